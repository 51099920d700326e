"""Text of single values: canonical cell text, numbers, quoting and escaping.

Every function maps Columns to a Column, so the work stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column, functions as F, types

T = TypeVar("T")

# Short JSON escapes by UTF-16 unit.
JSON_ESCAPES = [
    ("0008", "\\b"),
    ("0009", "\\t"),
    ("000A", "\\n"),
    ("000C", "\\f"),
    ("000D", "\\r"),
    ("0022", '\\"'),
    ("005C", "\\\\"),
]


def let(value: Column, body: Callable[[Column], Column], kind: str = "string") -> Column:
    """Evaluate `value` once and use it many times, also inside a lambda.

    `kind` is the type of the result. A fold over one element is cheaper than
    taking element 0 of a transformed array, which derives its type anew for every row.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def built_once(build: Callable[[], T]) -> Callable[[], T]:
    """Keep large expressions over fixed column names; building one takes thousands of JVM calls."""
    kept: dict = {}

    def get() -> T:
        gateway = id(SparkContext._gateway)
        if gateway not in kept:
            kept[gateway] = build()
        return kept[gateway]

    return get


def _strip_zeros(text: Column) -> Column:
    return F.rtrim(text, F.lit("0"))


def _pattern(number: Column, pattern: str) -> Column:
    return F.call_function("format_number", number, F.lit(pattern))


def _exponent_text(java: Column) -> Column:
    mantissa = F.substring_index(java, "E", 1)
    mantissa = F.when(
        mantissa.contains("."), F.rtrim(_strip_zeros(mantissa), F.lit("."))
    ).otherwise(mantissa)
    power = F.substring_index(java, "E", -1)
    digits = F.ltrim(power, F.lit("-"))
    return F.concat(
        mantissa,
        F.when(power.startswith("-"), "e-").otherwise("e+"),
        F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
    )


#: Below it doubles have fewer digits the smaller they are.
SUBNORMAL = 2.0**-1022


def is_common(number: Column) -> Column:
    """Whether a double is missing or prints like Java's: the cast to a string is its `float_text`."""
    size = F.abs(number)
    return number.isNull() | (size == 0) | ((size >= 1e-3) & (size < 1e7))


def float_text(value: Column, single: bool = False, every: bool = False) -> Column:
    """The shortest decimal text that reads back as the same number.

    `1.0`, `0.0001`, `1e-05`, `1e+16`, `inf`; NaN counts as missing. With
    `single`, the digits are those of a 32-bit number. With `every`, subnormal numbers, whole numbers from 1e16
    and powers of two are printed right as well; that expression is large, so it is for
    reading tables, once, and not for each format.
    """
    number = value.cast("float" if single else "double")
    return let(number, lambda n: let(n.cast("string"), lambda java: _float_text(n, java, single, every)))


def _float_text(number: Column, java: Column, single: bool, every: bool) -> Column:
    size = F.abs(number)
    fixed = _strip_zeros(java.cast("decimal(38,21)").cast("string"))
    fixed = let(
        fixed, lambda t: F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t)
    )
    digits = java
    if not single:
        # Java 17 may print a digit too many for very large or small numbers, and prints two at least.
        def shortest(places: range) -> Column:
            shorter = [_pattern(number, "0." + "#" * p + "E0" if p else "0E0") for p in places]
            if every:
                # Below a power of two doubles lie closer than above it, so what reads back may be the farther neighbour.
                shorter.insert(-1, let(_pattern(number, "0." + "#" * 16 + "E0"), _next_up))
            return F.coalesce(*[F.when(text.cast("double") == number, text) for text in shorter], java)

        if every:
            digits = (
                F.when(size < SUBNORMAL, shortest(range(17)))
                .when((size >= 1e16) & (size < 1e38), _whole_digits(number, size, java))
                .when((size >= 1e16) | (size < 1e-4), shortest(range(14, 17)))
                .otherwise(java)
            )
        else:
            digits = F.when((size >= 1e16) | (size < 1e-12), shortest(range(14, 17))).otherwise(java)
    return (
        F.when(F.isnan(number) | number.isNull(), F.lit(None).cast("string"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-4) & (size < (2.0**24 if single else 1e16)), fixed)
        .otherwise(let(digits, _exponent_text))
    )


def _next_up(text: Column) -> Column:
    """Of a number printed with 17 digits the next greater one, in size, with 16 digits; NULL if it has fewer."""
    digits = F.regexp_replace(F.substring_index(text, "E", 1), "[-.]", "")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    raised = (F.substring(digits, 1, 16).cast("bigint") + 1).cast("string")
    made = F.concat(sign, F.substring(raised, 1, 1), F.lit("."), F.substr(raised, F.lit(2)), F.lit("E"), F.substring_index(text, "E", -1))
    return F.when((F.length(digits) == 17) & (F.length(raised) == 16), made)


def _whole_digits(number: Column, size: Column, java: Column) -> Column:
    """Shortest digits of a whole number from 1e16 to 1e38, where Java's own may not be the nearest.

    The number is taken apart into its 53 bits and a power of two, whose product is exact as a decimal; it
    is rounded half to even at 15 and 16 digits, and the first that reads back is taken, else 17.
    """

    def rounded(exact: Column, places: int) -> Column:
        text = exact.cast("string")
        unit = F.rpad(F.lit("1"), F.length(text) - places + 1, F.lit("0")).cast("decimal(38,0)")
        whole = F.substring(text, 1, places).cast("bigint")
        rest = F.concat(F.lit("0"), F.substr(text, F.lit(places + 1))).cast("decimal(38,0)") * 2
        up = F.when((rest > unit) | ((rest == unit) & (whole % 2 == 1)), 1).otherwise(0)
        return let(
            (whole + up).cast("string"),
            lambda t: F.concat(
                F.when(number < 0, "-").otherwise(""), F.substring(t, 1, 1), F.lit("."), F.substr(t, F.lit(2)),
                F.lit("E"), (F.length(text) - places + F.length(t) - 1).cast("string"),
            ),
        )

    def shortest(exact: Column) -> Column:
        texts = [rounded(exact, p) for p in (15, 16, 17)]
        texts.insert(-1, let(texts[-1], _next_up))
        return F.coalesce(*[let(text, lambda t: F.when(t.cast("double") == number, t)) for text in texts], java)

    # Of the logarithm only the whole part counts; one too few or too many leaves a whole number of bits all the same.
    power = F.floor(F.log2(size)).cast("int") - 53
    one = F.lit(1).cast("bigint")
    steps = [F.least(power, F.lit(60)), F.greatest(power - 60, F.lit(0))]
    low, high = [F.call_function("shiftleft", one, n).cast("decimal(19,0)") for n in steps]
    factor = low * high
    bits = F.floor(size / F.pow(F.lit(2.0), power.cast("double"))).cast("decimal(19,0)")
    return F.when(power >= 0, let((bits * factor).cast("decimal(38,0)"), shortest)).otherwise(
        let(size.cast("bigint").cast("decimal(38,0)"), shortest)
    )


def three_digits(value: Column) -> Column:
    """A number at three significant digits: `12.3`, `12`, `1.23e+04`, `0.0012`."""
    return significant(value, 3)


def six_digits(value: Column) -> Column:
    """A number at six significant digits: `12345.7`, `12`, `1.23457e+06`, `0.0012`."""
    return significant(value, 6)


def significant(value: Column, places: int) -> Column:
    """A number at `places` significant digits without trailing zeros; NaN and missing ones are NULL.

    Subnormal numbers, which have fewer digits, may print fewer.
    """
    return let(value.cast("double"), lambda number: _significant(number, places))


def _significant(number: Column, places: int) -> Column:
    zeros = "0" * (places - 1)
    longer = _pattern(number, f"0.{zeros}0E0")
    # A tie of one digit more is exact only with few bits after the point: m / 2^k has k digits there.
    bits = 2.0 ** max(k for k in range(places * 4) if 5**k < 10 ** (places + 1))
    exact_tie = (
        longer.rlike(rf"^-?\d\.\d{{{places - 2}}}[02468]5E")
        & (longer.cast("double") == number)
        & (number * bits == F.rint(number * bits))
    )
    scientific = F.when(exact_tie, F.replace(longer, F.lit("5E"), F.lit("E"))).otherwise(
        _pattern(number, f"0.{zeros}E0")
    )
    power = F.substring_index(scientific, "E", -1).cast("int")
    fixed = F.rtrim(
        _strip_zeros(scientific.cast(f"decimal(20,{places + 5})").cast("string")), F.lit(".")
    )
    return (
        F.when(number.isNull() | F.isnan(number), F.lit(None).cast("string"))
        .when(F.abs(number) == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when(number == 0, F.when(number.cast("string").startswith("-"), "-0").otherwise("0"))
        .when(power.between(-4, places - 1), fixed)
        .otherwise(_exponent_text(scientific))
    )


def time_text(value: Column) -> Column:
    """`2024-01-01 00:00:00`, with six fraction digits only where there is a fraction."""
    return F.when(
        F.date_trunc("second", value) == value, F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def cell_text(value: Column, kind: types.DataType) -> Column:
    """The canonical text of a cell; missing values stay NULL."""
    if isinstance(kind, types.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(kind, types.FloatType):
        return float_text(value, single=True)
    if isinstance(kind, types.DoubleType):
        return float_text(value)
    if isinstance(kind, (types.TimestampType, types.TimestampNTZType)):
        return time_text(value)
    if isinstance(kind, (types.ArrayType, types.StructType, types.MapType)):
        return F.to_json(value)
    return value.cast("string")


def csv_quote(text: Column) -> Column:
    """Quote a field only if it holds a comma, a quote or a line break."""
    special = text.contains(",") | text.contains('"') | text.contains("\n") | text.contains("\r")
    return F.when(
        special,
        F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')),
    ).otherwise(text)


def json_escape(text: Column) -> Column:
    """The inside of an ASCII-only JSON string."""

    def unit(u: Column) -> Column:
        out = F.when(u == JSON_ESCAPES[0][0], F.lit(JSON_ESCAPES[0][1]))
        for code, short in JSON_ESCAPES[1:]:
            out = out.when(u == code, F.lit(short))
        return out.when(
            u.between("0020", "007E"), F.unhex(F.substring(u, 3, 2)).cast("string")
        ).otherwise(F.concat(F.lit("\\u"), F.lower(u)))

    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    special = (
        (F.length(text) != F.octet_length(text))
        | text.contains('"')
        | text.contains("\\")
        | text.rlike(r"\p{Cntrl}")
    )
    return F.when(special, F.array_join(F.transform(units, unit), "")).otherwise(text)


def json_string(text: Column) -> Column:
    return F.concat(F.lit('"'), json_escape(text), F.lit('"'))


def arrow_type_name(kind: types.DataType) -> str:
    """The name a columnar file gives the type; SQL types follow from it."""
    if isinstance(kind, types.DecimalType):
        return f"decimal128({kind.precision}, {kind.scale})"
    if isinstance(kind, types.ArrayType):
        return f"list<element: {arrow_type_name(kind.elementType)}>"
    if isinstance(kind, types.StructType):
        inner = ", ".join(f"{f.name}: {arrow_type_name(f.dataType)}" for f in kind.fields)
        return f"struct<{inner}>"
    if isinstance(kind, types.MapType):
        return f"map<{arrow_type_name(kind.keyType)}, {arrow_type_name(kind.valueType)}>"
    return {
        "tinyint": "int8",
        "smallint": "int16",
        "int": "int32",
        "bigint": "int64",
        "boolean": "bool",
        "timestamp": "timestamp[us, tz=UTC]",
        "timestamp_ntz": "timestamp[us]",
        "date": "date32[day]",
    }.get(kind.simpleString(), kind.simpleString())
