"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The input's own pieces (chunks of at most CHUNK rows) send rows to the shards. How many rows go from
each chunk to each shard is drawn first: the matrix with the chunks' sizes as row sums and the shards'
sizes as column sums, distributed as under a uniform permutation of all rows. It is drawn top-down
over a binary tree of chunks; at each node the left half's share of every shard is hypergeometric,
given what the shards before it took. Then each chunk permutes its rows and deals them out by its
row of the matrix, rows are exchanged, and each shard permutes what it received.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablemill.llm.common import let, read
from tablemill.llm.queries import query
from tablemill.session import stage

#: Rows of a chunk at most, and about the rows that one task orders within a shard.
CHUNK = 65_536
#: Attempts of a draw; each succeeds with a probability above 0.6.
ATTEMPTS = 96
#: Tree levels that one task draws before the nodes are spread over the cluster.
ALONE = 6


def _uniform(*keys) -> Column:
    """In (0, 1), decided by the keys alone."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def _log_factorial(x: Column) -> Column:
    """Exact below 20, Stirling's series with four terms above (error below 1e-12)."""
    series = (
        (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5.0))
    )
    return F.when(x < 20, F.log(F.factorial(F.greatest(x, F.lit(0.0)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(good: Column, bad: Column, draws: Column, *keys) -> Column:
    """How many of `draws` items taken without replacement are good.

    Ratio-of-uniforms rejection against the exact mass function, on the smaller of good and bad and
    of draws and the rest, so that the cost doesn't depend on the size of the numbers.
    """

    def body(v: Column) -> Column:
        small, large, taken = v["small"], v["large"], v["taken"]

        def log_mass(k: Column) -> Column:
            return -(_log_factorial(k) + _log_factorial(small - k) + _log_factorial(taken - k) + _log_factorial(large - taken + k))

        def attempt(i: Column) -> Column:
            point = F.struct(_uniform(*keys, i, 1).alias("x"), _uniform(*keys, i, 2).alias("y"))
            landed = let(point, lambda p: F.struct(p["x"].alias("x"), F.floor(v["centre"] + v["width"] * (p["y"] - 0.5) / p["x"]).cast("double").alias("k")))
            return let(
                landed,
                lambda q: F.when(
                    (q["k"] >= 0) & (q["k"] <= F.least(small, taken)),
                    F.when(2 * F.log(q["x"]) <= log_mass(q["k"]) - v["top"], q["k"]),
                ),
            )

        return F.coalesce(
            F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("double"), lambda got, i: F.coalesce(got, attempt(i))),
            v["mode"],
        )

    def shape(v: Column) -> Column:
        small, taken, all_ = v["small"], v["taken"], v["small"] + v["large"]
        share = small / all_
        spread = F.sqrt((all_ - taken) * taken * share * (1 - share) / (all_ - 1) + 0.5)
        mode = F.floor((taken + 1) * (small + 1) / (all_ + 2)).cast("double")
        return F.struct(
            small.alias("small"), v["large"].alias("large"), taken.alias("taken"),
            (taken * share + 0.5).alias("centre"),
            # The constants of the table mountain hat: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
            (spread * (2 * math.sqrt(2 / math.e)) + (3 - 2 * math.sqrt(3 / math.e))).alias("width"),
            mode.alias("mode"),
            (-(_log_factorial(mode) + _log_factorial(small - mode) + _log_factorial(taken - mode) + _log_factorial(v["large"] - taken + mode))).alias("top"),
        )

    folded = F.struct(
        F.least(good, bad).cast("double").alias("small"),
        F.greatest(good, bad).cast("double").alias("large"),
        F.least(draws, good + bad - draws).cast("double").alias("taken"),
    )
    drawn = let(let(folded, shape), body).cast("long")

    def unfold(k: Column) -> Column:
        of_good = F.when(good <= bad, k).otherwise(F.least(draws, good + bad - draws) - k)
        return F.when(2 * draws <= good + bad, of_good).otherwise(good - of_good)

    return (
        F.when((draws == 0) | (good == 0), F.lit(0).cast("long"))
        .when(bad == 0, draws)
        .when(draws == good + bad, good)
        .otherwise(let(drawn, unfold))
    )


def communication_matrix(chunks: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """chunk, counts array<long>: rows that each chunk sends to each shard.

    `chunks` (chunk int from 0 without gaps, n long) has about one row per CHUNK rows of the input
    and is gathered into one array; the sizes' sum is the sum of n.
    """
    spark, n_chunks = chunks.sparkSession, chunks.count()
    depth = max(0, (n_chunks - 1).bit_length())
    width = 1 << depth
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "n"))), lambda x: x["n"])
    nodes = chunks.agg(
        F.lit(0).cast("long").alias("node"),
        F.concat(gathered, F.array_repeat(F.lit(0).cast("long"), width - n_chunks)).alias("rows"),
        F.array(*[F.lit(s).cast("long") for s in sizes]).alias("counts"),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    for level in range(depth):
        half = width >> (level + 1)
        if level == ALONE:
            nodes = nodes.repartition(F.col("node"))

        def take(state: Column, j: Column) -> Column:
            capacity = F.get(F.col("counts"), j)
            drawn = hypergeometric(capacity, state["left"] - capacity, state["draws"], seed, F.lit(level), F.col("node"), j)  # noqa: B023
            return let(
                drawn,
                lambda x: F.struct(
                    (state["left"] - capacity).alias("left"),
                    (state["draws"] - x).alias("draws"),
                    F.concat(state["got"], F.array(x)).alias("got"),
                ),
            )

        start = F.struct(
            total(F.col("counts")).alias("left"),
            total(F.slice("rows", 1, half)).alias("draws"),
            F.array().cast("array<long>").alias("got"),
        )
        got = F.aggregate(F.sequence(F.lit(0), F.lit(len(sizes) - 1)), start, take, lambda s: s["got"])
        children = let(
            got,
            lambda x: F.array(
                F.struct((F.col("node") * 2).alias("node"), F.slice("rows", 1, half).alias("rows"), x.alias("counts")),
                F.struct(
                    (F.col("node") * 2 + 1).alias("node"),
                    F.slice("rows", half + 1, half).alias("rows"),
                    F.zip_with("counts", x, lambda a, b: a - b).alias("counts"),
                ),
            ),
        )
        nodes = nodes.select(F.explode(children).alias("c")).select("c.*")
    return nodes.where(F.col("node") < n_chunks).select(F.col("node").cast("int").alias("chunk"), "counts")


def shuffle_to_shards(rows: DataFrame, n_shards: int, seed: int = 1) -> DataFrame:
    """The rows with shard int and slot long; shards' counts differ by one at most.

    `rows` must be a stored table or another stable source of narrow rows. Every permutation of the
    rows over the slots is equally likely over seeds, up to double precision of the draws' weights.
    Nulls and repeated rows are rows like any other; an empty table stays empty. Columns named
    shard, slot, __piece, __row, __chunk, __counts, __rank are overwritten.
    """
    spark = rows.sparkSession
    local = F.monotonically_increasing_id()
    numbered = stage(rows.withColumn("__row", local).withColumn("__piece", F.shiftright("__row", 16)))
    sizes_of = stage(numbered.groupBy("__piece").agg(F.count(F.lit(1)).alias("n")))
    n_rows = sizes_of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = [n_rows // n_shards + (j < n_rows % n_shards) for j in range(n_shards)]
    # One row per chunk: about a 65,536th of the input's rows.
    chunks = stage(sizes_of.withColumn("chunk", F.row_number().over(Window.orderBy("__piece")) - 1))
    if not n_rows:
        return numbered.drop("__row", "__piece").withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    matrix = communication_matrix(chunks.select("chunk", "n"), sizes, seed).join(chunks.select("chunk", "__piece"), "chunk")
    order = Window.partitionBy("__piece").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "__row"), "__row")
    dealt = numbered.withColumn("__rank", F.row_number().over(order) - 1).join(
        matrix.select("__piece", F.col("counts").alias("__counts")), "__piece"
    )
    shard = F.aggregate(
        "__counts",
        F.struct(F.lit(0).alias("shard"), F.lit(0).cast("long").alias("upto")),
        lambda s, n: F.struct(
            (s["shard"] + F.when(s["upto"] + n <= F.col("__rank"), 1).otherwise(0)).alias("shard"),
            (s["upto"] + n).alias("upto"),
        ),
        lambda s: s["shard"],
    )
    # A shard's second permutation: rows in the order of a hash, cut into even ranges of it.
    parts = max(1, math.ceil(n_rows / n_shards / CHUNK))
    keyed = dealt.withColumns(
        {"shard": shard.cast("int"), "__key": F.xxhash64(F.lit(seed), F.lit("shard"), "__row")}
    ).drop("__counts", "__rank", "__piece")
    keyed = keyed.withColumn("__part", F.floor((F.shiftrightunsigned("__key", 11).cast("double") / float(1 << 53)) * parts).cast("int"))
    # The unsigned order of the key within a range of its upper bits.
    within = Window.partitionBy("shard", "__part").orderBy(F.shiftrightunsigned("__key", 11), "__row")
    keyed = stage(keyed.withColumn("__at", F.row_number().over(within)))
    bases = keyed.groupBy("shard", "__part").agg(F.max("__at").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = keyed.join(bases, ["shard", "__part"])
    return placed.withColumn("slot", (F.col("__base") + F.col("__at") - 1).cast("long")).drop(
        "__row", "__key", "__part", "__at", "__base"
    )


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`, with production settings."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = shuffle_to_shards(rows, 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
