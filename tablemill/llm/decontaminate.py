"""Benchmark decontamination with one Aho-Corasick automaton per block of benchmark windows.

Benchmark items are normalised and cut into windows of WINDOW words; the windows are the patterns.
Texts are normalised the same way and scanned once: the automaton reports every window that occurs, and
a map from normalised to original offsets gives the hit words and spans of the original text.

Normalisation works on UTF-8 bytes: A-Z become a-z and every other ASCII byte that is no letter or
digit becomes a space, so that offsets stay; then each run of spaces becomes one space.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemill.llm.common import process_cache, read
from tablemill.llm.queries import query
from tablemill.session import stage

WINDOW = 13
#: Share of a text's words above which (and at which) it is contaminated, as 1 / ONE_IN.
ONE_IN = 20
#: Bytes of patterns in one automaton at most: about 100 bytes of memory each. A larger benchmark
#: is cut into blocks that the tasks scan for in turn.
BLOCK_BYTES = 1_000_000

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def normalise(text: bytes) -> bytes:
    """Lower-case words joined by one space, with one space before and after; b" " if there is none."""
    words = text.translate(_TABLE).split(b" ")
    return b" " + b" ".join(filter(None, words)) + b" " if any(words) else b" "


def item_windows(item: str | None, width: int) -> list[bytes]:
    """The item's windows as patterns, each between spaces; a shorter item is one window."""
    words = normalise((item or "").encode()).split()
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))] if words else []


def _patterns(benchmark: DataFrame, width: int) -> DataFrame:
    """pattern, ids: every different window with the items that hold it, without null ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                of = set(item_windows(text, width))
                keys += [key] * len(of)
                found += of
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.binary())], ["id", "pattern"])

    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(cut, "id string, pattern binary")
    return rows.groupBy("pattern").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def blocks(benchmark: DataFrame, width: int = WINDOW, unnamed: bool = False) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The benchmark's windows in blocks that fit an automaton; at least one block, which may be empty.

    The benchmark is a stated query set: its windows pass through the driver a block at a time, to
    be sent to the tasks that read all texts. Items with a null id have windows if `unnamed`, but no name.
    """
    rows = stage(_patterns(benchmark if unnamed else benchmark.where(F.col("item_id").isNotNull()), width))
    block: list[tuple[bytes, list[str]]] = []
    held = 0
    for row in rows.toLocalIterator():
        if held and held + len(row["pattern"]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((bytes(row["pattern"]), list(row["ids"])))
        held += len(row["pattern"])
    yield block


class Scanner:
    """Finds a block's windows in normalised texts."""

    def __init__(self, block: list[tuple[bytes, list[str]]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (pattern, _) in enumerate(block):
            # One character for each byte.
            self.automaton.add_word(pattern.decode("latin-1"), (k, len(pattern)))
        if block:
            self.automaton.make_automaton()
        self.ids = [ids for _, ids in block]

    def scan(self, normal: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """Byte ranges of occurrences between their outer spaces, and the items they belong to."""
        spans, items = [], set()
        if len(self.ids):
            for end, (k, size) in self.automaton.iter(normal.decode("latin-1")):
                spans.append((end - size + 2, end))
                items.update(self.ids[k])
        return spans, items


def hit_words(normal: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each word whether a span covers it."""
    space = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    change = np.zeros(len(space), np.int64)
    at = np.asarray(spans, np.int64)
    # Word i stands after the i-th space; a span starts after one space and ends at another.
    np.add.at(change, np.searchsorted(space, at[:, 0]) - 1, 1)
    np.add.at(change, np.searchsorted(space, at[:, 1]), -1)
    return np.cumsum(change)[:-1] > 0


def original_ranges(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the original text that runs of hit words cover."""
    word = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(turn[::2], turn[1::2], strict=True)]


SCHEMA = "n_words long, n_hit long, items array<string>, ranges array<struct<start:long,end:long>>"
STATE = "spans array<struct<start:long,end:long>>, items array<string>"
#: Automata that a process keeps, by their block's name.
AUTOMATA = 2


def _scanner(name: str, block: Broadcast) -> Scanner:
    kept = process_cache("scanners", large=True)
    found = kept.pop(name, None) or Scanner(block.value)
    kept[name] = found
    while len(kept) > AUTOMATA:
        kept.pop(next(iter(kept)))
    return found


def _search(name: str, block: Broadcast, last: bool):
    """A scan for one block that takes the earlier blocks' findings along; the last one sums up."""

    def one(text: str | None, spans: list, items: set) -> tuple:
        raw = text.encode() if text else b""
        normal = normalise(raw)
        more, names = _scanner(name, block).scan(normal)
        spans, items = spans + more, items | names
        if not last:
            return [{"start": a, "end": b} for a, b in spans], sorted(items)
        n = normal.count(b" ") - 1
        if not spans:
            return n, 0, [], []
        hit = hit_words(normal, spans)
        ranges = [{"start": a, "end": b} for a, b in original_ranges(raw, hit)]
        return n, int(hit.sum()), sorted(items), ranges

    columns = ["n_words", "n_hit", "items", "ranges"] if last else ["spans", "items"]

    def search(texts: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
        before = zip(earlier["spans"], earlier["items"], strict=True)
        rows = [one(t, [(x["start"], x["end"]) for x in spans], set(items)) for t, (spans, items) in zip(texts, before, strict=True)]
        return pd.DataFrame(rows, columns=columns)

    def search_first(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, [], set()) for t in texts], columns=columns)

    kind = SCHEMA if last else STATE
    return F.pandas_udf(search, kind), F.pandas_udf(search_first, kind)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """`docs` (any columns, with `text`) and what was found in each text.

    n_words, n_hit, items (sorted ids of the items with an occurring window) and ranges (original byte
    ranges of hit words) are appended in a struct `found`; a column of that name is overwritten.
    Null and empty texts have no words. Every row, repeated or not, is judged alone. Items with a null id are
    left out, or, if `unnamed`, searched for like others without being among `items`.
    """
    context = docs.sparkSession.sparkContext
    run, state, waiting, k = uuid.uuid4().hex, None, None, 0

    def scanned(block: list, last: bool) -> Column:
        later, first = _search(f"{run}-{k}", context.broadcast(block), last)
        return first("text") if state is None else later("text", state)

    for block in blocks(benchmark, width, unnamed):
        if waiting is not None:
            state = scanned(waiting, last=False)
            k += 1
        waiting = block
    return docs.withColumn("found", scanned(waiting, last=True))


def contaminated(found: str = "found") -> Column:
    return (F.col(f"{found}.n_hit") > 0) & (ONE_IN * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    return find(docs, benchmark, width, unnamed).where(~contaminated()).drop("found")


@query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of all documents against the whole benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, read(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select(
        "doc_id", "found.n_words", "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
