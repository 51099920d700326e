"""Near-duplicate join on word shingles with Bayesian pruning of candidates.

Texts with equal shingle sets are one node. Nodes that agree in a band of MinHash values are candidates.
Within a band's bucket, the values of two nodes are compared step by step; a pair is dropped when, given the
matches so far, the posterior probability that its similarity reaches the threshold is below TOLERANCE.
What survives links nodes into small groups, in which every pair is verified exactly on its sets.

Pairs exist only as arrays inside a task: what leaves it is, per node, its number of links and
one edge that holds its group together. Buckets and groups of more than BLOCK nodes are cut into blocks, and
every two blocks meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablemill.llm.common import mix, partitions, process_cache, read, slices, text_buffers, word_bounds, word_hashes
from tablemill.llm.components import connected_components
from tablemill.llm.queries import query
from tablemill.llm.substring_dedup import window_prints
from tablemill.session import stage

SHINGLE = 5
#: The threshold as a fraction.
REACH = (4, 5)
BANDS, ROWS = 32, 4
#: MinHash values that one step compares.
STEP = 32
TOLERANCE = 1e-9
BLOCK = 1_024
NULL_KEY = -(1 << 63)


def shingle_sets(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 48-bit fingerprints of each document's different shingles, and n + 1 offsets.

    A document of fewer words than a shingle has, but not none, is one shingle.
    """
    starts, _, firsts = word_bounds(body, offsets)
    words = word_hashes(body, starts, 1)
    size = np.diff(firsts)
    prints = window_prints(words, SHINGLE)
    home = np.repeat(np.arange(len(size)), size)
    full = np.arange(len(words)) + SHINGLE <= firsts[1:][home] if len(words) else np.empty(0, bool)
    at = np.flatnonzero(full)
    value, doc = prints[at] if len(at) else np.empty(0, np.uint64), home[at]
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        extra = [mix(np.array([window_prints(words[firsts[k] : firsts[k + 1]], int(size[k]))[0]], np.uint64) + np.uint64(size[k]))[0] for k in short]
        value, doc = np.append(value, np.array(extra, np.uint64)), np.append(doc, short)
    # Documents of a slice are few enough for 16 bits.
    key = np.unique(doc.astype(np.uint64) << np.uint64(48) | value >> np.uint64(16))
    ends = np.searchsorted(key, np.arange(len(size) + 1, dtype=np.uint64) << np.uint64(48))
    return key & np.uint64((1 << 48) - 1), ends


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in slices(offsets):
        for c in range(a, b, 1 << 15):
            yield c, min(b, c + (1 << 15))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    kept = process_cache("minhash")
    if "factors" not in kept:
        rng = np.random.default_rng(11)
        n = BANDS * ROWS
        kept["factors"] = rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)
    return kept["factors"]


def minhash(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """16 bits of each of BANDS * ROWS MinHash values, a row per non-empty set."""
    start = ends[:-1][np.diff(ends) > 0]
    factor, offset = _factors()
    out = np.empty((len(start), len(factor)), np.uint16)
    if len(start):
        folded = mix(sets).astype(np.uint32)
        for k in range(len(factor)):
            value = (folded ^ offset[k]) * factor[k]
            value ^= value >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(value, start).astype(np.uint16)
    return out


def set_names(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set, as 16 bytes; of the empty set zeros."""
    size = np.diff(ends)
    out = np.zeros((len(size), 2), np.uint64)
    start = ends[:-1][size > 0]
    if len(start):
        for k in range(2):
            out[size > 0, k] = mix(np.add.reduceat(mix(sets ^ np.uint64((k + 1) << 56)), start) + size[size > 0].astype(np.uint64))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    ends = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("doc"), F.xxhash64(body).alias("th"), body.alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc, th (the text's hash), n (different shingles), name (of the set), sig (MinHash values; null for no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_buffers(batch["text"])
            for a, b in _slices(offsets):
                sets, ends = shingle_sets(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                full = np.diff(ends) > 0
                where = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)
                sig = _binary(minhash(sets, ends)).take(where)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part["doc"], part["th"], pa.array(np.diff(ends)), _binary(set_names(sets, ends)), sig], ["doc", "th", "n", "name", "sig"]
                )

    return _keyed(docs).mapInArrow(run, "doc long, th long, n long, name binary, sig binary")


def least_matches(compared: int) -> int:
    """Matches among `compared` values below which a pair is dropped.

    Under a uniform prior the similarity's posterior is Beta(matches + 1, misses + 1), whose tail above t is
    the chance of at most `matches` successes in compared + 1 trials of chance t.
    """
    t, total = REACH[0] / REACH[1], 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if total >= TOLERANCE:
            return m
    return compared


def held_together(sig: np.ndarray, group: np.ndarray, block: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """The least row of each row's component over the pairs that incremental comparison doesn't drop.

    `group` ascends and pairs stay within it. In a group that is `mixed`, only rows of different blocks are
    paired: others meet elsewhere. Rows that hang together already aren't compared again.
    """
    n = len(group)
    root, alive, d = np.arange(n), np.arange(n), 1
    needed = [(k, least_matches(k + STEP)) for k in range(0, sig.shape[1], STEP)]
    ends = np.searchsorted(group, group, "right")
    while True:
        alive = alive[alive + d < ends[alive]]
        if not len(alive):
            return root
        a = alive[(root[alive] != root[alive + d]) & (~mixed[alive] | (block[alive] != block[alive + d]))]
        matches = np.zeros(len(a), np.int64)
        for k, least in needed:
            matches += (sig[a, k : k + STEP] == sig[a + d, k : k + STEP]).sum(axis=1)
            stay = matches >= least
            a, matches = a[stay], matches[stay]
            if not len(a):
                break
        if len(a):
            root = _joined(root, a, a + d)
        d += 1


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after more edges."""
    while True:
        left, right = root[a], root[b]
        if np.array_equal(left, right):
            return root
        low = np.minimum(left, right)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        while not np.array_equal(root[root], root):
            root = root[root]


def _by_group(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups (rows with equal `grp`, `lo` and `hi`, which come together), of about `least` rows or one group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = _opens(table)
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield table.slice(0, last).combine_chunks()
        rest = table.slice(last).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _opens(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("grp", "lo", "hi"):
        column = table[name].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return new


def _blocked(rows: DataFrame, size: str, most: int) -> DataFrame:
    """Rows with blk, lo and hi: a group of `size` nodes in blocks, each row once per block that its own must meet."""
    spread = F.ceil(F.col(size) / most).cast("int")
    cut = rows.withColumn("blk", F.pmod(F.xxhash64("name", F.lit("block")), spread).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), spread - 1)))
    return cut.withColumns({"lo": F.least("blk", "other").cast("int"), "hi": F.greatest("blk", "other").cast("int")}).drop("other", size)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """a, b: edges that hold together the nodes (name, sig) whose pairs survive pruning."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    keys = nodes.select("name", F.explode(bands).alias("grp"))
    shared = keys.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = keys.join(shared, "grp").join(nodes.select("name", "sig"), "name")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches):
            group = np.cumsum(_opens(table))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(table.num_rows, -1)
            lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
            root = held_together(sig, group, table["blk"].to_numpy(), lo != hi)
            child = np.flatnonzero(root != np.arange(len(root)))
            names = table["name"].combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(child)), names.take(pa.array(root[child]))], ["a", "b"])

    return _grouped(_blocked(rows, "size", BLOCK)).select("grp", "lo", "hi", "blk", "name", "sig").mapInArrow(compare, "a binary, b binary")


def links_in(sets: list[np.ndarray], weight: np.ndarray, block: np.ndarray, mixed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links of each set, and the linked pairs, verified exactly."""
    size = np.array([len(s) for s in sets], np.int64)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    # Only shingles of several sets can be common ones.
    several = uses[column] > 1
    rank = np.cumsum(uses > 1) - 1
    row, column = row[several], rank[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4_096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (c, c + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - c] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = REACH[1] * common >= REACH[0] * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    if mixed:
        linked &= block[:, None] != block[None, :]
    return linked @ weight, *np.nonzero(np.triu(linked))


def exact_links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """name, links, root: for nodes of `groups` (name, doc, th, copies, grp, size), their verified links."""
    texts = _keyed(docs).join(groups.withColumnRenamed("name", "node"), ["doc", "th"])
    # Of repeated rows one is enough; the join has them side by side.
    copy = F.row_number().over(Window.partitionBy("doc", "th").orderBy("node"))
    texts = texts.withColumn("copy", copy).where("copy = 1").select("grp", "size", "node", "copies", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_buffers(batch["text"])
            for a, b in _slices(offsets):
                sets, ends = shingle_sets(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                raw = [sets[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["grp"], part["size"], part["node"], part["copies"], pa.array(raw, pa.binary())], ["grp", "size", "name", "copies", "items"]
                )

    made = texts.mapInArrow(cut, "grp long, size long, name binary, copies long, items binary")
    rows = _grouped(_blocked(made, "size", BLOCK // 2)).select("grp", "lo", "hi", "blk", "name", "copies", "items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, 500):
            cuts = np.append(np.flatnonzero(_opens(table)), table.num_rows)
            out: list[tuple[bytes, int, bytes]] = []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = table.slice(i, j - i)
                names = part["name"].to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in part["items"].to_pylist()]
                mixed = part["lo"][0].as_py() != part["hi"][0].as_py()
                links, a, b = links_in(sets, part["copies"].to_numpy(), part["blk"].to_numpy(), mixed)
                root = _joined(np.arange(len(names)), a, b)
                out += [(name, int(links[k]), names[root[k]]) for k, name in enumerate(names) if links[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
                ["name", "links", "root"],
            )

    return rows.mapInArrow(verify, "name binary, links long, root binary")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_shingles, doc, th, class_root: one row per row of `docs` (doc_id, text).

    n_links counts the other rows whose shingle sets have a Jaccard similarity of REACH or more, equal ones
    included; class_id is the least doc_id of all rows reached over links. A row without words has no links
    and is its own class. A null doc_id counts as the smallest long. (doc, th) names a row's document.
    Unrelated classes have one class_id if their least doc_ids are equal; class_root, the name of one of the
    class's shingle sets, tells them apart. It is null for rows without words.
    """
    signed = stage(signatures(docs))
    rows = signed.select("doc", "th", "n", "name")
    nodes = stage(
        signed.where("n > 0").groupBy("name").agg(F.min(F.struct("doc", "th")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    )
    groups = connected_components(candidate_edges(nodes))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    of = groups.join(sizes, "root").withColumnRenamed("node", "name").join(nodes.select("name", "first", "copies"), "name")
    of = of.select("name", "first.doc", "first.th", "copies", F.xxhash64("root").alias("grp"), "size")
    found = stage(exact_links(docs, of))
    links = found.groupBy("name").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("name").alias("a"), F.col("root").alias("b")))
    labelled = nodes.select("name", "first", "copies").join(classes.withColumnRenamed("node", "name"), "name", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "name")).join(links, "name", "left")
    least = labelled.groupBy("root").agg(F.min("first.doc").alias("class_id"))
    labelled = labelled.join(least, "root").select("name", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(labelled.withColumnRenamed("name", "node"), (F.col("name") == F.col("node")) & (F.col("n") > 0), "left")
    return out.select(
        F.when(F.col("doc") != NULL_KEY, F.col("doc")).alias("doc_id"),
        F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
        "doc", "th",
        F.col("root").alias("class_root"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class, the one with the least doc_id, with its own columns.

    Unrelated texts under one doc_id, or without any, are classes of their own. Documents without words stay,
    repeated rows of documents with words go.
    """
    groups = near_groups(docs.select("doc_id", "text")).where("n_shingles > 0")
    chosen = groups.groupBy("class_root").agg(F.min(F.struct("doc", "th")).alias("k")).select(F.col("k.doc").alias("__doc"), F.col("k.th").alias("__th"))
    body = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"__doc": F.coalesce("doc_id", F.lit(NULL_KEY)), "__th": F.xxhash64(body)})
    worded = body.rlike(r"[^ \x09-\x0D]")
    kept = keyed.where(worded).join(chosen, ["__doc", "__th"], "left_semi").dropDuplicates(["__doc", "__th"])
    return kept.unionByName(keyed.where(~worded)).drop("__doc", "__th")


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents."""
    return near_groups(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_shingles")
