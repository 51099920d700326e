"""Hard negatives by exact inner products: Strassen products of integer tiles and mergeable heaps.

Components are made integers, so every score is exact and ties are real. Tasks read their candidates in
stripes and meet all anchors, a block at a time, from files in the shared folder; a tile of scores is
the product of an anchor block and a candidate stripe, by Strassen's recursion on int64 with zero padding. Two
passes: the first keeps for each anchor a heap of its best rows of the same label, the second for
each such positive a heap of the best rows of other labels whose scores lie in its window. Heaps of
tiles, stripes and tasks merge in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablemill.llm.common import new_folder, open_store, read, stage_and_free
from tablemill.llm.queries import query
from tablemill.session import stage

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH percent of the positive's.
LOW, HIGH = 50, 95
#: Components are multiplied by this before they are rounded down.
SCALE = 256
#: Rows of an anchor block and of a stripe of candidates; columns of a tile.
BLOCK, STRIPE, TILE = 1_024, 32_768, 4_096
#: Strassen's recursion ends where a side is no longer than this.
SIDE = 32
#: A null vec_id comes after all others.
LAST = (1 << 63) - 1


def strassen(a: np.ndarray, b: np.ndarray, side: int = SIDE) -> np.ndarray:
    """a @ b of int64 matrices, exact; beyond 64 bits sums wrap, as they would without the recursion."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= side:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, side)[:m, :n]
    a11, a12, a21, a22 = a[: m // 2, : k // 2], a[: m // 2, k // 2 :], a[m // 2 :, : k // 2], a[m // 2 :, k // 2 :]
    b11, b12, b21, b22 = b[: k // 2, : n // 2], b[: k // 2, n // 2 :], b[k // 2 :, : n // 2], b[k // 2 :, n // 2 :]
    out = np.empty((m, n), np.int64)
    c11, c12, c21, c22 = out[: m // 2, : n // 2], out[: m // 2, n // 2 :], out[m // 2 :, : n // 2], out[m // 2 :, n // 2 :]
    p = strassen(a11 + a22, b11 + b22, side)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, side)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, side)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, side)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, side)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, side)
    c11 += strassen(a12 - a22, b21 + b22, side)
    return out


class Heaps:
    """For each of n owners the best `top` pairs (score, id): higher scores first, then smaller ids."""

    def __init__(self, score: np.ndarray, id: np.ndarray, filled: np.ndarray):
        self.score, self.id, self.filled = score, id, filled

    @staticmethod
    def none(n: int, top: int) -> Heaps:
        return Heaps(np.zeros((n, top), np.int64), np.full((n, top), LAST), np.zeros((n, top), bool))

    @staticmethod
    def of_tile(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, top: int) -> Heaps:
        """The best of each row of a tile; `ids` of the columns ascend."""
        out, left = Heaps.none(len(scores), top), allowed.copy()
        row = np.arange(len(scores))
        least = np.iinfo(np.int64).min
        for k in range(min(top, scores.shape[1])):
            open_scores = np.where(left, scores, least)
            at = open_scores.argmax(axis=1)
            found = left[row, at]
            # A score that is the least integer looks like one that isn't allowed.
            lost = np.flatnonzero(~found & left.any(axis=1))
            at[lost] = left[lost].argmax(axis=1)
            found = left[row, at]
            out.score[:, k], out.filled[:, k] = np.where(found, scores[row, at], 0), found
            out.id[:, k] = np.where(found, ids[at], LAST)
            left[row, at] = False
        return out

    def merge(self, other: Heaps) -> Heaps:
        top = self.score.shape[1]
        score, id, filled = (np.concatenate([getattr(self, c), getattr(other, c)], axis=1) for c in ("score", "id", "filled"))
        # ~score turns the order of all int64 without overflow.
        order = np.lexsort((id, ~score, ~filled), axis=1)[:, :top]
        return Heaps(*(np.take_along_axis(x, order, axis=1) for x in (score, id, filled)))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, parts: rows with a label and a finite vector, whose components are rounded integers."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    kept = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("parts"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter lists end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


class Rows:
    """Ids, labels and vectors, sorted by label and id, and the ranges of the labels."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, *more: str):
        id = np.asarray(batch["vec_id"].fill_null(LAST).to_numpy(), np.int64)
        label = np.asarray(batch["label"].to_numpy(), np.int64)
        order = np.lexsort((id, label))
        self.id, self.label, self.parts = id[order], label[order], _matrix(batch["parts"], 0)[order]
        self.more = {c: [batch[c][int(k)].as_py() for k in order] for c in more}
        cuts = np.flatnonzero(np.diff(self.label)) + 1
        self.ranges = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(id)], strict=True)) if len(id) else []

    def __len__(self) -> int:
        return len(self.id)


def _product(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of a tile; vectors of unlike length are compared as if zeros followed the shorter."""
    width = min(anchors.shape[1], candidates.shape[1])
    return strassen(np.ascontiguousarray(anchors[:, :width]), np.ascontiguousarray(candidates[:, :width].T))


def _stripes(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[Rows]:
    """A task's candidates, about `rows` at a time."""
    held, n = [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            held.append(batch.slice(low, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield Rows(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield Rows(pa.Table.from_batches(held))


def _blocks(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """All anchors, a block at a time, from the Parquet files of a shared folder."""
    from pyarrow import fs

    store, path = open_store(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                yield from (b for b in pq.ParquetFile(file).iter_batches(rows) if b.num_rows)


def _best(anchors: DataFrame, folder: str, candidates: DataFrame, positives: int, sizes: tuple[int, int, int]) -> DataFrame:
    """anchor, id, score: per anchor and stripe the best rows of the anchor's label, the anchor's own vec_id aside."""
    block, stripe, tile = sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _stripes(batches, stripe):
            where = {int(rows.label[a]): (a, b) for a, b in rows.ranges}
            for batch in _blocks(folder, block):
                own = Rows(batch, "anchor")
                for a, b in own.ranges:
                    low, high = where.get(int(own.label[a]), (0, 0))
                    best = Heaps.none(b - a, positives)
                    for at in range(low, high, tile):
                        to = min(at + tile, high)
                        scores = _product(own.parts[a:b], rows.parts[at:to])
                        best = best.merge(Heaps.of_tile(scores, own.id[a:b, None] != rows.id[None, at:to], rows.id[at:to], positives))
                    anchor = np.repeat(np.array(own.more["anchor"][a:b], np.int64), positives).reshape(best.id.shape)
                    yield _records(best, anchor=anchor)

    return candidates.mapInArrow(run, "anchor long, id long, score long")


def _records(best: Heaps, **columns: np.ndarray) -> pa.RecordBatch:
    f = best.filled
    id = pa.array(best.id[f], mask=best.id[f] == LAST)
    made = {k: pa.array(v[f]) for k, v in columns.items()} | {"id": id, "score": pa.array(best.score[f])}
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest negative score for a positive's: low * score <= 100 * x <= high * score."""
    return -((-low * score) // 100), high * score // 100


def _in_windows(folder: str, candidates: DataFrame, negatives: int, low: int, high: int, sizes: tuple[int, int, int]) -> DataFrame:
    """anchor, place, id, score: per positive (by place) and stripe the best rows of other labels in its window."""
    block, stripe, tile = sizes

    def bounds(own: Rows, a: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        found = [window(scores[k], low, high) if k < len(scores) else (1, 0) for scores in own.more["scores"][a:b]]
        limit = np.iinfo(np.int64)
        return tuple(np.array([min(max(x[i], limit.min), limit.max) for x in found], np.int64)[:, None] for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _stripes(batches, stripe):
            # Tiles of ascending ids.
            order = np.argsort(rows.id, kind="stable")
            id, label, parts = rows.id[order], rows.label[order], rows.parts[order]
            for batch in _blocks(folder, block):
                own = Rows(batch, "anchor", "scores")
                places = max((len(s) for s in own.more["scores"]), default=0)
                limits = [bounds(own, 0, len(own), k) for k in range(places)]
                best = [Heaps.none(len(own), negatives) for _ in range(places)]
                for at in range(0, len(id), tile):
                    scores = _product(own.parts, parts[at : at + tile])
                    other = own.label[:, None] != label[None, at : at + tile]
                    for k, (least, most) in enumerate(limits):
                        fits = (scores >= least) & (scores <= most) & other
                        hit = np.flatnonzero(fits.any(axis=1))
                        if len(hit):
                            found = Heaps.of_tile(scores[hit], fits[hit], id[at : at + tile], negatives)
                            whole = Heaps.none(len(own), negatives)
                            whole.score[hit], whole.id[hit], whole.filled[hit] = found.score, found.id, found.filled
                            best[k] = best[k].merge(whole)
                anchor = np.repeat(np.array(own.more["anchor"], np.int64), negatives).reshape(len(own), negatives)
                for k, heaps in enumerate(best):
                    yield _records(heaps, anchor=anchor, place=np.full(anchor.shape, k, np.int32))

    return candidates.mapInArrow(run, "anchor long, place int, id long, score long")


def _top(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _stored(df: DataFrame, kind: str) -> str:
    """A table in a folder that tasks read by themselves."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return folder


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    sizes: tuple[int, int, int] = (BLOCK, STRIPE, TILE),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` has vec_id, embedding and label; other columns don't matter. Rows with a null label, a null vector or
    a null or non-finite component take no part; an empty vector scores 0 with all. `is_anchor` is a
    condition on vec_id. A row with an anchor's vec_id is none of its positives. Every row counts: a repeated
    anchor has its results twice, a repeated candidate can be listed twice. Equal scores go by the smaller
    vec_id, a null one last. Positives without a negative in their window have no rows. Integers beyond 64
    bits saturate as components and wrap as scores.
    """
    ready = stage(usable(rows))
    anchors = stage(ready.where(F.coalesce(is_anchor, F.lit(False))).withColumn("anchor", F.monotonically_increasing_id()))
    best = _best(anchors, _stored(anchors, "anchors"), ready, positives, sizes)
    chosen = stage_and_free(_top(best, ["anchor"], positives))
    listed = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    listed = listed.select("anchor", F.col("p.id").alias("ids"), F.col("p.score").alias("scores"))
    windows = stage_and_free(anchors.join(listed, "anchor"))
    found = _in_windows(_stored(windows, "windows"), ready, negatives, low, high, sizes)
    kept = _top(found, ["anchor", "place"], negatives)
    named = windows.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "x"))
    named = named.select("anchor", "anchor_id", "place", F.col("x.ids").alias("positive_id"), F.col("x.scores").alias("positive_score"))
    return kept.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def moved_labels(rows: DataFrame) -> DataFrame:
    """The labels that the query mines: that of every seventh vec_id is the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))


_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a_id, a.label AS a_label, c.vec_id AS c_id, c.label AS c_label,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, c.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT a_id, a_label, c_id AS p_id, score AS p_score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, c_id) AS k
  FROM s WHERE a_label = c_label),
n AS (
  SELECT p.a_id, p.p_id, p.p_score, s.c_id AS n_id, s.score AS n_score,
         row_number() OVER (PARTITION BY p.a_id, p.p_id ORDER BY s.score DESC, s.c_id) AS k
  FROM p JOIN s ON p.a_id = s.a_id AND s.c_label <> s.a_label AND 50 * p.p_score <= 100 * s.score AND 100 * s.score <= 95 * p.p_score
  WHERE p.k <= 5)
SELECT a_id AS anchor_id, p_id AS positive_id, CAST(k AS INTEGER) AS rank, n_id AS negative_id, p_score AS positive_score, n_score AS negative_score
FROM n WHERE k <= 3
"""


@query("op13_hard_negatives", _SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every fiftieth vector against all."""
    return mine(moved_labels(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
