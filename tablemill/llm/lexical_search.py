"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector: for each term of the queries the whole contribution that the term would make to
a score. A query is then a 0/1 vector, and a score an inner product. Tasks take blocks of similar documents
and build a ball tree over each: a node knows its centroid and the radius around it that holds all its
documents. By Cauchy and Schwarz no document below a node scores more than <query, centroid> + |query| * radius;
that bound is computed in doubles and rounded up beyond any error they can have. A query visits nodes best
first and leaves the rest once a bound is less than its worst hit so far. Leaves are scored in integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablemill.llm.common import SLICE_BYTES, _tables, mix, partitions, powers, read, stage_and_free, text_buffers, word_bounds
from tablemill.llm.queries import query
from tablemill.llm.units import gather
from tablemill.session import stage

#: Hits of each query.
TOP = 50
#: Term saturation and length normalisation: 1000 * tf + SPREAD * m, where m is in percent of a mean document.
SPREAD, LENGTH_PERCENT = 20, 50
IMPACT, TF = 1_000_000_000, 1_000
#: Different terms of all queries in one pass over the documents, about; more queries go in further passes.
PASS_TERMS = 500_000
#: Cells of the 0/1 matrix of queries and terms that a tree is searched for at once.
CELLS = 2_000_000
#: Documents under one tree, and in a leaf.
BLOCK, LEAF = 4_096, 64
#: A gap cuts a node if it is at least one in WIDE of the width, and leaves one in UNEVEN documents on either side.
WIDE, UNEVEN = 10, 16
#: Share by which bounds are raised; sums of a million non-negative doubles err by less than a thousandth of it.
SAFE = 1e-6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that belong to no term.
_BREAK = np.array([not (b >= 128 or 48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])


def term_pieces(low: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most `most` bytes that no term crosses; a longer term makes a longer range."""
    at, n = 0, len(low)
    while at < n:
        end = min(at + most, n)
        if end < n and not _BREAK[low[end]] and offsets[np.searchsorted(offsets, end)] != end:
            breaks = np.flatnonzero(_BREAK[low[at:end]])
            edge = int(offsets[np.searchsorted(offsets, end) - 1])
            best = max(at + int(breaks[-1]) + 1 if len(breaks) else at, edge)
            if best <= at:
                further = np.flatnonzero(_BREAK[low[end : int(offsets[np.searchsorted(offsets, end)])]])
                best = end + int(further[0]) if len(further) else int(offsets[np.searchsorted(offsets, end)])
            end = best
        yield at, end
        at = end


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a text column: lower-case bytes, term starts and ends in them, and the terms' rows."""
    body, offsets = text_buffers(column)
    low = _LOWER[body]
    for a, b in term_pieces(low, offsets):
        first = np.searchsorted(offsets, a, "right") - 1
        last = np.searchsorted(offsets, b, "left")
        own = np.clip(offsets[first : last + 1], a, b) - a
        part = low[a:b]
        starts, ends, firsts = word_bounds(part, own, _BREAK)
        yield part, starts, ends, first + np.repeat(np.arange(len(own) - 1), np.diff(firsts))


def term_hashes(low: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    values, base, inverse = _tables(seed)
    weighted = np.where(_BREAK[low], np.uint64(0), values[low]) * powers(base, len(low))
    return mix(np.add.reduceat(weighted, starts) * powers(inverse, len(low))[starts])


class Dictionary:
    """Numbers of a bounded set of terms, found by hash and told by their bytes."""

    def __init__(self, terms: list[bytes]):
        joined = np.frombuffer(b" ".join(terms) or b" ", np.uint8)
        size = np.array([len(t) for t in terms], np.int64)
        start = np.concatenate(([0], np.cumsum(size + 1)))[:-1].astype(np.int64)
        for seed in count(11):
            keys = term_hashes(joined, start, seed)
            if len(np.unique(keys)) == len(keys):
                break
        order = np.argsort(keys)
        self.seed, self.keys, self.number = seed, keys[order], order
        self.pool, self.start, self.size = joined, start, size

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms are in the dictionary, and their numbers."""
        if not len(starts) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = term_hashes(low, starts, self.seed)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        number = self.number[at[hit]]
        size = ends[hit] - starts[hit]
        equal = size == self.size[number]
        hit, number, size = hit[equal], number[equal], size[equal]
        if len(hit):
            same = gather(low, starts[hit], size) == gather(self.pool, self.start[number], size)
            if not same.all():
                whole = np.logical_and.reduceat(same, np.concatenate(([0], np.cumsum(size)))[:-1])
                hit, number = hit[whole], number[whole]
        return hit, number


def item_terms(items: DataFrame, key: str) -> DataFrame:
    """key and term: the different terms of each item's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            own = batch[key].to_pylist()
            for low, starts, ends, row in terms_of(batch["text"]):
                raw = low.tobytes()
                different = {(r, raw[a:b]) for r, a, b in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True)}
                keys += [own[r] for r, _ in different]
                found += [t for _, t in different]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(found, pa.binary())], [key, "term"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, "text").mapInArrow(run, f"`{key}` {kind}, term binary").distinct()


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (those of the dictionary) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(terms)
        width = max(len(terms), 1)
        for batch in batches:
            rows = batch.num_rows
            n, codes, sums = np.zeros(rows, np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for low, starts, ends, row in terms_of(batch["text"]):
                n += np.bincount(row, minlength=rows)
                hit, number = known.find(low, starts, ends)
                code, times = np.unique(row[hit] * width + number, return_counts=True)
                codes.append(code)
                sums.append(times)
            # A document may lie in several pieces.
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            tf = np.bincount(back, np.concatenate(sums), len(code)).astype(np.int32)
            edge = pa.array(np.searchsorted(code, np.arange(rows + 1) * width).astype(np.int32))
            made = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in ((code % width).astype(np.int32), tf)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), *made], ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class BallTree:
    """Balls around sparse non-negative vectors: offsets into terms (ascending in each row) and values."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int):
        self.offsets, self.terms, self.values = offsets, terms, values
        self.size = np.diff(offsets)
        self.reals = values.astype(np.float64)
        row = np.repeat(np.arange(len(self.size)), self.size)
        self.norm = np.bincount(row, self.reals**2, len(self.size))
        self.room = np.zeros(width)
        self.rows: list[np.ndarray] = []
        self.center: list[tuple[np.ndarray, np.ndarray]] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        if len(self.size):
            self._grow(np.arange(len(self.size)))

    def entries(self, rows: np.ndarray) -> np.ndarray:
        return gather(np.arange(len(self.terms)), self.offsets[rows], self.size[rows])

    def _grow(self, rows: np.ndarray) -> None:
        """Nodes of these rows, parents before children."""
        waiting = [(rows, -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            me = len(self.rows)
            at = self.entries(rows)
            term, value = self.terms[at], self.reals[at]
            row = np.repeat(np.arange(len(rows)), self.size[rows])
            used, back = np.unique(term, return_inverse=True)
            mean = np.bincount(back, value, len(used)) / len(rows)
            own, norm = float(mean @ mean), self.norm[rows]
            apart = np.maximum(norm - 2 * np.bincount(row, value * mean[back], len(rows)) + own, 0)
            self.rows.append(rows)
            self.center.append((used, mean))
            # What the subtraction may lose is far less than this share of what is subtracted.
            self.radius.append(math.sqrt(float(apart.max()) + 1e-11 * (float(norm.max()) + own)) * (1 + SAFE))
            self.children.append(None)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (me, pair[1]) if side == 0 else (pair[0], me)
            if len(rows) <= LEAF or float(apart.max()) <= 1e-9 * (float(norm.max()) + own):
                continue
            # Along the line between two documents far apart, cut where there is a wide gap; else halve the given order.
            one = self._products(rows[int(apart.argmax())], term, value, row, len(rows))
            along = one - self._products(rows[int((norm - 2 * one).argmax())], term, value, row, len(rows))
            edge = -(-len(rows) // UNEVEN)
            placed = np.sort(along)
            gaps = np.diff(placed)[edge - 1 : len(rows) - edge]
            widest = int(gaps.argmax())
            first = np.arange(len(rows)) < len(rows) // 2
            if gaps[widest] * WIDE >= placed[-1] - placed[0] > 0:
                first = along <= placed[edge - 1 + widest]
            waiting.append((rows[~first], me, 1))
            waiting.append((rows[first], me, 0))

    def _products(self, pivot: int, term, value, row, n: int) -> np.ndarray:
        a, b = self.offsets[pivot], self.offsets[pivot + 1]
        self.room[self.terms[a:b]] = self.reals[a:b]
        out = np.bincount(row, value * self.room[term], n)
        self.room[self.terms[a:b]] = 0
        return out


class Hits:
    """The best documents of a query: higher scores first, then smaller keys."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def worst(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def offer(self, scores: np.ndarray, keys: np.ndarray) -> None:
        for k in np.flatnonzero(scores >= self.worst()).tolist():
            entry = (int(scores[k]), -int(keys[k]))
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def search(tree: BallTree, keys: np.ndarray, queries: np.ndarray, hits: list[Hits]) -> int:
    """Offers `hits` every document that can belong to them; the number of leaves scored.

    `queries` is a 0/1 matrix of queries and terms. Documents with a score of 0 are no hits.
    """
    if not tree.rows:
        return 0
    columns = np.ascontiguousarray(queries.T.astype(np.float64))
    length = np.sqrt(queries.sum(axis=1))
    bounds: dict[int, np.ndarray] = {}
    leaves: dict[int, tuple] = {}
    scored = 0

    def bound(node: int) -> np.ndarray:
        if node not in bounds:
            used, mean = tree.center[node]
            bounds[node] = (mean @ columns[used] + length * tree.radius[node]) * (1 + SAFE) + 1
        return bounds[node]

    for q, best in enumerate(hits):
        frontier = [(-float(bound(0)[q]), 0)]
        wanted = queries[q]
        while frontier:
            least, node = heapq.heappop(frontier)
            if -least < best.worst():
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if (b := float(bound(child)[q])) >= best.worst():
                        heapq.heappush(frontier, (-b, child))
                continue
            if node not in leaves:
                rows = tree.rows[node]
                at = tree.entries(rows)
                size = tree.size[rows]
                filled = size > 0
                leaves[node] = tree.terms[at], tree.values[at], (np.cumsum(size) - size)[filled], keys[rows[filled]]
            term, value, start, own = leaves[node]
            if len(start):
                best.offer(np.add.reduceat(value * wanted[term], start), own)
            scored += 1
    return scored


def query_groups(starts: np.ndarray, terms: np.ndarray, cells: int = CELLS) -> list[tuple[int, int]]:
    """Ranges of queries of whose different terms and number the product is at most `cells`, or single queries."""
    out, first, held = [], 0, set()
    for q in range(len(starts) - 1):
        own = set(terms[starts[q] : starts[q + 1]].tolist())
        if q > first and len(held | own) * (q - first + 1) > cells:
            out.append((first, q))
            first, held = q, set()
        held |= own
    return [*out, (first, len(starts) - 1)] if len(starts) > 1 else out


#: A null doc_id comes after all others.
LAST = (1 << 63) - 1


def _best(found: DataFrame, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """number (of the query), doc_id, score: the hits of each task."""
    width = len(weights)

    def impacts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        column = batch["terms"]
        offsets = column.offsets.to_numpy().astype(np.int64)
        term = column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        tf = batch["counts"].flatten().to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        n = np.repeat(batch["n"].to_numpy(), np.diff(offsets))
        m = (100 - LENGTH_PERCENT) + (LENGTH_PERCENT * n * documents) // length
        value = weights[term] * ((IMPACT * tf) // (TF * tf + SPREAD * m))
        ids = batch["doc_id"]
        return offsets, term, value, ids.fill_null(LAST).to_numpy().astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = []
        for a, b in query_groups(starts, terms):
            used = np.unique(terms[starts[a] : starts[b]])
            matrix = np.zeros((b - a, len(used)), np.int64)
            row = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
            matrix[row, np.searchsorted(used, terms[starts[a] : starts[b]])] = 1
            local = np.full(width, -1)
            local[used] = np.arange(len(used))
            groups.append((matrix, local, len(used), [Hits(top) for _ in range(b - a)]))
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                offsets, term, value, keys = impacts(batch.slice(low, BLOCK))
                for matrix, local, own, hits in groups:
                    kept = (local[term] >= 0) & (value > 0)
                    edges = np.concatenate(([0], np.cumsum(kept)))[offsets]
                    tree = BallTree(edges, local[term[kept]], value[kept], own)
                    search(tree, keys, matrix, hits)
        out, number = [], 0
        for *_, hits in groups:
            for best in hits:
                out += [(number, -key, score) for score, key in best.heap]
                number += 1
        ids = pa.array([x[1] if x[1] != LAST else None for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), ids, pa.array([x[2] for x in out], pa.int64())], ["number", "doc_id", "score"]
        )

    return found.mapInArrow(run, "number int, doc_id long, score long")


def _ranked(best: DataFrame, by: list, top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, key: str = "item_id", top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """`key`, rank, doc_id, score: the `top` documents with the highest scores above 0 of each item.

    `docs` has doc_id and text, `items` `key` and text; other columns don't matter. Rows with one key, null
    included, are one item. Every row of `docs` is a document; of equal scores the smaller doc_id comes
    first, a null one last. Texts that are null or have no term are no documents, and items without terms, or
    whose terms no document holds, have no rows.
    """
    asked = stage(item_terms(items, key))
    passes = max(1, -(-asked.count() // pass_terms))
    parts = [_rank_pass(docs, asked.where(F.pmod(F.xxhash64(key), F.lit(passes)) == k) if passes > 1 else asked, key, top) for k in range(passes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rank_pass(docs: DataFrame, asked: DataFrame, key: str, top: int) -> DataFrame:
    """The ranking for the items of one pass, whose terms (a bounded number) go to every task."""
    spark = docs.sparkSession
    pairs = asked.toArrow().sort_by([(key, "ascending"), ("term", "ascending")])
    terms = sorted(set(pairs["term"].to_pylist()))
    number = {t: k for k, t in enumerate(terms)}
    keys = pairs[key].to_pylist()
    own = np.array([number[t] for t in pairs["term"].to_pylist()], np.int64)
    firsts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    starts = np.array([*firsts, len(keys)], np.int64)

    found = stage(vectors(docs, terms))
    documents, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    weights = np.zeros(len(terms), np.int64)
    for t, df in zip(holding["t"].to_pylist(), holding["df"].to_pylist(), strict=True):
        weights[t] = weight(documents, df)
    # Documents with like terms under one ball.
    alike = F.array_min(F.transform("terms", lambda t: F.xxhash64(t)))
    near = found.where(F.size("terms") > 0).withColumns({"alike": alike, "same": F.xxhash64("terms", "counts")})
    near = near.repartitionByRange(partitions(spark), "alike", "same", "doc_id").sortWithinPartitions("alike", "same", "doc_id")
    best = stage_and_free(_best(near, starts, own, weights, documents, max(length, 1), top).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))))
    ranked = _ranked(_ranked(best, ["number", "part"], top).drop("rank", "part"), ["number"], top)
    schema = f"number int, `{key}` {asked.schema[key].dataType.simpleString()}"
    names = spark.createDataFrame([(k, keys[i]) for k, i in enumerate(firsts)], schema)
    return ranked.join(F.broadcast(names), "number").select(key, "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM d),
p AS (SELECT r, doc_id, len(ts) AS n, t, count(*) AS tf FROM d, unnest(ts) AS u(t) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, len(ts), t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""


@query("op12_lexical_search", _SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
