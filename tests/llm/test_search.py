import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import CLASHING, prose, table

from tablemill.llm import hard_negatives, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(rows, items, top):
    """(item, rank, doc_id, score) by the contract."""
    docs = [(d, terms(t)) for d, t in rows]
    documents, length = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, t in docs:
            score = 0
            for x in wanted & set(t):
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[x] + 1)))
                score += w * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 20 * (100 - 50 + (50 * len(t) * documents) // length)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored)[:top])]
    return out


ITEMS = [
    (1, "alpha beta the of and tion Reon x don't R2D2 naïve"), (2, None), (3, ""), (4, "ONE two three"), (4, "größe GRÖSSE"), (5, "!! ??"),
    (None, "日本 straße"), (6, "nowhere zzz"), (7, "edited"), (7, "edited"),
]


@pytest.mark.parametrize("top", [1, 5, 50])
def test_ranking_against_plain_python(spark, docs, rows, top):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical_search.rank(docs, items, top=top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert table(found, *found.columns) == sorted(ranking(rows, ITEMS, top), key=repr)


def test_ranking_in_passes_small_blocks_and_pieces(spark, clashing, rows, empty, monkeypatch):
    items = spark.createDataFrame([(*x, "c", "c") for x in ITEMS], "item_id long, text string, term string, number string")
    want = sorted(ranking(rows, ITEMS, 7), key=repr)
    for name, value in (("BLOCK", 9), ("LEAF", 2), ("CELLS", 12)):
        monkeypatch.setattr(lexical_search, name, value)
    found = lexical_search.rank(clashing, items, top=7, pass_terms=6)
    assert table(found, *found.columns) == want
    assert lexical_search.rank(empty, items).count() == 0
    assert lexical_search.rank(clashing, items.limit(0)).count() == 0
    assert lexical_search.rank(clashing, items.select(F.col("item_id").cast("string"), "text"), top=7).schema["item_id"].dataType.simpleString() == "string"


@pytest.mark.parametrize("most", [1, 3, 64])
def test_terms_in_pieces(rows, most, monkeypatch):
    texts = [t for _, t in rows if t is None or len(t) < 3_000][:40] + ["", "a", "é" * 30, None, "Ab" * 50]
    monkeypatch.setattr(lexical_search.term_pieces, "__defaults__", (most,))
    found = [[] for _ in texts]
    for low, starts, ends, row in lexical_search.terms_of(pa.array(texts)):
        for r, a, b in zip(row, starts, ends, strict=True):
            found[r].append(low[a:b].tobytes().decode())
    assert found == [terms(t) for t in texts]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    known = lexical_search.Dictionary([b"one", b"three", b"two"])
    monkeypatch.setattr(lexical_search, "term_hashes", lambda low, starts, seed: np.full(len(starts), known.keys[1]))
    text = np.frombuffer(b"one two three four six", np.uint8)
    hit, number = known.find(text, np.array([0, 4, 8, 14, 19]), np.array([3, 7, 13, 18, 22]))
    word = known.number[1]
    assert hit.tolist() == [[0, 2, 1][word]] and number.tolist() == [word]


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_what_a_scan_finds(seed):
    rng = np.random.default_rng(seed)
    width, n = 60, 700
    dense = rng.integers(0, 10**9, (n, width)) * (rng.random((n, width)) < 0.15)
    dense[300:] = dense[rng.integers(0, 3, 400)]
    keys = rng.permutation(n)
    offsets = np.concatenate(([0], np.cumsum((dense > 0).sum(axis=1))))
    tree = lexical_search.BallTree(offsets, np.nonzero(dense)[1], dense[dense > 0], width)
    queries = (rng.random((12, width)) < 0.2).astype(np.int64)
    hits = [lexical_search.Hits(10) for _ in queries]
    scored = lexical_search.search(tree, keys, queries, hits)
    for q, best in zip(queries, hits, strict=True):
        scores = dense @ q
        order = sorted((-s, k) for s, k in zip(scores.tolist(), keys.tolist(), strict=True) if s > 0)[:10]
        assert sorted(best.heap, reverse=True) == [(-s, -k) for s, k in order]
    assert scored <= len(queries) * sum(c is None for c in tree.children)
    for node, rows in enumerate(tree.rows):
        used, mean = tree.center[node]
        center = np.zeros(width)
        center[used] = mean
        assert np.sqrt(((dense[rows] - center) ** 2).sum(axis=1)).max() <= tree.radius[node]


def test_tree_prunes_groups_of_near_copies():
    rng = np.random.default_rng(2)
    groups = np.kron(np.eye(16, dtype=np.int64), np.full((1, 5), 10**9))
    dense = rng.permutation(np.repeat(groups, 200, axis=0)) + rng.integers(0, 10**6, (3200, 80))
    tree = lexical_search.BallTree(np.arange(3201) * 80, np.tile(np.arange(80), 3200), dense.ravel(), 80)
    queries = np.zeros((1, 80), np.int64)
    queries[0, 10:15] = 1
    hits = [lexical_search.Hits(20)]
    scored = lexical_search.search(tree, np.arange(3200), queries, hits)
    scores = dense @ queries[0]
    assert sorted(s for s, _ in hits[0].heap) == sorted(scores.tolist())[-20:]
    assert scored < sum(c is None for c in tree.children) / 4


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (40, 33, 65), (64, 64, 64), (70, 64, 129), (100, 0, 7), (0, 4, 4)])
@pytest.mark.parametrize("side", [1, 4, 32])
def test_strassen(shape, side):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(1 << 62), 1 << 62, (m, k)), rng.integers(-300, 300, (k, n))
    assert np.array_equal(hard_negatives.strassen(a, b, side), a @ b)


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    scores, allowed = rng.integers(-3, 3, (6, 40)), rng.random((6, 40)) < 0.4
    scores[0, :5] = np.iinfo(np.int64).min
    allowed[0, 5:] = False
    allowed[1] = False
    ids = np.arange(40) * 3
    tiles = [hard_negatives.Heaps.of_tile(scores[:, a:b], allowed[:, a:b], ids[a:b], 4) for a, b in ((0, 9), (9, 10), (10, 40))]
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        merged = hard_negatives.Heaps.none(6, 4)
        for k in order:
            merged = merged.merge(tiles[k])
        for row in range(6):
            want = sorted((-int(s), int(i)) for s, i, ok in zip(scores[row], ids, allowed[row], strict=True) if ok)[:4]
            found = [(-int(s), int(i)) for s, i, ok in zip(merged.score[row], merged.id[row], merged.filled[row], strict=True) if ok]
            assert found == want


def negatives(rows, positives=5, most=3):
    """The contract in plain Python; rows are (vec_id, label, vector)."""
    last = 1 << 63
    ready = []
    for vec, label, vector in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            ready.append((vec, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    def order(x):
        return -x[0], last if x[1] is None else x[1]
    out = []
    for a, label, vector in ready:
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v)), i, k) for i, k, v in ready if i != a]
        for ps, pid, _ in sorted([s for s in scored if s[2] == label], key=order)[:positives]:
            fits = sorted([s for s in scored if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps], key=order)[:most]
            out += [(a, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(fits)]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.uniform(-0.3, 0.6) for _ in range(9)]) for i in range(400)]
    rows += [(1_000 + i, 1, rows[50][2]) for i in range(30)] + [(2_000 + i, 2, rows[50][2][:5]) for i in range(3)]
    rows += [rows[100], rows[100], rows[7], (None, 1, rows[50][2]), (None, 0, [0.9] * 9), (None, None, None), (3_000, 1, None), (3_050, None, rows[0][2]), (-50, 0, rows[3][2])]
    rows += [(4_000, 1, [0.1, None, 0.2]), (4_050, 1, [0.1, float("nan")]), (4_100, 2, [float("inf")]), (4_150, 1, []), (4_200, 0, [0.0] * 9)]
    rng.shuffle(rows)
    return rows


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("sizes", [(1024, 32768, 4096), (5, 37, 11)])
def test_hard_negatives_against_plain_python(spark, vectors, sizes):
    rows = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").repartition(3)
    clash = rows.withColumns({c: F.lit("clash") for c in (*CLASHING, "anchor", "parts", "place", "id", "score", "ids", "scores", "rank")})
    found = hard_negatives.mine(clash, F.col("vec_id") % 50 == 0, sizes=sizes)
    assert found.columns == COLUMNS
    want = negatives(vectors)
    assert table(found, *COLUMNS) == sorted(want, key=repr)
    assert len(want) > 50 and any(r[3] is None or r[1] is None for r in want)
    assert hard_negatives.mine(rows.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_windows_at_their_edges():
    for score in [*range(-50, 300), (1 << 63) - 1, -(1 << 63)]:
        least, most = hard_negatives.window(score)
        for x in {least - 1, least, most, most + 1}:
            assert (50 * score <= 100 * x <= 95 * score) == (least <= x <= most)


def test_integers_out_of_range_do_not_fail(spark):
    rows = [(0, 1, [3e38, -3e38]), (1, 1, [3e38, 1.0]), (2, 2, [1e30, 1e30]), (50, 1, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(frame, F.col("vec_id") % 50 == 0).count() >= 0
    assert prose(random.Random(1), 2)
