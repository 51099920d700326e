import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from tests.llm import brute
from tests.llm.conftest import table

from tablemill.llm import jaccard_join, substring_dedup, suffix_dedup
from tablemill.llm.components import connected_components


def test_substring_dedup(docs, rows):
    found = substring_dedup.remove_repeats(docs)
    assert table(found, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup(rows), key=repr)
    assert set(docs.columns) < set(found.columns)


def test_substring_dedup_clashing_and_empty(clashing, empty, rows):
    found = substring_dedup.remove_repeats(clashing)
    assert table(found, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup(rows), key=repr)
    assert found.where("body <> 'clash' OR marks <> 'clash' OR doc <> 'clash'").count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_cut_repeats_leaves_clean_texts_alone(docs, rows):
    cut = substring_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    removed = brute.substring_dedup(rows)
    expected = [(doc, kept if n else text, len(kept) if n else text and len(text)) for (doc, text), (_, _, n, kept) in zip(rows, removed, strict=True)]
    assert [r[:2] for r in table(cut, "doc_id", "text", "n_chars")] == [r[:2] for r in sorted(expected, key=repr)]


def test_equal_windows_share_anchors():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 5, 400).astype(np.uint64)
    words = np.concatenate([base, base[37:300], np.full(90, 2, np.uint64), base[100:220]])
    words = words * np.uint64(0x9E3779B97F4A7C15)
    firsts = np.array([0, 400, 663, 753, 873])
    found = substring_dedup.Anchored(words, firsts, 20)
    seen, windows = {}, 0
    for at, first, count, key, shift in zip(found.at, found.first, found.count, found.key, found.shift, strict=True):
        for k in range(count):
            windows += 1
            anchor = (int(key), int(shift) - k)
            assert seen.setdefault(tuple(words[first + k : first + k + 20].tolist()), anchor) == anchor
    assert windows == 381 + 244 + 71 + 101


def test_suffix_dedup(docs, rows):
    found = suffix_dedup.remove_strings(docs)
    assert table(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.suffix_dedup(rows), key=repr)


def test_suffix_dedup_clashing_and_empty(clashing, empty, rows):
    found = suffix_dedup.remove_strings(clashing)
    assert table(found, "doc_id", "n_removed", "kept") == sorted([(d, n, k) for d, _, n, _, k in brute.suffix_dedup(rows)], key=repr)
    assert found.where("row <> 'clash' OR answers <> 'clash'").count() == 0
    assert suffix_dedup.remove_strings(empty).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_run_index_matches_any_pattern(seed):
    rng = np.random.default_rng(seed)
    pieces = list({bytes(rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8)) for _ in range(12)})
    docs = rng.integers(0, 6, len(pieces))
    index = suffix_dedup.RunIndex(pieces, docs, 6)
    length, doc = index.stream(pieces)
    at = 0
    for piece in pieces:
        for i in range(len(piece)):
            gram = piece[i : i + 6]
            holders = [int(d) for p, d in zip(pieces, docs, strict=True) if gram in p]
            assert (length[at] >= 6) == (len(gram) == 6)
            assert len(gram) < 6 or doc[at] == min(holders)
            at += 1
    assert len(index.run_start) <= index.n


def test_near_groups(docs, rows):
    found = jaccard_join.near_groups(docs)
    assert table(found, "doc_id", "class_id", "n_links") == sorted(brute.near_groups(rows), key=repr)


def test_near_groups_clashing_and_empty(clashing, empty, rows):
    assert table(jaccard_join.near_groups(clashing), "doc_id", "class_id", "n_links") == sorted(brute.near_groups(rows), key=repr)
    assert jaccard_join.near_groups(empty).count() == 0


def test_blocks_change_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    assert table(jaccard_join.near_groups(docs), "doc_id", "class_id", "n_links") == sorted(brute.near_groups(rows), key=repr)


def test_keep_one(docs, clashing, rows):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    # One document of each component with words, that of the least doc_id; components may share that id.
    least = {}
    for root, (doc, text) in zip(brute.near_components(rows)[0], rows, strict=True):
        if brute.words(text):
            least[root] = min(least.get(root, 1 << 63), brute.key(doc))
    wordless = [d for d, t in rows if not brute.words(t)]
    found = kept.collect()
    worded = [r["doc_id"] for r in found if brute.words(r["text"])]
    assert sorted(map(brute.key, worded)) == sorted(least.values())
    assert len(set(least.values())) < len(least)
    assert sorted(map(brute.key, (r["doc_id"] for r in found if not brute.words(r["text"])))) == sorted(map(brute.key, wordless))
    assert jaccard_join.keep_one(clashing).columns == clashing.columns


def test_least_matches():
    assert jaccard_join.least_matches(128) < 128 * 0.8 < 128
    assert [jaccard_join.least_matches(n) for n in (32, 64, 96, 128)] == sorted(jaccard_join.least_matches(n) for n in (32, 64, 96, 128))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 300)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    expected = [(i, 0) for i in range(41)] + [(100, 100), (101, 100), (150, 150), (200, 150), (300, 150)]
    assert table(found, "node", "root") == sorted(expected, key=repr)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [6, 7, 9])
def test_long_documents_are_scanned_in_parts(docs, rows, monkeypatch, bits):
    values = np.random.default_rng(bits).integers(0, 1 << 40, 3_000).astype(np.uint64) << np.uint64(24)
    whole = suffix_dedup.least_places(values, 35)
    monkeypatch.setattr(suffix_dedup, "PLACE", bits)
    assert np.array_equal(suffix_dedup.least_places(values, 35), whole)


def test_pieces_are_told_apart_by_64_bits():
    rng = np.random.default_rng(1)
    anchor, piece = rng.integers(0, 1 << 62, 5).astype(np.uint64), rng.integers(0, 1 << 62, 5).astype(np.uint64)
    low = piece ^ np.arange(1, 6, dtype=np.uint64)
    assert not set(suffix_dedup.span_keys(anchor, piece).tolist()) & set(suffix_dedup.span_keys(anchor, low).tolist())
    batch = pa.RecordBatch.from_arrays([pa.array([3, 9]), pa.array(["ab" * 60, "the end " + "ab" * 60])], ["doc", "text"])
    sent = suffix_dedup._unpacked(pa.Table.from_batches([suffix_dedup._send(batch, 1, 100)]).filter(pa.compute.is_null(pa.compute.field("doc"))))
    assert sent[0].dtype == sent[1].dtype == np.uint64 and (sent[0] >> np.uint64(40)).any() and (sent[1] % np.uint64(1 << 20)).any()


def test_common_anchors_change_nothing(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_PIECES", 1)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 20_000)
    passage = next(t for d, t in rows if d == -4)[:300]
    more = [(1_000 + i, f"{i * 7919} {i} {passage} {i * 104729} and {i}") for i in range(40)]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = suffix_dedup.remove_strings(given)
    assert table(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.suffix_dedup([*rows, *more]), key=repr)


def test_common_word_anchors_change_nothing(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "ANCHOR_RUNS", 1)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 20_000)
    passage = " ".join(next(t for d, t in rows if d == -4).split()[:45])
    more = [(1_000 + i, f"{i} {i * 7919} {passage} {i * 104729} and {i}") for i in range(60)]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string").repartition(9))
    found = substring_dedup.remove_repeats(given)
    assert table(found, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup([*rows, *more]), key=repr)


def test_keep_one_of_unrelated_texts_without_or_with_one_id(spark):
    text = lambda word: " ".join(f"{word}{k}" for k in range(60))
    near = lambda word: text(word) + " end"
    given = [(None, text("a")), (None, text("b")), (7, near("a")), (8, near("b")), (3, text("c")), (3, text("d")), (9, near("d")), (None, text("b"))]
    kept = jaccard_join.keep_one(spark.createDataFrame(given, "doc_id long, text string"))
    expected = [(None, text("a")), (None, text("b")), (3, text("c")), (3, text("d"))]
    assert table(kept, "doc_id", "text") == sorted(expected, key=repr)


@pytest.mark.parametrize("most", [1, 10_000])
def test_windows_of_one_anchor_are_told_apart_by_64_bits(monkeypatch, most):
    prints = substring_dedup.window_prints
    monkeypatch.setattr(substring_dedup, "window_prints", lambda words, width: prints(words, width) & np.uint64(0xFFFFFFFF))
    texts = [" ".join([*(f"{i}a{k}" for k in range(9)), "all", "of", "them", "share", "these", "few", "words", *(f"{i}b{k}" for k in range(9))]) for i in range(40)]
    texts.append(texts[7])
    batch = pa.RecordBatch.from_arrays([pa.array(range(41), pa.int64()), pa.array([0] * 41), pa.array(texts)], ["doc", "variant", "text"])
    judged = [substring_dedup._judge(pa.Table.from_batches([substring_dedup._send(batch, 1, 20, most)]), 1)]
    windows = judged[0].filter(pa.compute.is_null(judged[0]["doc"]))
    judged.append(substring_dedup._judge_dealt(windows))
    marked = [d for part in judged for d in part["doc"].to_pylist() if d is not None]
    assert set(marked) == {40}


def test_many_texts_without_or_with_one_id_keep_their_own_words(spark):
    passage = [f"shared{k}" for k in range(25)]
    given = [(None if i % 2 else 5, " ".join([*(f"{i}w{k}" for k in range(i % 60)), *passage, f"{i}end"])) for i in range(3_000)]
    found = substring_dedup.remove_repeats(spark.createDataFrame(given, "doc_id long, text string"))
    assert table(found, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substring_dedup(given), key=repr)
