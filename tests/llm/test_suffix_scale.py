import random

import numpy as np
import pyarrow as pa

from tests.llm import brute
from tests.llm.conftest import prose, table

from tablemill.llm import suffix_dedup


def letters(rng, n):
    return "".join(map(chr, rng.integers(97, 123, n)))


def asked(texts):
    """The spans of one document per text that are asked for, by document."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc", "text"])
    judged = suffix_dedup._judge(pa.Table.from_batches([suffix_dedup._send(batch, 1, 1 << 40)]))
    replies = judged.filter(pa.compute.equal(judged["kind"], suffix_dedup.ASKED))
    return {d: len(b) // suffix_dedup._ASK.itemsize for d, b in zip(replies["doc"].to_pylist(), replies["body"].to_pylist(), strict=True)}


def gram_of_least_hash(rng):
    """Sixteen letters that are the anchor of any ordinary string they stand in."""
    many = rng.integers(97, 123, 400_000).astype(np.uint8)
    at = int(np.argmin(suffix_dedup.gram_hashes(many)))
    return many[at : at + suffix_dedup.K].tobytes().decode()


def test_many_pieces_of_one_anchor_are_not_asked_for_by_chance():
    rng = np.random.default_rng(11)
    gram = gram_of_least_hash(rng)
    texts = [letters(rng, 60) + gram + letters(rng, 60) for _ in range(3_000)]
    assert sum(asked(texts).values()) < 60


def test_equal_bytes_too_few_for_a_string_are_not_asked_for():
    rng = np.random.default_rng(12)
    gram = gram_of_least_hash(rng)
    before, after = letters(rng, 60), letters(rng, 60)
    # 20 equal bytes on one side of the anchor, none on the other: 36 of 50.
    texts = [letters(rng, 60) + before[-20:] + gram + letters(rng, 60) for _ in range(5)]
    assert not asked(texts)
    # 20 on one and 14 on the other are a string.
    texts = [letters(rng, 60) + "-" * i + before[-20:] + gram + after[:14] + letters(rng, 60) for i in range(2)]
    assert set(asked(texts)) == {0, 1}


def test_index_is_bounded(monkeypatch):
    rng = np.random.default_rng(13)
    passages = [letters(rng, 52) for _ in range(400)]
    rows = [(0, k, d, k * 10 + d, 0, (p + str(d) + letters(rng, 20)).encode()) for k, p in enumerate(passages) for d in range(3)]
    order = rng.permutation(len(rows))
    pieces = pa.Table.from_arrays(suffix_dedup._rows([rows[i] for i in order], suffix_dedup._PIECE), schema=suffix_dedup._PIECE)
    sizes = []

    class Watched(suffix_dedup.RunIndex):
        def __init__(self, pieces, first_doc, width):
            sizes.append(sum(map(len, pieces)))
            super().__init__(pieces, first_doc, width)

    monkeypatch.setattr(suffix_dedup, "RunIndex", Watched)
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 4_000)
    found = suffix_dedup._compare(pieces)
    marks = {(d, *m) for d, b in zip(found["doc"].to_pylist(), found["body"].to_pylist(), strict=True) for m in np.frombuffer(b, suffix_dedup._MARK).tolist()}
    assert marks == {(d, k * 10 + d, 0, 3) for k in range(400) for d in (1, 2)}
    assert max(sizes) <= 4_000 < sum(sizes)


def test_small_scans_and_indexes_change_nothing(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "SENT_PIECES", 3)
    rng = random.Random(3)
    # Equal strings of every length around WIDTH, cut from one passage at every place, between different bytes.
    passage = prose(rng, 40)
    more = [(2_000 + i, prose(rng, 9) + passage[i % 90 : i % 90 + 45 + i % 13] + prose(rng, 9)) for i in range(150)]
    given = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    found = suffix_dedup.remove_strings(given)
    assert table(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.suffix_dedup([*rows, *more]), key=repr)
    assert suffix_dedup.remove_strings(given, ["doc_id"]).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
