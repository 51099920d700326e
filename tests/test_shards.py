"""Token sequences by dictionaries and by tokenizer files, and the split by position."""

import random

import pytest
from pyspark.sql import functions as F

from tablemill.constants import TOKEN_SHARDS, TRAIN_PER_MILLE
from tablemill.operators import shards

SPACES = [" ", "\n", "\t", " ", " ", "\x1c"]


@pytest.fixture(scope="module")
def segments(spark):
    rng = random.Random(4)
    words = ["the", "of", "größe", "x,y", "日本", *(f"w{i}" for i in range(40))]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice(SPACES) for _ in range(rng.randrange(0, 30)))
        rows.append((rng.choice(["csv", "json"]), f"t{i // 3}", i % 3, text))
    rows += [("csv", "none", 0, None), ("csv", "empty", 0, ""), ("csv", "long", 0, "long word " * 5_000)]
    return rows, spark.createDataFrame(rows, "format string, table_id string, seg_no bigint, text string").repartition(4)


def expected(rows):
    counts = {}
    for *_, text in rows:
        for w in (text or "").split():
            counts[w] = counts.get(w, 0) + 1
    ids = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w.encode())))}
    return {(f, t, n): [ids[w] for w in text.split()] for f, t, n, text in rows if (text or "").split()}


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_token_ids_by_dictionaries(segments, most, monkeypatch):
    rows, frame = segments
    monkeypatch.setattr(shards.dictionary_batches, "__defaults__", (most,))
    found = shards.tokenize_segments(frame).collect()
    assert {(r["format"], r["table_id"], r["seg_no"]): r["token_ids"] for r in found} == expected(rows)
    assert {r["shard"] for r in found} <= set(range(TOKEN_SHARDS)) and len({r["shard"] for r in found}) > 8
    vocab = shards.vocabulary(frame)
    again = shards.tokenize_segments(frame, vocab).collect()
    assert {(r["format"], r["table_id"], r["seg_no"]): r["token_ids"] for r in again} == expected(rows)


def test_dictionaries_hold_each_word_of_a_batch_once(segments):
    rows, frame = segments
    batches = shards.dictionary_batches(frame.coalesce(1)).collect()
    assert len(batches) == 1
    words = batches[0]["words"]
    assert len(words) == len(set(words)) == len({w for *_, t in rows for w in (t or "").split()})
    assert sum(batches[0]["counts"]) == len(batches[0]["codes"]) == sum(batches[0]["sizes"])
    assert shards.tokenize_segments(frame.limit(0)).count() == 0


def test_token_ids_by_a_file(spark, segments, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tablemill.sources.files import write_token_ids

    rows, frame = segments
    path = str(public.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(path)
    want = {(f, t, n): plain.encode(text, add_special_tokens=False).ids for f, t, n, text in rows if (text or "").strip()}
    write_token_ids(shards.encode_segments(frame, path), f"{tmp_path}/ids")
    found = spark.read.parquet(f"{tmp_path}/ids").collect()
    assert {(r["format"], r["table_id"], r["seg_no"]): r["token_ids"] for r in found} == {k: v for k, v in want.items() if v}
    by_words = {(r["table_id"], r["seg_no"]): r["shard"] for r in shards.tokenize_segments(frame).collect()}
    assert all(by_words[r["table_id"], r["seg_no"]] == r["shard"] for r in found)


@pytest.mark.parametrize("per_mille", [TRAIN_PER_MILLE, 500, 0, 1000])
def test_split_by_position(spark, per_mille):
    rng = random.Random(8)
    rows = [(f"d{i:04d}", rng.randrange(0, 200) if i % 9 else None) for i in range(500)]
    rows.append(("d0200x", 20_000))
    shuffled = rng.sample(rows, len(rows))
    frame = spark.createDataFrame(shuffled, "doc string, n_tokens int")
    found = {r["doc"]: r for r in shards.split_by_position(frame, ["doc"], per_mille).collect()}
    total, before = sum(n or 0 for _, n in rows), 0
    for doc, n in sorted(rows):
        assert found[doc]["first_token"] == before
        assert found[doc]["part"] == ("train" if before * 1000 < total * per_mille else "valid")
        before += n or 0
    trained = sum(n or 0 for d, n in rows if found[d]["part"] == "train")
    assert 0 <= trained - total * per_mille / 1000 <= max(n or 0 for _, n in rows)


def test_split_of_nothing(spark):
    assert shards.split_by_position(spark.createDataFrame([], "doc string, n_tokens int"), ["doc"]).count() == 0
