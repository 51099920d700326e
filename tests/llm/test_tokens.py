import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import brute
from tests.llm.conftest import table

from tablemill.llm import bpe, token_store, units
from tablemill.llm.common import new_folder, public_tokenizer, text_buffers

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer():
    return units.load(public_tokenizer(NAME))


def odd_texts():
    rng = random.Random(2)
    letters = [*"abAB'sé́İßſ  \x1c\x85​<|>1٣中文!.,-", " ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "Σ", "ς", "ẛ̣", "\x00"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(800)] + ["", None, " ", "a" * 4_000]


@pytest.mark.parametrize("mean", [2, 16, 1024])
def test_chunks_encode_as_the_library_does(tokenizer, mean, monkeypatch):
    cuts = bpe.cut_points
    monkeypatch.setattr(bpe, "cut_points", lambda body, offsets: cuts(body, offsets, mean))
    texts = odd_texts()
    coder = units.Encoder(public_tokenizer(NAME), remembered=3_000)
    ids, ends = bpe.encode_chunked(coder, *text_buffers(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_no_documents():
    ids, ends = bpe.encode_chunked(units.Encoder(public_tokenizer(NAME)), *text_buffers(pa.array([], pa.string())))
    assert len(ids) == 0 and ends.tolist() == [0]


def test_round_trip(docs, clashing, empty, rows, tokenizer):
    expected = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert table(bpe.round_trip(docs, NAME), *columns) == sorted(expected, key=repr)
    assert table(bpe.round_trip(clashing, NAME), *columns) == sorted(expected, key=repr)
    assert bpe.round_trip(empty, NAME).count() == 0


def test_encode_and_decode_documents(docs, rows, tokenizer):
    encoded = bpe.encode_documents(docs, NAME)
    all_ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert table(encoded, "doc_id", "ids") == sorted([(d, i) for (d, _), i in zip(rows, all_ids, strict=True)], key=repr)
    texts = [(d, tokenizer.decode(i, skip_special_tokens=False)) for (d, _), i in zip(rows, all_ids, strict=True)]
    assert table(bpe.decode_documents(encoded, NAME), "doc_id", "text") == sorted(texts, key=repr)


def test_words_carry_the_ids():
    assert units.splits_at_spaces(public_tokenizer(NAME), ["Don't <|endoftext|> stop ＡＢＣ\nnow", "İstanbul é x"])


def stored(spark, docs):
    folder = new_folder(spark, "ids")
    placed = token_store.write_shards(docs, folder, NAME, shards=4)
    index = token_store.write_index(placed, folder)
    return folder, placed, index


def test_token_store(spark, docs, clashing, rows, tokenizer):
    ordered = sorted(rows, key=lambda r: (brute.key(r[0]), (r[1] or "").encode()))
    expected, start = [], 0
    for doc, text in ordered:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for given in (docs, clashing):
        folder, placed, index = stored(spark, given)
        found = token_store.lookup(given.select("doc_id").distinct(), index, folder)
        read = token_store.read_ids(found, token_store.manifest_of(placed).select("shard", "file", "base"), folder)
        assert table(read, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    missing = spark.createDataFrame([(10_000 + i,) for i in range(200)], "doc_id long")
    assert token_store.lookup(missing, index, folder).count() == 0


def test_empty_token_store(spark, empty):
    folder, placed, index = stored(spark, empty)
    found = token_store.lookup(empty.select("doc_id"), index, folder)
    assert token_store.read_ids(found, token_store.manifest_of(placed).select("shard", "file", "base"), folder).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 63), 1 << 63, 5_000))
    index = token_store.build_index(keys, np.zeros(len(keys), np.int32), np.arange(len(keys)), np.ones(len(keys), np.int64))
    slots = token_store.slots(index, keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    others = np.setdiff1d(rng.integers(-(1 << 63), 1 << 63, 5_000), keys)
    assert (token_store.slots(index, others) == -1).all()
