import random

import pandas as pd
import pyarrow as pa
import pytest

from tablemill.functions import tokens

public = pytest.importorskip("public_tokenizers")


class Watched:
    """A tokenizer that notes how many bytes each call got."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def __getattr__(self, name):
        def call(texts, **options):
            self.calls.append([len(t.encode()) for t in texts])
            return getattr(self.tokenizer, name)(texts, **options)

        return call


@pytest.fixture
def watched(monkeypatch):
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    one = Watched(Tokenizer.from_file(path))
    monkeypatch.setitem(tokens._LOADED, path, one)
    return path, one


def texts():
    rng = random.Random(4)
    words = ["the", "größe", "日本", "1,5", "x", "Customer#000000042", "\n"]
    out = [" ".join(rng.choices(words, k=rng.randrange(1, 900))) for _ in range(500)]
    out[7], out[8], out[300], out[499] = None, "", "long " * 60_000, None
    return out


def bounded(calls, most):
    return len(calls) > 1 and all(sum(c) <= most or len(c) == 1 for c in calls)


def test_ids_are_taken_part_by_part(watched, monkeypatch):
    monkeypatch.setattr(tokens, "ENCODED_BYTES", 50_000)
    path, one = watched
    given = texts()
    parts = list(tokens.file_ids(path, pa.array(["left out", *given])[1:]))
    want = [one.tokenizer.encode(t or "", add_special_tokens=False).ids for t in given]
    assert [ids for part in parts for ids in part.to_pylist()] == want
    assert bounded(one.calls, 50_000) and list(tokens.file_ids(path, pa.array([], pa.string()))) == []


def test_counts_are_taken_part_by_part(spark, watched):
    path, one = watched
    given = texts() * 3
    found = tokens._counter(path).func(pd.Series(given))
    assert found.tolist() == [len(one.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in given]
    assert bounded(one.calls, 1 << 20)
