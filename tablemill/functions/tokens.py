"""Token counting. A tokenizer is a function from a text Column to a count Column."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

from tablemill.constants import WIDE_SPACES, WORD

Tokenizer = Callable[[Column], Column]
#: Bytes of text encoded in one call, or one longer text: until its ids are taken, an encoding holds some 100 bytes a token.
ENCODED_BYTES = 1 << 20


def plain_spaces(text: Column) -> Column:
    """Turn whitespace outside ASCII into spaces; ASCII text passes untouched."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(
        F.translate(text, WIDE_SPACES, " " * len(WIDE_SPACES))
    )


def count_words(text: Column) -> Column:
    """Default tokenizer: pieces between whitespace."""
    return F.regexp_count(plain_spaces(text), F.lit(WORD)).cast("int")


def words(text: Column) -> Column:
    return F.regexp_extract_all(plain_spaces(text), F.lit(f"({WORD})"), F.lit(1))


def is_blank(text: Column) -> Column:
    return F.when(F.substring(text, 1, 1).between("!", "~"), False).otherwise(
        ~plain_spaces(text).rlike(WORD)
    )


class FileTokenizer:
    """Token counts under a file in the `tokenizers` JSON format, run over Arrow batches.

    `least` is a Column tokenizer that never counts more tokens than the file does, and whose counts of lines
    add up to no more than that of the text they form. By default it counts words; that is
    a bound for files whose tokens each lie in one word, which is verified on the vocabulary.
    """

    def __init__(self, path: str, least: Tokenizer | None = None):
        if least is None and not tokens_keep_to_words(path):
            raise ValueError(f"tokens of {path} span words; give a lower bound of its counts")
        self.path, self.least, self.count = path, least or count_words, _counter(path)

    def __call__(self, text: Column) -> Column:
        # The null check is a second use of the text, which keeps it a column of its own: rendering
        # and Python call must not be merged into one expression.
        return F.when(text.isNotNull(), self.count(text))


def _counter(path: str):
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encoded = encode_parts(path, pa.array(texts, pa.string(), from_pandas=True))
        return pd.Series([len(e) for part in encoded for e in part], dtype="int32")

    return count


def file_tokenizer(path: str, least: Tokenizer | None = None) -> FileTokenizer:
    """A tokenizer file as a tokenizer; see FileTokenizer for `least`."""
    return FileTokenizer(path, least)


def tokens_keep_to_words(path: str) -> bool:
    """Whether no token but special ones prints characters of more than one word, so that a word costs a token at least."""
    tokenizer = _load(path)
    if tokenizer.pre_tokenizer is None:
        return False
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    ids = [i for i in range(tokenizer.get_vocab_size()) if i not in special]
    return all(len(text.split()) <= 1 for text in tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False))


def encode_parts(path: str, texts: pa.Array) -> Iterator[list]:
    """Encodings of texts under a tokenizer file, those of about ENCODED_BYTES at a time; a NULL text has no tokens.

    A part's encodings are to be dropped before the next part is asked for.
    """
    tokenizer = _load(path)
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy().astype(np.int64))
    first = 0
    while first < len(texts):
        limit = (ends[first - 1] if first else 0) + ENCODED_BYTES
        last = max(first + 1, int(np.searchsorted(ends, limit, "right")))
        part = [t or "" for t in texts.slice(first, last - first).to_pylist()]
        yield tokenizer.encode_batch_fast(part, add_special_tokens=False)
        first = last


def file_ids(path: str, texts: pa.Array) -> Iterator[pa.ListArray]:
    """Token ids of texts under a tokenizer file, about ENCODED_BYTES of text at a time; a NULL text has none."""
    for part in encode_parts(path, texts):
        ids = [np.array(e.ids, np.int64) for e in part]
        del part
        ends = np.cumsum([0, *(len(x) for x in ids)])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))


_LOADED: dict = {}


def _load(path: str):
    if path not in _LOADED:
        # Each core has a task; threads beside it would hold memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as FileTokenizer

        _LOADED[path] = FileTokenizer.from_file(path)
    return _LOADED[path]
