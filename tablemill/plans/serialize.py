"""Corpus to segments: clean, order, render, count, pack, in all formats at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from tablemill.constants import TOKEN_BUDGET
from tablemill.functions.tokens import Tokenizer, count_words
from tablemill.operators import clean, order, pack
from tablemill.session import stage
from tablemill.sources.corpus import Corpus


class Prepared(NamedTuple):
    corpus: Corpus
    tables: DataFrame
    large: DataFrame | None


def prepare(corpus: Corpus, split_rows: int = order.SPLIT_ROWS) -> Prepared:
    """Profile and clean the tables once, and find those too large for one task."""
    tables = stage(clean.clean_tables(corpus))
    return Prepared(corpus, tables, order.large_tables(tables, split_rows))


def serialize(
    prepared: Prepared, budget: int = TOKEN_BUDGET, tokenizer: Tokenizer = count_words
) -> DataFrame:
    """`(format, table_id, seg_no, start_ord, end_ord, n_rows, text, n_tokens)`."""
    segments = pack.pack_segments(*prepared, budget, tokenizer)
    return pack.segment_tokens(pack.segment_text(segments), tokenizer)


def ranges(
    prepared: Prepared, budget: int = TOKEN_BUDGET, tokenizer: Tokenizer = count_words
) -> DataFrame:
    return pack.pack_ranges(*prepared, budget, tokenizer)
