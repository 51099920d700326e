"""Imports every operator and the pipeline, so that their queries are registered."""

import corpus_pipeline
from tablemill.llm import bpe, chat, decontaminate, hard_negatives, jaccard_join, lexical_search, quality  # noqa: F401
from tablemill.llm import secret_scan, sharding, substring_dedup, suffix_dedup, token_store, warc  # noqa: F401
from tablemill.llm.queries import QUERIES, SQL, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["QUERIES", "SQL"]
