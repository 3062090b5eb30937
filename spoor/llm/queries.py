"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import query_chat, query_decontaminate, query_html, query_language, query_lm, query_minhash, query_mixing, query_periodic, query_quality, query_spelling, query_substring, query_tokens, query_toxicity

_MODULES = (query_tokens, query_quality, query_chat, query_language, query_minhash, query_substring, query_lm, query_decontaminate, query_mixing, query_toxicity, query_spelling, query_periodic, query_html)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {m.NAME: m.query for m in _MODULES}
ORACLES: dict[str, str] = {m.NAME: m.SQL for m in _MODULES if m.SQL}
