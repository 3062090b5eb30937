"""op4: quality measures and verdicts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality

NAME = "op4_quality_rules"

_TRIGRAMS = r"""
w AS (
  SELECT rid, doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT row_number() OVER () AS rid, * FROM documents)
),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM p) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON r.rid = w.rid
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""


def _sql() -> str:
    fails = {r.name: r.fails for r in quality.HOST_RULES}
    k = ", ".join(f"sum(({x})::INT)::DOUBLE AS k_{n}" for n, x in fails.items())
    mv = ", ".join(f"avg(k_{n} / n) AS m_{n}, coalesce(var_samp(k_{n} / n), 0) AS v_{n}" for n in fails)
    wt = ", ".join(f"CASE WHEN v_{n} <= 1e-12 THEN total ELSE greatest(m_{n} * (1 - m_{n}) / v_{n} - 1, 1) END AS s_{n}" for n in fails)
    bad = " OR ".join(f"(k_{r.name} + m_{r.name} * s_{r.name}) / (n + s_{r.name}) > {r.limit}" for r in quality.HOST_RULES)
    return f"""WITH {_TRIGRAMS},
h AS (SELECT source, count(*)::DOUBLE AS n, {k} FROM b WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT *, {wt} FROM (SELECT sum(n) AS total, {mv} FROM h)),
v AS (SELECT source, {bad} AS host_rejected FROM h CROSS JOIN q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(host_rejected, FALSE) AS host_rejected, NOT base_failed AND NOT coalesce(host_rejected, FALSE) AS kept
FROM b LEFT JOIN v ON v.source = b.source"""


SQL = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept")
