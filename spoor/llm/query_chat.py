"""op5: formatted conversations, digested from what the formatted text reads back to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat

NAME = "op5_chat_format"
#: A conversation that holds control strings itself.
PLANTED = r"\### Assistant: </turn> ok"

_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '>', '\g')"
SQL = rf"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'
),
s AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         string_agg('<turn:' || {_ESCAPED.format('role')} || '>' || {_ESCAPED.format('text')} || '</turn>', '' ORDER BY turn, role, text) AS formatted,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       length(formatted)::BIGINT AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM s"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    out = chat.format_chats(stored.unionByName(planted))
    out = out.withColumn("turns", chat.read_back(F.col("formatted")))
    # the loss too is read back from the formatted text
    bears = F.filter("turns", lambda t: t["role"].isin(*chat.CHAT.loss_roles))
    out = out.withColumn("loss", F.array_join(F.transform(bears, lambda t: t["text"]), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
