"""A log table with credentials that follow from its keys, so that results can be derived anywhere.

`logs` takes conversations as an agent's records. Six of seven turns get a token of one of six kinds made from a
SHA-256 of the conversation's number modulo 50, so secrets recur across sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGENTS = ("claude", "codex", "gemini", "cursor")


def token(digest: Column, kind: Column) -> Column:
    return (
        F.when(kind == 0, F.concat(F.lit("npm_"), F.substring(digest, 1, 36)))
        .when(kind == 1, F.concat(F.lit("sk-or-v1-"), digest))
        .when(kind == 2, F.concat(F.lit("sbp_"), F.substring(digest, 1, 40)))
        .when(kind == 3, F.concat(F.lit("hf_"), F.translate(F.substring(digest, 1, 34), "0123456789", "GHIJKLMNOP")))
        .when(kind == 4, F.concat(F.lit("sk_"), F.when(F.substring(digest, 1, 1) < "8", "live_").otherwise("test_"), F.substring(digest, 1, 24)))
        .when(kind == 5, F.concat(F.lit("AKIA"), F.upper(F.substring(digest, 1, 16))))
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, agent, file, line_no, session, project, timestamp, role, origin, text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    digest, kind = F.sha2(F.concat(F.lit("k"), (F.col("conv_id") % 50).cast("string")), 256), (F.col("conv_id") + F.col("turn")) % 7
    agent = F.element_at(F.array(*map(F.lit, AGENTS)), (F.col("conv_id") % len(AGENTS) + 1).cast("int"))
    origin = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "assistant").otherwise("other")
    return rows.select(
        "conv_id",
        "turn",
        agent.alias("agent"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"),
        (F.col("turn") + 1).cast("int").alias("line_no"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"),
        F.concat(F.lit("/work/p"), (F.col("conv_id") % 10).cast("string")).alias("project"),
        F.concat(F.lit("2025-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
        "role",
        origin.alias("origin"),
        F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit(" KEY "), token(digest, kind), F.lit(" end")), F.lit(""))).alias("text"),
    )


#: The same in SQL, as common table expressions `logs` and `hits` (each planted token that its rule accepts).
LOGS_SQL = """
base AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS body, sha256('k' || (conv_id % 50)::VARCHAR) AS d, (conv_id + turn) % 7 AS kind FROM conversations
), logs AS (
  SELECT *, ['claude', 'codex', 'gemini', 'cursor'][(conv_id % 4 + 1)::INT] AS agent,
    'conv_' || conv_id::VARCHAR || '.jsonl' AS file, (turn + 1)::INT AS line_no, 's' || conv_id::VARCHAR AS session,
    '2025-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:' || lpad((turn % 60)::VARCHAR, 2, '0') || 'Z' AS timestamp,
    CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'assistant' ELSE 'other' END AS origin,
    CASE kind WHEN 0 THEN 'npm_' || substr(d, 1, 36) WHEN 1 THEN 'sk-or-v1-' || d WHEN 2 THEN 'sbp_' || substr(d, 1, 40)
      WHEN 3 THEN 'hf_' || translate(substr(d, 1, 34), '0123456789', 'GHIJKLMNOP')
      WHEN 4 THEN 'sk_' || CASE WHEN substr(d, 1, 1) < '8' THEN 'live_' ELSE 'test_' END || substr(d, 1, 24)
      WHEN 5 THEN 'AKIA' || upper(substr(d, 1, 16)) END AS secret
  FROM base
), planted AS (
  SELECT *, body || coalesce(' KEY ' || secret || ' end', '') AS text FROM logs
), hits AS (
  SELECT *, left(sha256(secret), 12) AS fingerprint,
    ['npm-token', 'openrouter-api-key', 'supabase-access-token', 'huggingface-token', 'stripe-secret-key', 'aws-access-key-id'][(kind + 1)::INT] AS rule_id,
    ['npm', 'OpenRouter', 'Supabase', 'Hugging Face', 'Stripe', 'AWS'][(kind + 1)::INT] AS provider,
    CASE kind WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN CASE WHEN contains(secret, '_live_') THEN 4 ELSE 1 END ELSE 3 END AS severity_rank
  FROM planted WHERE secret IS NOT NULL AND (kind NOT IN (0, 2, 3) OR list_entropy(string_split(secret, '')) >= CASE kind WHEN 2 THEN 3.0 ELSE 3.5 END)
)"""
