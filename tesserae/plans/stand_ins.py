"""Reference-shaped relations made from the driver's tables, in Spark and in DuckDB SQL.

Each function has its SQL twin in ``SQL``; a query over one names its twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: a document and its vector."""
    both = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents"), F.col("vec_id") == F.col("doc_id"))
    return both.selectExpr(
        "concat('c', lpad(cast(vec_id as string), 6, '0')) id", "vec_id n", "concat(source, '/', lang, '/', cast(doc_id as string), '.txt') file_path", "1 start_line", "2 end_line",
        "text content", "case vec_id % 5 when 0 then 'memory' when 1 then 'external' when 2 then 'commit' when 4 then 'file' end kind",
        "case vec_id % 4 when 0 then 'code' when 1 then 'web' when 2 then 'doc' end source_type", "case vec_id % 4 when 1 then '' when 2 then 'app' when 3 then 'lib' end sub_project",
        "case vec_id % 6 when 0 then '' when 1 then '{}' else concat('{\"label\":', cast(label as string), ',\"lang\":\"', lang, '\",\"n\":\"', cast(label as string), '\"}') end metadata",
        "case when vec_id % 3 = 0 then concat('s', cast(vec_id as string)) else '' end summary", "concat(source, '/', lang) context_path", f"{NOW} + vec_id * 1000 mod_time",
        f"case when vec_id % 7 = 0 then cast(0 as bigint) else cast({NOW} - (vec_id % 120) * 86400 as bigint) end last_accessed", "sha2(text, 256) content_hash",
        "case when vec_id % 10 = 0 then concat('fn', cast(vec_id as string)) else '' end identifier", "embedding vector", "label",
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories: documents with vectors, typed, tagged and hashed."""
    from tesserae.operators.memory import prepare

    e = entries(spark, sf_dir).selectExpr("concat('mem:', id) id", "n", "content", "case when n % 3 = 0 then '' else concat('p', cast(n % 5 as string)) end project", "vector", "mod_time created_at", "mod_time updated_at", "case when n % 4 = 0 then 'explicit' else 'session' end source", "context_path")
    return prepare(e)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries made of events: their type and ``k`` choose event, stage, class and mode."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rows = e.selectExpr(
        "event_id", "ts", "'INFO' level", "k", "case when user_id % 10 = 0 then '' else concat('s', cast(user_id as string)) end session",
        "case k % 7 when 0 then 'session-start' when 1 then 'user-prompt' when 2 then 'user-prompt' when 3 then 'pre-tool-use' when 4 then 'post-edit-actor' when 5 then 'stop' else 'post-edit' end event",
    )
    fields = F.expr(
        "map('stage', case k % 7 when 1 then case k % 3 when 0 then 'ok' when 1 then 'cache_hit' else 'skip' end when 2 then 'ok' else '' end,"
        " 'bytes', case when k % 11 = 0 then 'x1' else cast(k as string) end,"
        " 'class', case when k % 7 <> 3 then '' when k % 4 = 0 then 'allow' when k % 4 = 1 then 'block' when k % 4 = 2 then 'warn' else '' end,"
        " 'mode', case when k % 3 = 0 then 'shadow' else 'block' end,"
        " 'rule_id', case when k % 5 = 0 then '' when k % 5 = 1 then 'llm:m' else concat('R', cast(k % 5 as string)) end,"
        " 'reason', concat('r', cast(k as string)), 'msg', case when k % 2 = 0 then 'reindex_ok' else 'other' end)"
    )
    return rows.withColumn("fields", fields)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.selectExpr("cast(conv_id as string) session", "turn idx", "role", "text")


SQL = {
    "entries": f"""entries AS (SELECT concat('c', lpad(vec_id::VARCHAR, 6, '0')) AS id, vec_id AS n, concat(source, '/', lang, '/', doc_id::VARCHAR, '.txt') AS file_path, 1 AS start_line, 2 AS end_line,
  text AS content, CASE vec_id % 5 WHEN 0 THEN 'memory' WHEN 1 THEN 'external' WHEN 2 THEN 'commit' WHEN 4 THEN 'file' END AS kind,
  CASE vec_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'web' WHEN 2 THEN 'doc' END AS source_type, CASE vec_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'app' WHEN 3 THEN 'lib' END AS sub_project,
  CASE vec_id % 6 WHEN 0 THEN '' WHEN 1 THEN '{{}}' ELSE concat('{{"label":', label::VARCHAR, ',"lang":"', lang, '","n":"', label::VARCHAR, '"}}') END AS metadata,
  CASE WHEN vec_id % 3 = 0 THEN concat('s', vec_id::VARCHAR) ELSE '' END AS summary, concat(source, '/', lang) AS context_path, {NOW} + vec_id * 1000 AS mod_time,
  CASE WHEN vec_id % 7 = 0 THEN 0 ELSE {NOW} - (vec_id % 120) * 86400 END AS last_accessed, sha256(text) AS content_hash,
  CASE WHEN vec_id % 10 = 0 THEN concat('fn', vec_id::VARCHAR) ELSE '' END AS identifier, embedding::DOUBLE[] AS vector, label
  FROM embeddings JOIN documents ON doc_id = vec_id)""",
    "log": """log AS (SELECT *, CASE k % 7 WHEN 1 THEN CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'cache_hit' ELSE 'skip' END WHEN 2 THEN 'ok' ELSE '' END AS stage,
  CASE WHEN k % 11 = 0 THEN 0 ELSE k END AS bytes, CASE WHEN k % 7 <> 3 THEN '' WHEN k % 4 = 0 THEN 'allow' WHEN k % 4 = 1 THEN 'block' WHEN k % 4 = 2 THEN 'warn' ELSE '' END AS class,
  CASE WHEN k % 3 = 0 THEN 'shadow' ELSE 'block' END AS mode, CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN 'llm:m' ELSE concat('R', (k % 5)::VARCHAR) END AS rule_id,
  concat('r', k::VARCHAR) AS reason, CASE WHEN k % 2 = 0 THEN 'reindex_ok' ELSE 'other' END AS msg
  FROM (SELECT event_id, ts, (props->>'$.k')::INT AS k, CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('s', user_id::VARCHAR) END AS session,
  CASE (props->>'$.k')::INT % 7 WHEN 0 THEN 'session-start' WHEN 1 THEN 'user-prompt' WHEN 2 THEN 'user-prompt' WHEN 3 THEN 'pre-tool-use' WHEN 4 THEN 'post-edit-actor' WHEN 5 THEN 'stop' ELSE 'post-edit' END AS event FROM events))""",
    "messages": "messages AS (SELECT conv_id::VARCHAR AS session, turn AS idx, role, text FROM conversations)",
}
