"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, pii_key, read


def op1_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.grid_join import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.pii import pseudonymise

    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), count="n_entities")


def op4_quality_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.cotrain import classify

    scored = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.licenses import scan

    docs = read(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"), "text")
    return scan(files, keep=["doc_id"])


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm.byte_bpe import round_trip

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.html_text import extract_column

    found = extract_column(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm.rans import read_back, write

    return read_back(*write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.mjpeg import media_digest

    return media_digest(read(spark, sf_dir, "documents"))


def op11_heap_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.heap_lloyd import compress, with_label_error

    coded, books = compress(read(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    coded = with_label_error(coded.withColumn("code", F.lower(F.hex("code"))))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in the documents that the contract names, words from one place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    at = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.expr("h div 10")).withColumn("n", F.size("words"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    at = at.withColumn("a", a.cast("int")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    planted = F.expr("array_join(transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)]), ' ')")
    return at.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.periodic_runs import find_runs, longest

    found = find_runs(with_planted_periods(read(spark, sf_dir, "documents"))).withColumn("best", longest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.repeats import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_grid_order_join, op2_simhash_near_dedup, op3_pii_surrogates, op4_quality_cotrain, op5_mix_sources, op6_license_scan, op7_byte_bpe, op8_html_text, op9_rans_tokens, op10_media_columns, op11_heap_lloyd_codes, op12_periodic_runs, op13_substring_dedup)}

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT min(struct_pack(r := source_size / weight, rest := rest, weights := weights)) AS first FROM l WHERE weight * rest <= cap * weights
), t AS (
  SELECT source, source_size, CASE WHEN weight * rest > cap * weights THEN cap::DOUBLE
         ELSE (weight * first.rest)::DOUBLE / first.weights::DOUBLE END AS target
  FROM l, f
), p AS (
  SELECT d.*, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN source_size > 0 THEN (floor(target)::HUGEINT // source_size) * size
             + greatest(0, least(size, floor(target)::HUGEINT % source_size - place)) ELSE 0 END)::BIGINT AS taken
FROM p
"""



def _lloyd_sql() -> str:
    """Plain Lloyd: four rounds over 4 parts and 256 entries, then the last assignment."""
    steps = []
    for k in range(5):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d, any_value(x) AS x
  FROM (SELECT r, p.p, e, x, list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)])::BIGINT AS d FROM p JOIN c{k} AS c ON p.p = c.p)
  GROUP BY r, p
), m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c
  FROM (SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT p, e, unnest(x) AS x, unnest(range(len(x))) AS i FROM a{k}) GROUP BY p, e, i)
  GROUP BY p, e
), c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{k} AS c LEFT JOIN m{k} AS m ON c.p = m.p AND c.e = m.e
)""")
    rounds = ", ".join(steps)
    return f"""
WITH v AS (
  SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS x, len(embedding) // 4 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), n AS (
  SELECT *, row_number() OVER (ORDER BY vec_id, x) - 1 AS r FROM v
), p AS (
  SELECT r, p, x[p * w + 1 : (p + 1) * w] AS x FROM n, range(4) AS t(p)
), c0 AS (
  SELECT p, r AS e, x AS c FROM p WHERE r < 256
), {rounds}, f AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY r
), h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c4
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM n JOIN f ON n.r = f.r, h
"""


#: Every window of 50 words by its least document; a word goes if one of the 50 windows over it is another's.
_REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL
), s AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p
), f AS (
  SELECT r, i, min(doc_id) OVER (PARTITION BY k) < doc_id AS again FROM s
), m AS (
  SELECT r, list(i ORDER BY i) AS at FROM f WHERE again GROUP BY r
), x AS (
  SELECT d.r, unnest(range(1, len(w) + 1)) AS i FROM d JOIN m ON d.r = m.r
), c AS (
  SELECT x.r, x.i, max(CASE WHEN f.again THEN x.i END) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NULL AS kept
  FROM x LEFT JOIN f ON x.r = f.r AND x.i = f.i
), k AS (
  SELECT r, list(i ORDER BY i) FILTER (WHERE kept) AS left_over FROM c GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN k.r IS NULL THEN 0 ELSE len(w) - coalesce(len(left_over), 0) END::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN k.r IS NULL THEN w ELSE [w[i] for i in coalesce(left_over, [])] END, ' ')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""

ORACLE_SQL = {"op5_mix_sources": _MIX_SQL, "op11_heap_lloyd_codes": _lloyd_sql(), "op13_substring_dedup": _REPEATS_SQL}
