"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, langid, linededup, maxscore, mixing, multiindex, packing, quality, simhash, warc
from .shared import held_out

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer's file where the library that ships it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return quality.classify(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op6_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out(docs["doc_id"]))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality, op2_maxscore, op3_mixing, op4_warc, op5_chaining, op6_multiindex, op7_langid, op8_linededup, op9_simhash, op10_packing)}


# ---- DuckDB ---------------------------------------------------------------------------------------------------------

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s
), k AS (
  SELECT *, row_number() OVER o AS k, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), f AS (
  SELECT *, min(CASE WHEN rest * w <= cap * open THEN k END) OVER () AS first FROM k
), t AS (
  SELECT source, source_size, CASE WHEN k < first THEN cap ELSE max(CASE WHEN k = first THEN rest END) OVER () * w / max(CASE WHEN k = first THEN open END) OVER () END AS target FROM f
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(concat_ws('|', '17', doc_id::VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < kept THEN kept END AS refers_to FROM k
"""

OP8_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM d),
w AS (
  SELECT doc_id, text, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS win
  FROM (SELECT *, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, text, i) AS nth FROM w
), c AS (
  SELECT DISTINCT doc_id, text, unnest([i, i + 1, i + 2]) AS i FROM o WHERE nth > 1
), g AS (SELECT doc_id, text, list(i) AS gone FROM c GROUP BY doc_id, text)
SELECT x.doc_id, CASE WHEN x.text IS NULL THEN 0 ELSE len(string_split(x.text, chr(10))) END::BIGINT AS n_lines, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
  CASE WHEN g.gone IS NULL THEN x.text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(x.text, chr(10))) + 1), lambda i: NOT list_contains(g.gone, i)), lambda i: string_split(x.text, chr(10))[i]), chr(10)) END AS text
FROM documents x LEFT JOIN g ON x.doc_id IS NOT DISTINCT FROM g.doc_id AND x.text = g.text
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_maxscore": OP2_SQL, "op3_mixing": OP3_SQL, "op4_warc": OP4_SQL, "op8_linededup": OP8_SQL}
