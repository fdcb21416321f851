"""Thin queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, language, licences, quality, secrets, sentencepieces, simhash, suffixes, toxicity, transport, vectors, whitening
from .stage import held_out, stage, table

Query = Callable[[SparkSession, str], DataFrame]


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents"), path=F.col("source"))
    return found.select("doc_id", "path", "ordinal", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lang_col="lang")
    scored = toxicity.score(docs, model, lang_col="lang")  # the language chooses the threshold only
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "threshold", "toxic")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode(table(spark, sf_dir, "documents"), outputs=("packed", "decoded"))
    return coded.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", held_out(), "lang_pred", "score", "rejected")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no file names: a text that is in the main a licence stands for the licence file of its source's directory
    notice = licences.mostly_licence(F.col("text"))
    name = F.when(notice, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    folder = F.when(notice, F.lit(None)).otherwise(F.floor(F.col("doc_id") / 1000).cast("string"))
    return licences.scan(table(spark, sf_dir, "documents"), path=F.concat_ws("/", "source", folder, name))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return done.select("doc_id", "n_bytes", removed.cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = stage(quality.features(table(spark, sf_dir, "documents")), "quality-features")
    model = quality.fit(feats, table(spark, sf_dir, "labels"))
    scored = quality.score(feats, model)
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    src = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), transport.samples_of("text").alias("samples"))
    media = transport.store(src, "samples").select("doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    read = transport.parse(media, outputs=("packets", "streams", "times", "points", "payload"))
    payload = [F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32")]
    return read.select("doc_id", "n_bytes", *payload, "media_bytes", "media_sha256", transport.feature().alias("feature"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", whitening.as_long("deviation"))


def queries() -> dict[str, Query]:
    return {"op1_decontaminate": op1_decontaminate, "op2_language": op2_language, "op3_licences": op3_licences, "op4_vector_dedup": op4_vector_dedup, "op5_secrets": op5_secrets, "op6_toxicity": op6_toxicity, "op7_sentencepiece": op7_sentencepiece, "op8_simhash": op8_simhash, "op9_repeats": op9_repeats, "op10_quality": op10_quality, "op11_transport": op11_transport, "op12_alignment": op12_alignment, "op13_whitening": op13_whitening}


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND embedding IS NOT NULL
         AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c IS NULL OR NOT isfinite(c))) = 0
         AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c <> 0)) > 0 AS ok
  FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, r) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_vector_dedup": OP4_SQL}
