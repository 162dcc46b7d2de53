"""The registered queries of the language-model operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import (
    copies,
    html,
    jaccard,
    licenses,
    manifest,
    mixing,
    neighbours,
    oracles,
    pieces,
    quality,
    scoring,
    secrets,
    variants,
    warc,
)
from stayline.session import new_path, stage
from stayline.workload.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit_quality(stats, table(spark, sf_dir, "labels"))
    return quality.score_quality(stats, model)


@query("op2_secret_scans")
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stage(secrets.find_places(docs).drop("text"), "secrets")
    return secrets.digest(found, secrets.rejected_from(found))


@query("op3_license_scans")
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first_word"]).alias("first_word"),
        F.array_max(base["first_word"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


WARC_SQL = """
with records as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
firsts as (
  select payload_digest, min(page_id) as first_id from records where payload_bytes >= 100 group by all)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when page_id is distinct from first_id and first_id is not null then 'revisit' else 'response' end
    as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from records left join firsts using (payload_digest)"""


@query("op9_warc", WARC_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(warc.resolve_revisits(table(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path, payloads=False).drop("target_uri", "payload")


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(table(spark, sf_dir, "documents"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants", oracles.VARIANTS)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))

@query("op12_exact_dedup", oracles.COPIES)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_groups(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", oracles.MANIFEST)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changes = {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    return manifest.manifest(docs, tampered, changes).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        "verified",
    )
