"""The registered queries of the operators, over whole tables, and their SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, centroids, decontamination, fingerprints, language_id, licenses, ngram_join, packing, pii, quality, repeats, token_counts, wrappers
from .common import crc_mod, session_dir, stored, table


def word_tokenizer() -> str:
    """The vocabulary file of the packing contract, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = [name for name, _ in pii.FIELDS if name != "masked"]
    return pii.find(docs, pii.train(pii.sample(docs)), fields=fields).drop("text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), weights).drop("text")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents come; those of low quality are counted anew by another tokenizer version; toxic
    ones go. The second batch is sent twice. Texts are counted where they are read; only counts are joined."""
    first, second = token_counts.VERSIONS
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", token_counts.tokens_of(text, first).alias("old"), token_counts.tokens_of(text, second).alias("new"))
    docs = stored(docs, "counts")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = docs.join(marks, "doc_id").withColumn("low", F.coalesce(F.col("quality") == 0, F.lit(False)))
    low, toxic = marked.filter("low"), marked.filter("toxic = 1")
    old = lambda df: df.select("source", "lang", F.lit(first).alias("version"), F.col("old").alias("tokens"))
    new = lambda df: df.select("source", "lang", F.lit(second).alias("version"), F.col("new").alias("tokens"))
    rollup = token_counts.Rollup(spark, f"{session_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", token_counts.changes(inserted=old(docs)))
    for _ in range(2):
        rollup.commit("recount", token_counts.changes(inserted=new(low), deleted=old(low)))
    rollup.commit("takedown", token_counts.changes(deleted=new(toxic.filter("low")).unionByName(old(toxic.filter("NOT low")))))
    return rollup.totals()


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_html": op6_html,
    "op7_ngram_join": op7_ngram_join,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_fingerprints": op10_fingerprints,
    "op11_centroids": op11_centroids,
    "op12_alignment": op12_alignment,
    "op13_repeats": op13_repeats,
}
ORACLES: dict[str, str] = {"op3_token_counts": token_counts.ORACLE_SQL, "op11_centroids": centroids.oracle()}
