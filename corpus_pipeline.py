"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, and packing, in this order.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. Decisions are on rows, not on
doc_ids: a null or repeated doc_id is a document of its own. Columns beside those of documents are dropped; an empty table
gives an empty result in each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm import decontamination, language_id, ngram_join, packing, pii
from kinweave.llm.common import crc_mod, stored, table
from kinweave.llm.queries import word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language stay; null texts and those without a letter go, and all where no row has a
    language to learn from. Repeated rows stay."""
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs.select(*COLUMNS), model).filter("lang_pred <> 'und'").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a key of doc_id and text in the order of doc_id, rows without a doc_id last."""
    least = F.lit("0").cast(docs.schema["doc_id"].dataType)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", least).alias("id"), F.xxhash64("text").alias("text"))
    return docs.select(*COLUMNS).withColumn("_row", own)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of the smallest doc_id stays, one without a doc_id only where none
    has any; so do all without words. Of rows that are equal in doc_id and text one stays."""
    rows = keyed(docs)
    kept = ngram_join.join(rows, key="_row").filter("_row = component_id").select("_row").distinct()
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("doc_id"))
    return rows.join(kept, "_row", "left_semi").withColumn("nth", nth).filter("nth = 1").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words stands in benchmark passages go. Each row is judged by itself, whatever
    its doc_id; null and empty texts are clean."""
    named = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), *COLUMNS)
    judged = decontamination.judged(named, table(spark, sf_dir, "benchmark"), key="_id", text="_text", keep=tuple(COLUMNS))
    return judged.filter(~F.col("contaminated")).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, with personal data masked by its kind and n_chars that of the masked text; a null text becomes an
    empty one."""
    found = pii.find(docs.select(*COLUMNS), pii.train(pii.sample(docs)), fields=["masked"])
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 4096 tokens; a null or empty text is the end token alone."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("language_id", by_language),
    ("ngram_join", without_near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Suffix sets, trained taggers and tokenizers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
