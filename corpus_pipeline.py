"""The training-data pipeline: five stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import decontaminate, jaccard, langid, packing, substrings
from harvestry.llm.store import only_ids, without_ids, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The stages learn a model, run rounds and pack greedily; SQL can't express them.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; null and blank texts and texts without letters go."""
    return langid.identify(docs).filter(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates.

    Rows that share an id are documents of their own, told apart by a hash of id and text: only those of equal or similar
    text are copies. Rows without an id stay.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is not null and n > 1").select("doc_id")
    repeated = written(repeated, "repeated")
    some = repeated.limit(1).count() > 0
    keyed = docs.select(*COLUMNS, F.col("doc_id").alias("_key"))
    if some:
        hashed = only_ids(keyed, repeated, "doc_id").withColumn("_key", F.xxhash64("doc_id", "text"))
        keyed = written(without_ids(keyed, repeated, "doc_id").unionByName(hashed), "keyed")
    groups = jaccard.jaccard_groups(keyed, "_key")
    gone = groups.filter("id <> component_id").select(F.col("id").alias("_key")).distinct()
    kept = without_ids(keyed, written(gone, "gone"), "_key")
    if not some:
        return kept.select(*COLUMNS)
    others = without_ids(kept, repeated, "doc_id").select(*COLUMNS)
    one = only_ids(kept, repeated, "doc_id").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return others.union(one)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has; a document that nothing is left of goes."""
    left = substrings.dedup_substrings(docs).filter("kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = written(found.select(F.col("id").alias("doc_id")).distinct(), "contaminated")
    return without_ids(docs, found, "doc_id").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
