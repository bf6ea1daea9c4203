"""A training-corpus pipeline over documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontaminate, jaccard_join, language, mixing, pii
from strandline.llm.staging import staged


#: Rows of an Arrow batch: executors hold one for each task outside their heaps, and long texts make batches of 10 000 rows large.
BATCH_ROWS = 1024


def tuned(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, as a stage's result is computed after its function has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; those without letters or too far from every centroid go."""
    tuned(spark)
    model = language.fit(docs.where(language.remainder("doc_id", 3) != 1))
    return language.identify(docs, model, "_language").where("not _language.rejected").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked at a 5-word shingle similarity of 0.8."""
    tuned(spark)
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold 0.8 or more of a benchmark item's 5-word shingles."""
    tuned(spark)
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    tuned(spark)
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for each copy taken."""
    tuned(spark)
    return mixing.taken(docs).select(*docs.columns, "size", "source_size", "target", "copy")


STAGES = [
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The first stage is a fitted model, which SQL can't express; tests hold the join, the decontamination and the spans against brute-force versions, languages against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
