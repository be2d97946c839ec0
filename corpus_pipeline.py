"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. What a
stage leaves in the shared folder is removed once its result is written: by ``run``, or when
the next stage is called with docs read from that result.

Rows are followed by a key over (doc_id, text), so null and repeated ids keep their own
verdicts; rows that are equal in both share one. An empty table passes through as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import decontaminate, jaccard, packing, secrets, toxicity
from cohortlab.llm.stage import end_steps, pipeline_step, remove, shared_dir, shielded, stage, table


def _keyed(docs: DataFrame):
    """``docs`` with a column _key for the row key, its other columns shielded, and what gives
    them back. Null and empty texts differ."""
    plain, restore = shielded(docs, "doc_id", "text")
    key = F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull())
    return plain.withColumn("_key", key), lambda out: restore(out.drop("_key")).select(*docs.columns)


@pipeline_step
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is under one half."""
    columns = docs.columns
    plain, restore = shielded(docs, "doc_id", "text")
    scored = toxicity.score_severity(plain, toxicity.train(plain, table(spark, sf_dir, "labels")))
    return restore(scored.where(~F.col("toxic")).drop("severity", "grade", "p_toxic", "toxic")).select(*columns)


@pipeline_step
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each linked group (nulls last); documents without
    words link with nothing and stay. Of rows equal in id and text, one stays."""
    keyed, restore = _keyed(docs)
    groups = jaccard.jaccard_groups(keyed.select(F.col("_key").alias("doc_id"), "text")) \
        .select(F.col("doc_id").alias("_k"), "component_id").distinct()
    ids = keyed.select(F.col("_key").alias("_i"), "doc_id").distinct()
    first = groups.join(ids, F.col("_k") == F.col("_i")).groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_k"))["_k"].alias("_key"))
    kept = keyed.join(stage(first.select("_key"), "kept"), "_key", "left_semi")
    # rows that repeat one (doc_id, text) meet by their key alone, before any text moves
    often = stage(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1).select("_key"), "repeated")
    return restore(kept.join(often, "_key", "left_anti").unionByName(
        kept.join(often, "_key", "left_semi").dropDuplicates(["_key"])))


@pipeline_step
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    keyed, restore = _keyed(docs)
    found = decontaminate.decontaminate(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = stage(found.where("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return restore(keyed.join(bad, "_key", "left_anti"))


@pipeline_step
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    columns = docs.columns
    out = secrets.redact_secrets(docs)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


@pipeline_step
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The fitted model and the tokenizer are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        result = step(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        end_steps(spark)
        if read:
            remove(spark, [read])
        read = path
    return docs
