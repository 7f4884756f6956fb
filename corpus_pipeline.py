"""A training-corpus pipeline over `documents`: five operators, each working on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and reads it back
as the next stage's documents. All stages return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.decontaminate import drop_contaminated
from auditloom.llm.jaccard_join import drop_near_duplicates
from auditloom.llm.mixing import mix
from auditloom.llm.shared import shared_folder
from auditloom.llm.substring_dedup import substring_dedup
from auditloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, rejects are gone."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more) stays."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out."""
    return substring_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs are gone."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: Toxicity, pruning and alignment are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession, path: str):
    """The session's file system and a path on it: folders are looked at and removed by Spark's own means."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over `documents`, each written in the session's shared folder and read again.

    A run with a `run_id` of its own goes on behind the last stage that it has completed, if it was broken off. A
    stage's folder is removed when the next one is complete; the last one's holds the result.
    """
    root = f"{shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    paths = [f"{root}/{name}" for name, _ in STAGES]
    complete = [n for n, path in enumerate(paths) if _exists(spark, f"{path}/_SUCCESS")] if run_id else []
    done = max(complete, default=-1)
    docs = spark.read.parquet(paths[done] if complete else f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        if n > done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[n])
            docs = spark.read.parquet(paths[n])
            if n:
                files, folder = _folder(spark, paths[n - 1])
                files.delete(folder, True)
    return docs
