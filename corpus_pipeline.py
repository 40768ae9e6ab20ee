"""The corpus pipeline: quality rules, language identification, near-dedup, source mixing and packing of ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import stages
from vellum.operators.graph import remove_folder, shared_folder

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("language_id", stages.language_id),
    ("minhash_near_dedup", stages.near_dedup),
    ("source_mixing", stages.source_mixing),
    ("best_fit_packing", stages.best_fit_packing),
]
#: SQL can't express the perplexity model, compression, or signatures; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each keeps is written to the shared folder as Parquet and reread by the next, and removed when that is done. The last one's
    stays, for the rows returned are read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
