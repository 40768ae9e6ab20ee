"""The corpus pipeline's stages: each takes (spark, docs, sf_dir) and gives the rows it keeps, with the columns of ``docs``.

Each row stands or falls by its own text and language, for ids may be null or shared; only equal rows have one verdict. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, language, mixing, packing, quality
from .arrow import cut


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (a digest that equal rows share alone), text and lang of the rows that are judged."""
    return docs.select(_row_key(docs).alias("doc_id"), "text", "lang")


def _row_key(docs: DataFrame):
    return F.xxhash64(*(c for name in ("doc_id", "lang", "text") for c in (docs[name], docs[name].isNull())))


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose digest has true verdicts (doc_id, kept)."""
    keys = verdicts.filter("kept").select("doc_id").distinct().select(F.col("doc_id").alias("row_key"))
    return docs.join(keys, _row_key(docs) == keys["row_key"], "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity bands reject go."""
    return _kept(docs, quality.quality(_keyed(docs)).select("doc_id", "kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stays open (no letter, or too narrow a margin) go."""
    learned = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.classify(_keyed(docs), learned)
    return _kept(docs, found.select("doc_id", (~F.col("rejected")).alias("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the smallest id stays; of equal id and text, the least row."""
    found = cut(dedup.components(docs, shingle=5, percent=80).select("doc_id", "text_key", "comp"))
    linked = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(dedup.first()).alias("first"))
    keys = linked.select("first.doc_id", "first.text_key").union(found.filter("comp IS NULL").select("doc_id", "text_key").distinct())
    same = F.expr("d.doc_id <=> k.doc_id") & (F.xxhash64("d.text") == F.col("k.text_key"))
    kept = docs.alias("d").join(keys.alias("k"), same, "left_semi")
    repeated = found.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    return kept.groupBy("doc_id", dedup.text_key()).agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*") if repeated else kept


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places."""
    return packing.best_fit_packing(docs)
