"""Mixing sources to target weights: capped water-filling and seeded repetitions.

``water_fill`` clamps sources at ``max_epochs`` times their size and shares the excess among the others in proportion to
their weights until none is above. A source is clamped just if its capacity per weight is at most the level that the
sources not yet clamped reach together, so one pass over the sources by capacity per weight finds the rounds' end.

``mix`` takes whole repetitions of every document of a source and, for the fraction left, one more of the documents
whose seeded digest (of id and text, for ids may be null or shared) lies below a cut. The cut is found from the sizes by (source, digest range): 65,536 ranges for each
source, counted map-side before any shuffle, so a source with a third of all rows is no task's burden. Documents meet their source's plan where they are, as long as
the plan's size, which is checked, allows to send it to every task; they are never shuffled by source unless there are very many sources.

Defined results: null text has size 0; the null source is a source, last by code point; documents of size 0 take 0;
rows equal in id and text share a digest and are taken alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import cut

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 65_536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest_range(seed: int, doc_id: Column, text: Column) -> Column:
    """0 to 65,535 from the MD5 of the seed, the id and the text, as any engine has it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight`` by the rank of the source's code points (null last). One row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """From one row a source (source, source_size, weight): adds ``target``, summing to ``share`` of all sizes if capacity allows."""
    everyone = Window.partitionBy(F.lit(0))
    by_ratio = everyone.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    since = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(since)
    leveled = sources.withColumn("_place", F.row_number().over(by_ratio)).withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") < cap)
    first = F.min(F.when(F.col("_free"), F.struct("_place", "_level"))).over(everyone)["_level"]
    target = F.least(cap, F.coalesce(F.col("weight") * first, cap))
    return leveled.withColumn("target", target).drop("_place", "_level", "_free")


def plan_sources(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """From (source, size, range), one row a source: source, source_size, target, whole (repetitions of every document) and cut (the last range that is taken once more)."""
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = water_fill(cyclic_weights(sources, weights), share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(epochs)).withColumn("more", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = F.sum("range_size").over(Window.partitionBy("source").orderBy("range"))
    ranges = ranges.withColumn("upto", upto).alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source"))
    near = F.abs(F.col("upto") - F.col("more")) < F.abs(F.col("upto") - F.col("range_size") - F.col("more"))
    return ranges.groupBy("p.source").agg(
        *(F.first(c).alias(c) for c in ("source_size", "target", "whole")),
        F.coalesce(F.max(F.when(near | (F.col("upto") <= F.col("more")), F.col("range"))), F.lit(-1)).alias("cut"),
    )


#: Rows of a plan up to which it is sent to every task, some 10 MB; a plan of more sources is joined by shuffle.
SENT_SOURCES = 100_000


def _beside_rows(plan: DataFrame) -> DataFrame:
    plan = cut(plan)
    return F.broadcast(plan) if plan.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES else plan


def mix(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words, repeats counted) for each row of ``docs``; ``options`` as ``plan_sources`` has them."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest_range(seed, F.col("doc_id"), F.col("text")).alias("range")))
    copies = F.col("whole") + (F.col("range") <= F.col("cut")).cast("long")
    return sized.alias("d").join(_beside_rows(plan_sources(sized, **options)).alias("c"), F.expr("d.source <=> c.source")).select(
        "doc_id", F.col("size"), F.col("d.source").alias("source"), "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )


def repeat_rows(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their columns, each as often as the mix takes it. Each row finds its source's plan; rows don't meet by id."""
    drawn = digest_range(seed, F.col("doc_id"), F.col("text"))
    plan = plan_sources(docs.select("source", n_words(F.col("text")).alias("size"), drawn.alias("range")), **options)
    rows = docs.select(F.struct(*docs.columns).alias("d"), drawn.alias("range"))
    taken = rows.join(_beside_rows(plan.withColumnRenamed("source", "s")), F.expr("d.source <=> s")).withColumn("copies", (F.col("whole") + (F.col("range") <= F.col("cut")).cast("long")).cast("int"))
    return taken.filter("copies > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")


#: The mix in DuckDB's SQL, with the parameters of the query.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || COALESCE(doc_id::VARCHAR, '') || ':' || COALESCE(text, '')), 1, 4))::INT AS range
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (
  SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () * 1.5::DOUBLE
             - COALESCE(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
f AS (SELECT *, arg_min(lev, place) FILTER (lev * weight < source_size * 2.0) OVER () AS first FROM l),
t AS (SELECT source, source_size, LEAST(source_size * 2.0::DOUBLE, COALESCE(weight * first, source_size * 2.0::DOUBLE)) AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT source, range, sum(size)::BIGINT AS range_size FROM d GROUP BY ALL),
u AS (SELECT *, sum(range_size) OVER (PARTITION BY source ORDER BY range) AS upto FROM r),
c AS (
  SELECT p.source, COALESCE(max(CASE WHEN abs(upto - (target - whole * source_size)) < abs(upto - range_size - (target - whole * source_size))
                                      OR upto <= target - whole * source_size THEN range END), -1) AS cut
  FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source GROUP BY p.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + CASE WHEN d.range <= c.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
