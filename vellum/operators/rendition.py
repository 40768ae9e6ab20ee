"""Which rendition a row is wanted, shown and built at: decision tables over columns.

A context has the columns mode (remember, remember_per_photo, best_available, or a rendition by name), last_rendition, row_rendition, library_source, is_raw,
is_edited, frames_edited, has_embedded, composes and built_is_exact, and built, an array of the renditions that are built.

Defined results: null flags count as false and a null ``built`` as none; a null or unknown mode wants nothing, so what is promised is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Renditions a mode may name, and the camera's own pictures.
NAMED = ("embedded", "camera", "full", "max")
OWN = ("embedded", "camera")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _built(rendition) -> Column:
    return F.coalesce(F.array_contains("built", rendition), F.lit(False))


def wanted() -> Column:
    """What the setting asks for, which may be nothing or a file that isn't there."""
    best = F.when(_built("max"), "max").when(_built("full"), "full").when(_flag("has_embedded"), "embedded").otherwise("full")
    mode = F.col("mode")
    return F.when(mode == "remember", F.col("last_rendition")).when(mode == "remember_per_photo", F.col("row_rendition")).when(mode == "best_available", best).when(mode.isin(*NAMED), mode)


def guaranteed() -> Column:
    """What is there without a look: the render where the library renders, an edit needs it or there is nothing else; else the camera's picture."""
    past = F.when(_flag("composes"), _flag("frames_edited")).otherwise(_flag("is_edited"))
    renders = F.coalesce(F.col("library_source") == "render", F.lit(False))
    return F.when(renders | past | ~_flag("has_embedded"), "full").otherwise("embedded")


def shown() -> Column:
    """What to draw from now, with no build."""
    want, sure = wanted(), guaranteed()
    exact = F.coalesce(F.col("mode") == "best_available", F.lit(False)) & _flag("built_is_exact")
    raw = F.when(want.isNull(), sure).when(want.isin(*OWN), F.when(_built(want), want).otherwise(sure)).when((want == sure) | exact, want).otherwise(sure)
    return F.when(~_flag("is_raw"), F.when(_flag("is_edited"), "full").otherwise("embedded")).otherwise(raw)


def to_build() -> Column:
    """What to build before the row can be read at what is wanted, or null."""
    want, now = wanted(), shown()
    return F.when(~_flag("is_raw"), F.lit(None).cast("string")).when((now == "embedded") & _flag("composes") & ~_built("embedded"), "embedded").when(
        want.isNotNull() & ~want.isin(*OWN) & (want != now), want
    )


def queue_edited(touched: DataFrame, renditions: DataFrame) -> DataFrame:
    """Photos (photo_id, stamp: the newest edit behind them) whose copy (photo_id, built_from, deferred_from) is older than that, or was never built, and wasn't put off until a later edit. Of repeated rows the
    newest stamps count; photos without a stamp are owed nothing."""
    newest = touched.groupBy("photo_id").agg(F.max("stamp").alias("stamp")).filter("stamp IS NOT NULL")
    copies = renditions.groupBy("photo_id").agg(F.max("built_from").alias("__built"), F.max("deferred_from").alias("__put_off"))
    owed = newest.join(copies, "photo_id", "left")
    return owed.filter("(__built IS NULL OR stamp > __built) AND (__put_off IS NULL OR stamp > __put_off)").select("photo_id", "stamp")


def put_off(renditions: DataFrame, touched: DataFrame, keep=None) -> DataFrame:
    """Copies (photo_id, built_at, built_from, deferred_from, needs_build) after the photos in ``touched`` (photo_id, stamp), but for ``keep``, are put off until an edit after that stamp. One that was never
    built is still needed; a photo without a copy gets a row that needs none."""
    newest = touched.filter(~F.col("photo_id").eqNullSafe(F.lit(keep))).groupBy("photo_id").agg(F.max("stamp").alias("__stamp"), F.lit(True).alias("__off"))
    both = renditions.withColumn("__there", F.lit(True)).join(newest, "photo_id", "full")
    off, there = F.coalesce("__off", F.lit(False)), F.coalesce("__there", F.lit(False))
    needs = F.when(off & (F.col("built_at").isNotNull() | ~there), False).otherwise(F.col("needs_build"))
    return both.select("photo_id", "built_at", "built_from", F.when(off, F.col("__stamp")).otherwise(F.col("deferred_from")).alias("deferred_from"), needs.alias("needs_build"))
