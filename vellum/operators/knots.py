"""Interpolating as-of joins: a value between the two knots around it in a table of calibration.

Values and knots are dealt by range over (group, place) together and written down; inside a range, carried windows give the last knot before and the first one after a row, and a short table of the ranges' first and
last knots carries them over the ranges' ends. So a group with a third of all rows is cut into ranges like any other, and no knot is looked up by a join.

Defined results: a place on a knot has the knot's value; before the first and after the last knot of a group the value is that knot's (``ends`` "clamp") or null ("null"); null or NaN places and groups without knots give null;
null groups are one group; knots with a null place or value don't count; of knots at one place the least value counts; repeated rows are rows of the result each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def interpolated(rows: DataFrame, knots: DataFrame, by: str, at: str, value: str, name: str, ends: str = "clamp", ranges: int | None = None) -> DataFrame:
    """The rows with ``name``: the value at their place ``at`` in their group ``by``. ``knots`` has the columns ``by``, ``at`` and ``value``."""
    if ends not in ("clamp", "null"):
        raise ValueError("ends is clamp or null")
    place = F.when(~F.isnan(F.col(at).cast("double")), F.col(at).cast("double"))
    table = knots.select(F.col(by).alias("__by"), place.alias("__at"), F.col(value).cast("double").alias("__v")).dropna(subset=["__at", "__v"]).groupBy("__by", "__at").agg(F.min("__v").alias("__v"))
    own = F.struct(*[F.col(c) for c in rows.columns])
    both = table.withColumn("__row", F.lit(None).cast(rows.select(own.alias("r")).schema["r"].dataType)).unionByName(rows.select(F.col(by).alias("__by"), place.alias("__at"), F.lit(None).cast("double").alias("__v"), own.alias("__row")))
    keys = [F.col("__by").asc_nulls_first(), F.col("__at").asc_nulls_first(), F.col("__row").isNotNull().asc(), F.col("__tie").asc()]
    both = both.withColumn("__tie", F.monotonically_increasing_id())
    dealt = both.repartitionByRange(ranges, *keys) if ranges else both.repartitionByRange(*keys)
    dealt = checkpointed(dealt.withColumn("__part", F.spark_partition_id()))
    knot = F.when(F.col("__row").isNull(), F.struct("__by", "__at", "__v"))
    order = Window.partitionBy("__part").orderBy(*keys)
    # the next knot is the last one in the opposite order: a frame that ends with its partition is summed anew for each row
    back = Window.partitionBy("__part").orderBy(F.col("__by").desc_nulls_last(), F.col("__at").desc_nulls_last(), F.col("__row").isNotNull().desc(), F.col("__tie").desc())
    local = dealt.withColumns({"__a": F.last(knot, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__b": F.last(knot, True).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    sort = F.struct(F.col("__by").isNotNull(), "__by", "__at")
    parts = dealt.groupBy("__part").agg(F.min_by(knot, F.when(knot.isNotNull(), sort)).alias("first"), F.max_by(knot, F.when(knot.isNotNull(), sort)).alias("last"))
    along = Window.orderBy("__part")  # one row a range
    carried = parts.select("__part", F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    found = local.filter("__row IS NOT NULL").join(F.broadcast(carried), "__part")
    side = lambda near, far: F.when(F.coalesce(near, far)["__by"].eqNullSafe(F.col("__by")) & F.col("__at").isNotNull(), F.coalesce(near, far))
    a, b = side(F.col("__a"), F.col("__before")), side(F.col("__b"), F.col("__after"))
    found = found.withColumns({"__a": a, "__b": b})
    share = (F.col("__at") - F.col("__a.__at")) / (F.col("__b.__at") - F.col("__a.__at"))
    between = F.col("__a.__v") + (F.col("__b.__v") - F.col("__a.__v")) * share
    end = F.coalesce("__a.__v", "__b.__v") if ends == "clamp" else F.lit(None).cast("double")
    result = F.when(F.col("__a.__at") == F.col("__at"), F.col("__a.__v")).when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), between).otherwise(end)
    return found.select("__row.*", result.alias(name))
