"""What comes from outside over the sample tables: edits in sidecars, lens corrections, edited lists of labels and folders renamed outside."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lens
from ..operators import labels, relocation
from ..operators.graph import checkpointed
from ..operators.pairing import ranked
from ..sources import develop, sidecar
from .live import own_folder
from .registry import query


#: Files that one task writes.
FILES_PER_TASK = 250


def described(k):
    """A sidecar whose settings follow from a whole number."""
    text = lambda c: c.cast("string")
    return sidecar.document({
        "crs:ProcessVersion": F.when(k % 7 == 1, "5.7").when(k % 7 > 1, "11.0"), "crs:AlreadyApplied": F.when(k % 11 == 0, "True"), "crs:HasSettings": F.when(k % 2 == 0, "True"),
        "crs:Exposure2012": F.when(k % 3 == 0, text(k % 15 - 7)), "crs:Contrast2012": F.when(k % 5 == 0, text(k % 301 - 150)), "crs:Saturation": F.when(k % 4 == 0, text(k % 50)),
        "crs:Temperature": F.when(k % 6 < 3, text(1000 + k % 100 * 1000)), "crs:Tint": F.when((k % 6).isin(0, 1, 4), text(k % 40)),
        "crs:HasCrop": F.when(k % 8 < 3, "true"), "crs:CropLeft": F.when(k % 8 < 4, "0.125"), "crs:CropRight": F.when(k % 8 == 1, "0.1").otherwise("0.875"), "crs:CropAngle": F.lit("2.5"),
        "crs:Exposure": F.when(k % 21 == 0, "0.5"), "crs:ParametricDarks": F.when(k % 9 == 0, "10"), "crs:GrainAmount": F.when(k % 10 == 0, "30"), "xmp:Rating": F.lit("3"),
    })


def taken(source: str, key: str) -> str:
    """SQL for the edits of the sidecars that ``described`` makes of a key."""
    return f"""
WITH k AS (SELECT {key} AS k FROM {source}),
v AS (SELECT k, k % 7 <= 1 AS older, k % 2 = 0 AS flagged, CASE WHEN k % 3 = 0 AND k % 7 > 1 THEN least(greatest(k % 15 - 7, -5), 5) ELSE 0 END AS exposure, CASE WHEN k % 5 = 0 AND k % 7 > 1 THEN least(greatest(k % 301 - 150, -100), 100) ELSE 0 END AS contrast,
  CASE WHEN k % 4 = 0 THEN k % 50 ELSE 0 END AS saturation, k % 6 < 3 AS warm, k % 6 IN (0, 1, 4) AS tinted, least(greatest(1000 + k % 100 * 1000, 2000), 50000) AS t, k % 40 AS tint, k % 8 IN (0, 2) AS cropped FROM k),
r AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'applied' WHEN NOT flagged AND exposure = 0 AND contrast = 0 AND saturation = 0 AND NOT cropped AND NOT (warm AND tinted) THEN 'nothing stated' WHEN older AND k % 21 = 0 THEN 'older controls' END AS refused FROM v)
SELECT k, refused, CASE WHEN refused IS NULL THEN exposure::DOUBLE END AS exposure, CASE WHEN refused IS NULL THEN contrast::DOUBLE END AS contrast, CASE WHEN refused IS NULL THEN saturation::DOUBLE END AS saturation,
  CASE WHEN refused IS NULL AND warm AND tinted THEN t::DOUBLE END AS temperature, CASE WHEN refused IS NULL AND warm AND tinted THEN tint::DOUBLE END AS tint,
  CASE WHEN refused IS NULL THEN CASE WHEN cropped THEN 0.125::DOUBLE ELSE 0.0::DOUBLE END END AS crop_left, CASE WHEN refused IS NULL THEN CASE WHEN cropped THEN 0.875::DOUBLE ELSE 1.0::DOUBLE END END AS crop_right, CASE WHEN refused IS NULL THEN CASE WHEN cropped THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END END AS crop_angle,
  CASE WHEN refused IS NULL THEN concat_ws(',', CASE WHEN warm <> tinted THEN 'half white balance' END, CASE WHEN older THEN 'older but untouched' END, CASE WHEN NOT flagged THEN 'settings not flagged' END) END AS notes,
  concat_ws(',', CASE WHEN k % 10 = 0 THEN 'GrainAmount' END, CASE WHEN k % 9 = 0 THEN 'parametric curve' END) AS left_out FROM r"""


def shown(found):
    fields = ("exposure", "contrast", "saturation", "temperature", "tint", "crop_left", "crop_right", "crop_angle")
    return found.select("k", "refused", *(F.col(f"edits.{f}").alias(f) for f in fields), F.array_join("notes", ",").alias("notes"), F.array_join("left_out", ",").alias("left_out"))


@query(taken("orders", "o_orderkey"))
def sidecar_edits(t):
    key = F.col("o_orderkey")
    return shown(develop.with_edits(t.orders.select(key.alias("k"), described(key).alias("xmp")), "xmp"))


@query(taken("supplier", "s_suppkey"))
def sidecar_edits_from_files(t):
    """The same from a file a supplier, read back from the folder."""
    with own_folder(t) as folder:
        key = F.col("s_suppkey")
        files = t.supplier.select(key.alias("k"), described(key).alias("value")).repartition(-(-t.supplier.count() // FILES_PER_TASK) or 1, "k")
        # a file a row: written, and moved to its place (version 2), by the tasks and not by the driver
        files.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("k").text(folder)
        found = sidecar.read(t.spark, folder, "*.txt").select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k"), F.col("text").alias("xmp"))
        return checkpointed(shown(develop.with_edits(found, "xmp")))


@query("""
WITH p AS (SELECT o_orderkey, (o_custkey % 41 - 20) / 200.0::DOUBLE AS k1, (o_orderkey % 31 - 15) / 300.0::DOUBLE AS k2, (o_orderkey % 97) / 80.0::DOUBLE AS radius, 3000.0::DOUBLE + o_custkey % 7 * 500 AS w, 4000.0::DOUBLE AS h FROM orders),
q AS (SELECT *, list_transform(range(0, 16), lambda i: round((k1 * (i / 15.0::DOUBLE) * (i / 15.0::DOUBLE) + k2 * ((i / 15.0::DOUBLE) * (i / 15.0::DOUBLE)) * ((i / 15.0::DOUBLE) * (i / 15.0::DOUBLE))) * 16384)) AS knots, least(radius * 15, 15.0::DOUBLE) AS place FROM p),
d AS (SELECT *, (knots[floor(place)::INT + 1] + (knots[least(floor(place)::INT + 2, 16)] - knots[floor(place)::INT + 1]) * (place - floor(place))) / 16384 AS moved FROM q)
SELECT o_orderkey, knots[16] + 0.0 AS corner, round(moved, 9) + 0.0 AS moved, round(0.9::DOUBLE * radius * (1 + moved), 9) AS source FROM d""")
def lens_radii(t):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select("o_orderkey", lens.knots_of((customer % 41 - 20) / 200.0, (key % 31 - 15) / 300.0, 16).alias("knots"), (key % 97 / 80.0).alias("radius"))
    knots, radius = F.col("knots"), F.col("radius")
    return rows.select("o_orderkey", F.get(knots, F.lit(15)).alias("corner"), (F.round(lens.displacement(knots, radius), 9) + 0.0).alias("moved"), F.round(lens.source_radius(knots, radius, F.lit(0.9)), 9).alias("source"))


@query("""
WITH p AS (SELECT s_suppkey, (s_nationkey - 12) / 100.0::DOUBLE AS k1, (s_suppkey % 9 - 4) / 100.0::DOUBLE AS k2, 3000.0::DOUBLE + s_suppkey % 7 * 500 AS w, 4000.0::DOUBLE AS h FROM supplier),
q AS (SELECT *, least(w, h) / 2 / sqrt(w / 2 * (w / 2) + h / 2 * (h / 2)) AS edge, list_transform(range(0, 16), lambda i: round((k1 * (i / 15.0::DOUBLE) * (i / 15.0::DOUBLE) + k2 * ((i / 15.0::DOUBLE) * (i / 15.0::DOUBLE)) * ((i / 15.0::DOUBLE) * (i / 15.0::DOUBLE))) * 16384)) AS knots FROM p),
r AS (SELECT s_suppkey, knots, edge, unnest(list_append(list_transform(range(0, 481), lambda i: i / 480.0::DOUBLE), edge)) AS radius FROM q),
d AS (SELECT *, radius * (1 + (knots[floor(radius * 15)::INT + 1] + (knots[least(floor(radius * 15)::INT + 2, 16)] - knots[floor(radius * 15)::INT + 1]) * (radius * 15 - floor(radius * 15))) / 16384) AS lands FROM r),
m AS (SELECT *, max(lands) OVER (PARTITION BY s_suppkey ORDER BY radius) AS reach FROM d),
c AS (SELECT s_suppkey, least(1.0::DOUBLE, min(CASE WHEN radius >= edge AND reach > 0 THEN radius / reach END)) AS crop FROM m GROUP BY 1)
SELECT s_suppkey, round(CASE WHEN crop < 1 THEN crop * (1 - 1e-5) ELSE crop END, 9) AS crop FROM c""")
def filling_crops(t):
    key = F.col("s_suppkey")
    knots = lens.knots_of((F.col("s_nationkey") - 12) / 100.0, (key % 9 - 4) / 100.0, 16)
    suppliers = t.supplier.select("s_suppkey", "s_nationkey").repartition(4 * t.spark.sparkContext.defaultParallelism)  # few bytes, much work
    rows = suppliers.select("s_suppkey", knots.alias("knots"), (3000.0 + key % 7 * 500).alias("w"))
    return rows.select("s_suppkey", F.round(lens.filling_crop(F.col("knots"), F.col("w"), F.lit(4000.0)), 9).alias("crop"))


HELD = "(SELECT c_nationkey AS library, c_custkey AS id, 'n' || c_custkey % 5 AS name, c_custkey % 3 AS colour, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS position, 'a' AS stamp, 'b' AS stamp_position FROM customer WHERE c_custkey % 4 > 0)"
ORDERED = "(SELECT c_nationkey AS library, c_custkey AS id, 'n' || c_custkey % 7 AS name, c_custkey % 3 AS colour, c_custkey AS place FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey <> 6)"
REMOVED = "(SELECT c_nationkey AS library, c_custkey AS id FROM customer WHERE c_custkey % 5 = 0 AND c_nationkey <> 6)"


@query(f"""
WITH s AS (SELECT * FROM {HELD} WHERE library IN (SELECT library FROM {ORDERED} UNION SELECT library FROM {REMOVED})),
stays AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM {REMOVED})), l AS (SELECT * FROM {ORDERED}),
b AS (SELECT coalesce(l.library, h.library) AS library, coalesce(l.id, h.id) AS id, l.id IS NULL AS late, h.id IS NULL AS anew, CASE WHEN l.id IS NULL THEN h.name ELSE l.name END AS name, CASE WHEN l.id IS NULL THEN h.colour ELSE l.colour END AS colour,
  h.name AS was, h.position AS stood, h.stamp, h.stamp_position, coalesce(l.place, h.position) AS listed_at FROM l FULL JOIN stays h ON h.id = l.id),
p AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY late, listed_at, id) - 1 AS position FROM b)
SELECT library, id, name, colour, position, CASE WHEN anew OR name <> was THEN 'z' ELSE stamp END AS stamp, CASE WHEN anew OR position <> stood THEN 'z' ELSE stamp_position END AS stamp_position,
  CASE WHEN anew THEN 'insert' WHEN name <> was AND position <> stood THEN 'rename and move' WHEN name <> was THEN 'rename' WHEN position <> stood THEN 'move' ELSE 'keep' END AS action FROM p
UNION ALL SELECT library, id, name, colour, position, stamp, stamp_position, 'delete' FROM s WHERE id IN (SELECT id FROM {REMOVED})""")
def saved_labels(t):
    key = F.col("c_custkey")
    base = lambda where, n: t.customer.filter(where).select(F.col("c_nationkey").alias("library"), key.alias("id"), F.concat(F.lit("n"), (key % n).cast("string")).alias("name"), (key % 3).alias("colour"))
    held = ranked(base("c_custkey % 4 > 0", 5), ["library"], ["id"], "position").withColumns({"stamp": F.lit("a"), "stamp_position": F.lit("b")})
    ordered = base("c_custkey % 3 = 0 AND c_nationkey <> 6", 7).withColumn("place", F.col("id"))
    removed = base("c_custkey % 5 = 0 AND c_nationkey <> 6", 7).select("library", "id")
    return labels.saved(held, ordered, removed, F.lit("z"))


@query("""
WITH s AS (SELECT c_custkey AS id, 'old/' || c_custkey AS path, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS dev, c_custkey // 3 AS ino, CASE WHEN c_custkey // 3 % 2 = 0 THEN c_custkey % 4 + 1 END AS birth FROM customer),
d AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN 'old/' ELSE 'new/' END || c_custkey AS path, c_nationkey AS dev, c_custkey // 3 AS ino, c_custkey % 4 + CASE WHEN c_custkey % 8 = 1 THEN 2 ELSE 1 END AS birth FROM customer WHERE c_custkey % 9 > 0
  UNION ALL SELECT 'twin/' || c_custkey, c_nationkey, c_custkey // 3, c_custkey % 4 + 1 FROM customer WHERE c_custkey % 10 = 3),
f AS (SELECT * FROM d WHERE path NOT IN (SELECT path FROM s)),
c AS (SELECT s.id, s.path, min(f.path) AS target FROM s JOIN f ON f.dev = s.dev AND f.ino = s.ino AND (s.birth IS NULL OR s.birth = f.birth) WHERE s.path NOT IN (SELECT path FROM d) GROUP BY ALL HAVING count(*) = 1)
SELECT min(id) AS id, arg_min(path, id) AS path, target FROM c GROUP BY target""")
def relocated_shoots(t):
    """Some folders kept their place, some birth times differ or aren't known, some identities stand twice; all shoots of an inode know their birth time or none does."""
    key, ino = F.col("c_custkey"), F.floor(F.col("c_custkey") / 3)
    name = lambda top: F.concat(top, key.cast("string")).alias("path")
    birth = key % 4 + 1
    shoots = t.customer.select(key.alias("id"), name(F.lit("old/")), F.when(key % 7 > 0, F.col("c_nationkey")).alias("dev"), ino.alias("ino"), F.when(ino % 2 == 0, birth).alias("birth"))
    dirs = t.customer.filter("c_custkey % 9 > 0").select(name(F.when(key % 6 == 0, "old/").otherwise("new/")), F.col("c_nationkey").alias("dev"), ino.alias("ino"), F.when(key % 8 == 1, birth + 1).otherwise(birth).alias("birth"))
    twins = t.customer.filter("c_custkey % 10 = 3").select(name(F.lit("twin/")), F.col("c_nationkey").alias("dev"), ino.alias("ino"), birth.alias("birth"))
    return relocation.relocated(shoots, dirs.union(twins))
