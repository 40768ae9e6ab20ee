"""Catalogue rows: projections, who stands for whom, renditions, links, edit sessions and scans.

An order is a photo (its customer its stack), its lineitems are its edits (the first two), the frames it is composed of, its backups and the devices that hold it;
suppliers are devices, a customer's place in the world is a shoot's folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, paths, validity
from ..operators import links, projection, rendition, scan, sessions
from .listings import PATHS, customer_paths
from .registry import query

KINDS = ("hdr", "panorama")
PHOTO_COLUMNS = {
    "id": "o_orderkey", "library_id": "CAST(o_custkey % 3 AS INT)", "shoot_id": "CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 40 END", "stack_id": "o_custkey",
    "kind": "CASE o_orderkey % 5 WHEN 0 THEN 'panorama' WHEN 1 THEN 'hdr' ELSE 'file' END", "sequence_kind": "CASE o_custkey % 3 WHEN 0 THEN 'exposure' WHEN 1 THEN 'focus' END",
    "is_missing": "o_orderstatus = 'P' OR o_orderpriority = '2-HIGH'", "is_deleted": "o_orderkey % 11 = 0", "is_hidden": "o_orderpriority = '5-LOW'",
    "date_taken": "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END", "date_added": "o_orderdate", "stamp_placement": "lpad(CAST(o_custkey AS {text}), 8, '0')",
    "triage": "CASE o_orderstatus WHEN 'F' THEN 'picked' WHEN 'O' THEN 'rejected' ELSE 'odd' END",
}
PHOTOS = "(SELECT " + ", ".join(f"{v.format(text='VARCHAR')} AS {k}" for k, v in PHOTO_COLUMNS.items()) + " FROM orders)"
EDITS = "(SELECT l_orderkey AS photo_id, max(l_suppkey) % 3 AS cursor, lpad(CAST(max(l_partkey) AS VARCHAR), 8, '0') AS stamp FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)"
SOURCES = "(SELECT l_orderkey AS composed_id, l_partkey AS photo_id FROM lineitem WHERE l_linenumber >= 3 AND l_orderkey % 5 < 2)"
BACKUPS = "(SELECT l_orderkey AS photo_id, CASE l_returnflag WHEN 'R' THEN 'held' ELSE 'lost' END AS health FROM lineitem WHERE l_linenumber = 3)"
BLOBS = "(SELECT l_orderkey AS photo_id, l_suppkey % 6 AS peer_id FROM lineitem WHERE l_linenumber = 4)"
PEERS = "(SELECT s_suppkey AS peer_id, CAST(s_suppkey % 3 AS INT) AS library_id, CASE WHEN s_suppkey % 2 = 1 THEN 'active' ELSE 'left' END AS kind, CASE WHEN s_suppkey <> 3 THEN s_name END AS address FROM supplier WHERE s_suppkey IN (1, 2, 3, 4))"
STACKS = "(SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'bracket' ELSE 'auto' END AS origin, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 9 + 1 AS BIGINT) END AS size FROM customer)"
LINKS = "(SELECT o_orderkey AS raw_id, o_orderkey + 1 AS camera_file_id FROM orders WHERE o_orderkey % 4 < 2)"


def photos(t):
    return t.orders.select(*(F.expr(v.format(text="STRING")).alias(k) for k, v in PHOTO_COLUMNS.items()))


def edits(t):
    return t.lineitem.filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("photo_id")).agg((F.max("l_suppkey") % 3).alias("cursor"), F.lpad(F.max("l_partkey").cast("string"), 8, "0").alias("stamp"))


def sources(t):
    return t.lineitem.filter("l_linenumber >= 3 AND l_orderkey % 5 < 2").select(F.col("l_orderkey").alias("composed_id"), F.col("l_partkey").alias("photo_id"))


def backups(t):
    return t.lineitem.filter("l_linenumber = 3").select(F.col("l_orderkey").alias("photo_id"), F.when(F.col("l_returnflag") == "R", "held").otherwise("lost").alias("health"))


def blobs(t):
    return t.lineitem.filter("l_linenumber = 4").select(F.col("l_orderkey").alias("photo_id"), (F.col("l_suppkey") % 6).alias("peer_id"))


def peers(t):
    kind, address = F.when(F.col("s_suppkey") % 2 == 1, "active").otherwise("left"), F.when(F.col("s_suppkey") != 3, F.col("s_name"))
    return t.supplier.filter("s_suppkey IN (1, 2, 3, 4)").select(F.col("s_suppkey").alias("peer_id"), (F.col("s_suppkey") % 3).cast("int").alias("library_id"), kind.alias("kind"), address.alias("address"))


def stacks(t):
    size = F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 9 + 1).cast("long"))
    return t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "bracket").otherwise("auto").alias("origin"), size.alias("size"))


def pairs(t):
    return t.orders.filter("o_orderkey % 4 < 2").select(F.col("o_orderkey").alias("raw_id"), (F.col("o_orderkey") + 1).alias("camera_file_id"))


def facts(t):
    return projection.row_facts(edits(t), sources(t), backups(t), blobs(t), peers(t), 0)


_HELD = f"EXISTS (SELECT 1 FROM {BACKUPS} b WHERE b.photo_id = {{0}}.id AND b.health = 'held')"
_AWAY = f"EXISTS (SELECT 1 FROM {BLOBS} b WHERE b.photo_id = {{0}}.id AND b.peer_id <> 0)"
_EDITED = f"EXISTS (SELECT 1 FROM {EDITS} e WHERE e.photo_id = p.id AND e.cursor > 0)"
_FRAMES = f"EXISTS (SELECT 1 FROM {SOURCES} s JOIN {EDITS} e ON e.photo_id = s.photo_id WHERE s.composed_id = p.id AND e.cursor > 0)"
_GONE = f"({{0}}.is_missing AND NOT {_HELD} AND NOT {_AWAY})"
_REACH = f"(EXISTS (SELECT 1 FROM {BLOBS} b JOIN {PEERS} r ON r.peer_id = b.peer_id WHERE b.photo_id = p.id AND r.kind = 'active' AND r.address IS NOT NULL) OR EXISTS (SELECT 1 FROM {PEERS} r WHERE r.library_id = p.library_id AND r.kind = 'active' AND r.address IS NOT NULL))"
_OWN_STAMP = f"coalesce((SELECT max(stamp) FROM {EDITS} e WHERE e.photo_id = p.id), '')"
_FRAME_STAMP = f"coalesce((SELECT max(e.stamp) FROM {SOURCES} s JOIN {EDITS} e ON e.photo_id = s.photo_id WHERE s.composed_id = p.id), '')"
_BUILT = f"nullif(greatest({_OWN_STAMP}, {_FRAME_STAMP}, CASE WHEN kind <> 'file' THEN stamp_placement ELSE '' END), '')"


@query(f"""SELECT id, library_id, stack_id, nullif(kind, 'file') AS composite_kind,
  CASE WHEN EXISTS (SELECT 1 FROM {STACKS} k WHERE k.id = p.stack_id AND k.origin = 'bracket') THEN sequence_kind END AS bracket_kind,
  (SELECT count(*) FROM {SOURCES} s WHERE s.composed_id = p.id) AS frame_count, coalesce((SELECT max(size) FROM {STACKS} k WHERE k.id = p.stack_id), 1) AS stack_size,
  date_taken AS ordering_date, CASE WHEN triage IN ('picked', 'rejected') THEN triage ELSE 'untriaged' END AS triage, is_missing, is_deleted,
  {_EDITED} AS is_edited, {_FRAMES} AS frames_edited, CASE WHEN kind <> 'file' THEN {_FRAMES} ELSE {_EDITED} END AS edits_render,
  is_missing AND {_HELD.format('p')} AS is_offloaded,
  CASE WHEN NOT is_missing OR {_HELD.format('p')} THEN NULL WHEN NOT {_AWAY.format('p')} THEN NULL WHEN {_REACH} THEN 'reachable' ELSE 'unreachable' END AS original_elsewhere,
  {_BUILT} AS built_from FROM {PHOTOS} p""")
def listing_summaries(t):
    return projection.summaries(photos(t), facts(t), stacks(t), peers(t), "taken_desc", KINDS)


@query(f"SELECT id FROM {PHOTOS} f WHERE NOT EXISTS (SELECT 1 FROM {LINKS} l JOIN {PHOTOS} r ON r.id = l.raw_id WHERE l.camera_file_id = f.id AND r.is_deleted = f.is_deleted AND (NOT {_GONE.format('r')} OR {_GONE.format('f')}))")
def not_a_camera_file(t):
    return projection.not_a_camera_file(projection.with_facts(photos(t), facts(t)), pairs(t)).select("id")


@query(f"""SELECT id FROM {PHOTOS} f WHERE NOT EXISTS (SELECT 1 FROM {SOURCES} s JOIN {PHOTOS} c ON c.id = s.composed_id WHERE s.photo_id = f.id AND NOT c.is_deleted)
  AND NOT EXISTS (SELECT 1 FROM {LINKS} l JOIN {PHOTOS} r ON r.id = l.raw_id WHERE l.camera_file_id = f.id AND r.is_deleted = f.is_deleted AND (NOT {_GONE.format('r')} OR {_GONE.format('f')}))""")
def not_stood_for(t):
    return projection.not_stood_for(projection.with_facts(photos(t), facts(t)), sources(t), pairs(t)).select("id")


@query(f"SELECT l.raw_id, arg_min(f.kind, f.id) AS kind FROM {LINKS} l JOIN {PHOTOS} r ON r.id = l.raw_id JOIN {PHOTOS} f ON f.id = l.camera_file_id WHERE f.is_deleted = r.is_deleted AND NOT {_GONE.format('f')} GROUP BY 1")
def camera_file_of(t):
    return projection.camera_file_of(projection.with_facts(photos(t), facts(t)), pairs(t), "kind")


SHOOTS = f"(SELECT c_custkey AS id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder_path, c_custkey % 9 = 0 AS is_hidden FROM {PATHS} WHERE c_custkey < 40)"
_HIDDEN_SHOOTS = f"(SELECT s.id FROM {SHOOTS} s JOIN {SHOOTS} h ON h.is_hidden AND (s.folder_path = h.folder_path OR starts_with(s.folder_path, h.folder_path || '/')) WHERE s.id <> 9)"


def shoots(t):
    return customer_paths(t).filter("c_custkey < 40").select(F.col("c_custkey").alias("id"), paths.folder(F.col("path")).alias("folder_path"), (F.col("c_custkey") % 9 == 0).alias("is_hidden"))


@query(f"SELECT id, is_hidden OR (shoot_id IS NOT NULL AND shoot_id IN {_HIDDEN_SHOOTS}) AS hides FROM {PHOTOS}")
def hidden_but_for_one_shoot(t):
    return projection.hidden(photos(t), shoots(t), exempt=9).select("id", "hides")


# renditions

_CONTEXT = {
    "mode": "CASE o_orderkey % 7 WHEN 0 THEN 'remember' WHEN 1 THEN 'remember_per_photo' WHEN 2 THEN 'best_available' WHEN 3 THEN 'embedded' WHEN 4 THEN 'full' WHEN 5 THEN 'max' END",
    "last_rendition": "CASE o_custkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'camera' WHEN 2 THEN 'max' END", "row_rendition": "CASE o_custkey % 5 WHEN 0 THEN 'embedded' WHEN 1 THEN 'max' WHEN 2 THEN 'full' END",
    "library_source": "CASE WHEN o_orderpriority < '3' THEN 'render' ELSE 'embedded' END", "is_raw": "o_custkey % 6 <> 0", "is_edited": "o_orderkey % 3 = 0", "frames_edited": "o_orderkey % 4 = 0",
    "has_embedded": "o_custkey % 8 <> 1", "composes": "o_orderstatus = 'F'", "built_is_exact": "o_orderkey % 2 = 0",
}
_BUILT_SET = {"embedded": "o_orderkey % 5 = 0", "camera": "o_orderkey % 5 = 1", "full": "o_orderkey % 5 > 2", "max": "o_orderkey % 6 = 0"}
_R = ", ".join(f"{v} AS {k}" for k, v in _CONTEXT.items()) + ", " + ", ".join(f"{v} AS has_{k}" for k, v in _BUILT_SET.items())


@query(f"""WITH c AS (SELECT o_orderkey, {_R.replace('<> 1 AS has_embedded', '<> 1 AS lifts')} FROM orders),
w AS (SELECT *, CASE mode WHEN 'remember' THEN last_rendition WHEN 'remember_per_photo' THEN row_rendition WHEN 'best_available' THEN CASE WHEN has_max THEN 'max' WHEN has_full THEN 'full' WHEN lifts THEN 'embedded' ELSE 'full' END ELSE mode END AS wanted,
  CASE WHEN library_source = 'render' OR (CASE WHEN composes THEN frames_edited ELSE is_edited END) OR NOT lifts THEN 'full' ELSE 'embedded' END AS sure FROM c),
s AS (SELECT *, CASE WHEN NOT is_raw THEN CASE WHEN is_edited THEN 'full' ELSE 'embedded' END WHEN wanted IS NULL THEN sure
  WHEN wanted = 'embedded' THEN CASE WHEN has_embedded THEN wanted ELSE sure END WHEN wanted = 'camera' THEN CASE WHEN has_camera THEN wanted ELSE sure END
  WHEN wanted = sure OR (mode = 'best_available' AND built_is_exact) THEN wanted ELSE sure END AS shown FROM w)
SELECT o_orderkey, wanted, shown, CASE WHEN NOT is_raw THEN NULL WHEN shown = 'embedded' AND composes AND NOT has_embedded THEN 'embedded' WHEN wanted IN ('embedded', 'camera') THEN NULL WHEN wanted <> shown THEN wanted END AS to_build FROM s""")
def rendition_policy(t):
    built = F.filter(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in _BUILT_SET.items())), lambda x: x.isNotNull())
    rows = t.orders.select("o_orderkey", *(F.expr(v).alias(k) for k, v in _CONTEXT.items()), built.alias("built"))
    return rows.select("o_orderkey", rendition.wanted().alias("wanted"), rendition.shown().alias("shown"), rendition.to_build().alias("to_build"))


# links

@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey % 3 AS library_id, date_trunc('month', o_orderdate) AS date_taken, CAST(o_custkey % 50 AS VARCHAR) AS stem, nullif(o_orderpriority, '5-LOW') AS make, CASE WHEN o_orderkey % 2 = 0 THEN 'arw' ELSE 'jpg' END AS format FROM orders)
SELECT r.id AS raw_id, c.id AS camera_file_id FROM f r JOIN f c USING (library_id, date_taken, stem) WHERE r.format = 'arw' AND c.format = 'jpg' AND r.make IS NOT DISTINCT FROM c.make""")
def linked_pairs(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("library_id"), F.trunc("o_orderdate", "month").alias("date_taken"), F.lit("f").alias("folder"), (F.col("o_custkey") % 50).cast("string").alias("stem"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("camera_make"), F.lit(None).cast("string").alias("camera_model"), F.when(F.col("o_orderkey") % 2 == 0, "arw").otherwise("jpg").alias("format"), F.lit("file").alias("kind"),
    )
    return links.link_pairs(rows, paths.RENDERED_FORMATS, ("jpg", "heic"))


MEMBERS = "(SELECT o_custkey AS grp, o_orderkey AS id, o_orderkey % 2 = 0 AS is_raw, nullif(o_orderstatus, 'P') AS triage, CAST(left(o_orderpriority, 1) AS INT) AS rating, CASE WHEN o_orderkey % 13 > 0 THEN strftime(o_orderdate, '%Y%m') END AS stamp FROM orders)"


def members(t):
    return t.orders.select(
        F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("is_raw"), F.nullif("o_orderstatus", F.lit("P")).alias("triage"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"), F.when(F.col("o_orderkey") % 13 > 0, F.date_format("o_orderdate", "yyyyMM")).alias("stamp"),
    )


@query(f"WITH w AS (SELECT *, first_value(triage) OVER o AS t, first_value(rating) OVER o AS r FROM {MEMBERS} WINDOW o AS (PARTITION BY grp ORDER BY coalesce(stamp, '') DESC, is_raw DESC, id DESC)) SELECT id, t AS triage, r AS rating FROM w WHERE triage IS DISTINCT FROM t OR rating IS DISTINCT FROM r")
def newest_marks_of_groups(t):
    return links.newest_marks(members(t), ["triage", "rating"], "stamp")


LABELS = "(SELECT DISTINCT l_orderkey AS id, l_returnflag || l_linestatus AS label, strftime(min(l_shipdate), '%Y%m') AS stamp FROM lineitem WHERE l_linenumber {0} GROUP BY 1, 2)"


def marks(t, where):
    return t.lineitem.filter(f"l_linenumber {where}").groupBy(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("label")).agg(F.date_format(F.min("l_shipdate"), "yyyyMM").alias("stamp"))


@query(f"""WITH held AS {LABELS.format('= 1')}, removed AS {LABELS.format('= 2')},
g AS (SELECT m.grp, h.label, max(h.stamp) AS added FROM {MEMBERS} m JOIN held h USING (id) GROUP BY 1, 2),
e AS (SELECT m.grp, m.id, g.label, g.added, h.stamp AS has, coalesce(r.stamp, '') AS gone FROM {MEMBERS} m JOIN g USING (grp) LEFT JOIN held h ON h.id = m.id AND h.label = g.label LEFT JOIN removed r ON r.id = m.id AND r.label = g.label),
l AS (SELECT *, max(gone) FILTER (has IS NULL) OVER (PARTITION BY grp, label) AS last FROM e)
SELECT id, label, CASE WHEN last > added THEN 'remove' ELSE 'add' END AS action FROM l WHERE last IS NOT NULL AND (last > added) = (has IS NOT NULL)""")
def shared_labels_of_groups(t):
    return links.shared_labels(members(t).select("group", "id"), marks(t, "= 1"), marks(t, "= 2"))


CROPS = "(SELECT l_orderkey AS photo_id, min(l_discount) AS l, min(l_tax) AS tp, 1 - min(l_tax) AS r, 1 - min(l_discount) AS b, min(l_suppkey) AS turns FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"
VARIANTS = "(SELECT l_orderkey AS photo_id, CASE l_linenumber WHEN 2 THEN 'grid' WHEN 3 THEN 'full' ELSE 'max' END AS variant, CASE WHEN l_returnflag <> 'A' THEN l_shipdate END AS built_at, l_linestatus = 'O' AS needs_build FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4)"


@query(f"""WITH c AS {CROPS}, v AS {VARIANTS},
f AS (SELECT o_orderkey AS id, 600 + o_custkey % 400 AS width, 400 + o_custkey % 300 AS height, CASE WHEN o_orderkey % 5 < 2 THEN 1000 + o_custkey % 9 END AS cw, CASE WHEN o_orderkey % 5 < 2 THEN 900 + o_custkey % 7 END AS ch, o_totalprice AS file_size FROM orders WHERE o_orderkey % 17 > 0)
SELECT p.id, date_taken AS ordering_date, f.file_size, (CASE WHEN c.photo_id IS NULL THEN width WHEN turns % 2 = 1 THEN greatest(1, floor(coalesce(ch, height) * (b - tp) + 0.5)) ELSE greatest(1, floor(coalesce(cw, width) * (r - l) + 0.5)) END)::BIGINT AS display_width,
  (CASE WHEN c.photo_id IS NULL THEN height WHEN turns % 2 = 1 THEN greatest(1, floor(coalesce(cw, width) * (r - l) + 0.5)) ELSE greatest(1, floor(coalesce(ch, height) * (b - tp) + 0.5)) END)::BIGINT AS display_height,
  (SELECT max(built_at) FROM v WHERE v.photo_id = p.id AND variant = 'grid') AS tile_built_at, coalesce((SELECT bool_or(needs_build) FROM v WHERE v.photo_id = p.id AND variant = 'full'), FALSE) AS needs_renditions,
  coalesce((SELECT string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) FROM lineitem WHERE l_orderkey = p.id AND l_linenumber = 5), '') AS albums,
  (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = p.id AND l_linenumber > 5) AS labels,
  (SELECT arg_min(CASE WHEN w.id % 2 = 0 THEN 'jpg' ELSE 'heic' END, w.id) FROM {LINKS} k JOIN {PHOTOS} w ON w.id = k.camera_file_id WHERE k.raw_id = p.id AND w.is_deleted = p.is_deleted AND NOT {_GONE.format('w')}) AS camera_file_format
FROM {PHOTOS} p LEFT JOIN f USING (id) LEFT JOIN c ON c.photo_id = p.id""")
def detail_rows(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    canvas = lambda v: F.when(key % 5 < 2, v)
    fields = t.orders.filter("o_orderkey % 17 > 0").select(key.alias("id"), (600 + cust % 400).alias("width"), (400 + cust % 300).alias("height"), canvas(1000 + cust % 9).alias("canvas_width"), canvas(900 + cust % 7).alias("canvas_height"), F.col("o_totalprice").alias("file_size"))
    one = t.lineitem.filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("photo_id")).agg(F.min("l_discount").alias("left"), F.min("l_tax").alias("top"), F.min("l_suppkey").alias("quarter_turns"))
    crops = one.withColumns({"right": 1 - F.col("top"), "bottom": 1 - F.col("left")})
    variant = F.when(F.col("l_linenumber") == 2, "grid").when(F.col("l_linenumber") == 3, "full").otherwise("max")
    copies = t.lineitem.filter("l_linenumber BETWEEN 2 AND 4").select(F.col("l_orderkey").alias("photo_id"), variant.alias("variant"), F.when(F.col("l_returnflag") != "A", F.col("l_shipdate")).alias("built_at"), (F.col("l_linestatus") == "O").alias("needs_build"))
    rows = projection.with_facts(photos(t), facts(t)).withColumn("format", F.when(F.col("id") % 2 == 0, "jpg").otherwise("heic"))
    files = projection.camera_file_of(rows, pairs(t), "format")
    part = lambda where, c, name: t.lineitem.filter(where).select(F.col("l_orderkey").alias("photo_id"), F.col(c).alias(name))
    summary = projection.summaries(photos(t), facts(t), stacks(t), peers(t), "taken_desc", KINDS)
    out = projection.details(summary, fields, crops, copies, files, part("l_linenumber = 5", "l_suppkey", "album_id"), part("l_linenumber > 5", "l_partkey", "label_id"))
    return out.select(
        "id", "ordering_date", "file_size", "display_width", "display_height", "tile_built_at", "needs_renditions", F.array_join(F.array_sort(F.col("album_ids").cast("array<string>")), ",").alias("albums"),
        F.size("label_ids").cast("long").alias("labels"), "camera_file_format",
    )
