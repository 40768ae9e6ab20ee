"""Scans against a catalogue, edit sessions, restored stamps, checks of outside values, projections of pixels, and picture descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, paths, validity
from ..operators import changes, descriptor, scan, sequence, sessions, similarity
from ..sources import sidecar
from .listings import PATHS, customer_paths
from .photos import EDITS, SOURCES, edits, sources
from .registry import query

FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
#: A nation and segment is a shoot's folder; its files are customers. Some folders weren't walked, some are gone, some have another identity.
SHOOT_ROWS = f"(SELECT row_number() OVER (ORDER BY path) AS id, path, CASE WHEN length(path) % 5 > 0 THEN length(path) END AS dev, n AS ino, 1 AS birth, CASE WHEN n % 3 = 0 THEN 0 ELSE n END AS photos FROM (SELECT {FOLDER} AS path, count(*) AS n FROM {PATHS} GROUP BY 1) WHERE n % 4 > 0)"
DIR_ROWS = f"(SELECT {FOLDER} AS path, length({FOLDER}) AS dev, CASE WHEN count(*) % 2 = 0 THEN count(*) ELSE 0 END AS ino, 1 AS birth FROM {PATHS} GROUP BY 1 HAVING count(*) % 5 > 0)"


def folders(t):
    return customer_paths(t).groupBy(paths.folder(F.col("path")).alias("path")).agg(F.count("*").alias("n"))


def shoot_rows(t):
    dev = F.when(F.length("path") % 5 > 0, F.length("path"))
    rows = folders(t).filter("n % 4 > 0").select("path", dev.alias("dev"), F.col("n").alias("ino"), F.lit(1).alias("birth"), F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")).alias("photos"))
    from ..operators import ordering

    return ordering.positions(rows, ["path"]).withColumn("id", F.col("position") + 1).drop("position")


def dir_rows(t):
    return folders(t).filter("n % 5 > 0").select("path", F.length("path").alias("dev"), F.when(F.col("n") % 2 == 0, F.col("n")).otherwise(0).alias("ino"), F.lit(1).alias("birth"))


@query(f"""WITH s AS {SHOOT_ROWS}, d AS {DIR_ROWS}
SELECT s.path, s.id, 'identity' AS change FROM s JOIN d USING (path) WHERE s.dev IS DISTINCT FROM d.dev OR s.ino IS DISTINCT FROM d.ino OR s.birth IS DISTINCT FROM d.birth
UNION ALL SELECT DISTINCT {FOLDER}, NULL, 'create' FROM {PATHS} WHERE {FOLDER} <> '' AND {FOLDER} NOT IN (SELECT path FROM s)
UNION ALL SELECT path, id, 'remove' FROM s WHERE photos = 0 AND dev IS NOT NULL AND path NOT IN (SELECT path FROM d) AND NOT EXISTS (SELECT 1 FROM s o WHERE starts_with(o.path, s.path || '/'))""")
def shoot_folder_changes(t):
    return scan.folder_changes(shoot_rows(t), dir_rows(t), customer_paths(t).select("path"), full=True)


BINS = "(SELECT n_nationkey AS library_id, 'bin' AS path, n_nationkey % 4 AS dev, CASE WHEN n_nationkey % 11 = 4 THEN 0 ELSE 7 END AS ino FROM nation)"
BIN_DIRS = "(SELECT n_nationkey AS library_id, CASE WHEN n_nationkey % 5 = 0 THEN 'bin' WHEN n_nationkey % 8 = 3 THEN 'deep/' || lower(n_name) ELSE lower(n_name) END AS path, n_nationkey % 4 AS dev, CASE WHEN n_nationkey % 11 = 4 THEN 0 ELSE 7 END AS ino FROM nation WHERE n_nationkey % 6 > 0 UNION ALL SELECT n_nationkey, 'copy', n_nationkey % 4, CASE WHEN n_nationkey % 11 = 4 THEN 0 ELSE 7 END FROM nation WHERE n_nationkey % 7 = 0)"
BINNED = "(SELECT c_nationkey AS library_id, 'bin/' || c_name AS path FROM customer WHERE c_custkey % 10 = 0)"
BIN_FILES = "(SELECT c_nationkey AS library_id, lower(n_name) || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 20 = 0 AND c_nationkey % 3 > 0)"


@query(f"""WITH m AS (SELECT library_id, count(*) AS n, min(d.path) AS target, bool_or(d.path = b.path) AS same FROM {BINS} b JOIN {BIN_DIRS} d USING (library_id, dev, ino) WHERE ino <> 0 GROUP BY 1),
j AS (SELECT b.library_id, b.path, m.n, m.target, m.same, EXISTS (SELECT 1 FROM {BINNED} x JOIN {BIN_FILES} f ON f.library_id = x.library_id AND f.path = m.target || substr(x.path, length(b.path) + 1) WHERE x.library_id = b.library_id AND starts_with(x.path, b.path || '/')) AS holds FROM {BINS} b LEFT JOIN m USING (library_id)),
w AS (SELECT *, CASE WHEN n IS NULL OR (n = 1 AND same) THEN 'kept' WHEN n > 1 OR contains(target, '/') THEN 'ambiguous' WHEN holds THEN 'renamed' ELSE 'stranger' END AS became FROM j)
SELECT library_id, path, became, CASE WHEN became = 'renamed' THEN target END AS target FROM w""")
def renamed_bins(t):
    n = t.nation.select(F.col("n_nationkey").alias("library_id"), F.lower("n_name").alias("name"), (F.col("n_nationkey") % 4).alias("dev"), F.when(F.col("n_nationkey") % 11 == 4, 0).otherwise(7).alias("ino"))
    bins = n.select("library_id", F.lit("bin").alias("path"), "dev", "ino")
    dirs = n.filter("library_id % 6 > 0").select("library_id", F.when(F.col("library_id") % 5 == 0, "bin").when(F.col("library_id") % 8 == 3, F.concat(F.lit("deep/"), "name")).otherwise(F.col("name")).alias("path"), "dev", "ino")
    dirs = dirs.unionByName(n.filter("library_id % 7 = 0").select("library_id", F.lit("copy").alias("path"), "dev", "ino"))
    c = t.customer.select(F.col("c_nationkey").alias("library_id"), "c_custkey", "c_name")
    binned = c.filter("c_custkey % 10 = 0").select("library_id", F.concat(F.lit("bin/"), "c_name").alias("path"))
    files = c.filter("c_custkey % 20 = 0 AND library_id % 3 > 0").join(n, "library_id").select("library_id", F.concat_ws("/", "name", "c_name").alias("path"))
    return scan.bin_by_identity(dirs, bins, files, binned)


@query(f"SELECT c_custkey AS id, path AS old_path, 'bin/' || path AS new_path FROM {PATHS} WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def crossings_by_path(t):
    c = customer_paths(t)
    added = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("bin/"), "path").alias("path"))
    return scan.pair_by_path(added, c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), "path"), "bin")[0]


@query(f"SELECT 'bin/' || path AS path FROM {PATHS} WHERE c_custkey % 3 > 0 AND c_custkey % 2 = 0")
def additions_without_crossings(t):
    c = customer_paths(t)
    added = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("bin/"), "path").alias("path"))
    return scan.pair_by_path(added, c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), "path"), "bin")[1]


@query(f"WITH s AS (SELECT c_custkey AS id, path AS was_at FROM {PATHS} WHERE c_custkey % 7 = 0) SELECT 'row' AS side, CAST(c_custkey AS VARCHAR) AS what FROM {PATHS} WHERE c_custkey NOT IN (SELECT id FROM s) UNION ALL SELECT 'file', path FROM {PATHS} WHERE c_custkey % 2 = 0 AND path NOT IN (SELECT was_at FROM s)")
def held_back_moves(t):
    c = customer_paths(t)
    stalled = c.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"), F.col("path").alias("was_at"))
    rows, files = scan.without_stalled(c.select(F.col("c_custkey").alias("id")), c.filter("c_custkey % 2 = 0").select("path"), stalled)
    return rows.select(F.lit("row").alias("side"), F.col("id").cast("string").alias("what")).unionByName(files.select(F.lit("file").alias("side"), F.col("path").alias("what")))


@query(f"SELECT c_custkey FROM {PATHS} WHERE starts_with(path, 'asia/nation_2/') OR path = 'europe/x' OR c_custkey % 50 = 0")
def scope_of_a_scan(t):
    changed = t.spark.createDataFrame([("asia/nation_2",), ("europe/x",)], "path string")
    return scan.in_scope_of(customer_paths(t), changed, F.col("c_custkey") % 50 == 0).select("c_custkey")


GENERATED = "(SELECT 'renditions/' || CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.avif.part' ELSE '.avif' END AS path, epoch(o_orderdate)::BIGINT AS modified, o_custkey AS bytes, 'draft_' || o_custkey AS draft FROM orders)"


def generated(t):
    end = F.when(F.col("o_orderkey") % 4 == 0, ".jpg").when(F.col("o_orderkey") % 4 == 1, ".avif.part").otherwise(".avif")
    return t.orders.select(
        F.concat(F.lit("renditions/"), F.col("o_orderkey").cast("string"), end).alias("path"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("modified"), F.col("o_custkey").alias("bytes"),
        F.concat(F.lit("draft_"), F.col("o_custkey").cast("string")).alias("draft"),
    )


@query(f"SELECT path, bytes FROM {GENERATED} WHERE NOT (path LIKE '%.avif' AND EXISTS (SELECT 1 FROM customer WHERE 'renditions/' || c_custkey || '.avif' = path)) AND NOT (path LIKE '%.part' AND 900000000 - modified < 20000000)")
def orphaned_files(t):
    return scan.orphans(generated(t), t.customer.select(F.col("c_custkey").alias("id")), ".avif", ".part", F.lit(900_000_000), 20_000_000)


@query(f"SELECT draft, sum(bytes)::BIGINT AS bytes FROM {GENERATED} WHERE bytes % 8 = 0 GROUP BY 1 HAVING 1000000000 - max(modified) > 30000000")
def stale_drafts(t):
    files = generated(t).filter("bytes % 8 = 0").select(F.concat_ws("/", F.lit("drafts"), "draft", "path").alias("path"), "modified", "bytes")
    return scan.stale_drafts(files, "drafts", F.lit(1_000_000_000), 30_000_000)


FRAMES = "(SELECT l_orderkey AS merge, l_partkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 5 = 0 THEN l_suppkey % 3 ELSE 1 END AS stack, CASE l_orderkey % 4 WHEN 0 THEN 'auto' ELSE 'bracket' END AS origin, CASE l_orderkey % 3 WHEN 0 THEN 'pixelShift' WHEN 1 THEN CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 2 THEN NULL ELSE 'exposure' END ELSE 'focus' END AS kind, CASE WHEN l_orderkey % 2 = 0 OR l_linenumber > 1 THEN 9 - l_linenumber END AS idx, l_shipdate AS taken FROM lineitem)"


@query(f"""WITH m AS (SELECT merge, count(*) AS n, count(DISTINCT stack) AS stacks, bool_and(origin = 'bracket') AS brackets, count(DISTINCT kind) AS kinds, count(kind) AS known, min(kind) AS kind,
  CASE WHEN count(idx) = count(*) THEN string_agg(id::VARCHAR, ',' ORDER BY idx, id) ELSE string_agg(id::VARCHAR, ',' ORDER BY taken, id) END AS ids FROM {FRAMES} GROUP BY 1),
p AS (SELECT *, CASE WHEN stacks <> 1 OR NOT brackets THEN 'not one bracket stack' WHEN kinds <> 1 OR known <> n THEN 'not one capture' WHEN kind = 'pixelShift' AND n <> 4 THEN 'not all frames of a pixel shift' END AS problem FROM m)
SELECT merge, problem, CASE WHEN problem IS NULL THEN kind END AS kind, CASE WHEN problem IS NULL THEN ids END AS ids FROM p""")
def bracket_merges(t):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when(key % 3 == 0, "pixelShift").when(key % 3 == 1, F.when((key % 7 == 0) & (line == 2), F.lit(None)).otherwise("exposure")).otherwise("focus")
    frames = t.lineitem.select(
        key.alias("merge"), (F.col("l_partkey") * 10 + line).alias("id"), F.when(key % 5 == 0, F.col("l_suppkey") % 3).otherwise(1).alias("stack"), F.when(key % 4 == 0, "auto").otherwise("bracket").alias("origin"),
        kind.alias("kind"), F.when((key % 2 == 0) | (line > 1), 9 - line).alias("index"), F.col("l_shipdate").alias("taken"),
    )
    return scan.bracket_orders(frames, 4).withColumn("ids", F.array_join("ids", ","))


# sessions

DOCS = "(SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 9 > 0 THEN 's' || (o_custkey % {0}) END AS session, strftime(o_orderdate, '%Y%m%d') AS stamp, 's' || (o_custkey % 4) AS on_session, strftime(o_orderdate, '%Y') || '0701' AS on_stamp, o_orderpriority AS doc FROM orders WHERE {1})"


def docs(t, sessions_, where, shift):
    date = F.date_add("o_orderdate", shift)
    on = F.array(F.struct(F.concat(F.lit("s"), (F.col("o_custkey") % 4).cast("string")).alias("session"), F.concat(F.date_format(date, "yyyy"), F.lit("0701")).alias("stamp")))
    session = F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.lit("s"), (F.col("o_custkey") % sessions_).cast("string")))
    return t.orders.filter(where).select(F.col("o_orderkey").alias("photo_id"), session.alias("session"), F.date_format(date, "yyyyMMdd").alias("stamp"), on.alias("chain"), F.col("o_orderpriority").alias("doc"))


@query(f"""WITH a AS {DOCS.format(3, 'o_orderkey % 2 = 0')}, b AS {DOCS.format(5, 'TRUE').replace('o_orderdate', '(o_orderdate + INTERVAL 40 DAY)')},
j AS (SELECT a.photo_id, a.session AS s1, a.stamp AS t1, a.doc AS d1, b.session AS s2, b.stamp AS t2, b.doc AS d2,
  CASE WHEN a.session = b.session THEN b.stamp >= a.stamp ELSE b.on_session = a.session AND b.on_stamp >= a.stamp END AS one, CASE WHEN a.session = b.session THEN a.stamp >= b.stamp ELSE a.on_session = b.session AND a.on_stamp >= b.stamp END AS two
  FROM a JOIN b USING (photo_id) WHERE a.session IS NOT NULL AND b.session IS NOT NULL)
SELECT photo_id, s1 AS session, t1 AS stamp, d1 AS doc FROM j WHERE NOT one AND NOT two UNION SELECT photo_id, s2, t2, d2 FROM j WHERE NOT one AND NOT two""")
def parked_sessions(t):
    return sessions.parked(docs(t, 3, "o_orderkey % 2 = 0", 0), docs(t, 5, "true", 40))


@query(f"""WITH p AS (SELECT o_orderkey AS photo_id, strftime(o_orderdate, '%Y%m%d') || '00000000' || lpad((o_custkey % 5)::VARCHAR, 16, '0') AS stamp FROM orders WHERE o_orderkey % 3 = 0)
SELECT p.photo_id, p.stamp, o.o_orderpriority AS path, CASE WHEN right(stamp, 1) = '0' THEN 'this device' ELSE s.s_name END AS name FROM p JOIN orders o ON o.o_orderkey = p.photo_id LEFT JOIN supplier s ON lpad(s.s_suppkey::VARCHAR, 16, '0') = right(p.stamp, 16) AND s.s_suppkey < 4""")
def edit_conflicts(t):
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("00000000"), F.lpad((F.col("o_custkey") % 5).cast("string"), 16, "0"))
    parked = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("photo_id"), stamp.alias("stamp"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("library_id"), F.col("o_orderpriority").alias("path"))
    names = t.supplier.filter("s_suppkey < 4").select(F.lpad(F.col("s_suppkey").cast("string"), 16, "0").alias("peer"), F.col("s_name").alias("name"))
    return sessions.conflicts(parked, rows, names, "0" * 16).select("photo_id", "stamp", "path", "name")


ASKED = "(SELECT l_orderkey AS photo_id, l_linenumber % 3 AS rev, l_linenumber * 100000 + l_partkey * 10 + l_suppkey % 10 AS ord FROM lineitem)"
HELD = "(SELECT o_orderkey AS photo_id, o_custkey % 3 AS rev FROM orders WHERE o_orderkey % 4 > 0)"


@query(f"WITH j AS (SELECT a.*, coalesce(h.rev, 0) AS held FROM {ASKED} a LEFT JOIN {HELD} h USING (photo_id)) SELECT photo_id, rev, ord AS \"order\", held FROM j WHERE NOT (rev = held AND ord = coalesce((SELECT min(k.ord) FROM j k WHERE k.photo_id = j.photo_id AND k.rev = k.held), -1))")
def refused_revisions(t):
    changes = t.lineitem.select(F.col("l_orderkey").alias("photo_id"), (F.col("l_linenumber") % 3).alias("rev"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("order"))
    held = t.orders.filter("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("photo_id"), (F.col("o_custkey") % 3).alias("revision"))
    return sessions.at_revision(changes, held, "photo_id", "rev", "revision")[1]


RENDITIONS = "(SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 6 > 0 THEN lpad(CAST(o_custkey % 700 AS VARCHAR), 8, '0') END AS built_from FROM orders)"


def renditions(t):
    return t.orders.select(F.col("o_orderkey").alias("photo_id"), F.when(F.col("o_orderkey") % 6 > 0, F.lpad((F.col("o_custkey") % 700).cast("string"), 8, "0")).alias("built_from"))


@query(f"SELECT r.photo_id, CASE WHEN r.built_from >= e.stamp THEN '99999999' ELSE r.built_from END AS built_from FROM {RENDITIONS} r LEFT JOIN {EDITS} e USING (photo_id)")
def restamped_renditions(t):
    return sessions.restamp_renditions(renditions(t), edits(t), F.lit("99999999"))


@query("SELECT o_orderkey, '99999999' AS stamp_a, '99999999' AS stamp_b FROM orders")
def restamped_catalogue(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("stamp_a"), F.col("o_orderpriority").alias("stamp_b"))
    return sessions.restamp(rows, ["stamp_a", "stamp_b"], F.lit("99999999"))


@query(f"""WITH b AS (SELECT composed_id AS r, photo_id FROM {SOURCES} UNION SELECT photo_id, photo_id FROM {EDITS}),
p AS (SELECT o_orderkey AS photo_id, '00000' || lpad(CAST(o_custkey % 997 AS VARCHAR), 3, '0') AS stamp FROM orders WHERE o_orderkey % 3 = 0),
s AS (SELECT b.r AS photo_id, max(e.stamp) AS now, max(CASE WHEN e.photo_id % 5 = 0 THEN '00000' || right(e.stamp, 3) ELSE e.stamp END) AS was, bool_or(e.photo_id % 5 = 0) AS touched FROM b JOIN {EDITS} e USING (photo_id) GROUP BY 1),
q AS (SELECT s.photo_id, touched, greatest(now, p.stamp) AS now, greatest(was, p.stamp) AS was FROM s LEFT JOIN p ON p.photo_id = s.photo_id AND s.photo_id IN (SELECT composed_id FROM {SOURCES})),
r AS (SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 2 = 0 THEN '00000' || lpad(CAST(o_orderkey % 997 AS VARCHAR), 3, '0') ELSE '00000' || lpad(CAST(o_custkey % 997 AS VARCHAR), 3, '0') END AS built_from, CASE WHEN o_orderkey % 7 > 0 THEN 1 END AS built_at FROM orders)
SELECT r.photo_id, CASE WHEN q.touched AND built_at IS NOT NULL AND r.built_from = q.was THEN q.now ELSE r.built_from END AS built_from FROM r LEFT JOIN q USING (photo_id)""")
def vouched_renditions(t):
    e = edits(t)
    vouched = e.filter("photo_id % 5 = 0").select("photo_id", F.concat(F.lit("00000"), F.substring("stamp", -3, 3)).alias("stamp"))
    three = lambda c: F.concat(F.lit("00000"), F.lpad((F.col(c) % 997).cast("string"), 3, "0"))
    built = t.orders.select(F.col("o_orderkey").alias("photo_id"), F.when(F.col("o_orderkey") % 2 == 0, three("o_orderkey")).otherwise(three("o_custkey")).alias("built_from"), F.when(F.col("o_orderkey") % 7 > 0, 1).alias("built_at"))
    placements = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("photo_id"), three("o_custkey").alias("stamp"))
    return sessions.vouch(built, vouched, sources(t), e, placements).select("photo_id", "built_from")


@query("SELECT user_id, event_type, arg_max(value, (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END, ts, event_id)) AS value, bool_or(event_id % 3 = 0) AS by_user FROM events GROUP BY 1, 2")
def user_edits_outrank_automatic_ones(t):
    return changes.merge_edits(t.events.withColumn("by_user", F.col("event_id") % 3 == 0), ["user_id", "event_type"], "by_user", ["ts", "event_id"], "value")


PAGES = "(SELECT user_id % 20 AS origin, user_id AS page, epoch_ms(min(ts)) AS first, epoch_ms(max(ts)) AS last FROM events GROUP BY ALL)"


@query(f"""WITH h AS (SELECT origin, min(last) AS held, median(first)::BIGINT // 1000 * 1000 AS expected FROM {PAGES} WHERE origin % 4 > 0 GROUP BY 1)
SELECT page, CASE WHEN last > 1706000000000 + 3600000 THEN 'reject' WHEN last <= coalesce(h.held, -1) THEN 'old' WHEN first > h.expected THEN 'wait' ELSE 'apply' END AS verdict FROM {PAGES} p LEFT JOIN h USING (origin)""")
def verdicts_on_pages(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    pages = t.events.groupBy((F.col("user_id") % 20).alias("origin"), F.col("user_id").alias("page")).agg(F.min(ms).alias("first"), F.max(ms).alias("last"))
    held = pages.filter("origin % 4 > 0").groupBy("origin").agg(F.min("last").alias("held"), (F.floor(F.percentile("first", F.lit(0.5)).cast("long") / 1000) * 1000).alias("expected"))
    return changes.page_verdicts(pages, held, "origin", "first", "last", F.lit(1_706_000_000_000), F.lit(3_600_000)).select("page", "verdict")


ARRIVALS = "(SELECT c_nationkey AS library_id, c_custkey AS id, 'f' || (c_custkey % 40) AS path, 'f' || (c_custkey % 60 + 20) AS was, c_custkey % 7 AS stamp FROM customer WHERE c_custkey % 3 = 0)"
HOLDERS = "(SELECT c_nationkey AS library_id, 10000 - c_custkey AS id, 'f' || (c_custkey % 40) || CASE c_custkey % 5 WHEN 0 THEN '_2' WHEN 1 THEN '_3' ELSE '' END AS path, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 7 END AS stamp FROM customer WHERE c_custkey % 3 = 1)"


@query(f"""WITH h AS {HOLDERS}, m AS (SELECT a.*, h.id AS held_by, h.stamp AS held, h.stamp IS NOT NULL AND (h.stamp < a.stamp OR (h.stamp = a.stamp AND h.id < a.id)) AS arriving FROM {ARRIVALS} a JOIN h USING (library_id, path) WHERE a.id <> h.id),
g AS (SELECT *, (SELECT min(k) FROM range(2, 9) r(k) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.library_id = m.library_id AND h.path = m.path || '_' || k)) AS free, EXISTS (SELECT 1 FROM h WHERE h.library_id = m.library_id AND h.path = m.was) AS taken FROM m)
SELECT library_id, path, CASE WHEN arriving THEN id ELSE held_by END AS loser, CASE WHEN arriving THEN 'arriving' ELSE 'holder' END AS side, CASE WHEN arriving AND was IS NOT NULL AND NOT taken AND was <> path THEN was ELSE path || '_' || free END AS given FROM g""")
def contested_folders(t):
    c = t.customer.select(F.col("c_nationkey").alias("library_id"), "c_custkey")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"))
    key = F.col("c_custkey")
    arrivals = c.filter("c_custkey % 3 = 0").select("library_id", key.alias("id"), name(key % 40).alias("path"), name(key % 60 + 20).alias("was"), (key % 7).alias("stamp"))
    suffix = F.when(key % 5 == 0, "_2").when(key % 5 == 1, "_3").otherwise("")
    holders = c.filter("c_custkey % 3 = 1").select("library_id", (10_000 - key).alias("id"), F.concat(name(key % 40), suffix).alias("path"), F.when(key % 4 > 0, key % 7).alias("stamp"))
    return changes.folder_claims(arrivals, holders)


# checks and geometry

@query(r"SELECT c_custkey, CASE WHEN regexp_full_match(o, '[+-][0-9]{2}:[0-9]{2}') THEN (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END * (o[2:3]::INT * 60 + o[5:6]::INT)) END AS minutes FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+0' || (c_custkey % 10) || ':30' WHEN 1 THEN '-11:0' || (c_custkey % 10) WHEN 2 THEN '      ' ELSE '+1:00' END AS o FROM customer)")
def clock_offsets(t):
    digit = (F.col("c_custkey") % 10).cast("string")
    o = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("+0"), digit, F.lit(":30"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("-11:0"), digit)).when(F.col("c_custkey") % 4 == 2, "      ").otherwise("+1:00")
    return t.customer.select("c_custkey", validity.offset_minutes(o).alias("minutes"))


@query(r"""SELECT c_custkey, NOT contains(p, '\') AND NOT starts_with(p, '/') AND NOT regexp_matches(p, '^[A-Za-z]:') AND NOT list_has_any(string_split(p, '/'), ['', '.', '..']) AS path_ok, NOT contains(n, '/') AND n NOT IN ('', '.', '..') AS name_ok
FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '/' || path WHEN 1 THEN 'C:' || path WHEN 2 THEN replace(path, '/', '\') WHEN 3 THEN path || '/../x' WHEN 4 THEN path || '//x' ELSE path END AS p, CASE c_custkey % 4 WHEN 0 THEN '..' WHEN 1 THEN path WHEN 2 THEN '' ELSE 'Bin' END AS n FROM """ + PATHS + ")")
def paths_from_outside(t):
    case, path = F.col("c_custkey") % 6, F.col("path")
    p = F.when(case == 0, F.concat(F.lit("/"), path)).when(case == 1, F.concat(F.lit("C:"), path)).when(case == 2, F.replace(path, F.lit("/"), F.lit("\\"))).when(case == 3, F.concat(path, F.lit("/../x"))).when(case == 4, F.concat(path, F.lit("//x"))).otherwise(path)
    four = F.col("c_custkey") % 4
    n = F.when(four == 0, "..").when(four == 1, path).when(four == 2, "").otherwise("Bin")
    return customer_paths(t).select("c_custkey", validity.is_replicated_path(p).alias("path_ok"), validity.is_bin_name(n).alias("name_ok"))


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'rectilinear' WHEN 1 THEN 'cylindrical' ELSE 'equirectangular' END AS k, (p_size - 25) * 0.02 AS u, (p_partkey % 100 - 50) * 0.01 AS v FROM part),
r AS (SELECT *, CASE k WHEN 'rectilinear' THEN u WHEN 'cylindrical' THEN sin(u) ELSE sin(u) * cos(v) END AS x, CASE k WHEN 'equirectangular' THEN sin(v) ELSE v END AS y, CASE k WHEN 'rectilinear' THEN 1.0::DOUBLE WHEN 'cylindrical' THEN cos(u) ELSE cos(u) * cos(v) END AS z FROM p)
SELECT p_partkey, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(25 + u / 0.02, 4) AS back_x, round(50 + v / 0.02, 4) AS back_y, round(100 + 50 * y / z, 4) AS source_y FROM r""")
def canvas_rays(t):
    k = F.when(F.col("p_size") % 3 == 0, "rectilinear").when(F.col("p_size") % 3 == 1, "cylindrical").otherwise("equirectangular")
    step, cx, cy = F.lit(0.02), F.lit(25.0), F.lit(50.0)
    ray = geometry.canvas_to_ray(k, F.col("p_size").cast("double"), cy + (F.col("p_partkey") % 100 - 50) / 2, cx, cy, step)
    back = geometry.ray_to_canvas(k, ray, cx, cy, step)
    still = F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    seen = geometry.ray_to_source(still, F.lit(50.0), F.lit(300.0), F.lit(200.0), ray)
    rounded = {"x": ray[0], "y": ray[1], "z": ray[2]}
    return t.part.select("p_partkey", *(F.round(c, 6).alias(n) for n, c in rounded.items()), F.round(back[0], 4).alias("back_x"), F.round(back[1], 4).alias("back_y"), F.round(seen[1], 4).alias("source_y"))


@query("""WITH k AS (SELECT p_partkey, 1600 + p_size * 400.0 AS t FROM part), x AS (SELECT *, CASE WHEN t <= 4000 THEN -0.2661239e9 / t**3 - 0.2343589e6 / t**2 + 0.8776956e3 / t + 0.179910 ELSE -3.0258469e9 / t**3 + 2.1070379e6 / t**2 + 0.2226347e3 / t + 0.240390 END AS x FROM k),
y AS (SELECT *, CASE WHEN t <= 2222 THEN -1.1063814 * x**3 - 1.34811020 * x**2 + 2.18555832 * x - 0.20219683 WHEN t <= 4000 THEN -0.9549476 * x**3 - 1.37418593 * x**2 + 2.09137015 * x - 0.16748867 ELSE 3.0817580 * x**3 - 5.87338670 * x**2 + 3.75112997 * x - 0.37001483 END AS y FROM x)
SELECT p_partkey, round(x, 5) AS x, round(y, 5) AS y, round(449 * ((x - 0.3320) / (0.1858 - y))**3 + 3525 * ((x - 0.3320) / (0.1858 - y))**2 + 6823.3 * ((x - 0.3320) / (0.1858 - y)) + 5520.33, 2) AS kelvin FROM y WHERE t BETWEEN 1667 AND 25000""")
def illuminants(t):
    xy = geometry.planckian_xy(1600 + F.col("p_size") * 400.0)
    rows = t.part.select("p_partkey", xy.alias("xy")).filter("xy IS NOT NULL")
    return rows.select("p_partkey", F.round(F.col("xy")[0], 5).alias("x"), F.round(F.col("xy")[1], 5).alias("y"), F.round(geometry.temperature_of(F.col("xy")[0], F.col("xy")[1]), 2).alias("kelvin"))


@query("""WITH m AS (SELECT s_suppkey, s_suppkey % 7 + 1.0::DOUBLE AS a, s_nationkey % 5 + 0.5::DOUBLE AS b, 3.0::DOUBLE AS d FROM supplier)
SELECT s_suppkey, round(1 / a, 6) AS i0, round(-b / (a * d), 6) AS i1, round(1 / d, 6) AS i4 FROM m""")
def inverse_matrices(t):
    a, b, zero = F.col("s_suppkey") % 7 + 1.0, F.col("s_nationkey") % 5 + 0.5, F.lit(0.0)
    inverse = geometry.inverse3(F.array(a, b, zero, zero, F.lit(3.0), zero, zero, zero, F.lit(1.0)))
    return t.supplier.select("s_suppkey", F.round(inverse[0], 6).alias("i0"), F.round(inverse[1], 6).alias("i1"), F.round(inverse[4], 6).alias("i4"))


# scans that read little, sidecars, feeds and marks

@query(f"SELECT c_custkey FROM {PATHS} JOIN customer USING (c_custkey) WHERE NOT (c_custkey % 3 > 0 AND (CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 5 END) = 5)")
def files_to_hash(t):
    files = customer_paths(t).select("c_custkey", "path", F.lit(5).alias("modified"), F.lit(None).cast("long").alias("size"))
    known = files.filter("c_custkey % 3 > 0").select("path", F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(5).alias("modified"), "size")
    return changes.to_hash(files, known, "path", "modified", "size").select("c_custkey")


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS rating, NULL::VARCHAR AS label FROM part")
def sidecar_fields(t):
    xml = sidecar.document({"dc:title": F.col("p_name"), "xmp:Rating": F.when(F.col("p_size") % 2 == 0, F.col("p_size"))})
    found = sidecar.fields(xml, {"title": "dc:title", "rating": "xmp:Rating", "label": "xmp:Label"})
    return t.part.select("p_partkey", found.alias("f")).select("p_partkey", "f.*")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'picked' ELSE o_orderstatus END AS mark, CASE WHEN o_custkey % 5 = 0 AND o_orderstatus <> 'picked' THEN 'new' ELSE 'old' END AS stamp FROM orders")
def marked_rows(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("stack"), F.col("o_orderstatus").alias("mark"), F.lit("old").alias("stamp"))
    chosen = t.customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("stack"))
    return changes.set_fields(rows, chosen, "stack", {"mark": F.lit("picked")}, "stamp", F.lit("new")).select("o_orderkey", "mark", "stamp")


@query("WITH p AS (SELECT event_id, user_id FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 300) SELECT p.event_id, p.user_id, c.c_name FROM p LEFT JOIN customer c ON c.c_custkey = p.user_id")
def feed_page_with_rows(t):
    log = t.events.select("event_id", "user_id")
    return changes.page_of_rows(log, t.customer.select(F.col("c_custkey").cast("long").alias("user_id"), "c_name"), ["user_id"], ["event_id"], (1000,), 300)


@query("SELECT user_id, event_id, CASE WHEN event_id <= user_id * 40 THEN 'done' ELSE 'redo' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 20")
def steps_to_undo_and_redo(t):
    return changes.undo_history(t.events.select("user_id", "event_id", (F.col("user_id") * 40).alias("cursor")), "user_id", "event_id", "cursor", 20).select("user_id", "event_id", "state")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_shipdate, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 3")
def transfers_to_pick(t):
    """Of each device's queue the first three: pulls before pushes, then the oldest."""
    from pyspark.sql import Window

    from ..operators import ordering

    w = Window.partitionBy("l_suppkey").orderBy(ordering.ranked_by(F.col("l_returnflag"), ["R", "A"]), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return t.lineitem.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, json_type(props) AS kind, CASE WHEN json_type(a) = 'ARRAY' THEN json_array_length(a)::INT END AS n, CASE WHEN x IS NULL OR y IS NULL OR z IS NULL THEN NULL ELSE greatest(x, y, z) END AS most FROM (SELECT *, '[' || repeat('1,', (event_id % 4)::INT) || '2]' AS a, event_id % 5 AS x, nullif(user_id % 3, 0) AS y, floor(value)::BIGINT AS z FROM events)")
def json_kinds_and_strict_greatest(t):
    array = F.concat(F.lit("["), F.repeat(F.lit("1,"), (F.col("event_id") % 4).cast("int")), F.lit("2]"))
    kind = F.upper(F.regexp_extract(F.schema_of_variant(F.parse_json("props")), "^([A-Za-z]+)", 1))
    three = [F.col("event_id") % 5, F.nullif(F.col("user_id") % 3, F.lit(0)), F.floor("value")]
    none = three[0].isNull() | three[1].isNull() | three[2].isNull()
    return t.events.select("event_id", kind.alias("kind"), F.json_array_length(array).alias("n"), F.when(~none, F.greatest(*three)).alias("most"))


@query("SELECT l_suppkey, max(l_extendedprice) AS most, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1")
def row_of_the_maximum(t):
    """What a group's other columns are where one measure is largest."""
    return t.lineitem.groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("most"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("l_orderkey"))


@query("WITH j AS (SELECT o_orderkey, '[' || o_custkey || ',' || o_orderkey || ']' AS a FROM orders) SELECT o_orderkey, i::INT AS place, (a::JSON->>i)::BIGINT AS value FROM j, range(2) r(i)")
def json_array_items(t):
    array = F.from_json(F.concat(F.lit("["), "o_custkey", F.lit(","), "o_orderkey", F.lit("]")), "array<long>")
    return t.orders.select("o_orderkey", F.posexplode(array).alias("place", "value"))


# descriptors: an embedding's 64 values are the 8 by 8 pixels of a picture

PIXELS = "(SELECT vec_id, i % 8 AS x, i // 8 AS y, round(v * 1000) AS r FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings))"


def pixels(t):
    long = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v") * F.lit(1000).cast("float"))  # by a whole number it would be a double
    return long.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), *(F.round(F.col("v") + F.lit(k).cast("float")).alias(c) for k, c in enumerate("rgb")))


@query(f"""WITH v AS (SELECT * FROM (VALUES (0, 0, 8), (1, 1, 6)) AS w(vw, first, width)), c AS (SELECT vec_id, vw, ((y - first) * 4 // width) * 4 + (x - first) * 4 // width AS cell, avg(r) AS value FROM {PIXELS}, v WHERE x >= first AND x < first + width AND y >= first AND y < first + width GROUP BY ALL),
k AS (SELECT *, round(value * 10) AS q, rank() OVER (PARTITION BY vec_id, vw ORDER BY round(value * 10)) AS rk, count(*) OVER (PARTITION BY vec_id, vw, round(value * 10)) AS ties, count(*) OVER (PARTITION BY vec_id, vw) AS n FROM c)
SELECT vec_id, vw AS view, cell::INT AS cell, round((rk - 1 + (ties - 1) / 2) / (n - 1) * 255)::INT AS level FROM k""")
def descriptor_levels(t):
    cells = descriptor.cell_means(pixels(t), ["vec_id"], 8, 8, 4)
    return descriptor.levels(cells, ["vec_id", "view"], "r", 10.0).select("vec_id", "view", F.col("cell").cast("int").alias("cell"), "level")


@query()
def descriptor_similarity(t):
    """How alike each picture is to the one before it of its label."""
    found = descriptor.descriptors(pixels(t), ["vec_id"], 8, 8, 8)
    rows = t.embeddings.select("vec_id", "label").join(found, "vec_id")
    from pyspark.sql import Window

    before = F.lag("descriptor").over(Window.partitionBy("label").orderBy("vec_id"))
    return descriptor.similarity(rows.withColumn("before", before).filter("before IS NOT NULL"), "before", "descriptor", 8, 6).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query()
def descriptor_groups(t):
    """Runs of a label whose ids are at most 5 apart, cut into groups whose members are all alike."""
    found = t.embeddings.select("vec_id", "label").join(descriptor.descriptors(pixels(t), ["vec_id"], 8, 8, 8), "vec_id")
    runs = sequence.gap_runs(found, ["label"], F.col("vec_id"), ["vec_id"], 5)
    alike = lambda members, v: [descriptor.alike(m, v, 8, 6) for m in members]
    return similarity.clique_groups(runs, ["label", "run"], ["vec_id"], "descriptor", "vec_id", 0.2, alike).select("vec_id", "label", "clique")
