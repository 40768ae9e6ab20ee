"""Snapshots, upserts, merges, queues, clocks, scalar functions and change-log streams. An event is a change: its user the row, its type the unit, (ts, event_id) the stamp."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clock, paths
from ..operators import changes, graph
from ..sources import catalogue
from ..streaming import change_log
from .registry import query

STATE = "(SELECT user_id || '/' || event_type AS path, arg_max(value, (ts, event_id)) AS content FROM events WHERE {} GROUP BY 1)"
BEFORE, AFTER = STATE.format("ts < TIMESTAMP '2024-01-10' AND event_type <> 'signup'"), STATE.format("event_type <> 'error'")


def state(t, where):
    return t.events.filter(where).groupBy(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("content"))


def before(t):
    return state(t, "ts < TIMESTAMP_NTZ '2024-01-10' AND event_type <> 'signup'")


def after(t):
    return state(t, "event_type <> 'error'")


@query(f"SELECT path, CASE WHEN b.content IS NULL THEN 'added' WHEN a.content IS NULL THEN CASE WHEN b.gone THEN NULL ELSE 'removed' END WHEN b.gone THEN 'reappeared' WHEN a.content <> b.content THEN 'modified' END AS change FROM (SELECT *, path LIKE '%/view' AS gone FROM {BEFORE}) b FULL JOIN {AFTER} a USING (path) WHERE change IS NOT NULL")
def snapshot_diff(t):
    return changes.snapshot_diff(before(t).withColumn("gone", F.col("path").like("%/view")), after(t), "path", "content", "gone")


DOCS = "(SELECT '{0}/' || doc_id AS path, md5(text) AS h FROM documents WHERE {1})"


@query(f"WITH b AS {DOCS.format('a', 'source <> ' + chr(39) + 'src1' + chr(39))}, a AS (SELECT CASE WHEN lang = 'en' THEN 'a/' ELSE 'c/' END || doc_id AS path, md5(text) AS h FROM documents WHERE source <> 'src2'), g AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM b WHERE path NOT IN (SELECT path FROM a)), n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS k FROM a WHERE path NOT IN (SELECT path FROM b)) SELECT h, g.path AS from_id, n.path AS to_id FROM g JOIN n USING (h, k)")
def detected_moves(t):
    d = t.documents.withColumn("h", F.md5(F.col("text").cast("binary")))
    old = d.filter("source <> 'src1'").select(F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), "h")
    new = d.filter("source <> 'src2'").select(F.concat(F.when(F.col("lang") == "en", "a/").otherwise("c/"), F.col("doc_id").cast("string")).alias("path"), "h")
    return changes.detect_moves(old, new, "path", "h")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2")
def upsert_newest(t):
    rows = t.events.select("user_id", "event_type", "event_id", "ts")
    base = rows.filter("ts < TIMESTAMP_NTZ '2024-01-15'").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))
    return changes.upsert(base, rows.filter("ts >= TIMESTAMP_NTZ '2024-01-15'"), ["user_id", "event_type"], "ts")


@query("WITH b AS (SELECT c_nationkey AS k, min(c_custkey) AS v FROM customer WHERE c_nationkey < 10 GROUP BY 1) SELECT * FROM b UNION ALL SELECT s_nationkey, min(s_suppkey) FROM supplier WHERE s_nationkey NOT IN (SELECT k FROM b) GROUP BY 1")
def insert_missing(t):
    base = t.customer.filter("c_nationkey < 10").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("v"))
    return changes.insert_missing(base, t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v")), ["k"], "v")


@query("SELECT c_custkey, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def update_from_join(t):
    source = t.orders.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return changes.update_from(t.customer.select("c_custkey", "c_acctbal"), source, "c_custkey", "c_acctbal", "m")


DOOMED = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN ({DOOMED})")
def delete_cascade(t):
    doomed = t.orders.filter("o_orderstatus = 'P' AND o_totalprice > 200000")
    return changes.delete_cascade(t.orders, t.lineitem, doomed, "o_orderkey", "l_orderkey", F.lit("0"))[1].select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT o_orderkey, lpad(lower(to_hex(epoch_ms(o_orderdate))), 12, '0') || '0000local' AS stamp, TRUE AS deleted FROM orders WHERE o_orderkey IN ({DOOMED})")
def tombstones_of_delete(t):
    doomed = t.orders.filter("o_orderstatus = 'P' AND o_totalprice > 200000")
    stamp = clock.encode(F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.lit(0), F.lit("local"))
    return changes.delete_cascade(t.orders, t.lineitem, doomed, "o_orderkey", "l_orderkey", stamp)[2]


UNITS = "(SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max((ts, event_id)) AS s FROM events WHERE event_type <> 'error' GROUP BY 1, 2)"
TOMBS = "(SELECT user_id, max(ts) AS tomb FROM events WHERE event_type = 'error' AND value > 20 GROUP BY 1)"


def units(t):
    return changes.merge_units(t.events.filter("event_type <> 'error'"), ["user_id"], "event_type", ["ts", "event_id"], "value")


def tombs(t):
    return t.events.filter("event_type = 'error' AND value > 20").select("user_id", F.col("ts").alias("tomb_stamp"))


@query(f"SELECT user_id, event_type, value FROM {UNITS}")
def merge_units(t):
    return units(t).select("user_id", "event_type", "value")


@query(f"SELECT user_id, event_type, value FROM {UNITS} WHERE user_id NOT IN (SELECT user_id FROM {TOMBS})")
def merge_final_tombstones(t):
    return changes.apply_tombstones(units(t), tombs(t), ["user_id"], F.col("stamp.ts"), True).select("user_id", "event_type", "value")


@query(f"SELECT u.user_id, event_type, value FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY 1, 2) u LEFT JOIN {TOMBS} t ON u.user_id = t.user_id WHERE tomb IS NULL OR ts > tomb")
def merge_resurrectable(t):
    return changes.apply_tombstones(units(t), tombs(t), ["user_id"], F.col("stamp.ts"), False).select("user_id", "event_type", "value")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def deferred_rows(t):
    return changes.defer(t.orders, t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey")[1].select("o_orderkey")


@query("WITH d AS (SELECT event_type, min(event_id) AS f FROM events WHERE value > 60 GROUP BY 1) SELECT e.event_type, max(event_id) AS held FROM events e LEFT JOIN d USING (event_type) WHERE value <= 60 AND (f IS NULL OR event_id < f) GROUP BY 1")
def version_vector(t):
    return changes.version_vector(t.events.filter("value <= 60"), t.events.filter("value > 60"), "event_type", "event_id")


@query("WITH v AS (SELECT user_id AS peer, event_type AS origin, max(event_id) AS held FROM events GROUP BY 1, 2) SELECT event_id FROM events e WHERE value > 20 AND (SELECT count(DISTINCT peer) FROM v WHERE v.origin = e.event_type AND v.held >= e.event_id) = (SELECT count(DISTINCT peer) FROM v)")
def collectable_tombstones(t):
    vectors = t.events.groupBy(F.col("user_id").alias("peer"), F.col("event_type").alias("origin")).agg(F.max("event_id").alias("held"))
    stones = t.events.filter("value > 20").select("event_id", F.col("event_type").alias("origin"))
    return changes.collectable(stones, vectors, "origin", "event_id", "peer").select("event_id")


@query("SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '_' || rn END AS given FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS rn FROM part)")
def name_claims(t):
    return changes.claim_names(t.part, "p_name", "p_size", "p_partkey").select("p_partkey", "given")


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE b IS NULL OR o_orderdate > b")
def owed_work(t):
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return changes.owed(t.orders, done, "o_orderkey", "o_orderdate", "l_shipdate").select("o_orderkey")


@query("SELECT c_custkey, count(DISTINCT CASE WHEN l_orderkey IS NULL THEN o_orderkey END) AS lost, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) AS misplaced, count(DISTINCT o_orderkey) AS held FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def backup_sets(t):
    j = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.lineitem.select("l_orderkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy("c_custkey").agg(F.count_distinct(F.when(F.col("l_orderkey").isNull(), F.col("o_orderkey"))).alias("lost"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("o_orderkey"))).alias("misplaced"), F.count_distinct("o_orderkey").alias("held"))


STAMP = "lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') || lpad(lower(to_hex(event_id % 65536)), 4, '0') || 'peer' || user_id"


@query(f"SELECT event_id, {STAMP} AS stamp, epoch_us(ts) // 1000 AS ms, (event_id % 65536)::INT AS counter, 'peer' || user_id AS origin FROM events")
def clock_stamps(t):
    s = clock.encode(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 65536, F.concat(F.lit("peer"), F.col("user_id").cast("string")))
    return t.events.select("event_id", s.alias("stamp")).select("event_id", "stamp", clock.millis(F.col("stamp")).alias("ms"), clock.counter(F.col("stamp")).alias("counter"), clock.origin(F.col("stamp")).alias("origin"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS total FROM events GROUP BY 1")
def json_fields(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).cast("long").alias("total"))


@query("""SELECT event_id, '{"k":' || ((props->>'$.k')::INT + 1) || ',"kind":"' || event_type || '"}' AS props FROM events""")
def json_rewritten(t):
    k = F.get_json_object("props", "$.k").cast("int") + 1
    return t.events.select("event_id", F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind"))).alias("props"))


@query("SELECT item_id, pos, word FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark) WHERE length(word) > 3")
def unnested_sources(t):
    return t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).filter(F.length("word") > 3)


@query("SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, len(string_split(path, '/')) AS depth FROM (SELECT page_id, url AS path FROM pages)")
def path_parts(t):
    p = F.col("url")
    return t.pages.select("page_id", paths.folder(p).alias("folder"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"), paths.depth(p).alias("depth"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'rendered' WHEN 2 THEN 'rendered' END AS class FROM part")
def format_classes(t):
    name = F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in (".ARW", ".jpg", ".HEIC", ".txt", "")]), F.col("p_size") % 5 + 1))
    return t.part.select("p_partkey", paths.format_class(name).alias("class"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN c_mktsegment || ' ' || (2000 + c_nationkey) ELSE c_mktsegment END AS library FROM customer")
def library_names(t):
    root = F.when(F.col("c_nationkey") < 8, F.concat(F.lit("/photos/"), "c_mktsegment", F.lit("/"), (F.col("c_nationkey") + 2000).cast("string"))).otherwise(F.concat(F.lit("/photos/"), "c_mktsegment"))
    return t.customer.select("c_custkey", paths.library_name(root).alias("library"))


@query("SELECT c_custkey, CASE WHEN n = 'NATION_2' THEN 'moved' || substr(p, 9) ELSE p END AS path FROM (SELECT c_custkey, n_name AS n, n_name || '/' || c_custkey AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def rewritten_prefix(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", paths.moved(F.concat_ws("/", "n_name", F.col("c_custkey").cast("string")), "NATION_2", "moved").alias("path"))


@query("SELECT p_partkey, sha1('arw|' || p_size || '|' || p_partkey) AS hash FROM part")
def quick_hashes(t):
    return t.part.select("p_partkey", paths.quick_hash(F.concat("p_name", F.lit(".ARW")), F.col("p_size"), F.col("p_partkey")).alias("hash"))


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def content_hashes(t):
    return catalogue.content_hash(t.pages.select("page_id", F.col("html").cast("binary").alias("content"))).select("page_id", "sha256")


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN '.cache/' WHEN 1 THEN 'bin/' WHEN 2 THEN 'old/' ELSE 'keep/' END || c_custkey AS p FROM customer) WHERE starts_with(p, 'keep/')")
def scan_scope(t):
    p = F.concat(F.element_at(F.array(*[F.lit(x) for x in (".cache/", "bin/", "old/", "keep/")]), F.col("c_nationkey") % 4 + 1), F.col("c_custkey").cast("string"))
    return t.customer.withColumn("p", p).filter(paths.in_scope(F.col("p"), ["old"], "bin")).select("c_custkey")


@query("SELECT l_partkey, l_suppkey, arg_min(l_orderkey, (l_returnflag <> 'R', l_orderkey)) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def first_per_identity(t):
    rows = t.lineitem.withColumn("known", F.col("l_returnflag") == "R")
    return catalogue.first_per_identity(rows, ["l_partkey", "l_suppkey"], "known", "l_orderkey").select("l_partkey", "l_suppkey", "l_orderkey")


@query("SELECT event_id, user_id FROM events WHERE (user_id, event_id) > (20, 300) ORDER BY user_id, event_id LIMIT 500")
def change_feed_page(t):
    return catalogue.feed_page(t.events, ["user_id", "event_id"], (20, 300)).select("event_id", "user_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events) WHERE rn > 7")
def snapshots_to_drop(t):
    return catalogue.snapshots_to_drop(t.events, "event_type", "ts", 7).select("event_id")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 512")
def replay_tail(t):
    return change_log.tail(t.events, "event_id").select("event_id")


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, o_orderdate::DATE + 1 AS next_day, nullif(o_orderstatus, 'P') AS triage, greatest(o_custkey, o_orderkey) AS larger, o_orderpriority BETWEEN '1' AND '3' AS urgent, rtrim(o_orderpriority, 'HIGH') AS trimmed, replace(o_orderpriority, '-', ':') AS replaced FROM orders")
def scalar_functions(t):
    d = F.col("o_orderdate").cast("timestamp")
    return t.orders.select(
        "o_orderkey", F.unix_timestamp(d).alias("seconds"), F.date_add(d, 1).alias("next_day"), F.expr("nullif(o_orderstatus, 'P')").alias("triage"), F.greatest("o_custkey", "o_orderkey").alias("larger"),
        F.col("o_orderpriority").between("1", "3").alias("urgent"), F.rtrim(F.col("o_orderpriority"), F.lit("HIGH")).alias("trimmed"), F.replace("o_orderpriority", F.lit("-"), F.lit(":")).alias("replaced"),
    )


@query("SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def streamed_merge(t):
    folder = f"{graph.shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    t.events.repartition(3, "user_id").write.parquet(f"{folder}/log")
    stream = change_log.read_log(t.spark, f"{folder}/log", t.events.schema, 1)
    table = change_log.MergedTable(f"{folder}/table", ["user_id", "event_type"], "ts")
    run = table.start(stream, f"{folder}/progress")
    run.awaitTermination()
    last = max(p.batchId for p in run.recentProgress if p.numInputRows)
    out = graph.checkpointed(table.read(t.spark, last).select("user_id", "event_type", "event_id", "value", "ts"))
    graph.remove_folder(t.spark, folder)
    return out


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, user_id, arg_max(event_type, ts) AS event_type, count(*) AS n FROM events GROUP BY 1, 2")
def coalesced_events(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return change_log.coalesce_events(e, ["user_id"], "ts", "1 hour", "event_type")


@query("WITH e AS (SELECT event_id, user_id, props AS old, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new FROM events) SELECT event_id, CASE WHEN new IS NULL THEN 'removed' WHEN (old->>'$.k') <> (new->>'$.k') THEN 'changed' END AS what FROM e WHERE what IS NOT NULL")
def document_differences(t):
    from pyspark.sql import Window

    from ..operators import documents

    e = t.events.withColumn("new", F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    d = e.withColumn("diff", documents.difference(F.col("props"), F.col("new"))).select("event_id", F.explode("diff").alias("field", "change"))
    return d.select("event_id", F.when(F.col("change.new").isNull(), "removed").otherwise("changed").alias("what"))


@query("WITH RECURSIVE e AS (SELECT c_custkey // 2 AS a, c_custkey AS b FROM customer WHERE c_acctbal > 0), r AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 9900 UNION SELECT b FROM r JOIN e ON e.a = r.node) SELECT node FROM r")
def reachable_below(t):
    edges = t.customer.filter("c_acctbal > 0").select(F.floor(F.col("c_custkey") / 2).alias("a"), F.col("c_custkey").alias("b"))
    return graph.reachable(edges, t.customer.filter("c_acctbal > 9900").select(F.col("c_custkey").alias("node")))


@query("SELECT sum(size)::BIGINT AS bytes, count(*) AS files FROM (SELECT l_partkey, l_suppkey, max(l_quantity)::BIGINT AS size FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)")
def storage_usage(t):
    files = t.lineitem.filter("l_returnflag <> 'N'").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").cast("long").alias("size"))
    return files.agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


@query("SELECT DISTINCT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages")
def distinct_folders(t):
    return t.pages.select(paths.folder(F.col("url")).alias("folder")).distinct()


@query("WITH a AS (SELECT user_id AS f, max(ts) AS m FROM events WHERE ts < TIMESTAMP '2024-01-12' GROUP BY 1), b AS (SELECT user_id AS f, max(ts) AS m FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT f FROM a FULL JOIN b USING (f) WHERE a.m IS DISTINCT FROM b.m")
def changed_folders(t):
    a = t.events.filter("ts < TIMESTAMP_NTZ '2024-01-12'").groupBy(F.col("user_id").alias("f")).agg(F.max("ts").alias("m"))
    b = t.events.filter("event_type <> 'view'").groupBy(F.col("user_id").alias("f")).agg(F.max("ts").alias("n"))
    return a.join(b, "f", "full").filter("NOT (m <=> n)").select("f")


@query("WITH w AS (SELECT p_brand AS label, row_number() OVER (ORDER BY p_brand) - 1 AS place FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 48)), h AS (SELECT p_brand AS label, row_number() OVER (ORDER BY p_brand) - 1 AS place FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 3)) SELECT label, CASE WHEN h.place IS NULL THEN 'insert' WHEN w.place IS NULL THEN 'delete' ELSE 'move' END AS action FROM w FULL JOIN h USING (label) WHERE w.place IS DISTINCT FROM h.place")
def reconciled_labels(t):
    from ..operators import ordering

    side = lambda where, name: ordering.positions(t.part.filter(where).select(F.col("p_brand").alias("label")).distinct(), ["label"], name, 4)
    j = side("p_size > 48", "want").join(side("p_size < 3", "have"), "label", "full").filter("NOT (want <=> have)")
    return j.select("label", F.when(F.col("have").isNull(), "insert").when(F.col("want").isNull(), "delete").otherwise("move").alias("action"))


@query("SELECT o_custkey, max((l_orderkey IS NULL)::INT)::BOOLEAN AS owes_any, count(DISTINCT CASE WHEN l_orderkey IS NULL THEN o_orderkey END) AS owed, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN o_orderkey END) AS again FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING owes_any")
def pending_work(t):
    j = t.orders.join(t.lineitem.select("l_orderkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    none = F.col("l_orderkey").isNull()
    out = j.groupBy("o_custkey").agg(F.bool_or(none).alias("owes_any"), F.count_distinct(F.when(none, F.col("o_orderkey"))).alias("owed"), F.count_distinct(F.when(F.col("l_returnflag") == "A", F.col("o_orderkey"))).alias("again"))
    return out.filter("owes_any")


@query("SELECT event_id, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 60000000 THEN ts ELSE prev END AS used FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)")
def touched_by_resolution(t):
    from pyspark.sql import Window

    prev = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    far = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp")) > 60_000_000
    return t.events.withColumn("prev", prev).select("event_id", F.when(F.col("prev").isNull() | far, F.col("ts")).otherwise(F.col("prev")).alias("used"))
