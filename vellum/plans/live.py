"""Trees, feeds, replicas, groups, views and snapshots as they run: each query derives its stream or folder from a table, in a folder of its own that it removes again."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import graph
from ..sources import feed, snapshots, tree
from ..streaming import change_log, debounce, groups, replica, views
from .registry import query


@contextmanager
def own_folder(t):
    folder = f"{graph.shared_folder(t.spark)}/live-{uuid.uuid4().hex}"
    yield folder
    graph.remove_folder(t.spark, folder)


@query("SELECT DISTINCT 'c_mktsegment=' || c_mktsegment || '/c_nationkey=' || c_nationkey AS path, TRUE AS complete FROM customer WHERE c_nationkey <> 3")
def tree_folders(t):
    with own_folder(t) as folder:
        t.customer.filter("c_nationkey < 15").write.partitionBy("c_mktsegment", "c_nationkey").parquet(folder)
        t.customer.filter("c_nationkey >= 15").write.mode("append").partitionBy("c_mktsegment", "c_nationkey").parquet(folder)
        out = tree.scan(t.spark, folder, tasks=8)
        deep = out.filter("kind = 'folder' AND path LIKE '%/%' AND path NOT LIKE '%/c_nationkey=3'").select("path")
        return deep.join(tree.is_complete(out))


@query("SELECT DISTINCT 'o_orderstatus=' || o_orderstatus || '/o_orderpriority=' || left(o_orderpriority, 1) AS path FROM orders WHERE o_orderstatus = 'F'")
def tree_below_a_prefix(t):
    with own_folder(t) as folder:
        t.orders.select("o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("o_orderpriority")).write.partitionBy("o_orderstatus", "o_orderpriority").parquet(folder)
        return tree.scan(t.spark, folder, prefix="o_orderstatus=F/", tasks=4).filter("kind = 'folder'").select("path")


@query("SELECT p_partkey FROM part WHERE p_size = 1")
def tree_removals(t):
    """Parts of one size are gone from the tree."""
    with own_folder(t) as folder:
        sized = t.part.select("p_partkey", F.col("p_size").alias("size"))
        sized.filter("size <> 1").write.partitionBy("size").parquet(folder)
        files = tree.scan(t.spark, folder).filter("kind = 'file'").select("kind", F.regexp_extract("path", "^size=(\\d+)/", 1).try_cast("int").alias("path"))
        return tree.removals(sized.withColumnRenamed("size", "path"), files).select("p_partkey")


LOG = "SELECT lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') || '0000' || lpad('p' || event_id % 3, 16, 'p') AS stamp, event_type, user_id, event_id FROM events"


def stamped(t):
    stamp = F.concat(F.lpad(F.lower(F.hex(F.unix_millis(F.col("ts").cast("timestamp")))), 12, "0"), F.lit("0000"), F.lpad(F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")), 16, "p"))
    return t.events.withColumn("stamp", stamp)


@query(f"SELECT stamp, event_type AS entity, user_id::VARCHAR AS row_id, event_id FROM ({LOG}) WHERE NOT (stamp[17:] = 'ppppppppppppppp1' AND stamp <= '018cc7200000000000000')")
def streamed_feed(t):
    """Every change but what the reader holds of one origin, by pages and micro-batches."""
    with own_folder(t) as folder:
        order = ["stamp", "entity", "row_id", "event_id"]
        log = stamped(t).select("stamp", F.col("event_type").alias("entity"), F.col("user_id").cast("string").alias("row_id"), "event_id")
        feed.append(log, f"{folder}/log", order, 4)
        rows = feed.read_feed(t.spark, f"{folder}/log", log.schema, order, page=1000, pages=1 << 20, held={"ppppppppppppppp1": "018cc7200000000000000"})
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
        return graph.checkpointed(t.spark.read.schema(log.schema).parquet(f"{folder}/out"))


REPLICA = f"""
WITH e AS (SELECT *, 'u' || user_id AS root FROM ({LOG}) WHERE NOT (event_type = 'signup' AND user_id % 5 = 0)),
u AS (SELECT root, event_type, max(stamp) AS stamp, arg_max(event_id, (stamp, event_id::VARCHAR))::VARCHAR AS value FROM e GROUP BY 1, 2),
h AS (SELECT root, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS shoot, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS click, max(CASE WHEN event_type = 'error' THEN stamp END) AS tomb FROM e GROUP BY 1)
SELECT root, CASE event_type WHEN 'signup' THEN 'shoot' WHEN 'view' THEN 'photo_label' ELSE 'photo' END AS kind, CASE event_type WHEN 'signup' THEN root WHEN 'error' THEN 'purchase' ELSE event_type END AS row_id,
  CASE event_type WHEN 'error' THEN 'deleted' ELSE 'all' END AS unit, stamp, CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND stamp <= tomb) THEN 'gone' WHEN event_type = 'signup' OR (shoot = 1 AND (event_type <> 'view' OR click = 1)) THEN 'applied' ELSE 'waiting' END AS status
FROM u JOIN h USING (root)"""


def replica_log(t):
    kind = F.when(F.col("event_type") == "signup", "shoot").when(F.col("event_type") == "view", "photo_label").otherwise("photo")
    row = F.when(F.col("event_type") == "signup", F.col("root")).when(F.col("event_type") == "error", "purchase").otherwise(F.col("event_type"))
    above = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") != "signup", "shoot")
    gone = F.col("event_type") == "error"
    log = stamped(t).filter("NOT (event_type = 'signup' AND user_id % 5 = 0)").withColumn("root", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return log.select(
        "root", kind.alias("kind"), row.alias("row_id"), above.alias("parent_kind"), F.when(above == "photo", "click").when(above == "shoot", F.col("root")).alias("parent_id"), F.when(~gone, "all").alias("unit"), "stamp",
        F.when(~gone, F.col("event_id").cast("string")).alias("value"), gone.alias("deleted"),
    )


KINDS = ["shoot", "photo", "photo_label"]


@query(REPLICA)
def replica_merged(t):
    return replica.merged(replica_log(t))


@query(REPLICA)
def replica_streamed(t):
    """The same from three micro-batches, the log's last third first."""
    with own_folder(t) as folder:
        log = graph.checkpointed(replica_log(t).withColumn("third", F.expr("pmod(xxhash64(stamp, row_id), 3)")))
        for third in (2, 0, 1):
            log.filter(F.col("third") == third).drop("third").coalesce(1).write.mode("append").parquet(f"{folder}/log")
        shown = replica.stream_merge(change_log.read_log(t.spark, f"{folder}/log", replica.LOG, 1), KINDS)
        table = change_log.MergedTable(f"{folder}/table", ["root", "kind", "row_id", "unit"], "seq", 8)
        table.start(shown, f"{folder}/progress").awaitTermination()
        return graph.checkpointed(table.read(t.spark, table.table.written(t.spark)[-1]).drop("seq"))


@query(f"WITH r AS ({REPLICA}), s AS (SELECT *, stamp[17:] AS origin FROM r), w AS (SELECT origin, min(stamp) AS first FROM s WHERE status = 'waiting' GROUP BY 1) SELECT origin, max(stamp) AS held FROM s LEFT JOIN w USING (origin) WHERE status <> 'waiting' AND (first IS NULL OR stamp < first) GROUP BY 1")
def replica_coverage(t):
    return replica.coverage(replica.merged(replica_log(t)))


@query("""
WITH e AS (SELECT event_type AS library, user_id, epoch_us(ts) // 1000 AS tick, lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY ts) AS was FROM events),
s AS (SELECT *, sum(CASE WHEN was IS NULL OR tick - was >= 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY library ORDER BY tick ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT library, max(tick) + 7200000 AS due, CASE WHEN count(DISTINCT user_id) > 3 THEN 'full' ELSE 'paths' END AS what,
  CASE WHEN count(DISTINCT user_id) > 3 THEN '' ELSE list_aggregate(list_sort(list(DISTINCT user_id::VARCHAR)), 'string_agg', ',') END AS paths FROM s GROUP BY library, run""")
def scan_requests(t):
    with own_folder(t) as folder:
        rows = t.events.select(F.col("event_type").alias("library"), F.col("ts").cast("timestamp").alias("at"), F.lit("path").alias("what"), F.col("user_id").cast("string").alias("path"))
        for year in sorted(r[0] for r in rows.filter("at IS NOT NULL").select(F.year("at")).distinct().collect()):  # many tasks write a year, in no order, which is less than events may be late
            rows.filter(F.year("at") == year).repartitionByRange("at").sortWithinPartitions("at").write.mode("append").option("maxRecordsPerFile", 20_000).parquet(f"{folder}/log")
        last = t.spark.sql("SELECT '' AS library, TIMESTAMP '2100-01-01' AS at, 'ok' AS what, '' AS path")
        last.write.mode("append").parquet(f"{folder}/log")
        out = debounce.scan_requests(change_log.read_log(t.spark, f"{folder}/log", rows.schema, 1000), 7_200_000, 3, late="400 days")
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
        return graph.checkpointed(t.spark.read.parquet(f"{folder}/out").select("library", "due", "what", F.array_join("paths", ",").alias("paths")))


@query("""
WITH l AS (SELECT c_custkey AS a, c_custkey + 7 AS b FROM customer WHERE c_acctbal > 1000 AND c_nationkey <> 5),
n AS (SELECT a AS node FROM l UNION SELECT b FROM l),
m AS (SELECT node, NOT EXISTS (SELECT 1 FROM l WHERE b = node) AS first FROM n)
SELECT node, max(CASE WHEN first THEN node END) OVER (PARTITION BY node % 7 ORDER BY node) AS component FROM m""")
def link_groups_by_batches(t):
    """Three batches: links of some rows, of the others, and the removal of one nation's."""
    with own_folder(t) as folder:
        table = groups.LinkGroups(folder, "long", 8)
        link = t.customer.filter("c_acctbal > 1000").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b"), F.col("c_nationkey"), F.lit(False).alias("removed"))
        for version, batch in enumerate((link.filter("c_nationkey < 15"), link.filter("c_nationkey >= 15"), link.filter("c_nationkey = 5").withColumn("removed", F.lit(True)))):
            table.apply(batch.select("a", "b", "removed"), version)
        return graph.checkpointed(table.groups(t.spark, 2))


@query("SELECT o_custkey AS k, o_orderstatus AS status, c_nationkey AS nation, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND c_acctbal > 0 GROUP BY ALL")
def join_view_by_deltas(t):
    """A view of orders with their customer: first all rows, then some go from either side."""
    with own_folder(t) as folder:
        view = views.JoinView(folder, "k long", "status string", "nation int", None, 8)
        orders = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.lit(1).cast("long").alias("n"))
        customers = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.lit(1).cast("long").alias("n"), "c_acctbal")
        view.apply(orders.filter("k % 2 = 0"), customers.drop("c_acctbal"), 0)
        view.apply(orders.filter("k % 2 = 1"), customers.filter("c_acctbal <= 0").drop("c_acctbal").withColumn("n", -F.col("n")), 1)
        view.apply(orders.filter("status = 'P'").withColumn("n", -F.col("n")), None, 2)
        return graph.checkpointed(view.read(t.spark, 2))


@query("SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0")
def published_snapshot(t):
    """The second version carries a table over; a later write that was never published isn't seen."""
    with own_folder(t) as folder:
        store = snapshots.Snapshots(t.spark, folder)
        store.save({"customer": t.customer, "nation": t.nation}, "daily")
        store.save({"customer": t.customer.filter("c_acctbal > 0")}, "daily", carry=True)
        store.write({"customer": t.customer.limit(1)})
        store.rotate({"daily": 1}, 0)
        customer, nation = (store.read(name) for name in ("customer", "nation"))
        return graph.checkpointed(customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_acctbal", "n_name"))
