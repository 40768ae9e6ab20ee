"""Joins, look-ups and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, lookup
from .registry import query


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def inner_join_chain(t):
    return t.orders.filter("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def left_join_filtered(t):
    return t.customer.join(t.orders.filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_join(t):
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def anti_join(t):
    return t.part.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("SELECT DISTINCT a.l_suppkey AS one, b.l_suppkey AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey")
def overlapping_pairs(t):
    keyed = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    other = keyed.withColumnRenamed("l_suppkey", "other")
    return keyed.join(other, ["l_orderkey", "l_partkey"]).filter("l_suppkey < other").select(F.col("l_suppkey").alias("one"), "other").distinct()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)")
def chosen_or_group(t):
    rows = t.lineitem.withColumn("row", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return lookup.chosen_or_group(rows, rows.filter("l_quantity = 50 AND l_discount > 0.09"), "row", "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT r.s_suppkey AS raw, f.s_suppkey AS file FROM supplier r JOIN supplier f ON r.s_nationkey = f.s_nationkey AND nullif(round(r.s_acctbal / 1000), 0) IS NOT DISTINCT FROM nullif(round(f.s_acctbal / 1000), 0) AND r.s_suppkey < f.s_suppkey")
def rule_link(t):
    side = lambda name: t.supplier.select("s_nationkey", F.expr("nullif(round(s_acctbal / 1000), 0)").alias(f"{name}_model"), F.col("s_suppkey").alias(name))
    return side("raw").join(side("file"), "s_nationkey").filter("raw_model <=> file_model AND raw < file").select("raw", "file")


@query("SELECT c_custkey, coalesce((SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey), -1) AS banner FROM customer")
def first_banner(t):
    first = lookup.first_of(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey", "banner")
    return t.customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("banner", F.lit(-1)).alias("banner"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counts_with_zero(t):
    return lookup.with_counts(t.customer, t.orders, "c_custkey", "o_custkey", "n").select("c_custkey", "n")


@query("WITH d AS (SELECT doc_id, md5(text) AS h, source = 'src0' AS gone FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY h, gone ORDER BY doc_id) AS k FROM d) SELECT a.h, a.doc_id AS from_id, b.doc_id AS to_id FROM n a JOIN n b ON a.h = b.h AND a.k = b.k AND a.gone AND NOT b.gone")
def multiset_pairs(t):
    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "source")
    return lookup.pair_multisets(d.filter("source = 'src0'"), d.filter("source <> 'src0'"), ["h"], ["doc_id"], ["doc_id"], "doc_id", "doc_id")


@query("WITH a AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, count(*) AS n, min(c_custkey) AS left_id FROM customer WHERE c_acctbal < 500 GROUP BY 1, 2), b AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, count(*) AS n, min(c_custkey) AS right_id FROM customer WHERE c_acctbal > 9500 GROUP BY 1, 2) SELECT nation, seg, left_id, right_id FROM a JOIN b USING (nation, seg) WHERE a.n = 1 AND b.n = 1")
def unique_matches(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    return lookup.unique_matches(c.filter("c_acctbal < 500"), c.filter("c_acctbal > 9500"), ["nation", "seg"], "c_custkey", "c_custkey")


MOVES = "(SELECT 'lib/' || n_name || '/' || c_mktsegment || '/' || c_custkey AS o, CASE WHEN c_nationkey < 5 THEN 'new/' || n_name || '/' || c_mktsegment || '/' || c_custkey WHEN c_acctbal > 3000 THEN 'away/' || c_custkey END AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH f AS (SELECT o, n, unnest([array_to_string(string_split(o, '/')[1:1], '/'), array_to_string(string_split(o, '/')[1:2], '/'), array_to_string(string_split(o, '/')[1:3], '/')]) AS folder FROM {MOVES}), t AS (SELECT folder, CASE WHEN ends_with(n, substr(o, length(folder) + 1)) THEN substr(n, 1, length(n) - length(o) + length(folder)) END AS target FROM f) SELECT folder, min(target) AS target, count(*) AS files FROM t GROUP BY folder HAVING count(*) = count(target) AND min(target) = max(target) AND folder <> min(target)")
def moved_folders(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    tail = F.concat_ws("/", "n_name", "c_mktsegment", F.col("c_custkey").cast("string"))
    new = F.when(F.col("c_nationkey") < 5, F.concat(F.lit("new/"), tail)).when(F.col("c_acctbal") > 3000, F.concat(F.lit("away/"), F.col("c_custkey").cast("string")))
    return lookup.moved_folders(c.select(F.concat(F.lit("lib/"), tail).alias("o"), new.alias("n")), "o", "n")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 10)")
def all_inputs_under(t):
    return lookup.all_under(t.lineitem, "l_orderkey", F.col("l_quantity") > 10)


@query("WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS items FROM lineitem GROUP BY 1), f AS (SELECT min(k) OVER (PARTITION BY items) AS a, k AS b FROM s) SELECT a, b FROM f WHERE a <> b")
def equal_sets(t):
    return lookup.same_sets(t.lineitem, "l_orderkey", "l_suppkey")


@query("SELECT o_custkey, count(*) AS members, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS done, count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END) AS kinds FROM orders GROUP BY 1")
def conditional_measures(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("members"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)).alias("done"), F.count_distinct(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))).alias("kinds"))


@query("SELECT l_suppkey, bool_or(l_returnflag = 'R') AS any_returned, max(l_shipdate) AS last, min(l_shipdate) AS first, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def group_flags(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.max("l_shipdate").alias("last"), F.min("l_shipdate").alias("first"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderstatus = 'F', o_orderkey)) AS winner FROM orders GROUP BY 1")
def composite_winner(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", F.col("o_orderstatus") == "F", "o_orderkey")).alias("winner"))


@query("SELECT o_custkey, coalesce(max(l_linenumber), -1) + 1 AS next FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def next_position(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(-1)) + 1).alias("next"))


@query("SELECT lower(p_name) AS folded, arg_max(p_partkey, (p_retailprice, p_partkey)) AS newest, count(*) AS n FROM part GROUP BY 1")
def case_folded_newest(t):
    return t.part.groupBy(F.lower("p_name").alias("folded")).agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("newest"), F.count("*").alias("n"))


@query("SELECT nation, max(balance) AS latest FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1")
def latest_over_union(t):
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))).groupBy("nation").agg(F.max("balance").alias("latest"))


@query("SELECT user_id, min(event_id) AS oldest, sum(value) AS bytes FROM events GROUP BY 1 ORDER BY max(ts) DESC, user_id LIMIT 40")
def groups_by_age(t):
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("oldest"), F.sum("value").alias("bytes"), F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id").limit(40).drop("last")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_pairs(t):
    return t.documents.select("lang", "source").distinct()


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_tax = 0")
def except_distinct(t):
    return t.part.select("p_partkey").subtract(t.lineitem.filter("l_tax = 0").select("l_partkey"))


@query("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect_distinct(t):
    return t.customer.filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.filter("s_acctbal > 5000").select("s_nationkey"))


EDGES = "(SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey // 2 AND a.c_mktsegment = b.c_mktsegment)"


def segment_edges(t):
    c = t.customer.select(F.col("c_custkey").alias("a"), "c_mktsegment", F.floor(F.col("c_custkey") / 2).alias("half"))
    return c.join(t.customer.select(F.col("c_custkey").alias("half"), F.col("c_mktsegment").alias("seg")), "half").filter("c_mktsegment = seg").select("a", F.col("half").alias("b"))


@query(f"WITH RECURSIVE e AS (SELECT a, b FROM {EDGES} UNION SELECT b, a FROM {EDGES}), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a) SELECT node, min(reach) AS component FROM r GROUP BY 1")
def connected_groups(t):
    return graph.connected_components(segment_edges(t))


@query(f"WITH RECURSIVE e AS (SELECT a, b FROM {EDGES} UNION SELECT b, a FROM {EDGES}), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a), g AS (SELECT node, min(reach) AS component FROM r GROUP BY 1) SELECT component, arg_max(node, (c_acctbal, node)) AS winner, count(*) AS members FROM g JOIN customer ON node = c_custkey GROUP BY 1")
def merged_group_winner(t):
    joined = graph.connected_components(segment_edges(t)).join(t.customer, F.col("node") == F.col("c_custkey"))
    return joined.groupBy("component").agg(F.max_by("node", F.struct("c_acctbal", "node")).alias("winner"), F.count("*").alias("members"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY 1, 2")
def pricing_summary(t):
    return t.lineitem.filter("l_shipdate <= DATE '2000-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
