"""Listings, filters, orderings and facets. An order is a catalogue entry: taken is its date (unknown while it is partial), its customer its stack."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import filters, listing, lookup, ordering, sequence
from .registry import query

TAKEN = "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END"
ENTRIES = f"(SELECT o_orderkey AS id, o_custkey AS stack, {TAKEN} AS taken, o_orderdate AS added, o_orderpriority AS rating, o_totalprice AS bytes, nullif(o_orderstatus, 'P') AS triage FROM orders)"


def entries(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stack"), F.expr(TAKEN).alias("taken"), F.col("o_orderdate").alias("added"),
        F.col("o_orderpriority").alias("rating"), F.col("o_totalprice").alias("bytes"), F.expr("nullif(o_orderstatus, 'P')").alias("triage"),
    )


@query(f"SELECT id, taken, bytes FROM {ENTRIES} WHERE bytes > 1000 AND (triage = 'F' OR rating = '1-URGENT') ORDER BY taken DESC NULLS LAST, id DESC LIMIT 100 OFFSET 100")
def listing_page(t):
    c = filters.Conditions([F.col("bytes") > 1000], [F.col("triage") == "F", F.col("rating") == "1-URGENT"], "any")
    return listing.list_rows(entries(t), c, ordering.order_by("taken_desc", "taken", "added", "id"), 100, 100).select("id", "taken", "bytes")


@query(f"SELECT id, taken FROM {ENTRIES} ORDER BY taken ASC NULLS LAST, id LIMIT 500 OFFSET 9800")
def listing_page_undated_last(t):
    return listing.list_rows(entries(t), filters.Conditions(), ordering.order_by("taken_asc", "taken", "added", "id"), 9800, 500).select("id", "taken")


@query(f"SELECT id, added FROM {ENTRIES} ORDER BY added DESC, id DESC LIMIT 100")
def listing_page_added(t):
    return listing.list_rows(entries(t), filters.Conditions(), ordering.order_by("added_desc", "taken", "added", "id")).select("id", "added")


@query(f"SELECT count(*) AS members, count(DISTINCT stack) + count(*) FILTER (stack IS NULL) AS entries FROM {ENTRIES} WHERE triage = 'F'")
def listing_totals(t):
    return listing.totals(entries(t), filters.Conditions([F.col("triage") == "F"]), "stack")


@query(f"SELECT 'triage' AS facet, triage AS value, count(*) AS n FROM {ENTRIES} WHERE triage IS NOT NULL GROUP BY ALL UNION ALL SELECT 'rating', rating, count(*) FROM {ENTRIES} GROUP BY ALL")
def listing_facets(t):
    return listing.facets(entries(t), "triage", "rating")


@query(f"SELECT strftime(coalesce(taken, added), '%Y-%m-%d') AS day, count(*) AS n FROM {ENTRIES} GROUP BY ALL")
def listing_days(t):
    return listing.per_day(entries(t), F.coalesce("taken", "added"))


@query(f"SELECT id, stack, size FROM (SELECT id, stack, count(*) OVER (PARTITION BY stack) AS size, row_number() OVER (PARTITION BY stack ORDER BY taken DESC NULLS LAST, id DESC) AS rn FROM {ENTRIES}) WHERE rn = 1")
def listing_collapsed(t):
    out = listing.collapse(entries(t), "stack", [F.col("taken").desc_nulls_last(), F.desc("id")], F.col("id"), "size")
    return out.select("id", "stack", "size")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%R_D w%' OR p_type ILIKE '%R_D w%'")
def filter_search(t):
    return t.part.filter(filters.search("R_D w", F.col("p_name"), F.col("p_type"))).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-04-01'")
def filter_days_inclusive(t):
    return t.orders.filter(filters.between_days(F.col("o_orderdate"), "1996-03-01", "1996-03-31")).select("o_orderkey")


@query(f"SELECT id FROM {ENTRIES} WHERE triage IS NULL OR triage IN ('O')")
def filter_triage_with_untriaged(t):
    return entries(t).filter(filters.one_of_or_null(F.col("triage"), ["O"], True)).select("id")


@query(f"SELECT id FROM {ENTRIES} WHERE bytes > 5000 AND triage = 'F' AND rating = '2-HIGH'")
def filter_match_all(t):
    c = filters.Conditions([F.col("bytes") > 5000], [F.col("triage") == "F", F.col("rating") == "2-HIGH"])
    return entries(t).filter(c.column()).select("id")


@query(f"SELECT id FROM {ENTRIES} WHERE bytes > 5000 AND (triage = 'F' OR rating = '2-HIGH')")
def filter_match_any(t):
    c = filters.Conditions([F.col("bytes") > 5000], [F.col("triage") == "F", F.col("rating") == "2-HIGH"], "any")
    return entries(t).filter(c.column()).select("id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (14000, 3)")
def filter_row_value(t):
    return t.lineitem.filter(filters.after([F.col("l_orderkey"), F.col("l_linenumber")], [14000, 3])).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 3)")
def filter_having_all(t):
    return filters.having_all(t.customer, t.orders, ["1-URGENT", "2-HIGH", "5-LOW"], "c_custkey", "o_custkey", "o_orderpriority").select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT stack FROM {ENTRIES} WHERE triage = 'F' AND stack IS NOT NULL)")
def filter_not_in(t):
    return filters.not_in(t.customer, "c_custkey", entries(t).filter("triage = 'F'"), "stack").select("c_custkey")


@query("SELECT a.o_orderkey FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey + 1 WHERE nullif(a.o_orderstatus, 'P') IS NOT DISTINCT FROM nullif(b.o_orderstatus, 'P')")
def filter_null_safe(t):
    e = entries(t)
    b = e.select((F.col("id") + 1).alias("id"), F.col("triage").alias("before"))
    return e.join(b, "id").filter(F.col("triage").eqNullSafe(F.col("before"))).select(F.col("id").alias("o_orderkey"))


PATHS = "(SELECT c_custkey, lower(r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name || '.ARW') AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def customer_paths(t):
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.lower(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", F.concat("c_name", F.lit(".ARW")))).alias("path")
    )


@query(f"SELECT c_custkey, path FROM {PATHS} WHERE path >= 'asia/nation_2/' AND path < 'asia/nation_20'")
def filter_below_folder(t):
    return customer_paths(t).filter(paths.below(F.col("path"), "asia/nation_2"))


@query(f"SELECT c_custkey FROM {PATHS} WHERE starts_with(path, 'asia/nation_2/machinery/') AND instr(substr(path, length('asia/nation_2/machinery/') + 1), '/') = 0")
def filter_direct_children(t):
    return customer_paths(t).filter(paths.is_direct_child(F.col("path"), "asia/nation_2/machinery")).select("c_custkey")


HIDDEN = "(SELECT lower(r_name || '/' || n_name) AS folder FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE '%_1%' UNION ALL SELECT 'europe')"


def hidden_folders(t):
    geo = t.nation.filter("n_name LIKE '%_1%'").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return geo.select(F.lower(F.concat_ws("/", "r_name", "n_name")).alias("folder")).unionByName(t.spark.range(1).select(F.lit("europe").alias("folder")))


@query(f"SELECT c_custkey FROM {PATHS} p WHERE EXISTS (SELECT 1 FROM {HIDDEN} h WHERE p.path = h.folder OR starts_with(p.path, h.folder || '/'))")
def hidden_subtree(t):
    return lookup.at_or_below(customer_paths(t), "path", hidden_folders(t), "folder").select("c_custkey")


@query(f"SELECT c_custkey, (SELECT max_by(h.folder, length(h.folder)) FROM {HIDDEN} h WHERE starts_with(p.path, h.folder || '/')) AS owner FROM {PATHS} p")
def longest_prefix(t):
    return lookup.longest_prefix(customer_paths(t), "path", hidden_folders(t), "folder", "owner").select("c_custkey", "owner")


@query(f"SELECT id, row_number() OVER (ORDER BY taken ASC NULLS LAST, id) - 1 AS position FROM {ENTRIES}")
def positions(t):
    return ordering.positions(entries(t).select("id", "taken"), ["taken", "id"]).select("id", "position")


@query(f"SELECT id, position FROM (SELECT id, row_number() OVER (ORDER BY taken ASC NULLS LAST, id) - 1 AS position FROM {ENTRIES}) WHERE position BETWEEN 10 AND 40 OR position BETWEEN 9000 AND 9100")
def ids_at_positions(t):
    return ordering.at_positions(ordering.positions(entries(t).select("id", "taken"), ["taken", "id"]), [(10, 40), (9000, 9100)]).select("id", "position")


@query(f"SELECT stack, position FROM (SELECT stack, row_number() OVER (ORDER BY taken ASC NULLS LAST, id) - 1 AS position FROM {ENTRIES}) WHERE stack IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def positions_of_stacks(t):
    chosen = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("stack"))
    return ordering.positions(entries(t).select("id", "taken", "stack"), ["taken", "id"]).join(chosen, "stack", "left_semi").select("stack", "position")


@query(f"SELECT id FROM {ENTRIES} WHERE taken > TIMESTAMP '1997-05-28' OR (taken = TIMESTAMP '1997-05-28' AND id > 1) OR taken IS NULL ORDER BY taken ASC NULLS LAST, id LIMIT 50")
def seek_forward(t):
    import datetime

    return ordering.seek(entries(t), "taken", "id", (datetime.datetime(1997, 5, 28), 1), True, 50).select("id")


@query(f"SELECT id FROM {ENTRIES} WHERE taken IS NOT NULL OR id < 500 ORDER BY taken DESC NULLS FIRST, id DESC LIMIT 50")
def seek_backward_undated(t):
    return ordering.seek(entries(t), "taken", "id", (None, 500), False, 50).select("id")


@query(f"SELECT id FROM {ENTRIES} WHERE taken >= TIMESTAMP '1996-01-01' AND (taken < TIMESTAMP '1996-02-01' OR (taken = TIMESTAMP '1996-02-01' AND id <= 7000)) ORDER BY taken, id LIMIT 1000")
def range_between_anchors(t):
    import datetime

    return ordering.between_anchors(entries(t), "taken", "id", (datetime.datetime(1996, 1, 1), 0), (datetime.datetime(1996, 2, 1), 7000)).select("id")


@query(f"SELECT id FROM (SELECT id, taken FROM {ENTRIES} WHERE taken < TIMESTAMP '1996-02-01' OR (taken = TIMESTAMP '1996-02-01' AND id <= 7000) ORDER BY taken DESC, id DESC LIMIT 200)")
def range_up_to_an_anchor(t):
    import datetime

    return ordering.between_anchors(entries(t), "taken", "id", None, (datetime.datetime(1996, 2, 1), 7000), 200).select("id")


_PLACES = f"(SELECT id, stack, row_number() OVER (ORDER BY taken ASC NULLS LAST, id) - 1 AS position FROM {ENTRIES})"


@query(f"SELECT id FROM {ENTRIES} WHERE stack IN (SELECT stack FROM {_PLACES} WHERE position BETWEEN 10 AND 40)")
def ids_at_positions_with_stacks(t):
    e = entries(t).select("id", "taken", "stack")
    return lookup.chosen_or_group(e, ordering.at_positions(ordering.positions(e, ["taken", "id"]), [(10, 40)]), "id", "stack").select("id")


@query("SELECT DISTINCT o_orderkey + o_custkey % 3 AS position FROM orders WHERE o_orderkey % 5 > 0 AND (o_orderkey BETWEEN 100 AND 4000 OR o_orderkey BETWEEN 9000 AND 9005) AND o_orderkey BETWEEN 50 AND 3000")
def rebased_selection(t):
    samples = t.orders.filter("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("was"), (F.col("o_orderkey") + F.col("o_custkey") % 3).alias("now"))
    ranges = lambda *r: t.spark.createDataFrame(list(r), "start long, end long")
    return ordering.rebase(ranges((100, 4000), (9000, 9005)), samples, ranges((50, 3000)))


@query("WITH r AS (SELECT c_nationkey AS nation, c_custkey AS start, c_custkey + (c_acctbal / 100)::INT AS stop FROM customer WHERE c_acctbal >= 0), m AS (SELECT *, max(stop) OVER (PARTITION BY nation ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY nation ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT nation, min(start) AS start, max(stop) AS stop FROM g GROUP BY nation, run")
def merged_ranges(t):
    r = t.customer.filter("c_acctbal >= 0").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("start"), (F.col("c_custkey") + F.rint(F.col("c_acctbal") / 100).cast("int")).alias("stop"))  # SQL rounds halves to even here
    return ordering.merge_ranges(r, "start", "stop", ["nation"])


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS kind FROM orders ORDER BY kind, o_orderdate DESC, o_orderkey LIMIT 200")
def kind_order(t):
    return t.orders.select("o_orderkey", "o_orderdate", ordering.ranked_by(F.col("o_orderpriority"), ["5-LOW", "1-URGENT"]).alias("kind")).orderBy("kind", F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "kind")


@query(f"SELECT path, len(string_split(path, '/')) AS depth FROM {PATHS} ORDER BY depth DESC, path LIMIT 100")
def depth_order(t):
    return customer_paths(t).select("path", paths.depth(F.col("path")).alias("depth")).orderBy(F.desc("depth"), "path").limit(100)


@query(f"SELECT c_mktsegment AS segment, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS funded, count(*) FILTER (o_orderkey IS NOT NULL) AS ordered, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS partial, count(*) FILTER (o_totalprice > 200000) AS large, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (year(o_orderdate) >= 2000) AS recent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def coverage_measures(t):
    joined = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumnRenamed("c_mktsegment", "segment")
    measures = {"funded": "c_acctbal > 0", "ordered": "o_orderkey IS NOT NULL", "finished": "o_orderstatus = 'F'", "partial": "o_orderstatus = 'P'", "large": "o_totalprice > 200000", "urgent": "o_orderpriority = '1-URGENT'", "recent": "year(o_orderdate) >= 2000"}
    return listing.coverage(joined, {k: F.expr(v) for k, v in measures.items()}, ["segment"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1")
def representative(t):
    order = [F.desc("l_extendedprice"), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))]
    return sequence.representative(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"SELECT id, stack, row_number() OVER (PARTITION BY stack ORDER BY (triage = 'F') DESC NULLS LAST, taken DESC NULLS LAST, id DESC) = 1 AS shown FROM {ENTRIES} WHERE bytes > 50000")
def representative_flag(t):
    order = [(F.col("triage") == "F").desc_nulls_last(), F.col("taken").desc_nulls_last(), F.desc("id")]
    return sequence.representative(entries(t).filter("bytes > 50000"), ["stack"], order, "shown").select("id", "stack", "shown")


@query(f"SELECT id, sum((triage IS NOT NULL)::BIGINT) OVER (PARTITION BY stack)::BIGINT AS visible FROM {ENTRIES}")
def visible_stack_size(t):
    return entries(t).select("id", sequence.visible_size(["stack"], F.col("triage").isNotNull()).alias("visible"))
