"""Runs, brackets, budgets, ranks, numeric patterns and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..operators import arrays, sequence, similarity
from .registry import query

RUNS = "(SELECT *, 1 + sum(broken) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS broken FROM events))"


def runs(t):
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return sequence.gap_runs(e, ["user_id"], F.col("us"), ["ts", "event_id"], 21_600_000_000)


@query(f"SELECT event_id, run::BIGINT AS run FROM {RUNS}")
def gap_split(t):
    return runs(t).select("event_id", F.col("run").cast("long").alias("run"))


@query(f"SELECT user_id, run::BIGINT AS run, count(*) AS n, min(ts) AS first, max(ts) AS last, round(sum(value), 2) AS total FROM {RUNS} GROUP BY user_id, run")
def run_summary(t):
    return runs(t).groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH f AS (SELECT conv_id, turn, role, turn % 4 + 1 AS i, 4 AS c FROM conversations),
m AS (SELECT *, CASE WHEN coalesce(i = lag(i) OVER w + 1 AND turn - lag(turn) OVER w <= 1, FALSE) THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn, i, role)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, i, role ROWS UNBOUNDED PRECEDING) AS bracket FROM m),
k AS (SELECT *, count(*) OVER (PARTITION BY conv_id, bracket) AS n, min(i) OVER (PARTITION BY conv_id, bracket) AS first FROM r)
SELECT conv_id, turn, bracket::BIGINT AS bracket FROM k WHERE n >= 2 AND first = 1 AND n = c""")
def complete_brackets(t):
    f = t.conversations.select("conv_id", "turn", "role", (F.col("turn") % 4 + 1).alias("i"), F.lit(4).alias("c"), F.lit(None).cast("int").alias("g"))
    return sequence.brackets(f, ["conv_id"], F.col("turn"), "i", "c", "g", "role", 1).select("conv_id", "turn", F.col("bracket").cast("long").alias("bracket"))


@query("SELECT s_suppkey, CASE WHEN n > 1 THEN floor((r - 1 + (ties - 1) / 2) / (n - 1) * 255 + 0.5)::INT ELSE 0 END AS level FROM (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY b) AS r, count(*) OVER (PARTITION BY s_nationkey, b) AS ties, count(*) OVER (PARTITION BY s_nationkey) AS n FROM (SELECT *, round(s_acctbal / 1000) AS b FROM supplier))")
def rank_levels(t):
    s = t.supplier.withColumn("b", F.round(F.col("s_acctbal") / 1000))
    return s.select("s_suppkey", sequence.rank_to_255("b", ["s_nationkey"]).alias("level"))


@query("SELECT p_partkey, round(running, 2) AS running FROM (SELECT *, sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS running FROM part) WHERE running <= 20000")
def within_budget(t):
    return sequence.within_budget(t.part, "p_retailprice", [F.desc("p_size"), F.col("p_partkey")], 20000, ["p_brand"]).select("p_partkey", F.round("running", 2).alias("running"))


@query("SELECT p_partkey FROM (SELECT *, sum(p_size) OVER (PARTITION BY p_brand) - coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM part) WHERE l > 500")
def least_used_to_evict(t):
    return sequence.to_evict(t.part, "p_size", [F.col("p_partkey")], ["p_brand"], 500).select("p_partkey")


@query("SELECT p_partkey FROM (SELECT *, row_number() OVER w AS rn, sum(p_size) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey DESC)) WHERE rn = 1 OR running <= 100")
def keep_newest(t):
    return sequence.keep_newest(t.part, ["p_brand"], [F.desc("p_partkey")], "p_size", 100).select("p_partkey")


@query("WITH b AS (SELECT l_returnflag AS flag, least(999, greatest(0, floor((l_extendedprice - 0) / 105)))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY flag ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY flag) AS total FROM b) SELECT flag, min(bin) * 105.0::DOUBLE AS quantile FROM c WHERE run >= total * 0.95::DOUBLE GROUP BY 1")
def binned_quantile(t):
    return arrays.binned_quantile(t.lineitem.withColumnRenamed("l_returnflag", "flag"), F.col("l_extendedprice"), 0.0, 105000.0, 1000, 0.95, ["flag"])


@query("SELECT c_mktsegment, least(19, greatest(0, floor((c_acctbal + 1000) / 550)))::INT AS bin, count(*) AS n FROM customer GROUP BY ALL")
def histogram(t):
    return arrays.histogram(t.customer, F.col("c_acctbal"), -1000.0, 10000.0, 20, ["c_mktsegment"])


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def least_squares(t):
    slope, intercept = arrays.least_squares(t.lineitem, [F.col("l_quantity"), F.lit(1.0)], F.col("l_extendedprice"))
    return t.spark.range(1).select(F.round(F.lit(float(slope)), 4).alias("slope"), F.round(F.lit(float(intercept)), 2).alias("intercept"))


@query("SELECT event_id, round(coalesce(lag(value) OVER w, first_value(value) OVER f) * 0.25 + value * 0.5 + coalesce(lead(value) OVER w, last_value(value) OVER f) * 0.25, 6) AS smooth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def smoothed(t):
    return t.events.select("event_id", F.round(arrays.moving("value", ["user_id"], ["ts", "event_id"], [0.25, 0.5, 0.25]), 6).alias("smooth"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS to_centre FROM embeddings JOIN (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1) USING (label)")
def similarity_to_centre(t):
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return t.embeddings.join(centres, "label").select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("c")), 6).alias("to_centre"))


@query()
def clique_groups(t):
    """Ids of a label that are at most 3 apart are a run."""
    runs = sequence.gap_runs(t.embeddings, ["label"], F.col("vec_id"), ["vec_id"], 3)
    return similarity.clique_groups(runs, ["label", "run"], ["vec_id"], "embedding", "vec_id", 0.2).select("vec_id", "label", "clique")


@query()
def distinct_matches(t):
    e = t.embeddings
    return similarity.distinct_matches(e.filter("label = 0"), e.filter("label <> 0"), "vec_id", "embedding", 0.95)


@query("""SELECT p_partkey, round(CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END, 9) AS linear,
round(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END, 9) AS encoded,
round(CASE WHEN v < 0.081 THEN v / 4.5 ELSE pow((v + 0.099) / 1.099, 1 / 0.45) END, 9) AS rec709, round(pow(v, 2.2), 9) AS gamma,
round(pow(greatest(pow(v, 32.0 / 2523) - 3424.0 / 4096, 0) / (2413.0 / 128 - 2392.0 / 128 * pow(v, 32.0 / 2523)), 16384.0 / 2610), 9) AS pq,
round(pow((3424.0 / 4096 + 2413.0 / 128 * pow(v, 2610.0 / 16384)) / (1 + 2392.0 / 128 * pow(v, 2610.0 / 16384)), 2523.0 / 32), 9) AS pq_encoded,
round(CASE WHEN v <= 0.5 THEN v * v / 3 ELSE (exp((v - 0.55991073) / 0.17883277) + 0.28466892) / 12 END, 9) AS hlg
FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS v FROM part)""")
def transfer_curves(t):
    p = t.part.select("p_partkey", (F.col("p_size") / 50.0).alias("v"))
    v = F.col("v")
    curves = {"linear": colour.srgb_to_linear(v), "encoded": colour.linear_to_srgb(v), "rec709": colour.rec709_to_linear(v), "gamma": colour.gamma_to_linear(v, 2.2), "pq": colour.pq_to_linear(v), "pq_encoded": colour.linear_to_pq(v), "hlg": colour.hlg_to_linear(v)}
    return p.select("p_partkey", *[F.round(c, 9).alias(n) for n, c in curves.items()])


@query("SELECT l_orderkey, l_linenumber, round(0.4124 * a + 0.3576 * b + 0.1805 * c, 9) AS x, round(0.2126 * a + 0.7152 * b + 0.0722 * c, 9) AS y, round(0.0193 * a + 0.1192 * b + 0.9505 * c, 9) AS z FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem)")
def matrix_product(t):
    m = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]
    x, y, z = colour.matrix3(m, F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"))


@query("SELECT p_partkey, floor(CASE WHEN p_size <= 5 THEN 20 WHEN p_size <= 20 THEN 20 + (p_size - 5) * (60.0::DOUBLE / 15) WHEN p_size <= 45 THEN 80 + (p_size - 20) * (15.0::DOUBLE / 25) ELSE 95 END + 0.5)::BIGINT AS quality FROM part")
def encoder_quality(t):
    q = colour.round_half_up(colour.piecewise_linear(F.col("p_size"), [(5, 20), (20, 80), (45, 95)]))
    return t.part.select("p_partkey", q.cast("long").alias("quality"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 2 = 1 THEN h ELSE w END)::BIGINT AS width, (CASE WHEN l_linenumber % 2 = 1 THEN w ELSE h END)::BIGINT AS height FROM (SELECT *, greatest(1, floor(6000 * (1 - l_discount - l_tax) + 0.5)) AS w, greatest(1, floor(4000 * (1 - l_tax - l_tax) + 0.5)) AS h FROM lineitem)")
def display_sizes(t):
    w, h = colour.display_size(F.lit(6000), F.lit(4000), F.col("l_discount"), F.col("l_tax"), 1 - F.col("l_tax"), 1 - F.col("l_tax"), F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", w.cast("long").alias("width"), h.cast("long").alias("height"))


@query("SELECT quantile_disc(l_extendedprice, 0.5) AS median FROM lineitem")
def rank_selected_median(t):
    n = t.lineitem.filter("l_extendedprice IS NOT NULL").count()
    low, high = t.lineitem.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    v = arrays.rank_select(t.lineitem, F.col("l_extendedprice"), (n - 1) // 2, low, high)
    return t.spark.range(1).select(F.lit(v).cast("double").alias("median"))


@query("SELECT (c_custkey % 64) // 8 AS tile_x, (c_custkey // 64) // 8 AS tile_y, count(*) AS n, round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY ALL")
def tile_reduction(t):
    grid = t.customer.select((F.col("c_custkey") % 64).alias("x"), F.floor(F.col("c_custkey") / 64).alias("y"), "c_acctbal")
    return arrays.tiles(grid, "x", "y", 8, {"n": F.count("*"), "mean": F.round(F.avg("c_acctbal"), 4), "low": F.min("c_acctbal"), "high": F.max("c_acctbal")})


@query()
def largest_filled_rectangle(t):
    grid = t.customer.select("c_mktsegment", (F.col("c_custkey") % 32).alias("x"), F.floor(F.col("c_custkey") / 32).alias("y"), (F.col("c_acctbal") > 0).alias("on"))
    return arrays.largest_rectangle(grid, ["c_mktsegment"], "x", "y", "on")


@query("SELECT p_brand, p_partkey, round(sum(w * p2) , 4) AS blurred FROM (SELECT a.p_brand, a.p_partkey, coalesce(b.p_retailprice, CASE WHEN a.rn + o < 1 THEN a.f ELSE a.l END) AS p2, w FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, first_value(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f, last_value(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM part) a CROSS JOIN (VALUES (-2, 0.1::DOUBLE), (-1, 0.2), (0, 0.4), (1, 0.2), (2, 0.1)) k(o, w) LEFT JOIN (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) b ON a.p_brand = b.p_brand AND b.rn = a.rn + o) GROUP BY 1, 2")
def stencil_of_five(t):
    return t.part.select("p_brand", "p_partkey", F.round(arrays.moving("p_retailprice", ["p_brand"], ["p_partkey"], [0.1, 0.2, 0.4, 0.2, 0.1]), 4).alias("blurred"))
