"""Backup sets, collapsed stacks, put-off copies and detail rows over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backup, links, rendition
from .registry import query

ORIGINALS = "(SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 6 = 0 THEN 'composite' ELSE 'file' END AS kind, 'c' || o_custkey % 50 || '/' || o_orderkey AS path, o_orderstatus = 'P' OR o_orderkey % 8 = 1 AS is_missing, CASE WHEN o_orderkey % 4 > 0 THEN 'h' || o_custkey % 3 END AS content_hash, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 2 END AS file_size FROM orders)"
COPIES = "(SELECT l_orderkey AS photo_id, (min(l_suppkey) % 2)::INT AS peer_id, 'c' || min(l_partkey) % 50 || '/' || l_orderkey AS rel_path, CASE max(l_returnflag) WHEN 'R' THEN 'held' WHEN 'N' THEN 'held' ELSE CASE min(l_suppkey) % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' END END AS health, 'h' || min(l_partkey) % 3 AS content_hash, min(l_partkey) % 2 AS size FROM lineitem WHERE l_linenumber < 4 GROUP BY l_orderkey)"


def originals(t):
    text = lambda c: F.col(c).cast("string")
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("photo_id"), F.when(key % 6 == 0, "composite").otherwise("file").alias("kind"), F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), text("o_orderkey")).alias("path"),
        ((F.col("o_orderstatus") == "P") | (key % 8 == 1)).alias("is_missing"), F.when(key % 4 > 0, F.concat(F.lit("h"), (F.col("o_custkey") % 3).cast("string"))).alias("content_hash"), F.when(key % 5 > 0, F.col("o_custkey") % 2).alias("file_size"),
    )


def copies(t):
    one = t.lineitem.filter("l_linenumber < 4").groupBy(F.col("l_orderkey").alias("photo_id")).agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.max("l_returnflag").alias("f"))
    number = lambda c, n: (F.col(c) % n).cast("string")
    health = F.when(F.col("f").isin("R", "N"), "held").when(F.col("s") % 3 == 0, "missing").when(F.col("s") % 3 == 1, "changed")
    return one.select("photo_id", (F.col("s") % 2).cast("int").alias("peer_id"), F.concat(F.lit("c"), number("p", 50), F.lit("/"), F.col("photo_id").cast("string")).alias("rel_path"), health.alias("health"), F.concat(F.lit("h"), number("p", 3)).alias("content_hash"), (F.col("p") % 2).alias("size"))


@query(f"""
WITH j AS (SELECT p.*, b.photo_id AS b, b.health, b.content_hash AS bh, b.size, b.rel_path FROM {ORIGINALS} p LEFT JOIN {COPIES} b ON b.photo_id = p.photo_id AND b.peer_id = 1 WHERE kind = 'file')
SELECT photo_id, coalesce(NOT is_missing AND (b IS NULL OR health <> 'held' OR (content_hash IS NOT NULL AND content_hash <> bh) OR (file_size IS NOT NULL AND file_size <> size)), FALSE) AS owed, is_missing AND b IS NULL AS lost,
  coalesce(health = 'held' AND path <> rel_path, FALSE) AS misplaced, is_missing AND b IS NOT NULL AS offloaded, path AS belongs_at, rel_path AS was_at FROM j""")
def backup_states(t):
    return backup.backup_states(originals(t), copies(t), 1)


@query(f"""
SELECT count(*) AS originals, count_if(b.health = 'held' AND (p.content_hash IS NULL OR p.content_hash = b.content_hash) AND (file_size IS NULL OR file_size = size))::BIGINT AS backed_up,
  count_if(NOT is_missing AND (b.photo_id IS NULL OR health <> 'held' OR (p.content_hash IS NOT NULL AND p.content_hash <> b.content_hash) OR (file_size IS NOT NULL AND file_size <> size)))::BIGINT AS pending,
  count_if(is_missing AND health = 'held')::BIGINT AS offloaded, count_if(health = 'missing')::BIGINT AS missing, count_if(health = 'changed')::BIGINT AS changed, count_if(is_missing AND (b.photo_id IS NULL OR health <> 'held'))::BIGINT AS missing_originals
FROM {ORIGINALS} p LEFT JOIN {COPIES} b ON b.photo_id = p.photo_id AND b.peer_id = 1 WHERE kind = 'file'""")
def backup_coverage(t):
    return backup.backup_coverage(originals(t), copies(t), 1)


MEMBERS = "(SELECT c_custkey AS stack_id, unnest([c_custkey, c_custkey + 7]) AS photo_id, lpad((c_custkey % 90)::VARCHAR, 3, '0') AS stamp FROM customer WHERE c_acctbal > 1000)"


@query(f"""
WITH s AS (SELECT c_custkey AS id, lpad((c_custkey % 13)::VARCHAR, 3, '0') AS made, c_custkey - 7 * row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_custkey) AS run FROM customer WHERE c_acctbal > 1000),
w AS (SELECT id, first_value(id) OVER (PARTITION BY run ORDER BY made DESC, id DESC) AS winner FROM s),
g AS (SELECT c_custkey AS stack_id, c_custkey + 7 * (1 + c_nationkey % 3) AS photo_id, lpad((c_nationkey * 3)::VARCHAR, 3, '0') AS stamp FROM customer),
m AS (SELECT m.*, w.winner FROM {MEMBERS} m JOIN w ON w.id = m.stack_id),
keep AS (SELECT stack_id, photo_id, stamp FROM m WHERE stack_id = winner),
new AS (SELECT DISTINCT m.winner AS stack_id, m.photo_id FROM m LEFT JOIN g ON g.stack_id = m.winner AND g.photo_id = m.photo_id WHERE m.stack_id <> winner AND (g.stamp IS NULL OR g.stamp <= m.stamp))
SELECT * FROM keep UNION ALL SELECT stack_id, photo_id, '999' FROM new WHERE (stack_id, photo_id) NOT IN (SELECT stack_id, photo_id FROM keep)""")
def collapsed_stacks(t):
    """Each stack shares a photo with the one seven further on, so runs of them become one."""
    number = lambda c: F.lpad(c.cast("string"), 3, "0")
    key = F.col("c_custkey")
    rows = t.customer.filter("c_acctbal > 1000")
    members = rows.select(key.alias("stack_id"), F.explode(F.array(key, key + 7)).alias("photo_id"), number(key % 90).alias("stamp"))
    graves = t.customer.select(key.alias("stack_id"), (key + 7 * (1 + F.col("c_nationkey") % 3)).alias("photo_id"), number(F.col("c_nationkey") * 3).alias("stamp"))
    return links.collapse_stacks(members, rows.select(key.alias("stack_id"), number(key % 13).alias("created_stamp")), graves, "999")[0]


COPIED = "(SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 4 > 0 THEN 't' END AS built_at, CASE WHEN o_orderkey % 4 > 0 THEN lpad((o_custkey % 50)::VARCHAR, 3, '0') END AS built_from, CASE WHEN o_orderkey % 3 = 0 THEN lpad((o_custkey % 70)::VARCHAR, 3, '0') END AS deferred_from, o_orderkey % 2 = 0 AS needs_build FROM orders WHERE o_orderkey % 9 > 0)"
TOUCHED = "(SELECT l_orderkey AS photo_id, max(lpad((l_partkey % 80)::VARCHAR, 3, '0')) AS stamp FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)"


def copied(t):
    number, key = lambda c, n: F.lpad((F.col(c) % n).cast("string"), 3, "0"), F.col("o_orderkey")
    return t.orders.filter("o_orderkey % 9 > 0").select(key.alias("photo_id"), F.when(key % 4 > 0, "t").alias("built_at"), F.when(key % 4 > 0, number("o_custkey", 50)).alias("built_from"), F.when(key % 3 == 0, number("o_custkey", 70)).alias("deferred_from"), (key % 2 == 0).alias("needs_build"))


def touched(t):
    return t.lineitem.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("photo_id"), F.lpad((F.col("l_partkey") % 80).cast("string"), 3, "0").alias("stamp"))


@query(f"SELECT photo_id, stamp FROM {TOUCHED} LEFT JOIN {COPIED} USING (photo_id) WHERE (built_from IS NULL OR stamp > built_from) AND (deferred_from IS NULL OR stamp > deferred_from)")
def queued_since_edits(t):
    return rendition.queue_edited(touched(t), copied(t))


@query(f"""
WITH x AS (SELECT * FROM {TOUCHED} WHERE photo_id <> 42)
SELECT coalesce(c.photo_id, x.photo_id) AS photo_id, built_at, built_from, CASE WHEN x.photo_id IS NOT NULL THEN stamp ELSE deferred_from END AS deferred_from,
  CASE WHEN x.photo_id IS NOT NULL AND (built_at IS NOT NULL OR c.photo_id IS NULL) THEN FALSE ELSE needs_build END AS needs_build FROM {COPIED} c FULL JOIN x ON x.photo_id = c.photo_id""")
def copies_put_off(t):
    return rendition.put_off(copied(t), touched(t), 42)
