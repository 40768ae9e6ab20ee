"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Candidates are dealt row by row into shards of about ``shard_rows`` rows, each a partition that is written down once. A shard's index holds, for each
dimension, posting segments by quantised value (steps of ``step``). Queries meet it ``width`` at a time: segments are taken by descending impact (the
level times the largest of the queries' components) and add each query's impact to their rows' accumulators. A row's score lies
within its accumulator plus what the segments not yet taken can still add or take (the sum over dimensions of the largest and least
impact left), plus its quantisation error (by Cauchy-Schwarz, the query's norm times the row's residual norm). After each wave
of segments the k-th largest lower bound, or the k-th best score of shards searched before if that is higher, is compared with the upper bounds; a query stops when no more than
``rescore`` rows can still be members, or when the segments end. All rows whose upper bound reaches the bar, ties included, are then
scored exactly; their number has no cap.

Vectors are never shuffled to meet queries: queries go to all shards in blocks of about ``block`` (so a broadcast has a bound: ``block`` vectors), and shards are searched in rounds, first as
many as there are cores, then as many as were searched before. A round's k-th best scores are the next one's bar, so that a query gets about k rows a round
and not k a shard: what is shuffled grows with the queries times the logarithm of the shards.

Defined results: vectors that are null, empty, of another length than the majority by count (smaller length on ties), or with null or non-finite components
take no part, as queries or candidates; rows without an id take no part as queries and are no one's result; repeated ids are rows
of their own, none of them a candidate of its own id; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import cut


class ImpactIndex:
    """Posting segments of an integer matrix by dimension and quantised value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, step: int = 8):
        self.ids, self.vectors, self.step = ids, vectors, step
        levels = np.floor_divide(vectors + step // 2, step)
        residual = (vectors - levels * step).astype(np.float64)
        self.error = np.sqrt((residual**2).sum(axis=1))
        self.dims, self.values, self.rows = [], [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(levels[:, d], kind="stable").astype(np.int32)
            v, at = np.unique(levels[order, d], return_index=True)
            for value, rows in zip(v.tolist(), np.split(order, at[1:])):
                if value:  # the segment of level 0 adds nothing
                    self.dims.append(d)
                    self.values.append(value * step)
                    self.rows.append(rows)
        self.dims, self.values = np.array(self.dims, np.int64), np.array(self.values, np.int64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, rescore: int, bars: np.ndarray | None = None, waves: tuple[float, ...] = (0.5, 0.8, 1.0)) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row; ``own`` its id) the ids and scores of its k best rows, less those under its bar. ``waves``: shares of the postings after which to look."""
        q = queries.astype(np.float64)
        order = np.argsort(-np.abs(self.values) * np.abs(q).max(axis=0)[self.dims], kind="stable")
        taken = np.cumsum([len(self.rows[s]) for s in order.tolist()])
        acc = np.zeros((len(self.ids), len(q)))
        norm, open_, out = np.sqrt((q**2).sum(axis=1)), list(range(len(q))), [None] * len(q)
        at = 0
        for share in waves:
            end = int(np.searchsorted(taken, share * taken[-1])) + 1 if len(taken) and share < 1 else len(order)
            for s in order[at:end].tolist():
                acc[self.rows[s]] += q[:, self.dims[s]] * self.values[s]
            at = end
            left = order[at:]
            most, least = np.zeros(q.shape[1]), np.zeros(q.shape[1])
            np.maximum.at(most, self.dims[left], self.values[left])
            np.minimum.at(least, self.dims[left], self.values[left])
            up, down = np.maximum(q * most, q * least).sum(axis=1), np.minimum(q * most, q * least).sum(axis=1)
            for i in list(open_):
                takes_part = self.ids != own[i]
                here = min(k, int(takes_part.sum()))
                if not here:
                    out[i] = (np.empty(0, np.int64), np.empty(0, np.int64))
                else:
                    slack = norm[i] * self.error + 1e-6 * (1 + norm[i])
                    low = (acc[:, i] - slack + down[i])[takes_part]
                    bar = np.partition(low, -here)[-here]
                    if bars is not None:
                        bar = max(bar, bars[i])
                    may = takes_part & (acc[:, i] + slack + up[i] >= bar)
                    if at < len(order) and int(may.sum()) > rescore:
                        continue
                    may = np.flatnonzero(may)
                    exact = self.vectors[may] @ queries[i]
                    if bars is not None:
                        may, exact = may[exact >= bars[i]], exact[exact >= bars[i]]
                    best = np.lexsort((self.ids[may], -exact))[:k]
                    out[i] = (self.ids[may][best], exact[best])
                open_.remove(i)
            if not open_:
                break
        return out


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as long, of the rows that take part."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    good = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = rows.filter(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    width = whole.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return whole.filter(F.size("v") == (width["n"] if width else 0))


def _matrix(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return ids, np.asarray(flat.flatten(), np.int64).reshape(len(ids), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, block: int = 20_000, step: int = 8, rescore: int = 64, width: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` and ``queries``: (vec_id, v) as ``integer_vectors`` gives them."""
    vectors, queries = cut(vectors), cut(queries)
    context = vectors.sparkSession.sparkContext
    shards, blocks = max(1, -(-vectors.count() // shard_rows)), max(1, -(-queries.count() // block))
    # dealt by row, so that one id or vector with very many rows fills no shard and no block
    dealt, queries = (cut(rows.repartition(n).withColumn("part", F.spark_partition_id())) for rows, n in ((vectors, shards), (queries, blocks)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    done = []
    for number in range(blocks):
        asked = queries.filter(F.col("part") == number).toArrow()
        best, bars, first = None, None, 0
        while first < shards and asked.num_rows:
            end = first + max(context.defaultParallelism, first)
            shared = context.broadcast((*_matrix(asked), bars))

            def run(batches, shared=shared):
                rows = [b for b in batches if b.num_rows]
                if not rows:
                    return
                own, q, bars = shared.value
                index = ImpactIndex(*_matrix(pa.Table.from_batches(rows)), step)
                for at in range(0, len(own), width):
                    part = slice(at, at + width)
                    found = index.search(q[part], own[part], k, rescore, None if bars is None else bars[part])
                    cols = (np.repeat(own[part], [len(i) for i, _ in found]), np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

            found = dealt.filter(F.col("part").between(first, end - 1)).mapInArrow(run, "query_id long, vec_id long, score long")
            found = found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)
            best = cut(found.withColumn("rank", rank).filter(F.col("rank") <= k))
            first = end
            if first < shards:
                last = {r["query_id"]: r["score"] for r in best.filter(F.col("rank") == k).select("query_id", "score").collect()}
                bars = np.array([last.get(i, -(2**62)) for i in asked.column("vec_id").to_pylist()], np.int64)
        if best is not None:
            done.append(best)
    empty = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    out = empty
    for best in done:
        out = out.unionByName(best)
    return out.select("query_id", "rank", "vec_id", "score")


#: The query in DuckDB's SQL.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
