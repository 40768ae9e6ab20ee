"""Vector code compression: product codes whose codebooks are learned by whole-number Lloyd rounds over kd-trees.

Components become floor(scale * x), vectors are cut into ``parts`` equal consecutive parts, and a part position's codebook starts as that part of the ``entries`` vectors of the smallest ids.
In each round the driver builds one kd-tree a codebook and broadcasts them (at most ``parts * entries`` short vectors, whatever the table's size). Tasks search whole batches at once: a node's
bounding box gives the least squared distance a row can have below it, rows go to the nearer child first, and a child is left out for the rows whose best distance is less than that bound; a child at exactly the best
distance is visited, so that an equal entry of a lower index wins. A task gives back one row of count and component sums for each entry it used, so what is shuffled
is bounded by tasks times entries, and a third of all rows being copies of one vector costs nothing more. All arithmetic is of whole numbers, so results don't depend on how rows are dealt.

Defined results: rows whose vector is null or holds null or non-finite components are left out; so are vectors of another length than the most common one (the smaller on ties), for a codebook has
one length; a length that ``parts`` doesn't divide, and scaled components beyond 2**28, are errors. Null ids are kept and sort last, repeated ids are rows of their own, ordered by vector; with fewer rows than
``entries`` the codebooks are shorter; entries that no row uses stay; equal rows have equal codes; null labels are one label; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import cut

#: Rows searched at once.
_ROWS = 4096
#: Labels up to which their sums are broadcast.
_FEW_LABELS = 100_000
_LARGEST = 1 << 28


class KdTree:
    """Entries by index, nodes with bounding boxes; leaves have up to ``leaf`` entries."""

    def __init__(self, points: np.ndarray, leaf: int = 8):
        self.points, self.leaf = points.astype(np.int64), leaf
        self.low, self.high, self.children, self.members = [], [], [], []
        self._grow(np.arange(len(points)))

    def _grow(self, own: np.ndarray) -> int:
        node, box = len(self.low), self.points[own]
        self.low.append(box.min(axis=0))
        self.high.append(box.max(axis=0))
        self.children.append(None)
        self.members.append(np.sort(own))
        width = self.high[node] - self.low[node]
        if len(own) > self.leaf and width.any():
            order = own[np.argsort(box[:, int(width.argmax())], kind="stable")]
            self.children[node] = (self._grow(order[: len(own) // 2]), self._grow(order[len(own) // 2 :]))
        return node

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        out = np.maximum(self.low[node] - x, x - self.high[node])
        np.maximum(out, 0, out=out)
        return np.einsum("ij,ij->i", out, out)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the nearest entry, the lowest of equals, and the squared distance."""
        index, best = np.full(len(x), len(self.points)), np.full(len(x), np.iinfo(np.int64).max)
        self._visit(0, np.arange(len(x)), np.zeros(len(x), np.int64), x, index, best)
        return index, best

    def _visit(self, node: int, rows: np.ndarray, bound: np.ndarray, x: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        rows = rows[bound <= best[rows]]  # a bound that equals the best may hide an equal entry of a lower index
        if not len(rows):
            return
        if self.children[node] is None:
            own = self.members[node]
            apart = np.zeros((len(rows), len(own)), np.int64)
            for at, entry in zip(x[rows].T, self.points[own].T):
                apart += (at[:, None] - entry) ** 2
            first = apart.argmin(axis=1)
            found, least = own[first], apart[np.arange(len(rows)), first]
            better = (least < best[rows]) | ((least == best[rows]) & (found < index[rows]))
            index[rows[better]], best[rows[better]] = found[better], least[better]
            return
        (a, b), here = self.children[node], x[rows]
        to_a, to_b = self._bound(a, here), self._bound(b, here)
        first = to_a <= to_b
        self._visit(a, rows[first], to_a[first], x, index, best)
        self._visit(b, rows, to_b, x, index, best)
        self._visit(a, rows[~first], to_a[~first], x, index, best)


def whole_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, v): the rows that take part, floor(scale * x) of each component."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double") * scale)
    good = F.col(embedding).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = F.when(F.exists(x, lambda c: F.abs(c) > _LARGEST), F.raise_error(F.lit("components beyond 2**28 after scaling"))).otherwise(F.transform(x, lambda c: F.floor(c).cast("int")))
    return rows.filter(good).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), held.alias("v"))


def _parts_of(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Pieces of a batch: first row, last row, and for each part position the rows' components."""
    flat = batch.column(batch.schema.names.index("v"))
    for at in range(0, batch.num_rows, _ROWS):
        piece = flat.slice(at, _ROWS)
        yield at, at + len(piece), np.split(piece.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(piece), -1), parts, axis=1)


def _sums(vectors: DataFrame, trees: list[KdTree]) -> DataFrame:
    """(part, entry, n, sums) over all rows; tasks sum first."""
    shared, parts = vectors.sparkSession.sparkContext.broadcast(trees), len(trees)
    width = trees[0].points.shape[1]

    def run(batches):
        trees = shared.value
        total = np.zeros((parts, len(trees[0].points), width), np.int64)
        count = np.zeros(total.shape[:2], np.int64)
        for batch in batches:
            for _, _, pieces in _parts_of(batch, parts):
                for p, x in enumerate(pieces):
                    index, _ = trees[p].nearest(x)
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    if len(used):
                        total[p, used] += np.add.reduceat(x[order], starts, axis=0)
                        count[p, used] += np.diff(np.append(starts, len(order)))
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    each = vectors.select("v").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(width))).alias("sums"))


def learn(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """The codebooks (parts, entries, width of a part) after so many rounds, from the rows of ``whole_vectors``, which are of one length."""
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(vectors, [KdTree(book) for book in books]).collect():  # at most parts * entries rows
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): entries' indices in two hex digits a part, and the squared distance to what they stand for."""
    shared, parts = vectors.sparkSession.sparkContext.broadcast([KdTree(book) for book in books]), len(books)

    def run(batches):
        for batch in batches:
            for first, last, pieces in _parts_of(batch, parts):
                found = [tree.nearest(x) for tree, x in zip(shared.value, pieces)]
                digits = np.stack([index for index, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(codes, pa.string()), pa.array(sum(apart for _, apart in found))], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray, name: str = "v") -> DataFrame:
    """The rows of ``encode`` with the vectors that their codes stand for."""
    table = F.array(*(F.array(*(F.array(*map(F.lit, entry.tolist())) for entry in book)) for book in books))
    entry = [table[p][F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")] for p in range(len(books))]
    return codes.withColumn(name, F.concat(*entry))


def vector_codes(rows: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows (vec_id, embedding, label)."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits")
    vectors = cut(whole_vectors(rows, "vec_id", "embedding", "label", scale))
    lengths = vectors.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if lengths is None or not lengths["n"]:
        return vectors.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    if lengths["n"] % parts:
        raise ValueError(f"vectors of length {lengths['n']} can't be cut into {parts} equal parts")
    vectors = vectors.filter(F.size("v") == lengths["n"])
    books = learn(vectors, parts, entries, rounds)
    found = cut(encode(vectors, books))
    totals = cut(found.groupBy("label").agg(F.sum("error").alias("label_error")))
    totals = F.broadcast(totals) if totals.count() <= _FEW_LABELS else totals
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return found.join(totals, found["label"].eqNullSafe(totals["label"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(width: int = 16, rounds: int = 4) -> str:
    """The query in DuckDB's SQL, for vectors of four times ``width``: every part against every entry."""
    steps = [f"""
k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, part, x, list_inner_product(x, x) AS xx FROM (SELECT r, part, v[{width} * part + 1 : {width} * part + {width}] AS x FROM k, range(4) t(part))),
c0 AS MATERIALIZED (SELECT part, r AS i, x AS c, xx AS cc FROM p WHERE r < 256)"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (
  SELECT r, p.part, min((xx - 2 * list_inner_product(x, c) + cc)::BIGINT * 256 + i) AS m FROM p JOIN c{n} c ON p.part = c.part GROUP BY r, p.part)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT part, i, c, list_inner_product(c, c) AS cc FROM (
    SELECT o.part, o.i, coalesce(n.c, o.c) AS c FROM c{n} o LEFT JOIN (
      SELECT part, i, list(floor(s / n) ORDER BY j) AS c FROM (
        SELECT a.part, a.m % 256 AS i, j, sum(x[j]) AS s, count(*) AS n FROM a{n} a JOIN p ON a.r = p.r AND a.part = p.part, range(1, {width + 1}) t(j) GROUP BY ALL)
      GROUP BY part, i) n ON o.part = n.part AND o.i = n.i))""")
    return f"""WITH {','.join(steps)},
f AS (
  SELECT r, string_agg(printf('%02x', (m % 256)::INT), '' ORDER BY part) AS code, sum((m - m % 256) / 256)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY part, i)) FROM c{rounds}) AS codebooks_sha256
FROM f JOIN k USING (r)
"""
