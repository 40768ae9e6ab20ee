"""Similarity over vectors: grouping of neighbours in time, and best matches between two sides.

Defined results: rows without a vector match nothing and are in no group of two; a vector of zeros is alike to nothing (cosine 0); ties go to the smaller id; repeated rows are rows of their own; empty tables
give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def clique_groups(rows: DataFrame, by: list[str], order: list[str], vector: str, row_id: str, threshold: float, alike=None) -> DataFrame:
    """Sequential grouping inside each run: a row joins the open group if it is alike, by at least the threshold, to every member, else it opens a new one.
    Gives ``by``, id and ``clique`` (the group's first position in its run; -1 for a group of one, and for rows whose vector is null, which end the open group).
    Order matters, so a run is one task's, which streams through it and holds the open group alone, however long the run is; split rows into
    runs (``sequence.gap_runs``) first. ``alike(members, vector)`` gives the similarities to a list of vectors; cosine where it is None."""
    if alike is None:

        def alike(members, v):
            m = np.stack(members)
            return m @ v / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(v), 1e-12)

    kinds = dict(rows.dtypes)
    keep = [*by, row_id]

    def walk(batches):
        run, at, start, members, ids = None, 0, 0, [], []
        done: list[tuple] = []

        def close():
            done.extend((*run, i, start if len(ids) > 1 else -1) for i in ids)
            members.clear()
            ids.clear()

        for pdf in batches:
            for row, v in zip(pdf[keep].itertuples(index=False, name=None), pdf[vector]):
                here, i = row[:-1], row[-1]
                if run is None or not _same(run, here):
                    if ids:
                        close()
                    run, at, start = here, 0, 0
                if v is None:
                    close()
                    done.append((*run, i, -1))
                else:
                    v = np.asarray(v, float)
                    if members and np.min(alike(members, v)) < threshold:
                        close()
                    if not members:
                        start = at
                    members.append(v)
                    ids.append(i)
                at += 1
            yield pd.DataFrame(done, columns=[*keep, "clique"])
            done = []
        if ids:
            close()
        yield pd.DataFrame(done, columns=[*keep, "clique"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", clique long"
    streamed = rows.select(*dict.fromkeys([*keep, *order, vector])).repartition(*by).sortWithinPartitions(*by, *order)
    return streamed.mapInPandas(walk, schema)


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def distinct_matches(left: DataFrame, right: DataFrame, row_id: str, vector: str, ratio: float, block: int = 2048) -> DataFrame:
    """(left_id, right_id, distance): for each left row its nearest right row by Euclidean distance, kept if that is less than ``ratio`` times the distance of the second
    nearest, and if the left row is the right one's best too. Both sides are dealt into blocks of about ``block`` rows; a task holds one block of each,
    and only each left row's two best in it go on. Rows without a vector match nothing."""
    left, right = left.filter(F.col(vector).isNotNull()), right.filter(F.col(vector).isNotNull())
    n_left, n_right = (max(1, -(-df.count() // block)) for df in (left, right))
    place = lambda n: F.pmod(F.xxhash64(row_id), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    l = left.select(place(n_left).alias("i"), every(n_right).alias("j"), F.lit(True).alias("asks"), row_id, vector)  # noqa: E741
    r = right.select(every(n_left).alias("i"), place(n_right).alias("j"), F.lit(False).alias("asks"), row_id, vector)
    kind = dict(left.dtypes)[row_id]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values(row_id)
        if not len(ask) or not len(have):
            return pd.DataFrame({"left_id": [], "right_id": [], "distance": []})
        b, ids = np.stack(have[vector].to_list()).astype(float), have[row_id].to_numpy()
        out = []
        for at in range(0, len(ask), 256):
            part = ask.iloc[at : at + 256]
            a = np.stack(part[vector].to_list()).astype(float)
            # the two nearest by the expanded square, those near the bound exactly
            square = (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :]
            bar = np.partition(square, min(1, len(ids) - 1), axis=1)[:, min(1, len(ids) - 1)]
            for i, v, s, limit in zip(part[row_id], a, square, bar):
                near = np.flatnonzero(s <= limit + 1e-6 * (1 + abs(limit)))
                d = np.sqrt(((b[near] - v) ** 2).sum(axis=1))
                out += [(i, ids[near[j]], float(d[j])) for j in np.argsort(d, kind="stable")[:2]]
        return pd.DataFrame(out, columns=["left_id", "right_id", "distance"])

    found = l.unionByName(r).groupBy("i", "j").applyInPandas(search, f"left_id {kind}, right_id {kind}, distance double")
    w = Window.partitionBy("left_id").orderBy("distance", "right_id")
    best = found.withColumns({"place": F.row_number().over(w), "second": F.lead("distance").over(w)}).filter("place = 1")
    good = best.filter(F.col("second").isNull() | (F.col("distance") < ratio * F.col("second")))
    back = Window.partitionBy("right_id").orderBy("distance", "left_id")
    return good.withColumn("place", F.row_number().over(back)).filter("place = 1").select("left_id", "right_id", "distance")


def paired_points(points: DataFrame, pairs: DataFrame, ratio: float = 0.8, rows: int = 512) -> DataFrame:
    """(a, b, from_point, to_point, over): of each pair of pictures, the points of the first that match one point of the second clearly better than any other: the best inner product is over 0 and leaves, short of 1, at
    most ``ratio`` of what the second best leaves. ``points``: picture, point, v (of unit length); ``pairs``: a, b.

    A picture is one row before it meets the pairs, so a task holds two pictures' points and nothing is compared outside a pair. A second picture with one point is distinct from nothing and matches nothing; points without a vector
    take no part; equal best points go to the smaller one, and then leave as much as the second best."""
    kinds = dict(points.dtypes)
    whole = points.filter("v IS NOT NULL").groupBy("picture").agg(F.sort_array(F.collect_list(F.struct("point", "v"))).alias("of"))
    packed = whole.select("picture", F.col("of.point").alias("point"), F.col("of.v").alias("v"))
    side = lambda name: packed.select(F.col("picture").alias(name), F.col("point").alias(f"{name}_point"), F.col("v").alias(f"{name}_v"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def match(batches):
        for pdf in batches:
            out = []
            for a, b, mine, u, theirs, v in zip(pdf["a"], pdf["b"], pdf["a_point"], pdf["a_v"], pdf["b_point"], pdf["b_v"]):
                if len(theirs) < 2:
                    continue
                to = np.stack(v).astype(float)
                for at in range(0, len(u), rows):
                    alike = np.stack(u[at : at + rows]).astype(float) @ to.T
                    best = alike.argmax(axis=1)
                    top, second = -np.partition(-alike, 1, axis=1)[:, :2].T
                    near, next_ = np.maximum(1 - top, 0), np.maximum(1 - second, 0)
                    over = np.where(next_ > 1e-9, near / np.maximum(next_, 1e-9), 1.0)
                    out += [(a, b, mine[at + i], theirs[best[i]], float(over[i])) for i in np.flatnonzero((top > 0) & (over <= ratio))]
            yield pd.DataFrame(out, columns=["a", "b", "from_point", "to_point", "over"])

    return both.mapInPandas(match, f"a {kinds['picture']}, b {kinds['picture']}, from_point {kinds['point']}, to_point {kinds['point']}, over double")


def consensus(matches: DataFrame, by: list[str], tolerance: float, tries: int = 64, seed: int = 0) -> DataFrame:
    """From matched points (ax, ay, bx, by_) of each pair: the affine map from samples of three that most matches agree on, refitted to those
    (m0 to m5, and how many agreed); pairs with fewer than three matches give none."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.column_stack([pdf["ax"], pdf["ay"], np.ones(len(pdf))])
        b = pdf[["bx", "by_"]].to_numpy(float)
        order = np.lexsort((b[:, 1], b[:, 0], a[:, 1], a[:, 0]))
        a, b = a[order], b[order]
        rng, best = np.random.default_rng(seed), None
        for _ in range(tries if len(a) >= 3 else 0):
            pick = rng.choice(len(a), 3, replace=False)
            if abs(np.linalg.det(a[pick])) < 1e-9:
                continue
            agree = np.hypot(*(a @ np.linalg.solve(a[pick], b[pick]) - b).T) <= tolerance
            if best is None or agree.sum() > best.sum():
                best = agree
        if best is None or best.sum() < 3:
            return pd.DataFrame(columns=[*by, "m0", "m1", "m2", "m3", "m4", "m5", "agreed"])
        m = np.linalg.lstsq(a[best], b[best], rcond=None)[0]
        return pdf[by].head(1).assign(**{f"m{i}": v for i, v in enumerate(m.T.ravel())}, agreed=int(best.sum()))

    kinds = dict(matches.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", " + ", ".join(f"m{i} double" for i in range(6)) + ", agreed long"
    return matches.select(*by, "ax", "ay", "bx", "by_").groupBy(*by).applyInPandas(fit, schema)
