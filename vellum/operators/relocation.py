"""Shoots whose folder was renamed outside, found again by the identity (device, inode) that a scan saw elsewhere, with the birth time as a second witness.

A folder that a shoot holds is no candidate, nor is one that an earlier shoot, by id, has claimed. Birth times agree where they are equal or either is unknown (null or 0). A shoot with just one candidate is
found; with several it is ambiguous and left. Two folders of one identity and birth time can't be told apart by anyone, so only a lone one ever counts, and what a task keeps of an identity is one row
a birth time, however many folders or shoots carry it.

Defined results: null devices or inodes match nothing; repeated directories count once; of repeated shoots the first claims; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relocated(shoots: DataFrame, dirs: DataFrame) -> DataFrame:
    """(id, path, target) of the shoots (id, path, dev, ino, birth) whose folder is gone and whose identity a directory (path, dev, ino, birth) alone carries."""
    birth = F.coalesce(F.col("birth").cast("long"), F.lit(0)).alias("birth")
    seen = dirs.dropDuplicates(["path"])
    free = seen.join(shoots.select("path"), "path", "left_anti").dropna(subset=["dev", "ino"]).select("path", "dev", "ino", birth)
    lone = free.groupBy("dev", "ino", "birth").agg(F.count("*").alias("n"), F.min("path").alias("target"))
    gone = shoots.dropna(subset=["dev", "ino"]).join(seen.select("path"), "path", "left_anti").select("id", "path", "dev", "ino", birth)
    gone = gone.join(lone.select("dev", "ino").distinct(), ["dev", "ino"], "left_semi")
    nothing = lambda df, *names: df.withColumns({n: F.lit(None).cast(gone.schema[n].dataType) for n in names})
    rows = nothing(lone.withColumn("asks", F.lit(False)), "id", "path").unionByName(gone.withColumns({"asks": F.lit(True), "n": F.lit(None).cast("long"), "target": F.lit(None).cast("string")}))
    dealt = rows.repartition("dev", "ino").sortWithinPartitions("dev", "ino", "asks", "id")
    return dealt.mapInArrow(_claims, gone.select("id", "path").withColumn("target", F.lit("")).schema)


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    identity, left, total = None, {}, 0
    for batch in batches:
        out = {"id": [], "path": [], "target": []}
        columns = (batch.column(c).to_pylist() for c in ("dev", "ino", "birth", "n", "target", "asks", "id", "path"))
        for dev, ino, birth, n, target, asks, id_, path in zip(*columns):
            if (dev, ino) != identity:
                identity, left, total = (dev, ino), {}, 0
            if not asks:
                left[birth] = (n, target)
                total += n
                continue
            # the birth times that agree with the shoot's
            agree = [b for b in (birth, 0) if b in left] if birth else list(left) if total == 1 else []
            if sum(left[b][0] for b in agree) == 1:
                for name, value in zip(out, (id_, path, left.pop(agree[0])[1])):
                    out[name].append(value)
                total -= 1
        yield pa.RecordBatch.from_arrays([pa.array(v, batch.schema.field("id").type if n == "id" else pa.string()) for n, v in out.items()], list(out))
