"""Small helpers for Arrow-batched Spark tasks and for cutting lineage in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.graph import checkpointed

#: Bytes that part words: space and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Entries a per-worker word table may hold before it starts anew.
CACHE_ENTRIES = 200_000
#: Rows that a function over Arrow batches gets at once, which bounds what it holds as Python objects.
STEP_ROWS = 400


class WordTable(dict):
    """A per-process table word -> value, computed at the first sight of a word and bounded in size."""

    def __init__(self, make: Callable[[bytes], object], most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.make(word)
        return value


def word_hashes() -> WordTable:
    return WordTable(xxhash.xxh3_64_intdigest)


def hash_words(words: list[bytes], table: WordTable) -> np.ndarray:
    """64-bit hashes of the words, the same on every machine."""
    return np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))


def by_size(batches: Iterator[pa.RecordBatch], column: str, rows: int = 1000, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, beyond one row, ``most`` bytes of a string column."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + most, "right"))))
            yield batch.slice(at, end - at)
            at = end


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Runs a function over Arrow batches. ``make`` is called once in each task; its result turns column lists into column lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                out = step({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there, so that lost executors don't repeat what led to them."""
    return checkpointed(df)


def cut_dense(df: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """``cut`` for rows of a few numbers: read by as many tasks as the rows are worth, so that small tables don't cost each later shuffle many small files."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return kept.coalesce(max(1, -(-seen.get["n"] // rows_per_task)))
