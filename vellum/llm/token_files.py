"""Token counts: a separator scan over flat, unindexed token files.

A token file is nothing but ids of one width, each document's ended by a separator id. ``scan`` plans blocks of a fixed
number of tokens from the files' sizes, searches each block for separators with one vectorised comparison, and stitches the documents
that cross blocks with a prefix scan over the blocks of a file: how many separators came before, and where the last one was. The scan's window reads
three numbers a block (a file of a terabyte has half a million blocks); the separators' places stay in rows by block and meet the scan's result in a join
by file and block. No task holds more than a block of tokens.

``write`` makes such files from texts: one a task attempt, under names of their own, so that what a lost or repeated attempt wrote is never
read; only the files that finished tasks report count. Files are read and written by URI with pyarrow's file systems.

Defined results: null and empty texts are documents of no tokens; tokens after a file's last separator are a document with
``terminated`` false; an empty file has no documents; a file whose size isn't a multiple of the width raises an error;
repeated rows are documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import remove_folder, shared_folder
from .arrow import cut
from .tokens import WordTokenizer, default_tokenizer


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, separator: int = 49_407, dtype: str = "<u2") -> DataFrame:
    """Writes token files of ``docs`` (doc_id, text) below ``folder``; gives (file, bytes, ordinal, doc_id) for each document, written down for good."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        import os

        tok = WordTokenizer(path, ordinary_specials=True)
        name = f"{folder}/{uuid.uuid4().hex}.tokens"
        files, at = _filesystem(name)
        files.create_dir(os.path.dirname(at), recursive=True)
        ids, size, end = [], 0, np.array([separator], dtype).tobytes()
        with files.open_output_stream(at) as out:
            for batch in batches:
                ids += batch.column(0).to_pylist()
                for i in range(0, batch.num_rows, 500):
                    parts = []
                    for text in batch.column(1).slice(i, 500).to_pylist():
                        parts += (np.frombuffer(tok.ids(text), "<u4").astype(dtype).tobytes(), end)
                    size += out.write(b"".join(parts))
        yield pa.RecordBatch.from_pydict(
            {"file": pa.array([name] * len(ids), pa.string()), "bytes": pa.array([size] * len(ids), pa.int64()), "ordinal": pa.array(range(len(ids)), pa.int64()), "doc_id": pa.array(ids, pa.int64())}
        )

    return cut(docs.select("doc_id", "text").mapInArrow(run, "file string, bytes long, ordinal long, doc_id long"))


def scan(files: DataFrame, separator: int = 49_407, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """From (file, bytes): file, ordinal, start (in tokens), n_tokens and terminated of each document."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            ends = []
            for file, size, block in zip(cols["file"], cols["bytes"], cols["block"]):
                if size % width:
                    raise ValueError(f"{file} has {size} bytes, no multiple of {width}")
                system, at = _filesystem(file)
                with system.open_input_file(at) as source:
                    source.seek(block * block_tokens * width)
                    raw = source.read(min(block_tokens * width, size - block * block_tokens * width))
                ends.append(np.flatnonzero(np.frombuffer(raw, dtype) == separator) + block * block_tokens)
            yield pa.RecordBatch.from_pydict(cols | {"ends": pa.array(ends, pa.list_(pa.int64()))}, schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    blocks = files.filter("bytes > 0").select("file", F.col("bytes").cast("long").alias("bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / (width * block_tokens)))).alias("block"))
    found = cut(blocks.repartition("file", "block").mapInArrow(run, "file string, bytes long, block long, ends array<long>"))
    # the prefix scan: separators before a block, and the last of them
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    short = found.select("file", "bytes", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("end"))
    carried = F.coalesce(F.max("end").over(before), F.lit(-1))
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    rows = found.join(short.select("file", "block", carried.alias("last"), base.alias("base")), ["file", "block"])
    closed = rows.select("file", "base", "last", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("base") + F.col("i")).alias("ordinal"), (F.when(F.col("i") == 0, F.col("last")).otherwise(F.get("ends", F.col("i") - 1)) + 1).alias("start"), "end", F.lit(True).alias("terminated")
    )
    whole = short.groupBy("file", "bytes").agg(F.coalesce(F.max("end"), F.lit(-1)).alias("last"), F.sum("n").alias("n"))
    size = (F.col("bytes") / width).cast("long")
    tail = whole.filter(F.col("last") + 1 < size).select("file", F.col("n").alias("ordinal"), (F.col("last") + 1).alias("start"), size.alias("end"), F.lit(False).alias("terminated"))
    return closed.unionByName(tail).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "terminated")


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, start (its place in its token file) and terminated of each row, by writing token files to the shared folder, scanning them
    and removing them. The file's order gives each scanned document its id back."""
    folder = f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    written = write(docs, folder, tokenizer)
    found = scan(written.groupBy("file").agg(F.max("bytes").alias("bytes")))
    out = cut(written.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "terminated"))
    remove_folder(docs.sparkSession, folder)
    return out
