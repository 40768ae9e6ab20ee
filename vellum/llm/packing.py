"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

1. ``tokenize_pieces`` encodes each whole text, ends it with a separator id and cuts only longer documents, into
   pieces of the capacity; the last piece may be shorter.
2. Pieces of exactly the capacity are sequences already. The others are dealt row by row and packed best-fit decreasing
   inside each partition; sequences filled up to ``nearly_full`` are emitted.
3. Underfull sequences travel as single items, a list of pieces each (at most ``capacity`` of them, for each has a
   token), to fewer partitions, and are packed again, level by level, until one task's worth is left; that last level
   emits everything. The number of partitions follows the number of items, so that no task gets more than
   about ``items_per_task`` of them.
4. Best fit opens a sequence only for what fits into no other, so any two sequences of one partition hold more than the capacity together: at
   most one of them is filled by half or less, and no two that are filled by more can ever merge. Where a level leaves too many
   underfull sequences for fewer partitions, those over half are therefore emitted, and the others, at most one a partition, go on.
   That costs at most one sequence for each partition of such a level, about one in ``items_per_task`` items.

Every level is written to the shared checkpoint folder before the next reads it, so a lost executor can't give a part of a
level other sequences than the rest.

Defined results: null text is an empty text (its document is the separator alone); repeated rows are packed once each;
ties are ordered by doc_id, piece and checksum; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import by_size, cut
from .tokens import WordTokenizer, default_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()

    names = [c.split()[0] for c in PIECES.split(", ")]

    def run(batches):
        tok = WordTokenizer(path)
        end = array("I", [separator])
        if sys.byteorder == "big":
            end.byteswap()
        end, width = end.tobytes(), 4 * capacity
        for part in by_size(batches, "text"):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tok.ids_of(part.column("text"))):
                ids = ids.as_py() + end
                pieces = (ids[at : at + width] for at in range(0, len(ids), width))
                rows += [(doc_id, n, n * capacity, len(p) // 4, zlib.crc32(p)) for n, p in enumerate(pieces)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit for sizes in descending order: each goes to the fullest bin that has room. Gives the bins' item numbers.

    Bins are kept by room, so a step costs the search among the distinct rooms (at most ``capacity`` of them).
    """
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for item, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([item])
            number, room = len(bins) - 1, capacity - size
        else:
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            bins[number].append(item)
            room -= size
        if room > 0:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(number)
    return bins


_MEMBERS = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def _pack_level(items: DataFrame, capacity: int, keep_full: int, level: int) -> DataFrame:
    """Packs each partition's items (fill, members); ``done`` marks sequences filled to ``keep_full``."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        rows = [r for pdf in batches for r in zip(pdf["fill"], pdf["members"])]
        key = lambda r: (-r[0], *(-1 if m is None else m for m in (r[1][0]["doc_id"], r[1][0]["piece"], r[1][0]["ids_crc32"])))
        rows.sort(key=key)
        base = (level << 52) | (TaskContext.get().partitionId() << 32)
        bins = best_fit([int(r[0]) for r in rows], capacity)
        for at in range(0, len(bins), 2000):
            out = {"sequence_id": [], "fill": [], "done": [], "members": []}
            for number, chosen in enumerate(bins[at : at + 2000], at):
                fill, members = 0, []
                for item in chosen:
                    for m in rows[item][1]:
                        members.append({**m, "offset": fill + m["offset"]})
                    fill += int(rows[item][0])
                out["sequence_id"].append(base | number)
                out["fill"].append(fill)
                out["done"].append(fill >= keep_full)
                out["members"].append(members)
            yield pd.DataFrame(out)

    schema = f"sequence_id long, fill long, done boolean, members {_MEMBERS}"
    return items.select("fill", "members").mapInPandas(run, schema)


def dealt_evenly(items: DataFrame, parts: int, level: int) -> DataFrame:
    """Rows, written down already, dealt by a digest of their place: equal rows don't meet."""
    return items.withColumn("at", F.monotonically_increasing_id()).repartition(parts, F.xxhash64("at", F.lit(level)))


def pack(pieces: DataFrame, capacity: int = 2048, nearly_full: float = 0.999, items_per_task: int = 50_000, fan_in: int = 8) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``tokenize_pieces``."""
    keep_full = max(1, int(capacity * nearly_full))
    pieces = cut(pieces)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") >= capacity).select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.filter(F.col("length") < capacity).select(
        F.col("length").alias("fill"), F.array(F.struct(*cols, F.lit(0).cast("long").alias("offset"))).cast(_MEMBERS).alias("members")
    )
    count = items.count()
    parts = max(1, -(-count // items_per_task))
    level, done = 1, []
    while count:
        last = parts == 1
        packed = cut(_pack_level(dealt_evenly(items, parts, level), capacity, 0 if last else keep_full, level))
        done.append(packed.filter("done"))
        under = packed.filter("not done")
        left, half = packed.agg(F.count_if(~F.col("done")), F.count_if(~F.col("done") & (2 * F.col("fill") <= capacity))).first()
        if last or not left:
            break
        fewer = max(1, min(parts // fan_in, -(-left // items_per_task)), -(-left // items_per_task))
        if fewer >= parts:  # too many over half to go on together
            done.append(under.filter(2 * F.col("fill") > capacity))
            under, left, fewer = under.filter(2 * F.col("fill") <= capacity), half, max(1, -(-half // items_per_task))
        items, count, parts, level = under.select("fill", "members"), left, fewer, level + 1
    out = full
    for d in done:
        out = out.unionByName(d.select("sequence_id", F.inline("members")).select(*cols, "sequence_id", "offset"))
    return out


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048) -> DataFrame:
    return pack(tokenize_pieces(docs, tokenizer, capacity), capacity)
