"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``, by a time-major dynamic programme over tensors.

Rows get places by conversation and turn (dealt by range, so no task sees a whole long conversation), and every 4,096 places are a block. A conversation's rows in a block are one short array of codes (role initial and
first fault). Tasks bucket those arrays by length and fill tensors (turn, conversation, state): costs run backward over turns, all conversations of a bucket at once, each turn by one gather of
4 x 4 matrices; then edits are traced forward, all conversations a step at a time. The four states are: nothing yet, after a system turn, after a user turn, after an assistant turn.

A conversation that lies in several blocks is put together by the blocks' (min, +) matrices: one fold over 16 numbers a block gives what follows a block, its trace from each of the four states
is made by a task as of any other block, and a fold over four exit states a block picks the one that holds. So one conversation with a third of all rows is the work of many tasks.

Edits, with their letters: Keep costs 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate rows can only be deleted), Insert an empty user or assistant turn 2; a truncated row that is not deleted costs 1 more. Of several cheapest
ways the one with the ASCII-least letters is taken; letters decide all roles.

Defined results: null roles and texts are one space; null turns come first; rows of one turn are ordered by role and text; conversations with a null id are one conversation; a role that doesn't begin with s, u or a, the empty one
too, can't be kept; repeated rows are duplicates; a conversation whose rows are all gone keeps its id with zeros, no edits and the hash of nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import positions
from .arrow import cut

BLOCK = 4096
#: Cells of (turn, conversation) in a tensor.
_CELLS = 1 << 18
_SPACES = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: State after a user or assistant turn is made, by state; what a kept row of class s, u, a leads to (-1: not allowed).
_MADE = np.array([2, 2, 3, 2])
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1] * 4])
#: What is left to pay at the end, by state: the turns that a whole pair still lacks.
_END = np.array([0, 4, 2, 0])
_PAD = 16


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product of matrices in the last two axes."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(-2)


def _matrices() -> np.ndarray:
    """For each code (class + 4 * fault, and padding) the cost from a state before a row, where turns may be inserted, to one after it."""
    insert = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for s, made in enumerate(_MADE):
        insert[s, made] = 2
    insert = np.minimum(_times(insert, insert), _FAR)
    out = np.full((_PAD + 1, 4, 4), _FAR)
    for code in range(_PAD):
        kind, fault = code % 4, code // 4
        for s in range(4):
            out[code, s, s] = 3
            if fault not in (BLANK, DUPLICATE):
                late = int(fault == TRUNCATED)
                out[code, s, _MADE[s]] = min(out[code, s, _MADE[s]], 2 + late)
                if (to := _KEPT[kind, s]) >= 0:
                    out[code, s, to] = min(out[code, s, to], late)
        out[code] = np.minimum(_times(insert, out[code]), _FAR)
    out[_PAD] = np.where(np.eye(4, dtype=bool), 0, _FAR)
    return out


_COSTS = _matrices()


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of arrays by length: up to double the shortest of a bucket, and so many that a tensor stays small."""
    order = np.argsort(lengths, kind="stable")
    first = 0
    while first < len(order):
        most = max(1, 2 * int(lengths[order[first]]))
        last = int(np.searchsorted(lengths[order], most, "right"))
        last = min(last, first + max(1, _CELLS // most))
        yield order[first:last]
        first = last


def _time_major(codes: list[np.ndarray]) -> np.ndarray:
    out = np.full((max(map(len, codes)), len(codes)), _PAD, np.int8)
    for i, own in enumerate(codes):
        out[: len(own), i] = own
    return out


def block_matrices(codes: list[np.ndarray]) -> np.ndarray:
    """The cost of each array of codes from each state to each other."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for chosen in _buckets(np.array(list(map(len, codes)))):
        turns = _time_major([codes[i] for i in chosen])
        now = np.broadcast_to(_COSTS[_PAD], (len(chosen), 4, 4))
        for at in range(len(turns) - 1, -1, -1):
            now = np.minimum(_times(_COSTS[turns[at]], now), _FAR)
        out[chosen] = now
    return out


def trace(codes: list[np.ndarray], ends: np.ndarray, entries: np.ndarray, last: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each array of codes, begun in the state ``entries`` and followed by the costs ``ends`` by state: its edits (letter and role initial each), exit state and cost.
    ``last``: whether the conversation ends with it."""
    edits, exits, costs = [""] * len(codes), np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    for chosen in _buckets(np.array(list(map(len, codes)))):
        own, lengths = [codes[i] for i in chosen], np.array([len(codes[i]) for i in chosen])
        turns = _time_major(own)
        back = np.empty((len(turns) + 1, len(chosen), 4), np.int64)
        back[-1] = ends[chosen]
        for at in range(len(turns) - 1, -1, -1):
            back[at] = (_COSTS[turns[at]] + back[at + 1][:, None, :]).min(-1)
        found, state = _forward(turns, back, lengths, entries[chosen], last[chosen])
        costs[chosen], exits[chosen] = back[0, np.arange(len(chosen)), entries[chosen]], state
        for i, e in zip(chosen.tolist(), found):
            edits[i] = e
    return edits, exits, costs


def _forward(turns, back, lengths, entries, last) -> tuple[list[str], np.ndarray]:
    at, state, on = np.zeros(len(entries), np.int64), entries.copy(), np.arange(len(entries))
    steps = []
    while len(on):
        t, s = at[on], state[on]
        inside, row = t < lengths[on], np.arange(len(on))
        code = turns[np.minimum(t, len(turns) - 1), on]
        kind, fault = code % 4, code // 4
        now, after = back[t, on, s], back[np.minimum(t + 1, len(turns)), on]
        made, kept, late = _MADE[s], _KEPT[kind, s], (fault == TRUNCATED).astype(np.int64)
        drop = inside & (3 + after[row, s] == now)
        insert = ~drop & np.where(inside, 2 + back[t, on, made] == now, last[on] & (now > 0))
        keep = inside & ~drop & ~insert & (kept >= 0) & ((fault == 0) | (fault == TRUNCATED)) & (late + after[row, kept] == now)
        rerole = inside & ~drop & ~insert & ~keep
        to = np.where(insert | rerole, made, np.where(keep, kept, s))
        pair = np.zeros((len(entries), 2), np.uint8)
        pair[on, 0] = np.select([drop, insert, keep, rerole], list(b"DIKR"), 0)
        pair[on, 1] = np.where(drop, ord("-"), np.frombuffer(b"-sua", np.uint8)[to])
        steps.append(pair)
        state[on], at[on] = to, t + (inside & ~insert)
        on = on[inside | insert]
    pairs = np.stack(steps, axis=1)  # the last step of each is where it stops
    count = (pairs[:, :, 0] > 0).sum(1)
    return [p[:n].tobytes().decode() for p, n in zip(pairs, count.tolist())], state


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, by the checksum of conversation and turn modulo 20."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(harm == 4, "user").otherwise(text_of("role"))
    times = F.array_repeat(F.lit(0), F.when(harm == 3, 2).otherwise(1))
    return rows.filter(harm != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def numbered_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos): places over all rows, by conversation and turn."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("turn").isNotNull().alias("dated"), F.monotonically_increasing_id().alias("tie"))
    return cut(positions(plain, ["conv_id", "dated", "turn", "role", "text", "tie"], "pos")).drop("dated", "tie")


def row_codes(numbered: DataFrame) -> DataFrame:
    """(conv_id, pos, code): role initial (s, u, a, other as 0 to 3) and four times the first fault."""
    trimmed, initial = F.rtrim(F.col("text"), F.lit(_SPACES)), F.substring("role", 1, 1)
    ended = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    narrow = numbered.select(
        "conv_id", "pos", F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")).alias("said"), F.when(trimmed == "", BLANK).when(~ended, TRUNCATED).otherwise(0).alias("fault"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
    )
    first = narrow.groupBy("conv_id", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return narrow.join(first, "pos", "left").select("conv_id", "pos", (F.col("kind") + 4 * fault).cast("tinyint").alias("code"))


def blocks_of(codes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(conv_id, start, codes), a conversation's codes in a block of places, and the conversations of several blocks."""
    whole = codes.groupBy("conv_id", F.expr(f"pos div {block}").alias("block")).agg(F.min("pos").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("all"))
    blocks = cut(whole.select("conv_id", "start", F.transform("all", lambda x: x["code"]).alias("codes")))
    several = blocks.groupBy("conv_id").agg(F.min("start").alias("start"), F.max("start").alias("end")).filter("start <> end")
    return blocks, several


def _array_of(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(column) else []


def _matrix_rows(batches):
    for batch in batches:
        if batch.num_rows:
            codes = _array_of(batch.column(2))
            flat = list(block_matrices(codes).reshape(len(codes), 16))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int64())), pa.array([int(c[0]) % 4 for c in codes], pa.int32()), pa.array([int(c[-1]) % 4 for c in codes], pa.int32())], names=["conv_id", "start", "costs", "first", "last"]
            )


def _illegal(kinds: np.ndarray) -> int:
    """Adjacent pairs other than su, ua and au."""
    a, b = kinds[:-1], kinds[1:]
    return int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())


def _fold_back(pdf):
    """What follows each block, from the last to the first, and whether two blocks meet in an illegal pair."""
    import pandas as pd

    pdf = pdf.sort_values("start")
    now, out = _END, []
    for costs in reversed(pdf["costs"].tolist()):
        out.append(now)
        now = (np.asarray(costs, np.int64).reshape(4, 4) + now).min(1)
    joints = [0, *(_illegal(np.array(pair)) for pair in zip(pdf["last"].tolist(), pdf["first"].tolist()[1:]))]
    place = range(len(pdf))
    return pd.DataFrame({"start": pdf["start"], "ends": out[::-1], "begins": [i == 0 for i in place], "closes": [i == len(pdf) - 1 for i in place], "joint": joints})


def _fold_forth(pdf):
    """The state in which each block begins, from the first to the last."""
    import pandas as pd

    exits = {(s, e): x for s, e, x in zip(pdf["start"].tolist(), pdf["entry"].tolist(), pdf["exit"].tolist())}
    starts, state, out = sorted({s for s, _ in exits}), 0, []
    for s in starts:
        out.append(state)
        state = exits[s, state]
    return pd.DataFrame({"start": starts, "entry": out})


_TRACED = "start long, entry int, exit int, edits string, cost long, blank long, duplicate long, truncated long, illegal long, several boolean"


def _traced_rows(batches):
    names = [c.split()[0] for c in _TRACED.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        codes, several = _array_of(col["codes"]), col["ends"].is_valid().to_numpy(zero_copy_only=False)
        begins, closes = (col[n].fill_null(True).to_numpy(zero_copy_only=False) for n in ("begins", "closes"))
        ends = np.array([_END if e is None else e for e in col["ends"].to_pylist()], np.int64)
        of = np.repeat(np.arange(len(codes)), np.where(begins, 1, 4))
        entry = np.arange(len(of)) - np.searchsorted(of, of)
        edits, exits, cost = trace([codes[i] for i in of], ends[of], entry, closes[of])
        faults = [c // 4 for c in codes]
        counts = [np.array([int((f == kind).sum()) for f in faults])[of] for kind in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = (np.array([_illegal(c % 4) for c in codes]) + col["joint"].fill_null(0).to_numpy(zero_copy_only=False))[of]
        values = [col["start"].take(pa.array(of)), entry, exits, edits, np.where(begins[of], cost, 0), *counts, illegal, several[of]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) if not isinstance(v, pa.Array) else v for v, k in zip(values, kinds)], names=names)


def solve(codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """From (conv_id, pos, code) with places in the order of conversations: one row (conv_id, start, edits, cost, blank, duplicate, truncated, illegal) for each conversation and block; the cost stands at its first."""
    blocks, several = blocks_of(codes, block)
    kind = dict(blocks.dtypes)["conv_id"]
    long = blocks.alias("b").join(several.alias("s"), F.expr("b.conv_id <=> s.conv_id"), "left_semi")
    matrices = long.select("conv_id", "start", "codes").mapInArrow(_matrix_rows, f"conv_id {kind}, start long, costs array<long>, first int, last int")
    follows = cut(matrices.groupBy("conv_id").applyInPandas(_fold_back, "start long, ends array<long>, begins boolean, closes boolean, joint long"))
    traced = blocks.join(follows, "start", "left").select("start", "codes", "ends", "begins", "closes", "joint").mapInArrow(_traced_rows, _TRACED)
    traced = cut(traced)
    conv = blocks.select("start", "conv_id")
    entries = traced.filter("several").join(conv, "start").select("conv_id", "start", "entry", "exit").groupBy("conv_id").applyInPandas(_fold_forth, "start long, entry int")
    whole = traced.filter("NOT several").unionByName(traced.filter("several").join(entries, ["start", "entry"], "left_semi"))
    return cut(whole.join(conv, "start").select("conv_id", "start", "edits", "cost", "blank", "duplicate", "truncated", "illegal"))


def _role(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


def repaired_rows(numbered: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, pos, part, edit, role, text): the rows that the edits leave and insert, in the order of pos and part."""
    own = solved.select("start", F.posexplode(F.regexp_extract_all("edits", F.lit("((?:I.)*[KRD].(?:(?:I.)+$)?)"), F.lit(1))))
    edits = own.select((F.col("start") + F.col("pos")).alias("pos"), "col")
    each = numbered.join(edits, "pos").select("*", F.posexplode(F.regexp_extract_all("col", F.lit("([IKR].)"), F.lit(1))).alias("part", "pair"))
    edit, made = F.substring("pair", 1, 1), _role(F.substring("pair", 2, 1))
    return each.select("conv_id", "pos", "part", edit.alias("edit"), F.when(edit == "K", F.col("role")).otherwise(made).alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))


def _line_hashes(batches):
    """One digest a conversation over its lines as they come, in the order of places."""
    now, conv = None, None
    done = {"conv_id": [], "repaired_sha256": []}

    def close():
        if now is not None:
            done["conv_id"].append(conv)
            done["repaired_sha256"].append(now.hexdigest())

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for one, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if now is None or one != conv:
                close()
                now, conv = hashlib.sha256(line.encode()), one
            else:
                now.update(b"\n" + line.encode())
        if done["conv_id"]:
            yield pa.RecordBatch.from_arrays([pa.array(done["conv_id"], kind), pa.array(done["repaired_sha256"], pa.string())], names=list(done))
            done = {n: [] for n in done}
    close()
    if done["conv_id"]:
        yield pa.RecordBatch.from_arrays([pa.array(done["conv_id"], kind), pa.array(done["repaired_sha256"], pa.string())], names=list(done))


def repair_digests(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each original conversation: gaps, faults, illegal pairs, cost and letters of the edits, and a digest of the repaired rows."""
    numbered = numbered_rows(damage(rows))
    solved = solve(row_codes(numbered), block)
    lines = repaired_rows(numbered, solved).select("conv_id", F.concat_ws(":", "role", "text").alias("line"), "pos", "part")
    kind = dict(rows.dtypes)["conv_id"]
    hashes = lines.repartition("conv_id").sortWithinPartitions("pos", "part").select("conv_id", "line").mapInArrow(_line_hashes, f"conv_id {kind}, repaired_sha256 string")
    turns = numbered.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "edits"))), lambda x: x["edits"]), "")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    total = solved.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in sums), F.regexp_replace(letters, "([IKRD]).", "$1").alias("audit"))
    out = rows.select("conv_id").distinct()
    for more in (turns, total, hashes):
        out = out.join(more.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *sums)), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
