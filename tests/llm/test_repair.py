import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import repair

COLS = "conv_id long, turn long, role string, text string, pos long, start string, code int, edits string"


def cheapest(rows):
    """(cost, letters, repaired lines) of rows (role, text, fault), by trying all edits."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(at, state, inserts):
        ways = [(0, "", ())] if at == len(rows) and state in ("", "a") else []
        if inserts < 3:
            for role, to in after[state].items():
                if role in names:
                    cost, letters, lines = best(at, to, inserts + 1)
                    ways.append((cost + 2, "I" + letters, (names[role] + ":", *lines)))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, letters, lines = best(at + 1, state, 0)
            ways.append((cost + 3, "D" + letters, lines))
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                if role[:1] in after[state] and role[:1]:
                    cost, letters, lines = best(at + 1, after[state][role[:1]], 0)
                    ways.append((cost + late, "K" + letters, (f"{role}:{text}", *lines)))
                for new in names:
                    if new in after[state]:
                        cost, letters, lines = best(at + 1, after[state][new], 0)
                        ways.append((cost + 2 + late, "R" + letters, (f"{names[new]}:{text}", *lines)))
        return min(ways, default=(1 << 40, "", ()))

    return best(0, "", 0)


def brute(table):
    spaced = lambda v: " " if v is None else str(v)
    convs = {r[0]: [] for r in table}
    for conv, turn, role, text in table:
        harm = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if harm == 4 else spaced(role), "" if harm == 1 else re.sub("[.!?]", "", spaced(text)) if harm == 2 else spaced(text)
        convs[conv] += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faulty = set(), []
        for _, role, text in rows:
            inner = text.strip(" \t\n\x0b\x0c\r")
            faulty.append((role, text, "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, letters, lines = cheapest(tuple(faulty))
        faults = [f for _, _, f in faulty]
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, table, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in table], COLS)
    got = repair.repair_digests(df, **options).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted(map(tuple, got.collect()), key=repr)


def tables(seed, convs, most):
    rng, out = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "user", "Assistant"]) if rng.random() < 0.4 else ("system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[turn % 2])
                text = rng.choice(["a.", "b!", "c", "d. \n", None, "", " \t", "e?\x0b", "é.", "f.", "g.", "h.", "."])
                out.append((conv if rng.random() < 0.98 else None, turn if rng.random() < 0.95 else rng.choice([None, turn - 1]), role, text))
    rng.shuffle(out)
    return out


def test_against_all_edits(spark):
    table = tables(1, 300, 9)
    want = brute(table)
    assert found(spark, table) == want
    assert found(spark, table, block=3) == want  # most conversations lie in several blocks


def test_long_conversations_over_blocks(spark):
    table = tables(2, 6, 160) + [(77, t, "user", "same.") for t in range(200)]
    want = brute(table)
    assert found(spark, table) == want
    assert found(spark, table, block=16) == want


def test_rows_that_are_all_gone_and_no_rows(spark):
    gone = [c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    table = [(c, 0, "user", "a.") for c in gone]
    assert found(spark, table) == brute(table)
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in found(spark, table))
    assert found(spark, []) == []


def test_repaired_rows_have_legal_roles(spark):
    table = tables(5, 80, 12)
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    numbered = repair.numbered_rows(rows)
    out = repair.repaired_rows(numbered, repair.solve(repair.row_codes(numbered), block=5))
    for r in out.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part", F.substring("role", 1, 1).alias("i")))).alias("all")).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(x["i"] for x in r["all"]))


def test_matrices_of_blocks_chain():
    rng = np.random.default_rng(3)
    codes = [rng.integers(0, 16, n).astype(np.int8) for n in (7, 1, 30, 12)]
    whole = repair.block_matrices([np.concatenate(codes)])[0]
    now = repair.block_matrices(codes)
    chained = repair._times(repair._times(repair._times(now[0], now[1]), now[2]), now[3])
    assert (np.minimum(chained, repair._FAR) == whole).all()
