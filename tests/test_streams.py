import datetime
import random
import uuid

import pytest

from vellum.streaming import buckets, change_log, debounce, replica

KINDS = ["library", "shoot", "photo", "label", "photo_label"]


def stream_of(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def peer_log(seed, n):
    """Changes of three peers to small trees: photos in shoots, labels on photos, deletions of both, and changes to rows whose parent comes never."""
    rng, out = random.Random(seed), []
    for i in range(n):
        root = f"s{rng.randrange(4)}"
        stamp = f"{i // 3:012x}{rng.randrange(3):04x}{rng.choice(['p1', 'p2', 'p3']) * 8}"
        kind = rng.choice(["shoot", "photo", "photo", "photo_label"])
        row = root if kind == "shoot" else f"{kind[-1]}{rng.randrange(4)}"
        parent = {"shoot": (None, None), "photo": ("shoot", root), "photo_label": ("photo", f"o{row[1:]}")}[kind]
        deleted = rng.random() < 0.15
        out.append((root, kind, row, *parent, None if deleted else rng.choice(["place", "mark"]), stamp, None if deleted else str(rng.randrange(9)), deleted))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_ends_in_the_batch_merge(spark, tmp_path, seed):
    log = [r for r in peer_log(seed, 70) if seed == 1 or r[0] != "s1" or r[1] != "shoot"]
    want = sorted(map(tuple, replica.merged(spark.createDataFrame(log, replica.LOG), ["photo_label"]).collect()), key=repr)
    held = None
    for order in range(2):
        rows, at = list(log), str(tmp_path / uuid.uuid4().hex)
        random.Random(order).shuffle(rows)
        rows += rows[:9]  # repeats
        for i in range(0, len(rows), 27):
            put(spark, rows[i : i + 27], replica.LOG, f"{at}/log")
        shown = replica.stream_merge(stream_of(spark, replica.LOG, f"{at}/log"), KINDS, ["photo_label"])
        table = change_log.MergedTable(f"{at}/table", ["root", "kind", "row_id", "unit"], "seq", 4)
        run = table.start(shown, f"{at}/progress")
        run.awaitTermination()
        got = table.read(spark, table.table.written(spark)[-1])
        assert sorted((tuple(r)[:-1] for r in got.select("root", "kind", "row_id", "unit", "stamp", "value", "status", "seq").collect()), key=repr) == want
        vector = sorted(map(tuple, replica.coverage(got).collect()))
        assert held is None or vector == held
        held = vector
        waiting = [r["stamp"] for r in got.filter("status = 'waiting'").collect()]
        assert all(not any(w[16:] == origin and w <= stamp for w in waiting) for origin, stamp in vector)
    assert seed == 1 or any(r[-1] == "waiting" for r in want)


def test_rows_wait_for_their_parent_and_rings_for_ever(spark):
    log = [("r", "photo", "p", "shoot", "r", "place", "2", "x", False), ("r", "photo_label", "l", "photo", "p", None, "3", None, False), ("q", "photo", "a", "photo", "b", "u", "1", "", False), ("q", "photo", "b", "photo", "a", "u", "1", "", False)]
    status = lambda rows: {r[:4]: r[-1] for r in map(tuple, replica.merged(spark.createDataFrame(rows, replica.LOG)).collect())}
    assert set(status(log).values()) == {"waiting"}
    log.append(("r", "shoot", "r", None, None, "name", "9", "s", False))
    assert status(log) == {("r", "photo", "p", "place"): "applied", ("r", "photo_label", "l", ""): "applied", ("r", "shoot", "r", "name"): "applied", ("q", "photo", "a", "u"): "waiting", ("q", "photo", "b", "u"): "waiting"}
    log.append(("r", "photo", "p", None, None, None, "5", None, True))
    assert status(log)["r", "photo", "p", "place"] == "gone" and status(log)["r", "photo_label", "l", ""] == "waiting"
    assert replica.merged(spark.createDataFrame([], replica.LOG)).count() == 0


def plain_requests(events, quiet, most, longest):
    """A clock that ticks from event to event."""
    out, pending, last, delay = [], set(), None, min(quiet, longest)
    for at, what, path in [*sorted(events, key=lambda e: (e[0], ("ok", "failed", "path").index(e[1]))), (1 << 50, "ok", "")]:
        if last is not None and at - last >= quiet:
            out.append((last + quiet, "full" if len(pending) > most else "paths", [] if len(pending) > most else sorted(pending), 0))
            pending, last = set(), None
        if what == "path":
            pending.add(path)
            last = at
        elif what == "failed":
            out.append((at + delay, "retry", [], delay))
            delay = min(2 * delay, longest)
        else:
            delay = min(quiet, longest)
    return sorted(out)


def watch_events(seed, n):
    rng, out, at = random.Random(seed), [], 1_000_000
    for _ in range(n):
        at += rng.choice([1, 3, 10, 40, 50, 51, 200])
        out.append((at, rng.choice(["path"] * 8 + ["failed", "failed", "ok"]), f"f{rng.randrange(12)}"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_debounce_is_what_a_clock_gives(spark, tmp_path, seed):
    schema, folder = "library string, at timestamp, what string, path string", str(tmp_path / "log")
    logs = {lib: watch_events(seed * 10 + i, 50) for i, lib in enumerate("ab")}
    rows = sorted((at, lib, what, path) for lib, events in logs.items() for at, what, path in events)
    rng = random.Random(seed)
    for i in range(0, len(rows), 23):
        part = rows[i : i + 23]
        rng.shuffle(part)
        put(spark, [(lib, datetime.datetime.fromtimestamp(at / 1000, datetime.UTC), what, path) for at, lib, what, path in part], schema, folder)
    put(spark, [("end", datetime.datetime.fromtimestamp(2_000_000, datetime.UTC), "ok", "")], schema, folder)
    out = debounce.scan_requests(stream_of(spark, schema, folder), 50, 2, 300, "1 second")
    name = f"requests_{seed}"
    run = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {lib: sorted((r["due"], r["what"], r["paths"], r["delay"]) for r in spark.table(name).filter(f"library = '{lib}'").collect()) for lib in "ab"}
    assert got == {lib: plain_requests(events, 50, 2, 300) for lib, events in logs.items()}
    assert {r[1] for r in got["a"]} == {"paths", "full", "retry"}


def test_a_request_waits_until_nothing_can_join_it(spark, tmp_path):
    """A later event is no sign that a run is over while the watermark lets an event between them in."""
    schema, folder = "library string, at timestamp, what string, path string", str(tmp_path / "log")
    events = [(1000, "path", "p"), (1040, "path", "q"), (1095, "path", None), (1070, "path", "p")]
    for lib, part in (("a", events[:3]), ("b", [(1066, "path", "x")]), ("a", events[3:]), ("", [(2_000_000, "ok", "")])):
        put(spark, [(lib, datetime.datetime.fromtimestamp(at / 1000, datetime.UTC), what, path) for at, what, path in part], schema, folder)
    out = debounce.scan_requests(stream_of(spark, schema, folder), 50, 3, 300, "30 milliseconds")
    out.writeStream.format("memory").queryName("waiting").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("waiting").collect())) == [("a", 1145, "paths", ["p", "q"], 0), ("b", 1116, "paths", ["x"], 0)]


def test_buckets_keep_versions_and_clean(spark, tmp_path):
    table = buckets.BucketTable(str(tmp_path / "t"), ["k"], "k long, v string", 4)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert table.read(spark, -1).count() == 0
    one = rows(*((i, "a") for i in range(40)))
    table.write(one, table.touched(one), 0)
    only = table.touched(rows((7, "b")))
    table.write(table.read(spark, 0, only), only, 1)
    assert table.read(spark, 1).count() == 40 and len(only) == 1
    assert {b for b, at in table.named(spark, 1).items() if at == 1} == only
    table.write(rows(), only, 2)
    assert table.read(spark, 2, only).count() == 0 and table.read(spark, 1, only).count() > 0
    table.write(rows(), set(), 5)
    assert table.named(spark, 5) == table.named(spark, 2) and table.before(spark, 5) == 2
    kept = sorted(map(tuple, table.read(spark, 5).collect()))
    assert table.clean(spark, 5) == 2
    assert sorted(map(tuple, table.read(spark, 5).collect())) == kept and table.written(spark) == [5]
