"""Watcher events into scan requests, by event time: a library's changed paths gather until nothing has happened for a quiet time; above a count, one full scan takes their place; after failures, retries come at
delays that double up to a limit and start anew after a success.

Within a micro-batch, events are gathered into runs by many tasks (library and stretch of time); a library's runs and results then meet and wait in its state until the watermark is past their quiet time, so the
requests follow from the events' times alone, not from how they were cut into batches. A run is its first and last time and its paths; of more than the count allows, one more is held, for a full scan names none.

Defined results: events later than the watermark are dropped, before they are gathered; repeated paths count once; a null path is an event without a path; an event exactly a quiet time after the one before begins a new request;
a success without a failure says nothing; at one time a success comes before a failure; libraries without events give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .replica import ROCKS

REQUESTS = "library string, due long, what string, paths array<string>, delay long"
_GATHERED = "library string, at timestamp, what string, first long, last long, paths array<string>"
#: Stretches of time that a library's events of a micro-batch are dealt out by: how many there are, and their length in quiet times.
STRETCHES, STRETCH = 64, 16


def runs_of(pdf, quiet: int, most: int) -> list[tuple[int, int, list[str]]]:
    """The runs (first, last, at most one path more than ``most``) of path events (at_ms, path) in any order: times less than ``quiet`` apart."""
    pdf = pdf.sort_values("at_ms")
    pdf["run"] = (pdf["at_ms"].diff() >= quiet).cumsum()
    ends = pdf.groupby("run")["at_ms"].agg(["first", "last"])
    different = pdf[["run", "path"]].dropna().drop_duplicates()
    paths = different[different.groupby("run").cumcount() <= most].groupby("run")["path"].agg(list).to_dict()
    return [(first, last, paths.get(run, [])) for run, first, last in zip(ends.index, ends["first"].tolist(), ends["last"].tolist())]


def joined(runs: list[tuple[int, int, list[str]]], quiet: int, most: int) -> list[tuple[int, int, list[str]]]:
    """Runs in order, those that overlap or are less than ``quiet`` apart as one."""
    out: list[tuple[int, int, set[str]]] = []
    for first, last, paths in sorted(runs, key=lambda r: r[:2]):
        if out and first - out[-1][1] < quiet:
            was = out[-1]
            if len(was[2]) <= most:
                was[2].update(paths)
            out[-1] = (was[0], max(was[1], last), was[2])
        else:
            out.append((first, last, set(paths)))
    return [(first, last, sorted(paths)[: most + 1]) for first, last, paths in out]


class Gather(StatefulProcessor):
    """A micro-batch's events, less those that came too late, as runs; holds nothing."""

    def __init__(self, quiet: int, most: int):
        self.quiet, self.most = quiet, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        runs, kept, other = [], 0, []
        for pdf in rows:
            path = pdf["what"] == "path"
            runs += runs_of(pdf.loc[path, ["at_ms", "path"]], self.quiet, self.most)
            other += [(w, a, a, []) for a, w in zip(pdf.loc[~path, "at_ms"].tolist(), pdf.loc[~path, "what"])]
            if len(runs) > 2 * kept + 10_000:
                runs = joined(runs, self.quiet, self.most)
                kept = len(runs)
        out = pd.DataFrame([("path", *r) for r in joined(runs, self.quiet, self.most)] + other, columns=["what", "first", "last", "paths"])
        out.insert(0, "at", pd.to_datetime(out["last"] + 1, unit="ms", utc=True))  # not before the last event's fraction of a millisecond
        out.insert(0, "library", key[0])
        yield out

    def close(self) -> None:
        pass


class Debounce(StatefulProcessor):
    def __init__(self, quiet: int, most: int, longest: int):
        self.quiet, self.most, self.longest = quiet, most, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long, paths array<string>")
        self.results = handle.getListState("results", "at long, what string")
        self.delay = handle.getValueState("delay", "delay long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        ends = []
        for pdf in rows:
            path = pdf["what"] == "path"
            runs = [(int(f), int(z), list(p)) for f, z, p in zip(pdf.loc[path, "first"], pdf.loc[path, "last"], pdf.loc[path, "paths"])]
            results = [(int(a), w) for a, w in zip(pdf.loc[~path, "last"], pdf.loc[~path, "what"])]
            if runs:
                self.runs.appendList(runs)
            if results:
                self.results.appendList(results)
            ends.append(int(pdf["last"].min()))
        if ends:
            self.handle.registerTimer(min(ends) + self.quiet)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        until, out = timerValues.getCurrentWatermarkInMs() - self.quiet, []
        runs = joined([(f, z, list(p)) for f, z, p in self.runs.get()], self.quiet, self.most) if self.runs.exists() else []
        for _, last, paths in runs:
            if last <= until:
                out.append((last + self.quiet, "full", [], 0) if len(paths) > self.most else (last + self.quiet, "paths", paths, 0))
        results = sorted(((a, w) for a, w in self.results.get()), key=lambda r: (r[0], r[1] == "failed")) if self.results.exists() else []
        delay = (self.delay.get() or (min(self.quiet, self.longest),))[0]
        for at, what in results:
            if at <= until and what == "failed":
                out.append((at + delay, "retry", [], delay))
                delay = min(2 * delay, self.longest)
            elif at <= until:
                delay = min(self.quiet, self.longest)
        self.delay.update((delay,))
        stay, left = [r for r in runs if r[1] > until], [r for r in results if r[0] > until]
        for state, rows in ((self.runs, stay), (self.results, left)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if stay or left:
            self.handle.registerTimer(min([r[1] for r in stay[:1]] + [r[0] for r in left[:1]]) + self.quiet)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in sorted(out)], columns=["library", "due", "what", "paths", "delay"])


def scan_requests(events: DataFrame, quiet: int = 2000, most: int = 500, longest: int = 300_000, late: str = "10 seconds") -> DataFrame:
    """``events``: library, at (timestamp), what (path, failed or ok), path. Gives REQUESTS; times in milliseconds."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stretch = F.expr(f"pmod(unix_millis(at) div {STRETCH * quiet}, {STRETCHES})").alias("stretch")
    rows = events.select("library", "at", "what", "path", F.unix_millis("at").alias("at_ms"), stretch).withWatermark("at", late)
    gathered = rows.groupBy("library", "stretch").transformWithStateInPandas(Gather(quiet, most), _GATHERED, "Append", "EventTime", eventTimeColumnName="at")
    return gathered.groupBy("library").transformWithStateInPandas(Debounce(quiet, most, longest), REQUESTS, "Append", "EventTime")
