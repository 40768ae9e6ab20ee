"""Hybrid logical clock stamps: 12 hex digits of milliseconds, 4 of a counter, then the peer's name. Stamps compare as text.

Defined results: null in, null out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COUNTER = 0xFFFF
#: Refuse what is further ahead than this.
MAX_SKEW_MS = 3_600_000


def encode(ms: Column, counter: Column, peer: Column) -> Column:
    return F.concat(F.lower(F.lpad(F.hex(ms), 12, "0")), F.lower(F.lpad(F.hex(counter), 4, "0")), peer)


def millis(stamp: Column) -> Column:
    return F.conv(F.substring(stamp, 1, 12), 16, 10).cast("long")


def counter(stamp: Column) -> Column:
    return F.conv(F.substring(stamp, 13, 4), 16, 10).cast("int")


def origin(stamp: Column) -> Column:
    return F.substr(stamp, F.lit(17))


def just_before(ms: Column) -> Column:
    """A stamp that sorts before all of a millisecond's."""
    return F.lower(F.lpad(F.hex(ms), 12, "0"))


def too_far_ahead(stamp: Column, now_ms: Column) -> Column:
    return millis(stamp) > now_ms + MAX_SKEW_MS


@dataclass
class Clock:
    """Mints stamps that rise whatever the wall clock does, and moves forward to what it observes."""

    peer: str
    last_ms: int = 0
    count: int = -1

    def _text(self) -> str:
        return f"{self.last_ms:012x}{self.count:04x}{self.peer}"

    def mint(self, wall_ms: int) -> str:
        if wall_ms > self.last_ms:
            self.last_ms, self.count = wall_ms, 0
        elif self.count >= MAX_COUNTER:
            self.last_ms, self.count = self.last_ms + 1, 0
        else:
            self.count += 1
        return self._text()

    def observe(self, stamp: str, wall_ms: int) -> None:
        ms, count = int(stamp[:12], 16), int(stamp[12:16], 16)
        if ms > wall_ms + MAX_SKEW_MS:
            raise ValueError("stamp is too far ahead")
        if (ms, count) > (self.last_ms, self.count):
            self.last_ms, self.count = ms, count
