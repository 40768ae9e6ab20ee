"""Snapshots of tables that are published by a manifest.

All files of a version are written first, each table in a folder of its own that no other version uses; then one small manifest, which names them, is renamed into place. A rename gives readers the old version or the
new one, whole; a run that is killed before it leaves folders that no manifest names. Readers pin a version once and read only what it names. A table that is carried over names the older version's folder.
Rotation first drops manifests, then the folders that none of those left names and that were begun before ``grace`` milliseconds ago, so a writer at work keeps its files.

Defined results: a folder without manifests has no version, and reading it is an error; two writers of one version: the first keeps it, the second is told; an empty table is a table; rotation with nothing to drop drops nothing.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.fs.exists(self._path(name)) else []

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d{12})\.json", n) for n in self._names("manifests")) if m)

    def manifest(self, version: int) -> dict:
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json").collect()))

    def write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Writes the tables' files and gives their folders; nothing refers to them yet."""
        folders = {}
        for name, df in tables.items():
            folders[name] = f"data/{int(time.time() * 1000):013d}-{uuid.uuid4().hex}/{name}"
            df.write.parquet(f"{self.folder}/{folders[name]}")
        return folders

    def publish(self, folders: dict[str, str], kind: str = "manual", carry: bool = False) -> int:
        """Names the folders in the next version. ``carry``: tables that are not given stay as in the version before."""
        known = self.versions()
        before = self.manifest(known[-1])["tables"] if carry and known else {}
        version = known[-1] + 1 if known else 1
        draft, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version:012d}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({"version": version, "kind": kind, "made": int(time.time() * 1000), "tables": before | folders}).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise FileExistsError(f"version {version} was published by another writer")
        return version

    def save(self, tables: dict[str, DataFrame], kind: str = "manual", carry: bool = False) -> int:
        return self.publish(self.write(tables), kind, carry)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest if none is given."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"no such version in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{self.manifest(known[-1] if version is None else version)['tables'][table]}")

    def rotate(self, keep: dict[str, int], grace: int = 3_600_000) -> list[int]:
        """Keeps the newest so many versions of each kind (all of a kind that isn't named), and the newest of all; gives the versions that went."""
        all_of = {v: self.manifest(v) for v in self.versions()}
        by_kind: dict[str, list[int]] = {}
        for v, m in all_of.items():
            by_kind.setdefault(m["kind"], []).append(v)
        gone = [v for kind, own in by_kind.items() if kind in keep for v in own[: max(0, len(own) - keep[kind])] if v != max(all_of)]
        for v in gone:
            self.fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        named = {f.split("/")[1] for v, m in all_of.items() if v not in gone for f in m["tables"].values()}
        for name in self._names("data"):
            if name not in named and int(name.split("-")[0]) < time.time() * 1000 - grace:
                self.fs.delete(self._path(f"data/{name}"), True)
        return sorted(gone)
