"""Size-tiered compaction of immutable shards under a versioned manifest.

An arrival is appended as a run of small shards. Runs of similar size share a tier (each tier ``fanout`` times the one
below); once a tier holds ``fanout`` runs, they are merged into one run of target-sized files, so a row is rewritten once a
tier. Each step ends by a manifest of the next version, which appears whole or not at all and only if no other writer has that
version; there is no lock, so a writer that is lost leaves nothing that stops the next. Of two writers the later one reads the
new version and tries again. Readers use the
highest version and never see half a step. Old shards go only when no kept version names them.

Contract: all rows and columns are kept as they are, nulls, repeated rows and columns of any name included; an empty arrival
adds a run without rows; the order of rows isn't kept. ``read`` adds the column ``shard``, with underscores behind it where that
name is taken.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmenta.llm.store import _path, new_path, read_small, write_new


class Conflict(RuntimeError):
    """Another writer has that version."""


@dataclass
class TieredStore:
    spark: SparkSession
    root: str
    target_bytes: int = 128 << 20
    base_bytes: int = 16 << 20
    fanout: int = 4
    _sizes: dict[str, int] = field(default_factory=dict)

    def _names(self, folder: str) -> dict[str, float]:
        """What a folder of the store holds, and when each was last changed."""
        f, p = _path(self.spark, f"{self.root}/{folder}")
        return {str(x.getPath().getName()): x.getModificationTime() / 1000 for x in f.listStatus(p)} if f.exists(p) else {}

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for x in self._names("manifest") if (m := re.fullmatch(r"v(\d+)\.json", x)))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "runs": []}
        return json.loads(read_small(self.spark, f"{self.root}/manifest/v{version or known[-1]:08d}.json"))

    def commit(self, seen: dict, runs: list[dict]) -> dict:
        """The next version; fails if another writer has taken it since ``seen`` was read."""
        after = {"version": seen["version"] + 1, "runs": runs}
        if not write_new(self.spark, f"{self.root}/manifest/v{after['version']:08d}.json", json.dumps(after)):
            raise Conflict(f"another writer committed version {after['version']}")
        return after

    def tier(self, n_bytes: int) -> int:
        return max(0, math.floor(math.log(max(1, n_bytes) / self.base_bytes, self.fanout)) + 1) if n_bytes >= self.base_bytes else 0

    def _run(self, path: str) -> dict:
        f, p = _path(self.spark, path)
        size = int(f.getContentSummary(p).getLength())
        return {"path": path, "bytes": size, "tier": self.tier(size)}

    def append(self, arrival: DataFrame) -> dict:
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        arrival.write.option("compression", "zstd").parquet(path)
        return self.adopt(path)

    def adopt(self, path: str) -> dict:
        """Append shards that are written already; merge the tiers that this fills."""
        run = self._run(path)
        while True:
            now = self.manifest()
            try:
                now = self.commit(now, [*now["runs"], run])
                break
            except Conflict:
                continue
        while full := [t for t in {r["tier"] for r in now["runs"]} if sum(r["tier"] == t for r in now["runs"]) >= self.fanout]:
            now = self.merge(now, min(full))
        return now

    def merge(self, now: dict, tier: int) -> dict:
        runs = [r for r in now["runs"] if r["tier"] == tier]
        rows = self.spark.read.parquet(*[r["path"] for r in runs])
        size = sum(r["bytes"] for r in runs)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.coalesce(max(1, -(-size // self.target_bytes))).write.option("compression", "zstd").parquet(path)  # joins scan splits; no shuffle
        merged = self._run(path)
        merged["tier"] = max(merged["tier"], tier + 1)
        while True:
            try:
                return self.commit(now, [*[r for r in now["runs"] if r not in runs], merged])
            except Conflict:
                now = self.manifest()
                if any(r not in now["runs"] for r in runs):  # another writer merged one of them
                    self._delete(path)
                    return now

    def _delete(self, path: str) -> None:
        f, p = _path(self.spark, path)
        f.delete(p, True)

    def vacuum(self, keep: int = 1, orphans_after_s: float | None = None) -> None:
        """Drop manifests but the last ``keep`` and the runs that only the dropped ones name; and, if asked for, what lost writers
        left: files of the store that no version names and that have been unchanged for so long."""
        known = self.versions()
        kept = {r["path"] for v in known[-keep:] for r in self.manifest(v)["runs"]}
        old = {r["path"] for v in known[:-keep] for r in self.manifest(v)["runs"]} - kept
        for at in [*old, *(f"{self.root}/manifest/v{v:08d}.json" for v in known[:-keep])]:
            self._delete(at)
        here = f"/{self.root.rstrip('/').rpartition('/')[2]}/data/"  # paths may come back with their scheme written otherwise
        named = {r.rpartition(here)[2].partition("/")[0] for r in kept}
        for folder in ("data", "manifest") if orphans_after_s is not None else ():
            for name, changed in self._names(folder).items():
                if name not in named and not re.fullmatch(r"v\d+\.json", name) and time.time() - changed >= orphans_after_s:
                    self._delete(f"{self.root}/{folder}/{name}")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the shard each stands in."""
        rows = self.spark.read.parquet(*[r["path"] for r in self.manifest(version)["runs"]])
        return rows.withColumn(_free("shard", rows), F.col("_metadata.file_name"))


def _free(name: str, rows: DataFrame) -> str:
    """The name, with underscores behind it until no column has it."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def compacted(docs: DataFrame, arrivals: int = 8, target_bytes: int = 128 << 20, base_bytes: int = 1 << 20) -> tuple[TieredStore, int]:
    """Bring in a table as arrivals dealt by doc_id, compacting as they come; the store and its last version."""
    spark = docs.sparkSession
    store = TieredStore(spark, new_path(spark, "tiered"), target_bytes, base_bytes)
    dealt, arrival = f"{store.root}/data/arrivals", _free("arrival", docs)
    docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))).write.partitionBy(arrival).option("compression", "zstd").parquet(dealt)
    f, p = _path(spark, dealt)
    for status in sorted((str(x.getPath()) for x in f.listStatus(p) if x.isDirectory())):
        store.adopt(status)
        store.vacuum()
    if not store.versions():
        store.append(docs)
    return store, store.versions()[-1]
