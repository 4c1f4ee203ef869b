"""Report and package sinks: CSV, JSON and WAV exports with a manifest of hashes and of where they come from."""

from __future__ import annotations

import json
import platform
import subprocess
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmenta.functions.guards import isolated
from segmenta.sources.recordings import artifact_hashes, encode_wav


def provenance() -> dict:
    """Versions and, where there is one, the commit that made a report."""

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", *args], check=True, capture_output=True, text=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return "unavailable"

    return {"commit": git("rev-parse", "HEAD"), "changed": bool(git("status", "--porcelain").strip("unavailable")), "python": platform.python_version(), "spark": pyspark.__version__}


def plain(df: DataFrame) -> DataFrame:
    """df with NaN and infinite numbers as nulls, as JSON has neither."""
    number = (T.DoubleType, T.FloatType)
    return df.select(*[F.when(F.abs(F.col(f.name)) < float("inf"), F.col(f.name)).alias(f.name) if isinstance(f.dataType, number) else F.col(f.name) for f in df.schema])


def _put(spark: SparkSession, path: str, content: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(content.encode()))
    out.close()


def write_report(tables: dict[str, DataFrame], path: str, config: dict, source: str, formats: tuple[str, ...] = ("csv", "json")) -> DataFrame:
    """Write each table in each format below path, which must be new and apart from the source, then config.json and
    manifest.json; the manifest as a table: artifact, format, rows, sha256. Tables are written as Spark deals them."""
    isolated(source, path)
    spark = next(iter(tables.values())).sparkSession
    hashes = []
    for name, df in tables.items():
        for kind in formats:
            at = f"{path}/{name}.{kind}"
            writer = plain(df).write.mode("errorifexists")
            writer.option("header", "true").csv(at) if kind == "csv" else writer.json(at)
            rows = spark.read.option("header", "true").csv(at).count() if kind == "csv" else spark.read.schema(df.schema).json(at).count()
            digest = artifact_hashes(spark, at).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("sha256"))), 256).alias("h")).first().h  # a hash for each file
            hashes.append((f"{name}.{kind}", kind, rows, digest))
    _put(spark, f"{path}/config.json", json.dumps(config, sort_keys=True))
    _put(spark, f"{path}/manifest.json", json.dumps({"artifacts": [dict(zip(("artifact", "format", "rows", "sha256"), h, strict=True)) for h in hashes], **provenance()}, sort_keys=True))
    return spark.createDataFrame(hashes, "artifact string, format string, rows long, sha256 string")


def write_packages(segments: DataFrame, path: str, tracks: list[str], rate: int = 4000) -> DataFrame:
    """A WAV file for each segment (vec_id) and track, written by the executors under new names; manifest: vec_id, track, file,
    sha256."""
    from hashlib import sha256

    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        for batch in batches:
            out = []
            for track in tracks:
                for vec, x in zip(batch.column("vec_id").to_pylist(), batch.column(track).to_pylist(), strict=True):
                    content = encode_wav(x, rate)
                    name = f"{vec}-{track}-{uuid.uuid4().hex[:12]}.wav"
                    where, at = fs.FileSystem.from_uri(f"{path}/{name}")
                    where.create_dir(at.rpartition("/")[0], recursive=True)
                    with where.open_output_stream(f"{at}.tmp", compression=None) as f:
                        f.write(content)
                    where.move(f"{at}.tmp", at)
                    out.append((vec, track, name, sha256(content).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), *[pa.string()] * 3))], ["vec_id", "track", "file", "sha256"])

    return segments.select("vec_id", *tracks).mapInArrow(run, "vec_id long, track string, file string, sha256 string")
