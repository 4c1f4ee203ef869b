"""Sources and sinks: WAV, annotation TSV, metadata CSV, manifests and inventories."""

from __future__ import annotations

import io
import math
import re
import struct
import tempfile
import uuid
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = "start double, end double, state int"
_STEM = "([^/]+)[.][a-z]+$"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder; where none is set, on this machine, if it is the only one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def encode_wav(samples, rate: int = 4000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode_wav(content: bytes) -> dict:
    """Samples in -1..1 as mono, with what the header says; the error instead, if it can't be read."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            n, ch, width, rate = w.getnframes(), w.getnchannels(), w.getsampwidth(), w.getframerate()
            kind = {1: "u1", 2: "<i2", 4: "<i4"}[width]
            x = np.frombuffer(w.readframes(n), kind).astype(np.float64)
    except (wave.Error, EOFError, KeyError, struct.error) as e:
        return {"sample_rate": None, "channels": None, "n_frames": None, "signal": None, "error": type(e).__name__}
    x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
    return {"sample_rate": rate, "channels": ch, "n_frames": n, "signal": x.reshape(-1, ch).mean(1).tolist() if ch else [], "error": None if n else "empty"}


def resampled(x, rate: int, target: int) -> np.ndarray:
    """Samples at another rate, by a windowed-sinc filter between the two; the length is rounded up."""
    x = np.asarray(x, np.float64)
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    if up == down or not len(x):
        return x
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    n = -(-len(x) * up // down)
    # Each output sample meets every up-th tap of the filter.
    at = np.arange(n) * down + half
    first = at // up
    taps = (2 * half) // up + 1
    place = first[:, None] - np.arange(taps)
    tap = at[:, None] - place * up
    ok = (place >= 0) & (place < len(x)) & (tap >= 0) & (tap < len(h))
    return (np.where(ok, x[np.clip(place, 0, len(x) - 1)], 0.0) * np.where(ok, h[np.clip(tap, 0, len(h) - 1)], 0.0)).sum(1)


def inspect_wav(head: bytes, size: int) -> dict:
    """What a WAV file's header says, by its first bytes and its length; samples aren't looked at."""
    none = {"sample_rate": None, "channels": None, "n_frames": None}
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return none | {"error": "not_wav"}
    at, form = 12, None
    while at + 8 <= len(head):
        name, n = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 24 <= len(head):
            form = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
        if name == b"data":
            if form is None or not form[4]:
                return none | {"error": "no_format"}
            frames = n // form[4]
            return {"sample_rate": form[2], "channels": form[1], "n_frames": frames, "error": "empty" if not frames else "truncated" if at + 8 + n > size else None}
        at += 8 + n + n % 2
    return none | {"error": "no_data"}


def inspected(content, length=None):
    """The header's columns of WAV contents; only the first 64 KiB go to Python."""

    def run(head: pd.Series, size: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([inspect_wav(bytes(h), int(n)) for h, n in zip(head, size, strict=True)], columns=["sample_rate", "channels", "n_frames", "error"]).astype({"sample_rate": "Int32", "channels": "Int32", "n_frames": "Int64"})

    c = F.col(content)
    return F.pandas_udf(run, "sample_rate int, channels int, n_frames long, error string")(F.substring(c, 1, 1 << 16), F.length(c) if length is None else F.col(length))


def read_wav(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """recording_id, sample_rate, channels, n_frames, signal, error of every WAV file below a path; at another rate if one is given."""

    def _decoded(content: pd.Series) -> pd.DataFrame:
        rows = [decode_wav(bytes(c)) for c in content]
        for r in rows:
            if rate and r["signal"] and r["sample_rate"] != rate:
                r["signal"], r["sample_rate"] = resampled(r["signal"], r["sample_rate"], rate).tolist(), rate
        return pd.DataFrame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    decoded = F.pandas_udf(_decoded, "sample_rate int, channels int, n_frames long, signal array<double>, error string")
    return files.select(F.regexp_extract("path", _STEM, 1).alias("recording_id"), decoded("content").alias("w")).select("recording_id", "w.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Headerless annotation files, typed, with the recording each belongs to."""
    rows = spark.read.schema(ANNOTATION).option("sep", "\t").option("pathGlobFilter", "*.tsv").option("recursiveFileLookup", "true").csv(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), _STEM, 1).alias("recording_id"), "start", "end", "state")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Recordings by their files; contents aren't read, as the column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", _STEM, 1).alias("recording_id"), F.regexp_extract("path", "[.]([a-z]+)$", 1).alias("kind"), "length")
    g = files.groupBy("recording_id").agg(F.max(F.when(F.col("kind") == "wav", F.col("length"))).alias("wav_bytes"), F.max(F.when(F.col("kind") == "tsv", F.col("length"))).alias("tsv_bytes"))
    return g.withColumn("paired", F.col("wav_bytes").isNotNull() & F.col("tsv_bytes").isNotNull())


def artifact_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("artifact"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Each artifact that a manifest names and whether what is there has its hash."""
    got = found.withColumnRenamed("sha256", "found")
    return manifest.join(got, "artifact", "left").select("artifact", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("verified"))
