"""Shared storage of the operators: one folder that the driver and all executors see.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a temporary folder
is set; on a cluster that is an error. Tables are written by Spark's committers. Other files are written by executors through ``pyarrow.fs`` under a
name of the attempt and renamed when whole, so that a lost executor leaves at most an unused temporary file.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, without a trailing slash."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="segmenta-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it again: cuts the lineage, and what follows never computes it twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path that exists, so that it can be listed even if nothing is written there."""
    path = new_path(spark, name)
    f, p = _path(spark, path)
    f.mkdirs(p)
    return path


def drop(*tables: DataFrame | tuple[SparkSession, str]) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        spark, path = t if isinstance(t, tuple) else (t.sparkSession, t._stored_at)
        f, p = _path(spark, path)
        f.delete(p, True)


def write_new(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file in one step that either shows it whole or, where the name is taken, changes nothing; False then.

    A rename that doesn't replace does this in stores that rename in one step; a local file system has hard links for it.
    """
    f, p = _path(spark, path)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    _, q = _path(spark, tmp)
    out = f.create(q, False)
    out.write(bytearray(content.encode()))
    out.close()
    jvm = spark._jvm
    try:
        if f.getScheme() == "file":
            file = lambda x: jvm.java.io.File(f.makeQualified(x).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(file(p), file(q))
        else:
            none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = none
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(q, p, how)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        if f.exists(q):
            f.delete(q, False)
    return True


def read_small(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


@contextmanager
def atomic_file(uri: str):
    """On an executor: a binary stream whose content appears under ``uri`` only when it is whole."""
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(tmp, compression=None) as out:
        yield out
    where.move(tmp, path)
