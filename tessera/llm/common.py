"""Helpers that the training-data operators share: staging, batches, packaging."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python operators cut Arrow batches so that one step holds about this many bytes of text.
STEP_BYTES = 4 << 20
#: Keys that are joined from a broadcast table because of their many rows: no more than this.
HOT_KEYS = 2000
#: Rows of a file where a bound of all rows is known.
FILE_ROWS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, in tests, a temporary one that goes when the driver ends."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        where = getattr(shared_dir, "own", None)
        if not where:
            where = shared_dir.own = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it runs from a source tree."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


#: Staged folders that are still there, and the session of each.
_staged: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    """Results read staged folders until the driver ends; then they go."""
    for path, spark in list(_staged.items()):
        with contextlib.suppress(Exception):  # a session that has stopped leaves its files to the cluster
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors.

    ``most`` is about how many rows it has at most; then the last stage has no more tasks, and files, than that needs.
    On a local file system without Hadoop's native library executors start a process for each file and its checksum.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(max(1, -(-most // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    _staged[path] = spark
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged frame that nothing reads any more."""
    _delete(df.sparkSession, df.staged_path)
    _staged.pop(df.staged_path, None)


def joined_by_count(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each with ``n``, the rows of ``left`` that have it, ``total`` in all.

    Keys with more than a ``HOT_KEYS``-th of all rows can't be more than that many, so they are
    broadcast, and no task gets all rows of one. ``right`` is read for that, so it is to be staged.
    """
    many = max(1000, total // HOT_KEYS)
    if right.filter(F.col("n") > many).isEmpty():
        return left.join(right, key)
    hot, rest = F.broadcast(right.filter(F.col("n") > many)), right.filter(F.col("n") <= many)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(rest, key))


def slices(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts add up to about ``step`` bytes; a longer text stays whole."""
    import numpy as np

    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + step, side="right")))
        yield batch.slice(at, to - at)
        at = to


def doc_text(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns, whatever else the table holds."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c) for c in keep])
