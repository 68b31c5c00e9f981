"""Tables that a job writes for itself in the cluster's shared folder.

A plan that is read several times, or that a loop builds on, is written once and
read back; an executor that is lost then costs one task, not the whole lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own on a single machine (tests), and an error on a cluster."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-")
    return "file://" + _own[app]


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df once under the shared folder; give back the table read from there and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilewright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, name)[0]


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that write_table made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all(since: int = 0) -> None:
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            drop_table(spark, path)
        except Exception:  # the session has gone; the shared folder is the cluster's to clear
            return


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables that jobs write within are deleted at the end; results must have been read or written by then. Others go when the program ends."""
    since = len(_written)
    try:
        yield
    finally:
        _drop_all(since)


def shuffle_width(spark: SparkSession, df: DataFrame | None = None, per_partition: int = 256 << 20) -> int:
    """Partitions of an exchange whose number AQE can't choose: the session's setting, or more if the files that df reads hold more than so many bytes for each."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is None:
        return n
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.length())]
    return max(n, -(-sum(s for s in sizes if s < 1 << 60) // per_partition))  # without a size the optimizer takes the largest number
