"""Where tables that several jobs read are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a local one where that is unset and the master is local, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Paths given out inside each open scratch(), the innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written through fresh_path inside it. Results must have been written elsewhere or collected by then."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.remove(paths)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{ensure_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def shuffle_tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle goes to; as a number given to repartition, tasks are not put together again until they are too large for memory."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that no later job computes it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """What written gives, and how many of its rows meet a condition (all without one), counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, (F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n")), name)
    return out, seen.get["n"]
