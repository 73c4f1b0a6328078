"""Session defaults, the folder that driver and executors share, and the package for executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(name: str = "rillhouse", **conf: str) -> SparkSession:
    """A session with UTC times, adaptive plans and the RocksDB state store."""
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    return SparkSession.builder.appName(name).config(map=defaults | conf).getOrCreate()


@contextmanager
def conf_set(spark: SparkSession, name: str, value) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Whether a query's shuffle files go when it ends, not once the driver happens to collect its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Partitions that shuffles of batches are dealt into before adaptive plans put small ones together, and
#: compressed bytes that a task then takes, of a shuffle or of a table's files.
FINE, TASK_BYTES = 1024, 16 * 1024 * 1024
_FINE = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": FINE,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES,
    "spark.sql.files.maxPartitionBytes": TASK_BYTES,
}


def fine_partitions(spark: SparkSession) -> None:
    """Where unset, let adaptive plans choose partitions by size from many small ones: a task's rows then
    don't grow with the input, as they do with a fixed number of partitions. Shares are small, as compressed
    rows take ten times their bytes and more where they are sorted, and as a task that deals its rows into
    more than 200 partitions holds them all."""
    for name, value in _FINE.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in `spark.checkpoint.dir`; only where that is unset and Spark runs on one machine, in
    a local temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-rillhouse-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark application: functions and state
    processors that run there are found by their names."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-rillhouse-"), "rillhouse-jobs.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(home):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
