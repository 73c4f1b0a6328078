"""Starting queries: the only place that does. Sinks are idempotent by batch or by key.

Each runner works off all there is and returns when that is done; with `every` (an interval such as
`5 seconds`) the query goes on, and is returned running. Keyed state lies in RocksDB, whatever the
session's setting; that is put back once the query has started."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rillhouse.session import ROCKSDB, conf_set
from rillhouse.sources import topics

from . import keyed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Batches whose state is kept: a restart needs the last two. (The engine's default of 100 keeps the disk of state
#: long after its rows are gone.)
_RETAINED, BATCHES = "spark.sql.streaming.minBatchesToRetain", 2
#: With the third format a part of a join keeps its state in one store, not in four. A checkpoint keeps the format it began with.
_JOINS, ONE_STORE = "spark.sql.streaming.join.stateFormatVersion", 3
#: A batch commits what it changed, not files of all its stores.
_CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def _start(stream: DataFrame, writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    with ExitStack() as held:
        for name, value in ((_PROVIDER, ROCKSDB), (_RETAINED, BATCHES), (_JOINS, ONE_STORE), (_CHANGES, "true")):
            held.enter_context(conf_set(stream.sparkSession, name, value))
        query = writer.start()
    if every is None:
        query.awaitTermination()
    return query


def append(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None, every: str | None = None) -> StreamingQuery:
    """Append the rows of a stream as Parquet, each once: the sink logs the files of each batch, and a
    batch that runs again adds none. `rows` reads them."""
    writer = stream.writeStream.format("parquet").option("path", path)
    return _start(stream, writer.partitionBy(*partition_by) if partition_by else writer, checkpoint, every)


def rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a stream of that schema has appended so far; no rows if it has not begun."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def append_topic(stream: DataFrame, target: str, checkpoint: str, servers: str | None = None, every: str | None = None, topic: str | None = None) -> StreamingQuery:
    """Append rows as JSON: to topic `target` of a broker (or, with `topic`, to the topic that this column
    names), or, with no servers, to a folder of compressed text files, each row once."""
    if servers is None:
        return _start(stream, topics.as_json(stream).writeStream.format("text").option("compression", "gzip").option("path", target), checkpoint, every)
    out = topics.as_json(stream, topic=F.col(topic) if topic else None).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return _start(stream, out if topic else out.option("topic", target), checkpoint, every)


def each(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    return _start(stream, stream.writeStream.foreachBatch(run), checkpoint, every)


def upsert(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, op: str | None = None, every: str | None = None) -> StreamingQuery:
    """Keep a keyed table (see `keyed`) up to date from a stream: the last row of each key by
    `order`; with `op`, rows whose `op` says `delete` take their key away."""
    return each(stream, lambda batch, n: keyed.merge(batch, n, path, keys, order, op), checkpoint, every)


def fan_out(stream: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One pass over a stream, several outputs: each batch is held while its parts are written, a
    folder for each batch, so that a batch that runs again replaces what it wrote."""

    def run(batch: DataFrame, n: int) -> None:
        held = batch.persist()
        try:
            for name, f in outputs.items():
                f(held).write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")
        finally:
            held.unpersist()

    return each(stream, run, checkpoint, every)


def with_config(stream: DataFrame, load: Callable[[], DataFrame], route: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Route each batch by the config as it is then: a small table, read anew."""

    def run(batch: DataFrame, n: int) -> None:
        routed = route(batch, load()).write.option("partitionOverwriteMode", "static").mode("overwrite")
        routed.partitionBy("sink_table").parquet(f"{path}/batch={n}")

    return each(stream, run, checkpoint, every)
