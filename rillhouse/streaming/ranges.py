"""Jobs of a stream done range by range of event time, for jobs whose rows need others only within bounds of
their own time: interval joins and tumbling windows.

Each batch is parsed once and held as columns, beside what is still held of those before. The batch job then
runs over the range of time that the watermark has closed since, with the rows within `back` before and `ahead`
after it: no state store is called for each row, and a batch costs by its rows and by those that its bounds
hold open. The watermark is the least, over the slices of the stream that the job reads, of the latest time
seen, less `delay`; a slice that has not come holds it back. Rows of a range that is closed are late and dropped.

A batch writes what it holds, then its output, and last a small manifest (see `keyed`); one that runs again
starts from the manifest before its own and replaces what it wrote."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillhouse.functions.times import width_ms
from rillhouse.session import SHUFFLES_END, conf_set
from rillhouse.sources.topics import OPEN_FILES, ROW_GROUP

from . import keyed, runners

#: Says of a time in microseconds whether it lies in the range that is being closed.
Within = Callable[[Column], Column]


def between(low: int | None, high: int) -> Within:
    return lambda at: (at < high) if low is None else (at >= low) & (at < high)


def by_range(
    stream: DataFrame, job: Callable[[DataFrame, Within], DataFrame], path: str, checkpoint: str, time: Column, slices: list[Column],
    back: str = "0 seconds", ahead: str = "0 seconds", delay: str = "10 seconds", step: str | None = None,
    deal: str | None = None, write: Callable[[DataFrame, int], None] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Run `job` over each closed range. `time` is a row's time in microseconds; rows in none of the slices, or
    without a time, are not held. With `step`, ranges begin and end at multiples of it. `deal` names a column of
    few values that held rows are stored by. `write` takes the output of a batch; without it that lies in `path`,
    where `rows` finds it."""
    spark = stream.sparkSession
    us = lambda width: width_ms(width) * 1000
    put = write or (lambda out, n: out.write.mode("overwrite").parquet(f"{path}/rows/batch={n}"))
    of = reduce(add, [F.when(s, 1 << i).otherwise(0) for i, s in enumerate(slices)])
    marked = stream.select("*", time.alias("__at"), of.alias("__of"))
    columns, schema = stream.columns, marked.schema

    def held(session: SparkSession, n: int) -> DataFrame:
        return session.read.schema(schema).parquet(f"{path}/held={n}")

    def run(batch: DataFrame, n: int) -> None:
        files = keyed.Files(spark, path)
        before = max((m for m in files.manifests() if m < n), default=None)
        was = files.read(before) if before is not None else {"closed": None, "seen": [None] * len(slices)}
        closed, seen = was["closed"], was["seen"]
        new = batch.where("__of > 0 AND __at IS NOT NULL")
        new = new if closed is None else new.where(F.col("__at") >= closed)
        kept = None if before is None else held(batch.sparkSession, before)
        if kept is not None and closed is not None:
            kept = kept.where(F.col("__at") >= closed - us(back))
        both = (new if kept is None else new.unionByName(kept)).write.option("partitionOverwriteMode", "static").option("parquet.block.size", ROW_GROUP)
        with conf_set(batch.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES):
            (both.partitionBy(deal) if deal else both).mode("overwrite").parquet(f"{path}/held={n}")
        found = held(spark, n)
        latest = found.agg(*[F.max(F.when(F.col("__of").bitwiseAND(1 << i) != 0, F.col("__at"))) for i in range(len(slices))]).first()
        seen = [max((x for x in pair if x is not None), default=None) for pair in zip(seen, latest, strict=True)]
        upto = closed
        if all(x is not None for x in seen):
            one = us(step) if step else 1
            upto = (min(seen) - us(delay) - us(ahead)) // one * one
            upto = upto if closed is None else max(closed, upto)
        with conf_set(spark, SHUFFLES_END, "true"):
            if upto != closed:
                rows = found.where(between(None if closed is None else closed - us(back), upto + us(ahead))(F.col("__at")))
                put(job(rows.select(*columns), between(closed, upto)), n)
            else:
                put(job(found.select(*columns), lambda at: F.lit(False)), n)
        files.put(n, {"closed": upto, "seen": seen})
        # this manifest and the one before it are kept, with what they name
        keep = [m for m in files.manifests() if m <= n][-2:]
        for name in files.names():
            if (name.startswith("held=") and int(name[5:]) not in keep) or (name.startswith("manifest-") and int(name[9:-5]) not in keep):
                files.drop(name)

    return runners.each(marked, run, checkpoint, every)


def rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """What has come out so far, of that schema."""
    names = [n for n in keyed.Files(spark, f"{path}/rows").names() if n.startswith("batch=")]
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{n}" for n in names]) if names else spark.createDataFrame([], schema)
