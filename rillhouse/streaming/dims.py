"""Dimension tables kept by a stream of changes, a keyed table (see `keyed`) for each sink of a routing
config that may change between batches.

A table is put and deleted by key from each batch. Where the config of a sink was changed since the
batch before, its table is dropped and begun anew; where it was deleted, the table is dropped. Each
batch leaves a small manifest with the config it ran by and the batch that each table began with, so a
batch that runs again finds the same tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillhouse.functions.changelog import latest_per_key, valid
from rillhouse.operators.routing import routed

from . import keyed, runners

_FIELDS = ("source_table", "source_type", "sink_columns", "sink_row_key")


def tables_of(config: DataFrame) -> dict[str, list[dict[str, str]]]:
    """The config rows of each sink. A routing config is small: a row for each source and sink."""
    out: dict[str, list[dict[str, str]]] = {}
    for r in config.select("sink_table", *_FIELDS).toLocalIterator():
        out.setdefault(r["sink_table"], []).append({f: r[f] for f in _FIELDS})
    return {sink: sorted(rows, key=lambda r: json.dumps(r)) for sink, rows in out.items()}


def after_change(before: dict[str, dict], config: dict[str, list[dict[str, str]]], n: int) -> dict[str, dict]:
    """The tables of batch `n`: those of the config; one begins with this batch unless the batch before
    had it under the same config."""
    same = lambda sink, rows: sink in before and before[sink]["config"] == rows
    return {sink: {"config": rows, "since": before[sink]["since"] if same(sink, rows) else n} for sink, rows in config.items()}


def keep(changelog: DataFrame, load: Callable[[], DataFrame], database: str, path: str, checkpoint: str, seq: str, every: str | None = None) -> StreamingQuery:
    """Keep the dimension tables below `path` by a stream of changes, `load` giving the config of now.
    `seq` tells changes of the same second apart."""
    spark = changelog.sparkSession

    def run(batch: DataFrame, n: int) -> None:
        files = keyed.Files(spark, path)
        done = [m for m in files.manifests() if m < n]
        before = files.read(done[-1]) if done else {}
        config = load()
        now = after_change(before, tables_of(config), n)
        rows = routed(valid(batch, database), config, by_op=False)
        rows = rows.select("sink_table", F.element_at("data", F.col("sink_row_key")).alias("row_key"), "op_type", "data", "ts", seq)
        # one pass over the batch for all tables; each then reads its own folder
        part = f"{path}/rows-{n}"
        rows = latest_per_key(rows, ["sink_table", "row_key"], ["ts", seq])
        rows.write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("sink_table").parquet(part)
        touched = {name[11:] for name in keyed.Files(spark, part).names() if name.startswith("sink_table=")}
        for sink in now:
            if sink in touched:
                own = spark.read.schema(rows.schema).parquet(part).where(F.col("sink_table") == sink).drop("sink_table")
                keyed.merge(own, n, f"{path}/{sink}-{now[sink]['since']}", ["row_key"], ["ts", seq], op="op_type")
        files.put(n, now)
        # what neither this batch nor the one before names is gone; so are the rows of earlier batches
        kept = {f"{sink}-{t['since']}" for tables in (before, now) for sink, t in tables.items()} | {f"rows-{n}"}
        for name in files.names():
            if not name.startswith(("manifest-", "_")) and name not in kept:
                files.drop(name)

    return runners.each(changelog, run, checkpoint, every)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables as of the newest batch, flat: row_key and the columns of the config, as text."""
    files = keyed.Files(spark, path)
    if not files.manifests():
        return {}
    out = {}
    for sink, table in files.read(files.manifests()[-1]).items():
        names = dict.fromkeys(c.strip() for row in table["config"] for c in row["sink_columns"].split(","))
        home = f"{path}/{sink}-{table['since']}"
        if keyed.Files(spark, home).manifests():
            out[sink] = keyed.read(spark, home).select("row_key", *[F.col("data")[c].alias(c) for c in names])
        else:  # no row has come yet
            out[sink] = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ["row_key", *names]))
    return out
