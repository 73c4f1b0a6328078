"""Config-driven routing: dimension tables and facts picked by rows of a small config table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillhouse.functions.changelog import latest_per_key, valid
from rillhouse.functions.maps import keep_keys


def current_config(changes: DataFrame, sink_type: str, order: str = "seq") -> DataFrame:
    """Config rows in force after a log of changes (op, before, after): the last state of each
    (source table, source type), deleted ones gone."""
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    flat = changes.select("op", order, row.alias("r")).select("op", order, "r.*").where(F.col("sink_type") == sink_type)
    last = latest_per_key(flat, ["source_table", "source_type"], [order])
    return last.where("op <> 'd'").drop("op", order)


def routed(changelog: DataFrame, config: DataFrame, by_op: bool) -> DataFrame:
    """Changelog rows joined with the config rows of their table (and operation: a source type
    lists operations or is ALL), the data pruned to the sink's columns."""
    op = F.regexp_replace("type", "^bootstrap-", "")
    rows = changelog.withColumn("op_type", op)
    cfg = config.select("source_table", "source_type", "sink_table", "sink_columns", "sink_row_key")
    on = F.col("table") == F.col("source_table")
    if by_op:
        on = on & ((F.col("source_type") == "ALL") | F.array_contains(F.split("source_type", ","), F.col("op_type")))
    # a config is small; shuffled by the few names of tables, all changes of one would meet in one task
    return rows.join(F.broadcast(cfg), on).withColumn("data", keep_keys(F.col("data"), F.col("sink_columns")))


def dim_rows(changelog: DataFrame, config: DataFrame, database: str, seq: str) -> DataFrame:
    """Current rows of all dimension tables: (sink_table, row_key, op_type, data), the last state of
    each key, deleted ones gone. One pass and one shuffle for all tables."""
    rows = routed(valid(changelog, database), config, by_op=False)
    rows = rows.select("sink_table", F.element_at("data", F.col("sink_row_key")).alias("row_key"), "op_type", "data", "ts", seq)
    return latest_per_key(rows, ["sink_table", "row_key"], ["ts", seq], op="op_type").drop("ts", seq)


def dim_tables(changelog: DataFrame, config: DataFrame, database: str, path: str, seq: str = "seq") -> dict[str, DataFrame]:
    """A flat table for each sink of the config, which is small and bounded by its own rows. The rows
    of all sinks are made in one pass and written to `path`, a folder a sink; each table reads its
    own folder."""
    rows = dim_rows(changelog, config, database, seq)
    rows.write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("sink_table").parquet(path)
    held, out = changelog.sparkSession.read.schema(rows.schema).parquet(path), {}
    for r in config.select("sink_table", "sink_columns").distinct().toLocalIterator():
        names = [c.strip() for c in r["sink_columns"].split(",")]
        out[r["sink_table"]] = held.where(F.col("sink_table") == r["sink_table"]).select(*[F.col("data")[c].alias(c) for c in names])
    return out


def route_facts(changelog: DataFrame, config: DataFrame, database: str) -> DataFrame:
    """Fact rows with their target: (sink_table, op_type, data, ts). Bootstrap rows are no facts."""
    rows = routed(valid(changelog, database, ("insert", "update", "delete")), config, by_op=True)
    return rows.select("sink_table", "op_type", "data", "ts")
