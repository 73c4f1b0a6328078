"""Reading a changelog: slices of tables, status changes, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, database: str, types: tuple[str, ...] = ("insert", "update", "delete", "bootstrap-insert")) -> DataFrame:
    """Rows of the business database with table, a known type, a time and data."""
    return df.where((F.col("database") == database) & (F.trim("table") != "") & F.col("type").isin(*types) & F.col("ts").isNotNull() & (F.size("data") > 0))


def taken(table: str, op: str) -> Column:
    return (F.col("table") == table) & (F.col("type") == op)


def take(df: DataFrame, table: str, op: str, *keys: str) -> DataFrame:
    """Rows of one table and operation: the named keys of `data` as strings, and ts."""
    return df.where(taken(table, op)).select(*[F.col("data")[k].alias(k) for k in keys], "ts")


def went(table: str, column: str, old: str | None, new: str) -> Column:
    was = F.col("old")[column]
    return taken(table, "update") & (was.isNotNull() if old is None else was == old) & (F.col("data")[column] == new)


def transition(df: DataFrame, table: str, column: str, old: str | None, new: str) -> DataFrame:
    """Updates that took `column` from `old`, or from any known value, to `new`."""
    return df.where(went(table, column, old, new))


def pick(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col("data")[k].alias(k) for k in keys], "ts")


def cart_delta() -> Column:
    """Pieces added to a cart: all on insert, the increase on update; null where nothing was added,
    the update did not touch the number, or a number can't be read."""
    new, old = F.col("data")["sku_num"].try_cast("int"), F.col("old")["sku_num"].try_cast("int")
    return F.when(F.col("type") == "insert", new).when((F.col("type") == "update") & (new > old), new - old)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first version of each key: an aggregate with partial sums, no sort of versions."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, "v.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], op: str | None = None) -> DataFrame:
    """The last version of each key; keys whose last operation is a delete are gone."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, "v.*").select(*df.columns)
    return last.where(F.col(op) != "delete") if op else last
