"""App logs: cleaning, repair of the new-visitor flag, and the split into five outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillhouse.functions.maps import filled, merge
from rillhouse.functions.times import watermarked
from rillhouse.streaming import state


def log_clean(log: DataFrame) -> DataFrame:
    """Logs with at least one filled part."""
    return log.where(filled(F.col("start")) | filled(F.col("page")) | filled(F.col("err")) | filled(F.col("displays")) | filled(F.col("actions")))


def repaired_flag(flag: Column, day: Column, first: Column, is_first: Column) -> Column:
    """The visitor flag by a device's first record (a struct with flag and day): its day is the first-seen
    one if it says new, else the day before. The first record stands; later ones that say new on another
    day say 0."""
    seen = F.when(first["flag"] == "1", first["day"]).otherwise(F.date_sub(first["day"], 1))
    return F.when(is_first, flag).when((flag == "1") & (day != seen), F.lit("0")).otherwise(flag)


def repair_is_new(log: DataFrame, tie: str, delay: str = "1 millisecond", keep: str | None = None) -> DataFrame:
    """Logs with `common.is_new` repaired, by device in time order, `tie` (a number) after equal times.
    A device's first record is found by partial sums, so that no task sorts all records of one. On
    streams it is kept as state (for good, or until the device was silent for `keep`); order holds in a
    batch, and arrival between batches."""
    mid, flag, at = F.col("common")["mid"], F.col("common")["is_new"], F.timestamp_millis("ts")
    repaired = lambda f: merge(F.col("common"), F.create_map(F.lit("is_new"), f))
    if log.isStreaming:
        packed = log.select(mid.alias("mid"), at.alias("et"), "ts", F.col(tie).cast("long").alias("seq"), flag.alias("is_new"), F.to_json(F.struct(*log.columns)).alias("value"))
        fixed = state.seen_since(watermarked(packed, "et", delay), keep)
        rows = fixed.select(F.from_json("value", log.schema).alias("r"), "is_new").select("r.*", "is_new")
        return rows.withColumn("common", repaired(F.col("is_new"))).select(*log.columns)
    rows = log.withColumn("__mid", mid)
    first = rows.groupBy("__mid").agg(F.min(F.struct("ts", tie, flag.alias("flag"), F.to_date(at).alias("day"))).alias("__first")).withColumnRenamed("__mid", "__key")
    joined = rows.join(first, F.col("__mid").eqNullSafe(F.col("__key")), "left")
    is_first = F.col("ts").eqNullSafe(F.col("__first.ts")) & F.col(tie).eqNullSafe(F.col(f"__first.{tie}"))
    return joined.withColumn("common", repaired(repaired_flag(flag, F.to_date(at), F.col("__first"), is_first))).select(*log.columns)


def _base(extra: str) -> Column:
    return merge(merge(F.col("common"), F.create_map(F.lit("ts"), F.col("ts").cast("string"))), F.col(extra))


def start(log: DataFrame) -> DataFrame:
    """Start logs, flat in `record`."""
    return log.where(filled(F.col("start"))).select(_base("start").alias("record"))


def page(log: DataFrame) -> DataFrame:
    """Page logs (a log with a start is none), flat in `record`."""
    return log.where(~filled(F.col("start")) & filled(F.col("page"))).select(_base("page").alias("record"))


def _parts(log: DataFrame, name: str) -> DataFrame:
    """Elements of an array of a page log; page fields win, but an element keeps its own time."""
    pages = log.where(~filled(F.col("start")) & filled(F.col("page"))).select(_base("page").alias("b"), F.explode(name).alias("e"))
    own = F.map_filter("e", lambda k, _: k == "ts")
    return pages.select(merge(merge(F.col("e"), F.col("b")), own).alias("record"))


def action(log: DataFrame) -> DataFrame:
    return _parts(log, "actions")


def display(log: DataFrame) -> DataFrame:
    return _parts(log, "displays")


def err(log: DataFrame) -> DataFrame:
    """Error records: common, time and error fields, start or page fields on top."""
    top = merge(F.col("page"), F.col("start"))
    return log.where(filled(F.col("err"))).select(merge(_base("err"), top).alias("record"))


def split_log(log: DataFrame) -> dict[str, DataFrame]:
    return {f.__name__: f(log) for f in (start, page, err, action, display)}
