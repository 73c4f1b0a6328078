"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every document gets a hash of its id as key. Within a source, keys are dealt to ranges by their
leading bits (a hash is uniform, so the ranges are even however large one source is); a window
sums sizes within each range, a second one sums the ranges' totals, and both together give each
document the number of words before it in its source's order. A source takes whole epochs, then
the documents up to its exact budget. No row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Rows of a source that a range holds about, and ranges of a source at least.
RANGE_ROWS, RANGES = 100_000, 512


def prefix_sums(df: DataFrame, group: str, key: str, ties: list[str], value: str, out: str, ranges: int = RANGES) -> DataFrame:
    """`df` with `out`: the sum of `value` over the rows of its group before it, in the order of
    `key` (a uniform bigint hash), then `ties`. Groups are not null. No window holds more than a
    range of a group, or a group's ranges (at most 2^31 / 100,000 of these for each 2^31 rows)."""
    part = free_name(df, "range")
    dealt = df.withColumn(part, F.expr(f"cast(shiftrightunsigned(`{key}`, 32) * {ranges}L div 4294967296 as int)"))
    totals = dealt.groupBy(group, part).agg(F.sum(value).alias("total"))
    w = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("g"), F.col(part).alias("p"), F.coalesce(F.sum("total").over(w), F.lit(0)).alias("offset"))
    w = Window.partitionBy(group, part).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("own", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return own.join(offsets, (F.col(group) == F.col("g")) & (F.col(part) == F.col("p")), "left").select(*df.columns, (F.col("own") + F.col("offset")).alias(out))


def ranks(names: DataFrame, column: str) -> DataFrame:
    """`names` (distinct values, null last, one column) with `rank` from 0 in code point order,
    without a window over all of them: ranges by sampled bounds, and prefix sums of their sizes."""
    n = max(1, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = materialize(names.repartitionByRange(n, F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-names")
    sizes = held.groupBy("part").count()
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of n partitions
    before = sizes.select("part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())
    return held.withColumn("row", F.row_number().over(w)).join(before, "part").select(column, (F.col("before") + F.col("row") - 1).alias("rank"))


def targets(sized: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): sources in code point order (null last) weigh `weights`,
    repeating; they share `share` times all sizes by weight, each at most `most` times its size,
    what is over going to the others by weight until none is above."""
    if share > most:
        raise ValueError("the sources cannot give that much")
    sizes = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    order = ranks(sizes.select(source), source).withColumnRenamed(source, "s")
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    now = sizes.join(order, F.col(source).eqNullSafe(F.col("s"))).select(source, "source_size", weight.alias("w"))
    now = materialize(now, "mix-sources")
    cap = F.col("source_size") * float(most)
    total = float(now.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words for one unit of weight; what is capped gets its cap
    while True:
        full = cap <= level * F.col("w")
        r = now.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = max(0.0, total - (r[0] or 0.0)) / r[1] if r[1] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return now.select(source, "source_size", F.least(cap, F.lit(level) * F.col("w")).alias("target"))


def _named(source: str) -> Column:
    """A key of the source that is not null, so that equal joins and groups share a partitioning."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, row: str | None = None, **shares) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken (words that the
    mix takes, 0 to 2 times its size); with `row`, that column too.

    The taken words of a source add up to its target, rounded down. Null and blank texts have size
    0 and take nothing; texts of any length count whole; repeated rows count each; keys hash id and
    text, so that rows of a null or repeated id are spread; equal keys go by id; a null source is a
    source; no rows give none; no other column is looked at, whatever its name. Reruns agree:
    nothing depends on the order or the place of rows."""
    more = [F.col(row).alias("row")] if row else []
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), doc_id, text).alias("key"), *more)
    sized = materialize(sized, "mix-sizes")
    ranges = max(RANGES, sized.count() // RANGE_ROWS)
    aims = targets(sized, "source", **shares).select(_named("source").alias("s"), "source_size", "target")
    placed = prefix_sums(sized.withColumn("named", _named("source")), "named", "key", ["doc_id", "size", *(["row"] if row else [])], "size", "before", ranges)
    budget = F.floor(F.col("target") + 1e-6)
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 1e-6) as long) div source_size")).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("before")))
    joined = placed.join(aims, F.col("named") == F.col("s"))
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * epochs + rest).cast("long").alias("taken"), *(["row"] if row else []))


def draw(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them: a row for each epoch, and one more for a
    last part of half the document or more. Documents without words are not drawn; no rows give
    none; all columns stay, whatever their names."""
    row = free_name(docs, "row")
    held = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    times = F.when(F.col("size") > 0, F.expr("cast(floor((2 * taken + size) / (2 * size)) as int)")).otherwise(F.lit(0))
    drawn = mix(held, row=row, **options).select(F.col("row").alias(row), times.alias("times")).where("times > 0")
    copy = free_name(held, "copy")
    drawn = drawn.select(row, F.col("times").alias(copy))
    return held.join(drawn, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns)
