"""What the operators share: the word pattern, shipping the package, and cutting lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words, as a character class body and as the characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"

#: About as many bytes an Arrow batch has at most, but for a longer row: JVM and Python hold batches
#: whole, and twice over. Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or, only where that is
    unset and Spark runs on one machine, a new temporary folder kept for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-rillhouse-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back. Cuts lineage so that a lost
    executor costs a reread, and so that costly columns are computed once."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each Spark application, and hold the
    session's Arrow batches to `BATCH_BYTES`, unless it sets a limit of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, files in os.walk(os.path.join(top, "rillhouse")):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, top))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-rillhouse-"), "rillhouse.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def whole_text(text: str | Column = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_list(text: Column) -> Column:
    """Words of a non-null text as an array, without Python."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.regexp_count(whole_text(text), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores put before it until no column of `df` clashes. The operators name
    the column that they add so: a column of `df` is never replaced."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, the value computed once however often `use` takes it."""
    return F.element_at(F.transform(F.array(value), use), 1)


_BLOCK = 256


def running(values: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array by an associative `add`, in time linear in its length but for a
    small factor: blocks are added up on their own, then their ends."""
    grow = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))
    sums = lambda xs: F.slice(F.aggregate(xs, F.array(start), grow), 2, F.size(xs))

    def blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: sums(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))

    def joined(own: Column) -> Column:
        # the totals before the blocks are one more than the blocks
        before = F.slice(F.aggregate(F.transform(own, lambda o: F.element_at(o, -1)), F.array(start), grow), 1, F.size(own))
        return F.flatten(F.zip_with(own, before, lambda o, first: F.transform(o, lambda x: add(first, x))))

    some = lambda xs: F.when(F.size(xs) <= _BLOCK, sums(xs)).otherwise(bind(blocks(xs), joined))
    return bind(values, some)


def hash_bounds(rows: DataFrame, k: int) -> dict[Any, int]:
    """For each kind of `rows` (a uniform bigint hash `h`, and `kind`) a bound on h, so that `k` rows
    of the kind, or all it has, are at or below it and few more. Rows are counted by the hash's
    leading bits where they are; 65,536 counts a kind are added up, one bound a kind comes here.
    Sixteen more bits are looked at, in the bound's own cell alone, while that holds over k rows
    more than it need. Rows of one hash can't be parted: a sample still has its own limit."""
    found: dict[Any, int] = {}
    cells, need = rows, {}  # rows still wanted of the kinds in `cells`; k at first
    own = lambda kind: F.col("kind").eqNullSafe(F.lit(kind))
    for shift in (48, 32, 16, 0):
        wanted = reduce(lambda out, kv: F.when(own(kv[0]), kv[1]).otherwise(out), need.items(), F.lit(k))
        counts = cells.groupBy("kind", F.shiftright("h", shift).alias("cell")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy("kind").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).where(F.col("before") < wanted)
        wide = {}
        for r in before.groupBy("kind").agg(F.max(F.struct("cell", "before", "n")).alias("m")).select("kind", "m.*").collect():
            low, rest = r["cell"] << shift, need.get(r["kind"], k) - r["before"]
            found[r["kind"]] = low + (1 << shift) - 1
            if r["n"] > rest + k:
                wide[r["kind"]] = (low, rest)
        if not wide:
            break
        need = {kind: rest for kind, (_, rest) in wide.items()}
        cells = rows.where(reduce(or_, [F.col("h").between(low, low + (1 << shift) - 1) & own(kind) for kind, (low, _) in wide.items()]))
    return found


def below(h: Column, kind: Column, bounds: dict[Any, int]) -> Column:
    """True for rows at or below the bound of their kind; `kind` is only looked at where the hash is
    low enough for some kind."""
    if not bounds:
        return F.lit(False)
    return (h <= max(bounds.values())) & reduce(or_, [kind.eqNullSafe(F.lit(k)) & (h <= b) for k, b in bounds.items()])


def spread_join(rows: DataFrame, side: DataFrame, key: str, n: str = "n") -> DataFrame:
    """`rows` joined with `side` on `key`; `side` has a row for each key of `rows`, with the number of
    its rows in `n`. Keys of more than a thousandth of the rows are fewer than a thousand: these are
    broadcast, so that no task gets all rows of a hot key; the others are shuffled."""
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = side.where(F.col(n) * 1000 > total)
    few = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(few, key, "left_anti").join(side.where(F.col(n) * 1000 <= total), key))


class Remembered(dict):
    """What `make` gives for a key, remembered in two halves of `keep` keys: when the newer is full
    it becomes the older, and keys asked for again move over, so that frequent ones stay."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep = keep
        self.older: dict = {}

    def __missing__(self, key):
        found = self.older[key] if key in self.older else self.make(key)
        if self.worth(key):
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found

    def make(self, key):
        raise NotImplementedError

    def worth(self, key) -> bool:
        return True
