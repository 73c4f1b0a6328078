"""Keyed tables: the last row of each key, kept by merging batches.

A table is a folder of buckets of keys. Each merge writes the touched buckets to a folder of its own
(`batch=<n>`) and then, last, a small manifest that says in which folder each bucket lies; readers take
the newest manifest, so they see a merge as a whole or not at all. A batch that runs again starts from
the manifest before its own and gives the same table. The number of buckets follows the number of
rows. Deleted keys stay as marks, so that an older row that comes late does not bring them back, and
are left out on reading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillhouse.functions.changelog import latest_per_key

#: Rows that a bucket holds about.
BUCKET_ROWS = 1_000_000


class Files:
    """The files of a folder, and its manifests by number."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.make = path, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.make(self.path))] if self.fs.exists(self.make(self.path)) else []

    def manifests(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.names() if n.startswith("manifest-") and n.endswith(".json"))

    def read(self, n: int) -> dict:
        stream = self.fs.open(self.make(f"{self.path}/manifest-{n}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, n: int, manifest: dict) -> None:
        """Written aside, then renamed."""
        target, aside = self.make(f"{self.path}/manifest-{n}.json"), self.make(f"{self.path}/_manifest-{n}")
        stream = self.fs.create(aside, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if self.fs.exists(target):
            self.fs.delete(target, False)
        self.fs.rename(aside, target)

    def drop(self, name: str) -> None:
        self.fs.delete(self.make(f"{self.path}/{name}"), True)


def _load(spark: SparkSession, path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
    folders = sorted({f"{path}/{folder}/bucket={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets})
    return spark.read.schema(manifest["schema"]).parquet(*folders) if folders else None


def merge(batch: DataFrame, n: int, path: str, keys: list[str], order: list[str], op: str | None = None, bucket_rows: int = BUCKET_ROWS) -> None:
    """Merge batch `n` into the table: the last row of each key by `order` stays, of the batch or of
    the table. With `op`, rows whose `op` says `delete` are deletions."""
    spark, files = batch.sparkSession, Files(batch.sparkSession, path)
    before = max((m for m in files.manifests() if m < n), default=None)
    was = files.read(before) if before is not None else {"buckets": 1, "rows": 0, "folders": {}}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    buckets = was["buckets"]
    while was["rows"] > buckets * bucket_rows:
        buckets *= 2
    own = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = latest_per_key(batch, keys, order)
    touched = None
    if buckets == was["buckets"]:
        touched = [r[0] for r in new.select(own.alias("b")).distinct().collect()]  # one number a bucket
    old = _load(spark, path, was, touched)
    both = new if old is None else latest_per_key(old.unionByName(new), keys, order)
    folder = f"batch={n}"
    both.withColumn("bucket", own).repartition(buckets, "bucket").write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("bucket").parquet(f"{path}/{folder}")
    written = Files(spark, f"{path}/{folder}").names()
    kept = was["folders"] if touched is not None else {}
    folders = {b: f for b, f in kept.items() if int(b) not in touched} | {name[7:]: folder for name in written if name.startswith("bucket=")}
    counts = spark.read.schema(schema).parquet(*[f"{path}/{f}/bucket={b}" for b, f in folders.items()]).count() if folders else 0
    files.put(n, {"buckets": buckets, "rows": counts, "folders": folders, "schema": schema, "op": op})
    # this manifest and the one before it are kept, with what they name
    keep = [m for m in files.manifests() if m <= n][-2:]
    named = {f for m in keep for f in files.read(m)["folders"].values()}
    for name in files.names():
        if (name.startswith("batch=") and name not in named) or (name.startswith("manifest-") and int(name[9:-5]) not in keep):
            files.drop(name)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table as of the newest manifest, deleted keys left out; where nothing was merged yet, no
    rows of `schema`."""
    files = Files(spark, path)
    if not files.manifests() and schema is not None:
        return spark.createDataFrame([], schema)
    manifest = files.read(files.manifests()[-1])
    rows = _load(spark, path, manifest)
    if rows is None:
        return spark.createDataFrame([], manifest["schema"])
    return rows.where(~F.coalesce(F.col(manifest["op"]) == "delete", F.lit(False))) if manifest["op"] else rows
