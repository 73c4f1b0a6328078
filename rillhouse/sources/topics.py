"""Topics of JSON strings: read from a broker or from files, parsed to typed columns, written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillhouse.session import SHUFFLES_END, conf_set

CHANGELOG = "database string, `table` string, type string, ts bigint, data map<string,string>, old map<string,string>"
#: Files that a task writing a changelog keeps open, and bytes of their row groups.
OPEN_FILES, ROW_GROUP = 16, 16 * 1024 * 1024
LOG = "common map<string,string>, start map<string,string>, page map<string,string>, err map<string,string>, displays array<map<string,string>>, actions array<map<string,string>>, ts bigint"


def read_raw(spark: SparkSession, source: str, stream: bool = False, servers: str | None = None, files: int | None = None) -> DataFrame:
    """A topic as strings in `value`, from its start and committed records only; with no servers,
    `source` is a folder of text files with a record a line, of which a stream takes so many a batch."""
    reader = spark.readStream if stream else spark.read
    if servers is None:
        return (reader.option("maxFilesPerTrigger", files) if stream and files else reader).format("text").load(source)
    options = {"kafka.bootstrap.servers": servers, "subscribe": source, "startingOffsets": "earliest", "kafka.isolation.level": "read_committed"}
    return reader.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"), "offset")


def _parsed(raw: DataFrame, schema: str, must: Column) -> DataFrame:
    # a generator: filters on fields of a parsed struct would be put below it, and parse each row again for each field
    rest = [c for c in raw.columns if c != "value"]
    fields = F.inline(F.array(F.from_json("value", schema, {"mode": "PERMISSIVE"})))
    names = StructType.fromDDL(schema).names
    return raw.select(fields, *rest).select(*[f"`{c}`" for c in names], *rest).where(must)


def parse_changelog(raw: DataFrame) -> DataFrame:
    """Changelog rows; malformed records and records without a table are dropped."""
    return _parsed(raw, CHANGELOG, F.col("table").isNotNull())


def store_changelog(raw: DataFrame, path: str, by_day: bool = False) -> None:
    """Parse a changelog once and write it as columns, a folder for each table (and day): jobs then
    read only their tables, and no JSON. A task keeps a file open for each of a few tables rather than
    sort its rows by table; row groups are small, so that large files are read by many tasks. What was
    shuffled to make the changelog goes with the write, before jobs shuffle its tables."""
    rows = parse_changelog(raw)
    rows = rows.withColumn("day", F.to_date(F.timestamp_seconds("ts"))) if by_day else rows
    writer = rows.write.option("partitionOverwriteMode", "static").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").mode("overwrite")
    with conf_set(raw.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES), conf_set(raw.sparkSession, SHUFFLES_END, "true"):
        writer.partitionBy(*["table", "day"][: 1 + by_day]).parquet(path)


def parse_log(raw: DataFrame) -> DataFrame:
    return _parsed(raw, LOG, F.lit(True))


def parse_topic(raw: DataFrame, schema: str) -> DataFrame:
    """A typed topic; null values (deletions of a keyed topic) and malformed records are dropped."""
    rest = [c for c in raw.columns if c != "value"]
    parsed = raw.where(F.col("value").isNotNull()).select(F.from_json("value", schema).alias("r"), *rest)
    fields = parsed.schema["r"].dataType.fieldNames()
    return parsed.where(F.coalesce(*[F.col(f"r.{f}").cast("string") for f in fields]).isNotNull()).select("r.*", *rest)


def as_json(df: DataFrame, topic: Column | None = None, key: str | None = None) -> DataFrame:
    """Rows as JSON in `value`, with a target topic and a key where given: what a Kafka sink takes."""
    extra = ([topic.alias("topic")] if topic is not None else []) + ([F.col(key).cast("string").alias("key")] if key else [])
    return df.select(*extra, F.to_json(F.struct(*df.columns)).alias("value"))


def load_config(spark: SparkSession, path: str, sink_type: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Routing rows of one sink type, from a file or over JDBC. Read anew for each micro-batch."""
    rows = spark.read.format("jdbc").options(**jdbc, dbtable=path).load() if jdbc else spark.read.parquet(path)
    return rows.where(F.col("sink_type") == sink_type) if sink_type else rows
