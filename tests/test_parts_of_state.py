"""Keyed state lies by parts of keys: the store is written once for a part, not once for a key."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rillhouse.operators import traffic, windows
from rillhouse.sources.topics import LOG
from rillhouse.streaming import runners, state

END = datetime(2030, 1, 1)


def run(spark, tmp_path, rows, schema, job):
    """What a job gives on a stream of one batch, and the rows its state store wrote."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = job(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = runners.append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    wrote = [o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"] if p["numInputRows"] and o["operatorName"].startswith("transformWithState")]
    return set(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())), set(map(tuple, job(spark.createDataFrame(rows, schema)).collect())), max(wrote)


def test_least_so_far_is_written_by_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTS", 4)
    rows = [(u, at, at) for u in range(60) for k in range(4) for at in [datetime(2024, 1, 1) + timedelta(hours=7 * k * (u % 5), minutes=u)]]
    rows.append((60, END, END))
    got, want, wrote = run(spark, tmp_path, rows, "user_id bigint, et timestamp, create_time timestamp", lambda df: windows.order_window(df, "1 hour").select("stt", F.col("order_unique_user_count"), F.col("order_new_user_count")))
    assert wrote <= 4 and len(want) > 5
    assert got == {r for r in want if r[0] < "2030"}


def test_first_seen_days_are_written_by_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PARTS", 4)
    rows = [({"mid": f"m{m}", "is_new": str((m + k) % 2)} if m else {"is_new": "1"}, None, {"p": "x"}, None, None, None, 1_714_521_600_000 + 40_000_000 * k, 100 * m + k) for m in range(60) for k in range(4)]
    got, want, wrote = run(spark, tmp_path, rows, f"{LOG}, seq bigint", lambda df: traffic.repair_is_new(df, "seq", "60 days").select(F.col("common")["mid"], F.col("common")["is_new"], "seq"))
    assert wrote <= 4 and len(want) == 240
    assert got == want
