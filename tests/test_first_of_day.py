"""Every row of a stream comes out, marked, whichever batch it came in."""

import random
from datetime import datetime, timedelta

from rillhouse.operators import windows
from rillhouse.streaming import runners

from .test_streaming import END, put, stream_of

SCHEMA = "user string, et timestamp, seq long"


def test_all_rows_of_a_day_are_kept_and_one_is_marked(spark, tmp_path):
    rng, rows = random.Random(4), []
    for seq in range(300):
        rows.append((rng.choice(["hot"] * 9 + ["a", None]), datetime(2024, 3, 1) + timedelta(minutes=20 * (seq // 2)), seq))
    for k in range(3):
        put(spark, tmp_path / "in", rows[100 * k : 100 * k + 100], SCHEMA)
    put(spark, tmp_path / "in", [("end", END, -1)], SCHEMA)
    runners.append(windows.marked_first_of_day(stream_of(spark, tmp_path / "in", SCHEMA), "user"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    first = {}
    for user, et, seq in rows:
        first.setdefault((user, et.date()), seq)
    got = {r.seq: r.is_first for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.seq >= 0}
    assert got == {seq: first[user, et.date()] == seq for user, et, seq in rows}
    batch = windows.marked_first_of_day(spark.createDataFrame(rows, SCHEMA), "user")
    assert {r.seq: r.is_first for r in batch.collect()} == got
