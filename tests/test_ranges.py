"""Facts and windows of streams by ranges of time: no state store is called for a row, what is held ends with
its bounds, and late rows, restarts and batches that run again give the same as before."""

import glob

import pytest
from pyspark.sql import functions as F

from rillhouse.operators import facts
from rillhouse.plans import fixtures as fx
from rillhouse.sources import topics
from rillhouse.streaming import ranges, runners

from .test_oracle import duck, test_oracle as agree  # noqa: F401
from .test_streaming import change, put, stream_of, uncommit

NAMES = ["stream_order_detail", "stream_cancel_detail", "stream_ods_payment_window", "stream_ods_to_dws", "stream_pay_detail", "stream_refund_pay", "stream_province_order_window", "stream_sku_order_window"]


@pytest.mark.parametrize("name", NAMES)
def test_no_store_is_called_for_a_row_of_several_batches(spark, sf, duck, name, monkeypatch):  # noqa: F811
    monkeypatch.setattr(fx, "BATCH_LINES", 2000)
    made, start = [], runners._start
    monkeypatch.setattr(runners, "_start", lambda *a: made.append(start(*a)) or made[-1])
    agree(spark, sf, duck, name)
    first = made[0].recentProgress
    assert len([p for p in first if p["numInputRows"]]) >= 3
    assert not any(p["stateOperators"] for p in first)


def near(rows, within):
    return facts.order_detail(rows, "10 seconds").where(within(F.col("ts") * 1_000_000)).select("id", "user_id")


def test_ranges_over_late_rows_restarts_and_batches_run_again(spark, tmp_path):
    line = lambda i, ts: change("order_detail", "insert", ts, {"id": f"d{i}", "order_id": f"o{i}"})
    order = lambda i, ts: change("order_info", "insert", ts, {"id": f"o{i}", "user_id": f"u{i}"})
    rest = lambda ts: [change(t, "insert", ts, {"order_detail_id": "none"}) for t in ("order_detail_coupon", "order_detail_activity")]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        log = stream_of(spark, tmp_path / "in", topics.CHANGELOG)
        us = F.col("ts") * 1_000_000
        ranges.by_range(log, near, out, checkpoint, us, facts.reads("order_detail"), "10 seconds", "10 seconds", deal="table")
        return sorted(map(tuple, ranges.rows(spark, out, "id string, user_id string").collect()))

    put(spark, tmp_path / "in", [line(1, 100), order(1, 105), line(2, 100), order(2, 111), line(3, 995)], topics.CHANGELOG)
    assert run() == []  # coupons and activities have not come: they hold the watermark back
    put(spark, tmp_path / "in", [*rest(1000), line(8, 1000), order(8, 1000)], topics.CHANGELOG)
    want = [("d1", "u1"), ("d2", None)]
    assert run() == want  # line 3 is open: its order may come
    uncommit(checkpoint, 1)
    assert run() == want
    put(spark, tmp_path / "in", [order(3, 1004), line(4, 200), order(9, 2000), line(9, 2000), *rest(2000)], topics.CHANGELOG)
    want = sorted([*want, ("d3", "u3"), ("d8", "u8")])
    assert run() == want  # line 4 is late
    uncommit(checkpoint, 2)
    assert run() == want
    held = [r.ts for r in spark.read.parquet(f"{out}/held=2").collect()]
    put(spark, tmp_path / "in", [order(10, 3000), line(10, 3000), *rest(3000)], topics.CHANGELOG)
    assert run() == sorted([*want, ("d9", "u9")])
    assert {r.ts for r in spark.read.parquet(f"{out}/held=3").collect()} == {2000, 3000} and min(held) > 900
    assert len(glob.glob(f"{out}/held=*")) == 2
