"""Keyed state, keyed tables, joins and window jobs over streams that come in several batches."""

import glob
import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rillhouse.functions.words import dictionary_words
from rillhouse.operators import facts, traffic, windows
from rillhouse.sources import topics
from rillhouse.streaming import dims, keyed, runners

DAY = datetime(2024, 5, 1)
END = datetime(2200, 1, 1)
key = lambda r: tuple(map(str, r))


def sorted_rows(df, columns=None):
    return sorted(map(key, df.select(*(columns or sorted(df.columns))).collect()))


def put(spark, path, rows, schema):
    """One more file of a stream, later than those before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def stream_of(spark, path, schema, one=True):
    path.mkdir(exist_ok=True)
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", 1) if one else reader).parquet(str(path))


def uncommit(checkpoint, n):
    """As if batch `n` had not been committed: it runs again."""
    found = glob.glob(f"{checkpoint}/commits/{n}") + glob.glob(f"{checkpoint}/commits/.{n}.crc")
    assert found
    for f in found:
        os.remove(f)


def last_batch(checkpoint):
    return max(int(os.path.basename(f)) for f in glob.glob(f"{checkpoint}/commits/[0-9]*"))


SCHEMA = "user string, et timestamp, seq long"


def first_of_day(stream):
    rows = stream.withWatermark("et", "90 days")
    return windows.first_rows(rows, [F.col("user"), windows.day_of()], ["user", "et", "seq"], until=windows.day_end())


def plain(batches):
    """Each user's first row of a day: by time in a batch, by arrival between batches."""
    seen, out = set(), []
    for rows in batches:
        for u, et, seq in sorted(rows, key=lambda r: (r[1], r[2])):
            if (u, et.date()) not in seen:
                out.append((u, et, seq))
            seen.add((u, et.date()))
    return sorted(map(key, out))


def test_first_of_day_over_batches_restarts_and_again(spark, tmp_path):
    rng, seq, batches = random.Random(2), 0, []
    for n in range(4):
        rows = []
        for _ in range(300):
            seq += 1
            rows.append((rng.choice(["hot"] * 20 + ["a", "b", None]), datetime(2024, 3, 1 + n) + timedelta(hours=rng.randint(0, 60)), seq))
        rows.append(min(rows, key=lambda r: (r[1], r[2])))  # a repeated row counts once
        batches.append(rows)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        runners.append(first_of_day(stream_of(spark, tmp_path / "in", SCHEMA)), path, checkpoint)
        return sorted_rows(spark.read.parquet(path), ["user", "et", "seq"])

    for n, rows in enumerate(batches):
        put(spark, tmp_path / "in", rows, SCHEMA)
        assert run() == plain(batches[: n + 1])  # each run is a restart
    uncommit(checkpoint, last_batch(checkpoint))
    assert run() == plain(batches)


def test_state_and_cost_of_a_batch_do_not_grow_with_history(spark, tmp_path):
    """Fifty days, a batch each: keys of closed days leave the state, and late batches take no longer."""
    for n in range(50):
        put(spark, tmp_path / "in", [(f"u{i}", datetime(2024, 1, 1) + timedelta(days=n, seconds=i), 100 * n + i) for i in range(60)], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = stream_of(spark, tmp_path / "in", SCHEMA).withWatermark("et", "1 hour")
        out = windows.first_rows(rows, [F.col("user"), windows.day_of()], ["user", "et", "seq"], until=windows.day_end())
        query = runners.append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    took = [p["batchDuration"] for p in progress]
    print("state rows", held, "milliseconds", took)
    assert len(progress) == 50 and max(held[5:]) <= 6 * held[0]
    assert sorted(took[-15:])[7] < 2 * sorted(took[5:20])[7]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000


def test_keyed_table_deletes_and_grows(spark, tmp_path):
    path, rng, want = str(tmp_path / "t"), random.Random(1), {}
    batches = []
    for n in range(4):
        rows = [(rng.randint(0, 60), 100 * n + i, rng.choice(["update", "update", "delete"])) for i in range(80)]
        batches.append([*rows, (1, -1, "update")])  # an old version that comes late
    frame = lambda rows: spark.createDataFrame(rows, "k long, seq long, op string")
    for n, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again changes nothing
            keyed.merge(frame(rows), n, path, ["k"], ["seq"], "op", bucket_rows=20)
        for r in rows:
            if r[0] not in want or want[r[0]][1] < r[1]:
                want[r[0]] = r
        assert sorted(map(tuple, keyed.read(spark, path).collect())) == sorted(r for r in want.values() if r[2] != "delete")
    assert keyed.Files(spark, path).read(3)["buckets"] > 1
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


PAGE = "mid string, uid string, sid string, vc string, ch string, ar string, is_new string, page_id string, last_page_id string, item_type string, item string, during_time long, et timestamp, seq long"
LINE = "id string, seq long, order_id string, sku_id string, sku_num string, split_total_amount string, split_activity_amount string, split_coupon_amount string, create_time string, et timestamp, user_id string, province_id string"


def page_rows(rng, n):
    for seq in range(n):
        # in time order, some up to an hour late
        et = DAY + timedelta(minutes=20 * seq) - timedelta(minutes=rng.choice([0, 0, 0, 60]))
        user = rng.choice(["u1", "u2", "u3", None])
        yield (user, user, f"{user}_{seq // 7}", str(seq % 2), "c", "a", "1", rng.choice(["home", "good_detail", "x"]), rng.choice(["login", None, "home"]), "keyword", "red shoe", seq, et, seq)


def line_rows(rng, n):
    for seq in range(n):
        at = DAY + timedelta(minutes=11 * seq)
        made = at - timedelta(minutes=rng.choice([0, 0, 5, 90]))
        amount = rng.choice(["10.00", "3.33", "x1.00", None])
        yield (f"l{seq - rng.choice([0, 0, 1, 3])}", seq, f"o{seq // 3}", f"s{seq % 4}", rng.choice(["1", "2", "many"]), amount, "1.00", "0.50", str(made), at, rng.choice(["a", "b", "c", None]), rng.choice(["1", "2", None]))


END_PAGE = ("end", "end", "end", "e", "e", "e", "e", "home", None, "keyword", "end", 0, END, -1)
END_LINE = ("end", -1, "end", "end", "1", "1", "1", "1", str(END), END, "end", "end")
SKU = [("s0", "zero", "p", "pn", "t", "tn", "1", "a", "2", "b", "3", "c", "9.99")]
SKU_SCHEMA = "id string, sku_name string, spu_id string, spu_name string, trademark_id string, trademark_name string, category1_id string, category1_name string, category2_id string, category2_name string, category3_id string, category3_name string, price string"
JOBS = {
    "traffic": (PAGE, page_rows, END_PAGE, lambda s, r: windows.traffic_window(r, "1 hour", "2 hours")),
    "home_detail": (PAGE, page_rows, END_PAGE, lambda s, r: windows.home_detail_window(r, "1 hour", "2 hours")),
    "login": (PAGE, page_rows, END_PAGE, lambda s, r: windows.login_window(r, "1 hour", "2 hours")),
    "keyword": (PAGE, page_rows, (*END_PAGE[:8], "home", *END_PAGE[9:]), lambda s, r: windows.keyword_window(r, "1 hour", "2 hours")),
    "payment": (LINE, line_rows, END_LINE, lambda s, r: windows.payment_window(r, "1 hour", "2 hours")),
    "cart_uu": (LINE, line_rows, END_LINE, lambda s, r: windows.cart_uu_window(r, "1 hour", "2 hours")),
    "order": (LINE, line_rows, END_LINE, lambda s, r: windows.order_window(r.withColumn("create_time", F.col("create_time").cast("timestamp")), "1 hour", "2 hours")),
    "sku_order": (LINE, line_rows, END_LINE, lambda s, r: windows.sku_order_window(r, s.createDataFrame(SKU, SKU_SCHEMA), "1 hour", "3 hours")),
    "province_order": (LINE, line_rows, END_LINE, lambda s, r: windows.province_order_window(r, s.createDataFrame([("1", "one")], "id string, name string"), "1 hour", "3 hours")),
    "refund": (LINE, line_rows, END_LINE, lambda s, r: windows.refund_window(r, s.createDataFrame(SKU, SKU_SCHEMA), "1 hour", "2 hours")),
    "register": (LINE, line_rows, END_LINE, lambda s, r: windows.register_window(r.withColumn("create_time", F.col("et")), "create_time", "1 hour", "2 hours")),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_window_jobs_on_streams_give_what_they_give_on_batches(spark, tmp_path, name):
    """Three files in order of time and one that closes the windows, read in a batch each."""
    schema, make, end, job = JOBS[name]
    rows = list(make(random.Random(3), 360))
    when = 12 if schema == PAGE else 9
    rows.sort(key=lambda r: (r[when], r[1] if schema == LINE else r[13]))
    for k in range(3):
        put(spark, tmp_path / "in", rows[120 * k : 120 * k + 120], schema)
    put(spark, tmp_path / "in", [end], schema)
    out = job(spark, stream_of(spark, tmp_path / "in", schema))
    runners.append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = job(spark, spark.createDataFrame(rows, schema))
    assert sorted_rows(spark.read.parquet(str(tmp_path / "out")), want.columns) == sorted_rows(want, want.columns) != []


def test_first_version_of_a_line_over_late_versions(spark, tmp_path):
    """A line's first version counts; later ones don't, in its batch or after, while it is remembered."""
    at = lambda h: str(DAY + timedelta(hours=h))
    line = lambda i, seq, h, n: (i, seq, "o", "s0", str(n), "1.00", "0", "0", at(h), DAY, "a", "1")
    for rows in ([line("a", 2, 1, 20), line("a", 1, 1, 10), line("b", 3, 1, 1)], [line("a", 4, 1, 40), line("c", 5, 2, 5)], [line("a", 6, 2, 60), line("b", 7, 3, 70)], [END_LINE]):
        put(spark, tmp_path / "in", rows, LINE)
    out = windows.sku_order_window(stream_of(spark, tmp_path / "in", LINE), spark.createDataFrame(SKU, SKU_SCHEMA).withColumn("price", F.lit("1")), "1 hour", "1 day")
    runners.append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r.stt[11:13], str(r.original_amount)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("01", "11.00"), ("02", "5.00")}


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "user_id string, create_time timestamp"
    for hours in ([10], [11, 10], [3, 12]):  # 3 o'clock is later than the delay
        put(spark, tmp_path / "in", [("u", DAY + timedelta(hours=h)) for h in hours], schema)
    put(spark, tmp_path / "in", [("end", END)], schema)
    runners.append(windows.register_window(stream_of(spark, tmp_path / "in", schema), width="1 hour", delay="2 hours"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted((r.stt[11:13], r.register_ct) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("10", 2), ("11", 1), ("12", 1)]


def test_streams_without_files_give_no_rows(spark, tmp_path):
    out = windows.traffic_window(stream_of(spark, tmp_path / "in", PAGE), "1 hour")
    runners.append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = runners.rows(spark, str(tmp_path / "out"), out.schema)
    assert got.count() == 0 and got.columns == out.columns
    assert runners.rows(spark, str(tmp_path / "never"), out.schema).count() == 0
    runners.upsert(stream_of(spark, tmp_path / "in", SCHEMA), str(tmp_path / "table"), ["user"], ["seq"], str(tmp_path / "c2"))
    assert keyed.read(spark, str(tmp_path / "table"), SCHEMA).count() == 0
    assert dims.read(spark, str(tmp_path / "no-dims")) == {}


def test_a_running_query_emits_windows_as_they_close(spark, tmp_path):
    schema = "user_id string, create_time timestamp"
    out = windows.register_window(stream_of(spark, tmp_path / "in", schema, False), width="5 seconds")
    query = runners.append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"), every="500 milliseconds")
    try:
        for k, want in ((0, 0), (6, 1), (12, 2)):
            put(spark, tmp_path / "in", [("u", DAY + timedelta(seconds=k))], schema)
            until = time.time() + 60
            while (n := runners.rows(spark, str(tmp_path / "out"), out.schema).count()) < want and time.time() < until:
                time.sleep(0.3)
            assert n == want and query.isActive
    finally:
        query.stop()


LOG = "common map<string,string>, start map<string,string>, page map<string,string>, err map<string,string>, displays array<map<string,string>>, actions array<map<string,string>>, ts bigint, seq bigint"


def test_flag_repair_over_four_files_with_restarts(spark, tmp_path):
    """A device's first record decides for all later ones, whichever batch they come in."""
    rng, rows = random.Random(8), []
    for seq in range(400):
        ms = 1_714_521_600_000 + 3_600_000 * (seq // 3)
        rows.append(({"mid": rng.choice(["a"] * 8 + ["b", "c", f"n{seq}"]), "is_new": rng.choice("01"), "x": "y"}, None, {"page_id": "home"}, None, None, [{"ts": "5"}], ms, seq))
    for k in range(4):
        put(spark, tmp_path / "in", rows[100 * k : 100 * k + 100], LOG)
        stream = stream_of(spark, tmp_path / "in", LOG)
        runners.append(traffic.repair_is_new(stream, "seq", "30 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    uncommit(str(tmp_path / "checkpoint"), last_batch(str(tmp_path / "checkpoint")))
    runners.append(traffic.repair_is_new(stream_of(spark, tmp_path / "in", LOG), "seq", "30 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    flat = lambda df: sorted((r.seq, r.ts, tuple(sorted(r.common.items())), r.page["page_id"], r.actions[0]["ts"]) for r in df.collect())
    want = traffic.repair_is_new(spark.createDataFrame(rows, LOG), "seq")
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == flat(want)
    first = {}
    for common, *_, ms, _ in rows:
        day = ms // 86_400_000
        if common["mid"] not in first:
            first[common["mid"]] = day if common["is_new"] == "1" else day - 1
            stays = True
        else:
            stays = common["is_new"] != "1" or day == first[common["mid"]]
        common["want"] = common["is_new"] if stays else "0"
    assert [r.common["is_new"] for r in sorted(want.collect(), key=lambda r: r.seq)] == [r[0]["want"] for r in rows]


def test_silent_devices_are_forgotten(spark, tmp_path):
    row = lambda mid, day, seq: ({"mid": mid, "is_new": "1"}, None, {"p": "x"}, None, None, None, 1_714_521_600_000 + 86_400_000 * day, seq)
    # b is heard every day; a comes back after it was forgotten, and its flag stands again
    for day in range(8):
        put(spark, tmp_path / "in", [row("b", day, day)] + ([row("a", day, 100 + day)] if day in (0, 1, 7) else []), LOG)
    out = traffic.repair_is_new(stream_of(spark, tmp_path / "in", LOG), "seq", "1 hour", keep="3 days")
    runners.append(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r.common["mid"], r.seq % 100): r.common["is_new"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {**{("b", d): "1" if d == 0 else "0" for d in range(8)}, ("a", 0): "1", ("a", 1): "0", ("a", 7): "1"}


def change(table, op, ts, data, old=None):
    return ("shop", table, op, ts, data, old)


def test_join_state_ends_with_its_bound(spark, tmp_path):
    """Refunds wait seven days for their payments: their rows are in the state before, and gone after."""
    day, log = 86_400, topics.CHANGELOG
    refund = lambda i, ts: [change("order_refund_info", "update", ts, {"id": f"r{i}", "order_id": f"o{i}", "refund_status": "0702"}, {"refund_status": "0701"}), change("order_info", "update", ts, {"id": f"o{i}", "order_status": "1005"}, {"order_status": "1002"})]
    pay = lambda i, ts: [change("refund_payment", "update", ts, {"id": f"p{i}", "order_id": f"o{i}", "refund_status": "1602"}, {"refund_status": "0701"})]
    dic = spark.createDataFrame([("x", "y")], "id string, dic_name string")

    def run():
        log_ = stream_of(spark, tmp_path / "in", log)
        query = runners.append(facts.refund_pay(log_, facts.order_refund(log_, dic), dic), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        ops = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]]
        return ops, {(r.id, r.order_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put(spark, tmp_path / "in", [c for i in range(50) for c in refund(i, 1000 + i)] + pay(0, 1100), log)
    held, got = run()
    assert got == {("p0", "o0")} and sum(held) >= 50
    put(spark, tmp_path / "in", [c for i in range(50, 60) for c in refund(i, 1000 + 6 * day)] + pay(1, 1000 + 6 * day) + pay(99, 6 * day), log)
    held, got = run()
    assert got == {("p0", "o0"), ("p1", "o1")} and sum(held) >= 60
    put(spark, tmp_path / "in", refund(70, 40 * day) + pay(71, 40 * day), log)
    held, got = run()
    assert len(got) == 2 and sum(held) < 10


def test_rows_of_outer_joins_come_out_when_their_bound_has_passed(spark, tmp_path):
    line = lambda i, ts: change("order_detail", "insert", ts, {"id": f"d{i}", "order_id": f"o{i}"})
    order = lambda i, ts: change("order_info", "insert", ts, {"id": f"o{i}", "user_id": f"u{i}"})
    extra = lambda t, ts: change(t, "insert", ts, {"order_detail_id": "none"})
    both = lambda ts: [extra("order_detail_coupon", ts), extra("order_detail_activity", ts)]
    for rows in ([line(1, 100), line(2, 100), order(1, 105), order(2, 111), *both(100)], [line(3, 1000), order(9, 1000), *both(1000)], [line(4, 2000), order(4, 2000), *both(2000)]):
        put(spark, tmp_path / "in", rows, topics.CHANGELOG)
    runners.append(facts.order_detail(stream_of(spark, tmp_path / "in", topics.CHANGELOG)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r.id: r.user_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: got.get(k, "open") for k in ("d1", "d2", "d3")} == {"d1": "u1", "d2": None, "d3": None}


def test_interval_join_of_a_hot_key_is_spread(spark):
    """One user has a third of all rows; no task reads over twice the median's."""
    rng = random.Random(1)
    rows = [(("hot" if i % 3 == 0 else f"u{i}"), DAY + timedelta(seconds=rng.randint(0, 30 * 86_400)), i) for i in range(6000)]
    left = spark.createDataFrame(rows[:3000], "user_id string, pet timestamp, a long")
    right = spark.createDataFrame(rows[3000:], "user_id string, et timestamp, b long")
    got = facts.interval_join(left, right, "user_id", "pet", "et", "30 minutes")
    want = {(a, b) for u, p, a in rows[:3000] for v, e, b in rows[3000:] if u == v and p - timedelta(minutes=30) <= e <= p}
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 500
    stretch = F.floor(F.unix_micros("et") / 1_800_000_000)
    per = Counter(r[0] for r in right.repartition(8, "user_id", stretch).select(F.spark_partition_id()).collect())
    assert max(per.values()) < 2 * sorted(per.values())[4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__near" in plan and "Cartesian" not in plan


def test_appends_come_once_when_a_batch_runs_again(spark, tmp_path):
    schema = "id string, n long"
    path, checkpoint = str(tmp_path / "topic"), str(tmp_path / "checkpoint")

    put(spark, tmp_path / "in", [("a", 1), ("a", 1), ("b", None)], schema)
    put(spark, tmp_path / "in", [("c", 3)], schema)
    want = [("a", 1), ("a", 1), ("b", None), ("c", 3)]
    by = lambda rows: sorted(rows, key=str)
    runners.append_topic(stream_of(spark, tmp_path / "in", schema), path, checkpoint)
    read = lambda: by(tuple(r) for r in topics.parse_topic(topics.read_raw(spark, path), schema).collect())
    assert read() == by(want)
    uncommit(checkpoint, last_batch(checkpoint))
    runners.append_topic(stream_of(spark, tmp_path / "in", schema), path, checkpoint)
    assert read() == by(want)


def test_dimension_tables_when_the_config_changes_or_a_batch_runs_again(spark, tmp_path):
    fields = "source_table string, source_type string, sink_table string, sink_type string, sink_columns string, sink_row_key string"
    config = [("t", "ALL", "dim_t", "DIM", "id,a", "id"), ("u", "ALL", "dim_u", "DIM", "id", "id")]
    schema, path, checkpoint = topics.CHANGELOG + ", seq int", str(tmp_path / "dims"), str(tmp_path / "checkpoint")

    def run(rows):
        if rows:
            put(spark, tmp_path / "in", [(*change(*r), n) for n, r in enumerate(rows)], schema)
        dims.keep(stream_of(spark, tmp_path / "in", schema), lambda: spark.createDataFrame(config, fields), "shop", path, checkpoint, "seq")
        return {n: sorted_rows(t, t.columns) for n, t in dims.read(spark, path).items()}

    put_ = lambda t, ts, i, a, op="insert": (t, op, ts, {"id": i, "a": a, "b": a + "b"})
    assert run([put_("t", 1, "1", "x"), put_("t", 1, "2", "y"), put_("u", 1, "9", "z")]) == {"dim_t": [("1", "1", "x"), ("2", "2", "y")], "dim_u": [("9", "9")]}
    assert run([put_("t", 2, "1", "x", "delete"), put_("t", 2, "2", "z", "update"), put_("t", 0, "2", "old", "bootstrap-insert")]) == {"dim_t": [("2", "2", "z")], "dim_u": [("9", "9")]}
    uncommit(checkpoint, 1)
    assert run([]) == {"dim_t": [("2", "2", "z")], "dim_u": [("9", "9")]}
    # dim_t gets another column and begins anew, dim_u goes, dim_v comes
    config[:] = [("t", "ALL", "dim_t", "DIM", "id,b", "id"), ("v", "ALL", "dim_v", "DIM", "id", "id")]
    assert run([put_("t", 3, "3", "n")]) == {"dim_t": [("3", "3", "nb")], "dim_v": []}
    uncommit(checkpoint, 2)
    assert run([]) == {"dim_t": [("3", "3", "nb")], "dim_v": []}
    assert run([put_("t", 4, "4", "m"), put_("v", 4, "5", "q")]) == {"dim_t": [("3", "3", "nb"), ("4", "4", "mb")], "dim_v": [("5", "5")]}
    assert not glob.glob(f"{path}/dim_u-*") and not glob.glob(f"{path}/dim_t-0")


def test_topics_round_trip_and_dirty_rows(spark, tmp_path):
    raw = ['{"database":"shop","table":"cart_info","type":"insert","ts":5,"data":{"id":"1","sku_num":"2"}}', '{"database":"shop","table":"cart_info","type":"insert","ts":5,"data":{"id":"2","sku_num":"many"}}', "{broken", '{"type":"insert"}']
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text("\n".join(raw))
    topics.store_changelog(topics.read_raw(spark, str(tmp_path / "raw")), str(tmp_path / "stored"))
    stored = spark.read.schema(topics.CHANGELOG).parquet(str(tmp_path / "stored"))
    assert [(r.id, r.sku_num) for r in facts.cart_add_detail(stored).collect()] == [("1", 2)]
    assert "PartitionFilters: [isnotnull(table" in facts.cart_add_detail(stored)._jdf.queryExecution().executedPlan().toString()
    out = topics.as_json(stored.select("type", "ts"), topic=F.lit("t"), key="ts").collect()
    assert {tuple(r) for r in out} == {("t", "5", '{"type":"insert","ts":5}')}


def test_words_of_text_without_spaces(spark):
    got = spark.createDataFrame([("红色手机壳红色",), ("", ), (None,)], "t string").select(dictionary_words(F.col("t"), {"红色", "手机", "手机壳"}).alias("w")).collect()
    assert [r.w for r in got] == [["红色", "手机壳"], [], []]


def test_batch_plans_sort_no_history_of_a_key(spark):
    """First rows are partial sums; no window runs over all rows of a device or user."""
    pages = spark.createDataFrame(list(page_rows(random.Random(1), 20)), PAGE)
    lines = spark.createDataFrame(list(line_rows(random.Random(1), 20)), LINE)
    logs = spark.createDataFrame([({"mid": "a", "is_new": "1"}, None, {"p": "x"}, None, None, None, 5, 1)], LOG)
    jobs = [windows.traffic_window(pages), windows.home_detail_window(pages), windows.payment_window(lines), windows.sku_order_window(lines, spark.createDataFrame(SKU, SKU_SCHEMA)), traffic.repair_is_new(logs, "seq")]
    for job in jobs:
        plan = job._jdf.queryExecution().executedPlan().toString()
        assert "Window [" not in plan and "partial_min" in plan
