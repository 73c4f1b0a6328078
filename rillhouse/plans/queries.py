"""Registered queries of the warehouse jobs, and the same results in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillhouse.functions import changelog as ch
from rillhouse.functions.times import stamp, to_seconds
from rillhouse.operators import facts, routing, traffic, windows
from rillhouse.session import conf_set, shared_path
from rillhouse.sources import topics
from rillhouse.streaming import dims, keyed, ranges, runners

from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# --- pieces of SQL


def win(ts: str, seconds: int) -> str:
    """stt, edt and cur_date of the epoch-aligned window of a time."""
    us = seconds * 1_000_000
    at = f"(epoch_us({ts}) // {us}) * {us}"
    f = "strftime(make_timestamp({}), '%Y-%m-%d %H:%M:%S')"
    return f"{f.format(at)} AS stt, {f.format(f'{at} + {us}')} AS edt, CAST(make_timestamp({at}) AS DATE) AS cur_date"


PAGE = """page AS (
  SELECT CAST(user_id AS VARCHAR) AS mid, CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS uid,
    user_id || '_' || strftime(ts, '%Y-%m-%d') AS sid, CAST(user_id % 3 AS VARCHAR) AS vc, CAST(user_id % 4 AS VARCHAR) AS ch, CAST(user_id % 5 AS VARCHAR) AS ar,
    CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END AS is_new,
    CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'good_detail' WHEN 'purchase' THEN 'payment' WHEN 'signup' THEN 'login' WHEN 'error' THEN 'search' END AS page_id,
    CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'good_detail' END AS last_page_id,
    CASE WHEN event_type IN ('view', 'click') THEN p_name END AS item, CAST(floor(value * 100) AS BIGINT) AS during_time, ts AS et, event_id AS seq
  FROM events LEFT JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part))"""
OD = """od AS (
  SELECT l_orderkey || '-' || l_linenumber AS id,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
    CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku_id, CAST(l_quantity AS INTEGER) AS sku_num,
    CAST(l_extendedprice AS DECIMAL(16,2)) AS total, CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_discount AS DECIMAL(16,2)) AS DECIMAL(16,2)) AS act,
    CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_tax AS DECIMAL(16,2)) AS DECIMAL(16,2)) AS cou,
    o_orderdate + to_seconds(o_orderkey % 86400) AS create_time, CAST(o_custkey AS VARCHAR) AS user_id, CAST(c_nationkey AS VARCHAR) AS province_id,
    l_returnflag, l_linenumber, l_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(16,2)) AS o_total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""
LINE = "line AS (SELECT * FROM od WHERE seq = 1)"
DIC = "dic(id, dic_name) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in fx.DIC.items()) + ")"
SKU = """sku AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS sku_name, CAST(p_size AS VARCHAR) AS spu_id, 'spu ' || p_size AS spu_name, p_brand AS trademark_id, 'tm ' || p_brand AS trademark_name,
    CAST(s_suppkey AS VARCHAR) AS category3_id, s_name AS category3_name, CAST(n_nationkey AS VARCHAR) AS category2_id, n_name AS category2_name, CAST(r_regionkey AS VARCHAR) AS category1_id, r_name AS category1_name,
    CAST(p_retailprice AS DECIMAL(16,2)) AS price
  FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
CHAIN = "sku_name, spu_id, spu_name, trademark_id, trademark_name, category1_id, category1_name, category2_id, category2_name, category3_id, category3_name"
DETAIL = """detail AS (
  SELECT id, order_id, sku_id, CAST(sku_num AS VARCHAR) AS sku_num, CAST(total AS VARCHAR) AS split_total_amount, CAST(act AS VARCHAR) AS split_activity_amount, CAST(cou AS VARCHAR) AS split_coupon_amount,
    strftime(create_time, '%Y-%m-%d %H:%M:%S') AS create_time, CAST(epoch(create_time) AS BIGINT) - (l_orderkey * 7 + l_linenumber) % 3600 AS ts, user_id, province_id,
    CASE WHEN cou > 0 THEN CAST(l_orderkey % 11 AS VARCHAR) END AS coupon_id, CASE WHEN cou > 0 THEN CAST(l_orderkey % 13 AS VARCHAR) END AS coupon_use_id,
    CASE WHEN act > 0 THEN CAST(l_orderkey % 5 AS VARCHAR) END AS activity_id, CASE WHEN act > 0 THEN CAST(l_orderkey % 7 AS VARCHAR) END AS activity_rule_id,
    o_orderstatus, l_orderkey, o_total, CAST(epoch(create_time) AS BIGINT) AS sec
  FROM line)"""
DETAIL_COLUMNS = "id, order_id, sku_id, sku_num, split_total_amount, split_activity_amount, split_coupon_amount, create_time, ts, user_id, province_id, coupon_id, coupon_use_id, activity_id, activity_rule_id"


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The changelog that the facts read, made and stored where that was not done yet."""
    return fx.stored_changelog(spark, d)


_log = stored


# --- plain windows


def _users(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return fx.table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", F.col("ts").alias("et"), F.col("ts").alias("create_time"), F.col("event_id").alias("seq"))


for _name, _width, _s in (("register_window", "5 seconds", 5), ("register_window_day", "1 day", 86400)):
    query(f"SELECT {win('ts', _s)}, count(*) AS register_ct FROM events WHERE event_type = 'signup' GROUP BY ALL", _name)(lambda spark, d, w=_width: windows.register_window(_users(spark, d, "signup"), width=w))


@query(f"SELECT {win('ts', 3600)}, count(DISTINCT user_id) AS cart_add_uu_ct FROM events WHERE event_type = 'click' GROUP BY ALL")
def cart_uu_window(spark, d):
    return windows.cart_uu_window(_users(spark, d, "click"), width="1 hour")


@query(f"""WITH {PAGE}, w AS (SELECT et, unnest(list_distinct([x FOR x IN regexp_split_to_array(lower(item), '[^a-z0-9]+') IF x <> ''])) AS keyword FROM page WHERE last_page_id IN ('home', 'search') AND item IS NOT NULL)
SELECT {win('et', 3600)}, keyword, count(*) AS keyword_count FROM w GROUP BY ALL""")
def keyword_window(spark, d):
    return windows.keyword_window(fx.page_log(spark, d), width="1 hour")


@query(f"""WITH t AS (SELECT make_timestamp((doc_id * 60) * 1000000) AS et, unnest(list_distinct([x FOR x IN regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+') IF x <> ''])) AS keyword FROM documents)
SELECT {win('et', 86400)}, keyword, count(*) AS keyword_count FROM t GROUP BY ALL""")
def keyword_documents(spark, d):
    docs = fx.table(spark, d, "documents").select(F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, doc_id, 0)").alias("et"), F.lit("home").alias("last_page_id"), F.lit("keyword").alias("item_type"), F.col("text").alias("item"))
    return windows.keyword_window(docs, width="1 day")


@query(f"""WITH {PAGE}, m AS (SELECT *, row_number() OVER (PARTITION BY mid, CAST(et AS DATE) ORDER BY et, seq) = 1 AS uv, row_number() OVER (PARTITION BY sid ORDER BY et, seq) = 1 AS sv FROM page)
SELECT {win('et', 3600)}, vc, ch, ar, is_new, CAST(sum(CASE WHEN uv THEN 1 ELSE 0 END) AS BIGINT) AS uv_ct, CAST(sum(CASE WHEN sv THEN 1 ELSE 0 END) AS BIGINT) AS sv_ct, count(*) AS pv_ct, CAST(sum(during_time) AS BIGINT) AS dur_sum FROM m GROUP BY ALL""")
def traffic_window(spark, d):
    return windows.traffic_window(fx.page_log(spark, d), width="1 hour")


@query(f"""WITH {PAGE}, m AS (SELECT *, row_number() OVER (PARTITION BY mid, page_id, CAST(et AS DATE) ORDER BY et, seq) AS n FROM page WHERE page_id IN ('home', 'good_detail'))
SELECT {win('et', 3600)}, CAST(sum(CASE WHEN page_id = 'home' THEN 1 ELSE 0 END) AS BIGINT) AS home_uv_ct, CAST(sum(CASE WHEN page_id = 'good_detail' THEN 1 ELSE 0 END) AS BIGINT) AS good_detail_uv_ct FROM m WHERE n = 1 GROUP BY ALL""")
def home_detail_window(spark, d):
    return windows.home_detail_window(fx.page_log(spark, d), width="1 hour")


@query(f"""WITH {PAGE}, m AS (SELECT uid, et, CAST(et AS DATE) AS day, row_number() OVER (PARTITION BY uid, CAST(et AS DATE) ORDER BY et, seq) AS n FROM page WHERE uid IS NOT NULL AND last_page_id = 'login'),
b AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY uid ORDER BY day), day) > 7 AS back FROM m WHERE n = 1)
SELECT {win('et', 86400)}, CAST(sum(CASE WHEN back THEN 1 ELSE 0 END) AS BIGINT) AS back_ct, count(*) AS uu_ct FROM b GROUP BY ALL""")
def login_window(spark, d):
    return windows.login_window(fx.page_log(spark, d), width="1 day")


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase')
SELECT {win('ts', 3600)}, count(*) AS payment_suc_unique_user_count, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS payment_suc_new_user_count FROM m WHERE n = 1 GROUP BY ALL""")
def payment_window(spark, d):
    return windows.payment_window(_users(spark, d, "purchase"), width="1 hour")


@query(f"""WITH {OD}, m AS (SELECT *, min(create_time) OVER (PARTITION BY user_id, CAST(create_time AS DATE) ORDER BY create_time) AS df, min(create_time) OVER (PARTITION BY user_id ORDER BY create_time) AS f FROM od WHERE user_id IS NOT NULL)
SELECT {win('create_time', 86400)}, count(DISTINCT CASE WHEN df = create_time THEN user_id END) AS order_unique_user_count, count(DISTINCT CASE WHEN f = create_time THEN user_id END) AS order_new_user_count FROM m GROUP BY ALL""")
def order_window(spark, d):
    return windows.order_window(fx.detail_versions(spark, d).withColumn("et", F.col("create_time")), width="1 day")


@query(f"WITH {SKU} SELECT id, {CHAIN} FROM sku")
def wide_sku_dim(spark, d):
    return fx.wide_sku(spark, d).drop("price")


@query(f"""WITH {OD}, {SKU}, {LINE}, g AS (SELECT {win('create_time', 86400)}, sku_id, sum(sku_num) AS n, sum(act) AS a, sum(cou) AS c, sum(total) AS t FROM line GROUP BY ALL)
SELECT stt, edt, cur_date, sku_id, {CHAIN}, CAST(CAST(n AS INTEGER) * price AS DECIMAL(16,2)) AS original_amount, CAST(a AS DECIMAL(16,2)) AS activity_reduce_amount, CAST(c AS DECIMAL(16,2)) AS coupon_reduce_amount, CAST(t AS DECIMAL(16,2)) AS order_amount FROM g LEFT JOIN sku ON sku.id = sku_id""")
def sku_order_window(spark, d):
    return windows.sku_order_window(fx.detail_versions(spark, d), fx.wide_sku(spark, d), width="1 day")


@query(f"""WITH {OD}, g AS (SELECT {win('create_time', 86400)}, id, province_id, order_id, sum(total) AS s, count(*) AS n FROM od WHERE province_id IS NOT NULL GROUP BY ALL),
a AS (SELECT stt, edt, cur_date, province_id, order_id, CAST((2 * CAST(s * 100 * 10000 AS HUGEINT) + n) // (2 * n) AS HUGEINT) AS m FROM g),
t AS (SELECT stt, edt, cur_date, province_id, count(DISTINCT order_id) AS order_count, sum(m) AS m FROM a GROUP BY ALL)
SELECT stt, edt, cur_date, province_id, n_name AS province_name, order_count, CAST(CAST((2 * CAST(m AS HUGEINT) + 10000) // 20000 AS DECIMAL(20,0)) / 100 AS DECIMAL(16,2)) AS order_amount FROM t LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = province_id""")
def province_order_window(spark, d):
    return windows.province_order_window(fx.detail_versions(spark, d), fx.province(spark, d), width="1 day")


@query(f"""WITH {OD}, {SKU}, {LINE} SELECT {win('create_time', 86400)}, trademark_id, trademark_name, category1_id, category1_name, category2_id, category2_name, category3_id, category3_name, user_id, count(*) AS refund_count
FROM line LEFT JOIN sku ON sku.id = sku_id WHERE l_returnflag = 'R' GROUP BY ALL""")
def refund_window(spark, d):
    return windows.refund_window(fx.detail_versions(spark, d).where("seq = 1 and l_returnflag = 'R'").withColumn("et", F.col("create_time")), fx.wide_sku(spark, d), width="1 day")


# --- versions, changes


VERSION = "SELECT id, seq, order_id, sku_id, sku_num, total AS split_total_amount FROM od"


@query(f"WITH {OD} {VERSION} WHERE seq = 1")
def first_version(spark, d):
    return ch.first_per_key(fx.detail_versions(spark, d).select("id", "seq", "order_id", "sku_id", "sku_num", "split_total_amount"), ["id"], ["seq"])


@query(f"WITH {OD} SELECT id, seq, order_id, sku_id, sku_num, total AS split_total_amount FROM (SELECT *, max(seq) OVER (PARTITION BY id) AS last FROM od) WHERE seq = last AND sku_num % 5 <> 0")
def latest_version(spark, d):
    """The last version; one with a number of pieces divisible by 5 is a deletion."""
    rows = fx.detail_versions(spark, d).select("id", "seq", "order_id", "sku_id", "sku_num", "split_total_amount").withColumn("op", F.when(F.col("sku_num") % 5 == 0, "delete").otherwise("update"))
    return ch.latest_per_key(rows, ["id"], ["seq"], op="op").drop("op")


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'bootstrap-insert' ELSE 'insert' END AS type, CAST(epoch(ts) AS BIGINT) AS ts, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0")
def changelog_valid(spark, d):
    """Malformed rows, rows of another database, of an unknown type and without data are dropped."""
    e = fx.table(spark, d, "events")
    i = F.col("event_id")
    kind = F.when(i % 17 == 0, "truncate").when(i % 5 == 0, "bootstrap-insert").otherwise("insert")
    data = F.when(i % 19 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("id"), i.cast("string")))
    row = F.struct(F.when(i % 13 == 0, "other").otherwise(fx.DATABASE).alias("database"), F.lit("t").alias("table"), kind.alias("type"), to_seconds("ts").alias("ts"), data.alias("data"))
    raw = e.select(F.when(i % 11 == 0, F.lit("{broken")).otherwise(F.to_json(row)).alias("value"))
    good = ch.valid(topics.parse_changelog(raw), fx.DATABASE)
    return good.select(F.col("data")["id"].cast("bigint").alias("id"), "type", "ts", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day"))


@query("SELECT event_id AS id, event_type AS kind, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_id % 7 <> 0")
def parse_topic(spark, d):
    """A typed topic with deletions and times in milliseconds."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz '1970-01-01 00:00:00', ts)")
    raw = fx.table(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), ms.alias("ms")))).alias("value"))
    return topics.parse_topic(raw, "id bigint, kind string, ms bigint").select("id", "kind", "ms", stamp(F.timestamp_millis("ms")).alias("at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS operate_time FROM orders WHERE o_orderstatus = 'P'")
def status_transition(spark, d):
    return ch.pick(ch.transition(_log(spark, d), "order_info", "order_status", "1001", "1003"), "id", "operate_time").drop("ts")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS province_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'O'")
def column_changed(spark, d):
    return ch.pick(ch.transition(_log(spark, d), "order_info", "order_status", None, "1005"), "id", "province_id").drop("ts")


@query("""WITH c AS (SELECT *, event_id % 2 = 1 AS up, 1 + event_id % 5 AS new, CASE WHEN event_id % 7 <> 0 THEN 1 + event_id % 4 END AS old FROM events WHERE event_type = 'click')
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 97 AS VARCHAR) AS sku_id, CAST(event_id % 89 AS VARCHAR) AS cart_price, 'sku ' || event_id % 97 AS sku_name, CAST(CASE WHEN up THEN new - old ELSE new END AS INTEGER) AS sku_num, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts
FROM c WHERE NOT up OR new > old""")
def cart_add_detail(spark, d):
    return facts.cart_add_detail(fx.cart_changes(spark, d))


# --- facts


@query(f"WITH {OD}, {LINE}, {DETAIL} SELECT {DETAIL_COLUMNS} FROM detail")
def order_detail(spark, d):
    return facts.order_detail(_log(spark, d)).drop("et")


@query(f"WITH {OD}, {LINE}, {DETAIL} SELECT {DETAIL_COLUMNS}, create_time AS cancel_time FROM detail WHERE o_orderstatus = 'P'")
def cancel_detail(spark, d):
    log = _log(spark, d)
    return facts.cancel_detail(log, facts.order_detail(log)).drop("et")


@query(f"""WITH {OD}, {LINE}, {DETAIL}, {DIC} SELECT 'p' || l_orderkey AS id, user_id, order_id, CAST(l_orderkey * 3 AS VARCHAR) AS trade_no, CAST(o_total AS VARCHAR) AS total_amount, '1602' AS payment_status, CAST(1101 + l_orderkey % 3 AS VARCHAR) AS payment_type, create_time AS callback_time, sec AS ts,
detail.id AS order_detail_id, sku_id, sku_num, split_total_amount, split_activity_amount, split_coupon_amount, create_time, province_id, coupon_id, coupon_use_id, activity_id, activity_rule_id, s.dic_name AS payment_status_name, t.dic_name AS payment_type_name
FROM detail LEFT JOIN dic s ON s.id = '1602' LEFT JOIN dic t ON t.id = CAST(1101 + l_orderkey % 3 AS VARCHAR) WHERE o_orderstatus = 'F' AND ts BETWEEN sec - 1800 AND sec""")
def pay_detail(spark, d):
    log = _log(spark, d)
    return facts.pay_detail(log, facts.order_detail(log), fx.dic(spark)).drop("et")


for _name, _back, _s in (("event_interval_join", "30 minutes", 1800), ("event_interval_join_day", "1 day", 86400)):
    query(f"SELECT p.event_id AS pay_id, c.event_id AS click_id, p.user_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - to_seconds({_s}) AND p.ts WHERE p.event_type = 'purchase' AND c.event_type = 'click'", _name)(
        lambda spark, d, b=_back: facts.interval_join(_users(spark, d, "purchase").select(F.col("seq").alias("pay_id"), "user_id", F.col("et").alias("pet")), _users(spark, d, "click").select(F.col("seq").alias("click_id"), "user_id", "et"), "user_id", "pet", "et", b).select("pay_id", "click_id", "user_id")
    )

REFUND = """refund AS (
  SELECT 'r' || line.id AS id, user_id, order_id, sku_id, CAST(1501 + l_orderkey % 2 AS VARCHAR) AS refund_type, CAST(sku_num AS VARCHAR) AS refund_num, CAST(total AS VARCHAR) AS refund_amount, CAST(1301 + l_orderkey % 4 AS VARCHAR) AS refund_reason_type, 'why ' || l_linenumber AS refund_reason_txt,
    strftime(create_time, '%Y-%m-%d %H:%M:%S') AS operate_time, CAST(epoch(create_time) AS BIGINT) AS ts, province_id, a.dic_name AS refund_type_name, b.dic_name AS refund_reason_type_name, l_orderkey
  FROM line LEFT JOIN dic a ON a.id = CAST(1501 + l_orderkey % 2 AS VARCHAR) LEFT JOIN dic b ON b.id = CAST(1301 + l_orderkey % 4 AS VARCHAR)
  WHERE l_returnflag = 'R' AND o_orderstatus <> 'O')"""


@query(f"WITH {OD}, {LINE}, {DIC}, {REFUND} SELECT * EXCLUDE l_orderkey FROM refund")
def order_refund(spark, d):
    return facts.order_refund(_log(spark, d), fx.dic(spark)).drop("et")


@query(f"""WITH {OD}, {LINE}, {DIC}, {REFUND} SELECT 'rp' || l_orderkey AS id, order_id, CAST(l_orderkey + 5 AS VARCHAR) AS out_trade_no, '1602' AS refund_status, CAST(1101 + l_orderkey % 4 AS VARCHAR) AS payment_type, CAST(l_orderkey * 2 AS VARCHAR) AS trade_no, operate_time AS callback_time, ts,
user_id, sku_id, refund_type, refund_num, refund_amount, refund_reason_type, refund_reason_txt, operate_time, province_id, refund_type_name, refund_reason_type_name, s.dic_name AS refund_status_name, t.dic_name AS payment_type_name
FROM refund LEFT JOIN dic s ON s.id = '1602' LEFT JOIN dic t ON t.id = CAST(1101 + l_orderkey % 4 AS VARCHAR) WHERE l_orderkey % 2 = 0""")
def refund_pay(spark, d):
    log = _log(spark, d)
    return facts.refund_pay(log, facts.order_refund(log, fx.dic(spark)), fx.dic(spark))


@query(f"""WITH {DIC} SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey % 97 AS VARCHAR) AS sku_id, CAST(o_orderkey % 9 AS VARCHAR) AS spu_id, CAST(o_orderkey AS VARCHAR) AS order_id, CAST(1201 + o_orderkey % 4 AS VARCHAR) AS appraise, o_orderpriority AS comment_txt,
strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS create_time, CAST(epoch(o_orderdate + to_seconds(o_orderkey % 86400)) AS BIGINT) AS ts, dic_name AS appraise_name FROM orders LEFT JOIN dic ON dic.id = CAST(1201 + o_orderkey % 4 AS VARCHAR) WHERE o_orderkey % 5 = 0""")
def comment_detail(spark, d):
    return facts.comment_detail(_log(spark, d), fx.dic(spark))


# --- app log

LOGS = """log AS (SELECT *, CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 AS ms, CAST(user_id AS VARCHAR) AS mid, CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END AS is_new FROM events WHERE event_id % 50 <> 1 AND event_id % 51 <> 2)"""


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return traffic.log_clean(topics.parse_log(fx.log_json(spark, d)))


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.col("record")[k].alias(k) for k in keys], F.size("record").cast("bigint").alias("n_fields"))


@query(f"WITH {LOGS} SELECT event_id AS seq, ms AS ts FROM log")
def log_clean(spark, d):
    return _logs(spark, d).select("seq", "ts")


@query(f"""WITH {LOGS}, f AS (SELECT *, first_value(is_new) OVER w AS fn, CAST(make_timestamp(first_value(ms) OVER w * 1000) AS DATE) AS fd, row_number() OVER w AS n, CAST(make_timestamp(ms * 1000) AS DATE) AS day FROM log WINDOW w AS (PARTITION BY mid ORDER BY ms, event_id))
SELECT event_id AS seq, mid, CASE WHEN n > 1 AND is_new = '1' AND day <> CASE WHEN fn = '1' THEN fd ELSE fd - 1 END THEN '0' ELSE is_new END AS is_new FROM f""")
def repair_is_new(spark, d):
    out = traffic.repair_is_new(_logs(spark, d), "seq")
    return out.select("seq", F.col("common")["mid"].alias("mid"), F.col("common")["is_new"].alias("is_new"))


@query(f"WITH {LOGS} SELECT 'start' AS mid, is_new, CAST(ms AS VARCHAR) AS ts, 'icon' AS entry, CAST(5 AS BIGINT) AS n_fields FROM log WHERE event_type = 'signup'")
def split_start(spark, d):
    return _flat(traffic.start(_logs(spark, d)), "mid", "is_new", "ts", "entry")


@query(f"WITH {LOGS} SELECT mid, is_new, 'page' AS ts, event_type AS page_id, CAST(event_id AS VARCHAR) AS item, CAST(5 AS BIGINT) AS n_fields FROM log WHERE event_type <> 'signup'")
def split_page(spark, d):
    return _flat(traffic.page(_logs(spark, d)), "mid", "is_new", "ts", "page_id", "item")


@query(f"WITH {LOGS} SELECT mid, is_new, 'page' AS ts, event_type AS page_id, CAST(event_id AS VARCHAR) AS item, CAST(event_id % 7 AS VARCHAR) AS error_code, CAST(6 AS BIGINT) AS n_fields FROM log WHERE event_type = 'error'")
def split_err(spark, d):
    return _flat(traffic.err(_logs(spark, d)), "mid", "is_new", "ts", "page_id", "item", "error_code")


@query(f"WITH {LOGS} SELECT mid, is_new, CAST(ms + k AS VARCHAR) AS ts, event_type AS page_id, CAST(event_id AS VARCHAR) AS item, 'a' || k AS action_id, CAST(6 AS BIGINT) AS n_fields FROM log, (VALUES (1), (2)) v(k) WHERE event_type = 'click'")
def split_action(spark, d):
    return _flat(traffic.action(_logs(spark, d)), "mid", "is_new", "ts", "page_id", "item", "action_id")


@query(f"WITH {LOGS} SELECT mid, is_new, 'page' AS ts, event_type AS page_id, CAST(event_id AS VARCHAR) AS item, 'd' AS display_type, CAST(event_id % 5 AS VARCHAR) AS pos, CAST(7 AS BIGINT) AS n_fields FROM log WHERE event_type = 'click'")
def split_display(spark, d):
    return _flat(traffic.display(_logs(spark, d)), "mid", "is_new", "ts", "page_id", "item", "display_type", "pos")


# --- routing

ROUTES = "source_table string, source_type string, sink_table string, sink_type string, sink_columns string, sink_row_key string"


def _routes(spark: SparkSession, *rows: tuple) -> DataFrame:
    change = f"op string, before struct<{ROUTES.replace(' string', ': string')}>, after struct<{ROUTES.replace(' string', ': string')}>, seq int"
    return spark.createDataFrame([(op, b, a, i) for i, (op, b, a) in enumerate(rows)], change)


@query("""WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT 'dim_order' AS sink_table, k AS row_key, CAST(c_nationkey AS VARCHAR) AS province_id, CAST(NULL AS VARCHAR) AS comment_txt, CASE WHEN o_orderstatus = 'O' THEN 'insert' ELSE 'update' END AS op_type FROM o
UNION ALL SELECT 'dim_comment', k, NULL, o_orderpriority, 'insert' FROM o WHERE o_orderkey % 5 = 0""")
def dim_tables(spark, d):
    """Dimension rows of two tables under a config that was changed and partly deleted."""
    a = ("order_info", "ALL", "dim_order", "DIM", "id,province_id", "id")
    b = ("comment_info", "ALL", "dim_comment", "DIM", "id, comment_txt", "id")
    gone = ("payment_info", "ALL", "dim_pay", "DIM", "id", "id")
    cfg = routing.current_config(_routes(spark, ("r", None, (*a[:4], "id", "id")), ("r", None, gone), ("u", None, a), ("c", None, b), ("d", gone, None), ("c", None, ("order_info", "insert", "fact", "DWD", "id", "id"))), "DIM")
    log = _log(spark, d).withColumn("seq", F.when(F.col("type") == "insert", 0).otherwise(1))
    return routing.dim_rows(log, cfg, fx.DATABASE, "seq").select("sink_table", "row_key", F.col("data")["province_id"].alias("province_id"), F.col("data")["comment_txt"].alias("comment_txt"), "op_type")


@query("""SELECT 'fact_order' AS sink_table, CAST(o_orderkey AS VARCHAR) AS id, 'insert' AS op_type, CAST(2 AS BIGINT) AS n FROM orders
UNION ALL SELECT 'fact_cancel', CAST(o_orderkey AS VARCHAR), 'update', CAST(2 AS BIGINT) FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'fact_all', CAST(o_orderkey AS VARCHAR), 'insert', CAST(1 AS BIGINT) FROM orders WHERE o_orderkey % 5 = 0""")
def route_facts(spark, d):
    rows = [("order_info", "insert", "fact_order", "DWD", "id,province_id", None), ("order_info", "update,delete", "fact_cancel", "DWD", "id,operate_time", None), ("comment_info", "ALL", "fact_all", "DWD", "id", None)]
    cfg = routing.current_config(_routes(spark, *[("c", None, r) for r in rows]), "DWD")
    out = routing.route_facts(topics.parse_changelog(fx.changelog(spark, d, "order", "cancel", "comment")), cfg, fx.DATABASE)
    return out.select("sink_table", F.col("data")["id"].alias("id"), "op_type", F.size("data").cast("bigint").alias("n"))


# --- streams over the tables' files


#: Whether a state store counts its rows, for metrics alone: a read for each write.
_COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
#: Rows that a part of a stream's state takes, about: a part's store costs about half a second of a core in each
#: batch, however few its rows.
_PARTS, PART_ROWS = "spark.sql.shuffle.partitions", 50_000


def _parts(spark: SparkSession, rows: int | None) -> int:
    """Parts of the state of a stream of so many rows: one for each core at least, and no more than the session says."""
    given = int(spark.conf.get(_PARTS))
    return given if rows is None else min(given, max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def _appended(spark: SparkSession, out: DataFrame, rows: int | None = None) -> DataFrame:
    """All that a stream appends, of so many rows where that is known."""
    path = shared_path(spark, "appended")
    with conf_set(spark, _COUNTED, "false"), conf_set(spark, _PARTS, _parts(spark, rows)):
        runners.append(out, path, shared_path(spark, "appended-checkpoint"))
    return runners.rows(spark, path, out.schema)


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a file stream reads a folder: the glob takes the table whether it is a file or a folder
    return spark.readStream.schema(fx.table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


@query("SELECT user_id, event_id AS seq, event_type AS last_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 5 <> 0")
def stream_upsert(spark, d):
    """Each user's last event, kept by an upsert from a stream; every fifth event deletes its user."""
    path, checkpoint = shared_path(spark, "upsert"), shared_path(spark, "upsert-checkpoint")
    op = F.when(F.col("event_id") % 5 == 0, "delete").otherwise("update")
    rows = _stream(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("last_type"), op.alias("op"))
    runners.upsert(rows, path, ["user_id"], ["seq"], checkpoint, op="op")
    return keyed.read(spark, path).select("user_id", "seq", "last_type")


@query("SELECT event_id AS seq, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 AS is_first FROM events WHERE event_type = 'purchase'")
def stream_first_of_day(spark, d):
    """Every purchase, marked if it is its user's first of the day."""
    out = windows.marked_first_of_day(_event_stream(spark, d, "purchase"), "user_id").select("seq", "user_id", "is_first")
    return _appended(spark, out, fx.table(spark, d, "events").where("event_type = 'purchase'").count()).where("seq >= 0")


@query("SELECT 'fact_order' AS sink_table, CAST(o_orderkey AS VARCHAR) AS id, 'insert' AS op_type FROM orders UNION ALL SELECT 'fact_comment', CAST(o_orderkey AS VARCHAR), 'insert' FROM orders WHERE o_orderkey % 5 = 0")
def stream_route(spark, d):
    """Changes as raw JSON in a topic of files, routed by a config that each batch reads anew."""
    topic, config, path = (shared_path(spark, n) for n in ("topic", "config", "routed"))
    fx.changelog(spark, d, "order", "comment").write.text(topic)
    spark.createDataFrame([("order_info", "insert", "fact_order", "DWD", "id", "id"), ("comment_info", "ALL", "fact_comment", "DWD", "id", "id"), ("comment_info", "ALL", "dim_comment", "DIM", "id", "id")], ROUTES).write.parquet(config)
    log = topics.parse_changelog(topics.read_raw(spark, topic, stream=True))
    load = lambda: topics.load_config(spark, config, "DWD")
    runners.with_config(log, load, lambda batch, cfg: routing.route_facts(batch, cfg, fx.DATABASE), path, shared_path(spark, "routed-checkpoint"))
    return spark.read.parquet(path).select("sink_table", F.col("data")["id"].alias("id"), "op_type")


@query(f"""WITH {LOGS} SELECT 'start' AS part, 'start' AS mid, is_new, CAST(ms AS VARCHAR) AS ts, NULL AS page_id, 'common' AS item, 'icon' AS extra, CAST(5 AS BIGINT) AS n_fields FROM log WHERE event_type = 'signup'
UNION ALL SELECT 'page', mid, is_new, 'page', event_type, CAST(event_id AS VARCHAR), NULL, 5 FROM log WHERE event_type <> 'signup'
UNION ALL SELECT 'err', mid, is_new, 'page', event_type, CAST(event_id AS VARCHAR), CAST(event_id % 7 AS VARCHAR), 6 FROM log WHERE event_type = 'error'
UNION ALL SELECT 'action', mid, is_new, CAST(ms + k AS VARCHAR), event_type, CAST(event_id AS VARCHAR), 'a' || k, 6 FROM log, (VALUES (1), (2)) v(k) WHERE event_type = 'click'
UNION ALL SELECT 'display', mid, is_new, 'page', event_type, CAST(event_id AS VARCHAR), 'd', 7 FROM log WHERE event_type = 'click'""")
def stream_split(spark, d):
    """App logs from a topic of files, split in one pass into five outputs."""
    topic, path = shared_path(spark, "log-topic"), shared_path(spark, "split")
    fx.log_json(spark, d).select("value").write.text(topic)
    log = traffic.log_clean(topics.parse_log(topics.read_raw(spark, topic, stream=True)))
    parts = {f.__name__: f for f in (traffic.start, traffic.page, traffic.err, traffic.action, traffic.display)}
    runners.fan_out(log, parts, path, shared_path(spark, "split-checkpoint"))
    value = lambda k: F.col("record")[k].alias(k)
    extra = F.coalesce(*[F.col("record")[k] for k in ("entry", "error_code", "action_id", "display_type")]).alias("extra")
    rows = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), *map(value, ("mid", "is_new", "ts", "page_id", "item")), extra, F.size("record").cast("bigint").alias("n_fields")) for name in parts]
    return reduce(DataFrame.unionByName, rows)


def _closed(spark: SparkSession, rows: DataFrame, **values: str) -> DataFrame:
    """Rows as a stream of files, and a row after all others, which closes the windows. It has the given
    values and passes the jobs' filters, as rows that these drop don't move the watermark."""
    path = shared_path(spark, "stream")
    rows.unionByName(_end(spark, rows, **values)).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _end(spark: SparkSession, rows: DataFrame, **values: str) -> DataFrame:
    made = {"timestamp": fx.END, "string": "end", "boolean": "true"}
    return spark.range(1).select(*[F.lit(values.get(c, made.get(t, "-1"))).cast(t).alias(c) for c, t in rows.dtypes])


def _event_stream(spark: SparkSession, d: str, kind: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return _closed(spark, fx.table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", at.alias("et"), at.alias("create_time"), F.col("event_id").alias("seq")))


def _page_stream(spark: SparkSession, d: str, last_page: str = "home") -> DataFrame:
    return _closed(spark, fx.page_log(spark, d).withColumn("et", F.col("et").cast("timestamp")), page_id="home", last_page_id=last_page, item_type="keyword")


def _line_stream(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Versions of order lines."""
    at = F.col("create_time").cast("timestamp")
    return _closed(spark, fx.detail_versions(spark, d).where(where).withColumn("create_time", at).withColumn("et", at))


#: The window jobs on streams: their stream and job, an hour wide, and the batch query whose SQL (of
#: windows so many seconds wide) says what must come out.
STREAMS = {
    "register_window_day": (lambda s, d: _event_stream(s, d, "signup"), lambda s, d, r, w: windows.register_window(r, width=w), 86400),
    "cart_uu_window": (lambda s, d: _event_stream(s, d, "click"), lambda s, d, r, w: windows.cart_uu_window(r, w), 3600),
    "keyword_window": (_page_stream, lambda s, d, r, w: windows.keyword_window(r, w), 3600),
    "traffic_window": (_page_stream, lambda s, d, r, w: windows.traffic_window(r, w), 3600),
    "home_detail_window": (_page_stream, lambda s, d, r, w: windows.home_detail_window(r, w), 3600),
    "login_window": (lambda s, d: _page_stream(s, d, "login").where("last_page_id = 'login'"), lambda s, d, r, w: windows.login_window(r, w), 86400),
    "payment_window": (lambda s, d: _event_stream(s, d, "purchase"), lambda s, d, r, w: windows.payment_window(r, w), 3600),
    "order_window": (_line_stream, lambda s, d, r, w: windows.order_window(r, w), 86400),
    "refund_window": (lambda s, d: _line_stream(s, d, "seq = 1 and l_returnflag = 'R'"), lambda s, d, r, w: windows.refund_window(r, fx.wide_sku(s, d), w), 86400),
}


def _hourly(name: str, seconds: int) -> str:
    """The SQL of a batch query whose windows are so many seconds wide, for windows of an hour."""
    sql = SQL[name]
    for ts in ("et", "ts", "create_time"):
        sql = sql.replace(win(ts, seconds), win(ts, 3600))
    return sql


for _name, (_rows, _job, _s) in STREAMS.items():
    query(_hourly(_name, _s), f"stream_{_name.replace('_day', '')}")(lambda spark, d, rows=_rows, job=_job: _appended(spark, job(spark, d, rows(spark, d), "1 hour")))


def _lines_in_order(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Versions of order lines as a stream of batches in order of time, and a row after all others."""
    path = shared_path(spark, "stream")
    rows = fx.detail_versions(spark, d).withColumn("create_time", F.col("create_time").cast("timestamp")).select(*columns)
    write = lambda df: df.write.mode("append").parquet(path)
    fx.in_order(spark, d, rows, F.unix_seconds("create_time"), write, path)
    write(_end(spark, rows))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", fx.BATCH_FILES).parquet(path)


def _windows_of(spark: SparkSession, lines: DataFrame, job: Callable[[DataFrame, ranges.Within, Column], DataFrame], back: str = "0 seconds", delay: str = windows.DELAY) -> DataFrame:
    """The hours of a stream of lines by their `create_time`, by ranges of whole hours: no store keeps state for each line."""
    path, us = shared_path(spark, "hours"), F.unix_micros(F.col("create_time").try_cast("timestamp"))
    run = lambda rows, within: job(rows, within(us))
    ranges.by_range(lines, run, path, shared_path(spark, "hours-checkpoint"), us, [F.lit(True)], back, delay=delay, step="1 hour")
    return ranges.rows(spark, path, run(spark.createDataFrame([], lines.schema), lambda at: F.lit(True)).schema)


@query(_hourly("sku_order_window", 86400))
def stream_sku_order_window(spark, d):
    """A line is remembered for a day."""
    lines = _lines_in_order(spark, d, "id", "seq", "sku_id", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount", "create_time")
    sku = fx.wide_sku(spark, d)
    return _windows_of(spark, lines, lambda rows, only: windows.sku_order_window(rows, sku, "1 hour", only=only), "1 day")


@query(_hourly("province_order_window", 86400))
def stream_province_order_window(spark, d):
    lines = _lines_in_order(spark, d, "id", "province_id", "order_id", "split_total_amount", "create_time")
    province = fx.province(spark, d)
    return _windows_of(spark, lines, lambda rows, only: windows.province_order_window(rows.where(only), province, "1 hour"))


@query(SQL["repair_is_new"])
def stream_repair_is_new(spark, d):
    """The flag repaired on a stream of logs that come in four files, in order of time."""
    path, logs = shared_path(spark, "log-topic"), fx.log_json(spark, d)
    n = logs.agg(F.max("seq")).first()[0] + 1
    for k in range(4):
        logs.where((F.col("seq") >= k * n // 4) & (F.col("seq") < (k + 1) * n // 4)).coalesce(1).write.mode("append").parquet(path)
    raw = spark.readStream.schema("value string, seq bigint").option("maxFilesPerTrigger", 1).parquet(path)
    out = traffic.repair_is_new(traffic.log_clean(topics.parse_log(raw)), "seq", delay="60 days")
    return _appended(spark, out.select("seq", F.col("common")["mid"].alias("mid"), F.col("common")["is_new"].alias("is_new")))


# --- facts on streams: lines and their partners come up to an hour apart, so the bounds of the joins decide


def _change_stream(spark: SparkSession, d: str, *parts: str) -> DataFrame:
    topic = fx.topic_of_files(spark, d, fx.timed_changelog(spark, d, *parts), fx.closing_changes())
    return topics.parse_changelog(topics.read_raw(spark, topic, stream=True, files=fx.BATCH_FILES))


#: What facts need of a changelog around a range of it, before and after: order lines have partners within half an
#: hour, cancels come within 35 minutes of them, payments after lines of half an hour, refunds within 7 days.
AROUND = {"order_detail": ("30 minutes", "30 minutes"), "cancel_detail": ("30 minutes", "35 minutes"), "pay_detail": ("1 hour", "30 minutes"), "refund_pay": ("7 days 10 seconds", "7 days 10 seconds")}


def _facts_of_range(spark: SparkSession, fact: str, log: DataFrame) -> DataFrame:
    dic = fx.dic(spark)
    if fact == "refund_pay":
        return facts.refund_pay(log, facts.order_refund(log, dic, "10 seconds"), dic, "7 days")
    lines = facts.order_detail(log, "30 minutes")
    return {"order_detail": lambda: lines, "cancel_detail": lambda: facts.cancel_detail(log, lines, "35 minutes"), "pay_detail": lambda: facts.pay_detail(log, lines, dic)}[fact]()


def _facts(spark: SparkSession, fact: str, log: DataFrame, more: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None] | None = None) -> tuple[str, StructType]:
    """Facts of a stream of changes, by ranges of their time `ts`: where they lie, and their schema."""
    path, us = shared_path(spark, "facts"), F.col("ts") * 1_000_000
    job = lambda rows, within: more(_facts_of_range(spark, fact, rows)).where(within(us))
    back, ahead = AROUND[fact]
    ranges.by_range(log, job, path, shared_path(spark, "facts-checkpoint"), us, facts.reads(fact), back, ahead, deal="table", write=write)
    return path, job(spark.createDataFrame([], log.schema), lambda at: F.lit(True)).schema


def _stream_of_facts(spark: SparkSession, d: str, fact: str, *parts: str) -> DataFrame:
    """The closing fact is left out at the end: left out on the stream it would close nothing."""
    found = ranges.rows(spark, *_facts(spark, fact, _change_stream(spark, d, *parts), lambda df: df.drop("et")))
    return found.where("id <> 'end'")


def _through_topic(spark: SparkSession, fact: str, log: DataFrame, more: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts of a stream put into a topic of JSON, and that topic as a stream."""
    topic = shared_path(spark, "facts-topic")
    write = lambda df, n: topics.as_json(df).write.mode("overwrite").option("compression", "gzip").text(f"{topic}/batch-{n}")
    _, schema = _facts(spark, fact, log, more, write)
    return topics.parse_topic(topics.read_raw(spark, f"{topic}/batch-*", stream=True), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


#: Order lines whose order, coupon and activity come within half an hour of them; else these are null.
NEAR = """near AS (
  SELECT id, order_id, sku_id, sku_num, split_total_amount, split_activity_amount, split_coupon_amount, create_time, ts, sec, o_orderstatus, l_orderkey, o_total, n AS user_known,
    CASE WHEN n THEN user_id END AS user_id, CASE WHEN n THEN province_id END AS province_id, CASE WHEN n THEN coupon_id END AS coupon_id, CASE WHEN n THEN coupon_use_id END AS coupon_use_id,
    CASE WHEN n THEN activity_id END AS activity_id, CASE WHEN n THEN activity_rule_id END AS activity_rule_id
  FROM (SELECT *, sec - ts <= 1800 AS n FROM detail))"""
ORDER_PARTS = ("order", "detail", "coupon", "activity")


@query(f"WITH {OD}, {LINE}, {DETAIL}, {NEAR} SELECT {DETAIL_COLUMNS} FROM near")
def stream_order_detail(spark, d):
    """Three outer joins on a stream, what they hold bounded by half an hour of event time."""
    return _stream_of_facts(spark, d, "order_detail", *ORDER_PARTS)


@query(f"WITH {OD}, {LINE}, {DETAIL}, {NEAR} SELECT {DETAIL_COLUMNS}, create_time AS cancel_time FROM near WHERE o_orderstatus = 'P' AND sec - ts <= 2100")
def stream_cancel_detail(spark, d):
    """Cancels within 35 minutes of their lines."""
    return _stream_of_facts(spark, d, "cancel_detail", *ORDER_PARTS, "cancel")


_PAY_SQL = SQL["pay_detail"].replace("FROM detail LEFT", "FROM near LEFT").replace("detail.id", "near.id").replace(f"{DETAIL}, {DIC}", f"{DETAIL}, {NEAR}, {DIC}").replace("SELECT 'p' || l_orderkey AS id, user_id", "SELECT 'p' || l_orderkey AS id, (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey = l_orderkey) AS user_id")


@query(_PAY_SQL)
def stream_pay_detail(spark, d):
    """The interval join on streams."""
    return _stream_of_facts(spark, d, "pay_detail", *ORDER_PARTS, "pay")


@query(SQL["refund_pay"])
def stream_refund_pay(spark, d):
    """Refunds wait up to seven days for their payments."""
    return _stream_of_facts(spark, d, "refund_pay", "refund", "refund_order", "refund_pay")


# --- from raw changes to windows


def _dirty(raw: DataFrame) -> DataFrame:
    """Raw changes, the amounts of every third line of an order unreadable."""
    third = (F.get_json_object("value", "$.table") == "order_detail") & F.get_json_object("value", "$.data.id").endswith("-3")
    return raw.withColumn("value", F.when(third, F.replace("value", F.lit('"split_total_amount":"'), F.lit('"split_total_amount":"x'))).otherwise(F.col("value")))


_ODS_SQL = SQL["stream_sku_order_window"].replace("sum(total) AS t", "sum(CASE WHEN l_linenumber <> 3 THEN total END) AS t")


@query(_ODS_SQL)
def ods_sku_order_window(spark, d):
    """Raw JSON to order lines to sku windows; amounts that can't be read are left out of sums."""
    stored_ = shared_path(spark, "dirty-changelog")
    topics.store_changelog(_dirty(fx.changelog(spark, d, *ORDER_PARTS)), stored_)  # parsed once, not for each of the four tables
    log = spark.read.schema(topics.CHANGELOG).parquet(stored_)
    return windows.sku_order_window(facts.order_detail(log).withColumn("seq", F.col("ts")), fx.wide_sku(spark, d), "1 hour")


@query(_ODS_SQL)
def stream_ods_to_dws(spark, d):
    """The same on streams: raw topic, joins, a topic of facts as JSON, and its windows."""
    raw = fx.topic_of_files(spark, d, _dirty(fx.timed_changelog(spark, d, *ORDER_PARTS)), fx.closing_changes())
    log = topics.parse_changelog(topics.read_raw(spark, raw, stream=True, files=fx.BATCH_FILES))
    lines = _through_topic(spark, "order_detail", log, lambda df: df.drop("et")).withColumn("seq", F.col("ts"))
    sku = fx.wide_sku(spark, d)
    # lines come in order of `ts`, which is up to an hour before their order was made
    return _windows_of(spark, lines, lambda rows, only: windows.sku_order_window(rows, sku, "1 hour", only=only), "1 day", "1 hour")


@query(f"""WITH {OD}, {LINE}, {DETAIL}, p AS (SELECT DISTINCT user_id, make_timestamp(sec * 1000000) AS et FROM detail WHERE o_orderstatus = 'F' AND ts BETWEEN sec - 1800 AND sec),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(et AS DATE) ORDER BY et) AS n, row_number() OVER (PARTITION BY user_id ORDER BY et) AS k FROM p)
SELECT {win('et', 3600)}, count(*) AS payment_suc_unique_user_count, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS payment_suc_new_user_count FROM m WHERE n = 1 GROUP BY ALL""")
def stream_ods_payment_window(spark, d):
    """Raw changes to payments (outer joins and the interval join) to a topic of facts, and its windows."""
    log = _change_stream(spark, d, *ORDER_PARTS, "pay")
    typed = _through_topic(spark, "pay_detail", log, lambda df: df.withColumn("seq", F.xxhash64("id", "order_detail_id")))
    return _appended(spark, windows.payment_window(typed, "1 hour", "10 seconds"))


@query(SQL["comment_detail"])
def stream_append(spark, d):
    """Comments as JSON in a topic of files, each once, and read back."""
    out = facts.comment_detail(_change_stream(spark, d, "comment"), fx.dic(spark))
    topic = shared_path(spark, "comments")
    runners.append_topic(out, topic, shared_path(spark, "comments-checkpoint"))
    return topics.parse_topic(topics.read_raw(spark, topic), ", ".join(f"{c} {t}" for c, t in out.dtypes))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS p, CAST(o_custkey AS VARCHAR) AS u, o_orderstatus AS s, o_orderpriority AS c FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT 'before' AS stage, 'dim_order' AS sink_table, id AS row_key, p AS value FROM o WHERE k % 14 <> 0
UNION ALL SELECT 'before', 'dim_comment', id, c FROM o WHERE k % 5 = 0
UNION ALL SELECT 'after', 'dim_order', id, u FROM o WHERE s = 'P'
UNION ALL SELECT 'after', 'dim_comment', id, c FROM o WHERE k % 5 = 0
UNION ALL SELECT 'after', 'dim_pay', 'p' || id, id FROM o WHERE s = 'F'""")
def stream_dim_tables(spark, d):
    """Dimension tables of a stream of three batches: puts and deletes, then a config in which one table
    has other columns (and is begun anew), one is gone and one is new."""
    topic, path, checkpoint, config = (shared_path(spark, n) for n in ("dim-topic", "dims", "dims-checkpoint", "dim-config"))
    id_ = F.get_json_object("value", "$.data.id").cast("long")
    orders = fx.changelog(spark, d, "order")
    gone = orders.where(id_ % 14 == 0).select(F.replace("value", F.lit('"type":"insert"'), F.lit('"type":"delete"')).alias("value"))
    first, last = [orders.where(id_ % 2 == 0).unionByName(fx.changelog(spark, d, "comment")), orders.where(id_ % 2 == 1).unionByName(gone)], fx.changelog(spark, d, "cancel", "pay")
    log = topics.parse_changelog(spark.readStream.schema("value string, seq int").parquet(topic + "*"))

    def run(batches: list[DataFrame], begun: int, rows: list[tuple]) -> None:
        spark.createDataFrame(rows, ROUTES).write.mode("overwrite").parquet(config)
        for n, batch in enumerate(batches):
            # all files that are new are a batch: they are written by all tasks, not by one
            batch.withColumn("seq", F.lit(begun + n)).write.mode("append").parquet(topic)
            dims.keep(log, lambda: topics.load_config(spark, config, "DIM"), fx.DATABASE, path, checkpoint, "seq")

    def seen(stage: str, value: dict[str, str]) -> DataFrame:
        tables = dims.read(spark, path)
        parts = [t.select(F.lit(stage).alias("stage"), F.lit(n).alias("sink_table"), "row_key", F.col(value[n]).alias("value")) for n, t in tables.items()]
        held = shared_path(spark, "dims-seen")
        reduce(DataFrame.unionByName, parts).write.parquet(held)
        return spark.read.parquet(held)

    comment, fact = ("comment_info", "ALL", "dim_comment", "DIM", "id, comment_txt", "id"), ("order_info", "ALL", "fact", "DWD", "id", "id")
    old = ("refund_payment", "ALL", "dim_refund", "DIM", "id, order_id", "id")
    run(first, 0, [("order_info", "ALL", "dim_order", "DIM", "id, province_id", "id"), comment, fact, old])
    before = seen("before", {"dim_order": "province_id", "dim_comment": "comment_txt", "dim_refund": "order_id"})
    run([last], 2, [("order_info", "ALL", "dim_order", "DIM", "id, user_id", "id"), comment, fact, ("payment_info", "ALL", "dim_pay", "DIM", "id, order_id", "id")])
    return before.unionByName(seen("after", {"dim_order": "user_id", "dim_comment": "comment_txt", "dim_pay": "order_id"}))
