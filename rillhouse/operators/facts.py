"""Trade and comment facts from the changelog. Streams bound each join by event time `et`; batches do where a
bound is given, as the ranges of time of `streaming.ranges` do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillhouse.functions.changelog import cart_delta, pick, take, taken, transition, went
from rillhouse.functions.times import width_ms

from .lookup import lookup_join

DETAIL = ("id", "order_id", "sku_id", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount", "create_time")


def _timed(df: DataFrame, name: str = "et", delay: str = "10 seconds") -> DataFrame:
    """Event time of a changelog row; streams get a watermark."""
    out = df.withColumn(name, F.timestamp_seconds("ts"))
    return out.withWatermark(name, delay) if df.isStreaming else out


def reads(fact: str) -> list[Column]:
    """The changes that a fact reads, by kind: a stream's watermark is the least of theirs."""
    if fact == "refund_pay":
        return [went("order_refund_info", "refund_status", "0701", "0702"), went("order_info", "order_status", None, "1005"), went("refund_payment", "refund_status", None, "1602")]
    more = {"order_detail": [], "cancel_detail": [("order_info", "order_status", "1001", "1003")], "pay_detail": [("payment_info", "payment_status", "1601", "1602")]}[fact]
    return [taken(t, "insert") for t in ("order_detail", "order_info", "order_detail_coupon", "order_detail_activity")] + [went(*w) for w in more]


def _near(left: DataFrame, right: DataFrame, on, how: str, bound: str | None) -> DataFrame:
    """Equi-join, within `bound` of event time where that is given; streams take 10 seconds if not, so that
    state can end. The right side's time goes."""
    bound = bound or ("10 seconds" if left.isStreaming else None)
    if bound:
        r = F.expr(f"ret between et - interval {bound} and et + interval {bound}")
        return left.join(_timed(right, "ret").drop("ts"), on & r, how).drop("ret")
    return left.join(right.drop("ts"), on, how)


def order_detail(changelog: DataFrame, bound: str | None = None) -> DataFrame:
    """Inserted order lines, widened by their order, coupon and activity."""
    od = _timed(take(changelog, "order_detail", "insert", *DETAIL))
    oi = take(changelog, "order_info", "insert", "id", "user_id", "province_id").withColumnRenamed("id", "oi_id")
    cd = take(changelog, "order_detail_coupon", "insert", "order_detail_id", "coupon_id", "coupon_use_id").withColumnRenamed("order_detail_id", "cd_id")
    ad = take(changelog, "order_detail_activity", "insert", "order_detail_id", "activity_id", "activity_rule_id").withColumnRenamed("order_detail_id", "ad_id")
    out = _near(od, oi, F.col("order_id") == F.col("oi_id"), "left", bound).drop("oi_id")
    out = _near(out, cd, F.col("id") == F.col("cd_id"), "left", bound).drop("cd_id")
    return _near(out, ad, F.col("id") == F.col("ad_id"), "left", bound).drop("ad_id")


def cancel_detail(changelog: DataFrame, details: DataFrame, within: str | None = None) -> DataFrame:
    """Order lines of orders that went from placed to cancelled, `within` so long of them where that is given;
    streams take 35 minutes if not."""
    cancels = pick(transition(changelog, "order_info", "order_status", "1001", "1003"), "id", "operate_time")
    cancels = cancels.select(F.col("id").alias("c_id"), F.col("operate_time").alias("cancel_time"), F.timestamp_seconds("ts").alias("cet"))
    on = F.col("order_id") == F.col("c_id")
    if changelog.isStreaming:
        cancels = cancels.withWatermark("cet", "10 seconds")
        within = within or "35 minutes"
    if within:
        on = on & F.expr(f"cet between et and et + interval {within}")
    return details.join(cancels, on).drop("c_id", "cet")


def interval_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, back: str) -> DataFrame:
    """Pairs with equal `on` and the right time within `back` before the left one, ends included. Rows
    meet by `on` and by stretches of time as long as `back`, the left ones in their own stretch and the
    one before, so that a key with very many rows is spread over tasks. On streams both times carry
    watermarks, so that the state of either side ends."""
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width_ms(back) * 1000))
    r = right.withColumnRenamed(on, "__on").withColumn("__stretch", stretch(right_time))
    near = left.withColumn("__near", F.explode(F.array(stretch(left_time), stretch(left_time) - 1)))
    met = (near[on] == F.col("__on")) & (F.col("__near") == F.col("__stretch"))
    return near.join(r, met & F.expr(f"{right_time} between {left_time} - interval {back} and {left_time}")).drop("__on", "__stretch", "__near")


def pay_detail(changelog: DataFrame, details: DataFrame, dic: DataFrame) -> DataFrame:
    """Successful payments with the order lines of the half hour before, and code names; `et` is the
    payment's time."""
    keys = ("id", "user_id", "order_id", "trade_no", "total_amount", "payment_status", "payment_type", "callback_time")
    pays = _timed(pick(transition(changelog, "payment_info", "payment_status", "1601", "1602"), *keys), "pet")
    lines = details.select(F.col("id").alias("order_detail_id"), "order_id", *DETAIL[2:], "province_id", "coupon_id", "coupon_use_id", "activity_id", "activity_rule_id", "et")
    out = interval_join(pays, lines, "order_id", "pet", "et", "30 minutes").drop("et").withColumnRenamed("pet", "et")
    out = lookup_join(out, dic, "payment_status", {"dic_name": "payment_status_name"})
    return lookup_join(out, dic, "payment_type", {"dic_name": "payment_type_name"})


def order_refund(changelog: DataFrame, dic: DataFrame, bound: str | None = None) -> DataFrame:
    """Approved refunds of order lines, with the order's province and code names; `et` is kept, so
    that the payment join can bound its state by it."""
    keys = ("id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount", "refund_reason_type", "refund_reason_txt", "operate_time")
    refunds = _timed(pick(transition(changelog, "order_refund_info", "refund_status", "0701", "0702"), *keys))
    orders = pick(transition(changelog, "order_info", "order_status", None, "1005"), "id", "province_id").withColumnRenamed("id", "oi_id")
    out = _near(refunds, orders, F.col("order_id") == F.col("oi_id"), "inner", bound).drop("oi_id")
    out = lookup_join(out, dic, "refund_type", {"dic_name": "refund_type_name"})
    return lookup_join(out, dic, "refund_reason_type", {"dic_name": "refund_reason_type_name"})


def refund_pay(changelog: DataFrame, refunds: DataFrame, dic: DataFrame, bound: str | None = None) -> DataFrame:
    """Paid refunds: each payment with every refunded sku of its order, and code names; within `bound` of
    its refund where that is given. Streams take seven days if not."""
    keys = ("id", "order_id", "out_trade_no", "refund_status", "payment_type", "trade_no", "callback_time")
    pays = pick(transition(changelog, "refund_payment", "refund_status", None, "1602"), *keys)
    lines = refunds.drop("id", "ts").withColumnRenamed("order_id", "r_order_id")
    on = F.col("order_id") == F.col("r_order_id")
    bound = bound or ("7 days" if pays.isStreaming else None)
    if bound:
        pays = _timed(pays, "pet")
        on = on & F.expr(f"pet between et - interval {bound} and et + interval {bound}")
    out = pays.join(lines, on).drop("r_order_id", "et", "pet")
    out = lookup_join(out, dic, "refund_status", {"dic_name": "refund_status_name"})
    return lookup_join(out, dic, "payment_type", {"dic_name": "payment_type_name"})


def cart_add_detail(changelog: DataFrame) -> DataFrame:
    """Additions to carts."""
    rows = changelog.where(F.col("table") == "cart_info").withColumn("__n", cart_delta()).where("__n is not null")
    return rows.select(*[F.col("data")[k].alias(k) for k in ("id", "user_id", "sku_id", "cart_price", "sku_name")], F.col("__n").alias("sku_num"), "ts")


def comment_detail(changelog: DataFrame, dic: DataFrame) -> DataFrame:
    """New comments with the name of their appraisal."""
    keys = ("id", "user_id", "sku_id", "spu_id", "order_id", "appraise", "comment_txt", "create_time")
    return lookup_join(take(changelog, "comment_info", "insert", *keys), dic, "appraise", {"dic_name": "appraise_name"})
