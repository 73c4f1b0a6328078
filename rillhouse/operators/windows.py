"""Tumbling-window jobs, the same function for batches and streams. All take a window width, and those
on streams a watermark delay; streams give each window once, when the watermark has closed it.

What depends on a key's history (first of a day, of a session, ever) is found apart from the rows that are
counted: first rows are an aggregate with partial sums in batch, so that no task holds all rows of a key, and
keyed state on streams (see `streaming.state`); both are then put together and summed by window. Records
carry an event time `et` and a unique `seq` after equal times."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillhouse.functions.changelog import first_per_key
from rillhouse.functions.times import stamped, tumble, watermarked
from rillhouse.functions.words import words
from rillhouse.streaming import state

from .lookup import lookup_join

WIDTH, DELAY = "5 seconds", "1 millisecond"
MONEY = "decimal(16,2)"
#: What makes a page view a login.
LOGIN = "trim(uid) <> '' AND (last_page_id = 'login' OR last_page_id IS NULL)"


def day_of(c: str = "et") -> Column:
    return F.to_date(c)


def day_end(c: str = "et") -> Column:
    return F.date_add(F.to_date(c), 1).cast("timestamp")


def first_rows(df: DataFrame, keys: list[Column], columns: list[str], order: tuple[str, ...] = ("et", "seq"), time: str = "et", until: Column | None = None) -> DataFrame:
    """(columns) of each key's first row by `order`; a null is a key. On streams order holds within a
    batch, and arrival between them; `until` says when no row of the key can come any more."""
    if df.isStreaming:
        return state.first_rows(df, keys, columns, order, time, until)
    first = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("v"))
    return first.select(*[F.col(f"v.{c}").alias(c) for c in columns])


def marked_first_of_day(df: DataFrame, user: str, delay: str = DELAY) -> DataFrame:
    """All rows with `is_first`: whether one is its user's first of the day, by (et, seq); a null is a user.
    On streams a day's rows come out once the watermark has closed the day."""
    # the window must be the only event time of either side of the join: `et` is carried as a number
    rows = watermarked(df, "et", delay).where("et IS NOT NULL")
    rows = rows.select(F.window("et", "1 day").alias("w"), F.unix_micros(F.col("et").cast("timestamp")).alias("us"), *[c for c in df.columns if c != "et"])
    first = rows.groupBy(F.col("w").alias("first_w"), F.col(user).alias("first_user")).agg(F.min(F.struct("us", "seq")).alias("first"))
    met = rows.join(first, (F.col("w") == F.col("first_w")) & F.col(user).eqNullSafe(F.col("first_user")))
    is_first = (F.col("us") == F.col("first.us")) & F.col("seq").eqNullSafe(F.col("first.seq"))
    return met.withColumn("et", F.timestamp_micros("us").cast(df.schema["et"].dataType)).select(*df.columns, is_first.alias("is_first"))


def stacked(parts: list[tuple[DataFrame, dict[str, Column]]], columns: list[str], measures: list[str]) -> DataFrame:
    """Rows of all parts: their `columns`, and each measure as the part says, else null."""
    rows = [df.select(*columns, *[given.get(m, F.lit(None)).cast("long").alias(m) for m in measures]) for df, given in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def register_window(users: DataFrame, ts: str = "create_time", width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    out = watermarked(users, ts, delay).groupBy(tumble(ts, width)).agg(F.count("*").alias("register_ct"))
    return stamped(out, "register_ct")


def keyword_window(page: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    hits = watermarked(page, "et", delay).where(F.col("last_page_id").isin("home", "search") & (F.col("item_type") == "keyword") & F.col("item").isNotNull())
    out = hits.select("et", F.explode(words("item")).alias("keyword")).groupBy(tumble("et", width), "keyword").agg(F.count("*").alias("keyword_count"))
    return stamped(out, "keyword", "keyword_count")


def cart_uu_window(cart: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    """Distinct users with additions to their cart. On streams a user's first row of a window counts."""
    rows = watermarked(cart, "et", delay)
    if not cart.isStreaming:
        return stamped(rows.groupBy(tumble("et", width)).agg(F.countDistinct("user_id").alias("cart_add_uu_ct")), "cart_add_uu_ct")
    w = F.window("et", width)
    users = first_rows(rows.where("et IS NOT NULL AND user_id IS NOT NULL"), [w["start"], F.col("user_id")], ["et"], until=w["end"])
    both = stacked([(rows, {}), (users, {"cart_add_uu_ct": F.lit(1)})], ["et"], ["cart_add_uu_ct"])
    return stamped(both.groupBy(tumble("et", width)).agg(total("cart_add_uu_ct")), "cart_add_uu_ct")


def traffic_window(page: DataFrame, width: str = WIDTH, delay: str = DELAY, keep: str | None = None) -> DataFrame:
    """Visitors (first view of a device's day), sessions (first view of a session), views, time. On streams
    a session is remembered for `keep` (for good if not given)."""
    dims, measures = ["vc", "ch", "ar", "is_new"], ["uv_ct", "sv_ct", "pv_ct", "dur_sum"]
    rows = watermarked(page, "et", delay).where("et IS NOT NULL")
    one = F.lit(1)
    visitors = first_rows(rows.where("mid IS NOT NULL"), [F.col("mid"), day_of()], ["et", *dims], until=day_end())
    sessions = first_rows(rows.where("sid IS NOT NULL"), [F.col("sid")], ["et", *dims], until=_later("et", keep))
    both = stacked([(rows, {"pv_ct": one, "dur_sum": F.col("during_time")}), (visitors, {"uv_ct": one}), (sessions, {"sv_ct": one})], ["et", *dims], measures)
    out = both.groupBy(tumble("et", width), *dims).agg(*[total(m) for m in measures[:3]], F.sum("dur_sum").alias("dur_sum"))
    return stamped(out, *dims, *measures)


def _later(time: str, keep: str | None) -> Column | None:
    return F.col(time) + F.expr(f"INTERVAL {keep}") if keep else None


def home_detail_window(page: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    """Devices that saw the home page and an item page for the first time of the day."""
    seen = watermarked(page, "et", delay).where("et IS NOT NULL AND mid IS NOT NULL AND page_id IN ('home', 'good_detail')")
    first = first_rows(seen, [F.col("mid"), F.col("page_id"), day_of()], ["et", "page_id"], until=day_end())
    sums = [F.count_if(F.col("page_id") == p).alias(f"{p}_uv_ct") for p in ("home", "good_detail")]
    return stamped(first.groupBy(tumble("et", width)).agg(*sums), "home_uv_ct", "good_detail_uv_ct")


def login_window(page: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    """Users by their first login of the day, and those back after more than a week."""
    rows = watermarked(page, "et", delay).where("et IS NOT NULL").where(LOGIN)
    if page.isStreaming:
        first = state.logins(rows)
    else:
        first = first_rows(rows.withColumn("day", day_of()), [F.col("uid"), F.col("day")], ["uid", "et", "day"])
        first = first.withColumn("before", F.lag("day").over(Window.partitionBy("uid").orderBy("day")))
    back = F.count_if(F.datediff("day", "before") > 7).alias("back_ct")
    return stamped(first.groupBy(tumble("et", width)).agg(back, F.count("*").alias("uu_ct")), "back_ct", "uu_ct")


def payment_window(pays: DataFrame, width: str = WIDTH, delay: str = DELAY, keep: str | None = None) -> DataFrame:
    """Payers by their first payment of the day, and first payers ever (on streams, in `keep`)."""
    measures = ["payment_suc_unique_user_count", "payment_suc_new_user_count"]
    rows = watermarked(pays, "et", delay).where("et IS NOT NULL AND user_id IS NOT NULL")
    of_day = first_rows(rows, [F.col("user_id"), day_of()], ["et"], until=day_end())
    ever = first_rows(rows, [F.col("user_id")], ["et"], until=_later("et", keep))
    both = stacked([(of_day, {measures[0]: F.lit(1)}), (ever, {measures[1]: F.lit(1)})], ["et"], measures)
    return stamped(both.groupBy(tumble("et", width)).agg(*map(total, measures)), *measures)


def order_window(details: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    """Users with an order that is the first of its day so far, and ever. A window without a hit has 0."""
    names = ["order_unique_user_count", "order_new_user_count"]
    rows = watermarked(details, "et", delay).where("user_id IS NOT NULL")
    if details.isStreaming:
        hits = state.least_so_far(rows.where("et IS NOT NULL AND create_time IS NOT NULL"), width)
        both = stacked([(rows, {}), (hits, {names[0]: F.col("u"), names[1]: F.col("n")})], ["et"], names)
        return stamped(both.groupBy(tumble("et", width)).agg(*map(total, names)), *names)
    # least so far by parts: of a user's day of et, and of the days before, so that no task sorts all rows of a user
    day, made, part = F.to_date("create_time").alias("day"), F.min("create_time").alias("made"), F.to_date("et").alias("part")
    least = rows.groupBy("user_id", day, part, "et").agg(made)

    def so_far(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        parts = df.groupBy(*keys, "part").agg(F.min("made").alias("made"))
        before = F.min("made").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in [*keys, "part"]])
        parts = parts.select(*[F.col(k).alias(f"{k}_") for k in [*keys, "part"]], before.alias("before"))
        within = Window.partitionBy(*keys, "part").orderBy("et").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return df.join(parts, same).withColumn(name, F.col("made") == F.least(F.min("made").over(within), "before")).drop(*[f"{k}_" for k in [*keys, "part"]], "before")

    marked = so_far(so_far(least, ["user_id", "day"], "u"), ["user_id"], "n")
    hit = lambda c: F.countDistinct(F.when(F.col(c), F.col("user_id")))
    out = marked.groupBy(tumble("et", width)).agg(hit("u").alias(names[0]), hit("n").alias(names[1]))
    return stamped(out, *names)


def _timed(details: DataFrame) -> DataFrame:
    """Facts carry their times as text; what can't be read is in no window."""
    return details.withColumn("create_time", F.col("create_time").try_cast("timestamp"))


SKU_NAMES = ["sku_name", "spu_id", "spu_name", "trademark_id", "trademark_name", *[f"category{k}_{x}" for k in (1, 2, 3) for x in ("id", "name")]]


def sku_order_window(details: DataFrame, sku_dim: DataFrame, width: str = WIDTH, delay: str = DELAY, keep: str = "1 day", only: Column | None = None) -> DataFrame:
    """Amounts of each sku's first-version order lines, with its chain of dimensions. The sums go
    to the lookup, so that few rows are joined. On streams a line is remembered for `keep`. First versions
    of batches count where `only` says so, if given."""
    columns = ["id", "sku_id", "sku_num", "split_total_amount", "split_activity_amount", "split_coupon_amount", "create_time"]
    rows = watermarked(_timed(details), "create_time", delay)
    if details.isStreaming:
        first = first_rows(rows.where("create_time IS NOT NULL"), [F.col("id")], columns, ("seq",), "create_time", _later("create_time", keep))
    else:
        first = first_per_key(rows.select(*columns, "seq"), ["id"], ["seq"])
        first = first if only is None else first.where(only)
    return with_sku(sku_order_sums(first, width), sku_dim)


def sku_order_sums(first: DataFrame, width: str = WIDTH) -> DataFrame:
    """Sums of what can be read as numbers: facts carry them as text."""
    money = lambda c: F.sum(F.col(c).try_cast(MONEY))
    sums = [F.sum(F.col("sku_num").try_cast("int")).alias("sku_num"), money("split_activity_amount").alias("activity_reduce_amount"), money("split_coupon_amount").alias("coupon_reduce_amount"), money("split_total_amount").alias("order_amount")]
    out = first.groupBy(tumble("create_time", width), "sku_id").agg(*sums)
    return stamped(out, "sku_id", "sku_num", "activity_reduce_amount", "coupon_reduce_amount", "order_amount")


def with_sku(sums: DataFrame, sku_dim: DataFrame) -> DataFrame:
    out = lookup_join(sums, sku_dim, "sku_id", {c: c for c in [*SKU_NAMES, "price"]})
    original = (F.col("sku_num").try_cast("int") * F.col("price").try_cast(MONEY)).cast(MONEY)
    money = [F.col(c).cast(MONEY).alias(c) for c in ("activity_reduce_amount", "coupon_reduce_amount", "order_amount")]
    return out.select("stt", "edt", "cur_date", "sku_id", *SKU_NAMES, original.alias("original_amount"), *money)


def province_order_window(details: DataFrame, province: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    """Orders and amounts of each province; the average over an order line's versions keeps repeated
    versions from counting twice. Streams chain three aggregates of a window: lines, orders, provinces."""
    rows = watermarked(_timed(details), "create_time", delay).where(F.col("province_id").isNotNull())
    line = rows.groupBy(tumble("create_time", width), "id", "province_id", "order_id").agg(F.avg(F.col("split_total_amount").try_cast(MONEY)).alias("amount"))
    again = F.window("w", width).alias("w") if details.isStreaming else F.col("w")
    order = line.groupBy(again, "province_id", "order_id").agg(F.sum("amount").alias("amount"))
    again = F.window("w", width).alias("w") if details.isStreaming else F.col("w")
    out = order.groupBy(again, "province_id").agg(F.count("order_id").alias("order_count"), F.sum("amount").cast(MONEY).alias("order_amount"))
    out = stamped(out, "province_id", "order_count", "order_amount")
    return lookup_join(out, province, "province_id", {"name": "province_name"}).select("stt", "edt", "cur_date", "province_id", "province_name", "order_count", "order_amount")


def refund_window(refunds: DataFrame, sku_dim: DataFrame, width: str = WIDTH, delay: str = DELAY) -> DataFrame:
    """Refunds of each user by trademark and category."""
    names = ["trademark_id", "trademark_name", *[f"category{k}_{x}" for k in (1, 2, 3) for x in ("id", "name")]]
    wide = lookup_join(watermarked(refunds, "et", delay), sku_dim, "sku_id", {c: c for c in names})
    first = [F.first(c).alias(c) for c in names if c not in ("trademark_id", "category3_id")]
    out = wide.groupBy(tumble("et", width), "trademark_id", "category3_id", "user_id").agg(*first, F.count("*").alias("refund_count"))
    return stamped(out, *names, "user_id", "refund_count")
