"""Keyed state of streams, in the engine's own state store (RocksDB). Every call from Python to the store
costs as much as dozens of rows, so keys are dealt into parts and a part's state is one value, read and
written once a batch; only logins have a small map for each key. State ends by event time: where the
watermark makes a key's further rows late anyway, a timer takes the state away.

Each processor holds little for a key at a time, however many rows a batch has of it (but for a device's
first batch, see `SeenSince`). Rows later than
the watermark are dropped before they get here. Order within a batch is by time, between batches by
arrival."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rillhouse.functions.times import DAY_MS, width_ms
from rillhouse.session import ship


def _keyed(slim: DataFrame, keys: list[str], processor: StatefulProcessor, schema, time: str) -> DataFrame:
    """Rows that `processor` makes of `slim` by key; `time` carries the watermark on."""
    ship(slim.sparkSession)
    return slim.groupBy(*keys).transformWithState(processor, schema, "append", "eventTime", eventTimeColumnName=time)


#: Into how many parts keys are dealt. A part's keys lie in one value: a batch reads and writes it once,
#: whatever the number of its keys, and few timers are needed.
PARTS = 4096


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


class FirstRows(StatefulProcessor):
    """The first row ever of each key of a part, by `order` in a batch. `until` of the row, in milliseconds,
    is when the key can be forgotten; null is never. Held are the keys and one row of each new one."""

    def __init__(self, columns: list[str], order: tuple[str, ...]):
        self.name, self.until, self.order = columns.index("name"), columns.index("until"), [columns.index(c) for c in order]

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "names array<string>, until array<long>")

    def _known(self, now: int) -> dict[str, int | None]:
        """The keys that are not to be forgotten yet."""
        if not self.seen.exists():
            return {}
        names, until = self.seen.get()
        return {k: u for k, u in zip(names, until, strict=True) if u is None or u > now}

    def _keep(self, known: dict[str, int | None]) -> None:
        if known:
            self.seen.update((list(known), list(known.values())))
        else:
            self.seen.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, best = self._known(timerValues.getCurrentWatermarkInMs()), {}
        at, i, until = itemgetter(*self.order), self.name, self.until
        for r in rows:
            name = r[i]
            if name not in known and (name not in best or at(r) < at(best[name])):
                best[name] = r
        if best:
            self._keep(known | {name: r[until] for name, r in best.items()})
            latest = lambda due: max((u for u in due if u is not None), default=0)
            if (new := latest(r[until] for r in best.values())) > latest(known.values()):
                self.handle.registerTimer(new)
        yield from best.values()

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep(self._known(expiredTimerInfo.getExpiryTimeInMs()))
        return iter(())

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, keys: list[Column], columns: list[str], order: tuple[str, ...], time: str, until: Column | None) -> DataFrame:
    """(columns) of the first row of each key. `time` is the column with the watermark; `until` is a
    timestamp after which no row of the key can come, or null."""
    name = F.to_json(F.struct(*[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
    rest = list(dict.fromkeys([time, *order, *columns]))
    forget = F.unix_millis(until) if until is not None else F.lit(None).cast("long")
    slim = stream.select(part_of(name), name.alias("name"), *rest, forget.alias("until"))
    return _keyed(slim, ["part"], FirstRows(slim.columns, order), slim.schema, time).select(*columns)


class Logins(StatefulProcessor):
    """A user's first login of each day, with the day of the login before. Kept are the days that the
    watermark has not closed, and the last of those that it has."""

    def init(self, handle) -> None:
        self.days = handle.getMapState("days", "day int", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first: dict[int, Row] = {}
        for r in rows:
            if r["day"] not in first or (r["et"], r["seq"]) < (first[r["day"]]["et"], first[r["day"]]["seq"]):
                first[r["day"]] = r
        known = {k[0] for k in self.days.keys()}
        for day in sorted(first.keys() - known):
            r = first[day]
            yield Row(uid=r["uid"], et=r["et"], seq=r["seq"], day=day, before=max((d for d in known if d < day), default=None))
            known.add(day)
            self.days.updateValue((day,), (True,))
        closed = sorted(d for d in known if (d + 1) * DAY_MS <= timerValues.getCurrentWatermarkInMs())
        for day in closed[:-1]:
            self.days.removeKey((day,))

    def close(self) -> None:
        pass


def day_number(c: str | Column) -> Column:
    return F.unix_date(F.to_date(c))


def logins(stream: DataFrame) -> DataFrame:
    """(et, day, before) of first logins of a day, from (uid, et, seq) with a watermark on et."""
    slim = stream.select("uid", "et", "seq", day_number("et").alias("day"))
    schema = "uid string, et timestamp, seq long, day int, before int"
    out = _keyed(slim, ["uid"], Logins(), schema, "et")
    return out.select("et", F.date_from_unix_date("day").alias("day"), F.date_from_unix_date("before").alias("before"))


class LeastSoFar(StatefulProcessor):
    """Windows in which a user of a part has a row whose `made` is the least so far, of its day and ever,
    by `et`, rows of one `et` together. Each window is reported once for either kind. Kept are a user's
    least ever, the least of each day, and what was reported of windows that the watermark has not closed."""

    def __init__(self, width_ms: int):
        self.width = width_ms

    def init(self, handle) -> None:
        users, days, told = "users array<string>, least array<long>", "day_of array<int>, day array<int>, made array<long>", "told_of array<int>, start array<long>, kinds array<int>"
        self.kept = handle.getValueState("kept", f"{users}, {days}, {told}")

    def _known(self) -> tuple[dict[str, int], dict[tuple[str, int], int], dict[tuple[str, int], int]]:
        """The least of a user, of a user's day, and the kinds reported of a user's window."""
        if not self.kept.exists():
            return {}, {}, {}
        users, least, day_of, day, made, told_of, start, kinds = self.kept.get()
        days = {(users[i], d): m for i, d, m in zip(day_of, day, made, strict=True)}
        return dict(zip(users, least, strict=True)), days, {(users[i], s): k for i, s, k in zip(told_of, start, kinds, strict=True)}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at: dict[tuple[str, int, int], int] = {}  # by user, et and day: the least
        when: dict[int, Any] = {}
        for _, user, et, us, made, day in rows:
            one = (user, us, day)
            if one not in at or made < at[one]:
                at[one] = made
            when.setdefault(us, et)
        if not at:
            return
        least, days, told = self._known()
        hit = Row("et", "u", "n")
        for (user, us), group in groupby(sorted(at), key=itemgetter(0, 1)):
            start, hits, low = us // 1000 // self.width * self.width, 0, None
            for one in group:
                made, day = at[one], (user, one[2])
                days[day] = min(days.get(day, made), made)
                hits |= made == days[day]
                low = made if low is None else min(low, made)
            least[user] = min(least.get(user, low), low)
            hits |= 2 * (low == least[user])
            new = hits & ~told.get((user, start), 0)
            if new:
                told[(user, start)] = told.get((user, start), 0) | new
                yield hit(when[us], new & 1, new >> 1)
        now = timerValues.getCurrentWatermarkInMs()
        told = {k: v for k, v in told.items() if k[1] + self.width > now}
        place = {user: i for i, user in enumerate(least)}
        of = lambda known: ([place[user] for user, _ in known], [x for _, x in known], list(known.values()))
        self.kept.update((list(least), list(least.values()), *of(days), *of(told)))

    def close(self) -> None:
        pass


def least_so_far(stream: DataFrame, width: str) -> DataFrame:
    """(et, u, n): a row for each user and window with a row that is the least of its day (u) or ever (n)
    so far, from (user_id, et, create_time) with a watermark on et."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    user = F.col("user_id").cast("string")
    slim = stream.select(part_of(user), user.alias("user_id"), "et", micros("et").alias("et_us"), micros("create_time").alias("made"), day_number("create_time").alias("day"))
    kind = stream.schema["et"].dataType.simpleString()
    return _keyed(slim, ["part"], LeastSoFar(width_ms(width)), f"et {kind}, u int, n int", "et")


class SeenSince(StatefulProcessor):
    """Repairs the visitor flag of the records of a part's devices by their first-seen days, see
    `traffic.repaired_flag`. The first batch of a device is held until its first record is known; later
    ones pass through. With `keep_ms`, a device that was not seen for so long is forgotten."""

    def __init__(self, keep_ms: int | None):
        self.keep = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "names array<string>, since array<int>, last array<long>")

    def _known(self) -> dict[str, tuple[int | None, int]]:
        """Each device's first-seen day, and the time of its last record."""
        if not self.seen.exists():
            return {}
        names, since, last = self.seen.get()
        return dict(zip(names, zip(since, last, strict=True), strict=True))

    def _update(self, known: dict[str, tuple[int | None, int]]) -> None:
        self.seen.update((list(known), [s for s, _ in known.values()], [t for _, t in known.values()]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, held, last = self._known(), {}, {}
        begun, out = not known, Row("et", "is_new", "value")

        def repaired(r: Row, since: int | None, first: bool = False) -> Row:
            _, _, et, _, _, day, flag, value = r
            return out(et, flag if first or flag != "1" or since is None or day is None or day == since else "0", value)

        for r in rows:
            name = r[1]
            if self.keep is not None:
                last[name] = max(last.get(name, 0), r[3] or 0)
            if name in known:
                yield repaired(r, known[name][0])
            else:
                held.setdefault(name, []).append(r)
        changed = bool(held) or bool(last)
        for name in list(held):
            own = held.pop(name)
            first = min(own, key=lambda r: (r[3] is not None, r[3] or 0, r[4]))  # nulls first, as in batch
            # a first record without a time has no day that later ones could miss
            _, _, _, _, _, day, flag, _ = first
            known[name] = (None if day is None else day if flag == "1" else day - 1, 0)
            for r in own:
                yield repaired(r, known[name][0], r is first)
        for name, ms in last.items():
            known[name] = (known[name][0], max(known[name][1], ms))
        if changed:
            self._update(known)
            if begun and self.keep is not None:
                self.handle.registerTimer(min(t for _, t in known.values()) + self.keep)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a part that has state has one timer: when the device that was silent for longest is due
        now = expiredTimerInfo.getExpiryTimeInMs()
        known = {name: v for name, v in self._known().items() if v[1] + self.keep > now}
        if known:
            self._update(known)
            self.handle.registerTimer(min(t for _, t in known.values()) + self.keep)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def seen_since(stream: DataFrame, keep: str | None) -> DataFrame:
    """(et, is_new, value) with `is_new` repaired, from (mid, et, ts, seq, is_new, value) with a watermark on et."""
    name = F.to_json(F.struct("mid"))  # a null is a device too
    slim = stream.select(part_of(name), name.alias("name"), "et", "ts", "seq", day_number("et").alias("day"), "is_new", "value")
    return _keyed(slim, ["part"], SeenSince(width_ms(keep) if keep else None), "et timestamp, is_new string, value string", "et")
