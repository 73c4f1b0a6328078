"""Time helpers. Logs carry milliseconds, the changelog carries seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd HH:mm:ss"
DAY_MS = 86_400_000


def to_seconds(c: str) -> Column:
    """Seconds since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', {c})")


def stamp(c: str | Column) -> Column:
    return F.date_format(c, STAMP)


def tumble(ts: str, width: str) -> Column:
    """Epoch-aligned tumbling window [start, end)."""
    return F.window(ts, width).alias("w")


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    """Replace a window column `w` by stt, edt and cur_date, the date of the window's start."""
    return df.select(stamp("w.start").alias("stt"), stamp("w.end").alias("edt"), F.to_date("w.start").alias("cur_date"), *columns)


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Streams get a watermark, unless `ts` has one from an operator before; batches don't need one."""
    if not df.isStreaming or "spark.watermarkDelayMs" in df.schema[ts].metadata:
        return df
    return df.withWatermark(ts, delay)


_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS, "week": 7 * DAY_MS}


def width_ms(width: str) -> int:
    """Milliseconds of a window's width such as `5 seconds` or `1 hour 30 minutes`."""
    words = width.split()
    return sum(int(n) * _UNITS[unit.lower().rstrip("s")] for n, unit in zip(words[::2], words[1::2], strict=True))
