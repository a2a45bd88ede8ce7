"""Event time, day keys, tumbling windows and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_time(text: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text → timestamp in the session zone; null when malformed."""
    return F.try_to_timestamp(text, F.lit(SECOND_FORMAT))


def millis_time(ms: Column | str) -> Column:
    return F.timestamp_millis(ms)


def whole_seconds_time(ms: Column | str) -> Column:
    """Epoch millis → timestamp, dropping the fraction of a second."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_seconds(F.floor(ms / F.lit(1000)))


_READERS = {"text": parse_time, "millis": millis_time, "seconds": whole_seconds_time}


def with_event_time(df: DataFrame, source: str, out: str = "rowtime", kind: str = "text",
                    delay: str | None = None) -> DataFrame:
    """Add timestamp `out` read from `source`; on a stream, also a watermark of `delay`."""
    return watermarked(df.withColumn(out, _READERS[kind](F.col(source))), out, delay)


def watermarked(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    return df.withWatermark(time, delay) if delay is not None and df.isStreaming else df


def day_key(ts: Column | str) -> Column:
    """``yyyyMMdd`` text."""
    return F.date_format(ts, "yyyyMMdd")


def day_number(stt: Column | str) -> Column:
    """``yyyyMMdd`` as an int from a ``yyyy-MM-dd HH:mm:ss`` text or a timestamp."""
    return F.date_format(F.to_timestamp(stt), "yyyyMMdd").cast("int")


def age_years(birthday: Column, asof: Column) -> Column:
    """Whole years between two dates: a birthday counts from its own day on."""
    before = F.date_format(asof, "MMdd") < F.date_format(birthday, "MMdd")
    return F.year(asof) - F.year(birthday) - F.when(before, 1).otherwise(0)


def tumble(time: str, size: str = "10 seconds") -> Column:
    """Epoch-aligned tumbling window, named ``window``."""
    return F.window(time, size).alias("window")


def window_bounds(window: str = "window") -> list[Column]:
    """``stt`` and ``edt`` texts of a window column."""
    return [F.date_format(f"{window}.start", SECOND_FORMAT).alias("stt"),
            F.date_format(f"{window}.end", SECOND_FORMAT).alias("edt")]


def seconds(n: float) -> Column:
    """An interval of `n` seconds."""
    return F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {n!r})")
