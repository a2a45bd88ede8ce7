"""Operators that keep state between micro-batches: bounces and unique visits of a page stream.

Their batch counterparts are in `operators.visits`. Both leave the event-time column usable, so
statistics may follow them in the same query. State lives in the RocksDB store and the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, StructField, StructType

from millrace.functions.times import watermarked
from millrace.operators.logs import blank
from millrace.operators.neighbours import with_slices


def user_jumps_stream(pages: DataFrame, within: float = 10.0, *, key: str = "mid", time: str = "ts",
                      tie: tuple[str, ...] = (), delay: str | None = "0 seconds",
                      slice_seconds: int = 30) -> DataFrame:
    """Bounces of a page stream: opening rows that the device's later rows do not follow in time.

    A left outer join in event time: an opening row that met no later row within `within` seconds
    comes out once the watermark has passed its waiting time, and what follows it in the same query
    waits as long. Rows meet by (device, time slice), and rows near a slice's start are also sent to the
    slice before, so a busy device is spread over its slices and the state of each spans one slice.
    ``delay=None`` takes the watermark that the pages have.
    """
    slice_seconds = max(slice_seconds, int(within) + 1)
    rows = watermarked(pages.filter(F.col(key).isNotNull()), time, delay)
    order = [time, *tie]
    after = with_slices(rows.select(key, *order), time, within, slice_seconds, "next").select(
        F.col(key).alias("_key"), F.col("_slice"), *(F.col(c).alias(f"_{c}") for c in order))
    own = F.expr(f"floor(unix_micros({time}) / {slice_seconds * 1_000_000})")
    openings = rows.filter(blank("last_page_id")).withColumn("_own", own)
    follows = (F.struct(*(f"_{c}" for c in order)) > F.struct(*order)) & (F.col(f"_{time}") >= F.col(time)) & (
        F.col(f"_{time}") < F.col(time) + F.expr(f"interval '{within}' second"))
    met = (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_slice")) & follows
    return openings.join(after, met, "left_outer").filter(F.col("_key").isNull()).select(*pages.columns)


class _FirstOfDay(StatefulProcessor):
    """Lets the earliest row of a (device, day) pass, and no later one."""

    def __init__(self, names: list[str], order: list[str]):
        self.names, self.order = names, order

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", StructType([StructField("seen", BooleanType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: tuple(r[c] for c in self.order), default=None)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            self.handle.registerTimer(first["_until"])
            yield Row(**{n: first[n] for n in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def unique_visits_stream(pages: DataFrame, *, key: str = "mid", time: str = "ts", tie: tuple[str, ...] = (),
                         delay: str | None = "0 seconds", size: str = "10 seconds") -> DataFrame:
    """The first opening row of each device and day, for statistics in the same query.

    Opening rows are first cut to one per device and window, combined before the shuffle, so a busy
    device sends a row per task. Windows come out in the order of the watermark, each with the
    earliest row of its device, so the first to arrive is the first of the day. `time` of the result is
    the last instant of the row's window (of `size`), the time by which it is known. `visited.unique_visits_sink`
    keeps the row's own time and takes rows that come days late; here they are dropped.
    """
    rest = [c for c in pages.columns if c not in (key, time)]
    rows = watermarked(pages.filter(blank("last_page_id") & F.col(key).isNotNull()), time, delay)
    first = rows.groupBy(F.window(time, size).alias("window"), key).agg(
        F.min_by(F.struct(*rest, F.unix_micros(time).alias("_at")), F.struct(time, *tie)).alias("_r"))
    day = F.to_date(F.timestamp_micros("_at"))
    # the timer's margin keeps the mark until every window of the day has come out
    known = first.select(key, F.window_time("window").alias(time), "_r.*").withColumns(
        {"_day": day, "_until": F.unix_millis(F.date_add(day, 1).cast("timestamp")) + 60_000})
    out = StructType([StructField(f.name, f.dataType, True) for f in pages.schema.fields])
    return known.groupBy(key, "_day").transformWithState(
        _FirstOfDay(pages.columns, ["_at", *tie]), out, "append", "eventTime", eventTimeColumnName=time)
