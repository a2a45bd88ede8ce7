"""Run a stream over stored rows, in time order and with restarts, and return what it wrote."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.session import freed_shuffles, lay_out, scratch_dir, taken_up
from millrace.streaming.runner import finish, start

SLICE = "_slice"


@dataclass
class Feed:
    """Stored rows of one stream. A closing row, far ahead in time, lets the last windows end. What is `then`
    to be done to the rows of a replay in slices is done to one slice at a time, before it is streamed."""
    rows: DataFrame
    time: str
    closing: dict[str, object] | None = field(default=None)
    then: Callable[[DataFrame], DataFrame] | None = field(default=None)


def _closing_row(feed: Feed, latest) -> DataFrame:
    values = {feed.time: F.lit(latest) + F.expr("interval 100 days")}
    values |= {c: F.lit(v) for c, v in feed.closing.items()}
    return feed.rows.sparkSession.range(1).select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in feed.rows.schema.fields])


def replay(spark: SparkSession, label: str, feeds: dict[str, Feed],
           build: Callable[[dict[str, DataFrame]], DataFrame] | None = None, *, rounds: int = 2,
           each: Callable[[DataFrame, int], None] | None = None,
           job: Callable[[dict[str, DataFrame], str], StreamingQuery] | None = None,
           before: Callable[[int], None] | None = None, slices: int = 0) -> str:
    """Feed the rows in `rounds` time steps, stopping and restarting in between.

    Returns the folder of the written result (unless `each` writes elsewhere). Rows are split at
    common times, so no row comes behind the watermark of its own history. With `job` a standing job is
    started on the streams, below the folder that is returned. `before` is called ahead of each step.
    With `slices` a step comes as so many micro-batches, one slice of its time after the other: rows are
    stored once, by slice, and disk holds the shuffles of one slice.
    """
    base = scratch_dir(spark, label)
    if slices:
        return _replay_slices(spark, base, label, feeds, build, rounds, slices, each, job, before)
    for name, feed in feeds.items():
        feed.rows.write.parquet(f"{base}/stored/{name}")
    stored = {n: spark.read.parquet(f"{base}/stored/{n}") for n in feeds}
    cuts, last = _cuts({n: Feed(stored[n], f.time) for n, f in feeds.items()}, rounds)
    for step in range(rounds):
        if before is not None:
            before(step)
        for name, feed in feeds.items():
            rows = stored[name]
            if step:
                rows = rows.filter(F.col(feed.time) >= F.lit(cuts[step - 1]))
            if step < rounds - 1:
                rows = rows.filter((F.col(feed.time) < F.lit(cuts[step])) |
                                   (F.col(feed.time).isNull() if step == 0 else F.lit(False)))
            elif feed.closing is not None:
                rows = rows.unionByName(_closing_row(feed, last))
            rows.write.mode("append").parquet(f"{base}/in/{name}")
        streams = {n: spark.readStream.schema(f.rows.schema).parquet(f"{base}/in/{n}")
                   for n, f in feeds.items()}
        _run(streams, base, label, build, each, job)
    return f"{base}/out"


def _cuts(feeds: dict[str, Feed], steps: int) -> tuple[list, object]:
    """Times that cut the span of all feeds into equal steps, and its end."""
    span = [f.rows.agg(F.min(f.time), F.max(f.time)).first() for f in feeds.values()]
    span = [s for s in span if s[0] is not None]
    first, last = min(s[0] for s in span), max(s[1] for s in span)
    return [first + (last - first) * i / steps for i in range(1, steps)], last


def _run(streams, base: str, label: str, build, each, job) -> None:
    if job is not None:
        finish(job(streams, f"{base}/out"))
        return
    finish(start(build(streams), name=f"{label}_{base[-12:]}", once=True, each=each,
                 path=None if each else f"{base}/out", checkpoint=f"{base}/checkpoint"))


def _replay_slices(spark, base, label, feeds, build, rounds, slices, each, job, before) -> str:
    """A stream reads the folders of the slices up to the one that is its turn."""
    total = rounds * slices
    cuts, last = _cuts(feeds, total)
    raw = {n: f"{base}/{'stored' if f.then else 'in'}/{n}" for n, f in feeds.items()}
    schemas = {n: (f.then(f.rows) if f.then else f.rows).schema for n, f in feeds.items()}
    for name, feed in feeds.items():
        passed = sum((F.when(F.col(feed.time) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
        lay_out(feed.rows.withColumn(SLICE, passed), raw[name], SLICE)
        if feed.closing is not None:
            lay_out(_closing_row(feed, last).withColumn(SLICE, F.lit(total - 1)), raw[name], SLICE)
    for k in range(total):
        if before is not None and k % slices == 0:
            before(k // slices)
        for name, feed in feeds.items():
            if feed.then is not None:
                rows = spark.read.schema(feed.rows.schema).parquet(raw[name]).filter(F.col(SLICE) == k).drop(SLICE)
                with freed_shuffles(spark):
                    feed.then(rows).write.option("compression", "zstd").parquet(f"{base}/in/{name}/{SLICE}={k}")
                taken_up(rows, f"{raw[name]}/{SLICE}={k}")
        come = ",".join(map(str, range(k + 1)))
        _run({n: spark.readStream.schema(schemas[n]).parquet(f"{base}/in/{n}/{SLICE}={{{come}}}") for n in feeds},
             base, label, build, each, job)
    return f"{base}/out"
