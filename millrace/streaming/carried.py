"""Windows and interval joins of a stream as micro-batch work: a batch is computed whole by the batch
operators, and only rows that are still open go on to the next batch, as a stored table.

A state store reads and writes every row one by one, although most windows begin and end within the same
micro-batch. Here a row is stored only while later rows can still join its window or meet it. What a batch
leaves lies below `path` under the batch's number, so a repeated batch reads the same and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Work = Callable[[DataFrame], DataFrame]
Write = Callable[[DataFrame, int], None]
MICROS = 1_000_000


def _session(df: DataFrame) -> SparkSession:
    """A micro-batch's own session; its batch work may use adaptive plans."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return df.sparkSession


def _left(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before left below `path`; the first batch has none before it."""
    return spark.read.parquet(f"{path}/batch={batch_id - 1}") if batch_id else None


def _keep(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _with_left(rows: DataFrame, left: DataFrame | None) -> DataFrame:
    return rows if left is None else rows.unionByName(left)


def _latest(known: Iterable[int | None]) -> int | None:
    return max((k for k in known if k is not None), default=None)


def windows_sink(path: str, time: str, work: Work, write: Write, *, size: float = 10, delay: float = 3
                 ) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of tumbling windows of `size` seconds: `work` turns rows of whole windows into
    their results, and each window is written once.

    A window is over when the latest time seen, less `delay` seconds, has passed its end. Rows of a window
    that an earlier batch has closed are dropped, as a stream's aggregation does.
    """
    return closed_sink(path, time, lambda rows, _, n: write(work(rows), n), size=size, delay=delay)


def closed_sink(path: str, time: str, done: Callable[[DataFrame, DataFrame, int], None], *, size: float = 10,
                delay: float = 3, ahead: float = 0) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer that gives `done` the rows of windows that are over, the rows of windows that are
    not, and the batch's number. A window waits for `ahead` seconds more, so that the open rows hold all
    that follows its rows within that time. See `windows_sink`.
    """
    at = F.unix_micros(time)
    end = at - F.pmod(at, F.lit(int(size * MICROS))) + int((size + ahead) * MICROS)

    def each(df: DataFrame, batch_id: int) -> None:
        spark = _session(df)
        old = _left(spark, f"{path}/mark", batch_id)
        before = old.first()["mark"] if old is not None else None
        latest = df.agg(F.max(at)).first()[0]
        mark = _latest((before, latest - int(delay * MICROS) if latest is not None else None))
        new = df.filter(F.col(time).isNotNull())
        rows = _with_left(new if before is None else new.filter(end > before), _left(spark, f"{path}/open", batch_id))
        over = F.lit(False) if mark is None else end <= mark
        done(rows.filter(over), rows.filter(~over), batch_id)
        _keep(rows.filter(~over), f"{path}/open", batch_id)
        _keep(spark.range(1).select(F.lit(mark).cast("bigint").alias("mark")), f"{path}/mark", batch_id)

    return each


def paired(one: DataFrame, many: DataFrame) -> DataFrame:
    """The rows of two streams as one, each in its own column, so that one query reads both."""
    def side(df: DataFrame, own: str, other: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(own), F.lit(None).cast(other.select(
            F.struct(*other.columns).alias(name)).schema[name].dataType).alias(name))

    return side(one, "one", many, "many").unionByName(side(many, "many", one, "one"))


def joined_sink(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], times: tuple[str, str], lower: float,
                upper: float, write: Write, *, delay: float = 0) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of an inner join of `paired` rows with ``one + lower ≤ many ≤ one + upper`` (seconds).

    `merge` joins two frames; every two rows meet in the batch of the later one to come. A side's row is
    kept until the times seen on both sides, less `delay` seconds, leave no room for a partner, so rows
    may come that late on either side. A hot key is left to the adaptive skew split, as in batch work.
    """
    def kept(time: str, mark: int | None, reach: float) -> Column:
        at = F.unix_micros(time)
        return at.isNotNull() if mark is None else at >= mark + int(reach * MICROS)

    def each(df: DataFrame, batch_id: int) -> None:
        spark = _session(df)
        one, many = (df.filter(F.col(s).isNotNull()).select(f"{s}.*") for s in ("one", "many"))
        old = _left(spark, f"{path}/mark", batch_id)
        before = old.first() if old is not None else (None, None)
        seen = df.agg(F.max(F.unix_micros(f"one.{times[0]}")), F.max(F.unix_micros(f"many.{times[1]}"))).first()
        latest = [_latest(pair) for pair in zip(before, seen)]
        mark = None if None in latest else min(latest) - int(delay * MICROS)
        left_one, left_many = _left(spark, f"{path}/one", batch_id), _left(spark, f"{path}/many", batch_id)
        out = merge(one, _with_left(many, left_many))
        write(out if left_one is None else out.unionByName(merge(left_one, many)), batch_id)
        _keep(_with_left(one, left_one).filter(kept(times[0], mark, -upper)), f"{path}/one", batch_id)
        _keep(_with_left(many, left_many).filter(kept(times[1], mark, lower)), f"{path}/many", batch_id)
        _keep(spark.range(1).select(*(F.lit(v).cast("bigint").alias(n) for n, v in zip(("one", "many"), latest))),
              f"{path}/mark", batch_id)

    return each
