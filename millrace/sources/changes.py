"""Captured database changes and the route table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from millrace import schemas
from millrace.sources.topics import CORRUPT, parse_json, read_topic, split_corrupt

# One-letter operation marks of the capture format.
OPERATIONS = {"c": "create", "u": "update", "d": "delete", "r": "read", "t": "truncate"}


def _type(op: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, op), F.lower(op))


def normalize_change(df: DataFrame, *, op_field: str = "type", map_create: bool = True,
                     with_time: bool = False, with_before: bool = False
                     ) -> tuple[DataFrame, DataFrame]:
    """Captured records (JSON text ``value``) → (``database, table, type, data``, quarantine).

    `data` holds the row after the change, every value as text, and is empty for a delete.
    ``op_field="operation", map_create=False`` gives the older shape, which keeps ``create``;
    `with_time` keeps the capture time ``ts_ms``, by which changes of a key can be ordered, and
    `with_before` the row ``before`` the change, which is where a delete has its key. Malformed
    lines are the quarantine.
    """
    rows, bad = split_corrupt(parse_json(df, schemas.CAPTURED_CHANGE))
    kind = _type(F.col("op"))
    if map_create:
        kind = F.when(kind == "create", "insert").otherwise(kind)
    keep = [c for c in df.columns if c != "value"]
    none = F.create_map().cast("map<string,string>")
    before = [F.coalesce("before", none).alias("before")] if with_before else []
    good = rows.select(*keep, F.col("source.db").alias("database"),
                       F.col("source.table").alias("table"),
                       insert_alias(kind).alias(op_field),
                       F.coalesce("after", none).alias("data"), *before,
                       *(["ts_ms"] if with_time else []))
    return good, bad.select(*keep, CORRUPT)


def parse_change(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change envelopes that are already ``{database, table, type, data}`` JSON, and the quarantine."""
    rows, bad = split_corrupt(parse_json(df, schemas.CHANGE))
    return rows.withColumn("type", insert_alias(F.col("type"))), bad.select(
        *(c for c in df.columns if c != "value"), CORRUPT)


def insert_alias(kind: Column) -> Column:
    """History loads mark their rows ``bootstrap-insert``; they are inserts."""
    return F.when(kind == "bootstrap-insert", "insert").otherwise(kind)


def read_changes(spark: SparkSession, name: str, *, databases: list[str] | None = None,
                 tables: list[str] | None = None, schema: str | None = None,
                 captured: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Changes from a topic or from files, narrowed to the listed databases and tables, and the
    quarantine of malformed lines.

    Tables may be given as ``table`` or ``database.table``. With `schema` the data map becomes
    typed columns. A snapshot followed by the log is one batch read plus one stream read.
    """
    lines = read_topic(spark, name, **options)
    df, bad = normalize_change(lines) if captured else parse_change(lines)
    if databases:
        df = df.filter(F.col("database").isin(databases))
    if tables:
        full = F.concat_ws(".", "database", "table")
        df = df.filter(F.col("table").isin(tables) | full.isin(tables))
    return (typed_data(df, schema) if schema else df), bad


def keyed_data(df: DataFrame, *fields: str) -> DataFrame:
    """Listed fields as columns, taken from the row before the change where a delete has no data."""
    row = F.when(F.size("data") > 0, F.col("data")).otherwise(F.col("before"))
    rest = [c for c in df.columns if c not in ("data", "before", *fields)]
    return df.select(*rest, *[F.try_element_at(row, F.lit(f)).alias(f) for f in fields])


def typed_data(df: DataFrame, schema: str, column: str = "data") -> DataFrame:
    """Spread a text map over typed columns; a value that does not fit becomes null."""
    from pyspark.sql.types import StructType
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[
        F.try_element_at(F.col(column), F.lit(f.name)).try_cast(f.dataType).alias(f.name)
        for f in StructType.fromDDL(schema).fields])


def load_routes(changes: DataFrame, seq: str | None = None) -> DataFrame:
    """Current routes from changes of the route table, one per (source_table, operate_type).

    Accepts plain route rows too. With `seq` the latest change of a route wins, and a route
    whose latest change is a delete is gone: a delete without data names its route by the row
    ``before`` it. Captured route columns may be in camel case.
    """
    cols = schemas.ROUTE_COLUMNS
    if "data" in changes.columns:
        camel = {c: c.split("_")[0] + "".join(w.title() for w in c.split("_")[1:]) for c in cols}
        maps = [m for m in ("data", "before") if m in changes.columns]
        get = lambda c: F.coalesce(*[F.try_element_at(m, F.lit(n))
                                     for m in maps for n in (c, camel[c])])
        changes = changes.select(*[get(c).alias(c) for c in cols], "type",
                                 *([seq] if seq else []))
    kind = F.col("type") if "type" in changes.columns else F.lit("insert")
    rows = changes.filter(F.col("source_table").isNotNull() & F.col("operate_type").isNotNull())
    if seq:
        newest = Window.partitionBy("source_table", "operate_type").orderBy(F.desc(seq))
        rows = rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
    return rows.filter(kind != "delete").select(*cols)
