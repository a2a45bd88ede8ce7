"""Change records: filtering, routing and folding into current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from millrace.codes import SINK_DIM, SINK_FACT


def valid_changes(df: DataFrame, deletes: bool = False) -> DataFrame:
    """Changes that name a table and carry data; with `deletes` also those that only name the row
    ``before`` them."""
    carried = F.size("data") > 0
    if deletes:
        carried = carried | ((F.col("type") == "delete") & (F.size("before") > 0))
    return df.filter((F.length("table") > 0) & carried)


MAX_ROUTE_BYTES = 8 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_bytes: int) -> DataFrame:
    """Mark `df` for broadcast when its rows, measured as text, take at most `max_bytes`."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


def _keyed(routes: DataFrame) -> DataFrame:
    """Routes under join names. Changes have few (table, type) pairs, so shuffling them by those
    would pile them up; routes are measured and sent to every task when they are small."""
    rest = [c for c in routes.columns if c not in ("source_table", "operate_type")]
    return broadcast_if_small(routes, MAX_ROUTE_BYTES).select(
        F.col("source_table").alias("_table"), F.col("operate_type").alias("_type"), *rest)


def route_changes(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """Changes that have a route, with its sink columns, and only the listed data fields.

    An empty field list keeps every field; names must match exactly.
    """
    r = _keyed(routes)
    listed = F.split("sink_columns", ",")
    kept = F.map_filter("data", lambda k, v: F.array_contains(listed, k))
    every = F.col("sink_columns").isNull() | (F.col("sink_columns") == "")
    return (changes.join(r, (changes["table"] == r["_table"]) & (changes["type"] == r["_type"]))
            .withColumn("data", F.when(every, F.col("data")).otherwise(kept))
            .drop("_table", "_type"))


def unrouted(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """Changes without a route."""
    r = _keyed(routes)
    return changes.join(r, (changes["table"] == r["_table"]) & (changes["type"] == r["_type"]),
                        "left_anti")


def split_routes(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dimension rows, fact rows); other sink types are dropped."""
    return (routed.filter(F.col("sink_type") == SINK_DIM),
            routed.filter(F.col("sink_type") == SINK_FACT))


def latest_by_key(changes: DataFrame, pk: str | list[str], seq: str | list[str], *,
                  type_column: str = "type", on_delete: str = "keep") -> DataFrame:
    """The current row of each key: the one with the highest `seq`.

    ``on_delete="keep"`` leaves a deleted key's last row in place, ``"drop"`` removes the key.
    """
    if on_delete not in ("keep", "drop"):
        raise ValueError(on_delete)
    pk, seq = ([c] if isinstance(c, str) else c for c in (pk, seq))
    newest = Window.partitionBy(*pk).orderBy(*[F.desc(c) for c in seq])
    rows = changes.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
    return rows.filter(F.col(type_column) != "delete") if on_delete == "drop" else rows


def upsert_by_key(changes: DataFrame, pk: str, seq: str, data: str = "data",
                  deleted: str | None = None) -> DataFrame:
    """Fold data maps per key, field by field: a change only touches the fields it carries.

    Returns ``pk`` and the merged map. The newest value of a field is found by an aggregate that
    combines before the shuffle, and at most one row per field of the table is collected per key.
    Where the boolean `deleted` is true the key is removed, and only later changes count.
    """
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    own = F.col(pk) if pk in changes.columns else F.try_element_at(data, F.lit(pk))
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.when(gone, F.array(F.struct(F.lit(None).cast("string").alias("key"),
                                            F.lit(None).cast("string").alias("value")))
                     ).otherwise(F.coalesce(F.map_entries(data), none))
    fields = changes.select(own.alias(pk), F.col(seq).alias("_seq"), F.explode(entries).alias("_e")
                            ).filter(F.col(pk).isNotNull())
    newest = fields.groupBy(pk, F.col("_e.key").alias("_f")).agg(
        F.max_by(F.struct("_e.value"), "_seq").alias("_v"), F.max("_seq").alias("_seq"))
    listed = newest.groupBy(pk).agg(
        F.max(F.when(F.col("_f").isNull(), F.col("_seq"))).alias("_gone"),
        F.sort_array(F.collect_list(F.struct("_f", "_v.value", "_seq"))).alias("_all"))
    kept = F.filter("_all", lambda e: e["_f"].isNotNull() & (
        F.col("_gone").isNull() | (e["_seq"] > F.col("_gone"))))
    folded = listed.withColumn("_all", kept).filter(F.size("_all") > 0)
    return folded.select(pk, F.map_from_entries(F.transform(
        "_all", lambda e: F.struct(e["_f"], e["value"]))).alias(data))
