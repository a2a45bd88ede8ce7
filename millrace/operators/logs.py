"""The event log: splitting, exposure rows and the new-visitor flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace import schemas
from millrace.functions.times import millis_time
from millrace.sources.topics import CORRUPT, parse_json

DEVICE = ["mid", "vc", "ch", "ar", "is_new"]
PAGE = ["page_id", "last_page_id", "item", "during_time"]


def blank(column: Column | str) -> Column:
    """Null or empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | (c == "")


def parse_logs(df: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(log rows, quarantine). A row needs a device id and a time besides being well-formed."""
    rows = parse_json(df, schemas.RAW_LOG, column)
    bad = F.col(CORRUPT).isNotNull() | F.col("common.mid").isNull() | F.col("ts").isNull()
    return rows.filter(~bad).drop(CORRUPT), rows.filter(bad)


def flat_log(df: DataFrame) -> DataFrame:
    """Device and page fields as columns, `ts` as a timestamp; `start` and `displays` stay."""
    rest = [c for c in df.columns if c not in ("common", "page", "ts", "start", "displays")]
    return df.select(*rest, *[f"common.{c}" for c in DEVICE], *[f"page.{c}" for c in PAGE],
                     millis_time("ts").alias("ts"), "start", "displays")


def split_logs(logs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(start rows, page rows, display rows) of flat logs.

    A row with a start object is a start row and nothing else, any other row is a page row.
    """
    starts = logs.filter(F.col("start").isNotNull())
    pages = logs.filter(F.col("start").isNull())
    return (starts.drop("displays", *PAGE), pages.drop("start"), explode_displays(pages))


def tagged_log(logs: DataFrame) -> DataFrame:
    """Flat logs as start, page and display rows in one table, told apart by ``kind``.

    The same rows as `split_logs`, but every log row is read and parsed once for all three.
    """
    text = F.lit(None).cast("string")
    carried = {c: F.col(c) for c in [*DEVICE, *PAGE, "ts"]}

    def row(kind: str, **own: Column) -> Column:
        values = {"kind": F.lit(kind), **carried, "item_type": text, **own}
        return F.struct(*[v.alias(n) for n, v in values.items()])

    no_page = {c: F.lit(None).cast("bigint" if c == "during_time" else "string") for c in PAGE}
    no_device = {c: text for c in DEVICE} | no_page
    page_id = F.col("page_id")
    shown = F.transform(F.coalesce("displays", F.array().cast(dict(logs.dtypes)["displays"])), lambda d: row(
        "display", **no_device | {"page_id": page_id, "item": d["item"], "item_type": d["item_type"],
                                  "ts": F.lit(None).cast("timestamp")}))
    start = F.array(row("start", **no_page))
    return logs.select(F.inline(F.when(F.col("start").isNotNull(), start).otherwise(
        F.concat(F.array(row("page")), shown))))


def explode_displays(pages: DataFrame, displays: str = "displays", *carry: str) -> DataFrame:
    """One row per exposed object: its fields plus the page it was shown on."""
    return pages.select(*carry, "page_id", F.inline(displays))


def repair_is_new(logs: DataFrame, time: str = "ts") -> DataFrame:
    """Set ``is_new`` to '0' on rows marked new after the device's first marked day.

    Rows not marked new need no look at the device's history, so they are not shuffled. The
    first days come from an aggregate, combined before the shuffle, and not from a window over
    the device, and the join below can be split when one device holds most rows.
    """
    marked = logs.filter(F.col("is_new") == "1")
    others = logs.filter(F.col("is_new").isNull() | (F.col("is_new") != "1"))
    first = (marked.filter(F.col("mid").isNotNull()).groupBy(F.col("mid").alias("_mid"))
             .agg(F.min(F.to_date(time)).alias("_first")))
    later = F.to_date(time) != F.col("_first")
    fixed = (marked.join(first, marked["mid"] == first["_mid"], "left")
             .withColumn("is_new", F.when(later, "0").otherwise(F.col("is_new")))
             .select(*logs.columns))
    return others.unionByName(fixed)


def search_terms(pages: DataFrame, time: str = "ts") -> DataFrame:
    """Search texts: what was asked for on the result-list page."""
    return pages.filter((F.col("page_id") == "good_list") & F.col("item").isNotNull()).select(
        F.col("item").alias("fullword"), F.col(time).alias("ts"))


def search_terms_from_view(page_view: DataFrame, time: str = "rowtime") -> DataFrame:
    """The same from rows that hold the page as a map."""
    page = F.col("page")
    return page_view.filter((page["page_id"] == "good_list") & page["item"].isNotNull()).select(
        page["item"].alias("fullword"), F.col(time).alias("ts"))

