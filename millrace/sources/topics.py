"""Text and JSON sources, from Kafka or from files holding the same lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

CORRUPT = "_corrupt_record"


def read_topic(spark: SparkSession, name: str, *, fmt: str = "kafka", stream: bool = True,
               group: str | None = None, position: str | None = None,
               **options: str) -> DataFrame:
    """Lines of a topic as ``value STRING``.

    ``fmt="kafka"`` subscribes to `name` (give ``kafka.bootstrap.servers`` as an option);
    ``fmt="text"`` reads files below the path `name`, for replay and tests. A Kafka stream
    keeps its offsets in its checkpoint; `group` only names the consumer group. `position` adds
    the Kafka offset under that name, which orders the changes of a key.
    """
    reader = (spark.readStream if stream else spark.read).format(fmt)
    if fmt == "kafka":
        reader = reader.option("subscribe", name)
        if group:
            reader = reader.option("kafka.group.id", group)
        return reader.options(**options).load().select(
            F.col("value").cast("string"), *([F.col("offset").alias(position)] if position else []))
    return reader.options(**options).load(name).select("value")


def read_json_topic(spark: SparkSession, name: str, schema: str, *, fmt: str = "kafka",
                    stream: bool = True, view: str | None = None, **options: str
                    ) -> tuple[DataFrame, DataFrame]:
    """A topic of JSON rows with a declared schema, optionally registered as a temp view, and the
    quarantine of malformed lines.

    A Kafka stream starts at the latest offset unless told otherwise.
    """
    if fmt == "kafka" and stream:
        options.setdefault("startingOffsets", "latest")
    good, bad = split_corrupt(parse_json(read_topic(spark, name, fmt=fmt, stream=stream, **options),
                                         schema))
    if view:
        good.createOrReplaceTempView(view)
    return good, bad.select(CORRUPT)


def parse_json(df: DataFrame, schema: str | StructType, column: str = "value") -> DataFrame:
    """Replace the JSON text `column` by the schema's columns plus ``_corrupt_record``.

    A malformed row keeps its text in ``_corrupt_record``, the other new columns are null.
    """
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    shape = StructType(list(shape.fields)).add(CORRUPT, StringType())
    parsed = F.from_json(column, shape, {"mode": "PERMISSIVE",
                                         "columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in df.columns if c != column]
    # The generator keeps later filters above the parser. They would otherwise be pushed below
    # the projection with a copy of the parser in each of them.
    once = F.inline(F.array(F.struct(F.col(column).alias("_text"), parsed.alias("_row"))))
    return (df.select(*rest, once)
              .select(*rest, *[F.col(f"_row.`{f.name}`") for f in shape.fields[:-1]],
                      F.when(F.col("_row").isNull(), F.coalesce("_text", F.lit("")))
                       .otherwise(F.col(f"_row.{CORRUPT}")).alias(CORRUPT)))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the quarantine column, quarantined rows)."""
    bad = F.col(CORRUPT).isNotNull()
    return df.filter(~bad).drop(CORRUPT), df.filter(bad)


def to_json_rows(df: DataFrame, *, drop: tuple[str, ...] = ()) -> DataFrame:
    """Each row as one JSON text column ``value``; null fields are left out."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in drop])).alias("value"))
