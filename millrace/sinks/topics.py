"""Topic-like sinks: Kafka, or folders of JSON lines with the same layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.sources.topics import to_json_rows


def topic_rows(df: DataFrame, topic: str) -> DataFrame:
    """Rows for a Kafka sink with a fixed topic: null key, JSON value."""
    return to_json_rows(df).select(F.lit(topic).alias("topic"), "value")


def rows_by_table(routed: DataFrame) -> DataFrame:
    """Rows for a Kafka sink that picks the topic per row; the body is the data alone."""
    return routed.select(F.col("sink_table").alias("topic"), F.to_json("data").alias("value"))


def write_topics(df: DataFrame, path_or_servers: str, *, fmt: str = "kafka", **options: str) -> None:
    """Batch write of (topic, value) rows; inside a micro-batch this is at-least-once on Kafka.

    ``fmt="text"`` writes one folder per topic.
    """
    if fmt == "kafka":
        df.write.format("kafka").option("kafka.bootstrap.servers", path_or_servers).options(
            **options).save()
    else:
        df.write.format(fmt).mode(options.pop("mode", "append")).options(**options).partitionBy(
            "topic").save(path_or_servers)


def console(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rows as one text column with a prefix, for the console sink."""
    return to_json_rows(df).select(F.concat(F.lit(prefix), F.col("value")).alias("value"))


def raw_lines(df: DataFrame, received: str | None = None) -> DataFrame:
    """Lines with the day they arrived on, for a text sink partitioned by ``dt``."""
    day = F.current_date() if received is None else F.to_date(received)
    return df.select("value", F.date_format(day, "yyyy-MM-dd").alias("dt"))
