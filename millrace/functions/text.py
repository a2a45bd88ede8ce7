"""Word segmentation and the keyword table functions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.functions import pandas_udf

from millrace.codes import CART, CLICK, ORDER

WORD = r"([\p{L}\p{N}]+)"
MOST_DICTIONARY = 64 << 20      # bytes of a dictionary's words


def words(text: Column | str) -> Column:
    """Array of lower-cased runs of letters and digits, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def dictionary_words(spark: SparkSession, dictionary: Iterable[str]):
    """Segmenter for scripts without spaces: longest dictionary match inside Han runs.

    Han characters no entry covers come out one by one; other runs are kept whole, as `words`
    does. Returns a column function.
    """
    import re

    known_words = frozenset(w.lower() for w in dictionary)
    size = sum(len(w.encode()) for w in known_words)
    if size > MOST_DICTIONARY:
        raise ValueError(f"the dictionary has {size} bytes; at most {MOST_DICTIONARY} are sent to every task")
    entries = spark.sparkContext.broadcast(known_words)
    longest = max((len(w) for w in entries.value), default=1)
    han = "㐀-鿿"
    runs = re.compile(f"[{han}]+|[^\\W_{han}]+")

    @pandas_udf("array<string>")
    def segment(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = entries.value

        def split(run: str) -> list[str]:
            out, at = [], 0
            while at < len(run):
                size = next((n for n in range(min(longest, len(run) - at), 1, -1)
                             if run[at:at + n] in known), 1)
                out.append(run[at:at + size])
                at += size
            return out

        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            return [w for run in runs.findall(text.lower())
                    for w in (split(run) if "㐀" <= run[0] <= "鿿" else [run])]

        for batch in texts:
            yield batch.map(one)

    return segment


def explode_words(df: DataFrame, text: str, out: str = "keyword", segment=words) -> DataFrame:
    """One row per word of `text`; rows without a word disappear."""
    return df.withColumn(out, F.explode(segment(F.col(text))))


def behaviour_counts(click: str = "click_ct", cart: str = "cart_ct",
                     order: str = "order_ct") -> Column:
    """Array of (ct, source) for each of the three counts above zero."""
    pairs = F.array(*[F.struct(F.col(c).cast("bigint").alias("ct"), F.lit(s).alias("source"))
                      for c, s in ((click, CLICK), (cart, CART), (order, ORDER))])
    return F.filter(pairs, lambda p: p["ct"] > 0)


def unpivot_counts(df: DataFrame, click: str = "click_ct", cart: str = "cart_ct",
                   order: str = "order_ct") -> DataFrame:
    """One row (ct, source) per non-zero behaviour count; the other columns stay."""
    keep = [c for c in df.columns if c not in ("ct", "source")]
    return df.select(*keep, F.inline(behaviour_counts(click, cart, order)))


def register(spark: SparkSession) -> None:
    """Register the table functions ``words_of`` and ``word_scores`` for `LATERAL f(...)` in SQL.

    They are SQL functions, so a lateral join over them becomes a plain Generate step.
    """
    found = r"regexp_extract_all(lower({}), r'([\p{{L}}\p{{N}}]+)', 1)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION words_of(txt STRING) RETURNS TABLE (word STRING)
        RETURN SELECT explode({found.format('txt')})
    """)
    counts = ", ".join(f"named_struct('ct', {c}, 'source', '{s}')"
                       for c, s in (("click", CLICK), ("cart", CART), ("orders", ORDER)))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION word_scores(
            name STRING, click BIGINT, cart BIGINT, orders BIGINT)
        RETURNS TABLE (keyword STRING, ct BIGINT, source STRING)
        RETURN SELECT inline(flatten(transform({found.format('name')}, w -> transform(
            filter(array({counts}), c -> c.ct > 0),
            c -> named_struct('keyword', w, 'ct', c.ct, 'source', c.source)))))
    """)
