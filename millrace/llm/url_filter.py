"""URL filters: host and path rules, and for all other URLs a ratio of two character models.

Two smoothed variable-order Markov models are counted, one over the URLs that a rule allows, one over
those that a rule blocks. A URL's score is its log-likelihood under the first less that under the
second, per character, and the threshold is calibrated on labelled URLs that were not counted.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from millrace.session import scratch_dir

# The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

ORDER = 4               # characters of context at most
WEIGHT = 2.0            # how many observations the shorter context's estimate counts for
ALPHABET = 128          # order 0 falls back on a uniform choice of so many characters
BINS = 100              # threshold resolution: steps of 1 / BINS nats per character
START = "\u0002"        # stands before the first character of a URL
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule = F.when(fits, F.lit(domain + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def grams(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per character of ``shown``: the character after its ORDER preceding ones.

    The text is cut into characters once, so the work is in proportion to its length.
    """
    characters = F.regexp_extract_all(F.concat(F.lit(START * ORDER), F.col("shown")), F.lit("(?s)."), F.lit(0))
    places = lambda c: F.sequence(F.lit(1), F.size(c) - ORDER)
    cut = F.transform(F.array(characters), lambda c: F.transform(
        places(c), lambda at: F.array_join(F.slice(c, at, F.lit(ORDER + 1)), "")))[0]
    return rows.select(*keep, F.explode(F.when(F.length("shown") > 0, cut)).alias("gram"))


def log_ratios(counted: DataFrame) -> DataFrame:
    """(gram, ratio) for every full gram of ``counted`` (gram, a, b), counts in either class.

    Order by order: P(c | context) = (n(context c) + WEIGHT * P(c | shorter context)) /
    (n(context) + WEIGHT). All tables hold distinct grams only.
    """
    model = None
    for order in range(ORDER + 1):
        cut = F.substring(F.col("gram"), ORDER + 1 - order, order + 1)
        level = counted.groupBy(cut.alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        around = W.partitionBy(F.substring(F.col("gram"), 1, order))
        if order == 0:
            totals = counted.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
            level = (level.withColumn("ta", totals.select("ta").scalar())
                     .withColumn("tb", totals.select("tb").scalar())
                     .withColumn("sa", F.lit(1 / ALPHABET)).withColumn("sb", F.lit(1 / ALPHABET)))
        else:
            level = (level.withColumn("ta", F.sum("a").over(around))
                     .withColumn("tb", F.sum("b").over(around))
                     .withColumn("shorter", F.substring(F.col("gram"), 2, order))
                     .join(model.select(F.col("gram").alias("shorter"), F.col("pa").alias("sa"),
                                        F.col("pb").alias("sb")), "shorter"))
        model = level.select("gram", *((F.col(n) + WEIGHT * F.col(s)).__truediv__(F.col(t) + WEIGHT)
                                       .alias(p) for n, t, s, p in (("a", "ta", "sa", "pa"),
                                                                    ("b", "tb", "sb", "pb"))))
    return model.select("gram", (F.log("pa") - F.log("pb")).alias("ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row ``cut``: the middle of the thresholds with the best mean of both classes' accuracies
    on rows (score, label), 0 where a class is missing."""
    both = scored.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.sum((F.col("label") == "allow").cast("double")).alias("a"),
        F.sum((F.col("label") == "block").cast("double")).alias("b"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    gain = both.select(
        "bin", (1 - F.coalesce(F.sum("a").over(below), F.lit(0.0)) / F.sum("a").over(everything)
                + F.coalesce(F.sum("b").over(below), F.lit(0.0)) / F.sum("b").over(everything)
                ).alias("gain"), F.lag("bin").over(W.orderBy("bin")).alias("last"))
    best = gain.groupBy("gain").agg(
        F.avg((F.col("bin") + F.coalesce(F.col("last") + 1, F.col("bin"))) / 2 / BINS).alias("cut"))
    return best.agg(F.coalesce(F.max_by("cut", "gain"), F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, *keep: str, url_col: str = "url", rules=RULES) -> DataFrame:
    """The columns ``keep`` with ``host``, ``path``, ``rule``, ``verdict``, ``score``, ``cut``.

    A URL without a rule is allowed if its score reaches the calibrated cut. One that is null or
    has no ``://`` has empty host and path, no rule and no score, and is blocked. With no labelled
    URL of a class the cut is 0. Each row is judged by its URL alone, so repeated rows agree.
    """
    rows = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
                        F.col(url_col).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("label", verdict)
    # what the models see: the host without its top-level domain, and the path, so that they learn
    # how URLs are written rather than the rules themselves
    shown = F.concat(F.regexp_replace("host", r"[^.]*$", ""), "path")
    texts = rows.groupBy("url", "host", "path", "label").agg(F.count("*").alias("n")).withColumn(
        "shown", shown).withColumn("tried", F.crc32(F.col("url").cast("binary")) % 5 == 0)
    folder = scratch_dir(pages.sparkSession, "urls")
    # a number stands for the URL beside its characters, so a long URL is carried once
    texts.withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{folder}/texts")
    texts = pages.sparkSession.read.parquet(f"{folder}/texts")
    learn = ~F.col("tried") & F.col("label").isNotNull()
    counted = grams(texts.filter(F.length("shown") > 0), "label", "tried", "n").groupBy("gram").agg(
        F.sum(F.when(learn & (F.col("label") == "allow"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(learn & (F.col("label") == "block"), F.col("n")).otherwise(0)).alias("b"))
    counted.write.parquet(f"{folder}/counts")
    model = log_ratios(pages.sparkSession.read.parquet(f"{folder}/counts"))
    sums = (grams(texts, "number").join(model, "gram").groupBy("number")
            .agg(F.avg("ratio").alias("score")).join(texts.select("number", "url"), "number").select("url", "score"))
    sums.write.parquet(f"{folder}/scores")
    sums = pages.sparkSession.read.parquet(f"{folder}/scores")
    scored = rows.join(sums, "url", "left")
    trial = (F.crc32(F.col("url").cast("binary")) % 5 == 0) & F.col("label").isNotNull()
    cut = threshold(scored.filter(trial & F.col("score").isNotNull()).select("score", "label"))
    by_model = F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")
    return (scored.withColumn("cut", cut.scalar())
            .withColumn("verdict", F.coalesce("label", by_model))
            .select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
                    "host", "path", "rule", "verdict", "score", "cut"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = judge(spark.read.parquet(f"{folder}/pages.parquet"), "page_id")
    return rows.select("page_id", "host", "path", "rule", "verdict", "score")
