"""Quality rules: robust multivariate outliers of document statistics.

Statistics of each document become a vector of variance-stabilised rates. Per language and source,
the minimum-covariance-determinant estimate of their centre and spread is fitted by concentration
steps, each of which is one aggregation over all documents, and a document whose Mahalanobis
distance lies beyond a chi-square bound is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from millrace.llm.words import Piece, pieces, span_hash, sum_by_row, whole, windows
from millrace.session import scratch_dir

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
MARK = np.zeros(256, dtype=bool)
MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True

BASE_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3

# The vector: name and the least standard deviation that counts, so that a rate which is constant
# in most documents does not turn one odd character into an outlier. Floors are low enough for each
# rate to pass CHI2_REJECT on its own.
FEATURES = (("f_length", 0.05), ("f_symbols", 0.05), ("f_marks", 0.05), ("f_digits", 0.10),
            ("f_upper", 0.06), ("f_dup_lines", 0.05), ("f_repeats", 0.05))
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

# Quantiles of the chi-square distribution with 7 degrees of freedom, at 0.5, 0.975 and
# 1 - 1e-12. The rates have longer tails than a normal sample, so only what is far out is rejected.
CHI2_MEDIAN, CHI2_REWEIGHT, CHI2_REJECT = 6.346, 16.013, 74.0

H_SHARE = 0.75          # share of a group that the concentration steps keep
STEPS = 6
LEAST_GROUP = 60        # smaller groups are judged by their language, then by all documents
BINS_PER_E = 24         # resolution of the distance threshold: 24 bins per factor e


def measure(piece: Piece) -> dict[str, np.ndarray]:
    """The counts of each row of a piece."""
    words, data, ends = piece.words(), piece.data, piece.ends
    inside = words.inside
    points = inside & ((data & 0xC0) != 0x80)
    out = {"n_words": words.counts.astype(np.int64),
           "word_chars": sum_by_row(points, ends),
           "n_symbols": sum_by_row(SYMBOL[data], ends),
           "n_marks": sum_by_row(MARK[data], ends),
           "n_digits": sum_by_row(DIGIT[data], ends),
           "n_upper": sum_by_row(UPPER[data], ends)}
    prefix = piece.prefix()
    # lines: a row's text split at \n; only those with a word count
    newline = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([ends[:-1], newline + 1]))
    line_starts = line_starts[line_starts < len(data)]
    following = np.append(line_starts[1:], len(data))
    is_cut = np.zeros(len(data) + 1, dtype=bool)
    is_cut[newline + 1] = True
    line_ends = following - is_cut[following]
    line_ends = np.maximum(line_ends, line_starts)
    worded = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_row = np.searchsorted(ends, line_starts, side="right") - 1
    line_hash = span_hash(prefix, line_starts, line_ends)
    out["n_lines"] = np.bincount(line_row, minlength=piece.n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(
        line_row[~first_of(line_row, line_hash)], minlength=piece.n).astype(np.int64)
    # words in windows that occur twice or more in the row
    hashes = span_hash(prefix, words.starts, words.ends)
    runs = windows(hashes, REPEAT_WINDOW)
    keep = np.flatnonzero(whole(words.first, words.counts, REPEAT_WINDOW, len(runs)))
    row = words.row()
    repeated = keep[often(row[keep], runs[keep])]
    covered = np.zeros(len(hashes), dtype=bool)
    for j in range(REPEAT_WINDOW):
        covered[repeated + j] = True
    out["n_repeat_words"] = sum_by_row(covered, words.first)
    return out


def groups_of(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (row, hash), and for each place in it whether a new group starts."""
    order = np.lexsort((hashes, rows))
    new = np.ones(len(rows), dtype=bool)
    r, h = rows[order], hashes[order]
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return order, new


def first_of(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    order, new = groups_of(rows, hashes)
    out = np.zeros(len(rows), dtype=bool)
    out[order] = new
    return out


def often(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    order, new = groups_of(rows, hashes)
    group = np.cumsum(new) - 1
    out = np.zeros(len(rows), dtype=bool)
    out[order] = np.bincount(group)[group] >= 2 if len(rows) else False
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks",
          "n_digits", "n_upper", "n_lines")


def statistics(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, its counts and whether it fails the base rules.

    A null text counts as empty. Rows are judged one by one, repeated rows alike.
    """
    kept = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
                       F.col(text_col).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = measure(piece)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(f"k{i}") for i in range(len(keep))),
                 *(pa.array(found[c]) for c in COUNTS)],
                [*(f"k{i}" for i in range(len(keep))), *COUNTS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)),
                        *(f"{c} long" for c in COUNTS)])
    failed = (F.col("n_words") < BASE_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (kept.mapInArrow(count, schema)
            .withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
            .withColumn("base_failed", failed))


def features() -> list[Column]:
    """Square roots of rates, and the logarithm of the mean word length."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    values = (F.log(chars / words), F.sqrt(F.col("n_symbols") / words),
              F.sqrt(F.col("n_marks") / words), F.sqrt(F.col("n_digits") / chars),
              F.sqrt(F.col("n_upper") / chars), F.sqrt(F.col("n_dup_lines") / lines),
              F.sqrt(F.col("n_repeat_words") / words))
    return [v.alias(name) for v, (name, _) in zip(values, FEATURES, strict=True)]


def moments(weight: Column) -> list[Column]:
    """Sums that give count, mean and covariance of the rows with weight 1."""
    x = [F.col(name) for name, _ in FEATURES]
    return [F.sum(weight.cast("double")).alias("m"),
            *(F.sum(x[i] * weight.cast("double")).alias(f"s{i}") for i in range(P)),
            *(F.sum(x[i] * x[j] * weight.cast("double")).alias(f"q{i}_{j}") for i, j in PAIRS)]


MOMENTS = ["m", *(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in PAIRS)]


def invert(fitted: DataFrame, inflate: bool) -> DataFrame:
    """Per cell: centre ``c*`` and the inverse of the covariance ``w*`` from moment sums."""
    floors = np.array([floor for _, floor in FEATURES]) ** 2

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            value = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(False)
            m = np.maximum(value("m").astype(float), 1.0)
            centre = np.stack([value(f"s{i}") / m for i in range(P)], 1)
            spread = np.zeros((n, P, P))
            for i, j in PAIRS:
                spread[:, i, j] = spread[:, j, i] = \
                    value(f"q{i}_{j}") / m - centre[:, i] * centre[:, j]
            spread[:, range(P), range(P)] = np.maximum(spread[:, range(P), range(P)], 0.0)
            if inflate:
                spread = spread * value("scale").astype(float)[:, None, None]
            spread[:, range(P), range(P)] += floors
            inverse = np.linalg.inv(spread)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("cell")),
                 *(pa.array(centre[:, i]) for i in range(P)),
                 *(pa.array(inverse[:, i, j]) for i, j in PAIRS)],
                ["cell", *(f"c{i}" for i in range(P)), *(f"w{i}_{j}" for i, j in PAIRS)])

    schema = ", ".join(["cell string", *(f"c{i} double" for i in range(P)),
                        *(f"w{i}_{j} double" for i, j in PAIRS)])
    return fitted.mapInArrow(solve, schema)


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its cell's estimate."""
    d = [F.col(name) - F.col(f"c{i}") for i, (name, _) in enumerate(FEATURES)]
    out = F.lit(0.0)
    for i, j in PAIRS:
        out = out + d[i] * d[j] * F.col(f"w{i}_{j}") * (1.0 if i == j else 2.0)
    return out


def with_cells(rows: DataFrame, least: int) -> DataFrame:
    """Add ``cell``: the language and source if at least ``least`` fit rows share them, else the
    pooled remainder of the language, else the pooled remainder of all; null where even that is
    too small. Null languages and sources are values of their own."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = rows.withColumn("_l", name("_lang")).withColumn("_s", name("_source"))
    fit = (~F.col("base_failed")).cast("long")
    pairs = rows.groupBy("_l", "_s").agg(F.sum(fit).alias("n"))
    by_lang = W.partitionBy("_l")
    small = F.when(F.col("n") < least, F.col("n")).otherwise(0)
    pairs = pairs.withColumn("n_lang", F.sum(small).over(by_lang))
    level = (F.when(F.col("n") >= least, 0).when(F.col("n_lang") >= least, 1).otherwise(2))
    pairs = pairs.withColumn("level", level)
    rest = pairs.agg(F.sum(F.when(F.col("level") == 2, F.col("n")).otherwise(0)).alias("n_rest"))
    cell = (F.when(F.col("level") == 0, F.concat_ws("\t", F.lit("0"), "_l", "_s"))
            .when(F.col("level") == 1, F.concat_ws("\t", F.lit("1"), "_l"))
            .when(F.col("n_rest") >= least, F.lit("2")))
    pairs = pairs.withColumn("n_rest", rest.scalar()).select("_l", "_s", cell.alias("cell"))
    return rows.join(pairs, ["_l", "_s"]).drop("_l", "_s")


def bin_of(d2: Column) -> Column:
    return F.floor(F.log(F.greatest(d2, F.lit(1e-6))) * BINS_PER_E).cast("int")


def median_bin(binned: DataFrame) -> DataFrame:
    """Per cell, (upper edge of the bin that holds the median of d2)."""
    up = W.partitionBy("cell").orderBy("bin")
    return (binned.withColumn("run", F.sum("n").over(up))
            .withColumn("all", F.sum("n").over(W.partitionBy("cell")))
            .filter(F.col("run") >= 0.5 * F.col("all"))
            .groupBy("cell").agg(F.exp((F.min("bin") + 1) / BINS_PER_E).alias("median")))


def concentrate(rows: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """One concentration step: moments of the closest ``share`` of each cell, in whole bins of
    distance. Rows are reduced to (cell, bin) before the shuffle, whatever the size of a cell."""
    near = rows.join(estimate, "cell").withColumn("bin", bin_of(distance()))
    binned = near.groupBy("cell", "bin").agg(*moments(F.lit(1)))
    up = W.partitionBy("cell").orderBy("bin")
    kept = (binned.withColumn("run", F.sum("m").over(up) - F.col("m"))
            .withColumn("all", F.sum("m").over(W.partitionBy("cell")))
            .filter(F.col("run") < share * F.col("all")))
    return kept.groupBy("cell").agg(*(F.sum(c).alias(c) for c in MOMENTS))


def start(rows: DataFrame) -> DataFrame:
    """A robust first estimate per cell: medians, and deviations of the middle half as spread."""
    ranks = [0.25, 0.5, 0.75]
    mid = rows.groupBy("cell").agg(*(
        F.percentile_approx(name, ranks, 1000).alias(f"p{i}") for i, (name, _) in enumerate(FEATURES)))
    return mid.select(
        "cell", *(F.col(f"p{i}")[1].alias(f"c{i}") for i in range(P)),
        *((1 / (F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2)
                + FEATURES[i][1] ** 2) if i == j else F.lit(0.0)).alias(f"w{i}_{j}")
          for i, j in PAIRS))


def outliers(stats: DataFrame, steps: int = STEPS, share: float = H_SHARE,
             least: int = LEAST_GROUP, reject: float = CHI2_REJECT) -> DataFrame:
    """Add ``cell``, ``d2`` (squared robust distance) and ``kept`` to rows of ``statistics``.

    Rows that fail the base rules take no part in the fit and are not kept. A row without a cell,
    as all documents together are too few, has a null distance and is kept. ``stats`` must hold
    ``_lang`` and ``_source``; it is read once per step, so pass a written table.
    """
    rows = with_cells(stats.select("*", *features()), least)
    fit = rows.filter(~F.col("base_failed") & F.col("cell").isNotNull()).select(
        "cell", *(name for name, _ in FEATURES))
    spark, folder = stats.sparkSession, scratch_dir(stats.sparkSession, "mcd")

    def kept(table: DataFrame, name: str) -> DataFrame:
        """A table of cells, written: its size is then known, so that joining it moves no rows."""
        table.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    estimate = kept(start(fit), "start")
    for k in range(steps):
        estimate = kept(invert(concentrate(fit, estimate, share), inflate=False), f"step{k}")
    # consistency: scale so that the median distance is that of a normal sample, then reweight once
    spaced = fit.join(estimate, "cell").withColumn("d2", distance())
    binned = spaced.withColumn("bin", bin_of(F.col("d2"))).groupBy("cell", "bin").agg(
        F.count("*").alias("n"))
    scale = kept(median_bin(binned).select(
        "cell", F.greatest(F.lit(1.0), F.col("median") / CHI2_MEDIAN).alias("scale")), "scale")
    scaled = spaced.join(scale, "cell")
    core = scaled.groupBy("cell").agg(
        *moments(F.col("d2") <= CHI2_REWEIGHT * F.col("scale")), F.first("scale").alias("scale"))
    final = kept(invert(core, inflate=True), "final")
    judged = rows.join(final, "cell", "left").withColumn("d2", distance())
    ok = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= reject)
    return judged.withColumn("kept", ok).select(*stats.columns, "cell", "d2", "kept")


def quality_rules(docs: DataFrame, *keep: str, text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", **fit) -> DataFrame:
    """Statistics, distance and verdict of every document; the counts are written once and reread."""
    stats = statistics(docs.withColumn("_lang", F.col(lang_col).cast("string"))
                       .withColumn("_source", F.col(source_col).cast("string")),
                       *keep, "_lang", "_source", text_col=text_col)
    folder = scratch_dir(docs.sparkSession, "stats")
    stats.write.parquet(folder)
    return outliers(docs.sparkSession.read.parquet(folder), **fit)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept", "d2")
