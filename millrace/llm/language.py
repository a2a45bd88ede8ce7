"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1. One binary classifier per bit weighs hashed byte
trigrams by how much likelier they are in the languages with +1 than in those with -1, counted over
all training documents. Decoding sums, over the bits, a loss of the classifier's margin against
each codeword, weighted by how often that classifier was right about that language in training; the
language of least loss wins, and a narrow win is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.words import Piece, folded, mix, pieces
from millrace.session import scratch_dir

BUCKETS = 1 << 15       # hashed trigrams
MOST_LANGUAGES = 255    # bound on the model: languages x buckets numbers
EXHAUSTIVE = 7          # up to so many languages get every possible bit
SMOOTH = 2000.0         # trigrams that every language is lent from the mean of all
SHARPNESS = 4.0         # margins are log-odds per trigram, a few tenths for clear text
AMBIGUOUS = 0.1         # least gap of mean loss between the best two languages

KEPT = np.arange(256, dtype=np.uint8)    # letters and non-ASCII bytes; anything else is a gap
KEPT[:97] = KEPT[123:128] = 32


def trigrams(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of each trigram whose middle byte is no gap; rows are padded with gaps."""
    data = KEPT[folded(piece.data)]
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before, after = np.empty_like(data), np.empty_like(data)
    before[1:], before[0], after[:-1], after[-1] = data[:-1], 32, data[1:], 32
    starts = piece.ends[:-1][piece.ends[:-1] < len(data)]
    before[starts] = 32
    after[piece.ends[1:][piece.ends[1:] > 0] - 1] = 32
    at = np.flatnonzero(data != 32)
    key = (before[at].astype(np.uint64) << np.uint64(16)) | \
        (data[at].astype(np.uint64) << np.uint64(8)) | after[at].astype(np.uint64)
    return (mix(key) & np.uint64(BUCKETS - 1)).astype(np.int64), at


def codewords(n: int) -> np.ndarray:
    """An n x bits matrix of +1 and -1: all splits of few languages, a fixed random choice of many."""
    if n < 2:
        return np.ones((n, 0))
    if n <= EXHAUSTIVE:
        return np.array([(1, *rest) for rest in product((1, -1), repeat=n - 1)][1:]).T
    bits = math.ceil(10 * math.log2(n))
    random = np.random.default_rng(n)
    best = max((random.choice((-1, 1), (n, bits)) for _ in range(50)),
               key=lambda m: -np.max(m @ m.T - 2 * bits * np.eye(n)))
    return best[:, np.abs(best.sum(0)) < n]


def count_trigrams(training: DataFrame) -> DataFrame:
    """(lang, bucket, n) summed per task, then over tasks, of rows (text, lang)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for piece in pieces(batches):
            bucket, at = trigrams(piece)
            names, code = np.unique(piece.column("lang").to_numpy(False).astype(str),
                                    return_inverse=True)
            row = np.searchsorted(piece.ends, at, side="right") - 1
            found = np.bincount(code[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
            for name, part in zip(names, found.reshape(-1, BUCKETS), strict=True):
                sums[name] = sums.get(name, 0) + part
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some)), pa.array(some.astype(np.int32)),
                 pa.array(total[some].astype(np.int64))], ["lang", "bucket", "n"])

    return (training.mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def fit(training: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, codewords, weights per bucket and bit) from all rows (text, lang).

    The counts that come to the driver are bounded by MOST_LANGUAGES x BUCKETS.
    """
    names = sorted(r.lang for r in training.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    codes = codewords(len(names))
    counts = np.zeros((len(names), BUCKETS))
    if names:
        table = count_trigrams(training).toArrow()
        at = {name: i for i, name in enumerate(names)}
        rows = np.array([at[x] for x in table["lang"].to_pylist()], dtype=int)
        counts[rows, table["bucket"].to_numpy()] = table["n"].to_numpy()
    total = counts.sum(1, keepdims=True)
    common = ((counts + 1 / BUCKETS) / (total + 1)).mean(0) if names else 0
    shares = (counts + SMOOTH * common) / (total + SMOOTH)
    weights = np.zeros((BUCKETS, codes.shape[1]), dtype=np.float32)
    for b in range(codes.shape[1]):
        plus, minus = shares[codes[:, b] > 0].mean(0), shares[codes[:, b] < 0].mean(0)
        weights[:, b] = np.log(plus) - np.log(minus)
    return names, codes, weights


def lettered(piece: Piece) -> np.ndarray:
    """Whether each row has a letter of any script."""
    ascii_letter = ((piece.data | 0x20) >= 97) & ((piece.data | 0x20) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[piece.ends[1:]] > total[piece.ends[:-1]]
    texts = piece.column("text")
    for i in np.flatnonzero(~out & (piece.ends[1:] > piece.ends[:-1])):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def margins(docs: DataFrame, weights: np.ndarray, keep: list[str], text_col: str) -> DataFrame:
    """The columns ``keep``, ``has_letter`` and ``margins``: mean weight per bit over the trigrams."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(weights), weights.shape[1]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            bucket, at = trigrams(piece)
            first = np.searchsorted(at, piece.ends)
            n = np.diff(first)
            sums = np.zeros((piece.n, bits))
            for b in range(bits):
                total = np.concatenate([[0.0], np.cumsum(shared.value[:, b][bucket], dtype=float)])
                sums[:, b] = total[first[1:]] - total[first[:-1]]
            mean = sums / np.maximum(n, 1)[:, None]
            flat = pa.array(mean.ravel())
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(f"k{i}") for i in range(len(keep))), pa.array(lettered(piece)),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(piece.n + 1, dtype=np.int32) * bits), flat)],
                [*(f"k{i}" for i in range(len(keep))), "has_letter", "margins"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "has_letter boolean",
                        "margins array<double>"])
    return (docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
                        F.col(text_col).alias("text"))
            .mapInArrow(score, schema)
            .withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)}))


def reliability(rows: DataFrame, names: list[str], codes: np.ndarray) -> np.ndarray:
    """Per language and bit, how often the classifier was right in training, above chance."""
    out = np.full(codes.shape, 1.0)
    right = rows.select("_lang", F.posexplode("margins").alias("bit", "margin")).groupBy(
        "_lang", "bit").agg(F.avg((F.col("margin") > 0).cast("double")).alias("plus"))
    at = {name: i for i, name in enumerate(names)}
    for r in right.collect():       # languages x bits rows
        code = codes[at[r["_lang"]], r["bit"]]
        share = r["plus"] if code > 0 else 1 - r["plus"]
        out[at[r["_lang"]], r["bit"]] = max(2 * share - 1, 0.01)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def decode(rows: DataFrame, names: list[str], codes: np.ndarray, trust: np.ndarray) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous``; drop the margins."""
    keep = [c for c in rows.columns if c not in ("has_letter", "margins")]

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            value = lambda c: batch.column(batch.schema.get_field_index(c))
            letter = value("has_letter").to_numpy(False).astype(bool)
            margin = value("margins").flatten().to_numpy(False).reshape(n, -1)
            if len(names) > 1:
                agreement = np.tanh(SHARPNESS * margin)[:, None, :] * codes[None]
                loss = (np.exp(-agreement) * trust[None]).sum(2)
                share = np.exp(-3 * (loss - loss.min(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                best, ranked = loss.argmin(1), np.sort(loss, 1)
                score, unsure = share[np.arange(n), best], ranked[:, 1] - ranked[:, 0] < AMBIGUOUS
                known = letter
            else:
                best, score = np.zeros(n, dtype=int), np.ones(n)
                unsure = np.zeros(n, dtype=bool)
                known = letter & bool(names)
            label = np.array([*names, "und"], dtype=object)
            yield pa.RecordBatch.from_arrays(
                [*(value(c) for c in keep),
                 pa.array(label[np.where(known, best, len(names))], pa.string()),
                 pa.array(np.where(known, score, 0.0)), pa.array(known & unsure)],
                [*keep, "lang_pred", "score", "ambiguous"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep),
                        "lang_pred string, score double, ambiguous boolean"])
    return rows.mapInArrow(choose, schema)


def held_out(doc_id: Column) -> Column:
    """One document in five, by a checksum of its id; a null id is held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """The columns ``keep`` with ``held_out``, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Training rows are those not held out with a language and a text. ``und``, with score 0, stands
    for a null text, a text without a letter, or no training row at all. Every row is judged by its
    text alone, so repeated rows get equal results. Texts are read twice: to count and to score.
    """
    learn = ~F.col("_held") & F.col("_lang").isNotNull()
    docs = docs.withColumn("_held", held_out(F.col(id_col))).withColumn(
        "_lang", F.col(lang_col).cast("string"))
    training = docs.filter(learn & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col("_lang").alias("lang"))
    names, codes, weights = fit(training)
    folder = scratch_dir(docs.sparkSession, "language")
    margins(docs, weights, [*keep, "_held", "_lang"], text_col).write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    trust = reliability(rows.filter(learn & F.col("has_letter")), names, codes) \
        if len(names) > 1 else np.ones(codes.shape)
    return decode(rows.drop("_lang").withColumnRenamed("_held", "held_out"), names, codes, trust)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = identify(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    return rows.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
