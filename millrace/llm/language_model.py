"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

    P(word | history) = P(class | history) * P(word | class, history)

Both factors are softmaxes over sums of weights that the history's features pick from hashed tables:
the word before (bigram), the two before (trigram), and the second and third before by themselves
(skips). The commonest words and the end of a text have places of their own in classes by frequency.
All other words are one class; within it a word has its share by training count, a word never seen
that of a tenth of an occurrence, so the probabilities of all words sum to one.

Training takes disjoint rounds that together hold every training text once. In each, tasks sum the
gradient over their texts from the shared weights, whole numbers of sixty-fourths so that the sum
does not depend on its order, and the driver, which holds the bounded tables, makes one step.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.words import BASE, BYTE, LOWER, Piece, mix, pieces, powers, span_hash, sum_by_row
from millrace.session import scratch_dir

HELD = 400_000              # distinct words that a counting task holds
MOST_WORDS = 1 << 18        # words whose counts are sent to every task; the others meet theirs in a join
MOST_BYTES = 64             # longer words are never sent
PIECE = 1 << 22             # text bytes encoded at a time

CLASSES = 16                # class 0: all words without a place of their own
PLACES = 32                 # words of each other class
OWN = (CLASSES - 1) * PLACES    # codes with a place; 0 is the end of a text, and what stands before its start
CODES = 4096                # codes from OWN on are hashes of the other words
PAIRS = 1 << 14             # hashed places for two words before, and for a word before with a class
CLASS_ROWS = 3 * CODES + PAIRS
WORD_ROWS = 2 * PAIRS
ROUNDS = 6
STEP = 0.3
EASE = 4.0                  # occurrences below which a step is held back
FURTHEST = 2.0              # a weight's longest step
BLOCK = 1 << 16             # tokens scored at a time
UNITS = 64                  # parts of one that gradients count in
SLICE = 1 << 15             # numbers of a gradient that travel as one row


def tokens(piece: Piece) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, distinct words, first word of each row): words lower-cased in A-Z."""
    words = piece.words()
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    body = LOWER[piece.data[words.inside]]
    column = pa.Array.from_buffers(pa.large_string(), len(words.starts),
                                   [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, words.first


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows (text), summed within each task and then over tasks."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("c", "sum")]).select(
            ["word", "c_sum"]).rename_columns(["word", "c"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for piece in pieces(batches, budget=PIECE):
            code, words, _ = tokens(piece)
            held.append(pa.table({"word": words.cast(pa.string()), "c": np.bincount(code, minlength=len(words))}))
            if sum(map(len, held)) > 2 * HELD:
                held = [summed(held)]
                if len(held[0]) > HELD:
                    yield from held[0].to_batches(1 << 16)
                    held = []
        if held:
            yield from summed(held).to_batches(1 << 16)

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The commonest training words with their counts, commonest first; bounded, sent to every task."""

    def __init__(self, counts: DataFrame, texts: int):
        level = F.floor(F.log2("c") * 8)
        short = counts.filter(F.octet_length("word") <= MOST_BYTES)
        rows = sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
        taken, least = 0, None
        for r in rows:      # at most 8 x 63 levels
            taken += r["count"]
            if taken > MOST_WORDS:
                break
            least = r["level"]
        found = short.filter(level >= least).toArrow() if least is not None else \
            pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
        order = pc.sort_indices(found, [("c", "descending"), ("word", "ascending")])
        found = found.take(order).combine_chunks()
        self.words, self.counts = found["word"].combine_chunks().cast(pa.string()), found["c"].to_numpy()
        total = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
        self.texts = texts
        self.n, self.v = (total["n"] or 0) + texts, total["v"] + (texts > 0)
        own = self.counts[:OWN - 1]
        self.rare_n, self.rare_v = self.n - texts - int(own.sum()), self.v - (texts > 0) - len(own)

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code, count) of each word; the count of a word that is not held is -1."""
        place = pc.index_in(words.cast(pa.string()), value_set=self.words).fill_null(-1).to_numpy() \
            if len(self.words) else np.full(len(words), -1)
        count = np.where(place >= 0, self.counts[place] if len(self.counts) else -1, -1)
        spread = OWN + (string_hashes(words) % np.uint64(CODES - OWN)).astype(np.int64)
        return np.where((place >= 0) & (place < OWN - 1), place + 1, spread), count

    def prior(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the classes, and of the words in each class; a place without a word has next to none."""
        held = np.full(OWN, 1e-9)
        held[:1 + len(self.counts[:OWN - 1])] = [max(self.texts, 1e-9), *self.counts[:OWN - 1]]
        held = held.reshape(CLASSES - 1, PLACES)
        classes = np.concatenate([[self.rare_n], held.sum(1)]) + 0.5
        return classes / classes.sum(), held / held.sum(1, keepdims=True)


def string_hashes(words: pa.Array) -> np.ndarray:
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1] \
        if len(words) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=sums[1:])
    return span_hash(sums, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


ENCODED = ("n_tokens long, n_known long, n_rare long, base double, rare double, codes binary, "
           "rest array<struct<word:string,n:long>>")


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns but ``text``, with each text's codes, what its held words add, and its other words
    with their numbers.

    ``base`` and ``rare`` are sums of log10(c + 0.1), over all held words and over those of class 0.
    """
    shared, keep = docs.sparkSession.sparkContext.broadcast(vocabulary), [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        end = math.log10(known.texts + 0.1)
        for piece in pieces(batches, budget=PIECE):
            unique, words, first = tokens(piece)
            code, count = known.codes(words)
            held = count >= 0
            logs = np.where(held, np.log10(np.maximum(count, 0) + 0.1), 0.0)
            n = np.diff(first)
            row = np.repeat(np.arange(piece.n), n)
            total = lambda values: np.bincount(row, values[unique], piece.n).astype(float)
            out = np.zeros(len(unique) + piece.n, dtype=np.uint16)
            out[np.arange(len(unique)) + row] = code[unique]
            ends = np.concatenate([[0], np.cumsum(2 * (n + 1))]).astype(np.int32)
            open_ = ~held[unique]
            pair, many = np.unique(row[open_] * max(len(words), 1) + unique[open_], return_counts=True)
            lists = np.searchsorted(pair // max(len(words), 1), np.arange(piece.n + 1)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(
                [words.take(pa.array(pair % max(len(words), 1))).cast(pa.string()), pa.array(many.astype(np.int64))], ["word", "n"]))
            whole = lambda x: pa.array(np.rint(x).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in keep), pa.array((n + 1).astype(np.int64)),
                 whole(total(held.astype(float)) + (known.texts > 0)), whole(total((code >= OWN).astype(float))),
                 pa.array(total(logs) + end), pa.array(total(np.where(code >= OWN, logs, 0.0))),
                 pa.Array.from_buffers(pa.binary(), piece.n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())]),
                 rest],
                [*keep, "n_tokens", "n_known", "n_rare", "base", "rare", "codes", "rest"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), ENCODED]))


class Model:
    """Weights of both softmaxes; every method takes arrays of tokens."""

    def __init__(self, classes: np.ndarray, places: np.ndarray):
        self.class_prior, self.place_prior = classes, places
        self.class_bias = np.log(classes).astype(np.float32)
        self.place_bias = np.log(places).astype(np.float32)
        self.class_weights = np.zeros((CLASS_ROWS, CLASSES), dtype=np.float32)
        self.place_weights = np.zeros((WORD_ROWS, PLACES), dtype=np.float32)

    @staticmethod
    def targets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place): a code beyond OWN is of class 0."""
        own = codes < OWN
        return np.where(own, codes // PLACES + 1, 0), codes % PLACES

    @staticmethod
    def history(codes: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """The first, second and third code before each, 0 before a text's start; ``place`` counts in the text."""
        out = []
        for k in (1, 2, 3):
            before = np.zeros_like(codes)
            before[k:] = codes[:-k]
            before[place < k] = 0
            out.append(before)
        return out

    @staticmethod
    def class_features(before: list[np.ndarray]) -> list[np.ndarray]:
        a, b, c = before
        pair = mix((a * CODES + b).astype(np.uint64) + np.uint64(1)) % np.uint64(PAIRS)
        return [a, CODES + b, 2 * CODES + c, 3 * CODES + pair.astype(np.int64)]

    @staticmethod
    def place_features(before: list[np.ndarray], of: np.ndarray) -> list[np.ndarray]:
        hashed = lambda x: (mix((x * CLASSES + of).astype(np.uint64) + np.uint64(7)) % np.uint64(PAIRS)).astype(np.int64)
        return [hashed(before[0]), PAIRS + hashed(before[1])]

    def shares(self, codes: np.ndarray, before: list[np.ndarray]):
        """What both softmaxes give: (classes, their features, shares), then the same of the places of
        tokens with one, led by their positions."""
        of, place = self.targets(codes)
        features = self.class_features(before)
        p = softmax(self.class_bias, self.class_weights, features)
        own = np.flatnonzero(of)
        inner = self.place_features([x[own] for x in before], of[own])
        return (of, features, p), (own, place[own], inner, softmax(self.place_bias[of[own] - 1], self.place_weights, inner))

    def log10(self, codes: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        (of, _, p), (own, place, _, q) = self.shares(codes, before)
        out = np.log10(p[np.arange(len(of)), of].astype(float))
        out[own] += np.log10(q[np.arange(len(own)), place].astype(float))
        return out

    def gradient(self, codes: np.ndarray, before: list[np.ndarray], sums: "Sums") -> None:
        (of, features, p), (own, place, inner, q) = self.shares(codes, before)
        p *= -1
        p[np.arange(len(of)), of] += 1
        q *= -1
        q[np.arange(len(own)), place] += 1
        for f in features:
            sums.add(sums.classes, f, p)
        for f in inner:
            sums.add(sums.places, f, q)

    def step(self, sums: "Sums") -> None:
        """Move every weight by its gradient over the information expected of its feature's occurrences."""
        inner = self.place_prior.mean(0)
        for weights, g, share in ((self.class_weights, sums.classes, self.class_prior), (self.place_weights, sums.places, inner)):
            information = g[:, -1:] * (share * (1 - share))[None] + EASE
            weights += np.clip(STEP * g[:, :-1] / information, -FURTHEST, FURTHEST).astype(np.float32)


def softmax(bias: np.ndarray, weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    x = weights[features[0]] + bias
    for f in features[1:]:
        x += weights[f]
    x -= x.max(1, keepdims=True) if len(x) else 0
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


class Sums:
    """Gradients of both tables; the last column counts the feature's occurrences."""

    def __init__(self):
        self.classes = np.zeros((CLASS_ROWS, CLASSES + 1))
        self.places = np.zeros((WORD_ROWS, PLACES + 1))

    @staticmethod
    def add(table: np.ndarray, feature: np.ndarray, parts: np.ndarray) -> None:
        if not len(feature):
            return
        order = np.argsort(feature.astype(np.uint16), kind="stable")    # tables have fewer than 2 ** 16 rows
        ranked = feature[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        table[ranked[starts], :-1] += np.add.reduceat(parts[order], starts, axis=0)
        table[ranked[starts], -1] += np.diff(np.append(starts, len(ranked)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.classes.ravel(), self.places.ravel()])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Sums":
        out = cls()
        out.classes[:] = flat[:out.classes.size].reshape(out.classes.shape)
        out.places[:] = flat[out.classes.size:].reshape(out.places.shape)
        return out


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(codes, the row of each, histories) of a batch, at most BLOCK tokens at a time."""
    column = batch.column(batch.schema.get_field_index("codes")).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    every = np.frombuffer(column.buffers()[2], dtype=np.uint16)[offsets[0] // 2:offsets[-1] // 2]
    first = (offsets - offsets[0]) // 2
    for at in range(0, len(every), BLOCK):
        to, back = min(at + BLOCK, len(every)), min(at, 3)      # histories reach three codes back
        row = np.searchsorted(first, np.arange(at - back, to), side="right") - 1
        codes = every[at - back:to].astype(np.int64)
        before = Model.history(codes, np.arange(at - back, to) - first[row])
        yield codes[back:], row[back:], [x[back:] for x in before]


def summed_gradient(texts: DataFrame, model: Model) -> Sums:
    """The gradient over all rows (codes): per task, then by slices over tasks, at last on the driver."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_ = Sums(), False
        for batch in batches:
            for codes, _, before in blocks(batch):
                shared.value.gradient(codes, before, sums)
                any_ = True
        if any_:
            flat = np.rint(sums.flat() * UNITS).astype(np.int32)
            parts = [flat[i:i + SLICE].tobytes() for i in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["slice", "part"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, part in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                held[number] = held.get(number, 0) + np.frombuffer(part, dtype=np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
                                         ["slice", "part"])

    found = (texts.select("codes").mapInArrow(run, "slice int, part binary").repartition("slice")
             .mapInArrow(add, "slice int, part binary").toArrow())
    flat = np.zeros(Sums().flat().size)
    for number, part in zip(found["slice"].to_pylist(), found["part"].to_pylist(), strict=True):
        own = np.frombuffer(part, dtype=np.int64)
        flat[number * SLICE:number * SLICE + len(own)] = own / UNITS
    shared.unpersist()
    return Sums.of(flat)


KEPT = ("row", "doc_id", "held_out", "n_tokens", "n_known", "n_rare", "base", "rare")


def scored(encoded: DataFrame, model: Model) -> DataFrame:
    """The columns KEPT and ``model``: the sum of log10 probabilities, a word of class 0 by its class alone."""
    shared, kinds = encoded.sparkSession.sparkContext.broadcast(model), dict(encoded.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for codes, row, before in blocks(batch):
                total += np.bincount(row, shared.value.log10(codes, before), batch.num_rows)
            own = [batch.column(batch.schema.get_field_index(c)) for c in KEPT]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total)], [*KEPT, "model"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in KEPT), "model double"])
    return encoded.select(*KEPT, "codes").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """One document in ten, by a checksum of its id; a null id is held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end per text; a null text is
    empty, so it has the end alone. ``base_score`` is the smoothed unigram log10 probability from exact
    counts of all training words, ``score`` the model's. Rows with a held-out or null id train nothing.
    Without training rows every word gets the same share. Equal texts get equal scores; a repeated row
    trains as often as it stands. Other columns are ignored. Counts of words beyond the commonest
    MOST_WORDS reach their texts in a join, so no document's words are cut.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "language-model")

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    held = held_out(F.col(id_col))
    counts = kept(count_words(docs.filter(~held).select(text)), "counts")
    vocabulary = Vocabulary(counts, docs.filter(~held).count())
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text,
                       F.monotonically_increasing_id().alias("row")).withColumn(
        "part", F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("row"), F.lit(rounds))).cast("int"))
    texts = encode(rows, vocabulary)
    texts.write.partitionBy("part").parquet(f"{folder}/encoded")     # a round reads its own folder
    encoded = spark.read.schema(texts.schema).parquet(f"{folder}/encoded")
    model = Model(*vocabulary.prior())
    for part in range(rounds):
        model.step(summed_gradient(encoded.filter(F.col("part") == part), model))
    sums = (encoded.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n")
            .join(counts, "word", "left").groupBy("row").agg(
                F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
                F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more")))
    of_words = F.lit(vocabulary.n + 0.1 * (vocabulary.v + 1))
    of_rare = F.lit(vocabulary.rare_n + 0.1 * (vocabulary.rare_v + 1))
    more = F.coalesce("more", F.lit(0.0))
    return (scored(encoded, model).join(sums, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(vocabulary.n).cast("long").alias("train_tokens"),
                    (F.col("base") + more - F.col("n_tokens") * F.log10(of_words)).alias("base_score"),
                    (F.col("model") + F.col("rare") + more - F.col("n_rare") * F.log10(of_rare)).alias("score")))


def op12_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{folder}/documents.parquet"))
