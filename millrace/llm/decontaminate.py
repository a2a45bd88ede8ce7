"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of a run of words and ignore the others, so a run hashes alike although
words at the ignored places were replaced. Hashes of documents meet those of benchmark items, and
around each hit the two word sequences are laid side by side and compared place by place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm.words import MARKS, STEP, Piece, U, folded, mix, pieces, signed
from millrace.session import scratch_dir

# Every pattern of replaced words that `compare` accepts leaves a place where one of the masks for the
# item's length meets equal words only (a test goes through all patterns). MASKS: LONG words or more.
LONG = 16
MASKS = ("11101111", "111010010011", "111100100000011", "110100001111", "1100101011001")
SHORT = {(12, 15): ("110111", "100000001111"), (10, 11): ("10111", "1000001011"), (7, 9): ("11011",),
         (5, 6): ("111", "1011")}
LEAST_WORDS = 5         # shorter items match nothing
WINDOW, AGREE = 20, 0.8  # places compared at least (or the whole item), and the share that must agree
# Items of up to so many text bytes go to every task; beyond, hashes meet in a shuffled join.
MOST_BROADCAST = 16 << 20
FILTER_BITS = 20

RESULT = "id {id}, item {item}, doc_word int, item_word int, compared int, agreed int"


def masks_for(lengths: Iterable[int]) -> list[tuple[np.ndarray, int, int]]:
    """(places selected, least, most words of the items it is for) of every mask that some length needs."""
    known = list(lengths)
    groups = [(LONG, np.iinfo(np.int64).max, MASKS), *((low, high, masks) for (low, high), masks in SHORT.items())]
    return [(np.flatnonzero([c == "1" for c in mask]), low, high) for low, high, masks in groups
            if any(low <= n <= high for n in known) for mask in masks]


def span_of(mask: np.ndarray) -> int:
    return int(mask[-1]) + 1


def seeds(words: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Hash of the selected words at each place where the mask fits."""
    n = len(words) - span_of(mask) + 1
    out = np.full(max(n, 0), U(sum(1 << int(at) for at in mask)))
    for j, at in enumerate(mask):
        out += words[at:at + len(out)] * STEP[j + 1]
    return mix(out)


def word_hashes(piece: Piece):
    words = piece.words(gaps=MARKS)
    return words, words.hashes(folded(piece.data))


class Items:
    """Benchmark items as word hashes end to end, with their seeds sorted by hash."""

    def __init__(self, table: pa.Table):
        names, hashes, counts = [], [], []
        for piece in pieces(table.to_batches()):
            words, values = word_hashes(piece)
            names += piece.column("item").to_pylist()
            hashes.append(values)
            counts.append(words.counts)
        self.names = names
        self.counts = np.concatenate([*counts, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.words = np.concatenate([*hashes, np.zeros(0, dtype=U)])
        self.masks = masks_for(self.counts.tolist())
        self.seeds = [self._sorted(*mask) for mask in self.masks]

    def _sorted(self, mask: np.ndarray, least: int, most: int):
        span = span_of(mask)
        values = seeds(self.words, mask)
        item = np.repeat(np.arange(len(self.counts)), self.counts)
        fits = np.zeros(len(values), dtype=bool)
        own = item[:len(values)]
        fits[:] = np.arange(len(values)) + span <= self.first[own + 1]
        fits &= (self.counts[own] >= least) & (self.counts[own] <= most)
        at = np.flatnonzero(fits)
        at = at[np.argsort(values[at], kind="stable")]
        present = np.zeros(1 << FILTER_BITS, dtype=bool)
        present[(values[at] >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        return values[at], at, present


def hits(items: Items, words: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct (row, item, shift) that share a seed: item word 0 lies at document word ``shift``."""
    found = []
    for (mask, _, _), (known, at, present) in zip(items.masks, items.seeds, strict=True):
        values = seeds(words, mask)
        if not len(known) or not len(values):
            continue
        maybe = np.flatnonzero(present[(values >> U(64 - FILTER_BITS)).astype(np.int64)])
        maybe = maybe[row[maybe] == row[maybe + span_of(mask) - 1]]
        low = np.searchsorted(known, values[maybe], side="left")
        many = np.searchsorted(known, values[maybe], side="right") - low
        where = np.repeat(maybe, many)
        within = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many)
        place = at[np.repeat(low, many) + within]
        item = np.searchsorted(items.first, place, side="right") - 1
        shift = (where - first[row[where]]) - (place - items.first[item])
        found.append(np.stack([row[where], item, shift], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)


def compare(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """(document word, item word, compared, agreed) of the best window laid at ``shift``, or None.

    A window is WINDOW places, or the whole item if shorter; it must lie in both texts.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    width = min(WINDOW, len(item))
    if high - low < width:
        return None
    same = np.concatenate([[0], np.cumsum(doc[low + shift:high + shift] == item[low:high])])
    agreed = same[width:] - same[:-width]
    best = int(agreed.argmax())
    if agreed[best] < AGREE * width:
        return None
    return low + best + shift, low + best, width, int(agreed[best])


def _rows(found: list[tuple], kinds: dict[str, str]) -> pa.RecordBatch:
    types = [None, None, pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = ["id", "item", "doc_word", "item_word", "compared", "agreed"]
    columns = list(zip(*found, strict=True)) or [[]] * len(names)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types[0], types[1] = (arrow.get(kinds[c]) for c in ("id", "item"))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def by_broadcast(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hits and comparison in one pass over the documents, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Items(items.toArrow()))
    kinds = dict(docs.dtypes) | dict(items.select("item").dtypes)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for piece in pieces(batches):
            words, values = word_hashes(piece)
            found, ids = [], piece.column("id")
            for r, i, shift in hits(known, values, words.row(), words.first):
                best = compare(values[words.first[r]:words.first[r + 1]],
                               known.words[known.first[i]:known.first[i + 1]], int(shift))
                if best:
                    found.append((ids[int(r)].as_py(), known.names[i], *best))
            if found:
                yield _rows(found, kinds)

    return docs.mapInArrow(search, RESULT.format(**kinds))


def seed_rows(texts: DataFrame, name: str, lengths: list[int], own: bool) -> DataFrame:
    """(name, seed, at) of every text; ``own``: only by the masks for the text's length."""
    masks, kind = masks_for(lengths), dict(texts.dtypes)[name]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words, values = word_hashes(piece)
            row = words.row()
            for mask, least, most in masks:
                hashed, span = seeds(values, mask), span_of(mask)
                at = np.flatnonzero(row[:len(hashed)] == row[span - 1:]) if len(hashed) else np.zeros(0, int)
                if own:
                    many = words.counts[row[at]]
                    at = at[(many >= least) & (many <= most)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(name).take(pa.array(row[at])), pa.array(signed(hashed[at])),
                     pa.array((at - words.first[row[at]]).astype(np.int32))], [name, "seed", "at"])

    return texts.select(name, "text").mapInArrow(cut, f"{name} {kind}, seed long, at int")


def by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for any number of items: seeds meet in a join, hits in a second one with the texts."""
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "seeds")
    lengths = list(range(LEAST_WORDS, LONG + 1))
    ours = seed_rows(items, "item", lengths, own=True).withColumnRenamed("at", "item_at").distinct()
    theirs = seed_rows(docs, "id", lengths, own=False)
    (theirs.join(ours, "seed").select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
     .groupBy("id", "item").agg(F.collect_list("shift").alias("shifts")).write.parquet(folder))
    pairs = (spark.read.parquet(folder).withColumnsRenamed({"id": "hit", "item": "hit_item"})
             .join(docs.withColumnRenamed("text", "doc_text"), F.col("hit").eqNullSafe(F.col("id"))).drop("hit")
             .join(items.withColumnRenamed("text", "item_text"), F.col("hit_item").eqNullSafe(F.col("item"))))
    kinds = dict(pairs.dtypes)

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                (a, doc), (b, item) = (word_hashes(Piece(one, t)) for t in ("doc_text", "item_text"))
                row = one.to_pylist()[0]
                found = [(row["id"], row["item"], *best) for best in
                         (compare(doc, item, s) for s in row["shifts"]) if best]
                if found:
                    yield _rows(found, kinds)

    return pairs.select("id", "item", "shifts", "doc_text", "item_text").mapInArrow(
        check, RESULT.format(**kinds))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text",
             most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row (id, item, doc_word, item_word, compared, agreed) per document id and item that overlap.

    Words are lower-cased runs of letters, digits and non-ASCII characters. The row tells the first
    best window: where it starts in both (words from 0), its width and how many places agree. Null
    or empty texts and items below LEAST_WORDS overlap with nothing; rows that share an id are
    searched one by one and give one row per item.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter(
        "text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = by_broadcast(texts, items) if size <= most_broadcast else by_join(texts, items)
    best = F.struct("agreed", -F.col("doc_word"), -F.col("item_word"), "compared")
    return (found.groupBy("id", "item").agg(F.max(best).alias("b"))
            .select("id", "item", (-F.col("b.col2")).alias("doc_word"), (-F.col("b.col3")).alias("item_word"),
                    "b.compared", "b.agreed"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    rows = overlaps(spark.read.parquet(f"{folder}/documents.parquet"),
                    spark.read.parquet(f"{folder}/benchmark.parquet"))
    return rows.withColumnsRenamed({"id": "doc_id", "item": "item_id"})
