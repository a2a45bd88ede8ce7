"""Hard-negative mining by a vertical scan of columnar blocks (BOND).

Vectors are cut into blocks of rows that lie column by column, each with the least and greatest value
of every dimension. An anchor visits every block once per question, in the block's task. It reads the
block's dimensions in order of its own descending magnitude; after each few, a row's score lies
between its partial product plus the least and plus the greatest that the remaining dimensions can
add. Rows whose bounds cannot reach the answer leave the candidate bitmap; the rest are scored in full.

The first question finds an anchor's positives: the best rows of its label. The second finds, for
each positive's score window, the best rows of other labels within it. Every block returns at most
``k`` rows an anchor and window, which one ranking over all blocks merges.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from millrace.session import scratch_dir

SCALE = 256
LARGEST = (1 << 24) - 1     # quantised components saturate here, so products stay within a long
BLOCK = 1 << 16             # rows of a block at most, about
STEPS = (16, 16, 16)        # dimensions read between two looks at the bitmap; then all that are left
NO_ID = np.iinfo(np.int64).max      # a null id comes after all others


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component as double, saturated at LARGEST."""
    one = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(float(SCALE)) * x.cast("double"))))
    return F.transform(vector, lambda x: one(x).cast("int"))


def usable(vector: Column, label: Column) -> Column:
    """No null label or vector, no null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return vector.isNotNull() & label.isNotNull() & F.forall(vector, lambda x: fine(x.cast("double")))


def relabelled(vec_id: Column, label: Column) -> Column:
    """The label of the mining task: where the id is divisible by 7, the next of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


class Block:
    """Rows of one block, label by label, ids ascending within a label; one line per dimension."""

    def __init__(self, rows: pa.Table):
        self.row, self.label = rows["row"].to_numpy(), rows["label"].to_numpy()
        self.ids = rows["vec_id"].fill_null(NO_ID).to_numpy()
        order = np.lexsort((self.row, self.ids, self.label))
        self.row, self.label, self.ids = self.row[order], self.label[order], self.ids[order]
        vectors = rows["vector"].combine_chunks()
        ends = vectors.offsets.to_numpy()
        lengths, flat = np.diff(ends), vectors.values.to_numpy()
        self.dims = int(lengths.max(initial=0))
        wide = np.zeros((len(self.row), self.dims), dtype=np.int64)     # shorter vectors end in zeros
        wide[np.arange(self.dims)[None, :] < lengths[:, None]] = flat[ends[0]:ends[-1]]
        wide = wide[order]
        self.low = wide.min(0, initial=0) if not len(wide) else wide.min(0)
        self.high = wide.max(0, initial=0) if not len(wide) else wide.max(0)
        self.reach = np.maximum(np.abs(self.low), np.abs(self.high))
        self.lines = np.ascontiguousarray(wide.T)
        self.typed = {np.dtype(np.int64): self.lines}

    def span(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))

    def as_type(self, anchor: np.ndarray) -> np.dtype:
        """The fastest number type in which products with this anchor are exact."""
        most = int((np.abs(anchor) * self.reach).sum())
        return np.dtype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)

    def matrix(self, kind: np.dtype) -> np.ndarray:
        if kind not in self.typed:
            self.typed[kind] = self.lines.astype(kind)
        return self.typed[kind]


class Scan:
    """One anchor's pass through a block: candidates and their partial products."""

    def __init__(self, block: Block, vector: np.ndarray, spans: list[slice]):
        """Only rows in ``spans`` are candidates."""
        anchor = np.zeros(block.dims, dtype=np.int64)
        anchor[:min(len(vector), block.dims)] = vector[:block.dims]
        kind = block.as_type(anchor)
        order = np.argsort(-np.abs(anchor), kind="stable")
        a, b = anchor[order] * block.low[order], anchor[order] * block.high[order]
        left = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
        self.least, self.most = left(np.minimum(a, b)), left(np.maximum(a, b))
        self.block, self.lines, self.order = block, block.matrix(kind), order
        self.weights, self.at = anchor.astype(kind)[order], 0
        self.rows: np.ndarray | None = None         # None: all of the spans
        self.spans = [s for s in spans if s.stop > s.start]
        self.part = np.zeros(sum(s.stop - s.start for s in self.spans), dtype=kind)

    def read(self, n: int) -> None:
        """Add the next n dimensions to the candidates' partial products."""
        dims, w = self.order[self.at:self.at + n], self.weights[self.at:self.at + n]
        if self.rows is not None:
            self.part += w @ self.lines[np.ix_(dims, self.rows)]
        else:
            to = 0
            for s in self.spans:
                self.part[to:to + s.stop - s.start] += w @ self.lines[dims, s]
                to += s.stop - s.start
        self.at += len(dims)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.part + self.part.dtype.type(self.least[self.at]), \
            self.part + self.part.dtype.type(self.most[self.at])

    def keep(self, bitmap: np.ndarray) -> None:
        if not bitmap.all():
            self.rows, self.part = self.candidates()[bitmap], self.part[bitmap]

    def candidates(self) -> np.ndarray:
        return self.rows if self.rows is not None else np.concatenate(
            [np.arange(s.start, s.stop) for s in self.spans] or [np.zeros(0, dtype=np.int64)])

    def steps(self) -> Iterator[None]:
        """Read step by step; between two, the caller thins the candidates."""
        yield
        for n in (*STEPS, len(self.order)):
            if self.at >= len(self.order) or not len(self.part):
                return
            self.read(n)
            yield

    def scored(self) -> tuple[np.ndarray, np.ndarray]:
        return self.candidates(), self.part.astype(np.int64)


def kth_largest(values: np.ndarray, k: int) -> float | None:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def first(block: Block, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by score, then id."""
    least = kth_largest(scores, k)
    if least is not None:
        near = scores >= least
        rows, scores = rows[near], scores[near]
    order = np.lexsort((block.row[rows], block.ids[rows], -scores))[:k]
    return rows[order], scores[order]


def positives(block: Block, anchor_row: int, label: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores): the block's first k rows of the anchor's label, but the anchor itself."""
    scan = Scan(block, vector, [block.span(label)])
    for _ in scan.steps():
        low, high = scan.bounds()
        bar = kth_largest(low, k + 1)       # the anchor itself may be one of them
        if bar is not None:
            scan.keep(high >= bar)
    rows, scores = scan.scored()
    other = block.row[rows] != anchor_row
    return first(block, rows[other], scores[other], k)


def negatives(block: Block, label: int, vector: np.ndarray, tops: np.ndarray, percent: int,
              k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(which positive score, rows, scores): the block's first k rows of other labels in each window.

    The window of a positive score p holds the scores s with percent * p <= 100 * s <= 100 * p.
    """
    own = block.span(label)
    scan = Scan(block, vector, [slice(0, own.start), slice(own.stop, len(block.row))])
    windows = [(-(-percent * int(p) // 100), int(p)) for p in tops]
    for _ in scan.steps():
        low, high = scan.bounds()
        wanted = np.zeros(len(low), dtype=bool)
        for least, most in set(windows):
            possible = (high >= least) & (low <= most)
            bar = kth_largest(low[possible & (low >= least) & (high <= most)], k)
            wanted |= possible if bar is None else possible & (high >= bar)
        scan.keep(wanted)
    rows, scores = scan.scored()
    for which, (least, most) in enumerate(windows):
        inside = (scores >= least) & (scores <= most)
        if inside.any():
            yield which, *first(block, rows[inside], scores[inside], k)


def visits(blocks: DataFrame, anchors: DataFrame, ask, schema: str) -> DataFrame:
    """``ask(block, anchor)`` of every anchor at every block; it yields tuples of ``schema``.

    Rows and anchors of a block arrive in one sorted stream, rows first, so a task holds one block and
    one batch of anchors, however many there are.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own, asks = table["block"].to_numpy(), table["tops"].is_valid().to_numpy()
            edges = np.flatnonzero(np.diff(own) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            found: list[tuple] = []
            for start, stop in zip([0, *edges], [*edges, len(own)], strict=True):
                if own[start] != number:
                    number, held, block = own[start], [], None
                if not asks[start]:
                    held.append(table.slice(start, stop - start))
                    continue
                if not held:        # anchors of a block that got no row
                    continue
                block = block or Block(pa.concat_tables(held))
                for anchor in table.slice(start, stop - start).select(["row", "label", "vector", "tops"]).to_pylist():
                    found += ask(block, anchor)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    both = blocks.withColumn("tops", F.lit(None).cast("array<long>")).unionByName(anchors)
    parts = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                both.sparkSession.sparkContext.defaultParallelism)
    return both.repartition(parts, "block").sortWithinPartitions(
        "block", F.col("tops").isNotNull()).mapInArrow(run, schema)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
         anchor: Column | None = None, k: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), and the rows' numbers.

    ``anchor`` says which rows are anchors (default: ids divisible by 100), ``label`` is the label to use
    (default: the column ``label``). Rows with a null label or vector or a null or non-finite component
    take no part. Scores are integer products of ``floor(256 * x)``; components of 65,536 or more in
    magnitude saturate; of vectors of unequal lengths, the shorter ends in zeros. Higher scores come
    first, then smaller ids, a null id last. Repeated rows are rows of their own: each may be an
    anchor, a positive and a negative. Fewer than k rows give as many as there are; a positive with
    nothing in its window, or of negative score, gives none. Other columns are ignored.
    """
    spark, folder = vectors.sparkSession, scratch_dir(vectors.sparkSession, "vectors")
    vec_id = F.col(id_col).cast("long")
    label = F.col("label") if label is None else label
    anchor = vec_id % 100 == 0 if anchor is None else anchor
    (vectors.filter(usable(F.col(vector_col), label))
     .select(vec_id.alias("vec_id"), label.cast("long").alias("label"), quantised(F.col(vector_col)).alias("vector"),
             F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"))
     .write.parquet(f"{folder}/rows"))
    rows = spark.read.parquet(f"{folder}/rows")
    n_blocks = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / BLOCK))
    blocks = rows.select(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"), "row", "vec_id", "label", "vector")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")

    def asking(anchors: DataFrame) -> DataFrame:
        return anchors.select(everywhere, "row", "vec_id", "label", "vector", "tops")

    def ask_positives(block: Block, a: dict) -> list[tuple]:
        found = positives(block, a["row"], a["label"], np.array(a["vector"], dtype=np.int64), k)
        return [(a["row"], int(block.row[r]), int(block.ids[r]), int(s)) for r, s in zip(*found, strict=True)]

    def ask_negatives(block: Block, a: dict) -> list[tuple]:
        found = negatives(block, a["label"], np.array(a["vector"], dtype=np.int64), np.array(a["tops"]), percent, k)
        return [(a["row"], which, int(block.row[r]), int(block.ids[r]), int(s))
                for which, own, scores in found for r, s in zip(own, scores, strict=True)]

    best = [F.col("score").desc(), F.col("other_id"), F.col("other")]
    anchors = rows.filter("anchor")
    (visits(blocks, asking(anchors.withColumn("tops", F.array().cast("array<long>"))), ask_positives,
            "row long, other long, other_id long, score long")
     .withColumn("place", F.row_number().over(W.partitionBy("row").orderBy(*best))).filter(F.col("place") <= k)
     .write.parquet(f"{folder}/positives"))
    found = spark.read.parquet(f"{folder}/positives")
    tops = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))),
                                                lambda x: x["score"]).alias("tops"))
    ranked = (visits(blocks, asking(anchors.join(tops, "row")), ask_negatives,
                     "row long, which int, other long, other_id long, score long")
              .withColumn("rank", F.row_number().over(W.partitionBy("row", "which").orderBy(*best)))
              .filter(F.col("rank") <= k))
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    of = found.select(F.col("row"), (F.col("place") - 1).alias("which"), name("other_id").alias("positive_id"),
                      F.col("other").alias("positive_row"), F.col("score").alias("positive_score"))
    return (ranked.join(of, ["row", "which"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", name("other_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score"), F.col("row").alias("anchor_row"), "positive_row",
                    F.col("other").alias("negative_row")))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    mined = mine(vectors, label=relabelled(F.col("vec_id"), F.col("label")))
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP11_SQL = """
with usable as (
  select row_number() over () as r, vec_id,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from usable where vec_id % 100 = 0),
scored as (
  select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id as other_id, a.label = b.label as same,
         list_inner_product(a.v, b.v)::bigint as score
  from anchors a join usable b on a.r <> b.r),
positives as (
  select * from scored where same
  qualify row_number() over (partition by ar order by score desc, other_id nulls last, br) <= 5),
ranked as (
  select p.anchor_id, p.other_id as positive_id, n.other_id as negative_id, p.score as positive_score,
         n.score as negative_score,
         row_number() over (partition by p.ar, p.br order by n.score desc, n.other_id nulls last, n.br) as rank
  from positives p join scored n
    on n.ar = p.ar and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
from ranked where rank <= 5
"""
