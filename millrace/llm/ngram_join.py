"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

Documents with equal n-gram sets form a class, and classes are the rows of the matrix. N-grams are
put into one order for all, frequent ones last. The first block of columns holds each row's first
n-grams, so many that two rows above the threshold must share one. Its product counts overlaps per
pair of rows, and a pair is discarded once its count and all it could still gain stay below what
the two sizes demand. Rows connected by what is left are multiplied in full, in tiles of bounded
size, block of columns by block of columns, and linked where the threshold is met.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.graphs import components
from millrace.llm.runs import changes, numbers, whole_groups
from millrace.llm.words import LOWER, U, mix, pieces, shingles, signed
from millrace.session import scratch_dir

WORDS, PERCENT = 4, 85
# The order of n-grams only decides how much work there is, not the result. Frequent n-grams come
# last; which ones are is counted over all documents, in first blocks REACH times as long, and the
# MOST_FREQUENT of them are known to every task.
REACH, MOST_FREQUENT = 2, 1 << 20
LIST = 64               # an n-gram with more rows ties them to one of them, to meet in tiles
TILE = 1000             # rows of a block; a tile is two blocks
COLUMNS = 4096          # columns multiplied at a time
DEALT = 1 << 18         # n-grams that go to tiles in one batch, about


def prefix_size(n, percent: int):
    """N-grams of a set of n, of which one must be shared to reach the threshold."""
    return n - (percent * n + 99) // 100 + 1


def needed(a, b, percent: int):
    """Least overlap of sets of a and b: 100 x overlap >= percent x union."""
    return -(-percent * (a + b) // (100 + percent))


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit sums) of each row's set; equal sets have equal ones."""
    size = np.bincount(rows, minlength=n).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    out = [size]
    for seed in (U(0x51ED270B), U(0x9E3779B9)):
        total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(mix(hashes + seed))])
        out.append(total[first[1:]] - total[first[:-1]])
    return tuple(out)


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """(id, name, n, sa, sb) per document: the size and the signature of its set."""
    kind = dict(docs.dtypes)["id"]

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = piece.words()
            size, sa, sb = signatures(*shingles(found, found.hashes(LOWER[piece.data]), words), piece.n)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("name"), pa.array(size), pa.array(signed(sa)), pa.array(signed(sb))],
                ["id", "name", "n", "sa", "sb"])

    return docs.mapInArrow(measure, f"id {kind}, name long, n long, sa long, sb long")


def frequent_ngrams(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """The n-grams in more than LIST rows of first blocks, rarest first: at most MOST_FREQUENT numbers."""
    rows = (postings(docs, np.zeros(0, dtype=U), words, percent, REACH).groupBy("gram")
            .agg(F.count("*").alias("n")).filter(F.col("n") > LIST)
            .orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).toArrow())
    return rows["gram"].to_numpy().view(U)[::-1].copy()


def postings(docs: DataFrame, frequent: np.ndarray, words: int, percent: int, reach: int = 1) -> DataFrame:
    """(gram, sa, sb, n): the first block of columns, once per class and task."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int64)))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        seen: set[tuple[int, int]] = set()
        for piece in pieces(batches):
            found = piece.words()
            rows, hashes = shingles(found, found.hashes(LOWER[piece.data]), words)
            size, sa, sb = signatures(rows, hashes, piece.n)
            new = np.zeros(piece.n, dtype=bool)
            for i, key in enumerate(zip(sa.tolist(), sb.tolist(), strict=True)):
                if size[i] and key not in seen:
                    seen.add(key)
                    new[i] = True
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                late = np.where(known[at] == hashes, rank[at] + 1, 0)
                if late.any():
                    by = np.lexsort((hashes, late, rows))
                    rows, hashes = rows[by], hashes[by]
            first = np.concatenate([[0], np.cumsum(size)])
            place = np.arange(len(rows)) - first[rows]
            keep = new[rows] & (place < reach * prefix_size(size, percent)[rows])
            own = rows[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(hashes[keep])), pa.array(signed(sa)[own]), pa.array(signed(sb)[own]),
                 pa.array(size[own])], ["gram", "sa", "sb", "n"])

    return docs.select("text").mapInArrow(cut, "gram long, sa long, sb long, n long")


PAIR = ["aa", "ab", "an", "ba", "bb", "bn", "tied"]


def first_block(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (aa, ab, an, ba, bb, bn, tied) of classes that share an n-gram of the first block.

    An n-gram's rows arrive sorted, run by run. Up to LIST of them give all their pairs of fitting
    size; of a longer run only the first row is held, and the others are tied to it.
    """

    def pair(x: np.ndarray, y: np.ndarray, rows: np.ndarray, tied: bool) -> pa.RecordBatch:
        """rows: (sa, sb, n) per line; x, y: lines, in ascending order of (sa, sb)."""
        return pa.RecordBatch.from_arrays(
            [*(pa.array(rows[x, j]) for j in range(3)), *(pa.array(rows[y, j]) for j in range(3)),
             pa.array(np.full(len(x), tied))], PAIR)

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), dtype=np.int64)
        open_run = None             # (gram, its first row) of a run too long to hold
        for batch in batches:
            rows = np.stack([numbers(batch, c) for c in ("gram", "sa", "sb", "n")], 1)
            if open_run is not None:
                more = rows[:, 0] == open_run[0]
                if more.any():
                    lines = np.concatenate([open_run[1][None], rows[more][:, 1:]])
                    yield pair(np.zeros(len(lines) - 1, dtype=int), np.arange(1, len(lines)), lines, True)
                rows = rows[~more]
                if len(rows):
                    open_run = None
            rows = np.concatenate([held, rows])
            rows = rows[changes(rows[:, 0], rows[:, 1], rows[:, 2])] if len(rows) else rows
            if not len(rows):
                held = rows
                continue
            starts = np.flatnonzero(changes(rows[:, 0]))
            last = starts[-1]
            yield from runs(rows[:last], starts[:-1])
            held = rows[last:]
            if len(held) > LIST:
                yield pair(np.zeros(len(held) - 1, dtype=int), np.arange(1, len(held)), held[:, 1:], True)
                open_run, held = (held[0, 0], held[0, 1:]), held[:0]
        if len(held):
            yield from runs(held, np.zeros(1, dtype=int))

    def runs(rows: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], len(rows))
        size = ends - starts
        for m in np.unique(size[(size > 1) & (size <= LIST)]):      # all runs of one length together
            x, y = np.triu_indices(m, 1)
            begin = starts[size == m][:, None]
            x, y = (begin + x).ravel(), (begin + y).ravel()
            small, large = np.minimum(rows[x, 3], rows[y, 3]), np.maximum(rows[x, 3], rows[y, 3])
            fit = 100 * small >= percent * large
            if fit.any():
                yield pair(x[fit], y[fit], rows[:, 1:], False)
        for k in np.flatnonzero(size > LIST):
            lines = np.arange(starts[k], ends[k])
            yield pair(np.full(len(lines) - 1, lines[0]), lines[1:], rows[:, 1:], True)

    kinds = "aa long, ab long, an long, ba long, bb long, bn long, tied boolean"
    return (posted.repartition("gram").sortWithinPartitions("gram", "sa", "sb")
            .mapInArrow(multiply, kinds))


def surviving(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose count and what both could still share can reach what their sizes demand.

    A pair that shares an n-gram of a long run is tied there and needs no exact count here.
    """
    rest = lambda n: n - prefix_of(n, percent)
    need = F.ceil(percent * (F.col("an") + F.col("bn")) / (100 + percent))
    summed = pairs.groupBy("aa", "ab", "ba", "bb").agg(
        F.max("an").alias("an"), F.max("bn").alias("bn"), F.max("tied").alias("tied"), F.count("*").alias("c"))
    enough = F.col("c") + F.greatest(rest(F.col("an")), rest(F.col("bn"))) >= need
    return summed.filter(F.col("tied") | enough)


def prefix_of(n: Column, percent: int) -> Column:
    return n - F.floor((percent * n + 99) / 100) + 1


def node(a: Column | str, b: Column | str) -> Column:
    """One sortable name for a class."""
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(hexed(a), hexed(b))


def tile_rows(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(tile, single, node, n, grams): the sets of the classes (id, name, node, tiles, single) of ``wanted``,
    read from one document each, known by id and text, and dealt straight to their tiles."""
    chosen = docs.join(wanted.select(F.col("id").alias("w"), F.col("name").alias("w_name"), "node", "tiles", "single"),
                       F.col("id").eqNullSafe(F.col("w")) & (F.col("name") == F.col("w_name"))).select(
        "text", "node", "tiles", "single")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            tiles, singles, nodes, grams = zip(*held, strict=True)
            size = np.array([len(g) for g in grams])
            return pa.RecordBatch.from_arrays(
                [pa.array(tiles), pa.array(singles), pa.array(nodes), pa.array(size),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                          pa.array(signed(np.concatenate(grams))))], ["tile", "single", "node", "n", "grams"])

        for piece in pieces(batches):
            found = piece.words()
            rows, hashes = shingles(found, found.hashes(LOWER[piece.data]), words)
            first = np.searchsorted(rows, np.arange(piece.n + 1))
            names, singles, tiles = (piece.column(c).to_pylist() for c in ("node", "single", "tiles"))
            for r in range(piece.n):
                if names[r] in seen:            # a repeated row
                    continue
                seen.add(names[r])
                for tile in tiles[r]:
                    held.append((tile, singles[r], names[r], hashes[first[r]:first[r + 1]]))
                    total += int(first[r + 1] - first[r])
                    if total >= DEALT:
                        yield flush()
                        held, total = [], 0
        if held:
            yield flush()

    return chosen.mapInArrow(cut, "tile string, single boolean, node string, n long, grams array<long>")


def overlap_counts(member: np.ndarray, grams: np.ndarray, m: int) -> np.ndarray:
    """The m x m product of an incidence matrix with itself, from (member, n-gram) entries."""
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    if not shared.any():
        return np.zeros((m, m), dtype=np.int32)
    member, column = member[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    total = np.zeros((m, m), dtype=np.int32)
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        at, to = np.searchsorted(column, [low, low + COLUMNS])
        block = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - low)), dtype=np.float32)
        block[member[at:to], column[at:to] - low] = 1
        total += (block @ block.T).astype(np.int32)     # whole numbers up to COLUMNS
    return total


def tile_links(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b, single): every row of a tile with the least row it reaches by links in the tile."""

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile"):
            starts = np.flatnonzero(changes(numbers(table, "tile")))
            for at, to in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                part = table.slice(int(at), int(to - at)).combine_chunks()
                once = changes(np.array(part.column("node").to_pylist(), dtype=object))   # a repeated row
                part = part.filter(pa.array(once)).combine_chunks()
                names, m = part.column("node").to_pylist(), part.num_rows
                size = numbers(part, "n").astype(np.int64)
                grams = part.column("grams").chunk(0).flatten().to_numpy(zero_copy_only=False)
                counts = overlap_counts(np.repeat(np.arange(m), size), grams, m)
                linked = counts >= needed(size[:, None], size[None], percent)
                np.fill_diagonal(linked, True)
                root = np.arange(m)
                while True:
                    least = np.where(linked, root[None], m).min(1)
                    if (least == root).all():
                        break
                    root = least
                tied = np.flatnonzero(root != np.arange(m))
                if len(tied):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in tied]), pa.array([names[i] for i in root[tied]]),
                         pa.array([part.column("single")[0].as_py()] * len(tied))], ["a", "b", "single"])

    return (tiles.repartition("tile").sortWithinPartitions("tile", "node")
            .mapInArrow(multiply, "a string, b string, single boolean"))


def tiled(members: DataFrame, percent: int) -> DataFrame:
    """(node, tiles, single) from members (node, n, root): the tiles each row belongs to.

    A group of up to TILE rows is one tile. A larger one is cut into bands of size, in each of which
    rows are dealt to blocks, and tiles are pairs of blocks of the same or neighbouring bands, as
    no link spans more: quadratic in blocks, and only where sizes allow a link.
    """
    in_group = members.groupBy("root").agg(F.count("*").alias("all"))
    step = float(np.log(100 / percent))
    band = F.when(F.col("all") <= TILE, 0).otherwise(F.floor(F.log("n") / step)).cast("int")
    banded = members.join(in_group, "root").withColumn("band", band)
    counts = banded.groupBy("root", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"),
                                               F.first("all").alias("all"))
    rows = banded.drop("all").join(counts, ["root", "band"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    next_one = counts.select("root", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    last_one = counts.select("root", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    sides = counts.select("root", "band").join(next_one, ["root", "band"], "left").join(
        last_one, ["root", "band"], "left")
    rows = rows.join(sides, ["root", "band"])
    name = lambda low, i, j: F.concat_ws(":", "root", low, i, j)
    mine = F.col("block")
    until = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(until(F.col("blocks")), lambda o: name(
        F.concat(F.lit("s"), F.col("band")), F.least(mine, o), F.greatest(mine, o)))
    up = F.transform(until(F.coalesce("above", F.lit(0))), lambda o: name(F.concat(F.lit("u"), F.col("band")), mine, o))
    down = F.transform(until(F.coalesce("below", F.lit(0))), lambda o: name(
        F.concat(F.lit("u"), F.col("band") - 1), o, mine))
    return rows.select("node", F.concat(same, up, down).alias("tiles"), (F.col("all") <= TILE).alias("single"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Words are split at ASCII white space and A-Z lower-cased; a document's set holds its distinct
    runs of ``words`` words, or all its words as one run if it has fewer. A null text or one without
    words has an empty set and no links. Two documents link when their sets' Jaccard similarity is at
    least ``percent`` per cent. ``component_id`` is the least id reachable by links, its own included;
    documents with equal sets, repeated rows among them, share it. Null ids take part, and are least
    only where there is no other.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("name"), F.col(text_col).alias("text"))

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = kept(set_rows(docs, words), "sets")
    classes = kept(rows.filter("n > 0").groupBy("sa", "sb", "n").agg(
        F.min("id").alias("id"), F.min_by(F.struct("id", "name"), F.struct(F.col("id").isNull(), "id", "name")).alias("of")), "classes")
    posted = postings(docs, frequent_ngrams(docs, words, percent), words, percent)
    pairs = kept(surviving(first_block(posted, percent), percent).select(
        node("aa", "ab").alias("a"), node("ba", "bb").alias("b")), "pairs")
    groups = kept(components(pairs), "groups")
    named = classes.withColumn("node", node("sa", "sb"))
    members = kept(named.join(groups, "node").select("node", "n", "root", "of"), "members")
    wanted = kept(tiled(members, percent).join(members.select("node", "of.id", "of.name"), "node"), "wanted")
    links = kept(tile_links(tile_rows(docs, wanted, words), percent), "links")
    # a group in a single tile is settled there; only links across tiles are left to connect
    roots = links.filter("single").select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).unionByName(
        components(links.filter("not single")))
    rooted = named.join(roots, "node").select("sa", "sb", "id", "root")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = kept(rooted.join(least, "root").select("sa", "sb", "component_id"), "linked")
    placed = classes.join(linked, ["sa", "sb"], "left").select(
        "sa", "sb", F.coalesce("component_id", "id").alias("component_id"))
    whole = rows.filter("n > 0").join(placed, ["sa", "sb"]).select("id", "n", "component_id")
    empty = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return whole.unionByName(empty).withColumnRenamed("n", "n_shingles")


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    rows = jaccard_join(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.withColumnRenamed("id", "doc_id")
