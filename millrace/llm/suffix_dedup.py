"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Only suffixes that can repeat are sorted. In every window of ``length`` bytes the least of its
short byte runs is its anchor; equal windows have equal anchors, so a window can only repeat where
its anchor's run does. Windows with one anchor in a row form a context. Contexts that equal an
earlier one repeat as a whole. The rest, where an anchor's run has several contexts, are sorted as
suffixes: a mergesort whose comparisons find the common extension of two suffixes by binary search
over prefix polynomial hashes. Neighbours with ``length`` bytes in common are verified byte by byte,
and all but the first of them, in document order, are repeats.

A document is known by its id and a 64-bit name of its text, so rows that share an id, or have none,
stay apart. Contexts that fold without being sorted are told apart by two 64-bit hashes, of all
their bytes and of the anchor's, and classes that lie in several tasks by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.runs import changes, numbers, whole_groups
from millrace.llm.words import BASE, BYTE, UNBASE, Piece, U, mix, pieces, powers, signed, span_hash
from millrace.session import scratch_dir

LENGTH, RUN = 100, 36
CHUNK_ROWS = 1 << 20    # contexts that a task looks through for equal ones before the shuffle
HOT = 32                # contexts of one anchor in such a chunk, beyond which they are spread
SALTS = 256
SORT_BYTES = 4 << 20    # context bytes sorted at a time
NULL_ID = -(1 << 63)
REPEAT, OPEN, OPEN_HOT = 0, 1, 2     # a context: known repeat, to be sorted, to be sorted among many


MOST = (1 << 16) - 1    # windows that a packed context may hold


def pack(low: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First window, number of windows, anchor within the first; sorts by the first."""
    return (low << 32) | (n << 16) | off


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 32, (packed >> 16) & MOST, packed & MOST


def later_ones(new_class: np.ndarray, ids: np.ndarray, names: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of members sorted by class, id, name and start, those that do not come first: of an id above
    the class's least, or after another one of the same document."""
    at = np.arange(len(ids))
    lead = np.maximum.accumulate(np.where(new_class, at, 0))
    own = np.maximum.accumulate(np.where(new_class | changes(ids, names), at, 0))
    return (ids > ids[lead]) | (start > start[own])


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the minimum of h[i:i + width]."""
    value, place, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        n = len(value) - step
        left = value[:n] <= value[step:]
        place = np.where(left, place[:n], place[step:])
        value = np.where(left, value[:n], value[step:])
        have += step
    return place


def contexts_of(piece: Piece, length: int, run: int) -> tuple[np.ndarray, ...]:
    """(row, low, n, off, seed, context) of a piece: maximal runs of windows with one anchor."""
    none = (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=U),) * 2
    size = np.diff(piece.ends)
    if len(piece.data) < length or not (size >= length).any():
        return none
    prefix = piece.prefix()
    at = np.arange(len(piece.data) - run + 1)
    h = mix((prefix[run:] - prefix[:-run]) * powers_inverse(len(at)))
    anchor = least_positions(h, length - run + 1).astype(np.int64)      # one per window start
    row = np.repeat(np.arange(piece.n), size)[:len(anchor)]
    start = np.arange(len(anchor))
    inside = start + length <= piece.ends[1:][row]
    start, row, anchor = start[inside], row[inside], anchor[inside]
    first = np.flatnonzero(changes(row, anchor))
    low, last = start[first], np.append(start[first[1:] - 1], start[-1:])
    row, anchor = row[first], anchor[first]
    n, off = last - low + 1, anchor - low
    context = span_hash(prefix, low, last + length) ^ mix(off.astype(U))
    return row, low, n, off, h[anchor], context


def powers_inverse(n: int) -> np.ndarray:
    return powers(UNBASE, n)


def context_rows(docs: DataFrame, length: int, run: int) -> DataFrame:
    """(key, context, id, name, packed, flag): every context of every document.

    Within a chunk of a task equal contexts are reduced to the first, the others being repeats, and
    an anchor with very many different contexts keeps HOT of them under its own key and has the
    rest dealt out by context.
    """
    names = ["key", "context", "id", "name", "packed", "flag"]

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        once = changes(*columns)                # a repeated row's are told once
        seed, context, ids, name, packed = (c[once] for c in columns)
        new_context, new_seed = changes(seed, context), changes(seed)
        later = later_ones(new_context, ids, name, packed >> 32)
        open_count = np.cumsum(~later)
        begin = np.maximum.accumulate(np.where(new_seed, np.arange(len(seed)), 0))
        nth = open_count - open_count[begin] + 1
        spread = ~later & (nth > HOT)
        group = np.cumsum(new_seed) - 1
        hot = np.bincount(group, weights=spread)[group] > 0
        key = np.where(spread, mix(seed ^ mix(context)), seed)
        key = np.where(later, mix(ids.view(U) ^ name.view(U)), key)
        flag = np.where(later, REPEAT, np.where(hot, OPEN_HOT, OPEN)).astype(np.int8)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(key)), pa.array(signed(context)), pa.array(ids), pa.array(name), pa.array(packed),
             pa.array(flag)], names)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for piece in pieces(batches):
            row, low, n, off, seed, context = contexts_of(piece, length, run)
            if not len(row):
                continue
            ids, name = (piece.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", "name"))
            held.append((seed, context, ids, name, pack(low - piece.ends[:-1][row], n, off)))
            total += len(row)
            if total >= CHUNK_ROWS:
                yield batch_of(held)
                held, total = [], 0
        if held:
            yield batch_of(held)

    return docs.mapInArrow(cut, "key long, context long, id long, name long, packed long, flag byte")


def repeated(rows: DataFrame) -> DataFrame:
    """(id, name, packed, flag): contexts that repeat an earlier one, and those whose anchor's run has others.

    A key's rows meet in one task; however common its text, they are a few per chunk.
    """

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, context, ids, name, packed, flag = (numbers(table, c) for c in table.column_names)
            new_key, new_context = changes(key), changes(key, context)
            later = (flag == REPEAT) | later_ones(new_context, ids, name, packed >> 32)
            same = ~(new_context | changes(ids, name, packed))      # a repeated row: told once
            group = np.cumsum(new_key) - 1
            several = np.bincount(group, weights=new_context)[group] > 1
            hot = (np.bincount(group, weights=flag == OPEN_HOT) > 0)[group]
            keep = np.flatnonzero((later | several | hot) & ~same)
            kind = np.where(later, REPEAT, np.where(hot, OPEN_HOT, OPEN)).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep]), pa.array(name[keep]), pa.array(packed[keep]), pa.array(kind[keep])],
                ["id", "name", "packed", "flag"])

    return (rows.repartition("key").sortWithinPartitions("key", "context", "id", "name", "packed", "flag")
            .mapInArrow(sift, "id long, name long, packed long, flag byte"))


def listed(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and where each row's begin; a null list is empty."""
    column = part.column(part.schema.get_field_index(name))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def open_contexts(texts: DataFrame, length: int, run: int) -> DataFrame:
    """(seed, salt, id, name, packed, body): the bytes of the contexts to be sorted."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            packed, first = listed(piece.rows, "packed")
            flag, _ = listed(piece.rows, "flags")
            row = np.repeat(np.arange(piece.n), np.diff(first))
            if not len(row):
                continue
            keep = flag != REPEAT
            row, packed, flag = row[keep], packed[keep], flag[keep]
            if not len(row):
                continue
            prefix = piece.prefix()
            low, n, off = unpack(packed)
            low = low + piece.ends[:-1][row]
            seed = mix((prefix[low + off + run] - prefix[low + off]) * powers_inverse(len(prefix))[low + off])
            size = n + length - 1
            ends = np.concatenate([[0], np.cumsum(size)])
            body = piece.data[np.repeat(low - ends[:-1], size) + np.arange(ends[-1])]
            ids, name = (piece.column(c).to_numpy(zero_copy_only=False)[row] for c in ("id", "name"))
            salt = np.where(flag == OPEN_HOT, 1 + (mix(ids.view(U) ^ mix(name.view(U))) % U(SALTS)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(seed)), pa.array(salt.astype(np.int32)), pa.array(ids), pa.array(name), pa.array(packed),
                 pa.Array.from_buffers(pa.binary(), len(row), [
                     None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])],
                ["seed", "salt", "id", "name", "packed", "body"])

    return texts.mapInArrow(cut, "seed long, salt int, id long, name long, packed long, body binary")


class Suffixes:
    """Suffixes of a byte buffer, compared on their first ``length`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(BYTE[data] * powers(BASE, len(data)))])
        self.back = powers_inverse(len(data) + 1)

    def same(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the first ``size`` bytes hash alike."""
        return ((self.sums[x + size] - self.sums[x]) * self.back[x]
                == (self.sums[y + size] - self.sums[y]) * self.back[y])

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes x and y have in common, by binary search, ``length`` at most."""
        low = np.zeros(len(x), dtype=np.int64)
        high = np.full(len(x), self.length + 1)
        while True:
            open_ = high - low > 1
            if not open_.any():
                return low
            middle = (low + high) >> 1
            alike = self.same(x, y, middle)
            low, high = np.where(alike, middle, low), np.where(alike, high, middle)

    def before(self, x: np.ndarray, y: np.ndarray, ties: np.ndarray | bool) -> np.ndarray:
        """Whether x sorts before y; ``ties``: what holds for equal ones."""
        common = self.extension(x, y)
        equal = common >= self.length
        at = np.minimum(common, self.length - 1)
        return np.where(equal, ties, self.data[x + at] < self.data[y + at])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The stable order of suffixes within ascending groups: a mergesort, all runs at once.

        In each round a suffix's new place in two merged runs is its place in its own plus the
        number of the other run's suffixes before it, found by binary search.
        """
        n = len(start)
        order = np.arange(n)
        begin = np.maximum.accumulate(np.where(changes(group), np.arange(n), 0))
        size = np.bincount(np.cumsum(changes(group)) - 1)
        end = begin + np.repeat(size, size)
        local, width = np.arange(n) - begin, 1
        while width < (size.max() if len(size) else 0):
            mine = local // width
            other = mine ^ 1
            low = np.minimum(begin + other * width, end)
            first, high = low.copy(), np.minimum(low + width, end)
            right = mine & 1                        # the left run's come first among equals
            x = start[order]
            live = np.flatnonzero(low < high)
            while len(live):
                middle = (low[live] + high[live]) >> 1
                earlier = self.before(x[middle], x[live], right[live] == 1)
                low[live] = np.where(earlier, middle + 1, low[live])
                high[live] = np.where(earlier, high[live], middle)
                live = live[low[live] < high[live]]
            place = begin + (mine // 2) * 2 * width + (local - mine * width) + (low - first)
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, width * 2
        return order

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the first ``length`` bytes are equal: by hash, then byte by byte."""
        out = self.same(x, y, np.full(len(x), self.length))
        places = np.arange(self.length)
        for at in range(0, len(x), 1 << 14):
            some = np.flatnonzero(out[at:at + (1 << 14)]) + at
            out[some] = (self.data[x[some][:, None] + places] == self.data[y[some][:, None] + places]).all(1)
        return out


def sorted_repeats(rows: DataFrame, length: int, spread: bool) -> DataFrame:
    """(ca, cb, id, name, start, n): runs of n repeated windows; or, with ``spread``, the first windows of
    each class of anchors whose contexts are spread over tasks, by a 128-bit class name (ca, cb)."""

    def repeats(part: pa.Table) -> Iterator[pa.RecordBatch]:
        seed, salt, ids, names, packed = (numbers(part, c) for c in ("seed", "salt", "id", "name", "packed"))
        low, n, off = unpack(packed)
        body = part.column("body").combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        offsets = np.frombuffer(body.buffers()[1], dtype=np.int32)[body.offset:body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        offsets = (offsets - offsets[0]).astype(np.int64)
        suffixes = Suffixes(data, length)
        ends = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(n)), n)
        j = np.arange(ends[-1]) - ends[:-1][row]
        # equal windows have equal distances to the anchor: these and the seed make the groups
        key = np.cumsum(changes(seed, salt)) - 1
        by = np.lexsort((low[row] + j, names[row], ids[row], off[row] - j, key[row]))
        row, j = row[by], j[by]
        start = offsets[:-1][row] + j
        group = np.cumsum(changes(key[row], off[row] - j)) - 1
        order = suffixes.sort(start, group)
        row, j, start, group = row[order], j[order], start[order], group[order]
        tied = np.zeros(len(start), dtype=bool)
        tied[1:] = group[1:] == group[:-1]
        tied[1:] &= suffixes.alike(start[:-1], start[1:])
        where = low[row] + j
        later = later_ones(~tied, ids[row], names[row], where)
        at = np.flatnonzero(later & (not spread))
        at = at[np.lexsort((where[at], row[at]))]
        if len(at):
            jump = np.ones(len(at), dtype=bool)
            jump[1:] = (row[at][1:] != row[at][:-1]) | (where[at][1:] != where[at][:-1] + 1)
            first = np.flatnonzero(jump)
            count = np.diff(np.append(first, len(at)))
            none = np.zeros(len(first), dtype=U)
            yield out(none, none, ids[row[at[first]]], names[row[at[first]]], where[at[first]], count)
        held = np.flatnonzero(~later & spread)
        if len(held):
            x = start[held]
            raw = (suffixes.sums[x + length] - suffixes.sums[x]) * suffixes.back[x]
            words = [np.ascontiguousarray(data[x[:, None] + np.arange(k, k + 8)]).view(U).ravel()
                     for k in range(0, length - 7, 8)]
            second = sum((mix(w + U(i)) * U(2 * i + 1) for i, w in enumerate(words)), np.zeros(len(x), dtype=U))
            yield out(mix(raw), second, ids[row[held]], names[row[held]], where[held], np.ones(len(held)))

    def out(ca, cb, ids, names, where, count) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(ca)), pa.array(signed(cb)), pa.array(ids), pa.array(names),
             pa.array(where.astype(np.int32)), pa.array(count.astype(np.int32))],
            ["ca", "cb", "id", "name", "start", "n"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "seed", "salt"):
            if spread:
                table = table.filter(pa.array(numbers(table, "salt") > 0)).combine_chunks()
                if not len(table):
                    continue
            new = np.flatnonzero(changes(numbers(table, "seed"), numbers(table, "salt")))
            size = unpack(numbers(table, "packed"))[1]
            total = np.concatenate([[0], np.cumsum(size + length)])
            at = 0
            while at < table.num_rows:      # whole groups of about SORT_BYTES
                to = new[np.searchsorted(total[new], total[at] + SORT_BYTES)] \
                    if total[-1] > total[at] + SORT_BYTES and total[new[-1]] > total[at] + SORT_BYTES \
                    else table.num_rows
                to = int(max(to, at + 1))
                yield from repeats(table.slice(at, to - at))
                at = to

    return (rows.repartition("seed", "salt").sortWithinPartitions("seed", "salt", "id", "name", "packed").mapInArrow(
        work, "ca long, cb long, id long, name long, start int, n int"))


def cut_texts(texts: DataFrame, id_type: str, length: int) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) from texts with their repeated windows."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            depth = np.zeros(len(piece.data) + 1, dtype=np.int32)
            packed, first = listed(piece.rows, "packed")
            flag, _ = listed(piece.rows, "flags")
            row = np.repeat(np.arange(piece.n), np.diff(first))
            low, n, _ = unpack(packed)
            spans, first = listed(piece.rows, "spans")
            span_row = np.repeat(np.arange(piece.n), np.diff(first))
            s_low, s_n = spans >> 32, spans & 0xFFFFFFFF
            for r, a, k, keep in ((row, low, n, flag == REPEAT), (span_row, s_low, s_n, s_n > 0)):
                begin = piece.ends[:-1][r[keep]] + a[keep]
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + k[keep] + length - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            starts = piece.ends[:-1][piece.ends[:-1] < len(gone)]
            edge[starts] = gone[starts]
            stop = gone.copy()
            stop[:-1] &= ~gone[1:]
            lasts = piece.ends[1:][piece.ends[1:] > 0] - 1
            stop[lasts] = gone[lasts]
            begin, end = np.flatnonzero(edge), np.flatnonzero(stop) + 1
            of = np.searchsorted(begin, piece.ends)
            base = np.repeat(piece.ends[:-1], np.diff(of))
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[piece.ends[1:]] - total[piece.ends[:-1]]
            kept = piece.data[~gone]
            ends = piece.ends - total[piece.ends]
            yield pa.RecordBatch.from_arrays(
                [piece.column("own_id"), pa.array(np.diff(piece.ends)), pa.array(removed),
                 pa.array(np.diff(of).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays(
                     [pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))],
                     ["start", "stop"])),
                 pa.Array.from_buffers(pa.binary(), piece.n, [
                     None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])],
                ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return texts.mapInArrow(cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, "
                                 "spans array<struct<start:int,stop:int>>, kept binary")


def span_of(start: Column, n: Column) -> Column:
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(n.cast("long"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          run: int = RUN) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) of every row; ``kept`` are the remaining bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one. Strings are judged on the input and never cross rows.
    A null text is empty. Ids are integers; a null id comes before all others. Rows that share an id
    and a text are one document and get equal results; rows that share an id, or have none, but not
    the text are documents of their own, none of which precedes another. ``length`` is at most 65,535.
    """
    if not run <= length <= MOST:
        raise ValueError(f"length must lie between run and {MOST}")
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession, "suffixes")
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("name"), F.col(text_col).alias("text"))
    key = ["id", "name"]
    repeated(context_rows(docs.select(*key, "text"), length, run)).write.parquet(f"{folder}/contexts")
    by_doc = spark.read.parquet(f"{folder}/contexts").groupBy(*key).agg(
        F.collect_list("packed").alias("packed"), F.collect_list("flag").alias("flags"))
    # the texts are moved once: both uses of this join read the same shuffle, and a document in very
    # many rows is split there
    texts = docs.join(by_doc, key, "left")
    rows = open_contexts(texts.select(*key, "text", "packed", "flags"), length, run)
    among = sorted_repeats(rows, length, True)
    least = among.groupBy("ca", "cb").agg(F.min("id").alias("least"))
    later = among.join(least, ["ca", "cb"]).filter(F.col("id") > F.col("least"))
    gone = sorted_repeats(rows, length, False).select(*key, "start", "n").unionByName(later.select(*key, "start", "n"))
    spans = gone.groupBy(*key).agg(F.collect_list(span_of(F.col("start"), F.col("n"))).alias("spans"))
    return cut_texts(texts.join(spans, key, "left"), kind, length)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"))
