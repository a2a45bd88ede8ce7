"""Arrow text columns as byte arrays: words, their hashes and shingles, without Python strings.

Everything works on a *piece*: a run of rows whose texts hold about ``PIECE_BYTES`` bytes, so that
memory is bounded by that or by the longest single text. Words are ``[^\\x20\\x09-\\x0D]+``, which
on UTF-8 bytes is splitting at six ASCII bytes. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Everything in ASCII but letters and digits: for words without the marks around them.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the accented capitals U+00C0 to U+00DE lower-cased."""
    out = LOWER[data]
    upper = np.zeros(len(data), dtype=bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[upper] += 0x20
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


BYTE = seeded(256, 11)
BASE = 0xD6E8FEB86659FD93
UNBASE = pow(BASE, -1, 1 << 64)
STEP = seeded(64, 23)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1), modulo 2 ** 64; kept for the next piece."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * PIECE_BYTES)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=U)
    return have[:n]


class Piece:
    """Some rows of a batch with their texts laid end to end.

    ``data``: the bytes; ``ends[i]`` to ``ends[i + 1]``: the bytes of row i; a null text is empty.
    """

    def __init__(self, rows: pa.RecordBatch, text: str):
        column = rows.column(rows.schema.get_field_index(text)).cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
            column.offset:column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else \
            np.zeros(0, dtype=np.uint8)
        self.rows, self.n = rows, len(column)
        self.ends = offsets - offsets[0]
        self.data = data[offsets[0]:offsets[-1]]

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        """Prefix polynomial sums of the bytes: one more entry than bytes."""
        data = self.data if data is None else data
        sums = np.empty(len(data) + 1, dtype=U)
        sums[0] = 0
        np.cumsum(BYTE[data] * powers(BASE, len(data)), out=sums[1:])
        return sums

    def words(self, gaps: np.ndarray = SPACE) -> "Words":
        return Words(self, gaps)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    raw = (prefix[ends] - prefix[starts]) * powers(UNBASE, len(prefix))[starts]
    return mix(raw + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


class Words:
    """Word positions of a piece: byte ``starts`` and ``ends``, ``first[i]`` the first word of row i."""

    def __init__(self, piece: Piece, gaps: np.ndarray):
        data, bounds = piece.data, piece.ends
        inside = ~gaps[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = bounds[:-1][bounds[:-1] < len(data)]
        begins[edges] = inside[edges]
        lasts = bounds[1:][bounds[1:] > 0] - 1
        stops[lasts] = inside[lasts]
        self.piece, self.inside = piece, inside
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word, of other bytes in the same places if given (lower-cased, say)."""
        return span_hash(self.piece.prefix(data), self.starts, self.ends)

    def row(self) -> np.ndarray:
        """The row each word belongs to."""
        return np.repeat(np.arange(self.piece.n), self.counts)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; entry i covers values i … i + k - 1."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    for j in range(k):
        out += values[j:j + n] * STEP[j]
    return mix(out)


def whole(first: np.ndarray, counts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of n windows of k values, which lie in one row."""
    inside = np.zeros(n + k, dtype=np.int32)
    fit = counts >= k
    np.add.at(inside, first[:-1][fit], 1)
    np.add.at(inside, first[1:][fit] - k + 1, -1)
    return np.cumsum(inside)[:n] > 0


def shingles(words: Words, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct k-word shingle, by row; a shorter row's words make one shingle."""
    all_windows = windows(values, k)
    keep = whole(words.first, words.counts, k, len(all_windows))
    row = words.row()
    rows, hashes = row[:len(keep)][keep], all_windows[keep]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.zeros(len(short), dtype=U)
        for i, r in enumerate(short):
            own = values[words.first[r]:words.first[r + 1]]
            extra[i] = (own * STEP[:len(own)]).sum() + U(len(own))
        rows = np.concatenate([rows, short])
        hashes = np.concatenate([hashes, mix(extra)])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text",
           budget: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut Arrow batches into pieces of about ``budget`` text bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
            column.offset:column.offset + len(column) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + budget, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield Piece(batch.slice(at, to - at), text)
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def sum_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
