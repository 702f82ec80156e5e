"""Words of whole Arrow string columns, found and hashed without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``. The delimiters are ASCII, so UTF-8 bytes can be scanned directly.
A word's hash is the polynomial sum of T[byte] * P**k modulo 2**64 over its bytes, taken from one
running sum over the buffer, then mixed. Words over LONG bytes are hashed by xxhash instead, since
structured inputs of great length weaken polynomials modulo a power of two.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_P = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8: its powers less 1 have few factors of two
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, (2 << 20) + 1)
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """starts, ends: byte positions; row: each word's row; first: row r has words first[r]:first[r + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(offsets) - 1
    if not len(data):
        e = np.zeros(0, np.int64)
        return Words(data, offsets, e, e, e, np.zeros(n + 1, np.int64))
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    begins[cut] |= word[cut]  # words never cross rows
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = word
    stops[1:-1] &= ~word[1:]
    stops[cut] |= (word[cut - 1]) & (cut > 0)
    ends = np.flatnonzero(stops)
    first = np.searchsorted(starts, offsets, "left")
    row = np.repeat(np.arange(n), np.diff(first))
    return Words(data, offsets, starts, ends, row, first)


def hash_words(w: Words, lower: bool = False) -> np.ndarray:
    """64-bit hashes; equal words (with A-Z lower-cased if lower) have equal hashes."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(w.data) + 1)
    run = np.empty(len(w.data) + 1, np.uint64)
    run[0] = 0
    np.cumsum((_LOWER if lower else _TABLE)[w.data] * up[: len(w.data)], out=run[1:])
    size = (w.ends - w.starts).astype(np.uint64)
    out = mixed((run[w.ends] - run[w.starts]) * down[w.starts] + size)
    for k in np.flatnonzero(size > LONG):
        raw = w.data[w.starts[k] : w.ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(raw.lower() if lower else raw, seed=7)  # bytes.lower() is A-Z only
    return out


def hash_windows(hashes: np.ndarray, w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of size consecutive words in a row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    whole = w.row[:n] == w.row[size - 1 :]
    return mixed(out[whole]), w.row[:n][whole]


def slices(rows: int, offsets: np.ndarray, most_bytes: int = 2 << 20) -> list[tuple[int, int]]:
    """Ranges of rows of at most most_bytes each (one row at least), so that work arrays stay bounded."""
    out, at = [], 0
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), rows)
        out.append((at, to))
        at = to
    return out


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All indexes of the ranges starts[i]:ends[i], one range after the other."""
    n = ends - starts
    keep = n > 0
    starts, n = starts[keep], n[keep]
    if not len(n):
        return np.zeros(0, np.int64)
    step = np.ones(int(n.sum()), np.int64)
    step[0] = starts[0]
    step[np.cumsum(n)[:-1]] = starts[1:] - (starts[:-1] + n[:-1] - 1)
    return np.cumsum(step)


_SHORT_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(LONG, _P, np.uint64)])


def _unit_hashes(d: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each unit, each byte's distance from its unit's start); the units are all of d."""
    from_start = np.arange(len(d), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    h = mixed(np.add.reduceat(_TABLE[d] * _SHORT_POWERS[np.minimum(from_start, LONG)], starts) + sizes.astype(np.uint64))
    for k in np.flatnonzero(sizes > LONG):
        h[k] = xxhash.xxh3_64_intdigest(d[starts[k] : starts[k] + sizes[k]].tobytes(), seed=7)
    return h, from_start


def _distinct(d: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash and a first unit of each distinct one, each unit's number among these), equal by bytes and not by hash alone."""
    h, from_start = _unit_hashes(d, starts, sizes)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    twin = first[number]
    if not ((sizes == sizes[twin]).all() and (d[np.repeat(starts[twin].astype(np.int32), sizes) + from_start] == d).all()):
        seen: dict[bytes, int] = {}  # two units share a hash
        raw = [d[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        number = np.array([seen.setdefault(r, len(seen)) for r in raw], np.int64)
        first = np.unique(number, return_index=True)[1]
    return h[first], first, number


@dataclass
class _Table:
    """Units in ascending order of hash: where each one's bytes and ids stand in two flat arrays."""

    h: np.ndarray
    at: np.ndarray
    size: np.ndarray
    data: np.ndarray
    id_at: np.ndarray
    n_ids: np.ndarray
    ids: np.ndarray

    def find(self, h: np.ndarray, d: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place of each unit here, -1 where it is not; bytes are compared."""
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero((self.h[k] == h) & (self.size[k] == sizes))
        out = np.full(len(h), -1, np.int64)
        if len(hit):
            n, p = sizes[hit], k[hit]
            same = d[spread(starts[hit], starts[hit] + n)] == self.data[spread(self.at[p], self.at[p] + n)]
            good = np.logical_and.reduceat(same, np.r_[0, np.cumsum(n)[:-1]])
            out[hit[good]] = p[good]
        return out

    def take(self, places: np.ndarray) -> _Table:
        n, m = self.size[places], self.n_ids[places]
        data, ids = self.data[spread(self.at[places], self.at[places] + n)], self.ids[spread(self.id_at[places], self.id_at[places] + m)]
        return _Table(self.h[places], np.cumsum(n) - n, n, data, np.cumsum(m) - m, m, ids)

    def merged(self, other: _Table) -> _Table:
        h = np.r_[self.h, other.h]
        by = np.argsort(h, kind="stable")
        return _Table(
            h[by], np.r_[self.at, other.at + len(self.data)][by], np.r_[self.size, other.size][by], np.r_[self.data, other.data],
            np.r_[self.id_at, other.id_at + len(self.ids)][by], np.r_[self.n_ids, other.n_ids][by], np.r_[self.ids, other.ids],
        )

    def bytes(self) -> int:
        return 40 * len(self.h) + len(self.data) + 4 * len(self.ids)


class Kept:
    """Ids of distinct units kept by a Python worker in flat arrays, two generations of half of most_bytes (and most) each.

    When the young one is full it becomes the old one, and the former old one goes; what is used again
    is copied to the young one. So frequent units stay and rare ones are forgotten.
    """

    def __init__(self, most_bytes: int, most: int = 1 << 62):
        self.most_bytes, self.most = most_bytes, most
        self.clear()

    def clear(self) -> None:
        self.young: list[_Table] = []
        self.old: list[_Table] = []

    def _add(self, new: _Table) -> None:
        if not len(new.h):
            return
        self.young.append(new)
        while len(self.young) > 1 and len(self.young[-2].h) < 2 * len(self.young[-1].h):
            last = self.young.pop()
            self.young[-1] = self.young[-1].merged(last)

    def ids(self, h: np.ndarray, d: np.ndarray, starts: np.ndarray, sizes: np.ndarray, make: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each distinct unit begin, how many they are); make gives those that are not kept."""
        if sum(t.bytes() for t in self.young) > self.most_bytes // 2 or sum(len(t.h) for t in self.young) > self.most // 2:
            self.old, self.young = self.young, []
        left, flat, used = np.arange(len(h)), [], 0
        at, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        again = []
        for table, is_old in [*((t, False) for t in self.young), *((t, True) for t in self.old)]:
            p = table.find(h[left], d, starts[left], sizes[left])
            hit = p >= 0
            if hit.any():
                got = table.take(p[hit])
                at[left[hit]], count[left[hit]] = used + got.id_at, got.n_ids
                flat.append(got.ids)
                used += len(got.ids)
                left = left[~hit]
                again += [got] if is_old else []
        if len(left):
            raw = d.tobytes()
            n = sizes[left]
            made = make([raw[a:b] for a, b in zip(starts[left].tolist(), (starts[left] + n).tolist(), strict=True)])
            m = np.fromiter(map(len, made), np.int64, len(made)) // 4
            ids = np.frombuffer(b"".join(made), "<u4")
            at[left], count[left] = used + np.cumsum(m) - m, m
            flat.append(ids)
            by = np.argsort(h[left], kind="stable")
            again.append(_Table(h[left][by], (np.cumsum(n) - n)[by], n[by], d[spread(starts[left], starts[left] + n)], (np.cumsum(m) - m)[by], m[by], ids))
        for t in again:
            self._add(t if (t.h[1:] >= t.h[:-1]).all() else t.take(np.argsort(t.h, kind="stable")))
        return (np.concatenate(flat) if flat else np.zeros(0, "<u4")), at, count


def table_of(found: Callable[[str], bool]) -> np.ndarray:
    """Which ASCII bytes a predicate takes; bytes of other characters are never marked."""
    return np.array([b < 128 and bool(found(chr(b))) for b in range(256)])


def gathered(
    column: pa.Array, cuts: list[tuple[np.ndarray, np.ndarray]], whole: np.ndarray, kept: Kept, make: Callable[[list[bytes]], list[bytes]], most_bytes: int = 2 << 20
) -> tuple[np.ndarray, np.ndarray]:
    """(unsigned 32-bit ids of all rows, where each row's begin and end) by encoding distinct units only.

    A row is cut into units between a byte marked in the left and one marked in the right table of any
    of cuts; rows marked in whole are one unit each. Units are found and compared by array operations,
    most_bytes at a time, so that Python objects are made only for units that are not kept.
    """
    data, offsets = utf8(column)
    filled = offsets[1:] > offsets[:-1]
    begins = np.zeros(len(data), bool)
    for left, right in cuts:
        begins[1:] |= left[data[:-1]] & right[data[1:]]
    for k in np.flatnonzero(whole & filled).tolist():
        begins[offsets[k] : offsets[k + 1]] = False
    begins[offsets[:-1][filled]] = True
    starts = np.flatnonzero(begins)
    ends = np.r_[starts[1:], len(data)].astype(np.int64)
    first = np.searchsorted(starts, offsets, "left")
    flat, counts, at = [], [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most_bytes, "right")))
        low = int(starts[at])
        d, s, n = data[low : int(ends[to - 1])], starts[at:to] - low, ends[at:to] - starts[at:to]
        if to == at + 1 and n[0] > most_bytes:  # longer than what is kept
            ids, id_at, m, number = np.frombuffer(make([d.tobytes()])[0], "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
            m[0] = len(ids)
        else:
            h, lead, number = _distinct(d, s, n)
            ids, id_at, m = kept.ids(h, d, s[lead], n[lead], make)
        a = id_at[number]
        flat.append(ids[spread(a, a + m[number])])
        counts.append(m[number])
        at = to
    sums = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
    return (np.concatenate(flat) if flat else np.zeros(0, "<u4")), sums[first]
