"""Vectorised text helpers used inside Arrow tasks.

A ``Spans`` is a set of byte ranges of one UTF-8 buffer with the number of the
document each range lies in.  Everything works on whole Arrow columns with
numpy; there is no Python loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20          # text handled at once inside a task (one longer text is one slice)

# The published XXH64 constants.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table: True for byte values inside any of the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a:b + 1] = True
    return t


#: Words are runs of anything but space and \t..\r.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII digits, ASCII lower-case letters and non-ASCII characters.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Spans:
    buf: np.ndarray      # uint8, eight zero bytes of padding at the end
    start: np.ndarray    # int64
    end: np.ndarray      # int64
    doc: np.ndarray      # int64, ascending
    n_docs: int

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES):
    """Zero-copy row slices of ``batch`` with about ``max_bytes`` of text each."""
    if not batch.num_rows:
        return
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = arr.fill_null("")
    lens = np.cumsum(pa.compute.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(lens):
        base = lens[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(lens, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with padding, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.zeros(int(off[-1] - off[0]) + 8, np.uint8)
    if len(buf) > 8:
        buf[:-8] = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]]
    return buf, off - off[0]


def words(column: pa.Array, chars: np.ndarray = NOT_SPACE, lower: bool = True) -> Spans:
    """Maximal runs of ``chars`` bytes in every text, optionally after lower-casing A-Z."""
    buf, off = utf8(column)
    if lower:
        buf = _LOWER[buf]
    n = len(buf) - 8
    inside = chars[buf[:n]]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    doc = np.searchsorted(off[1:], start, side="right")
    return Spans(buf, start, end, doc, len(off) - 1)


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def load64(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words at arbitrary byte positions (buffer is padded)."""
    view = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    return view[at]


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[start:end]`` for every range (the same as xxhash.xxh64)."""
    n = end - start
    out = np.empty(len(n), np.uint64)
    for a in range(0, len(n), 1 << 18):     # keep temporaries in cache and memory bounded
        out[a:a + (1 << 18)] = _xxh64(buf, start[a:a + (1 << 18)], n[a:a + (1 << 18)], seed)
    return out


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64(buf, start, n, seed):
    seed = np.uint64(seed)
    with np.errstate(over="ignore"):
        acc = np.full(len(n), seed + _P5)
        at = start.copy()
        left = n.copy()
        big = np.flatnonzero(n >= 32)
        if len(big):
            v = [np.full(len(big), x) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            live = np.arange(len(big))
            while len(live):
                rows = big[live]
                for k in range(4):
                    v[k][live] = _round(v[k][live], load64(buf, at[rows] + 8 * k))
                at[rows] += 32
                left[rows] -= 32
                live = live[left[rows] >= 32]
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                h = (h ^ _round(np.zeros_like(h), v[k])) * _P1 + _P4
            acc[big] = h
        acc += n.astype(np.uint64)
        rows = np.flatnonzero(left >= 8)
        while len(rows):
            lane = _round(np.zeros(len(rows), np.uint64), load64(buf, at[rows]))
            acc[rows] = _rotl(acc[rows] ^ lane, 27) * _P1 + _P4
            at[rows] += 8
            left[rows] -= 8
            rows = rows[left[rows] >= 8]
        rows = np.flatnonzero(left >= 4)
        if len(rows):
            four = load64(buf, at[rows]) & np.uint64(0xFFFFFFFF)
            acc[rows] = _rotl(acc[rows] ^ (four * _P1), 23) * _P2 + _P3
            at[rows] += 4
            left[rows] -= 4
        rows = np.flatnonzero(left > 0)
        while len(rows):
            acc[rows] = _rotl(acc[rows] ^ (buf[at[rows]].astype(np.uint64) * _P5), 11) * _P1
            at[rows] += 1
            left[rows] -= 1
            rows = rows[left[rows] > 0]
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
    return acc


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, rank of every key among them)."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(new) - 1
    return s[new], rank
