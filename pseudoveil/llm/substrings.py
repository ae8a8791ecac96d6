"""Suffix-array dedup: repeated substrings across documents, later copies removed.

Texts are UTF-8 bytes.  A byte of a document goes if a ``least``-byte string that
covers it also starts in a document with a smaller doc_id.

A corpus-wide suffix array is split by *minimisers*: the smallest hash among the
``least/2``-byte grams of a ``least``-byte window.  Equal windows have equal
minimisers, so all suffixes that can share ``least`` bytes meet in one range of
minimiser hashes, and only windows whose minimiser occurs elsewhere take part.

1. **Blocks.**  Documents are written once in blocks (slices of an Arrow batch).
2. **Which minimisers are shared.**  Every block sends its distinct minimisers by
   hash range and gets back one bit each: seen in another block, too.
3. **Fragments.**  For every shared minimiser a block sends the text around it:
   all windows that it rules.  Equal fragments of a block are sent once, with
   their smallest document, so a passage copied into a third of all documents
   costs one fragment per block.
4. **Enhanced suffix array per range.**  The windows of all fragments are sorted;
   neighbours get their common prefix length.  Groups of equal ``least``-byte
   prefixes whose occurrences are all preceded by the same byte inside their
   fragments are left out: the group one byte to the left covers them.  A stack
   scan over the others gives the common-prefix intervals; those with different
   left extensions are the maximal repeats, with all occurrences.
5. **Removal.**  In a repeat every occurrence outside its smallest document is
   marked, over its whole length.  The marks go back to the blocks as bits.

Every exchange carries one entry per block and distinct key, so memory of a task
is bounded by ``block_bytes`` or by the share of one hash range.

Defined results: null or empty text has no bytes; a text shorter than ``least``
is untouched; a string repeated only inside one document (or in rows sharing its
doc_id) stays; a null doc_id counts as smallest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, written
from .words import load64, mix64, text_slices, utf8, xxh64

NULL_ID = -(1 << 63)
BLOCK = "block long, docs binary, sizes binary, text binary"
KEYS = "range int, block long, base long, keys binary"
SHARED = "block long, range int, bits binary"
PIECES = "range int, block long, kind int, docs binary, sizes binary, text binary, at binary"
MARKS = "block long, range int, kind int, bits binary, docs binary, sizes binary, at binary"
U = np.uint64


def blocks(docs: DataFrame, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, "text", block_bytes):
                buf, off = utf8(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number])] + [pa.array([x], pa.binary()) for x in (
                        part.column(0).to_numpy().astype(np.int64).tobytes(), np.diff(off).tobytes(), buf[:-8].tobytes())],
                    ["block", "docs", "sizes", "text"])
                number += 1

    return rows.mapInArrow(task, BLOCK)


def gram_hashes(buf: np.ndarray, n: int, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes at positions 0..n-1 (the buffer is padded)."""
    view = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    h = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for k in [*range(0, width - 8, 8), width - 8]:
            h ^= view[k:k + n]
            h *= U(0x9E3779B97F4A7C15)
            h ^= h >> U(31)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
    return h


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[:-step], a[step:])
        have += step
    return a


class Block:
    """Text of one ``BLOCK`` row and the runs of windows ruled by one minimiser."""

    def __init__(self, r: dict, least: int):
        self.docs, self.sizes = (np.frombuffer(r[c], np.int64) for c in ("docs", "sizes"))
        text = r["text"]
        self.n = len(text)
        self.buf = np.zeros(self.n + 8, np.uint8)
        self.buf[:-8] = np.frombuffer(text, np.uint8)
        self.off = np.r_[0, np.cumsum(self.sizes)]
        self.least = least

    def runs(self):
        """(hash of the minimiser, first window, windows, document number) of every run."""
        gram, n = self.least // 2, self.n
        m = n - self.least + 1                       # windows, those that cross documents included
        none = np.zeros(0, np.int64)
        if m <= 0:
            return none.astype(U), none, none, none
        g = n - gram + 1
        h = gram_hashes(self.buf, g, gram)
        low = U(max(20, int(n).bit_length()))
        key = (h >> low << low) | np.arange(g, dtype=U)
        at = (sliding_min(key, self.least - gram + 1) & ((U(1) << low) - U(1))).astype(np.int64)
        edge = np.zeros(n + 1, np.int32)              # windows that would cross the end of their document
        ends = self.off[1:]
        start = np.maximum(ends - self.least + 1, self.off[:-1])
        np.add.at(edge, start, 1)
        np.add.at(edge, ends, -1)
        inside = np.cumsum(edge[:m]) == 0
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | first[1:m]
        p = np.flatnonzero(new)
        stop = np.r_[p[1:], m]
        closed = np.flatnonzero(~inside)
        if len(closed):
            nxt = np.searchsorted(closed, p)
            stop = np.minimum(stop, np.where(nxt < len(closed), closed[np.minimum(nxt, len(closed) - 1)], m))
        # Minima of hashes are small numbers; mixed once more they spread evenly over the hash ranges.
        return mix64(h[at[p]]), p, stop - p, np.searchsorted(self.off[1:], p, side="right")


def cut_ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where sorted hashes are cut into n ranges."""
    of = ((keys >> U(32)) * U(n)) >> U(32)
    return np.searchsorted(of, np.arange(n + 1, dtype=U))


def distinct(sorted_keys: np.ndarray) -> np.ndarray:
    return sorted_keys[np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]] if len(sorted_keys) else sorted_keys


def minimiser_keys(table: DataFrame, least: int, bits: int, n_ranges: int) -> DataFrame:
    """``KEYS``: the distinct minimisers of each block (top ``bits`` bits), as gaps, by hash range."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                k = distinct(np.sort(Block(r, least).runs()[0] >> U(64 - bits)))
                cut = cut_ranges(k << U(64 - bits), n_ranges)
                some = np.flatnonzero(np.diff(cut))
                parts = [k[cut[i]:cut[i + 1]] for i in some]
                gaps = [np.diff(x) for x in parts]
                wide = [len(g) and int(g.max()) >> 32 for g in gaps]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([r["block"]] * len(some), pa.int64()),
                     pa.array([int(x[0]) for x in parts], pa.int64()),
                     pa.array([b"8" + g.tobytes() if w else b"4" + g.astype(np.uint32).tobytes()
                               for g, w in zip(gaps, wide, strict=True)], pa.binary())], ["range", "block", "base", "keys"])

    return table.mapInArrow(task, KEYS)


def shared_keys(keys: DataFrame) -> DataFrame:
    """``SHARED``: for every asked minimiser, whether another block has it, too."""
    def task(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        all_keys = []
        for r in rows:
            gaps = np.frombuffer(r["keys"], np.uint64 if r["keys"][:1] == b"8" else np.uint32, offset=1)
            all_keys.append(np.r_[np.zeros(1, U), np.cumsum(gaps.astype(U))] + U(r["base"]))
        s = np.sort(np.concatenate(all_keys))
        twice = distinct(s[1:][s[1:] == s[:-1]])
        bits = []
        for k in all_keys:
            at = np.searchsorted(twice, k)
            hit = twice[np.minimum(at, len(twice) - 1)] == k if len(twice) else np.zeros(len(k), bool)
            bits.append(np.packbits(hit).tobytes())
        return pa.table([t.column("block"), t.column("range"), pa.array(bits, pa.binary())], ["block", "range", "bits"])

    return keys.groupBy("range").applyInArrow(task, SHARED)


def fragments(table: DataFrame, shared: DataFrame, least: int, bits: int, n_ranges: int) -> DataFrame:
    """``PIECES``.  Kind 1: text around shared minimisers, by hash range, equal ones once.
    Kind 0: the block's own notes, where each of its runs is and which fragment it equals."""
    def task(block: pa.Table, got: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        b = Block(r, least)
        h, p, n, doc = b.runs()
        key = h >> U(64 - bits)
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        rank = np.cumsum(new) - 1
        k = s[new]
        hit = np.zeros(len(k), bool)
        cut = cut_ranges(k << U(64 - bits), n_ranges)
        for g in got.to_pylist():
            a, z = cut[g["range"]], cut[g["range"] + 1]
            hit[a:z] = np.unpackbits(np.frombuffer(g["bits"], np.uint8), count=z - a).astype(bool)
        if len(k):                                    # shared inside the block: by two or more documents
            cuts = np.flatnonzero(new)
            hit |= np.minimum.reduceat(doc[order], cuts) != np.maximum.reduceat(doc[order], cuts)
        take = np.sort(order[hit[rank]]) if len(k) else order
        h, p, n, doc = h[take], p[take], n[take], doc[take]
        # A fragment begins one byte early where its document does, so that the left extension is known.
        lead = (p > b.off[doc]).astype(np.int64)
        a, size = p - lead, n + least - 1 + lead
        name = [xxh64(b.buf, a, a + size, seed) for seed in (1, 2 + least)]
        rng = ((h >> U(32)) * U(n_ranges)) >> U(32)
        order = np.lexsort((b.docs[doc], name[1], name[0], lead, rng))
        same = np.ones(max(len(order) - 1, 0), bool)
        for x in (name[0], name[1], lead, rng, size):
            same &= x[order][1:] == x[order][:-1]
        new = np.r_[True, ~same] if len(order) else np.zeros(0, bool)
        which = np.cumsum(new) - 1
        sent = order[new]                             # of equal fragments the one in the smallest document
        out = [(0, r["block"], 0, doc[order].tobytes(), n[order].tobytes(), b"", np.stack([p[order], which]).tobytes())]
        at = np.searchsorted(rng[sent], np.arange(n_ranges + 1, dtype=U))
        for i in np.flatnonzero(np.diff(at)):
            f = sent[at[i]:at[i + 1]]
            out.append((int(i), r["block"], 1, b.docs[doc[f]].tobytes(), (n[f] * 2 + lead[f]).astype(np.int32).tobytes(),
                        gathered(b.buf, a[f], size[f]).tobytes(), b""))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return table.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(task, PIECES)


def gathered(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``buf`` one after another."""
    total = int(size.sum())
    return buf[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)]


class Intervals:
    """Common-prefix intervals of the windows of a set of fragments."""

    def __init__(self, text: np.ndarray, start: np.ndarray, windows: np.ndarray, lead: np.ndarray, least: int):
        """Fragment i has ``windows[i]`` windows from ``start[i]``; ``lead[i]``: the byte before is its left extension."""
        self.text, self.least = text, least
        n = int(windows.sum())
        owner = np.repeat(np.arange(len(start)), windows)
        first = np.cumsum(windows) - windows
        step = np.arange(n) - first[owner]
        self.pos, self.owner = start[owner] + step, owner
        stop = (start + windows + least - 1)[owner]
        left = np.where((step > 0) | lead[owner], self.text[self.pos - 1].astype(np.int64), -1)
        fresh = step == 0                              # its left neighbour is no window of this fragment
        view = gram_hashes(text, len(text) - 8 - least + 1, least)
        h = view[self.pos]
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        cut = np.flatnonzero(np.r_[True, ~same]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[cut, n])
        if n:                                          # groups of two or more with different left extensions
            l = left[order]
            diverse = (np.minimum.reduceat(l, cut) != np.maximum.reduceat(l, cut)) | np.logical_or.reduceat(fresh[order], cut)
            keep = np.repeat((size > 1) & diverse, size)
            order = order[keep]
        # The suffix array of those groups: by window, then by the bytes that follow it.
        tail = [self._word(self.pos[order] + least + 8 * k, stop[order]).byteswap() for k in range(-(-least // 16) + 1)]
        order = order[np.lexsort((*tail[::-1], h[order]))]
        self.sa, self.left, self.fresh = order, left[order], fresh[order]
        self.lcp = self._common(order, h, stop)

    def _word(self, at, stop):
        """Eight bytes at ``at``, zero beyond ``stop``."""
        room = np.clip(stop - at, 0, 8).astype(U)
        w = load64(self.text, np.minimum(at, len(self.text) - 8))
        return np.where(room == 8, w, w & ((U(1) << (room * U(8))) - U(1)))

    def _common(self, order, h, stop) -> np.ndarray:
        """Common prefix length of neighbours; 0 unless their first ``least`` bytes are equal."""
        if len(order) < 2:
            return np.zeros(len(order) + 1, np.int64)
        a, b = order[:-1], order[1:]
        p, q = self.pos[a], self.pos[b]
        ok = h[a] == h[b]
        for k in [*range(0, self.least - 8, 8), self.least - 8]:         # the hash is checked against the bytes
            ok &= load64(self.text, p + k) == load64(self.text, q + k)
        out = np.where(ok, self.least, 0)
        room = np.minimum(stop[a] - p, stop[b] - q)
        live = np.flatnonzero(ok & (room > self.least))
        while len(live):
            x = self._word(p[live] + out[live], stop[a[live]]) ^ self._word(q[live] + out[live], stop[b[live]])
            low = x & (~x + U(1))                                         # lowest set bit
            more = np.where(x == 0, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64) // 8)
            more = np.minimum(more, room[live] - out[live])
            out[live] += more
            live = live[(more == 8) & (out[live] < room[live])]
        return np.r_[0, out, 0]

    def maximal_repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, from, to): ``sa[from:to]`` are all occurrences of each maximal repeat."""
        n = len(self.sa)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        differs = np.r_[0, (self.left[1:] != self.left[:-1]) | self.fresh[1:] | self.fresh[:-1]]
        turns = np.cumsum(differs)
        found, stack = [], []
        for i, l in enumerate(self.lcp.tolist()):
            left = i - 1
            while stack and stack[-1][0] > l:
                depth, left = stack.pop()
                found.append((depth, left, i))
            if l and (not stack or stack[-1][0] < l):
                stack.append((l, left))
        depth, a, b = np.array(found, np.int64).reshape(-1, 3).T
        some = turns[b - 1] != turns[a]
        return depth[some], a[some], b[some]


def marks(pieces: DataFrame, least: int) -> DataFrame:
    """``MARKS``: for every fragment sent, the windows that a smaller document holds, too."""
    def task(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        doc, code = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in (("docs", np.int64), ("sizes", np.int32)))
        windows, lead = (code >> 1).astype(np.int64), code & 1
        text = np.frombuffer(b"".join(r["text"] for r in rows) + bytes(8), np.uint8)
        size = windows + least - 1 + lead
        start = np.cumsum(size) - size + lead
        iv = Intervals(text, start, windows, lead.astype(bool), least)
        first = np.cumsum(windows) - windows
        edge = np.zeros(int(windows.sum()) + 1, np.int64)
        depth, a, b = iv.maximal_repeats()
        if len(depth):
            own = doc[iv.owner[iv.sa]]
            lowest = np.minimum.reduceat(np.r_[own, np.iinfo(np.int64).max], np.stack([a, b], 1).ravel())[::2]
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            later = own[at] > np.repeat(lowest, n)
            w, d = iv.sa[at[later]], np.repeat(depth, n)[later]
            np.add.at(edge, w, 1)                      # windows w .. w + depth - least lie in the repeat
            np.add.at(edge, w + d - least + 1, -1)
        hit = np.cumsum(edge[:-1]) > 0
        out, f = [], 0
        for r in rows:
            k = len(r["docs"]) // 8
            x = first[f] if f < len(first) else 0
            y = x + int(windows[f:f + k].sum())
            out.append((r["block"], r["range"], 1, np.packbits(hit[x:y]).tobytes(), b"", windows[f:f + k].astype(np.int32).tobytes(), b""))
            f += k
        kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in MARKS.split(", ")])

    return pieces.where("kind = 1").groupBy("range").applyInArrow(task, MARKS)


def removed(table: DataFrame, pieces: DataFrame, marked: DataFrame, least: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every document: ``spans`` the removed byte ranges."""
    notes = pieces.where("kind = 0").select("block", "range", "kind", F.lit(None).cast("binary").alias("bits"), "docs", "sizes", "at")

    def task(block: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(block.to_pylist()[0], least)
        rows = sorted(got.to_pylist(), key=lambda r: (r["kind"], r["range"]))
        edge = np.zeros(b.n + 1, np.int64)
        if rows and len(rows) > 1:
            note, sent = rows[0], rows[1:]
            doc, n = (np.frombuffer(note[c], np.int64) for c in ("docs", "sizes"))
            p, which = np.frombuffer(note["at"], np.int64).reshape(2, -1)
            windows = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in sent]).astype(np.int64)
            hit = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(np.frombuffer(r["sizes"], np.int32).sum()))
                                  for r in sent]).astype(bool)
            first = np.cumsum(windows) - windows
            lead = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])     # runs stand by fragment, smallest document first
            smallest = b.docs[doc[lead]][which]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone = hit[np.repeat(first[which], n) + step] | np.repeat(b.docs[doc] > smallest, n)
            w = (np.repeat(p, n) + step)[gone]
            np.add.at(edge, w, 1)
            np.add.at(edge, w + least, -1)
        out = np.cumsum(edge[:-1]) > 0
        starts = out.copy()
        starts[1:] &= ~out[:-1]
        inner = b.off[:-1][b.sizes > 0]
        starts[inner] = out[inner]
        ends = out.copy()
        ends[:-1] &= ~out[1:]
        ends[b.off[1:][b.sizes > 0] - 1] = out[b.off[1:][b.sizes > 0] - 1]
        x, y = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        doc = np.searchsorted(b.off[1:], x, side="right")
        total = np.r_[0, np.cumsum(out)]
        kept = b.buf[:-8][~out].tobytes()
        cut = b.off - total[b.off]
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(doc, np.arange(len(b.docs) + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(x - b.off[doc]), pa.array(y - b.off[doc])], ["start", "end"]))
        return pa.table([pa.array(b.docs, mask=b.docs == NULL_ID), pa.array(b.sizes), pa.array(np.diff(total[b.off])), spans,
                         pa.array([kept[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                        ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return table.groupBy("block").cogroup(notes.union(marked).groupBy("block")).applyInArrow(
        task, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def dedupe_substrings(docs: DataFrame, least: int = 50, block_bytes: int = 4 << 20, range_bytes: int = 2 << 20,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row.  ``range_bytes``
    is the text whose windows meet in one hash range."""
    if least < 32 or least % 2:
        raise ValueError("least must be even and at least 32")
    spark = docs.sparkSession
    table = written(blocks(docs, block_bytes, id_col, text_col), "blocks")
    size = table.agg(F.sum(F.length("text"))).first()[0] or 0
    n_ranges = 1 + size // range_bytes
    bits = min(64, 16 + max(8, int(size).bit_length()))      # so that an accidental match stays rare at any size
    shared = written(shared_keys(minimiser_keys(table, least, bits, n_ranges)), "shared")
    release(spark)
    pieces = written(fragments(table, shared, least, bits, n_ranges), "fragments")
    release(spark)
    marked = written(marks(pieces, least), "marks")
    release(spark)
    return removed(table, pieces, marked, least)


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    """Contract columns: 50-byte strings, all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedupe_substrings(docs, 50).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                              F.sha2("kept", 256).alias("kept_sha256"))
