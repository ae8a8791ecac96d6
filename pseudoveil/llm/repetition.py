"""Quality rules with suffix-array repetition inside each text.

Base figures per text (words, symbols, duplicated lines, words in repeated
5-word windows) come first.  The method then finds the maximal repeated word
substrings of each text:

1. prefix doubling over word ranks: suffixes are placed by their first 1, 2, 4,
   ... words; only positions whose window is repeated in its own text go on, and
   a suffix that becomes the only one of its group has its final place;
2. the suffixes that share at least ``min_words`` words with another suffix of
   the text form the suffix array, in the order of their places; common-prefix
   lengths of neighbours are read off the ranks of the doubling levels;
3. a stack scan of those lengths yields the longest-common-prefix intervals;
   an interval whose occurrences are not all preceded by the same word is a
   maximal repeat;
4. the occurrences of all maximal repeats are united per text; a text is kept
   if the covered share of its word characters is at most ``max_covered`` and
   its longest repeat at most ``max_longest`` of them.

Texts never interact, so a slice of an Arrow batch is processed at once and
nothing is shuffled.

Defined results: a null, empty or word-free text has all figures zero and
fails the base rule; repeated rows give repeated results; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import NOT_SPACE, Spans, byte_class, mix64, text_slices, utf8, words, xxh64

SYMBOLS = byte_class(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, covered double, longest double, n_repeats long")


def duplicated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def covered_words(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """True for every word inside one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


class SuffixArray:
    """Suffixes of all texts of a slice that share ``least`` or more words with
    another suffix of their text.  ``key``: one 64-bit value per word, equal
    only for equal words of one text; ``stop``: end of each word's text."""

    def __init__(self, key: np.ndarray, stop: np.ndarray, least: int):
        n = len(key)
        self.n, self.stop = n, stop
        alone = -1 - np.arange(n)                   # level rank of a window that is not repeated
        order = np.argsort(key, kind="stable")
        place = np.empty(n, np.int64)               # place of each suffix in the order by the words compared so far
        place[order] = self._first(key[order])
        alive = np.flatnonzero(duplicated(key))
        self.levels: dict[int, np.ndarray] = {}
        self._level(1, alone, alive, place)
        h, self.at = 1, alive if least == 1 else alive[:0]
        while len(alive):
            # Suffixes alone have their final place; the others of a group are ordered by the places h words on.
            nxt = np.full(len(alive), -1, np.int64)          # a suffix that ends here comes first
            more = alive + h < stop[alive]
            nxt[more] = place[alive[more] + h]
            pair = place[alive] * np.int64(n + 1) + nxt + 1
            order = np.argsort(pair, kind="stable")
            alive, pair = alive[order], pair[order]
            group, same = self._first(place[alive]), self._first(pair)
            place[alive] += same - group
            alive = np.sort(alive[duplicated(pair)])
            h *= 2
            if len(alive):
                self._level(h, alone, alive, place)
            if h == least:
                self.at = alive
        self.sa = self.at[np.argsort(place[self.at])]
        a, b = self.sa[:-1], self.sa[1:]
        self.lcp = np.r_[0, self.common(a, b), 0] if len(self.sa) else np.zeros(1, np.int64)

    @staticmethod
    def _first(x: np.ndarray) -> np.ndarray:
        """Index of the first equal value, for every element of a sorted array."""
        start = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
        return np.maximum.accumulate(np.where(start, np.arange(len(x)), 0))

    def _level(self, h: int, alone: np.ndarray, alive: np.ndarray, place: np.ndarray):
        """Keep the ranks of the repeated windows of ``h`` words."""
        rank = alone.copy()
        rank[alive] = place[alive]
        self.levels[h] = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix length of the suffixes at a and b, longest levels first."""
        out = np.zeros(len(a), np.int64)
        for h in sorted(self.levels, reverse=True):
            p, q = a + out, b + out
            ok = np.flatnonzero((p < self.n) & (q < self.n) & (p + h <= self.stop[a]) & (q + h <= self.stop[b]))
            rank = self.levels[h]
            hit = ok[(rank[p[ok]] >= 0) & (rank[p[ok]] == rank[q[ok]])]
            out[hit] += h
        return out

    def maximal_repeats(self, key: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int]]:
        """(length, from, to) of every maximal repeat: ``sa[from:to]`` are its occurrences."""
        before = np.where(self.sa > first[self.sa], key[self.sa - 1], np.uint64(0)) if len(self.sa) else self.sa
        begins = self.sa == first[self.sa]
        # turns[i]: number of left-extension changes up to i
        change = np.r_[True, (before[1:] != before[:-1]) | begins[1:] | begins[:-1]] if len(self.sa) else np.zeros(0, bool)
        turns = np.cumsum(change)
        out, stack = [], []
        for i, l in enumerate(self.lcp.tolist()):
            left = i - 1
            while stack and stack[-1][0] > l:
                depth, left = stack.pop()
                if depth >= least and turns[i - 1] != turns[left]:
                    out.append((depth, left, i))
            if l >= least and (not stack or stack[-1][0] < l):
                stack.append((l, left))
        return out


def innermost(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Depth of the innermost interval (depth, from, to) at each of n places, 0 outside.  The intervals nest, so a
    sweep over their starts writes every place once, however deep they lie."""
    out, at, opened = np.zeros(n, np.int64), 0, []

    def close(until):
        nonlocal at
        while opened and opened[-1][1] <= until:
            depth, end = opened.pop()
            out[at:end] = depth
            at = max(at, end)

    for depth, a, b in sorted(found, key=lambda r: (r[1], -r[2])):
        close(a)
        if opened:
            out[at:a] = opened[-1][0]
        at = a
        opened.append((depth, b))
    close(n)
    return out


def measure(column: pa.Array, window: int, min_words: int) -> dict[str, np.ndarray]:
    """All figures of every text of a string column."""
    w = words(column, NOT_SPACE, lower=False)
    n_docs, n = w.n_docs, len(w.start)
    buf, off = utf8(column)
    lead = (buf[:-8] & 0xC0) != 0x80                       # first byte of every code point
    upto = np.r_[0, np.cumsum(lead)]
    chars = upto[w.end] - upto[w.start]
    per = lambda x: np.bincount(w.doc, weights=x, minlength=n_docs).astype(np.int64)
    symbols = np.r_[0, np.cumsum(SYMBOLS[buf[:-8]])]
    n_words = w.per_doc()
    first = (np.cumsum(n_words) - n_words)[w.doc]
    stop = np.cumsum(n_words)[w.doc]

    h = xxh64(w.buf, w.start, w.end)
    with np.errstate(over="ignore"):
        key = mix64(h ^ mix64(w.doc.astype(np.uint64) + np.uint64(1)))
        roll = np.zeros(max(n - window + 1, 0), np.uint64)
        for k in range(window):
            roll = mix64(roll * np.uint64(31) + key[k:k + len(roll)])
    at = np.flatnonzero(np.arange(len(roll)) + window <= stop[:len(roll)])
    at = at[duplicated(roll[at])]
    repeat = covered_words(at, np.full(len(at), window), n)

    sa = SuffixArray(key, stop, min_words)
    found = sa.maximal_repeats(key, first, min_words)
    length = innermost(found, len(sa.sa))                  # longest maximal repeat at every suffix
    n_repeats, longest = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    sums = np.r_[0, np.cumsum(chars)]
    for depth, a, b in found:
        doc, p = w.doc[sa.sa[a]], sa.sa[a]
        n_repeats[doc] += 1
        longest[doc] = max(longest[doc], sums[p + depth] - sums[p])
    cover = covered_words(sa.sa[length > 0], length[length > 0], n)
    word_chars = per(chars)
    size = np.maximum(word_chars, 1)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
            "n_dup_lines": duplicate_lines(buf, off, w), "n_repeat_words": per(repeat), "n_repeats": n_repeats,
            "covered": per(chars * cover) / size, "longest": longest / size}


def duplicate_lines(buf: np.ndarray, off: np.ndarray, w: Spans) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(buf) - 8
    cut = np.unique(np.r_[np.flatnonzero(buf[:n] == 10) + 1, off[:-1]])      # line starts
    cut = cut[cut <= n]
    line = np.unique(np.searchsorted(cut, w.start, side="right") - 1)       # lines with a word
    start = cut[line]
    nl = np.flatnonzero(buf[:n] == 10)
    end_nl = np.r_[nl, n][np.searchsorted(nl, start)]
    doc = np.searchsorted(off[1:], start, side="right")
    end = np.minimum(end_nl, off[1:][doc])
    h = mix64(xxh64(buf, start, end) ^ mix64(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h)
    again = h[order][1:] == h[order][:-1]
    return np.bincount(doc[order][1:][again], minlength=len(off) - 1).astype(np.int64)


def quality(docs: DataFrame, window: int = 5, min_words: int = 8, max_repeat_percent: int = 20, least_words: int = 10,
            max_covered: float = 0.15, max_longest: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``SCHEMA`` for every row.  ``min_words`` must be a power of two."""
    if min_words < 1 or min_words & (min_words - 1):
        raise ValueError("min_words must be a power of two")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["doc_id"] + [x.split()[0] for x in SCHEMA.split(", ")]
    schema = rows.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", " + SCHEMA

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                m = measure(part.column(1), window, min_words)
                m["doc_id"] = part.column(0)
                m["base_failed"] = (m["n_words"] < least_words) | (
                    100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
                m["kept"] = ~m["base_failed"] & (m["covered"] <= max_covered) & (m["longest"] <= max_longest)
                yield pa.RecordBatch.from_arrays([pa.array(m[c]) for c in names], names)

    return rows.mapInArrow(task, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all documents."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
