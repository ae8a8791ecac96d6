"""Language identification by prediction by partial matching (PPM).

Every language has a variable-order byte context tree: symbol counts after the
last 3, 2, 1 and 0 bytes.  A symbol is coded in the longest context that the
tree holds; if it was never seen there, an escape is coded and the next shorter
context is tried, down to a uniform code over all byte values (escape method C:
``distinct / (total + distinct)``).  The statistics are frozen after training,
so the code length of a symbol depends on its last three bytes only and a text
is scored by table look-ups: exact code lengths, one numpy pass per language
set, whole texts.

A context is the last byte, the class of the byte before it (its low five bits) and the
class of the one before that (its low three bits), so there are 2**16 contexts of order 3
in all, whatever the input: no context is dropped, and rare ones share the statistics of
their class.  Lower-case ASCII letters have classes of their own in order 2.

Training counts (context, symbol) pairs per language over *all* labelled rows given
(combined in the task, then by Spark) and written once.  These counts are the tree and
reach the driver; there are 2**24 a language at most, and as many as a language uses.

Bytes are folded first: A-Z to lower case, digits to ``0``, white space to one
symbol.  Each text starts after three spaces.

Defined results: null text or text without a letter gives ``und`` with score
0; an empty training set gives ``und`` for every row; equal code lengths go to
the language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_slices, utf8

UND = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[0x30:0x3A] = 0x30
_FOLD[0x09:0x0E] = 0x20
LETTER = r"\p{L}"


SECOND, THIRD = 0x1FFF, 0xFFFF       # bits of the contexts of order 2 and 3
_CLASS = {1: (0xFF, 8), 2: (0x1F, 5), 3: (0x07, 3)}     # kept bits of the byte so far back, and their number


def contexts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of order 3 as uint32, symbol, text offsets) of all bytes."""
    buf, off = utf8(column)
    b = _FOLD[buf[:-8]]
    n = len(b)
    ctx = np.zeros(n, np.uint32)
    start = off[:-1]
    for back in (3, 2, 1):
        prev = np.full(n, 0x20, np.uint8)
        prev[back:] = b[:n - back] if n > back else b[:0]
        for k in range(back):                      # bytes before the text are spaces
            at = start + k
            prev[at[at < off[1:]]] = 0x20
        keep, bits = _CLASS[back]
        ctx = (ctx << np.uint32(bits)) | (prev & np.uint8(keep))
    return ctx, b, off


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts (or summed weights)."""
    if weights is None:
        s = np.sort(keys)
        cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        return s[cut], np.diff(np.r_[cut, len(s)]).astype(np.int64)
    order = np.argsort(keys)
    s = keys[order]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[cut], np.add.reduceat(weights[order], cut) if len(s) else weights


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of ``rows`` (text, lang): context << 8 | symbol, with counts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                langs = np.array(part.column(1).to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    ctx, sym, _ = contexts(part.column(0).filter(pa.array(langs == lang)))
                    k, n = tally((ctx.astype(np.uint64) << np.uint64(8)) | sym)
                    if lang in held:
                        k, n = np.r_[held[lang][0], k], np.r_[held[lang][1], n]
                        k, n = tally(k, n)
                    held[lang] = k, n
        for lang, (k, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(n)],
                                             ["lang", "gram", "n"])

    return rows.select("text", "lang").mapInArrow(task, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of all languages as code-length tables (bits)."""

    def __init__(self, langs, symbol, second, third, cost):
        self.langs, self.symbol, self.second, self.third, self.cost = langs, symbol, second, third, cost

    def parts(self) -> tuple:
        return self.langs, self.symbol, self.second, self.third, self.cost

    @staticmethod
    def build(counts: pd.DataFrame) -> Model | None:
        """``counts``: lang, gram, n.  None if there is nothing to learn from."""
        if not len(counts):
            return None
        langs = sorted(counts["lang"].unique())
        lang = np.searchsorted(langs, counts["lang"].to_numpy().astype(str)).astype(np.int64)
        high = lang, counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        used = np.unique(high[1] & 255)
        symbol = np.full(256, len(used), np.int16)           # the last class: bytes never coded in training
        symbol[used] = np.arange(len(used))
        n_sym, n_lang = len(used) + 1, len(langs)
        c3 = np.unique(high[1] >> 8)
        c2 = np.unique(c3 & SECOND)

        def level(counts, nodes, mask, lower):
            """Code lengths of one order from its counts and those of the order below."""
            lang, gram, n = counts
            c = np.zeros((len(nodes), n_sym, n_lang), np.float32)
            np.add.at(c, (np.searchsorted(nodes, gram >> 8 & mask), symbol[gram & 255], lang), n)
            total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                coded = -np.log2(c / (total + kinds))
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            return np.where(c > 0, coded, escape + lower).astype(np.float32)

        uniform = np.full((1, n_sym, n_lang), 8.0, np.float32)
        zero = level(high, np.zeros(1, np.int64), 0, uniform)
        one = level(high, np.arange(256), 0xFF, zero)
        two = level(high, c2, SECOND, one[c2 & 0xFF])
        three = level(high, c3, THIRD, two[np.searchsorted(c2, c3 & SECOND)])
        # Rows of ``cost``: order-3 nodes, then order-2 nodes, then order-1 nodes.
        second = (len(c3) + len(c2) + (np.arange(SECOND + 1) & 0xFF)).astype(np.int32)
        second[c2] = len(c3) + np.arange(len(c2))
        return Model(langs, symbol, second, c3.astype(np.uint32), np.concatenate([three, two, one]))

    def code_lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits of every text in every language, bytes of every text)."""
        ctx, sym, off = contexts(column)
        node = self._nodes(ctx)
        bits = self.cost[node, self.symbol[sym]]
        out = np.zeros((len(off) - 1, len(self.langs)))
        filled = np.flatnonzero(off[1:] > off[:-1])
        if len(filled):
            out[filled] = np.add.reduceat(bits, off[:-1][filled], axis=0, dtype=np.float64)
        return out, np.diff(off)

    def _nodes(self, ctx: np.ndarray) -> np.ndarray:
        """Row of ``cost`` for every context: two table look-ups."""
        two = self.second[ctx & np.uint32(SECOND)]
        if not hasattr(self, "_grid"):
            n3 = len(self.third)
            lows = np.arange(n3, int(self.second.max()) + 1)
            # (order-2 or order-1 node, class of the third last byte) -> node
            grid = np.repeat(lows.astype(np.int32)[:, None], 8, axis=1)
            grid[self.second[self.third & SECOND] - n3, self.third >> 13] = np.arange(n3)
            self._grid = grid
        return self._grid[two - len(self.third), ctx >> np.uint32(13)]


def train(labelled: DataFrame) -> Model | None:
    """Fit on every row of ``labelled`` (text, lang)."""
    rows = labelled.where("text is not null and lang is not null")
    return Model.build(gram_counts(rows).toPandas())


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row.  ``score`` is the
    posterior of the language under equal priors, ``2**-bits`` as likelihood."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model and model.parts())       # 2**16 contexts; plain arrays, so that executors need no package
    schema = rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value and Model(*held.value)
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                text = part.column(1)
                n = part.num_rows
                pred, score, rate = np.full(n, UND, dtype=object), np.zeros(n), np.zeros(n)
                if m is not None:
                    letter = pc.match_substring_regex(text, LETTER).fill_null(False).to_numpy(zero_copy_only=False)
                    bits, size = m.code_lengths(text)
                    best = bits.argmin(1)
                    low = bits[np.arange(n), best]
                    with np.errstate(under="ignore"):
                        p = 1 / np.exp2(low[:, None] - bits).sum(1)
                    pred = np.where(letter, np.array(m.langs, dtype=object)[best], UND)
                    score = np.where(letter, p, 0.0)
                    rate = low / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)],
                                                 ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(task, schema)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op5_langid(spark, sf_dir: str) -> DataFrame:
    """Contract columns; rows whose crc32(doc_id) mod 5 is 0 are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).select("text", "lang"))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
