"""Benchmark decontamination with a distributed positional inverted index.

1. **Index.**  Each Arrow slice of documents is one shard.  A shard stores, for
   every term of the benchmark vocabulary, the sorted list of its word
   positions (one sorted array of ``term, position`` keys) and its documents.
   Shards are written to the shared folder; term frequencies over the whole
   corpus are summed by Spark.
2. **Search.**  The benchmark windows are the query set.  In every shard each
   window starts from the postings of its rarest term and intersects the
   offset-adjusted lists of the others in order of rarity.  A window whose
   terms all stand at their offsets is an exact phrase; one whose terms all
   stand within ``slop`` words of them is a proximity match.
3. A word inside an exact phrase is hit.

The benchmark is sent to the tasks in blocks of about ``block_words`` words
(counted first), so what is broadcast is bounded however large it is.
Documents are never joined, shuffled or cut.

Defined results: null text has no words; an item without words matches
nothing; an item of fewer than ``window`` words is one window; equal windows of
several items count for each; rows that share a doc_id are separate rows; an
empty benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import ALNUM, text_slices, words, xxh64

NULL_ID = -(1 << 63)                 # stands for a null doc_id inside a shard
EXPAND = 1 << 20                     # (window, posting) pairs looked at together
SHARD = "docs binary, rows binary, n_words binary, postings binary"
HITS = "doc_id long, row long, n_words long, spans array<struct<start:long,end:long>>, items array<long>, near array<long>"


@dataclass
class Queries:
    """Distinct windows of a block of items."""
    vocabulary: np.ndarray           # uint64, sorted word hashes
    terms: np.ndarray                # (windows, window) term numbers, -1 beyond a short window
    size: np.ndarray                 # words of each window
    item_of: np.ndarray              # item ids, grouped by window
    item_at: np.ndarray              # offsets into item_of

    @staticmethod
    def build(items: pa.Table, window: int) -> Queries:
        w = words(items.column("text").combine_chunks(), ALNUM)
        h = xxh64(w.buf, w.start, w.end)
        vocabulary = np.unique(h)
        term = np.searchsorted(vocabulary, h)
        count = w.per_doc()
        first = np.cumsum(count) - count
        n = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(count)), n)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(doc))
        size = np.minimum(count[doc], window)
        grid = np.full((len(doc), window), -1, np.int64)
        for k in range(window):
            ok = k < size
            grid[ok, k] = term[at[ok] + k]
        distinct, back = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        ids = items.column("item_id").to_numpy()[doc]
        pair = np.unique(np.stack([back.ravel(), ids], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        return Queries(vocabulary, distinct, (distinct >= 0).sum(1), pair[:, 1],
                       np.searchsorted(pair[:, 0], np.arange(len(distinct) + 1)))

    def items(self, window: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every item of the windows ``window[pick]``: (pick repeated, place in item_of)."""
        low = self.item_at[window[pick]]
        n = self.item_at[window[pick] + 1] - low
        return np.repeat(pick, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def build_shards(rows: DataFrame, vocabulary: np.ndarray, gap: int) -> DataFrame:
    """One row per shard of ``rows`` (doc_id, row, text)."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = words(part.column(2), ALNUM)
                h = xxh64(w.buf, w.start, w.end)
                term = np.searchsorted(voc, h)
                known = np.flatnonzero(voc[np.minimum(term, len(voc) - 1)] == h) if len(voc) else np.zeros(0, np.int64)
                position = known + gap * w.doc[known]        # documents are ``gap`` words apart
                keys = np.sort((term[known] << 40) | position)
                ids = [part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (*ids, w.per_doc(), keys)],
                                                 ["docs", "rows", "n_words", "postings"])

    return rows.mapInArrow(task, SHARD)


def term_counts(shards: DataFrame, n_terms: int) -> np.ndarray:
    """Corpus frequency of every term of the block (bounded by its vocabulary)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), np.int64) >> 40, minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in shards.select("postings").mapInArrow(task, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


def find(postings: np.ndarray, q: Queries, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start position, exact) of every phrase and proximity match."""
    lead = order[:, 0]
    rare = q.terms[np.arange(len(q.terms)), lead]
    low = np.searchsorted(postings, rare << 40)
    count = np.searchsorted(postings, (rare + 1) << 40) - low
    found = []
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EXPAND, side="right")))
        win = np.repeat(np.arange(a, b), count[a:b])
        nth = np.arange(len(win)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
        start = (postings[low[win] + nth] & ((1 << 40) - 1)) - lead[win]
        exact = np.ones(len(win), bool)
        for k in range(1, q.terms.shape[1]):
            more = k < q.size[win]
            offset = order[win, k]
            want = (q.terms[win, offset] << 40) | np.maximum(start + offset, 0)
            at = np.searchsorted(postings, want)
            right = postings[np.minimum(at, len(postings) - 1)] - want
            left = want - postings[np.maximum(at - 1, 0)]
            right = np.where((at < len(postings)) & (right >= 0), right, slop + 1)
            left = np.where((at > 0) & (left >= 0), left, slop + 1)
            miss = np.where(more, np.minimum(left, right), 0)
            exact &= miss == 0
            ok = miss <= slop
            win, start, exact = win[ok], start[ok], exact[ok]
            if not len(win):
                break
        found.append((win, start, exact))
        a = b
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(shards: DataFrame, q: Queries, counts: np.ndarray, gap: int, slop: int) -> DataFrame:
    """``HITS`` rows of all documents of the shards."""
    frequency = np.where(q.terms >= 0, counts[q.terms], np.iinfo(np.int64).max)
    held = shards.sparkSession.sparkContext.broadcast((q, np.argsort(frequency, axis=1, kind="stable")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, order = held.value
        for batch in batches:
            for shard in batch.to_pylist():
                docs, rows, n_words, postings = (np.frombuffer(shard[c], np.int64) for c in ("docs", "rows", "n_words", "postings"))
                base = np.cumsum(n_words) - n_words + gap * np.arange(len(docs))
                if len(postings) and len(query.terms):
                    win, start, exact = find(postings, query, order, slop)
                else:
                    win, start, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
                doc = np.searchsorted(base, np.maximum(start, 0), side="right") - 1
                spans: list = [[] for _ in docs]
                items: list = [[] for _ in docs]
                near: list = [[] for _ in docs]
                hit = np.flatnonzero(exact)
                hit = hit[np.argsort(start[hit], kind="stable")]
                for d, s, e in merged(doc[hit], start[hit] - base[doc[hit]], query.size[win[hit]]):
                    spans[d].append({"start": s, "end": e})
                for picked, into in ((exact, items), (~exact, near)):
                    pick, at = query.items(win, np.flatnonzero(picked))
                    pair = np.unique(np.stack([doc[pick], query.item_of[at]], 1), axis=0) if len(at) else np.zeros((0, 2), int)
                    for d, item in pair.tolist():
                        into[d].append(item)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == NULL_ID), pa.array(rows), pa.array(n_words), pa.array(spans, span),
                     pa.array(items, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))],
                    ["doc_id", "row", "n_words", "spans", "items", "near"])

    return shards.mapInArrow(task, HITS)


def merged(doc, start, size):
    """Unite overlapping or touching ranges of each document (sorted by document and start)."""
    if not len(doc):
        return
    end = start + size
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * wide + end)               # documents never touch: wide exceeds any end
    new = np.r_[True, doc[1:] * wide + start[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    last = reach[np.r_[at[1:] - 1, len(doc) - 1]]
    yield from zip(doc[at].tolist(), start[at].tolist(), (last - doc[at] * wide).tolist(), strict=True)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, block_words: int = 500_000,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items, near) of every row of ``docs``: hit word
    ranges, items with an exact phrase, items with only a proximity match."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = 1 + size // block_words
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       F.monotonically_increasing_id().alias("row"), docs[text_col].cast("string").alias("text"))
    if blocks > 1:
        rows = written(rows, "decontaminate")                    # row numbers must agree between the blocks
    gap = window + 2 * slop + 1
    parts = []
    for b in range(blocks):
        q = Queries.build(items.where(F.pmod(F.hash("item_id"), F.lit(blocks)) == b).toArrow(), window)
        shards = written(build_shards(rows, q.vocabulary, gap), "index")
        parts.append(search(shards, q, term_counts(shards, len(q.vocabulary)), gap, slop))
    out = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            out = out.union(p)
        flat = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  one entry per block
        out = out.groupBy("doc_id", "row").agg(F.first("n_words").alias("n_words"), flat("spans"), flat("items"), flat("near"))
    return out.select("doc_id", "n_words", "spans", "items", "near")


def hit_words(spans):
    """Words inside the union of sorted ranges."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], s["end"]).alias("end")), lambda acc: acc["n"])


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contract columns: windows of 10 words, all documents against all items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))
