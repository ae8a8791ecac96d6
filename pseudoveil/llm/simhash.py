"""SimHash near-duplicate groups with pigeonring candidate filtering.

1. **Fingerprints.**  Per text: 64-bit SimHash of its word shingles (XXH64,
   seed 42).  A bit is set when more than half of the shingle hashes set it.
   Computed in Arrow tasks with numpy; only (doc_id, fingerprint) leaves.
2. **Distinct fingerprints.**  Equal fingerprints collapse to their smallest
   doc_id first, so any number of copies costs one row from here on.  The
   fingerprint itself is the node.
3. **Pigeonring.**  The 64 bits form a ring of ``segments`` equal segments.  If
   two fingerprints differ in at most ``max_bits`` bits there is a start
   segment from which, for every chain length l, the first l segments differ
   in at most ``l * max_bits / segments`` bits together.  The longest chain
   whose budget rounds down to zero must be *equal*: those bits are the
   equi-join key, one key per start.  Longer chains are checked on the
   candidate pairs with their proportional budgets, then the full distance.
4. **Crowded keys.**  A key shared by more than ``pair_limit`` distinct
   fingerprints is not paired up.  Its fingerprints are linked exactly through
   shared neighbours instead: two values within ``max_bits`` bits share a value
   that is at most ``max_bits / 2`` (rounded up) flips from both, and such a
   value has a bounded number of fingerprints around it.  Work stays linear in
   the crowd and no link is lost.
5. **Components.**  Links feed the connected-components job; each document
   gets the smallest doc_id it can reach.

Defined results: a null, empty or word-free text has fingerprint zero and is
linked like any other; a row without a doc_id links like any other and gets the
smallest doc_id of its group, null if there is none; a text with fewer words than a shingle hashes its whole
word sequence; repeated rows of a doc_id give repeated result rows; an empty
table gives no rows; columns other than ``id_col`` and ``text_col`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import components, written
from .words import Spans, text_slices, words, xxh64

CHUNK = 1 << 16        # shingles whose bits are unpacked at once


def joined_words(w: Spans) -> tuple[np.ndarray, np.ndarray]:
    """The words written one after another, one space after each: (buffer, new start of each word)."""
    n = w.end - w.start
    at = np.cumsum(n + 1) - (n + 1)
    buf = np.full(int((n + 1).sum()) + 8, 0x20, np.uint8)
    total = int(n.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    buf[np.repeat(at, n) + inner] = w.buf[np.repeat(w.start, n) + inner]
    return buf, at


def fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    """SimHash of every text of an Arrow string column."""
    w = words(column)
    out = np.zeros(w.n_docs, np.uint64)
    if not len(w.start):
        return out
    buf, at = joined_words(w)
    stop = at + (w.end - w.start)
    count = w.per_doc()
    first = np.cumsum(count) - count
    n_sh = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(w.n_docs), n_sh)
    word = np.repeat(first - (np.cumsum(n_sh) - n_sh), n_sh) + np.arange(len(doc))
    last = word + np.minimum(count[doc], shingle) - 1
    h = xxh64(buf, at[word], stop[last])
    bits = np.zeros((w.n_docs, 64), np.int64)
    for a in range(0, len(h), CHUNK):
        part, d = h[a:a + CHUNK], doc[a:a + CHUNK]
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        bits[d[cut]] += np.add.reduceat(ones, cut, axis=0, dtype=np.int32)
    on = (2 * bits > n_sh[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, fp): the signed 64-bit fingerprint of every row; ``body``: hash of its text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                fp = fingerprints(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fp.view(np.int64))], ["doc_id", "body", "fp"])

    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body"))
    return rows.mapInArrow(task, "doc_id long, body long, fp long")


def rotate(fp: Column, bits: int) -> Column:
    """Rotate right, so that the segment at ``bits`` comes first (lowest)."""
    if bits == 0:
        return fp
    return F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, 64 - bits))


def chain_budgets(segments: int, max_bits: int) -> list[int]:
    """Whole differing bits allowed in the first l segments, l = 1..segments."""
    return [l * max_bits // segments for l in range(1, segments + 1)]


def mask(bits: int) -> int:
    return -1 if bits >= 64 else (1 << bits) - 1


def links(fps: DataFrame, max_bits: int = 2, segments: int = 16, pair_limit: int = 32) -> DataFrame:
    """All links between distinct fingerprints as (a, b), node = ``node`` of ``fps`` (fp, node)."""
    if 64 % segments or not 0 < max_bits < segments:
        raise ValueError("segments must divide 64 and exceed max_bits")
    width, budgets = 64 // segments, chain_budgets(segments, max_bits)
    equal = sum(b == 0 for b in budgets)                     # segments that must match exactly
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), rotate(F.col("fp"), i * width).alias("r")) for i in range(segments)])
    keyed = fps.select("node", "fp", F.inline(turns)).select(
        "node", "fp", "turn", F.col("r").bitwiseAND(F.lit(mask(equal * width))).alias("key"))
    sizes = keyed.groupBy("turn", "key").count()
    few = sizes.where(F.col("count").between(2, pair_limit)).select("turn", "key")
    many = sizes.where(F.col("count") > pair_limit).select("turn", "key")

    # Pairs of the small keys; every chain longer than the key keeps its budget.
    small = keyed.join(few, ["turn", "key"])
    pairs = small.alias("x").join(small.alias("y"), ["turn", "key"]).where("x.fp < y.fp").select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), "turn",
        F.col("x.fp").bitwiseXOR(F.col("y.fp")).alias("diff"))
    ring = F.lit(0).cast("long")
    for i in range(segments):
        ring = F.when(F.col("turn") == i, rotate(F.col("diff"), i * width)).otherwise(ring)
    pairs = pairs.withColumn("ring", ring)
    for l in range(equal + 1, segments + 1):
        if l == segments or budgets[l - 1] != budgets[l]:    # the longest chain of each budget implies the shorter ones
            pairs = pairs.where(F.bit_count(F.col("ring").bitwiseAND(F.lit(mask(l * width)))) <= budgets[l - 1])
    pairs = pairs.select("a", "b")

    # Crowded keys: fingerprints meet at values half the distance away.
    crowd = keyed.join(many, ["turn", "key"]).select("node", "fp").distinct()
    near = crowd.select("node", F.explode(_flips(F.col("fp"), (max_bits + 1) // 2)).alias("value"))
    if max_bits % 2:
        raise ValueError("crowded keys are exact for even max_bits only")
    low = near.groupBy("value").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(low, "value").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return pairs.union(stars).distinct()


def _flips(fp: Column, depth: int) -> Column:
    """``fp`` and all values at most ``depth`` bit flips away (each once)."""
    patterns, last = [0], [(0, -1)]
    for _ in range(depth):
        last = [(p | 1 << i, i) for p, top in last for i in range(top + 1, 64)]
        patterns += [p for p, _ in last]
    signed = [p - (1 << 64) if p >> 63 else p for p in patterns]
    return F.transform(F.array(*[F.lit(p).cast("long") for p in signed]), lambda p: fp.bitwiseXOR(p))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, segments: int = 16, pair_limit: int = 32,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, fp, group, component_id) for every row of ``docs``.  ``group``: the component by
    fingerprints alone, which rows that share a doc_id do not join."""
    fp = written(simhash(docs, shingle, id_col, text_col), "simhash")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    found = components(links(distinct.select(F.col("fp").alias("node"), "fp"), max_bits, segments, pair_limit))
    grouped = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("group"))
    grouped = written(grouped, "fingerprint-groups")
    lows = grouped.groupBy("group").agg(F.min("low").alias("component_id"))
    return fp.join(grouped.join(lows, "group").drop("low"), "fp", "left").select("doc_id", "body", "fp", "group", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract columns: 3-word shingles, links at two or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, max_bits=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near copies: one row of each group stays, the one with the smallest doc_id (of
    rows that share it, the smallest text hash; of equal rows, any); a row without a doc_id only if no row of
    its group has one."""
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    rows = groups.groupBy("group", "doc_id", "body").agg(F.count("*").alias("n"))
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body", "n")).alias("r"))
    kept = written(first.select(F.col("r.doc_id").alias("__id"), F.col("r.body").alias("__body"), F.col("r.n").alias("__n")), "kept")

    def of(rows: DataFrame, which: DataFrame) -> DataFrame:
        same = rows[id_col].cast("long").eqNullSafe(which["__id"]) & (F.xxhash64(rows[text_col].cast("string")) == which["__body"])
        return rows.join(which, same, "left_semi")

    repeated = kept.where("__n > 1")
    out = of(docs, kept.where("__n = 1"))
    if repeated.isEmpty():
        return out
    return out.union(of(docs, repeated).dropDuplicates([id_col, text_col]))
