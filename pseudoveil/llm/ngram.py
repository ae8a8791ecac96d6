"""Language-model scoring by deleted interpolation of n-gram estimates.

A token is scored by a mixture of maximum-likelihood estimates of falling
order: the bigram ``c(u, v) / c(u)``, the unigram ``c(v) / N`` and the uniform
``1 / (V + 1)`` over the known tokens and one unknown token.  The mixture
weights depend on the frequency of the context u (one set per power of two) and
are learned by expectation-maximisation: a part of the training documents is
deleted from the counts and predicted by what remains.

Counting and looking up all n-grams of a corpus is one exchange:

1. Documents are cut into *blocks* (slices of an Arrow batch), written once with
   token numbers, so every later step sees the same blocks.
2. A block asks for its distinct words and bigrams (64-bit hashes with its own
   counts), split by hash range.  Repeats inside a block are combined first, so
   the word or pair that fills a third of the corpus is one entry per block.
3. Each hash range adds the counts of all blocks and answers every block in the
   order it asked.
4. Blocks meet their answers twice: once for the deleted documents, giving the
   (bucket, bigram, unigram) estimates that the distributed EM runs over; once
   to score all documents.

No vocabulary is broadcast or collected; what reaches the driver is N, V and
three weights per bucket.

Defined results: null or empty text is the end token alone; without training
documents every probability is uniform; rows that share a doc_id are scored
separately; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, written
from .words import NOT_SPACE, dense, mix64, text_slices, words, xxh64

NULL_ID = -(1 << 63)
UNSEEN, TRAIN, DELETED = 0, 1, 2         # parts: not learned from, kept in the counts, deleted from them for EM
END = np.uint64(0x9D39247E33776D41)      # symbols that are no word
START = np.uint64(0x2AF7398005AAA5C7)
BLOCK = "block long, docs binary, parts binary, sizes binary, words binary, tokens binary"
ASK = "range int, block long, kind int, keys binary, train binary, deleted binary"
ANSWER = "block long, range int, kind int, train binary, deleted binary, known long"


def ints(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(b, dtype)


def small(a: np.ndarray) -> bytes:
    """Counts as bytes in the narrowest width; the width is the first byte."""
    top = int(a.max()) if len(a) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def blocks(docs: DataFrame, part, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """``BLOCK`` rows: documents with their tokens as numbers of the block's sorted words."""
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       docs[text_col].cast("string").alias("text"), part.cast("byte").alias("part"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in text_slices(batch, "text", block_bytes):
                w = words(piece.column(1), NOT_SPACE)
                n = w.per_doc()
                h = np.insert(xxh64(w.buf, w.start, w.end), np.cumsum(n), END)      # one end after every document
                known, at = dense(h)
                cols = [piece.column(0).to_numpy().astype(np.int64), piece.column(2).to_numpy().astype(np.uint8), n + 1,
                        known, at.astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([number])] + [pa.array([c.tobytes()], pa.binary()) for c in cols],
                                                 [x.split()[0] for x in BLOCK.split(", ")])
                number += 1

    return rows.mapInArrow(task, BLOCK)


class Block:
    """The arrays of one ``BLOCK`` row."""

    def __init__(self, r: dict):
        self.docs, self.sizes = ints(r["docs"], np.int64), ints(r["sizes"], np.int64)
        self.words, self.tokens = ints(r["words"], np.uint64), ints(r["tokens"], np.uint32)
        self.part = np.repeat(ints(r["parts"], np.uint8), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty(len(self.tokens), np.int64)            # context token, -1 at the start of a document
        self.before[1:] = self.tokens[:-1]
        self.before[first] = -1

    def pairs(self) -> np.ndarray:
        """Hash of (context, token) of every token."""
        v = self.words[self.tokens]
        u = np.where(self.before >= 0, self.words[self.before], START)
        with np.errstate(over="ignore"):
            return mix64(mix64(u) + v)


def counted(at: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(training count, deleted count) of every number."""
    deleted = np.bincount(at[part == DELETED], minlength=n)
    return np.bincount(at[part == TRAIN], minlength=n) + deleted, deleted


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where sorted 64-bit keys are cut into n hash ranges."""
    of = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(n + 1, dtype=np.uint64))


def asked(table: DataFrame, n_ranges: int) -> DataFrame:
    """``ASK`` rows: distinct words (kind 1) and bigrams (kind 2) of every block by hash range."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                keys, at = dense(b.pairs())
                for kind, k, a in ((1, b.words, b.tokens), (2, keys, at)):
                    train, deleted = counted(a, b.part, len(k))
                    cut = ranges(k, n_ranges)
                    some = np.flatnonzero(np.diff(cut))
                    parts = [(cut[i], cut[i + 1]) for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([r["block"]] * len(some), pa.int64()),
                         pa.array([kind] * len(some), pa.int32()), pa.array([k[x:y].tobytes() for x, y in parts], pa.binary()),
                         pa.array([small(train[x:y]) for x, y in parts], pa.binary()),
                         pa.array([small(deleted[x:y]) for x, y in parts], pa.binary())], [x.split()[0] for x in ASK.split(", ")])

    return table.mapInArrow(task, ASK)


def answered(asks: DataFrame) -> DataFrame:
    """Corpus counts for every asked key, and per range how many keys training knows."""
    def task(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        out = []
        for kind in (1, 2):
            own = [r for r in rows if r["kind"] == kind]
            if not own:
                continue
            keys = [ints(r["keys"], np.uint64) for r in own]
            distinct, at = dense(np.concatenate(keys))
            sums = []
            for c in ("train", "deleted"):
                n = np.concatenate([wide(r[c]) for r in own])
                sums.append(np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64))
            known = int((sums[0] > 0).sum()) if kind == 1 else 0
            cut = np.cumsum([0] + [len(k) for k in keys])
            for i, r in enumerate(own):
                mine = at[cut[i]:cut[i + 1]]
                out.append({"block": r["block"], "range": r["range"], "kind": kind, "train": small(sums[0][mine]),
                            "deleted": small(sums[1][mine]), "known": known if i == 0 else 0})
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("range", pa.int32()), ("kind", pa.int32()),
                                                           ("train", pa.binary()), ("deleted", pa.binary()), ("known", pa.int64())]))

    return asks.groupBy("range").applyInArrow(task, ANSWER)


def counts(answers: pa.Table, *names: str) -> dict:
    """The counts of a block's words (kind 1) and bigrams (kind 2), in the order it asked."""
    got = sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["range"]))
    return {(k, c): np.concatenate([wide(r[c]) for r in got if r["kind"] == k]) for k in (1, 2) for c in names}


def estimates(u, v, pair, uni: np.ndarray, bi: np.ndarray, docs: int, total: int):
    """(bucket, bigram estimate, unigram estimate) of tokens ``v`` after contexts ``u`` (-1: start of a document)."""
    cu = np.where(u >= 0, uni[u], docs).astype(np.float64)
    p2 = np.divide(bi[pair], cu, out=np.zeros(len(cu)), where=cu > 0)
    bucket = np.zeros(len(cu), np.int64)
    bucket[cu > 0] = 1 + np.floor(np.log2(cu[cu > 0])).astype(np.int64)
    return bucket, p2, uni[v] / max(total, 1)


def deleted_tokens(table: DataFrame) -> DataFrame:
    """Per block the tokens of deleted documents: context, token and bigram as numbers of the block."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                pick = np.flatnonzero(b.part == DELETED)
                cols = (b.before[pick], b.tokens[pick], dense(b.pairs())[1][pick])
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]])] + [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in cols],
                                                 ["block", "context", "token", "pair"])

    return table.mapInArrow(task, "block long, context binary, token binary, pair binary")


def deleted_estimates(table: DataFrame, answers: DataFrame, docs: int, total: int) -> DataFrame:
    """Estimates of the tokens of deleted documents from the counts without them."""
    def task(block: pa.Table, got: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        u, v, pair = (ints(r[c], np.int32) for c in ("context", "token", "pair"))
        c = counts(got, "train", "deleted")
        x = estimates(u, v, pair, c[1, "train"] - c[1, "deleted"], c[2, "train"] - c[2, "deleted"], docs, total)
        return pa.table([pa.array([a.tobytes()], pa.binary()) for a in (x[0].astype(np.uint8), *(p.astype(np.float32) for p in x[1:]))],
                        ["bucket", "p2", "p1"])

    return deleted_tokens(table).groupBy("block").cogroup(answers.groupBy("block")) \
        .applyInArrow(task, "bucket binary, p2 binary, p1 binary")


def mixture(p2, p1, p0, w):
    """The three weighted parts of the probability."""
    return w[:, 2] * p2, w[:, 1] * p1, w[:, 0] * p0


def learn_weights(samples: DataFrame, p0: float, max_rounds: int = 12, tolerance: float = 1e-3) -> np.ndarray:
    """EM over ``samples``: (64 buckets, 3) weights of uniform, unigram and
    bigram.  Every round is one pass with one small sum per bucket."""
    w = np.full((64, 3), 1 / 3)
    w[0] = 0.5, 0.5, 0.0                                   # unknown context: no bigram estimate
    for _ in range(max_rounds):
        def task(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            total = np.zeros((64, 3))
            for batch in batches:
                for r in batch.to_pylist():
                    bucket = ints(r["bucket"], np.uint8)
                    parts = np.stack(mixture(ints(r["p2"], np.float32), ints(r["p1"], np.float32), p0, w[bucket])[::-1], 1)
                    parts /= parts.sum(1, keepdims=True)
                    for k in range(3):
                        total[:, k] += np.bincount(bucket, weights=parts[:, k], minlength=64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64))] + [pa.array(total[:, k]) for k in range(3)],
                                             ["bucket", "e0", "e1", "e2"])

        got = samples.mapInArrow(task, "bucket long, e0 double, e1 double, e2 double").groupBy("bucket") \
            .agg(F.sum("e0"), F.sum("e1"), F.sum("e2")).collect()
        e = np.zeros((64, 3))
        for r in got:
            e[r[0]] = r[1:]
        e += np.where(w > 0, 0.5, 0)                       # half a count each keeps empty buckets defined
        new = e / e.sum(1, keepdims=True)
        moved, w = np.abs(new - w).max(), new
        if moved < tolerance:
            break
    return w


def score(docs: DataFrame, part, block_bytes: int = 12 << 20, range_entries: int = 1 << 20,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, n_tokens, n_known, train_tokens, base_score, score) of
    every row.  ``part``: column with UNSEEN, TRAIN or DELETED."""
    spark = docs.sparkSession
    table = written(blocks(docs, part, block_bytes, id_col, text_col), "blocks")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p, n = ints(r["parts"], np.uint8), ints(r["sizes"], np.int64)
                yield pa.RecordBatch.from_pydict({"part": [0, 1, 2], "docs": [int((p == k).sum()) for k in range(3)],
                                                  "tokens": [int(n[p == k].sum()) for k in range(3)]})

    seen = {r["part"]: r for r in table.select("parts", "sizes").mapInArrow(sizes, "part long, docs long, tokens long")
            .groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    tokens, n_docs = ([seen[k][c] if k in seen else 0 for k in range(3)] for c in ("tokens", "docs"))
    n_ranges = 1 + sum(tokens) // range_entries
    answers = written(answered(asked(table, n_ranges)), "answers")
    release(spark)
    vocabulary = answers.agg(F.sum("known")).first()[0] or 0
    total, p0 = tokens[TRAIN] + tokens[DELETED], 1 / (vocabulary + 1)
    samples = written(deleted_estimates(table, answers, n_docs[TRAIN], tokens[TRAIN]), "samples")
    release(spark)
    weights = learn_weights(samples, p0) if total else np.tile([1.0, 0.0, 0.0], (64, 1))
    train_docs = n_docs[TRAIN] + n_docs[DELETED]

    def task(block: pa.Table, got: pa.Table) -> pa.Table:
        b, c = Block(block.to_pylist()[0]), counts(got, "train")
        uni = c[1, "train"]
        bucket, p2, p1 = estimates(b.before, b.tokens, dense(b.pairs())[1], uni, c[2, "train"], train_docs, total)
        p = sum(mixture(p2, p1, p0, weights[bucket]))
        at = np.cumsum(b.sizes) - b.sizes
        cv = uni[b.tokens]
        base = np.log10((cv + 1) / (total + vocabulary + 1))
        parts = ints(block.column("parts")[0].as_py(), np.uint8)
        return pa.table([pa.array(b.docs, mask=b.docs == NULL_ID), pa.array(parts.astype(np.int8)), pa.array(b.sizes),
                         pa.array(np.add.reduceat(cv > 0, at, dtype=np.int64)), pa.array(np.full(len(at), total)),
                         pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
                        ["doc_id", "part", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    totals = answers.select("block", "range", "kind", "train")
    return table.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        task, "doc_id long, part byte, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_ngram(spark, sf_dir: str) -> DataFrame:
    """Contract columns.  Learned from documents whose crc32(doc_id) mod 7 is not 2; of those,
    one in twenty is deleted from the counts to learn the weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.col("doc_id").cast("string"))
    part = F.when(crc % 7 == 2, UNSEEN).when(F.floor(crc / 7) % 20 == 0, DELETED).otherwise(TRAIN)
    return score(docs, part).select("doc_id", (F.col("part") == UNSEEN).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                    "base_score", "score")
