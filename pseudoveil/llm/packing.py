"""Harmonic packing of tokenised documents into fixed-length sequences.

A document longer than a sequence gives full sequences first; what is left of it, or
the whole of a shorter one, has a length in the *class* ``(capacity/(k+1), capacity/k]``
of exactly one k, and every sequence of class k takes k such documents.  The rest
of a sequence with its k documents (less than one document of the class) is filled
with the beginning of a later document, which is cut there; what remains of that
document is classed by its new length.  So only such fillers and documents beyond
the capacity are cut, and closed sequences are full.

Every task packs its own rows with one open sequence for each class that occurs
(about 2 * sqrt(capacity) of them); no worker needs to know of another, nothing
is shuffled and a lost task is simply run again.  Documents still open at the end of
a task are poured one after another into full sequences, and the last, incomplete
one is cut into pieces of powers of two, which need no padding.  Nothing is padded.

Token ids are those of ``tokenizers`` with the ``byte_bpe_50k`` vocabulary without
special tokens, followed by id 1.  Texts without very long words and runs of
white space are encoded by tiktoken with the same vocabulary as ranks, at a
quarter of the CPU time (tests compare the ids); its regular expression and
merges cannot take runs of millions of characters, so texts that hold a run of
``LONG_RUN`` go to ``tokenizers``.

Defined results: null or empty text is one piece with the closing id; a very
long text is encoded on its own and cut like any other; repeated rows are
packed separately; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


LONG_RUN = 5_000       # characters
_RUN = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


def encoder(ranks_path: str, tokenizer_path: str):
    """Text -> ids, from a tiktoken rank file and the tokenizers file of the same vocabulary; loaded once per Python worker."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    loaded = tiktoken.__dict__.setdefault("_loaded_by_path", {})
    if ranks_path not in loaded:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(tokenizer_path)
        slow.encode_special_tokens = True                    # a special token's string in a text is ordinary text
        loaded[ranks_path] = fast, slow
    fast, exact = loaded[ranks_path]

    def ids(text: str) -> np.ndarray:
        if _RUN.search(text):
            return np.array(exact.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return ids


class Part:
    """Ids of a document that are not placed yet, from ``start`` on."""

    def __init__(self, doc, ids: np.ndarray, start: int):
        self.doc, self.ids, self.start = doc, ids, start

    def __len__(self):
        return len(self.ids) - self.start

    def cut(self, n: int) -> tuple:
        """The row of its first n ids, which are placed now."""
        at, self.start = self.start, self.start + n
        return self.doc, at, n, zlib.crc32(self.ids[at:at + n].tobytes()), len(self.ids)


class Packer:
    """One task's open sequences."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[Part]] = {}                # class -> parts of its open sequence
        self.short: list[tuple[list[Part], int]] = []        # sequences with all their documents, and what they lack
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        """Write the pieces (rows of Part.cut) as one sequence."""
        total, offset = sum(p[2] for p in pieces), 0
        for p in pieces:
            self.rows.append((*p, self.next_id, offset, total))
            offset += p[2]
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        part = Part(doc, ids, 0)
        while len(part) >= self.capacity:
            self.close([part.cut(self.capacity)])
        while self.short and len(part) >= self.short[-1][1]:
            parts, lacks = self.short.pop()
            self.close([p.cut(len(p)) for p in parts] + [part.cut(lacks)])
        if not len(part):
            return
        k = self.capacity // len(part)
        parts = self.open.setdefault(k, [])
        parts.append(part)
        if len(parts) == k:
            del self.open[k]
            lacks = self.capacity - sum(map(len, parts))
            if lacks:
                self.short.append((parts, lacks))
            else:
                self.close([p.cut(len(p)) for p in parts])

    def finish(self) -> None:
        """Pour what is open into full sequences, the last tokens into powers of two."""
        parts = [p for ps, _ in self.short for p in ps] + [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(map(len, parts))
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= size
            pieces = []
            while size:
                n = min(size, len(parts[0]))
                pieces.append(parts[0].cut(n))
                size -= n
                if not len(parts[0]):
                    parts.pop(0)
            self.close(pieces)
        self.open, self.short = {}, []

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, ranks_path: str, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: see ``SCHEMA``.  ``capacity`` must be a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def table(placed):
        cols = list(zip(*placed, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc.as_py(), np.append(encode(text.as_py() or ""), END_ID).astype("<u4"))
            if placed := packer.taken():
                yield table(placed)
        packer.finish()
        if placed := packer.taken():
            yield table(placed)

    return rows.mapInArrow(task, SCHEMA)


def vocabulary() -> dict[str, str]:
    """The installed files of the vocabulary, as options of :func:`pack`."""
    import public_tokenizers
    return {"ranks_path": str(public_tokenizers.path("byte_bpe_50k.tiktoken")),
            "tokenizer_path": str(public_tokenizers.path("byte_bpe_50k.json"))}


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all documents, sequences of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, **vocabulary(), capacity=2048)
