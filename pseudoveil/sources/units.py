"""Text units from documents and tables (A1, A2).

A unit is one paragraph (line) of a document or one cell of a table.  All
detection runs per unit.  Paragraph units also carry their code-point offset
inside the document, so redaction can splice the document text directly and
never has to reassemble (re-shuffle) documents from their paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import bound

UNIT_KEY = ["doc_id", "unit_kind", "unit_no"]
KIND_RANK = {"paragraph": 0, "cell": 1}


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "paragraph", 0).when(kind == "cell", 1).otherwise(2)


OFFSET_STEP = 256      # offsets gathered at a time: appending to one long array would be quadratic


def line_offsets(parts: Column) -> Column:
    """Code-point offset of each part of ``split(text, '\\n')`` inside ``text``."""
    empty = F.array().cast("array<int>")

    def one(acc, p):
        return F.struct((acc["pos"] + F.length(p) + 1).alias("pos"), F.concat(acc["offs"], F.array(acc["pos"])).alias("offs"))

    def some(acc, ps, first):
        inner = F.aggregate(F.slice(ps, first, OFFSET_STEP), F.struct(acc["pos"], empty.alias("offs")), one)
        return F.struct(inner["pos"].alias("pos"), F.concat(acc["offs"], inner["offs"]).alias("offs"))

    start = F.struct(F.lit(0).alias("pos"), empty.alias("offs"))
    return bound(parts, lambda ps: F.aggregate(F.sequence(F.lit(1), F.size(ps), F.lit(OFFSET_STEP)), start,
                                               lambda acc, first: some(acc, ps, first), lambda acc: acc["offs"]))


def paragraph_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                    offsets: bool = True) -> DataFrame:
    """``(doc_id, unit_kind='paragraph', unit_no, text, unit_offset, carry...)``, narrow (no shuffle).

    Without ``offsets`` that column is left out: Spark would compute it even if nobody reads it."""
    carry = carry or []
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    if not offsets:
        return docs.select(F.col(id_col).alias("doc_id"), *carry, F.posexplode(parts).alias("unit_no", "text")).select(
            "doc_id", F.lit("paragraph").alias("unit_kind"), F.col("unit_no").cast("int").alias("unit_no"), "text", *carry)
    zipped = F.arrays_zip(parts.alias("text"), line_offsets(parts).alias("unit_offset"))
    return (
        docs.select(F.col(id_col).alias("doc_id"), *carry, F.posexplode(zipped).alias("unit_no", "u"))
        .select("doc_id", F.lit("paragraph").alias("unit_kind"), F.col("unit_no").cast("int").alias("unit_no"),
                F.col("u.text").alias("text"), F.col("u.unit_offset").alias("unit_offset"), *carry)
    )


def cell_units(df: DataFrame, key: str, cols: list[str], carry: list[str] | None = None) -> DataFrame:
    """One unit per chosen string cell, row-major: ``(doc_id=<key>, 'cell', unit_no, column, text, carry...)``."""
    carry = carry or []
    stacked = F.array(*[
        F.struct(F.lit(i).alias("unit_no"), F.lit(c).alias("column"), F.col(c).cast("string").alias("text"))
        for i, c in enumerate(cols)
    ])
    return (df.select(F.col(key).alias("doc_id"), *carry, F.inline(stacked))
            .select("doc_id", F.lit("cell").alias("unit_kind"), "unit_no", "column", "text",
                    F.lit(0).alias("unit_offset"), *carry))
