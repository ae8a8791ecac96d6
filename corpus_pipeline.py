"""A training-corpus pipeline from the operators of ``pseudoveil.llm``.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, in
the columns of ``documents``; its result is written as Parquet and read back as
the next stage's input.  The last stage returns the packed pieces.

1. ``language``: documents without a letter go, and those short enough that no learned language has
   half of the posterior.  The model learns from the labelled documents; it does not know a language that
   nobody labelled.
2. ``lines``: later copies of repeated line runs are cut out of the texts; a
   document that loses all its lines goes.
3. ``near_duplicates``: of each SimHash group one row stays, with the smallest doc_id.
4. ``benchmark``: documents with a passage of a benchmark item go.
5. ``packing``: the remaining texts as sequences of 2048 tokens.

Every stage decides per row: a missing or repeated doc_id takes no other row along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudoveil.llm import decontaminate, langid, linededup, packing, simhash
from pseudoveil.llm.storage import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
MIN_POSTERIOR = 0.5


def by_row(docs: DataFrame) -> DataFrame:
    """(row, text): rows known by id and text together, so that rows sharing an id are judged each by its own text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")


def keep(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose :func:`by_row` key is in the column ``doc_id`` of ``rows``."""
    kept = rows.select(F.col("doc_id").alias("kept_row")).distinct()
    return docs.join(kept, F.xxhash64(docs["doc_id"], docs["text"]) == kept["kept_row"], "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled documents teach."""
    model = langid.train(docs.select("text", "lang"))
    found = langid.identify(by_row(docs), model, id_col="row")
    return keep(docs, found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_POSTERIOR)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of line runs out; drop documents of which nothing is left."""
    out = linededup.dedupe_lines(docs)
    emptied = (F.col("lines_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    out = out.where(~emptied).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every SimHash group (3-word shingles, two bits)."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark passage (10 words)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(by_row(docs), items, window=10, id_col="row")
    return keep(docs, found.where(F.size("spans") == 0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, **packing.vocabulary(), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("packing", pack),
]

#: Language identification, SimHash and byte-pair encoding have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
