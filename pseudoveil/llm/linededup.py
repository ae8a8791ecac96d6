"""Line dedup: repeated runs of lines across all documents, later copies deleted.

A text is the sequence of its ``\\n``-separated lines; a line's symbol is its
128-bit hash, so the corpus is one set of sequences over line symbols.

1. **Prefix doubling.**  The name of the h-line prefix of a suffix is built from
   the names of its two halves; a grouped count over all suffixes keeps those
   whose prefix occurs more than once.  h = 1, 2, 4, ... until no prefix is
   repeated.  Only repeated suffixes go on, and a name shared by very many
   suffixes is combined before the shuffle.
2. **Longest-common-prefix intervals.**  The suffixes that share their first L
   lines are one interval of depth L.  Walking the doubling levels back down,
   every interval is split by the next 2^k lines: suffixes that still agree
   with another one move to a child interval, and the child stays in its parent
   as one representative, its first place.  At the end every suffix stands in
   the deepest interval it shares, every representative in the parent's, and a
   suffix that is not the first of its interval has an earlier copy of L lines.
3. **Deletion.**  A run is removed if its lines have ``min_chars`` or more
   characters together (ends trimmed).  Runs may be a single long line; short
   lines go only as part of a longer repeated run.  The first copy of every run
   stays, in the order of (doc_id, line).

All state is rows of (document, line, name) in written tables; the number of
rounds is logarithmic in the longest repeated run.

Defined results: a null text stays null and has no lines; an empty text has one
empty line and stays; rows that share doc_id *and* text are one document and
get the same result; a null doc_id sorts before all others; other columns pass
through unchanged whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

KEY = ["doc", "body"]          # doc_id (null: smallest long) and hash of the whole text


def place():
    return F.struct("doc", "body", "at")


def _keys(docs: DataFrame, id_col: str, text_col: str):
    doc = F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63)))
    return doc.alias("doc"), F.xxhash64(docs[text_col]).alias("body")


def line_symbols(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, body, at, a, b): every line of every text with its symbol (a, b)."""
    doc, body = _keys(docs, id_col, text_col)
    rows = docs.where(docs[text_col].isNotNull()).select(doc, body, F.posexplode(F.split(docs[text_col], "\n", -1)).alias("at", "line"))
    return rows.select(*KEY, "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"))


def repeated(named: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``named`` whose name ``by`` occurs more than once, with the first place of the name."""
    groups = named.groupBy(*by).agg(F.count("*").alias("n_places"), F.min(place()).alias("first"))
    return named.join(groups.where("n_places > 1").drop("n_places"), by)


def doubling_levels(lines: DataFrame) -> list[DataFrame]:
    """Level k: repeated prefixes of 2^k lines as (a, b, doc, body, at, first)."""
    symbols = lines.select("a", "b", *KEY, "at").distinct()        # rows sharing doc_id and text are one document
    levels = [written(repeated(symbols, ["a", "b"]), "lines")]
    while True:
        low, h = levels[-1], 1 << (len(levels) - 1)
        x = low.select(*KEY, "at", "a", "b")
        y = low.select(*KEY, (F.col("at") - h).alias("at"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        pairs = x.join(y, [*KEY, "at"]).select(*then("a", "b", "a2", "b2"), *KEY, "at")
        nxt = written(repeated(pairs, ["a", "b"]), "lines")
        if nxt.isEmpty():
            return levels
        levels.append(nxt)


def then(a: str, b: str, a2: str, b2: str):
    """Name of a prefix followed by another one."""
    return F.xxhash64(a, b, a2, b2).alias("a"), F.xxhash64(b2, a2, b, a).alias("b")


def intervals(levels: list[DataFrame]) -> DataFrame:
    """(a, b, depth, doc, body, at): places of all longest-common-prefix
    intervals; a child interval stands in its parent as its first place only."""
    state = None
    for k in range(len(levels) - 1, -1, -1):
        h, level = 1 << k, levels[k]
        # Suffixes that agree in 2^k lines and not in more, and one representative of those that do.
        fresh = level.select("a", "b", F.lit(h).alias("depth"), *KEY, "at")
        if state is None:
            state = written(fresh, "intervals")
            continue
        above = levels[k + 1].select(*KEY, "at", (F.col("first") == place()).alias("leads"))
        fresh = fresh.join(above, [*KEY, "at"], "left").where("coalesce(leads, true)").drop("leads")
        # Split every interval by the next 2^k lines.
        block = level.select(*KEY, F.col("at").alias("next"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        tried = state.withColumn("next", F.col("at") + F.col("depth")).join(block, [*KEY, "next"])
        split = tried.select(*then("a", "b", "a2", "b2"), (F.col("depth") + h).alias("depth"), *KEY, "at",
                             F.col("a").alias("a0"), F.col("b").alias("b0"))
        child = written(repeated(split, ["a", "b", "depth"]), "children")
        gone = child.where(F.col("first") != place()).select(F.col("a0").alias("a"), F.col("b0").alias("b"), *KEY, "at")
        stay = state.join(gone, ["a", "b", *KEY, "at"], "left_anti")
        state = written(stay.unionByName(child.drop("a0", "b0", "first")).unionByName(fresh), "intervals")
    return state


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(doc, body, at, n): maximal runs of n lines that start at an earlier place, too."""
    found = repeated(intervals(doubling_levels(lines)), ["a", "b", "depth"]).where(F.col("first") != place())
    longest = found.groupBy(*KEY, "at").agg(F.max("depth").alias("n"))
    before = F.max(F.col("at") + F.col("n")).over(
        Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return longest.withColumn("reach", before).where("reach is null or at + n > reach").drop("reach")


def dedupe_lines(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text,
    and the columns ``lines_total`` and ``lines_removed``."""
    doc, body = _keys(docs, id_col, text_col)
    runs = repeated_runs(line_symbols(docs, id_col, text_col)) \
        .groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("runs"))       # bounded by the lines of one text
    own = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c != text_col]
    joined = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), doc, body).join(runs, KEY, "left")
    lines = F.split(F.col(f"d.`{text_col}`"), "\n", -1)
    size = F.transform("lines", lambda x: F.length(F.trim(x)))
    long_runs = F.filter("runs", lambda r: F.aggregate(
        F.slice(F.col("size"), r["at"] + 1, r["n"]), F.lit(0), lambda s, x: s + x) >= min_chars)
    gone = F.flatten(F.transform("long", lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1)))
    out = joined.withColumn("lines", lines).withColumn("size", F.when(F.col("runs").isNotNull(), size)) \
        .withColumn("long", long_runs) \
        .withColumn("keep", F.when(F.size("long") > 0, F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)))
    text = F.when(F.col("keep").isNull(), F.col(f"d.`{text_col}`")).otherwise(
        F.array_join(F.transform("keep", lambda i: F.get(F.col("lines"), i)), "\n"))
    total = F.coalesce(F.size("lines"), F.lit(0))
    removed = F.when(F.col("keep").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("keep"))
    by_name = {**{c: o for c, o in zip([c for c in docs.columns if c != text_col], own, strict=True)}, text_col: text.alias(text_col)}
    return out.select(*[by_name[c] for c in docs.columns], F.greatest(total, F.lit(0)).alias("lines_total"),
                      removed.alias("lines_removed"))


def op7_linededup(spark, sf_dir: str) -> DataFrame:
    """All documents with later copies of repeated line runs deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedupe_lines(docs)
