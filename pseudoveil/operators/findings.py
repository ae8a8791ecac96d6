"""Combining findings: union, suppression of generated values, overlaps (group E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.spans import STEP, bound
from ..functions.text import normalize_key
from ..session import spread, written
from .detectors import FINDINGS_TYPE
from .key_filter import bits_for, key_filter, may_hold


def confidence_rank(conf: Column) -> Column:
    out = F.lit(V.UNKNOWN_CONFIDENCE_RANK)
    for name, rank in sorted(V.CONFIDENCE_RANK.items(), key=lambda kv: -kv[1]):
        out = F.when(conf == name, rank).otherwise(out)
    return out


def resolve_overlaps(findings: Column) -> Column:
    """Greedy left-to-right selection of disjoint spans inside one unit.

    Order: start, confidence rank, longer first, then detector order.  A
    finding is kept when it starts at or after the end of the last kept one;
    so an earlier start wins even over a higher confidence.
    """
    keyed = F.transform(findings, lambda f: F.struct(
        f["start"].alias("k_start"),
        confidence_rank(f["confidence"]).alias("k_conf"),
        (f["start"] - f["end"]).alias("k_neg_len"),
        f["seq"].alias("k_seq"),
        f.alias("f"),
    ))
    ordered = F.array_sort(keyed)
    empty = F.array().cast(FINDINGS_TYPE)

    def step(acc, k):
        keep = k["f"]["start"] >= acc["occupied"]
        return F.struct(
            F.when(keep, k["f"]["end"]).otherwise(acc["occupied"]).alias("occupied"),
            F.when(keep, F.concat(acc["out"], F.array(k["f"]))).otherwise(acc["out"]).alias("out"),
        )

    def block(acc, rows, first):
        inner = F.aggregate(F.slice(rows, first, STEP), F.struct(acc["occupied"], empty.alias("out")), step)
        return F.struct(inner["occupied"].alias("occupied"), F.concat(acc["out"], inner["out"]).alias("out"))

    def fold(rows):
        init = F.struct(F.lit(-1).alias("occupied"), empty.alias("out"))
        starts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, init, lambda acc, first: block(acc, rows, first), lambda acc: acc["out"])

    return bound(ordered, fold)


# --------------------------------------------------------------------------
# E2: suppression of values that are (part of) a generated fake
# --------------------------------------------------------------------------

HEAD = 8                   # characters by which a place in a string is first told from others


def _contained(inner: DataFrame, inner_col: str, outer: DataFrame, outer_col: str) -> DataFrame:
    """(outer_col, inner_col) pairs side by side: the substrings of ``outer`` that may be an ``inner``.

    Every place of an ``outer`` string is first tested with the first ``HEAD`` characters against a filter of
    the beginnings of ``inner`` (shorter strings with all of theirs).  Only where that holds, substrings of the
    lengths that ``inner`` has are cut and tested against a filter of whole ``inner`` strings, so the work
    is near the number of characters, and what is left for the shuffle is close to the true matches."""
    n = F.length(inner_col)
    lengths = inner.agg(F.collect_set(n)).scalar()                               # a few dozen numbers
    heads = inner.agg(F.collect_set(F.least(n, F.lit(HEAD)))).scalar()
    bits = bits_for(inner.count())
    begins = key_filter(inner.select(F.xxhash64(F.substring(inner_col, 1, HEAD))), bits)
    held = key_filter(inner.select(F.xxhash64(inner_col)), bits)
    text, size, head, at = F.col(outer_col), F.length(outer_col), F.col("_head"), F.col("_at")
    places = spread(outer).select(outer_col, F.explode(heads).alias("_head")).where(size >= head) \
        .select(outer_col, "_head", F.explode(F.sequence(F.lit(1), size - head + 1)).alias("_at")) \
        .where(may_hold(begins, F.xxhash64(F.substring(text, at, head)), bits))
    cut = places.select(outer_col, "_head", "_at", F.explode(F.when(head < HEAD, F.array(head)).otherwise(lengths)).alias("_n")) \
        .where(((head < HEAD) | (F.col("_n") >= HEAD)) & (F.col("_n") <= size - at + 1)) \
        .select(outer_col, F.substring(text, at, F.col("_n")).alias(inner_col))
    return cut.where(may_hold(held, F.xxhash64(inner_col), bits))


def suppressed_values(values: DataFrame, fakes: DataFrame) -> DataFrame:
    """Distinct ``norm`` values that equal, contain or are contained in a fake.

    ``values``: one column ``norm`` (normalised finding values).
    ``fakes``:  one column ``fake`` (normalised replacement values).
    Blank values never match and blank fakes are ignored.

    Containment is an equi-join on whole strings: either side is cut into the
    substrings of it that may be a string of the other side.  There is no
    candidate list, so no key is hotter than a distinct string.
    """
    return related_values(distinct_values(values.select("norm"), "values"), distinct_values(fakes.select("fake"), "fakes"))


def distinct_values(values: DataFrame, name: str) -> DataFrame:
    """The distinct values of the only column that are not blank, written."""
    return written(values.where(F.length(values.columns[0]) > 0).distinct(), name)


def values_inside(g: DataFrame, v: DataFrame) -> DataFrame:
    """(norm, fake): the values of ``v`` with each value of ``g`` that they hold, of tables from :func:`distinct_values`."""
    return _contained(g, "fake", v, "norm").join(g, "fake", "left_semi").select("norm", "fake")


def values_within(v: DataFrame, g: DataFrame) -> DataFrame:
    """The values ``norm`` of ``v`` that a value of ``g`` holds."""
    return v.join(_contained(v, "norm", g, "fake"), "norm", "left_semi")


def related_values(v: DataFrame, g: DataFrame) -> DataFrame:
    """:func:`suppressed_values` of two tables from :func:`distinct_values`."""
    return values_inside(g, v).select("norm").unionByName(values_within(v, g)).distinct()


def suppress_generated(fd: DataFrame, mapping: DataFrame) -> DataFrame:
    """Drop findings whose normalised value equals, contains or is part of any
    replacement in ``mapping`` (any type).  ``fd`` needs a ``value`` column."""
    fd = fd.withColumn("_norm", normalize_key(F.col("value")))
    fakes = mapping.select(normalize_key(F.col("replacement")).alias("fake"))
    bad = suppressed_values(fd.select(F.col("_norm").alias("norm")), fakes)
    return fd.join(bad.withColumnRenamed("norm", "_norm"), "_norm", "left_anti").drop("_norm")
