"""Audit tables over kept findings and scored NER candidates (group H).

All are DataFrame aggregations: counts per category, unique persons with
their first occurrence, source counts, first-N samples, NER totals,
rejection reasons and per-unit samples.  Nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import collapse_ws, summary_key
from ..sources.units import kind_rank


def _categories(spark) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(V.CATEGORIES)], "category string, rank int")


def category_counts(findings: DataFrame) -> DataFrame:
    """Distinct values per category (whitespace-collapsed, casefolded; empty
    skipped), all nine categories in fixed order, zeros included."""
    keyed = (findings.select("pii_type", summary_key(F.col("value")).alias("key"))
             .where(F.length("key") > 0))
    counts = keyed.groupBy("pii_type").agg(F.countDistinct("key").alias("distinct_values"))
    cats = _categories(findings.sparkSession)
    return (cats.join(F.broadcast(counts), cats.category == counts.pii_type, "left")
            .select("category", "rank", F.coalesce("distinct_values", F.lit(0)).cast("long").alias("distinct_values"))
            .orderBy("rank"))


def _position(df: DataFrame) -> F.Column:
    return F.struct("doc_id", kind_rank(F.col("unit_kind")).alias("kind"), "unit_no", "start")


def unique_persons(findings: DataFrame) -> DataFrame:
    """One row per person key with value, source and confidence of its first occurrence."""
    p = findings.where(F.col("pii_type") == "PERSON").select(
        summary_key(F.col("value")).alias("person_key"), collapse_ws(F.col("value")).alias("value"),
        "source", "confidence", _position(findings).alias("pos"))
    p = p.where(F.length("person_key") > 0)
    first = p.groupBy("person_key").agg(F.min_by(F.struct("value", "source", "confidence"), "pos").alias("f"),
                                        F.min("pos").alias("pos"))
    return first.select("person_key", "f.value", "f.source", "f.confidence",
                        F.col("pos.doc_id").alias("first_doc_id"), F.col("pos.unit_no").alias("first_unit_no"),
                        F.col("pos.start").alias("first_start"))


def person_sources(findings: DataFrame) -> DataFrame:
    return unique_persons(findings).groupBy("source").agg(F.count("*").alias("persons")).orderBy("source")


def person_sample(findings: DataFrame, n: int = V.SAMPLE_SIZE) -> DataFrame:
    """First ``n`` unique persons in first-seen order, plus how many more exist."""
    up = unique_persons(findings)
    w = Window.orderBy("first_doc_id", "first_unit_no", "first_start", "person_key")
    total = up.agg(F.count("*").alias("total"))
    top = up.orderBy("first_doc_id", "first_unit_no", "first_start", "person_key").limit(n) \
        .withColumn("position", F.row_number().over(w))
    return top.crossJoin(F.broadcast(total)).select(
        "position", "value", "source", F.greatest(F.col("total") - n, F.lit(0)).alias("remaining"))


def ner_totals(scored: DataFrame) -> DataFrame:
    """PERSON candidates / accepted / rejected per unit, per document and overall."""
    p = scored.where(F.col("label") == "PERSON")
    unit = [F.col(c) for c in ("doc_id", "unit_kind", "unit_no")]
    return (p.groupingSets([unit, unit[:1], []], *unit).agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected")))


def rejection_reasons(scored: DataFrame) -> DataFrame:
    """Rejected PERSON candidates by their last reason, most frequent first."""
    r = scored.where((F.col("label") == "PERSON") & ~F.col("accepted")).select(
        F.element_at("reasons", -1).alias("reason"),
        F.struct("doc_id", kind_rank(F.col("unit_kind")).alias("kind"), "unit_no", "start").alias("pos"))
    return r.groupBy("reason").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos")) \
        .select("reason", "count", F.col("first_pos.doc_id").alias("first_doc_id"),
                F.col("first_pos.unit_no").alias("first_unit_no"), F.col("first_pos.start").alias("first_start")) \
        .orderBy(F.desc("count"), "first_doc_id", "first_unit_no", "first_start")      # as many rows as there are reasons


def ner_samples(scored: DataFrame, n: int = V.SAMPLE_SIZE) -> DataFrame:
    """First ``n`` accepted and first ``n`` rejected PERSON candidates per unit.

    The rank is limited to ``n`` in every task before the shuffle; how many there are in
    all is a count of its own, combined before the shuffle as well."""
    group = ["doc_id", "unit_kind", "unit_no", "accepted"]
    p = scored.where(F.col("label") == "PERSON")
    ranked = p.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("start"))).where(F.col("position") <= n)
    sizes = p.groupBy(*group).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"of_{c}") for c in group], "n")
    same = reduce(and_, [ranked[c].eqNullSafe(sizes[f"of_{c}"]) for c in group])
    return ranked.join(sizes, same).select(*group, "position", "value", "score", F.greatest(F.col("n") - n, F.lit(0)).alias("remaining"))
