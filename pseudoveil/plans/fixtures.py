"""Derived input tables for the registered queries.

``corpus`` = paragraph units of ``documents`` plus ``pii_units``: one text
unit per ``customer`` row (joined to ``nation``) built from eight templates so
that every detector has matches and the table grows with the scale factor.
Both are pure DataFrame derivations of the given tables; the oracle SQL
builds the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import evened, spread
from ..sources.units import paragraph_units

PII_DOC_BASE = 1_000_000_000
FIRST_NAMES = ["Varun", "Asha", "Meera", "Vikram", "Karan", "Nisha", "Tarun", "Leela"]
LAST_NAMES = ["Kamat", "Rao", "Sharma", "Iyer", "Patil", "Desai", "Menon", "Joshi"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = evened(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return paragraph_units(docs, offsets=False)


def pii_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))       # short rows, long work on each
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    p = (F.lit(9000000000) + F.lit(7919) * k).cast("string")
    fn = F.element_at(F.array(*[F.lit(x) for x in FIRST_NAMES]), (F.expr("(c_custkey div 64) % 8") + 1).cast("int"))
    ln = F.element_at(F.array(*[F.lit(x) for x in LAST_NAMES]), (F.expr("(c_custkey div 8) % 8") + 1).cast("int"))
    odd = F.expr("(c_custkey div 8) % 2") == 1
    s = lambda c: c.cast("string")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("Call +91 "), F.substring(p, 1, 5), F.lit(" "), F.substring(p, 6, 5),
                                    F.lit(" or 0"), p, F.lit(" today")))
        .when(k % 8 == 1, F.concat(F.lit("SSN "), s(k % 900 + 100), F.lit("-"), s(k % 90 + 10), F.lit("-"),
                                   s(k % 9000 + 1000), F.lit(" on file")))
        .when(k % 8 == 2, F.concat(F.lit("DOB: "), s(k % 28 + 1), F.lit("/"), s(k % 12 + 1), F.lit("/"),
                                   s(k % 50 + 1950), F.lit(" dated 01/02/2020")))
        .when(k % 8 == 3, F.concat(F.lit("Registered Office: "), s(k % 200 + 1), F.lit(", MG Road, "),
                                   F.col("n_name"), F.lit(" "), s(k % 99999 + 400000), F.lit(" Telephone: "), p))
        .when(k % 8 == 4, F.concat(F.lit("managing director: "),
                                   F.when(odd, F.concat(F.substring(fn, 1, 1), F.lit("."))).otherwise(fn),
                                   F.lit(" "), ln, F.lit(" signed")))
        .when((k % 8 == 5) & odd, F.concat(F.when(F.expr("(c_custkey div 16) % 2") == 1, "Hence ").otherwise("Therefore "),
                                           ln, F.lit(" signed the offer")))
        .when(k % 8 == 5, F.concat(F.lit("Managing Director: "), fn, F.lit(" "), ln, F.lit(" signed")))
        .when(k % 8 == 6, F.concat(F.lit("Server 10."), s(k % 256), F.lit("."), s(F.expr("(c_custkey div 256) % 256")),
                                   F.lit(".7 mail user"), s(k), F.lit("@example.org, copy user"), s(k),
                                   F.lit("@example.org")))
        .otherwise(F.concat(F.lit("Card 4111 1111 1111 1111 paid; other 4111 1111 1111 1112 no; bill "), s(k),
                            F.lit(" to "), ln, F.lit(" Industries Limited via Bank of "), fn))
    )
    return cust.join(nat, cust.c_nationkey == nat.n_nationkey).select(
        (k + PII_DOC_BASE).cast("long").alias("doc_id"), F.lit("paragraph").alias("unit_kind"),
        F.lit(0).alias("unit_no"), text.alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_units(spark, sf_dir).unionByName(pii_units(spark, sf_dir))


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents plus one document per ``pii_units`` row (for document jobs)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.unionByName(pii_units(spark, sf_dir).select("doc_id", "text"))
