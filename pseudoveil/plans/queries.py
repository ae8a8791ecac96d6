"""Registered queries: one Spark job per operator, over the given tables."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors as D
from .fixtures import corpus

KEY = ["doc_id", "unit_kind", "unit_no"]

Query = Callable[[SparkSession, str], DataFrame]


def spans_out(units: DataFrame, findings: Column) -> DataFrame:
    return (units.select(*KEY, F.explode(findings).alias("f"))
            .select(*KEY, F.col("f.value").alias("value"), F.col("f.start").alias("start_pos"),
                    F.col("f.end").alias("end_pos")))


def _detector(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spans_out(corpus(spark, sf_dir), fn(F.col("text")))
    return run


detect_email = _detector(D.email_spans)
detect_phone = _detector(D.phone_spans)
detect_ssn = _detector(D.ssn_spans)
detect_ip = _detector(D.ip_spans)
detect_credit_card = _detector(D.card_spans)
detect_dob = _detector(D.dob_spans)
detect_address = _detector(D.address_spans)
context_persons = _detector(D.context_person_spans)


# --------------------------------------------------------------------------
# pipeline queries (all detectors; the NER stage runs the stand-in tagger)
# --------------------------------------------------------------------------

from ..functions import vocab as V  # noqa: E402
from ..functions.checks import mobile_number as _mobile  # noqa: E402
from ..functions.text import normalize_key as _norm, summary_key as _summary  # noqa: E402
from ..operators.findings import resolve_overlaps as _resolve  # noqa: E402
from ..operators.redact import Config, detect_units, redact_documents as _redact_documents  # noqa: E402
from .fixtures import corpus_documents  # noqa: E402

PIPELINE = Config()


def _found(units: DataFrame) -> DataFrame:
    """All findings of the units, before suppression and overlaps."""
    return detect_units(units, KEY, PIPELINE).select(*KEY, F.col("findings"))


def _first_run(spark: SparkSession, sf_dir: str):
    return _redact_documents(corpus_documents(spark, sf_dir), config=PIPELINE)


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _found(corpus(spark, sf_dir))
    return (u.select(*KEY, F.explode(_resolve(F.col("findings"))).alias("f"))
            .select(*KEY, "f.pii_type", "f.value", F.col("f.start").alias("start_pos"),
                    F.col("f.end").alias("end_pos"), "f.source"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_run(spark, sf_dir).output.select("doc_id", "text")


def mapping_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_run(spark, sf_dir).new_mapping.select(
        "pii_type", "norm_key", "surface", "replacement", "id")


def surrogate_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _first_run(spark, sf_dir).new_mapping
    return m.groupBy("pii_type").agg(
        F.count("*").alias("n_keys"), F.countDistinct("replacement").alias("n_replacements"),
        F.countDistinct("surface").alias("n_surfaces"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.audit import category_counts as _cc
    return _cc(_first_run(spark, sf_dir).findings)


def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _found(corpus(spark, sf_dir)).select(F.explode("findings").alias("f")).select("f.pii_type", "f.value")
    return f.select("pii_type", "value", _norm(F.col("value")).alias("norm_key"),
                    _summary(F.col("value")).alias("summary_key")).distinct()


def mobile_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = corpus(spark, sf_dir)
    return spans_out(u, D.phone_spans(F.col("text"))).withColumn("mobile", _mobile(F.col("value")))


# --------------------------------------------------------------------------
# audits, mapping edge, second run, table cells
# --------------------------------------------------------------------------

from ..operators import audit as _audit  # noqa: E402
from ..operators.findings import suppressed_values as _suppressed  # noqa: E402
from ..operators.redact import redact_table as _redact_table  # noqa: E402
from ..session import checkpoint_dir, spread, written  # noqa: E402
from ..sources.mapping_io import load_mapping, save_mapping  # noqa: E402
from ..operators.surrogates import surrogate_id as _surrogate_id  # noqa: E402
from .fixtures import PII_DOC_BASE, pii_units  # noqa: E402

detect_address_labelled = _detector(D.labelled_address_spans)


def unique_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.unique_persons(_first_run(spark, sf_dir).findings)


def person_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.person_sources(_first_run(spark, sf_dir).findings)


def person_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.person_sample(_first_run(spark, sf_dir).findings)


def mapping_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of a first run, written as JSON lines by type and loaded again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/mapping-{uuid.uuid4().hex}.jsonl"
    save_mapping(_first_run(spark, sf_dir).new_mapping, path, "jsonl")
    return load_mapping(spark, path).select("pii_type", "norm_key", "surface", "replacement", "id")


def _json_again(spark: SparkSession, mapping: DataFrame) -> DataFrame:
    """``mapping`` written as a JSON object in parts and loaded again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/mapping-{uuid.uuid4().hex}.json"
    save_mapping(mapping, path, "json")
    return load_mapping(spark, path)


def mapping_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_again(spark, _first_run(spark, sf_dir).new_mapping).select("pii_type", "surface", "replacement")


def _second_run(spark: SparkSession, sf_dir: str):
    first = _first_run(spark, sf_dir)
    return _redact_documents(corpus_documents(spark, sf_dir), mapping=first.mapping, config=PIPELINE), first


def suppress_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in already-redacted documents that are (part of) a generated fake."""
    first = _first_run(spark, sf_dir)
    from ..sources.units import paragraph_units
    u = paragraph_units(first.output.select("doc_id", "text"))
    fd = (_found(u).select(*KEY, F.explode("findings").alias("f"))
          .select(*KEY, "f.pii_type", "f.value", F.col("f.start").alias("start_pos"), F.col("f.end").alias("end_pos"))
          .withColumn("norm", _norm(F.col("value"))))
    fd = written(fd, "detected")      # the values and the join read it
    fakes = first.new_mapping.select(_norm(F.col("replacement")).alias("fake"))
    bad = _suppressed(fd.select("norm"), fakes)
    return fd.join(bad, "norm", "left_semi").drop("norm")


def mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    second, _ = _second_run(spark, sf_dir)
    return second.findings.select(*KEY, "pii_type", "value", F.col("start").alias("start_pos"),
                                  F.col("end").alias("end_pos"), "replacement")


def redact_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction with the mapping of a first run over the same documents: the same texts again."""
    return _second_run(spark, sf_dir)[0].output.select("doc_id", "text")


def mapping_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping after a run over even documents and another one over odd documents."""
    docs = corpus_documents(spark, sf_dir)
    first = _redact_documents(docs.where("doc_id % 2 = 0"), config=PIPELINE)
    second = _redact_documents(docs.where("doc_id % 2 = 1"), mapping=first.mapping, config=PIPELINE)
    return second.mapping.select("pii_type", "norm_key", "surface", "replacement", "id")


def mapping_append_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``mapping_append``, with the first run's mapping kept as JSON, which holds no ids."""
    docs = corpus_documents(spark, sf_dir)
    first = _redact_documents(docs.where("doc_id % 2 = 0"), config=PIPELINE)
    second = _redact_documents(docs.where("doc_id % 2 = 1"), mapping=_json_again(spark, first.mapping), config=PIPELINE)
    return second.mapping.select("pii_type", "norm_key", "surface", "replacement", "id")


def surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a first run's fakes, read back from the fakes alone."""
    m = _first_run(spark, sf_dir).new_mapping
    return m.select("pii_type", "replacement", _surrogate_id(F.col("pii_type"), F.col("replacement")).alias("id"))


def _null_id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with every third id missing; ``nr`` tells the rows apart."""
    return corpus_documents(spark, sf_dir).select(F.col("doc_id").alias("nr"),
                                                  F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("doc_id"), "text")


def redact_null_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an id are redacted like any other."""
    return _redact_documents(_null_id_documents(spark, sf_dir), config=PIPELINE).output.select("nr", "doc_id", "text")


def redact_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "text", (F.col("conv_id") * 100000 + F.col("turn")).cast("long").alias("row"))
    return _redact_table(c, "row", ["text"], config=PIPELINE).output.select("conv_id", "turn", "text")


def redact_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = pii_units(spark, sf_dir).select((F.col("doc_id") - PII_DOC_BASE).alias("c_custkey"), F.col("text").alias("note"))
    t = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").join(notes, "c_custkey"))
    return _redact_table(t, "c_custkey", ["c_name", "note"], config=PIPELINE).output


# --------------------------------------------------------------------------
# NER over the corpus with the stand-in tagger
# --------------------------------------------------------------------------

from ..operators import ner as _N  # noqa: E402


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = corpus(spark, sf_dir).where(~D.is_blank(F.col("text")))
    c = u.select(*KEY, "text", _N.capitalised_run_candidates(F.col("text")).alias("cands"))
    s = _N.score_units(c, KEY, out_col="s")
    return s.select(*KEY, F.explode("s").alias("x")).select(
        *KEY, "x.value", "x.label", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"),
        "x.accepted", "x.score", "x.reasons")


def ner_first_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEY, "label", "value", "start_pos", "end_pos")


def ner_person_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("label") == "PERSON").select(
        *KEY, "value", "start_pos", "end_pos", "accepted", "score",
        F.array_join("reasons", " | ").alias("reasons"))


def ner_organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where((F.col("label") == "ORG") & F.col("accepted")).select(
        *KEY, "value", "start_pos", "end_pos")


def ner_candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as a table with part-of-speech counts (none, one or two proper
    nouns, with and without an initial), validated after a join on the unit."""
    u = corpus(spark, sf_dir).where(~D.is_blank(F.col("text")))
    runs = u.select(*KEY, F.explode(_N.capitalised_run_candidates(F.col("text"))).alias("c")).select(*KEY, "c.*")
    turn = (F.col("doc_id") + F.col("start")) % 5
    table = runs.withColumn("propn_count", F.when(turn < 3, turn).when(turn == 3, 1).cast("int")) \
        .withColumn("initial_count", F.when(turn == 3, 1).otherwise(0).cast("int"))
    per_unit = _N.candidates_by_unit(table, KEY)
    s = _N.score_units(u.join(per_unit, KEY).select(*KEY, "text", "cands"), KEY, out_col="s")
    return s.select(*KEY, F.explode("s").alias("x")).select(
        *KEY, "x.label", "x.value", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), "x.accepted", "x.score")


def _audit_frame(spark, sf_dir):
    return _scored(spark, sf_dir).withColumnRenamed("start_pos", "start")


def ner_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.ner_totals(_audit_frame(spark, sf_dir))


def ner_rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.rejection_reasons(_audit_frame(spark, sf_dir))


def ner_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.ner_samples(_audit_frame(spark, sf_dir))
