"""Redaction jobs: detect -> suppress -> resolve -> map -> splice (A6, G).

Data flow and shuffles (``U`` = text units, small = proportional to findings):

1. detection: one projection over ``U`` builds each unit's findings array
   (regex + NER + label context).  Narrow, no shuffle.
2. suppression (only when a mapping is given): findings are exploded,
   anti-joined with the set of values that match a generated fake and regrouped
   per unit (shuffle of findings, not text).
3. overlap resolution: an in-row fold over each unit's findings array.
4. mapping: distinct ``(type, key)`` -> existing replacement or a new
   surrogate (shuffles of distinct keys only).
5. splice: findings with replacements are grouped per target row and joined
   to the text.  A row is known by its id (null like any other) and the hash of its
   text, so rows that share an id never get each other's edits.  A filter of the row
   keys with findings splits the rows inside the scan's stage: those without
   findings pass through and only the others meet the join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, normalize_key
from ..session import written
from ..sources.units import kind_rank, paragraph_units
from . import ner as N
from .detectors import (FINDINGS_TYPE, context_person_spans, detect_regex, is_blank,
                        no_findings)
from .findings import resolve_overlaps, suppress_generated
from .key_filter import bits_for, key_filter, may_hold
from .mapping import (DEFAULT_BUCKETS, assign_surrogates, empty_mapping, finding_keys,
                      merge_mapping, new_keys)

LOOKUPS = 64               # shares into which the rows of one value are split for the mapping join
FINDING_FIELDS = ["pii_type", "value", "start", "end", "confidence", "source", "score", "seq"]


@dataclass(frozen=True)
class Config:
    """Switches; defaults reproduce the original tool's behaviour.

    ner: ``"capitalised"`` (stand-in tagger), ``"off"``, or ``"table"`` (use the
    ``candidates`` DataFrame passed to :func:`detect_units`).
    """
    ner: str = "capitalised"
    labelled_address: bool = False
    propagate_names: bool = False
    label_ignore_case: bool = False
    buckets: int = DEFAULT_BUCKETS


@dataclass
class RedactionResult:
    output: DataFrame          # redacted rows (documents, units or table rows)
    findings: DataFrame        # kept findings with replacement (audit copy)
    mapping: DataFrame         # loaded mapping plus the new rows
    new_mapping: DataFrame     # only the rows added by this run
    ner: DataFrame             # scored NER candidates per unit (audit; computed only if asked for)
    findings_written: DataFrame   # kept findings as written, without replacements


# --------------------------------------------------------------------------
# 1. detection
# --------------------------------------------------------------------------

def detect_units(units: DataFrame, key: list[str], config: Config = Config(),
                 candidates: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """``(key..., carry..., findings array, scored array)``; text is not kept."""
    carry = carry or []
    text = F.col("text")
    if config.ner == "table":
        if candidates is None:
            raise ValueError("Config.ner='table' needs a candidates DataFrame")
        per_unit = N.candidates_by_unit(candidates, key)
        per_unit = per_unit.select(*[F.col(k).alias(f"cand_{k}") for k in key], "cands")
        # Units without a candidate pass by; only the others meet the join.
        none, some = split_by_findings(units, [F.col(k) for k in key], candidates.select(
            F.xxhash64(*[F.col(k).cast(units.schema[k].dataType) for k in key])))         # hashes differ between integer types
        some = some.join(per_unit, same_key(some, per_unit, key, [f"cand_{k}" for k in key]), "left")
        nothing = F.array().cast(f"array<{N.CANDIDATE_TYPE}>")
        units = none.select("*", nothing.alias("cands")).union(some.select(*none.columns, F.coalesce("cands", nothing)))
        cands = F.col("cands")
    elif config.ner == "capitalised":
        cands = N.capitalised_run_candidates(text)
    else:
        cands = None
    blank = is_blank(text)
    # Each expensive array is computed in its own projection and then used by
    # column reference, so a regex is never re-run inside another lambda.
    if cands is None:
        stage = units.select(*key, *carry, "text", N.empty_scored().alias("scored"))
    else:
        stage = units.select(*key, *carry, "text", F.when(blank, F.array().cast(
            f"array<{N.CANDIDATE_TYPE}>")).otherwise(cands).alias("cands"))
        stage = N.score_units(stage, key + carry, propagate_names=config.propagate_names)
    findings = F.when(blank, no_findings()).otherwise(F.concat(
        detect_regex(text, config.labelled_address),
        N.ner_findings(F.col("scored")),
        context_person_spans(text, config.label_ignore_case),
    ))
    # Through an array of one row: the optimiser cannot copy the detectors into a filter above.
    row = F.struct(*key, *carry, findings.alias("findings"), "scored")
    return stage.select(F.inline(F.array(row)))


def explode_findings(det: DataFrame, key: list[str], carry: list[str], col: str | Column = "findings") -> DataFrame:
    return det.select(*key, *carry, F.explode(col).alias("f")).select(*key, *carry, "f.*")


# --------------------------------------------------------------------------
# 2-3. suppression and overlaps
# --------------------------------------------------------------------------

def kept_findings(det: DataFrame, key: list[str], carry: list[str], mapping: DataFrame | None,
                  config: Config = Config()) -> DataFrame:
    """Findings after suppression of generated values (of a given mapping) and overlap resolution."""
    det = det.where(F.size("findings") > 0)
    if mapping is None:
        return explode_findings(det, key, carry, resolve_overlaps(F.col("findings")))      # by an expression: no filter repeats it
    fd = written(explode_findings(det, key, carry), "detected")      # suppression reads it twice
    fd = suppress_generated(fd, mapping)
    regrouped = fd.groupBy(*key, *carry).agg(
        F.collect_list(F.struct(*FINDING_FIELDS)).cast(FINDINGS_TYPE).alias("fs"))
    return explode_findings(regrouped, key, carry, resolve_overlaps(F.col("fs")))


# --------------------------------------------------------------------------
# 4. mapping
# --------------------------------------------------------------------------

def occurrence_order(key: list[str]) -> Column:
    """First-seen order of a finding: unit order, then right-to-left in a unit."""
    parts = [kind_rank(F.col(k)) if k == "unit_kind" else F.col(k) for k in key]
    return F.struct(*parts, (-F.col("start")).alias("neg_start"))


def map_findings(kept: DataFrame, key: list[str], mapping: DataFrame,
                 buckets: int = DEFAULT_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Return (findings with ``norm_key`` + ``replacement``, new mapping rows)."""
    keys = finding_keys(kept, occurrence_order(key)).where(F.length("norm_key") > 0)
    # New and loaded keys together are all values observed so far.
    new = assign_surrogates(new_keys(keys, mapping), mapping, buckets)
    full = merge_mapping(mapping, new).select("pii_type", "norm_key", "replacement")
    # A value on very many rows is looked up once for each of LOOKUPS shares of them, and every share gets its answer.
    share = F.pmod(F.xxhash64(*key, "start"), F.lit(LOOKUPS)).cast("int")
    with_key = kept.withColumn("norm_key", normalize_key(F.col("value"))).withColumn("_share", share)
    asked = with_key.select("pii_type", "norm_key", "_share").distinct().join(full, ["pii_type", "norm_key"], "left")
    # A value with a blank key has no mapping row and stays; any other must have one.
    found = F.when(F.col("norm_key") == "", F.col("value")).otherwise(F.coalesce("replacement", F.raise_error(
        F.concat(F.lit("no replacement for a finding of type "), F.col("pii_type"))).cast("string")))
    joined = with_key.join(asked, ["pii_type", "norm_key", "_share"], "left").drop("_share").withColumn("replacement", found)
    return joined, new


# --------------------------------------------------------------------------
# 5. splice
# --------------------------------------------------------------------------

EDIT_TYPE = "array<struct<start:int,end:int,replacement:string>>"


def splice_text(text: Column, edits: Column) -> Column:
    """Replace disjoint ``[start, end)`` spans of ``text`` (code points)."""
    ordered = F.array_sort(edits)

    def piece(e, i):
        prev_end = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(ordered, i)["end"])
        gap = text.substr(prev_end + 1, e["start"] - prev_end)
        return F.array(gap, e["replacement"])

    body = F.array_join(F.flatten(F.transform(ordered, piece)), "")
    last_end = F.coalesce(F.try_element_at(ordered, F.lit(-1))["end"], F.lit(0))
    tail = text.substr(last_end + 1, F.greatest(F.length(text) - last_end, F.lit(0)))
    return F.when(F.size(ordered) == 0, text).otherwise(F.concat(body, tail))


def edits_by(findings: DataFrame, target_key: list[str], offset: Column | None = None) -> DataFrame:
    off = offset if offset is not None else F.lit(0)
    return findings.groupBy(*target_key).agg(F.collect_set(F.struct(          # a set: equal rows give equal edits
        (F.col("start") + off).cast("int").alias("start"),
        (F.col("end") + off).cast("int").alias("end"),
        F.col("replacement"),
    )).cast(EDIT_TYPE).alias("edits"))


def same_key(left: DataFrame, right: DataFrame, names: list[str], renamed: list[str]) -> Column:
    """Join condition under which a null key matches a null key."""
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in zip(names, renamed, strict=True)])


def split_by_findings(target: DataFrame, key: list[Column], found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a finding, rows that may have one).  ``found``: the written findings' hashed row
    keys.  A narrow step: rows of the first part never meet a shuffle."""
    bits = bits_for(found.count())
    flagged = may_hold(key_filter(found, bits), F.xxhash64(*key), bits)
    return target.where(~flagged), target.where(flagged)


def apply_edits(target: DataFrame, edits: DataFrame, target_key: list[str], found: DataFrame, text_col: str = "text") -> DataFrame:
    """Splice the edits of ``target_key`` into ``target``; only rows that may have findings are joined."""
    plain, edited = split_by_findings(target, [F.col(k) for k in target_key], found)
    names = [f"edit_{k}" for k in target_key]
    edits = edits.select(*[F.col(k).alias(n) for k, n in zip(target_key, names)], "edits")
    joined = edited.join(edits, same_key(edited, edits, target_key, names), "left")
    spliced = F.when(F.col("edits").isNull(), F.col(text_col)).otherwise(splice_text(F.col(text_col), F.col("edits")))
    return plain.union(joined.select(*[spliced.alias(c) if c == text_col else F.col(c) for c in target.columns]))


# --------------------------------------------------------------------------
# jobs
# --------------------------------------------------------------------------

def redact_units(units: DataFrame, mapping: DataFrame | None = None, config: Config = Config(),
                 key: list[str] | None = None, candidates: DataFrame | None = None,
                 target: DataFrame | None = None, target_key: list[str] | None = None,
                 offset_col: str | None = None, carry: list[str] | None = None) -> RedactionResult:
    """Redact text units.  By default the units themselves are the output;
    ``target``/``target_key``/``offset_col`` splice a coarser table instead
    (e.g. whole documents with paragraph offsets).  ``carry``: further unit
    columns that tell rows with equal keys apart."""
    spark = units.sparkSession
    key = key or ["doc_id", "unit_kind", "unit_no"]
    carry = (carry or []) + ([offset_col] if offset_col else [])

    detected = detect_units(units, key, config, candidates, carry)
    # What several outputs branch from: findings, no text.
    kept = written(kept_findings(detected.select(*key, *carry, "findings"), key, carry, mapping, config), "findings")
    mapping = mapping if mapping is not None else empty_mapping(spark)
    mapped, new = map_findings(kept, key, mapping, config.buckets)

    if target is None:
        target, target_key = units, key
    off = F.col(offset_col) if offset_col else None
    output = apply_edits(target, edits_by(mapped, target_key, off), target_key, kept.select(F.xxhash64(*target_key)))
    ner = detected.select(*key, F.explode("scored").alias("s")).select(*key, "s.*")
    return RedactionResult(output=output, findings=mapped, mapping=merge_mapping(mapping, new),
                           new_mapping=new, ner=ner, findings_written=kept)


def redact_documents(docs: DataFrame, mapping: DataFrame | None = None, config: Config = Config(),
                     id_col: str = "doc_id", text_col: str = "text",
                     candidates: DataFrame | None = None) -> RedactionResult:
    """Redact whole documents, one unit per line; names and other columns stay as they are."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    target = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("unit_body"), row)
    units = paragraph_units(target, carry=["unit_body"])
    res = redact_units(units, mapping, config, candidates=candidates, target=target,
                       target_key=["doc_id", "unit_body"], offset_col="unit_offset", carry=["unit_body"])
    res.output = res.output.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return res


def redact_table(df: DataFrame, key: str, cols: list[str], mapping: DataFrame | None = None,
                 config: Config = Config()) -> RedactionResult:
    """Redact chosen string columns of a table in place (cells are units)."""
    from ..sources.units import cell_units
    body = F.xxhash64(*[F.col(c).cast("string") for c in cols])
    units = cell_units(df.withColumn("unit_body", body), key, cols, carry=["unit_body"])
    res = redact_units(units, mapping, config, key=["doc_id", "unit_kind", "unit_no"], carry=["unit_body"])
    # Per-row edit lists keyed by column index, joined once to the table.
    per_row = res.findings.groupBy("doc_id", "unit_body", "unit_no").agg(F.collect_set(F.struct(
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.col("replacement"))).cast(EDIT_TYPE).alias("edits"))
    per_row = per_row.groupBy(F.col("doc_id").alias("edit_key"), F.col("unit_body").alias("edit_body")).agg(
        F.map_from_entries(F.collect_list(F.struct("unit_no", "edits"))).alias("_edits"))
    plain, edited = split_by_findings(df, [df[key], body], res.findings_written.select(F.xxhash64("doc_id", "unit_body")))
    joined = edited.join(per_row, edited[key].eqNullSafe(per_row["edit_key"]) & (body == per_row["edit_body"]), "left")
    out = []
    for c in df.columns:
        if c in cols:
            e = F.try_element_at(F.col("_edits"), F.lit(cols.index(c)))
            out.append(F.when(e.isNull(), edited[c]).otherwise(splice_text(edited[c].cast("string"), e)).alias(c))
        else:
            out.append(edited[c])
    res.output = plain.select(*[plain[c].cast("string") if c in cols else plain[c] for c in df.columns]).union(joined.select(*out))
    return res


__all__ = ["Config", "RedactionResult", "detect_units", "kept_findings", "map_findings",
           "splice_text", "redact_units", "redact_documents", "redact_table", "collapse_ws"]
