"""Named-entity candidates and their validation (group C).

No model ships with this library.  Candidates come from one of:

* ``capitalised_run_candidates`` — a Catalyst-only stand-in tagger (runs of
  2-6 capitalised words; ORG when a legal suffix or organisation indicator is
  present).  It is *not* a statistical model and makes no parity claim.
* a candidate table ``(unit key, value, label, start, end, propn_count, initial_count)``
  produced by any tagger; ``tagged_candidates`` runs one over Arrow batches.

Everything after the candidates — first-mention dedupe, the person gate, the
shape and context scores, acceptance tiers and the organisation gate — is
exact and runs as column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.spans import bound, spans
from ..functions.text import casefold, py_strip, words
from .detectors import FINDINGS_TYPE, no_findings

# Python ``str.isdigit`` also accepts superscripts, subscripts and circled digits.
PY_DIGIT = (
    r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨"
    r"⑴-⑼⒈-⒐⓵-⓽❶-❾➀-➈➊-➒]"
)

CANDIDATE_TYPE = (
    "struct<value:string,label:string,start:int,end:int,"
    "propn_count:int,initial_count:int>"
)
SCORED_TYPE = (
    "struct<value:string,label:string,start:int,end:int,"
    "accepted:boolean,score:int,reasons:array<string>>"
)


def _word_regex(terms: list[str]) -> str:
    first = "".join(sorted({t[0] for t in terms}))          # most places fail at the first letter
    return rf"(?iU)(?=[{first}]){V.WB}(?:" + "|".join(terms) + rf"){V.WB}"


def _one_of(terms: Iterable[str], after: str = "") -> str:
    """Pattern of any of the terms as they stand (``after``: what has to follow them)."""
    terms = list(terms)
    first = "".join(sorted({t[0] for t in terms}))
    return rf"(?=[{first}])(?:" + "|".join(rf"\Q{t}\E" for t in terms) + f"){after}"


def _fold(c: Column) -> Column:
    """:func:`casefold` of a stored value: ASCII has no full folds to look for."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(casefold(c))


def _alpha_ratio_ok(v: Column) -> Column:
    alpha = F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    return (F.length(v) > 0) & (alpha / F.length(v) >= V.ALPHA_RATIO)


# --------------------------------------------------------------------------
# C3 + C4: person gate
# --------------------------------------------------------------------------

def gate_value(value: Column) -> Column:
    """The value the person gate looks at: stripped, trailing symbols removed,
    whitespace runs collapsed (no final strip)."""
    symbols = "".join("\\" + c if c in "^" else c for c in V.TRAILING_SYMBOLS)
    return F.regexp_replace(F.regexp_replace(py_strip(value), f"[{symbols}]+$", ""),
                            rf"(?U){V.WS}+", " ")


def _person_gate_parts(v: Column, lower: Column, w: Column, propn_count: Column | None,
                       initial_count: Column | None) -> Column:
    n = F.length(v)
    non_person = list(dict.fromkeys(V.PERSON_NON_NAME_WORDS + V.PERSON_GATE_EXTRA_WORDS))
    strip = F.lit(V.WORD_STRIP_CHARS)
    caps = F.size(F.filter(
        w, lambda x: F.btrim(x, strip).rlike(r"^\p{Lu}"),
    ))
    shape_ok = (
        (n >= V.PERSON_MIN_CHARS) & (n <= V.PERSON_MAX_CHARS)
        & (F.size(w) >= V.PERSON_MIN_WORDS) & (F.size(w) <= V.PERSON_MAX_WORDS)
        & ~v.rlike(PY_DIGIT)
        & (F.instr(v, "@") == 0)
        & (F.instr(lower, "www.") == 0)
        & ~v.rlike(r"[/:\t\n]")
        & ~lower.isin(V.PERSON_BLOCKLIST)
        & ~F.coalesce(F.try_element_at(w, F.lit(1)).rlike(r"^[A-Za-z]\.?$"), F.lit(False))
        & ~F.exists(w, lambda x: F.btrim(_fold(x), strip).isin(non_person))
        & ~lower.rlike(_word_regex(V.LOCATION_COMPOUND_WORDS))
        & _alpha_ratio_ok(v)
        & (caps >= 2)
    )
    if propn_count is None:
        return shape_ok
    if initial_count is None:
        initial_count = F.lit(None).cast("int")
    pos_ok = F.when(propn_count.isNull(), caps >= 2).otherwise(
        (propn_count >= 2) | ((propn_count >= 1) & (initial_count >= 1) & (F.size(w) >= 2))
    )
    return shape_ok & F.coalesce(pos_ok, F.lit(False))


def looks_like_person_name(value: Column, propn_count: Column | None = None,
                           initial_count: Column | None = None) -> Column:
    """Person shape gate followed by the proper-noun gate.

    With ``propn_count`` null (no part-of-speech analysis) the gate falls back
    to ">= 2 capitalised words", which the shape gate already requires.
    """
    v = gate_value(value)
    return _person_gate_parts(v, casefold(v), words(py_strip(v)), propn_count, initial_count)


# --------------------------------------------------------------------------
# C5: name shape score
# --------------------------------------------------------------------------

def _result(score, reasons: list) -> Column:
    return F.struct(
        F.lit(score).cast("int").alias("score") if not isinstance(score, Column) else score.cast("int").alias("score"),
        F.array(*[r if isinstance(r, Column) else F.lit(r) for r in reasons]).cast("array<string>").alias("reasons"),
    )


def name_shape_score(value: Column) -> Column:
    """``struct<score:int, reasons:array<string>>`` for how name-like a value is."""
    v = F.regexp_replace(py_strip(value), rf"(?U){V.WS}+", " ")
    lower = casefold(v)
    return _shape_parts(v, lower, words(v), words(lower))


def _shape_parts(v: Column, lower: Column, w: Column, lw: Column) -> Column:
    bad = F.array_sort(F.array_distinct(F.filter(lw, lambda x: x.isin(V.PERSON_NON_NAME_WORDS))))
    caps = F.size(F.filter(
        F.transform(w, lambda x: F.regexp_replace(x, V.SHAPE_LETTERS, "")),
        lambda x: x.rlike(r"^\p{Lu}"),
    ))
    once = F.struct(bad.alias("bad"), _alpha_ratio_ok(v).alias("alpha_ok"), caps.alias("caps"))
    return bound(once, lambda q: _shape_of(v, lower, w, q["bad"], q["alpha_ok"], q["caps"]))


def _shape_of(v: Column, lower: Column, w: Column, bad: Column, alpha_ok: Column, caps: Column) -> Column:
    n = F.length(v)
    alpha_pts = F.when(alpha_ok, 1).otherwise(-2)
    alpha_reason = F.when(alpha_ok, "mostly alphabetic").otherwise("not mostly alphabetic")
    cap_pts = F.when(caps == F.size(w), 1).when(caps >= 2, 0).otherwise(-1)
    cap_reason = (F.when(caps == F.size(w), "proper capitalization")
                  .when(caps >= 2, "partially capitalized").otherwise("poor capitalization"))
    return (
        F.when((n < V.PERSON_MIN_CHARS) | (n > V.PERSON_MAX_CHARS), _result(0, []))
        .when((F.size(w) < V.PERSON_MIN_WORDS) | (F.size(w) > V.PERSON_MAX_WORDS),
              _result(1, ["reasonable length"]))
        .when(v.rlike(PY_DIGIT), _result(-5, ["contains number"]))
        .when(F.instr(v, "@") > 0, _result(-5, ["email"]))
        .when(F.instr(lower, "www.") > 0, _result(-5, ["website"]))
        .when(v.rlike(r"[/:\t\n]"), _result(-4, ["contains separator"]))
        .when(lower.isin(V.PERSON_BLOCKLIST), _result(-5, ["blocked phrase"]))
        .when(F.size(bad) > 0,
              _result(-4, [F.concat(F.lit("non-person words: "), F.array_join(bad, ", "))]))
        .otherwise(_result(3 + alpha_pts + cap_pts,
                           ["reasonable length", "2-5 words", alpha_reason, cap_reason]))
    )


# --------------------------------------------------------------------------
# C6 + C7: context score
# --------------------------------------------------------------------------

PERSON_CONTEXT_RE = _word_regex(V.PERSON_CONTEXT_TERMS)
NON_PERSON_CONTEXT_RE = _word_regex(V.NON_PERSON_CONTEXT_TERMS)


def context_window(text: Column, start: Column, end: Column) -> Column:
    lo = F.greatest(start - V.CONTEXT_CHARS, F.lit(0))
    hi = F.least(F.length(text), end + V.CONTEXT_CHARS)
    return F.substring(text, lo + 1, hi - lo)


def person_confidence(text: Column, start: Column, end: Column, value: Column) -> Column:
    """Base 2 + shape score, +3 person context, -3 non-person context, -4 sentence words."""
    return _confidence_parts(context_window(text, start, end), name_shape_score(value), value)


def _confidence_parts(ctx: Column, shape: Column, value: Column) -> Column:
    return _confidence_of(ctx.rlike(PERSON_CONTEXT_RE), ctx.rlike(NON_PERSON_CONTEXT_RE), shape, _sentence_words(value))


def _sentence_words(value: Column) -> Column:
    cand_words = F.array_distinct(F.transform(
        F.regexp_extract_all(value, F.lit("([A-Za-z]+)"), 1), lambda x: F.lower(x)))
    return F.array_sort(F.filter(cand_words, lambda x: x.isin(V.SENTENCE_WORDS)))


def _confidence_of(person_ctx: Column, non_person_ctx: Column, shape: Column, overlap: Column) -> Column:
    score = (F.lit(2) + shape["score"]
             + F.when(person_ctx, 3).otherwise(0)
             - F.when(non_person_ctx, 3).otherwise(0)
             - F.when(F.size(overlap) > 0, 4).otherwise(0))
    empty = F.array().cast("array<string>")
    reasons = F.flatten(F.array(
        F.array(F.lit("ner PERSON")),
        shape["reasons"],
        F.when(person_ctx, F.array(F.lit("person context"))).otherwise(empty),
        F.when(non_person_ctx, F.array(F.lit("non-person context"))).otherwise(empty),
        F.when(F.size(overlap) > 0,
               F.array(F.concat(F.lit("sentence-like words: "), F.array_join(overlap, ", ")))
               ).otherwise(empty),
    ))
    return F.struct(score.cast("int").alias("score"), reasons.alias("reasons"))


# --------------------------------------------------------------------------
# C9: organisation gate
# --------------------------------------------------------------------------

ORG_MARK = _one_of(V.ORG_STRONG_SUFFIXES, r"\z") + "|" + _one_of(V.ORG_SPECIAL_INDICATORS)


def looks_like_organization(value: Column) -> Column:
    v = F.regexp_replace(py_strip(value), rf"(?U){V.WS}+", " ")
    return _org_parts(v, casefold(v))


def _org_parts(v: Column, lower: Column) -> Column:
    n = F.length(v)
    truncated = lower.rlike(_one_of(V.ORG_TRUNCATED_ENDINGS, r"\z"))
    doc_term = lower.rlike(_one_of(V.ORG_DOCUMENT_TERMS))
    return (
        (n >= V.ORG_MIN_CHARS) & (n <= V.ORG_MAX_CHARS)
        & ~lower.rlike(rf"(?U)^the{V.WS}+offer\b")
        & ~lower.rlike(rf"(?U)^the{V.WS}+issue\b")
        & ~truncated
        & ~lower.isin(V.ORG_BLOCKLIST)
        & ~doc_term
        & ~lower.isin(V.ORG_GENERIC_NAMES)
        & lower.rlike(ORG_MARK)
    )


# --------------------------------------------------------------------------
# C1a: stand-in tagger
# --------------------------------------------------------------------------

_CAP_WORD = r"(?:\p{Lu}\.|(?:Ltd|Inc|Corp|Pvt|Co)\.|\p{Lu}[\p{L}'’-]+)"
# No lookarounds: the same leftmost-first matches in any backtracking or RE2 engine.
CAPITALISED_RUN = _CAP_WORD + r"(?:[ ]+(?:(?:of|and|&)[ ]+)?" + _CAP_WORD + r"){1,5}"


def _org_marked(value: Column) -> Column:
    return _fold(value).rlike(ORG_MARK)


def capitalised_run_candidates(text: Column) -> Column:
    """``array<candidate>`` from runs of capitalised words (no model)."""
    found = spans(text, r"(?=\p{Lu})" + CAPITALISED_RUN)       # most places fail at the first letter
    return F.transform(found, lambda s: F.struct(
        s["value"].alias("value"),
        F.when(_org_marked(s["value"]), "ORG").otherwise("PERSON").alias("label"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        F.lit(None).cast("int").alias("propn_count"),
        F.lit(None).cast("int").alias("initial_count"),
    )).cast(f"array<{CANDIDATE_TYPE}>")


# --------------------------------------------------------------------------
# C2 + C8: scoring an array of candidates inside one unit
# --------------------------------------------------------------------------

def person_norm(value: Column) -> Column:
    return F.regexp_replace(_fold(value), rf"(?U){V.WS}+", " ")


# Each stage is a struct of stored values, so that no regex or word list is evaluated again for
# every use of it; what only the confidence score needs is left out where the gate says no.

def _prepare(c: Column) -> Column:
    """Stage 1: the cleaned forms of a candidate."""
    sv = F.regexp_replace(py_strip(c["value"]), rf"(?U){V.WS}+", " ")
    return F.struct(c.alias("c"), gate_value(c["value"]).alias("gv"), sv.alias("sv"))


def _prepare2(p: Column) -> Column:
    """Stage 2: lower-case forms and words of what the gate looks at."""
    return F.struct(p["c"].alias("c"), p["gv"].alias("gv"), p["sv"].alias("sv"), _fold(p["gv"]).alias("g_lower"),
                    F.array_remove(F.split(py_strip(p["gv"]), " "), "").alias("g_words"), _fold(p["sv"]).alias("s_lower"))


def _prepare3(p: Column) -> Column:
    """Stage 3: the person gate."""
    c = p["c"]
    gate = _person_gate_parts(p["gv"], p["g_lower"], p["g_words"], c["propn_count"], c["initial_count"])
    return F.struct(c.alias("c"), p["sv"].alias("sv"), p["s_lower"].alias("s_lower"),
                    F.when(c["label"] == "PERSON", gate).otherwise(False).alias("gate"))


def _prepare4(text: Column, p: Column) -> Column:
    """Stage 4: the context and words of a candidate that the gate does not turn away."""
    c, past = p["c"], F.coalesce(p["gate"], F.lit(True))
    return F.struct(c.alias("c"), p["sv"].alias("sv"), p["s_lower"].alias("s_lower"), p["gate"].alias("gate"), past.alias("past"),
                    F.when(past, context_window(text, c["start"], c["end"])).alias("ctx"),
                    F.when(past, words(p["sv"])).alias("s_words"), F.when(past, words(p["s_lower"])).alias("l_words"))


def _prepare5(p: Column) -> Column:
    """Stage 5: what the confidence score adds up."""
    past = p["past"]
    return F.struct(p["c"].alias("c"), p["sv"].alias("sv"), p["s_lower"].alias("s_lower"), p["gate"].alias("gate"),
                    F.when(past, _shape_parts(p["sv"], p["s_lower"], p["s_words"], p["l_words"])).alias("shape"),
                    F.when(past, p["ctx"].rlike(PERSON_CONTEXT_RE)).alias("person_ctx"),
                    F.when(past, p["ctx"].rlike(NON_PERSON_CONTEXT_RE)).alias("non_person_ctx"),
                    F.when(past, _sentence_words(p["c"]["value"])).alias("overlap"))


def _score_one(p: Column) -> Column:
    c, gate = p["c"], p["gate"]
    conf = _confidence_of(p["person_ctx"], p["non_person_ctx"], p["shape"], p["overlap"])
    is_person = c["label"] == "PERSON"
    accepted = F.when(is_person, gate & (conf["score"] >= V.ACCEPT_SCORE)).otherwise(
        _org_parts(p["sv"], p["s_lower"]))
    score = F.when(is_person, F.when(gate, conf["score"]).otherwise(V.SHAPE_REJECT_SCORE))
    reasons = F.when(is_person, F.when(gate, conf["reasons"]).otherwise(
        F.array(F.lit(V.SHAPE_REJECT_REASON))))
    return F.struct(
        c["value"].alias("value"), c["label"].alias("label"), c["start"].alias("start"),
        c["end"].alias("end"), accepted.alias("accepted"), score.cast("int").alias("score"),
        reasons.alias("reasons"),
    )


def first_mentions(named: Column) -> Column:
    """Candidates of ``array<struct<c,n>>`` in their order, of PERSON ones only the first of each name ``n``.

    Sorted by name and place, a first mention is one whose neighbour has another name."""
    placed = F.transform(named, lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"), x["c"].alias("c")))

    def firsts(p: Column) -> Column:
        by_name = F.array_sort(F.filter(p, lambda x: x["c"]["label"] == "PERSON"))
        first = bound(by_name, lambda s: F.filter(s, lambda x, j: (j == 0) | ~F.get(s, j - 1)["n"].eqNullSafe(x["n"])))
        others = F.filter(p, lambda x: x["c"]["label"] != "PERSON")
        placed_again = F.transform(F.concat(first, others), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))
        return F.transform(F.array_sort(placed_again), lambda x: x["c"])

    return bound(placed, firsts)


def _named(cands: Column) -> Column:
    return F.transform(F.filter(cands, lambda c: c["label"].isin("PERSON", "ORG")),
                       lambda c: F.struct(c.alias("c"), person_norm(c["value"]).alias("n")))


def score_candidates(text: Column, cands: Column, propagate_names: bool = False) -> Column:
    """Validate one unit's candidates: ``array<scored>`` for PERSON and ORG.

    PERSON candidates are deduplicated to their first mention (by casefolded,
    whitespace-collapsed value) before validation unless ``propagate_names``.
    Other labels are dropped.  For DataFrames prefer :func:`score_units`,
    which materialises the normalised values once per unit.
    """
    named = _named(cands)
    return _score_array(text, F.transform(named, lambda x: x["c"]) if propagate_names else first_mentions(named))


def _score_array(text: Column, cands: Column) -> Column:
    gated = F.transform(F.transform(F.transform(cands, _prepare), _prepare2), _prepare3)
    staged = F.transform(F.transform(gated, lambda p: _prepare4(text, p)), _prepare5)
    return F.transform(staged, _score_one).cast(f"array<{SCORED_TYPE}>")


def score_units(df: DataFrame, keep: list[str], cands_col: str = "cands", text_col: str = "text",
                propagate_names: bool = False, out_col: str = "scored") -> DataFrame:
    """Add ``scored`` to a DataFrame holding ``text`` and a candidate array.

    Each stage is its own projection so an array is never re-derived inside
    another element's lambda: normalised values are computed once per
    candidate, then the first-mention filter compares stored values.
    """
    normed = df.select(*keep, text_col, _named(F.col(cands_col)).alias("_cn"))
    firsts = F.transform("_cn", lambda x: x["c"]) if propagate_names else first_mentions(F.col("_cn"))
    firsts_df = normed.select(*keep, text_col, firsts.alias("_first"))
    # Through an array of one row: the optimiser cannot copy the scores into a filter or a join condition above.
    row = F.struct(*keep, text_col, _score_array(F.col(text_col), F.col("_first")).alias(out_col))
    return firsts_df.select(F.inline(F.array(row)))


def ner_findings(scored: Column) -> Column:
    """Accepted candidates as findings (PERSON: score tiers; ORG: MEDIUM)."""
    kept = F.filter(scored, lambda s: s["accepted"])
    return F.transform(kept, lambda s: F.struct(
        F.when(s["label"] == "PERSON", "PERSON").otherwise("ORGANIZATION").alias("pii_type"),
        s["value"].alias("value"),
        s["start"].alias("start"),
        s["end"].alias("end"),
        F.when(s["label"] == "ORG", "MEDIUM")
        .when(s["score"] >= V.HIGH_SCORE, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.lit("ner").alias("source"),
        F.when(s["label"] == "PERSON", s["score"]).cast("int").alias("score"),
        F.lit(V.SEQ_NER).alias("seq"),
    )).cast(FINDINGS_TYPE)


# --------------------------------------------------------------------------
# C1: candidate tables and pluggable taggers
# --------------------------------------------------------------------------

def candidates_by_unit(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Fold a candidate table into ``(key..., cands array)`` ordered by start."""
    c = candidates.select(*key, F.struct(
        py_strip(F.col("value")).alias("value"), F.col("label").cast("string").alias("label"),
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.col("propn_count").cast("int").alias("propn_count"),
        F.col("initial_count").cast("int").alias("initial_count"),
    ).alias("c"))
    return c.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("c.start").alias("s"), "c"))),
                    lambda x: x["c"]).cast(f"array<{CANDIDATE_TYPE}>").alias("cands"))


def tagged_candidates(units: DataFrame, key: list[str],
                      tagger: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Candidates from any tagger, run over Arrow batches of ``key..., text``.

    The tagger yields frames of ``key..., value, label, start, end, propn_count,
    initial_count`` (labels PERSON and ORG; counts of proper nouns and initials in
    the value after :func:`gate_value` cleaning, or null).  A model is loaded
    inside the tagger, once per iterator.
    """
    schema = ", ".join(f"{k} {units.schema[k].dataType.simpleString()}" for k in key)
    return units.select(*key, "text").mapInPandas(
        tagger, schema + ", value string, label string, start int, end int, propn_count int, initial_count int")


def empty_scored() -> Column:
    return F.array().cast(f"array<{SCORED_TYPE}>")


__all__ = [
    "looks_like_person_name", "name_shape_score", "person_confidence",
    "looks_like_organization", "capitalised_run_candidates", "score_candidates",
    "ner_findings", "candidates_by_unit", "tagged_candidates",
    "no_findings", "empty_scored", "person_norm", "context_window",
]
