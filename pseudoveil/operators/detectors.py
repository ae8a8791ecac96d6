"""Pattern detectors and label-context persons (column expressions).

Each detector maps a text column to ``array<finding>``; they run in one
projection over the text units, so detection is a narrow stage with no
shuffle.  Cheap prefilters skip the regex for text that cannot match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.checks import clean_address, ipv4_valid, looks_like_address, luhn_valid
from ..functions.number_lists import long_list_spans
from ..functions.spans import spans
from ..functions.text import collapse_ws, sql_array, words

FINDING_TYPE = (
    "struct<pii_type:string,value:string,start:int,end:int,"
    "confidence:string,source:string,score:int,seq:int>"
)
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"


def no_findings() -> Column:
    return F.array().cast(FINDINGS_TYPE)


def as_findings(sp: Column, pii_type: str, seq: int, source: str = "regex",
                confidence: str = "HIGH", score: int | None = None) -> Column:
    """Turn ``array<struct<value,start,end>>`` into findings of one type."""
    return F.transform(
        sp,
        lambda s: F.struct(
            F.lit(pii_type).alias("pii_type"),
            s["value"].alias("value"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(confidence).alias("confidence"),
            F.lit(source).alias("source"),
            F.lit(score).cast("int").alias("score"),
            F.lit(seq).alias("seq"),
        ),
    ).cast(FINDINGS_TYPE)


def _gated(cond: Column, found: Column) -> Column:
    return F.when(cond, found).otherwise(no_findings())


def email_spans(text: Column) -> Column:
    return _gated(F.instr(text, "@") > 0,
                  as_findings(spans(text, V.EMAIL_PATTERN), "EMAIL", V.SEQ_EMAIL))


def phone_spans(text: Column) -> Column:
    # The digit normal form always holds for a match, so no extra filter.
    return _gated(text.rlike(r"(?U)[6-9]\d{4}"),
                  as_findings(spans(text, V.PHONE_PATTERN), "PHONE", V.SEQ_PHONE))


def ssn_spans(text: Column) -> Column:
    return _gated((F.instr(text, "-") > 0) & text.rlike(r"(?U)-\d{2}-\d"),
                  as_findings(spans(text, V.SSN_PATTERN), "SSN", V.SEQ_SSN))


def ip_spans(text: Column) -> Column:
    found = F.filter(spans(text, V.IP_PATTERN), lambda s: ipv4_valid(s["value"]))
    return _gated((F.instr(text, ".") > 0) & text.rlike(r"(?U)\d\.\d"), as_findings(found, "IP_ADDRESS", V.SEQ_IP))


def card_spans(text: Column) -> Column:
    found = F.filter(spans(text, V.CARD_PATTERN), lambda s: luhn_valid(s["value"]))
    return _gated(text.rlike(r"(?U)\d(?:[ -]?\d){12}"), as_findings(found, "CREDIT_CARD", V.SEQ_CARD))


def dob_spans(text: Column) -> Column:
    found = spans(text, V.DOB_PATTERN, group=2)
    return _gated(text.rlike(r"(?U)\d") & text.rlike(r"(?iU)(?=[bd])(?:birth|dob|born)"), as_findings(found, "DATE", V.SEQ_DATE))


def address_spans(text: Column) -> Column:
    """Structured address: value is cleaned, the span keeps the full match."""
    long_list = text.rlike(V.LONG_LIST)
    short = F.when(~long_list, text)
    raw = F.when(long_list, long_list_spans(text)).otherwise(spans(short, V.ADDRESS_STRUCTURED_PATTERN))
    cleaned = F.transform(
        raw, lambda s: F.struct(clean_address(s["value"]).alias("value"), s["start"], s["end"])
    )
    kept = F.filter(cleaned, lambda s: (s["value"] != "") & looks_like_address(s["value"]))
    return _gated(text.rlike(V.ADDRESS_GATE), as_findings(kept, "ADDRESS", V.SEQ_ADDRESS))


def labelled_address_spans(text: Column) -> Column:
    """Label-anchored address (off unless ``Config.labelled_address``)."""
    found = spans(text, V.ADDRESS_LABELLED_PATTERN, group=2)
    return _gated(text.rlike(r"(?iU)address|office"), as_findings(found, "ADDRESS", V.SEQ_ADDRESS))


def person_label_pattern(ignore_case: bool = False) -> str:
    """``(label prefix)(name)``; labels match lower case only unless ``ignore_case``."""
    labels = "|".join(lbl.replace(r"\s", V.WS) for lbl in V.PERSON_LABELS)
    first = "[" + "".join(sorted({lbl[0] for lbl in V.PERSON_LABELS})) + "]"
    lab = f"(?i:(?={first})(?:{labels}))" if ignore_case else f"(?={first})(?:{labels})"
    word = V.PERSON_NAME_WORD
    return (
        f"(?U)({lab}{V.WS}*[:\\-]{V.WS}*(?:\\n{V.WS}*)?)"
        f"({word}(?:{V.WS}+{word}){{1,4}})"
    )


def looks_like_name(value: Column) -> Column:
    """Label-context name filter: 2-5 words, <=70 chars, no digit/@, no blocked word."""
    v = collapse_ws(value)
    w = words(v)
    lw = F.transform(w, lambda x: F.lower(x))
    return (
        (F.size(w) >= 2) & (F.size(w) <= 5)
        & (F.length(v) <= V.CONTEXT_MAX_CHARS)
        & ~v.rlike(r"(?U)\d")
        & (F.instr(v, "@") == 0)
        & ~F.arrays_overlap(lw, sql_array(V.CONTEXT_BLOCKED_WORDS))
    )


def context_person_spans(text: Column, ignore_case: bool = False) -> Column:
    found = F.filter(spans(text, person_label_pattern(ignore_case), group=2),
                     lambda s: looks_like_name(s["value"]))
    gate = ((F.instr(text, ":") > 0) | (F.instr(text, "-") > 0)) \
        & text.rlike(r"(?iU)(?=[pdos])(?:person|promoter|shareholder|director|officer|secretary)")
    return _gated(gate, as_findings(found, "PERSON", V.SEQ_CONTEXT, source="context",
                                    confidence="HIGH", score=V.CONTEXT_PERSON_SCORE))


def detect_regex(text: Column, labelled_address: bool = False) -> Column:
    """All pattern detectors, in emission order."""
    parts = [
        email_spans(text), phone_spans(text), ssn_spans(text), ip_spans(text),
        card_spans(text), dob_spans(text), address_spans(text),
    ]
    if labelled_address:
        parts.append(labelled_address_spans(text))
    return F.concat(*parts)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(rf"(?U)[^{V.WS_CLASS}]")
