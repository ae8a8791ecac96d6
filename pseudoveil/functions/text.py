"""String helpers that follow Python ``str`` semantics with Spark built-ins.

Spark's ``trim`` strips only spaces and ``lower`` is not ``casefold``; these
helpers close the gaps that matter for matching keys and gates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import WS

def py_strip(c: Column) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    """``re.sub(r"\\s+", " ", value.strip())``."""
    return F.regexp_replace(py_strip(c), rf"(?U){WS}+", " ")


# Characters whose casefold differs from their lower-case form (full folding).
_FOLD_FROM = ["ß", "ẞ", "ς", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ"]
_FOLD_TO = ["ss", "ss", "σ", "ff", "fi", "fl", "ffi", "ffl", "st", "st"]


def casefold(c: Column) -> Column:
    """``str.casefold()`` approximated as ``lower`` plus the common full folds."""
    out = F.lower(c)
    for a, b in zip(_FOLD_FROM, _FOLD_TO):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_key(c: Column) -> Column:
    """Mapping key: strip, collapse whitespace, drop one leading ``the``, casefold."""
    v = collapse_ws(c)
    v = F.regexp_replace(v, rf"(?iU)^the{WS}+", "")
    return casefold(v)


def summary_key(c: Column) -> Column:
    """Audit key: strip, collapse whitespace, casefold (``the`` is kept)."""
    return casefold(collapse_ws(c))


def words(c: Column) -> Column:
    """``value.split()`` on an already collapsed value (empty value -> [])."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def strip_chars(c: Column, chars: str) -> Column:
    """``str.strip(chars)`` for a fixed set of characters."""
    cls = "".join("\\" + ch if ch in "\\^-]" else ch for ch in chars)
    return F.regexp_replace(c, f"^[{cls}]+|[{cls}]+$", "")


def sql_array(values: list[str]) -> Column:
    """A literal ``array<string>``."""
    return F.array(*[F.lit(v) for v in values])
