"""Positional regex matches as a Catalyst expression.

Spark has ``regexp_extract_all`` (values, no positions) and ``regexp_instr``
(first match only).  ``spans`` returns every non-overlapping match, left to
right, with code-point offsets ``[start, end)`` — the same as Python's
``re.finditer`` for patterns that cannot match the empty string:

1. ``regexp_replace`` wraps each match (or its value group) in U+E000 markers;
2. ``split`` on the marker: odd segments are the matches;
3. ``aggregate`` walks the segments keeping a running code-point position (only if there is a match).

Text that already holds U+E000 is scanned with the marker swapped for U+FFFD
(same length, same regex classes) and the values are cut from the original.
Everything stays in the JVM; nothing is evaluated in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\uE000"
STEP = 256      # matches gathered at a time: appending to one long array would be quadratic
SPAN_TYPE = "array<struct<value:string,start:int,end:int>>"


def empty_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern`` in ``text`` as ``array<struct<value,start,end>>``.

    ``group=0`` takes the whole match.  ``group=2`` expects a pattern made of
    exactly two capturing groups ``(prefix)(value)`` and takes the value.
    """
    if group not in (0, 2):
        raise ValueError("group must be 0 (whole match) or 2 (prefix, value)")
    repl = f"{MARK}$0{MARK}" if group == 0 else f"$1{MARK}$2{MARK}"

    def step(acc, seg):
        n = F.length(seg)
        hit = F.struct(
            seg.alias("value"),
            acc["pos"].alias("start"),
            (acc["pos"] + n).alias("end"),
        )
        out = F.when(acc["i"] % 2 == 1, F.array_append(acc["out"], hit)).otherwise(acc["out"])
        return F.struct((acc["pos"] + n).alias("pos"), (acc["i"] + 1).alias("i"), out.alias("out"))

    def block(acc, segs, first):
        inner = F.aggregate(F.slice(segs, first, STEP), F.struct(acc["pos"], acc["i"], empty_spans().alias("out")), step)
        return F.struct(inner["pos"].alias("pos"), inner["i"].alias("i"), F.concat(acc["out"], inner["out"]).alias("out"))

    init = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("i"), empty_spans().alias("out"))

    def walk(m):
        return bound(F.split(m, MARK, -1), lambda segs: F.aggregate(F.sequence(F.lit(1), F.size(segs), F.lit(STEP)), init,
                                                                    lambda acc, first: block(acc, segs, first), lambda acc: acc["out"]))

    safe = F.translate(text, MARK, "\uFFFD")
    exact = F.transform(
        bound(F.regexp_replace(safe, pattern, repl), walk),
        lambda s: F.struct(
            F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        ),
    )
    # Most texts have no match and come out as they were: one comparison, no search for the marker.
    found = bound(F.regexp_replace(text, pattern, repl), lambda m: F.when(m == text, empty_spans())
                  .when(F.instr(text, MARK) > 0, exact).otherwise(walk(m)))
    return F.when(text.isNull(), empty_spans()).otherwise(found)
