"""Structured addresses in texts with very long number lists.

The address pattern starts with a list of numbers of any length, and the Java matcher
recurses once per list item, so a line of a thousand numbers would end the
executor.  Such texts (and only those) are scanned here over their number tokens, in
linear time and as a Catalyst expression.

A match starts at a number and runs over the list it begins.  It ends at the first
6-digit number within 220 characters after the list, or else at the last one inside it
that a separator without line end precedes, plus up to 80 characters.

1. One pattern without repetition groups splits the text into numbers and the gaps between.
2. A fold from the right gives every number, as the start of a list: where the list ends, the
   next 6-digit number and the next stop character behind it, the last 6-digit number inside
   it, and so the end of the match, if there is one.
3. A fold from the left takes the matches that do not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .spans import MARK, SPAN_TYPE, STEP, bound

PIN_DIGITS = 6
GAP_CHARS = 220            # between the list and the 6-digit number
TAIL_CHARS = 80            # after it
BLOCK = 4096               # characters of the blocks that values are cut from

# A number as the fold sees it; ``pin``: the first 6-digit number from it on; ``run_*``: of the list it begins.
_PIN = "struct<start:int,tail:int>"
_TOKEN = (f"struct<end:int,stop:int,tail:int,usable:boolean,slash:boolean,comma:boolean,pin:{_PIN},"
          f"run_end:int,run_stop:int,run_pin:{_PIN},inner:int>")
_STARTS = "array<struct<start:int,until:int>>"


def _tokens(text: Column) -> Column:
    """Array of numbers with their positions and the gaps before (``gap``) and after (``then``)."""
    safe = F.translate(text, MARK, "�")
    parts = F.split(F.regexp_replace(safe, r"(?U)\d+", f"{MARK}$0{MARK}"), MARK, -1)

    def positions(ps: Column) -> Column:
        empty = F.array().cast("array<int>")

        def one(acc, p):
            return F.struct((acc["pos"] + F.length(p)).alias("pos"), F.concat(acc["at"], F.array(acc["pos"])).alias("at"))

        def some(acc, first):
            inner = F.aggregate(F.slice(ps, first, STEP), F.struct(acc["pos"], empty.alias("at")), one)
            return F.struct(inner["pos"].alias("pos"), F.concat(acc["at"], inner["at"]).alias("at"))

        return F.aggregate(F.sequence(F.lit(1), F.size(ps), F.lit(STEP)), F.struct(F.lit(0).alias("pos"), empty.alias("at")), some,
                           lambda acc: acc["at"])

    def made(ps: Column, at: Column) -> Column:
        def token(i):
            start, n = F.get(at, i), F.length(F.get(ps, i))
            return F.struct(start.alias("start"), (start + n).alias("end"), n.alias("n"), F.get(ps, i - 1).alias("gap"),
                            F.get(ps, i + 1).alias("then"))
        return F.transform(F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2)), token)

    return bound(parts, lambda ps: bound(positions(ps), lambda at: F.when(F.size(ps) > 2, made(ps, at))))


def _described(tokens: Column) -> Column:
    """What the gaps say about every number."""
    def facts(t):
        begins = ~t["gap"].rlike(V.WORD_CHAR + r"\z")       # not $, which also stands before a last line end
        pin = begins & (t["n"] == PIN_DIGITS) & ~t["then"].rlike("^" + V.WORD_CHAR)
        comma = t["gap"].rlike(rf"(?U)^{V.WS}*+,{V.WS}*+\z")
        slash = t["gap"] == "/"
        usable = pin & (slash | comma & ~t["gap"].rlike(r"[.\n;]") & (F.length(t["gap"]) <= GAP_CHARS))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), begins.alias("begins"), pin.alias("pin"), comma.alias("comma"),
                        slash.alias("slash"), usable.alias("usable"), F.regexp_instr(t["then"], F.lit(r"[.\n;]")).alias("stop"))
    return F.transform(tokens, facts)


def _match_ends(tokens: Column, size: Column) -> Column:
    """From the right: (start, until) of the match that would start at every number; ``until`` null if none would."""
    none = F.lit(None).cast("int")
    beyond = F.struct(none.alias("end"), size.alias("stop"), none.alias("tail"), F.lit(False).alias("usable"), F.lit(False).alias("slash"),
                      F.lit(False).alias("comma"), F.lit(None).cast(_PIN).alias("pin"), none.alias("run_end"), none.alias("run_stop"),
                      F.lit(None).cast(_PIN).alias("run_pin"), none.alias("inner")).cast(_TOKEN)

    def read(t, p1, p2):
        """The token's record from those of the two numbers after it."""
        stop = F.when(t["stop"] > 0, t["end"] + t["stop"] - 1).otherwise(p1["stop"])
        half = p1["slash"]
        goes_on = F.when(half, p2["comma"]).otherwise(p1["comma"])
        n = F.when(half, p2).otherwise(p1)
        own_half = F.when(half & p1["usable"], p1["tail"])

        def with_stop(s):
            tail = F.least(t["end"] + TAIL_CHARS, s)
            pin = F.when(t["pin"], F.struct(t["start"].alias("start"), tail.alias("tail"))).otherwise(p1["pin"])
            inner = F.when(goes_on, F.coalesce(n["inner"], F.when(n["usable"], n["tail"]), own_half)).otherwise(own_half)
            return F.struct(
                t["end"].alias("end"), s.alias("stop"), tail.alias("tail"), t["usable"].alias("usable"), t["slash"].alias("slash"),
                t["comma"].alias("comma"), pin.alias("pin"),
                F.when(goes_on, n["run_end"]).when(half, p1["end"]).otherwise(t["end"]).alias("run_end"),
                F.when(goes_on, n["run_stop"]).when(half, p1["stop"]).otherwise(s).alias("run_stop"),
                F.when(goes_on, n["run_pin"]).when(half, p2["pin"]).otherwise(p1["pin"]).alias("run_pin"), inner.alias("inner")).cast(_TOKEN)

        return bound(stop, with_stop)

    def one(acc, t):
        def found(r):
            near = (r["run_pin"]["start"] - r["run_end"] <= GAP_CHARS) & (r["run_stop"] >= r["run_pin"]["start"])
            until = F.when(t["begins"], F.when(near, r["run_pin"]["tail"]).otherwise(r["inner"]))
            return F.struct(r.alias("p1"), acc["p1"].alias("p2"),
                            F.concat(acc["out"], F.array(F.struct(t["start"].alias("start"), until.alias("until")))).alias("out"))
        return bound(read(t, acc["p1"], acc["p2"]), found)

    empty = F.array().cast(_STARTS)

    def some(acc, ts, first):
        inner = F.aggregate(F.slice(ts, first, STEP), F.struct(acc["p1"], acc["p2"], empty.alias("out")), one)
        return F.struct(inner["p1"].alias("p1"), inner["p2"].alias("p2"), F.concat(acc["out"], inner["out"]).alias("out"))

    start = F.struct(beyond.alias("p1"), beyond.alias("p2"), empty.alias("out"))
    return bound(F.reverse(tokens), lambda ts: F.aggregate(F.sequence(F.lit(1), F.size(ts), F.lit(STEP)), start,
                                                            lambda acc, first: some(acc, ts, first), lambda acc: F.reverse(acc["out"])))


def _apart(starts: Column) -> Column:
    """From the left: the matches that start at or after the end of the last one taken."""
    empty = F.array().cast(_STARTS)

    def one(acc, s):
        take = s["start"] >= acc["at"]
        return F.struct(F.when(take, s["until"]).otherwise(acc["at"]).alias("at"),
                        F.when(take, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    def some(acc, ss, first):
        inner = F.aggregate(F.slice(ss, first, STEP), F.struct(acc["at"], empty.alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))

    init = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return bound(F.filter(starts, lambda s: s["until"].isNotNull()), lambda ss: F.when(F.size(ss) > 0, F.aggregate(
        F.sequence(F.lit(1), F.size(ss), F.lit(STEP)), init, lambda acc, first: some(acc, ss, first), lambda acc: acc["out"])))


def _cut(text: Column, matches: Column) -> Column:
    """Values of the matches, cut from blocks so that a long text is walked once."""
    def values(blocks):
        def value(m):
            first, last = F.floor(m["start"] / BLOCK).cast("int"), F.floor((m["until"] - 1) / BLOCK).cast("int")
            part = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
            return F.struct(F.substring(part, m["start"] - first * BLOCK + 1, m["until"] - m["start"]).alias("value"),
                            m["start"].alias("start"), m["until"].alias("end"))
        return F.transform(matches, value)

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")),
                         lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))
    return bound(blocks, values)


def long_list_spans(text: Column) -> Column:
    """Spans of the address pattern as ``array<struct<value,start,end>>``; null gives none."""
    found = bound(_tokens(text), lambda ts: F.when(ts.isNotNull(), bound(_described(ts), lambda ds: bound(
        _match_ends(ds, F.length(text)), _apart))))
    return F.coalesce(bound(found, lambda ms: F.when(ms.isNotNull(), _cut(text, ms))), F.array()).cast(SPAN_TYPE)
