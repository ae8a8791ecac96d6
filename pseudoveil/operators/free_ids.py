"""Ids whose fakes may be free of observed values, by the parts that fakes are made of.

A fake is a row of parts, one for each digit of its id in a mixed radix (:data:`PARTS`).  If a part has an observed
value in it, so has every fake with this part: only ids of clean parts need a test of their whole fakes, and
these ids are counted and listed by arithmetic, however many others lie between them.

If all choices of a part have observed values in them (``le`` is part of all of ``@example.net``), no fake of the
type avoids these values; they are passed over for that type and refuse none of its fakes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from . import surrogates as S

MOST = 1 << 53                                          # ids go as far: fakes are exact below
ANY = range(MOST)                                       # a last digit without an end


def _two(heads: list[str], tails: list[str]) -> list[str]:
    """The two-syllable words in the order of their numbers."""
    return [h + t for t in tails for h in heads]


_FIRST, _SURNAME = _two(S.NAME_HEADS, S.NAME_TAILS), _two(S.SURNAME_HEADS, S.SURNAME_TAILS)
_ORG_WORD = [a + b.lower() + c for c in S.NAME_TAILS for b in S.NAME_HEADS for a in S.SURNAME_HEADS]

#: The digits of a type's ids, lowest first: the choices of a part, or a number of values that are not looked at;
#: then the words that longer fakes have more of, or None if the last digit has no end.
PARTS: dict[str, tuple[list[list[str] | int], list[str] | None]] = {
    "PERSON": ([_FIRST, [f"{x}." for x in S.INITIALS], _SURNAME], _FIRST),
    "EMAIL": ([[f"{w}." for w in _FIRST], _SURNAME, [f"{n}@example.net" for n in range(10)]], None),
    "PHONE": ([["+91 9"]], None),
    "ORGANIZATION": ([_ORG_WORD, [f" {x} " for x in S.SECTORS], [f" {x}" for x in S.ORG_SUFFIXES]], _ORG_WORD),
    "ADDRESS": ([999, [f", {w} " for w in _SURNAME], [f" {x}, " for x in S.STREET_KINDS], [f", {x} - " for x in S.CITIES], 99999], None),
    "DATE": ([28, [f" {x} " for x in V.MONTHS.split("|")]], None),
    "SSN": ([], None),
    "CREDIT_CARD": ([[S.CARD_BIN]], None),
    "IP_ADDRESS": ([], None),
}


def part_strings(pii_type: str) -> set[str]:
    """All parts of a type's fakes, as they stand in normalised fakes."""
    digits, more = PARTS[pii_type]
    return {x.lower() for d in [*digits, more or []] if not isinstance(d, int) for x in d}


def passed_over(pii_type: str, inside: dict[str, set[str]]) -> set[str]:
    """The observed values that no fake of the type avoids.  ``inside``: the observed values in each part that has some."""
    out: set[str] = set()
    for d in PARTS[pii_type][0]:
        if not isinstance(d, int) and all(x.lower() in inside for x in d):
            out.update(*(inside[x.lower()] for x in d))
    return out


class Candidates:
    """The ids of a type whose fakes have clean parts, in order: the first one is candidate 0."""

    def __init__(self, pii_type: str, unclean: set[str]):
        digits, more = PARTS[pii_type]

        def clean(d: list[str] | int, low: int = 0) -> tuple[int, Sequence[int]]:
            if isinstance(d, int):
                return d, range(d)
            good = [i for i, x in enumerate(d) if i >= low and x.lower() not in unclean]
            return len(d), range(len(d)) if len(good) == len(d) else good

        own = [clean(d) for d in digits]
        # Runs of ids with the same digits: (first candidate, digits with radix and allowed values, lowest first).
        self._runs: list[tuple[int, list[tuple[int, Sequence[int]]]]] = []
        if more is None:
            self._add([*own, (len(ANY), ANY)])
        else:
            for words in range(S.MORE + 1):
                self._add([*own, *[clean(more)] * (words - 1), *[clean(more, 1)] * (words > 0)])
        self.count = self.below(MOST)

    def _add(self, digits: list[tuple[int, Sequence[int]]]) -> None:
        self._runs.append((self._after(), digits))

    def _after(self) -> int:
        if not self._runs:
            return 0
        n, (first, digits) = 1, self._runs[-1]
        for _, good in digits:
            n *= len(good)
        return first + n

    def below(self, i: int) -> int:
        """How many candidates have ids below ``i``."""
        total = 0
        for _, digits in self._runs:
            places, n = [(1, 1)], 1
            for radix, good in digits:
                places.append((places[-1][0] * radix, places[-1][1] * len(good)))
            rest, n = i, 0
            if rest >= places[-1][0]:
                n = places[-1][1]
            else:
                for (radix, good), (place, each) in zip(reversed(digits), reversed(places[:-1]), strict=True):
                    d, rest = divmod(rest, place)
                    at = bisect_left(good, d)
                    n += at * each
                    if at == len(good) or good[at] != d:
                        break
            total += n
        return total

    def id_of(self, c: int) -> int | None:
        """The id of candidate ``c``; None if there are fewer."""
        for lo, _, digits in self._within(c, min(c + 1, self.count)):
            i, place, c = 0, 1, c - lo
            for radix, good in digits:
                c, d = divmod(c, len(good))
                i, place = i + good[d] * place, place * radix
            return i
        return None

    def _within(self, lo: int, hi: int) -> Iterator[tuple[int, int, list[tuple[int, Sequence[int]]]]]:
        ends = [first for first, _ in self._runs[1:]] + [self._after()]
        for (first, digits), end in zip(self._runs, ends, strict=True):
            if max(lo, first) < min(hi, end):
                yield first, min(hi, end), digits

    def ids(self, lo: int, hi: int) -> list[tuple[int, int, Column]]:
        """The candidates from ``lo`` up to ``hi`` as ranges (from, up to, the id as an expression of the column ``id``)."""
        out = []
        for first, end, digits in self._within(lo, min(hi, self.count)):
            c, i, place = F.col("id") - F.lit(first), F.lit(0).cast("long"), 1
            for radix, good in digits:
                d = c if good is ANY else c % len(good)
                d = d if isinstance(good, range) else F.get(F.split(F.lit(",".join(map(str, good))), ",").cast("array<long>"), d.cast("int"))
                if place >= MOST:                       # beyond all ids
                    break
                i, c, place = i + d * F.lit(place), S._div(c, len(good)), place * radix
            out.append((max(lo, first), end, i))
        return out
