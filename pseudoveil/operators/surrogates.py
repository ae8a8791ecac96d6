"""Deterministic surrogate values (F5).

A surrogate is a pure function of ``(pii_type, id)``; each format is injective
in ``id`` for every id (beyond the usual shape of a type the value simply gets
longer), and formats of different types never coincide, so distinct ids give
distinct fakes across all types.  Names are built from short syllable lists by
a mixed-radix rule (no large literal tables).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.spans import bound

# Our own syllables; first and last names are two-syllable products (20 x 20).
NAME_HEADS = ["Ra", "Vi", "Ka", "Ma", "Sa", "Ni", "De", "Pa", "Ja", "Ha",
              "La", "Ta", "Mi", "Na", "Shi", "Ve", "Ar", "An", "Su", "Pra"]
NAME_TAILS = ["hul", "jay", "ran", "dhav", "nit", "esh", "ika", "ita", "ush", "ant",
              "van", "mesh", "deep", "pal", "raj", "ini", "tin", "vika", "lok", "sha"]
SURNAME_HEADS = ["Kul", "Bha", "Cha", "Dal", "Gho", "Jo", "Kam", "Lim", "Mo", "Nar",
                 "Pan", "Ram", "Sen", "Tri", "Upa", "Var", "Wad", "Yad", "Ze", "Aga"]
SURNAME_TAILS = ["karni", "tt", "ndra", "vi", "sh", "shi", "ath", "aye", "hite", "ang",
                 "dey", "an", "gupta", "vedi", "dhyay", "ma", "kar", "av", "lani", "rwal"]
INITIALS = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
SECTORS = ["Textiles", "Logistics", "Pharma", "Foods", "Infra", "Energy", "Polymers",
           "Systems", "Traders", "Exports", "Finance", "Motors", "Chemicals", "Metals",
           "Agro", "Realty", "Labs", "Media", "Steels", "Solutions", "Cables", "Papers",
           "Glass", "Tools", "Ventures"]
ORG_SUFFIXES = ["Limited", "Private Limited", "LLP", "Industries Limited", "Holdings Limited"]
STREET_KINDS = ["Road", "Marg", "Nagar", "Lane", "Street"]
CITIES = ["Pune", "Nashik", "Nagpur", "Thane", "Kolhapur", "Solapur", "Satara", "Sangli",
          "Aurangabad", "Amravati", "Jalgaon", "Akola", "Latur", "Dhule", "Ahmednagar",
          "Chandrapur", "Parbhani", "Jalna", "Bhiwandi", "Panvel"]

N_NAME = len(NAME_HEADS) * len(NAME_TAILS)          # 400
N_SURNAME = len(SURNAME_HEADS) * len(SURNAME_TAILS)  # 400

PHONE_MULT = 387420489        # 3**18, coprime with 10**9
CARD_MULT = 387420489
CARD_BIN = "400000"
FIRST_YEAR = 1930
PERSONS = N_NAME * len(INITIALS) * N_SURNAME          # names with one initial
ORG_WORDS = len(SURNAME_HEADS) * len(NAME_HEADS) * len(NAME_TAILS)
ORGANIZATIONS = ORG_WORDS * len(SECTORS) * len(ORG_SUFFIXES)
ADDRESSES = 999 * N_SURNAME * len(STREET_KINDS) * len(CITIES) * 99999
MORE = 4                                              # further digits of the mixed radix, beyond 64 bits together


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _first_name(i: Column) -> Column:
    return F.concat(_pick(NAME_HEADS, i % 20), _pick(NAME_TAILS, _div(i, 20) % 20))


def _surname(i: Column) -> Column:
    return F.concat(_pick(SURNAME_HEADS, i % 20), _pick(SURNAME_TAILS, _div(i, 20) % 20))


def _div(a: Column, b: int) -> Column:
    """Integer division of a non-negative long (exact below 2**53)."""
    return F.floor(a / F.lit(b)).cast("long")


def _more(i: Column, radix: int, word) -> list[Column]:
    """A word for each digit of ``i`` in ``radix`` without leading zeros; null beyond."""
    out = []
    for _ in range(MORE):
        out.append(F.when(i > 0, word(i % radix)))
        i = _div(i, radix)
    return out


def _pad(x: Column, width: int) -> Column:
    """Left-padded with zeros, never cut."""
    s = x.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def person(i: Column) -> Column:
    return F.concat_ws(" ", _first_name(i % N_NAME),
                       F.concat(_pick(INITIALS, _div(i, N_NAME) % 26), F.lit(".")),
                       *_more(_div(i, PERSONS), N_NAME, _first_name),
                       _surname(_div(i, N_NAME * 26) % N_SURNAME))


def email(i: Column) -> Column:
    local = F.concat(F.lower(_first_name(i % N_NAME)), F.lit("."),
                     F.lower(_surname(_div(i, N_NAME) % N_SURNAME)),
                     _div(i, N_NAME * N_SURNAME).cast("string"))
    return F.concat(local, F.lit("@example.net"))


def phone(i: Column) -> Column:
    body = F.pmod(i % 10 ** 9 * F.lit(PHONE_MULT).cast("long") + F.lit(12345), F.lit(10 ** 9).cast("long"))
    over = _div(i, 10 ** 9)
    return F.concat(F.lit("+91 9"), F.when(over > 0, over.cast("string")).otherwise(""), F.lpad(body.cast("string"), 9, "0"))


def _org_word(i: Column) -> Column:
    return F.concat(_pick(SURNAME_HEADS, i % 20), F.lower(_pick(NAME_HEADS, _div(i, 20) % 20)), _pick(NAME_TAILS, _div(i, 400) % 20))


def organization(i: Column) -> Column:
    rest = _div(i, ORG_WORDS)
    return F.concat_ws(" ", _org_word(i), *_more(_div(i, ORGANIZATIONS), ORG_WORDS, _org_word), _pick(SECTORS, rest % len(SECTORS)),
                       _pick(ORG_SUFFIXES, _div(rest, len(SECTORS)) % len(ORG_SUFFIXES)))


def address(i: Column) -> Column:
    house = (i % 999 + 1 + _div(i, ADDRESSES) * 999).cast("string")
    r = _div(i, 999)
    street = _surname(r % N_SURNAME)
    r = _div(r, N_SURNAME)
    kind = _pick(STREET_KINDS, r % len(STREET_KINDS))
    r = _div(r, len(STREET_KINDS))
    city = _pick(CITIES, r % len(CITIES))
    pin = (F.lit(400001) + _div(r, len(CITIES)) % 99999).cast("string")
    return F.concat(house, F.lit(", "), street, F.lit(" "), kind, F.lit(", "), city, F.lit(" - "), pin)


def date(i: Column) -> Column:
    """Days 1 to 28 of every month from ``FIRST_YEAR`` on."""
    year = F.lit(FIRST_YEAR) + _div(i, 28 * 12)
    return F.concat_ws(" ", F.lpad((i % 28 + 1).cast("string"), 2, "0"), _pick(V.MONTHS.split("|"), _div(i, 28) % 12), year.cast("string"))


def ssn(i: Column) -> Column:
    return F.concat(
        (F.lit(900) + i % 100).cast("string"), F.lit("-"),
        F.lpad((F.lit(1) + _div(i, 100) % 99).cast("string"), 2, "0"), F.lit("-"),
        _pad(F.lit(1) + _div(i, 9900), 4),
    )


def card(i: Column) -> Column:
    over = _div(i, 10 ** 9)
    body = F.concat(F.lit(CARD_BIN), F.when(over > 0, over.cast("string")).otherwise(""), F.lpad(
        F.pmod(i % 10 ** 9 * F.lit(CARD_MULT).cast("long") + F.lit(777), F.lit(10 ** 9).cast("long")).cast("string"), 9, "0"))
    # Luhn check digit over the 15-digit body (rightmost body digit is doubled).
    rev = F.split(F.reverse(body), "")
    total = F.aggregate(
        F.transform(rev, lambda d, k: F.when(k % 2 == 0,
                                             F.when(d.try_cast("int") * 2 > 9, d.try_cast("int") * 2 - 9)
                                             .otherwise(d.try_cast("int") * 2)).otherwise(d.try_cast("int"))),
        F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((F.lit(10) - total % 10) % 10).cast("string"))


def ip_address(i: Column) -> Column:
    """Reserved 240.0.0.0/4, which no real host has; then IPv6 documentation addresses."""
    v4 = F.concat_ws(".", (F.lit(240) + _div(i, 1 << 24) % 16).cast("string"), (_div(i, 65536) % 256).cast("string"),
                     (_div(i, 256) % 256).cast("string"), (i % 256).cast("string"))
    groups = [F.lower(F.hex(_div(i, 1 << k) % 65536)) for k in (48, 32, 16)] + [F.lower(F.hex(i % 65536))]
    return F.when(i < 1 << 28, v4).otherwise(F.concat_ws(":", F.lit("2001:db8:0:0"), *groups))


_FORMATS = {
    "PERSON": person, "EMAIL": email, "PHONE": phone, "ORGANIZATION": organization,
    "ADDRESS": address, "DATE": date, "SSN": ssn, "CREDIT_CARD": card, "IP_ADDRESS": ip_address,
}


def surrogate_of(pii_type: str, i: Column) -> Column:
    """The fakes of one type."""
    return _FORMATS[pii_type](i.cast("long"))


def surrogate(pii_type: Column, i: Column) -> Column:
    """The fake for ``(pii_type, id)``, id from 0 on without an upper bound."""
    i = i.cast("long")
    out = F.lit(V.REDACTED)
    for t, fn in _FORMATS.items():
        out = F.when(pii_type == t, fn(i)).otherwise(out)
    return out


# --------------------------------------------------------------------------
# The inverse: which id a fake stands for
# --------------------------------------------------------------------------

PHONE_INVERSE = pow(PHONE_MULT, -1, 10 ** 9)
CARD_INVERSE = pow(CARD_MULT, -1, 10 ** 9)


def _one_of(values: list[str]) -> str:
    return "(?:" + "|".join(values) + ")"


def _index(values: list[str], word: Column) -> Column:
    """Position of ``word`` in the list from 0; null if it is none of it."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), word)
    return F.when(at > 0, at - 1)


def _number(digits: Column) -> Column:
    return digits.try_cast("long")


def _two(word: Column, heads: list[str], tails: list[str]) -> Column:
    """Number of a two-syllable word: no head is the beginning of another one, so a word has one reading."""
    head = F.regexp_extract(word, "^" + _one_of(heads), 0)
    return _index(heads, head) + len(heads) * _index(tails, F.substr(word, F.length(head) + 1))


def _first_name_id(word: Column) -> Column:
    return _two(word, NAME_HEADS, NAME_TAILS)


def _surname_id(word: Column) -> Column:
    return _two(word, SURNAME_HEADS, SURNAME_TAILS)


def _org_word_id(word: Column) -> Column:
    head = F.regexp_extract(word, "^" + _one_of(SURNAME_HEADS), 0)
    rest = F.substr(word, F.length(head) + 1)
    return _index(SURNAME_HEADS, head) + 20 * _two(rest, [h.lower() for h in NAME_HEADS], NAME_TAILS)


def _digits_of(words: Column, number, radix: int) -> Column:
    """Value of the further words, lowest digit first; no words are 0."""
    values = F.transform(words, number)
    return F.aggregate(F.reverse(values), F.lit(0).cast("long"), lambda acc, v: acc * radix + v)


def _more_words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _person_id(v: Column) -> Column:
    parts = r"^(\S+) ([A-Z])\.((?: \S+)*) (\S+)$"
    get = lambda k: F.regexp_extract(v, parts, k)
    more = _digits_of(_more_words(get(3)), _first_name_id, N_NAME)
    return _first_name_id(get(1)) + N_NAME * (_index(INITIALS, get(2)) + 26 * _surname_id(get(4))) + PERSONS * more


def _email_id(v: Column) -> Column:
    parts = r"^([a-z]+)\.([a-z]+)([0-9]+)@example\.net$"
    get = lambda k: F.regexp_extract(v, parts, k)
    return _first_name_id(F.initcap(get(1))) + N_NAME * (_surname_id(F.initcap(get(2))) + N_SURNAME * _number(get(3)))


def _scrambled_id(over: Column, body: Column, add: int, inverse: int) -> Column:
    low = F.pmod((F.pmod(_number(body) - add, F.lit(10 ** 9))) * F.lit(inverse).cast("long"), F.lit(10 ** 9).cast("long"))
    return F.when(over == "", F.lit(0).cast("long")).otherwise(_number(over)) * 10 ** 9 + low


def _phone_id(v: Column) -> Column:
    parts = r"^\+91 9([0-9]*)([0-9]{9})$"
    return _scrambled_id(F.regexp_extract(v, parts, 1), F.regexp_extract(v, parts, 2), 12345, PHONE_INVERSE)


def _card_id(v: Column) -> Column:
    parts = rf"^{CARD_BIN}([0-9]*)([0-9]{{9}})[0-9]$"
    return _scrambled_id(F.regexp_extract(v, parts, 1), F.regexp_extract(v, parts, 2), 777, CARD_INVERSE)


def _organization_id(v: Column) -> Column:
    parts = rf"^(\S+)((?: \S+)*) ({_one_of(SECTORS)}) ({_one_of(sorted(ORG_SUFFIXES, key=len, reverse=True))})$"
    get = lambda k: F.regexp_extract(v, parts, k)
    more = _digits_of(_more_words(get(2)), _org_word_id, ORG_WORDS)
    return (_org_word_id(get(1)) + ORG_WORDS * (_index(SECTORS, get(3)) + len(SECTORS) * _index(ORG_SUFFIXES, get(4)))
            + ORGANIZATIONS * more)


def _address_id(v: Column) -> Column:
    parts = r"^([0-9]+), (\S+) (\S+), (\S+) - ([0-9]{6})$"
    get = lambda k: F.regexp_extract(v, parts, k)
    house, pin = _number(get(1)) - 1, _number(get(5)) - 400001
    rest = _surname_id(get(2)) + N_SURNAME * (_index(STREET_KINDS, get(3)) + len(STREET_KINDS) * (_index(CITIES, get(4)) + len(CITIES) * pin))
    return house % 999 + 999 * rest + ADDRESSES * _div(house, 999)


def _date_id(v: Column) -> Column:
    parts = r"^([0-9]{2}) ([A-Za-z]+) ([0-9]+)$"
    get = lambda k: F.regexp_extract(v, parts, k)
    return _number(get(1)) - 1 + 28 * (_index(V.MONTHS.split("|"), get(2)) + 12 * (_number(get(3)) - FIRST_YEAR))


def _ssn_id(v: Column) -> Column:
    parts = r"^9([0-9]{2})-([0-9]{2})-([0-9]{4,})$"
    get = lambda k: F.regexp_extract(v, parts, k)
    return _number(get(1)) + 100 * (_number(get(2)) - 1) + 9900 * (_number(get(3)) - 1)


def _ip_id(v: Column) -> Column:
    v4 = F.split(v, r"\.")
    four = ((_number(F.get(v4, F.lit(0))) - 240) * 256 + _number(F.get(v4, F.lit(1)))) * 65536 \
        + _number(F.get(v4, F.lit(2))) * 256 + _number(F.get(v4, F.lit(3)))
    groups = F.split(F.regexp_extract(v, r"^2001:db8:0:0:([0-9a-f]{1,4}(?::[0-9a-f]{1,4}){3})$", 1), ":")
    six = F.aggregate(groups, F.lit(0).cast("long"), lambda acc, g: acc * 65536 + F.conv(g, 16, 10).cast("long"))
    return F.when(F.size(v4) == 4, four).when(F.size(groups) == 4, six)


_INVERSES = {
    "PERSON": _person_id, "EMAIL": _email_id, "PHONE": _phone_id, "ORGANIZATION": _organization_id,
    "ADDRESS": _address_id, "DATE": _date_id, "SSN": _ssn_id, "CREDIT_CARD": _card_id, "IP_ADDRESS": _ip_id,
}
LONGEST = 160              # characters of a fake of a 64-bit id; a longer value is none


def surrogate_id(pii_type: Column, replacement: Column) -> Column:
    """The id whose fake ``replacement`` is, or null for a value that :func:`surrogate` never makes."""
    read = F.lit(None).cast("long")
    for t, fn in _INVERSES.items():
        read = F.when(pii_type == t, fn(F.when(F.length(replacement) <= LONGEST, replacement))).otherwise(read)
    back = bound(read, lambda i: F.when((i >= 0) & (surrogate(pii_type, i) == replacement), i))
    return back.cast("long")
