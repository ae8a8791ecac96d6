"""Value checks and normal forms as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import casefold, py_strip, sql_array


def luhn_valid(value: Column) -> Column:
    """Luhn mod-10 on the digits of ``value``; 13-19 digits required.

    Non-digits are dropped first.  Only ASCII digits carry a value here: a
    number written with other decimal digits is reported invalid.
    """
    digits = F.regexp_replace(value, r"(?U)\D", "")
    ascii_only = digits.rlike("^[0-9]*$")
    rev = F.split(F.reverse(digits), "")
    weighted = F.transform(
        rev,
        lambda d, i: F.when(
            i % 2 == 1,
            F.when(d.try_cast("int") * 2 > 9, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2),
        ).otherwise(d.try_cast("int")),
    )
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    n = F.length(digits)
    return (
        ascii_only
        & (n >= V.CARD_MIN_DIGITS)
        & (n <= V.CARD_MAX_DIGITS)
        & (total % 10 == 0)
    )


def ipv4_valid(value: Column) -> Column:
    """Strict dotted-quad IPv4: ASCII octets 0-255 without leading zeros."""
    return value.rlike(V.IPV4_STRICT)


def mobile_number(value: Column) -> Column:
    """Ten-digit Indian mobile number behind a matched PHONE value, else null."""
    digits = F.regexp_replace(value, r"(?U)\D", "")
    n = F.length(digits)
    mobile = (
        F.when(digits.startswith("91") & (n == 12), F.substring(digits, 3, 10))
        .when(digits.startswith("0091") & (n == 14), F.substring(digits, 5, 10))
        .when(digits.startswith("0") & (n == 11), F.substring(digits, 2, 10))
        .otherwise(digits)
    )
    return F.when((F.length(mobile) == 10) & F.substring(mobile, 1, 1).isin("6", "7", "8", "9"), mobile)


def clean_address(value: Column) -> Column:
    """Strip, cut at the first telephone/mobile word, strip, drop trailing `` ,:-``."""
    v = py_strip(value)
    v = F.regexp_replace(v, V.ADDRESS_STOP_PATTERN, "")
    v = py_strip(v)
    return F.regexp_replace(v, r"[ ,:\-]+$", "")


def looks_like_address(value: Column) -> Column:
    """An address word (letters-only tokens) or a standalone 6-digit number."""
    tokens = F.regexp_extract_all(casefold(value), F.lit("([a-zA-Z]+)"), 1)
    return F.arrays_overlap(tokens, sql_array(V.ADDRESS_WORDS)) | value.rlike(rf"(?U){V.WB}\d{{6}}{V.WB}")
