"""Pattern detectors: edge cases from FIXTURES.md and a differential check."""

import re

from conftest import run_col
from pseudoveil.operators import detectors as D


def test_email(spark):
    got = run_col(spark, D.email_spans, ["Write to a.b+c@mail.example.co.in.", "x@y.c1", "a@b"])
    assert got == [[("a.b+c@mail.example.co.in", 9, 33)], [], []]


def test_phone(spark):
    texts = ["+91 98765 43210", "00919876543210", "09876543210", "91 9876543210",
             "+91  9876543210", "919876543210", "5876543210", "5+91 98765 43210"]
    got = run_col(spark, D.phone_spans, texts)
    assert got[0] == [("+91 98765 43210", 0, 15)]
    assert got[1] == [("00919876543210", 0, 14)]
    assert got[2] == [("09876543210", 0, 11)]
    assert got[3] == [("9876543210", 3, 13)]
    assert got[4] == [("9876543210", 5, 15)]
    assert got[5] == [] and got[6] == []
    assert got[7] == [("98765 43210", 5, 16)]


def test_ssn(spark):
    got = run_col(spark, D.ssn_spans, ["123-45-6789", "0123-45-6789", "123-45-67890", "a 123-45-6789-1"])
    assert got == [[("123-45-6789", 0, 11)], [], [], [("123-45-6789", 2, 13)]]


def test_ip(spark):
    got = run_col(spark, D.ip_spans, ["see 10.0.0.1, ok", "1.2.3.4.", "999.1.1.1", "01.2.3.4", "255.255.255.255"])
    assert got == [[("10.0.0.1", 4, 12)], [], [], [], [("255.255.255.255", 0, 15)]]


def test_card(spark):
    texts = ["4111 1111 1111 1111 ok", "4111 1111 1111 1111 4111 1111 1111 1111",
             "4111-1111-1111-1112", "1111 2222 3333 4444 5555"]
    got = run_col(spark, D.card_spans, texts)
    assert got[0] == [("4111 1111 1111 1111 ", 0, 20)]
    assert got[1] == [("4111 1111 1111 1111", 0, 19), ("4111 1111 1111 1111", 20, 39)]
    assert got[2] == []


def test_dob(spark):
    texts = ["date of birth of 15/08/1990", "Born on 15 August 1990", "birth date: August 15 1990",
             "DOB 1-2-90", "dated 15/08/1990"]
    got = run_col(spark, D.dob_spans, texts)
    assert got[0] == [("15/08/1990", 17, 27)]
    assert got[1] == [("15 August 1990", 8, 22)]
    assert got[2] == [("August 15 1990", 12, 26)]
    assert got[3] == [("1-2-90", 4, 10)]
    assert got[4] == []


def test_address(spark):
    texts = ["12 MG Road, Pune 411001 Telephone: 9876543210", "profit of 12 lakh on 345678 shares",
             "Pune 411001", "12 MG Road. Pune 411001", "12 MG Road, Telephone: 22 411001"]
    got = run_col(spark, D.address_spans, texts)
    assert got[0] == [("12 MG Road, Pune 411001", 0, 45)]
    assert got[1] == [("12 lakh on 345678 shares", 10, 34)]
    assert got[2] == [] and got[3] == []
    assert got[4] == [("12 MG Road", 0, 32)]


def test_context_person(spark):
    texts = ["managing director: Varun Kamat", "Managing Director: Varun Kamat",
             "company secretary - Asha Rao Compliance Officer", "contact person:\nVarun Kamat and Asha Rao"]
    got = run_col(spark, D.context_person_spans, texts)
    assert got == [[("Varun Kamat", 19, 30)], [], [], [("Varun Kamat", 16, 27)]]


def test_context_person_ignore_case_flag(spark):
    got = run_col(spark, lambda t: D.context_person_spans(t, ignore_case=True), ["Managing Director: Varun Kamat"])
    assert got == [[("Varun Kamat", 19, 30)]]


def test_emoji_offsets(spark):
    got = run_col(spark, D.email_spans, ["😀 a@b.co and c@d.org!"])
    assert got == [[("a@b.co", 2, 8), ("c@d.org", 13, 20)]]


def test_private_use_marker_in_text(spark):
    got = run_col(spark, D.email_spans, [" x a@b.co "])
    assert got == [[("a@b.co", 4, 10)]]


# Python restatement of two patterns for a brute-force differential check.
PY_EMAIL = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
PY_SSN = re.compile(r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)")


def test_differential_against_python_re(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] for r in docs] + ["x 123-45-6789 y 987-65-4321", "é.a@b.com ab@c.de"]
    for fn, pat in [(D.email_spans, PY_EMAIL), (D.ssn_spans, PY_SSN)]:
        got = run_col(spark, fn, texts)
        want = [[(m.group(), m.start(), m.end()) for m in pat.finditer(t)] for t in texts]
        assert got == want


def number_list_addresses(text: str) -> list[tuple[int, int]]:
    """Spans of the structured address pattern.

    A match starts at a number and runs over the list it begins.  It ends at the
    first 6-digit number within 220 characters after the list, or else at the
    last one inside it, plus up to 80 characters.
    """
    import bisect
    import re
    pins = [m.span() for m in re.finditer(r"\b\d{6}\b", text)]
    pin_starts = [a for a, _ in pins]
    out, at, list_end = [], 0, -1
    numbers, gap_to, tail = re.compile(r"\b\d+"), re.compile(r"[^.\n;]{0,220}"), re.compile(r"[^.\n;]{0,80}")
    half = re.compile(r"\d++/\d")
    run = re.compile(r"\d++(?:/\d++)?+(?:\s*+,\s*+\d++(?:/\d++)?+)*+")
    while m := numbers.search(text, at):
        start = m.start()
        if start >= list_end or text[start - 1] == "/" and half.match(text, start):      # another list than the last one
            list_end = run.match(text, start).end()
        i = bisect.bisect_left(pin_starts, list_end)
        found = i < len(pins) and gap_to.fullmatch(text, list_end, pins[i][0]) and pins[i]
        k = i - 1
        while not found and k >= 0 and pins[k][0] > start:
            sep = pins[k][0]                          # the gap: a slash, or the separator from the item before
            if text[sep - 1] == "/":
                sep -= 1
            else:
                sep = text.rfind(",", start, sep)
                while text[sep - 1].isspace():
                    sep -= 1
            found = gap_to.fullmatch(text, sep, pins[k][0]) and pins[k]
            k -= 1
        if found:
            at = tail.match(text, found[1]).end()
            out.append((start, at))
        else:
            at = m.end()
    return out


def number_texts(n):
    import random
    rng = random.Random(1)
    words = ["1", "23", "400001", "411002 ", "400003/5", "12/400002", "4000011", "/", ",", ",", ", ", " , ", " \n", "\n", ".", "; ", " MG Road ", "a",
             "_", "é", "²", "\ue000", "x" * 100, "x" * 215, " " * 230]
    return ["", "no", "400001", "12, 400001", "1/2/3, 4", "12,\n400001 x", "²\n23, 12/400001"] + [
        "".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_number_list_scan_equals_the_pattern(spark):
    import re

    from pseudoveil.functions.number_lists import long_list_spans
    pattern = re.compile(r"\b\d+(?:/\d+)?(?:\s*,\s*\d+(?:/\d+)?)*[^.\n;]{0,220}?\b\d{6}\b(?:[^.\n;]{0,80})?")
    texts = number_texts(2000)
    assert all(number_list_addresses(t) == [m.span() for m in pattern.finditer(t)] for t in texts)
    got = run_col(spark, long_list_spans, texts)
    assert got == [[(t[a:b], a, b) for a, b in number_list_addresses(t)] for t in texts]


def test_long_number_lists_survive(spark):
    from pyspark.sql import functions as F

    from pseudoveil.operators import detectors as D
    line = ", ".join(str(400000 + i) for i in range(100_000))
    df = spark.createDataFrame([(line,), ("12, 5, MG Road, Pune 400001",)], "text string")
    for fn in (D.email_spans, D.phone_spans, D.ssn_spans, D.ip_spans, D.card_spans, D.dob_spans, D.address_spans,
               D.labelled_address_spans, D.context_person_spans):
        n = [r[0] for r in df.select(F.size(fn(F.col("text")))).collect()]
        assert n == ([1, 1] if fn is D.address_spans else [0, 0])


def test_word_boundaries_follow_python(spark):
    import re

    from pyspark.sql import functions as F

    from pseudoveil.functions import vocab as V
    from pseudoveil.functions.spans import spans
    texts = [f"{a}abc@b.co{b} {a}DOB{b}: 1/2/1990 {a}12, MG Road 400001{b}" for a in ("", "é", "मे", "x\u0301", "½", "²", "_", "-", "9")
             for b in ("", "é", "\u0947", "²", "_")]
    plain = {
        V.EMAIL_PATTERN: r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
        V.ADDRESS_STRUCTURED_PATTERN: r"(?i)\b\d+(?:/\d+)?(?:\s*,\s*\d+(?:/\d+)?)*[^.\n;]{0,220}?\b\d{6}\b(?:[^.\n;]{0,80})?",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for java, python in plain.items():
        got = [[(s["start"], s["end"]) for s in r[0]] for r in df.select(spans(F.col("t"), java)).collect()]
        assert got == [[m.span() for m in re.finditer(python, t)] for t in texts]


def test_cheap_gates_turn_no_match_away(spark):
    """With its gate every detector finds what its pattern finds in the whole text."""
    from pyspark.sql import functions as F

    from pseudoveil.functions import vocab as V
    from pseudoveil.functions.checks import ipv4_valid
    from pseudoveil.functions.spans import spans
    from pseudoveil.operators import detectors as D
    parts = ["", "a", "é", " ", "_", "9", "٣", "½", ".", "-", ", "]
    cores = ["+91 98765 43210", "9876543210", "٩876543210", "123-45-6789", "10.1.2.3", "DOB: 1/2/1990", "Born On 01-02-90", "born on 1 may 1990",
             "12, MG Road 400001", "Plot ١٢٣٤٥٦", "house 1234567", "managing director: Asha Rao", "ſecretary - Asha Rao", "company secretary- Asha Rao"]
    df = spark.createDataFrame([(f"{a}{c}{b}",) for c in cores for a in parts for b in parts] + [(None,), ("",)], "t string")
    t = F.col("t")
    at = lambda found: F.transform(found, lambda s: F.struct(s["start"], s["end"]))
    address = F.filter(F.transform(spans(t, V.ADDRESS_STRUCTURED_PATTERN), lambda s: F.struct(
        D.clean_address(s["value"]).alias("value"), s["start"], s["end"])), lambda s: (s["value"] != "") & D.looks_like_address(s["value"]))
    pairs = [(D.phone_spans(t), spans(t, V.PHONE_PATTERN)), (D.ssn_spans(t), spans(t, V.SSN_PATTERN)),
             (D.ip_spans(t), F.filter(spans(t, V.IP_PATTERN), lambda s: ipv4_valid(s["value"]))),
             (D.dob_spans(t), spans(t, V.DOB_PATTERN, group=2)), (D.address_spans(t), address),
             (D.context_person_spans(t), F.filter(spans(t, D.person_label_pattern(), group=2), lambda s: D.looks_like_name(s["value"])))]
    for gated, plain in pairs:
        rows = df.select(at(gated).alias("a"), at(plain).alias("b")).collect()
        assert any(r.b for r in rows) and all(r.a == r.b for r in rows)


def test_marked_texts_and_full_folds(spark):
    """Texts that hold the marker, with and without matches; word lists and marks in folded words."""
    from pyspark.sql import functions as F
    from pseudoveil.functions.spans import MARK
    from pseudoveil.operators import ner as N
    got = run_col(spark, N.capitalised_run_candidates, [f"{MARK}Asha Rao{MARK} x Ravi Iyer", f"{MARK} none {MARK}", None, "", "no"])
    assert got == [[("Asha Rao", 1, 9), ("Ravi Iyer", 13, 22)], [], [], [], []]
    v = ["Asha Rao", "Ünal Bank", "Bank. Rao", "Weiß Limited", "Rao LIMITED\n", "Straße Rao", "The Offer Limited", "Rao Limited of", "Metal Exchange"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v string").orderBy("i")
    rows = df.select(N.looks_like_person_name(F.col("v")).alias("p"), N.looks_like_organization(F.col("v")).alias("o"),
                     N.name_shape_score(F.col("v")).alias("s"), N.person_norm(F.col("v")).alias("n")).collect()
    assert [r.p for r in rows] == [True, False, False, False, False, True, False, False, False]
    assert [r.o for r in rows] == [False, False, False, True, True, False, False, False, True]
    assert rows[1].s.reasons == ["non-person words: bank"] and rows[0].s.score == 5
    assert rows[3].n == "weiss limited" and rows[5].n == "strasse rao"
