"""DuckDB formulations of the registered queries (the correctness oracle).

DuckDB's regex engine (RE2) has no lookarounds, so digit lookarounds are
turned into literals: maximal digit runs are wrapped in U+E001/U+E002 first
(``«»`` below), matches are found on the marked text and the markers are
dropped from each segment before offsets are counted.  Python/Java Unicode
whitespace is spelled out because RE2's ``\\s`` is ASCII only.
"""

from __future__ import annotations

from ..functions import vocab as V
from .fixtures import FIRST_NAMES, LAST_NAMES, PII_DOC_BASE

M = r"\x{E000}"     # match marker
A = r"\x{E001}"     # digit-run start
B = r"\x{E002}"     # digit-run end
PYWS = (r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
        r"\x{202f}\x{205f}\x{3000}")
WS = f"[{PYWS}]"
D = r"\p{Nd}"
KEY = "doc_id, unit_kind, unit_no"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


# --------------------------------------------------------------------------
# corpus
# --------------------------------------------------------------------------

DOC_UNITS = f"""
doc_units AS (
  SELECT doc_id::BIGINT AS doc_id, 'paragraph' AS unit_kind, unit_no::INTEGER AS unit_no, text
  FROM (SELECT doc_id, unnest(parts) AS text, unnest(generate_series(0, len(parts) - 1)) AS unit_no
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
)"""

PII_UNITS = f"""
pii_units AS (
  SELECT ({PII_DOC_BASE} + k)::BIGINT AS doc_id, 'paragraph' AS unit_kind, 0::INTEGER AS unit_no,
    CASE k % 8
      WHEN 0 THEN 'Call +91 ' || substr(p, 1, 5) || ' ' || substr(p, 6, 5) || ' or 0' || p || ' today'
      WHEN 1 THEN 'SSN ' || (k % 900 + 100) || '-' || (k % 90 + 10) || '-' || (k % 9000 + 1000) || ' on file'
      WHEN 2 THEN 'DOB: ' || (k % 28 + 1) || '/' || (k % 12 + 1) || '/' || (k % 50 + 1950) || ' dated 01/02/2020'
      WHEN 3 THEN 'Registered Office: ' || (k % 200 + 1) || ', MG Road, ' || n_name || ' ' || (k % 99999 + 400000)
                  || ' Telephone: ' || p
      WHEN 4 THEN 'managing director: ' || CASE WHEN (k // 8) % 2 = 1 THEN substr(fn, 1, 1) || '.' ELSE fn END || ' ' || ln || ' signed'
      WHEN 5 THEN CASE WHEN (k // 8) % 2 = 1 THEN CASE WHEN (k // 16) % 2 = 1 THEN 'Hence ' ELSE 'Therefore ' END || ln || ' signed the offer'
                  ELSE 'Managing Director: ' || fn || ' ' || ln || ' signed' END
      WHEN 6 THEN 'Server 10.' || (k % 256) || '.' || ((k // 256) % 256) || '.7 mail user' || k
                  || '@example.org, copy user' || k || '@example.org'
      ELSE 'Card 4111 1111 1111 1111 paid; other 4111 1111 1111 1112 no; bill ' || k
           || ' to ' || ln || ' Industries Limited via Bank of ' || fn
    END AS text
  FROM (SELECT c_custkey AS k, n_name, (9000000000 + 7919 * c_custkey)::VARCHAR AS p,
               {str_list(FIRST_NAMES)}[((c_custkey // 64) % 8) + 1] AS fn,
               {str_list(LAST_NAMES)}[((c_custkey // 8) % 8) + 1] AS ln
        FROM customer JOIN nation ON c_nationkey = n_nationkey)
)"""

CORPUS = f"""{DOC_UNITS},{PII_UNITS},
corpus AS (SELECT * FROM doc_units UNION ALL SELECT * FROM pii_units)"""


def with_corpus(*ctes: str) -> str:
    return "WITH " + ",\n".join([CORPUS.strip()] + [c.strip() for c in ctes])


# --------------------------------------------------------------------------
# positional spans
# --------------------------------------------------------------------------

def mark_digits(text: str) -> str:
    return f"regexp_replace({text}, '({D}+)', chr(57345) || '\\1' || chr(57346), 'g')"


def spans_cte(name: str, src: str, pattern: str, group: bool = False, digits: bool = False,
              text_col: str = "text") -> str:
    """CTE ``name(doc_id, unit_kind, unit_no, value, start_pos, end_pos)``.

    ``group``: pattern is ``(prefix)(value)``; ``digits``: match on digit-run
    marked text.  Offsets are code points in the original text.
    """
    base = mark_digits(text_col) if digits else text_col
    repl = "'\\1' || chr(57344) || '\\2' || chr(57344)" if group else "chr(57344) || '\\0' || chr(57344)"
    return f"""
{name}_seg AS (
  SELECT {KEY}, unnest(parts) AS seg, unnest(generate_series(1, len(parts))) AS i
  FROM (SELECT {KEY}, string_split(regexp_replace({base}, {q(pattern)}, {repl}, 'g'), chr(57344)) AS parts
        FROM {src} WHERE {text_col} IS NOT NULL)
),
{name}_pos AS (
  SELECT {KEY}, i, replace(replace(seg, chr(57345), ''), chr(57346), '') AS seg,
         coalesce(sum(length(replace(replace(seg, chr(57345), ''), chr(57346), ''))) OVER (
           PARTITION BY {KEY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos
  FROM {name}_seg
),
{name} AS (
  SELECT {KEY}, seg AS value, start_pos::INTEGER AS start_pos, (start_pos + length(seg))::INTEGER AS end_pos
  FROM {name}_pos WHERE i % 2 = 0
)"""


# --------------------------------------------------------------------------
# detector patterns in RE2 form
# --------------------------------------------------------------------------

EMAIL_RE = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
SSN_RE = f"{A}{D}{{3}}{B}-{A}{D}{{2}}{B}-{A}{D}{{4}}{B}"
CARD_RE = f"{A}(?:{D}{B}?[ -]?{A}?){{12,18}}{D}{B}"
PHONE_SEP = f"(?:{B}[{PYWS}-]{A})?"
PHONE_RE = (f"(^|[^{B}])((?:\\+{A}91{PHONE_SEP}|{A}0091{PHONE_SEP}|{A}0?)"
            f"[6-9]{D}{{4}}{PHONE_SEP}{D}{{5}}{B})")
IP_RUN_RE = f"[{D}.]+"
IP_SHAPE_RE = f"{D}{{1,3}}\\.{D}{{1,3}}\\.{D}{{1,3}}\\.{D}{{1,3}}"
DOB_RE = (
    f"(?i)((?:date{WS}+of{WS}+birth|\\bDOB\\b|birth{WS}+date|born{WS}+on|date{WS}+of{WS}+birth{WS}+of)"
    f"{WS}*[:\\-]?{WS}*)"
    f"({D}{{1,2}}[/-]{D}{{1,2}}[/-]{D}{{2,4}}|{D}{{1,2}}{WS}+(?:{V.MONTHS}){WS}+{D}{{4}}"
    f"|(?:{V.MONTHS}){WS}+{D}{{1,2}},?{WS}+{D}{{4}})"
)
ADDRESS_RE = (
    f"(?i)\\b{D}+(?:/{D}+)?(?:{WS}*,{WS}*{D}+(?:/{D}+)?)*"
    f"[^.\\n;]{{0,220}}?\\b{D}{{6}}\\b(?:[^.\\n;]{{0,80}})?"
)
LABELS_RE = "|".join(lbl.replace(r"\s", WS) for lbl in V.PERSON_LABELS)
CONTEXT_RE = (f"((?:{LABELS_RE}){WS}*[:\\-]{WS}*(?:\\n{WS}*)?)"
              f"({V.PERSON_NAME_WORD}(?:{WS}+{V.PERSON_NAME_WORD}){{1,4}})")


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({py_strip(x)}, '{WS}+', ' ', 'g')"


_FOLDS = [("ß", "ss"), ("ẞ", "ss"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"),
          ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]


def casefold(x: str) -> str:
    out = f"lower({x})"
    for a, b in _FOLDS:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


def normalize_key(x: str) -> str:
    return casefold(f"regexp_replace({collapse_ws(x)}, '(?i)^the{WS}+', '')")


def summary_key(x: str) -> str:
    return casefold(collapse_ws(x))


def luhn_ok(value: str) -> str:
    d = f"regexp_replace({value}, '\\P{{Nd}}', '', 'g')"
    r = f"reverse({d})"
    total = (f"list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 1 THEN "
             f"(CASE WHEN substr({r}, i + 1, 1)::INTEGER * 2 > 9 THEN substr({r}, i + 1, 1)::INTEGER * 2 - 9 "
             f"ELSE substr({r}, i + 1, 1)::INTEGER * 2 END) ELSE substr({r}, i + 1, 1)::INTEGER END))")
    return (f"(regexp_full_match({d}, '[0-9]*') AND length({d}) BETWEEN {V.CARD_MIN_DIGITS} AND "
            f"{V.CARD_MAX_DIGITS} AND {total} % 10 = 0)")


def clean_address(x: str) -> str:
    v = py_strip(x)
    v = f"regexp_replace({v}, '(?is)\\b(?:telephone|tel|phone|mobile|mob)\\b.*', '')"
    v = py_strip(v)
    return f"regexp_replace({v}, '[ ,:\\-]+$', '')"


def looks_like_address(x: str) -> str:
    return (f"(list_has_any(regexp_extract_all({casefold(x)}, '([a-zA-Z]+)', 1), {str_list(V.ADDRESS_WORDS)})"
            f" OR regexp_matches({x}, '\\b{D}{{6}}\\b'))")


def looks_like_name(x: str) -> str:
    v = collapse_ws(x)
    w = f"string_split({v}, ' ')"
    return (f"(len({w}) BETWEEN 2 AND 5 AND length({v}) <= {V.CONTEXT_MAX_CHARS} "
            f"AND NOT regexp_matches({v}, '{D}') AND strpos({v}, '@') = 0 "
            f"AND NOT list_has_any(list_transform({w}, lambda t: lower(t)), {str_list(V.CONTEXT_BLOCKED_WORDS)}))")


# --------------------------------------------------------------------------
# per-detector finding CTEs over a unit source
# --------------------------------------------------------------------------

def detector_ctes(src: str = "corpus", prefix: str = "d") -> tuple[list[str], str]:
    """CTEs producing ``{prefix}_all(doc_id, unit_kind, unit_no, pii_type, value, start_pos, end_pos,
    confidence, source, score, seq)`` for all pattern, NER and context detectors."""
    p = prefix
    ctes = [
        spans_cte(f"{p}_email", src, EMAIL_RE),
        spans_cte(f"{p}_phone", src, PHONE_RE, group=True, digits=True),
        spans_cte(f"{p}_ssn", src, SSN_RE, digits=True),
        spans_cte(f"{p}_iprun", src, IP_RUN_RE),
        spans_cte(f"{p}_card0", src, CARD_RE, digits=True),
        spans_cte(f"{p}_dob", src, DOB_RE, group=True),
        spans_cte(f"{p}_addr0", src, ADDRESS_RE),
        spans_cte(f"{p}_ctx0", src, CONTEXT_RE, group=True),
        f"""{p}_ip AS (SELECT * FROM {p}_iprun WHERE regexp_full_match(value, '{IP_SHAPE_RE}')
               AND regexp_full_match(value, {q(V.IPV4_STRICT[1:-1])}))""",
        f"""{p}_card1 AS (
  SELECT c.{KEY.replace(', ', ', c.')}, c.start_pos,
         CASE WHEN substr(u.text, c.end_pos + 1, 1) IN (' ', '-')
               AND NOT regexp_matches(substr(u.text, c.end_pos + 2, 1), '{D}')
              THEN c.end_pos + 1 ELSE c.end_pos END AS end_pos, u.text
  FROM {p}_card0 c JOIN {src} u USING ({KEY}))""",
        f"""{p}_card AS (SELECT {KEY}, substr(text, start_pos + 1, end_pos - start_pos) AS value,
               start_pos::INTEGER AS start_pos, end_pos::INTEGER AS end_pos FROM {p}_card1
               WHERE {luhn_ok('substr(text, start_pos + 1, end_pos - start_pos)')})""",
        f"""{p}_addr AS (SELECT {KEY}, {clean_address('value')} AS value, start_pos, end_pos FROM {p}_addr0
               WHERE {clean_address('value')} <> '' AND {looks_like_address(clean_address('value'))})""",
        f"""{p}_ctx AS (SELECT * FROM {p}_ctx0 WHERE {looks_like_name('value')})""",
    ]
    parts = [
        ("email", "EMAIL", V.SEQ_EMAIL), ("phone", "PHONE", V.SEQ_PHONE), ("ssn", "SSN", V.SEQ_SSN),
        ("ip", "IP_ADDRESS", V.SEQ_IP), ("card", "CREDIT_CARD", V.SEQ_CARD), ("dob", "DATE", V.SEQ_DATE),
        ("addr", "ADDRESS", V.SEQ_ADDRESS),
    ]
    union = " UNION ALL ".join(
        f"SELECT {KEY}, '{t}' AS pii_type, value, start_pos, end_pos, 'HIGH' AS confidence, 'regex' AS source, "
        f"NULL::INTEGER AS score, {seq} AS seq FROM {p}_{n}" for n, t, seq in parts)
    union += (f" UNION ALL SELECT {KEY}, 'PERSON', value, start_pos, end_pos, 'HIGH', 'context', "
              f"{V.CONTEXT_PERSON_SCORE}, {V.SEQ_CONTEXT} FROM {p}_ctx")
    union += (f" UNION ALL SELECT {KEY}, CASE label WHEN 'PERSON' THEN 'PERSON' ELSE 'ORGANIZATION' END, value, start_pos, end_pos, "
              f"CASE WHEN label = 'PERSON' AND score >= {V.HIGH_SCORE} THEN 'HIGH' ELSE 'MEDIUM' END, 'ner', score, {V.SEQ_NER} "
              f"FROM {p}_ner WHERE accepted")
    ctes += ner_ctes(src, f"{p}_")
    ctes.append(f"{p}_all AS ({union})")
    return ctes, f"{p}_all"


def detect_query(kind: str) -> str:
    ctes, _ = detector_ctes()
    name = {"EMAIL": "d_email", "PHONE": "d_phone", "SSN": "d_ssn", "IP_ADDRESS": "d_ip",
            "CREDIT_CARD": "d_card", "DATE": "d_dob", "ADDRESS": "d_addr", "PERSON": "d_ctx"}[kind]
    return with_corpus(*ctes) + f"\nSELECT {KEY}, value, start_pos, end_pos FROM {name}"


# --------------------------------------------------------------------------
# pipeline: overlaps, mapping, surrogates, splice
# --------------------------------------------------------------------------

CONF_RANK_SQL = ("CASE confidence " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.CONFIDENCE_RANK.items())
                 + f" ELSE {V.UNKNOWN_CONFIDENCE_RANK} END")


def resolve_ctes(name: str, findings: str) -> list[str]:
    """Greedy overlap resolution per unit as a recursive walk in sort order."""
    return [
        f"""{name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {KEY}
           ORDER BY start_pos, {CONF_RANK_SQL}, start_pos - end_pos, seq) AS rn
  FROM {findings})""",
        f"""{name}_walk AS (
  SELECT {KEY}, rn, end_pos AS occupied, true AS kept FROM {name}_ranked WHERE rn = 1
  UNION ALL
  SELECT r.doc_id, r.unit_kind, r.unit_no, r.rn,
         CASE WHEN r.start_pos >= w.occupied THEN r.end_pos ELSE w.occupied END,
         r.start_pos >= w.occupied
  FROM {name}_walk w JOIN {name}_ranked r
    ON r.doc_id = w.doc_id AND r.unit_kind = w.unit_kind AND r.unit_no = w.unit_no AND r.rn = w.rn + 1)""",
        f"""{name} AS (
  SELECT r.* EXCLUDE (rn) FROM {name}_ranked r JOIN {name}_walk w USING ({KEY}, rn) WHERE w.kept)""",
    ]


def _pick(values, idx: str) -> str:
    return f"{str_list(values)}[({idx}) + 1]"


def surrogate_sql(t: str, i: str) -> str:
    from ..operators import surrogates as S
    first = lambda x: f"({_pick(S.NAME_HEADS, f'({x}) % 20')} || {_pick(S.NAME_TAILS, f'(({x}) // 20) % 20')})"
    sur = lambda x: f"({_pick(S.SURNAME_HEADS, f'({x}) % 20')} || {_pick(S.SURNAME_TAILS, f'(({x}) // 20) % 20')})"
    person = (f"{first(f'{i} % 400')} || ' ' || {_pick(S.INITIALS, f'({i} // 400) % 26')} || '. ' || "
              f"{sur(f'({i} // 10400) % 400')}")
    email = (f"lower({first(f'{i} % 400')}) || '.' || lower({sur(f'({i} // 400) % 400')}) || "
             f"({i} // 160000)::VARCHAR || '@example.net'")
    phone = f"'+91 9' || lpad((({i} * {S.PHONE_MULT} + 12345) % 1000000000)::VARCHAR, 9, '0')"
    word = (f"{_pick(S.SURNAME_HEADS, f'{i} % 20')} || lower({_pick(S.NAME_HEADS, f'({i} // 20) % 20')}) || "
            f"{_pick(S.NAME_TAILS, f'({i} // 400) % 20')}")
    org = (f"{word} || ' ' || {_pick(S.SECTORS, f'({i} // 8000) % {len(S.SECTORS)}')} || ' ' || "
           f"{_pick(S.ORG_SUFFIXES, f'(({i} // 8000) // {len(S.SECTORS)}) % {len(S.ORG_SUFFIXES)}')}")
    r1, r2 = f"({i} // 999)", f"(({i} // 999) // 400)"
    r3 = f"({r2} // {len(S.STREET_KINDS)})"
    address = (f"({i} % 999 + 1)::VARCHAR || ', ' || {sur(f'{r1} % 400')} || ' ' || "
               f"{_pick(S.STREET_KINDS, f'{r2} % {len(S.STREET_KINDS)}')} || ', ' || "
               f"{_pick(S.CITIES, f'{r3} % {len(S.CITIES)}')} || ' - ' || "
               f"(400001 + ({r3} // {len(S.CITIES)}) % 99999)::VARCHAR")
    date = (f"lpad(({i} % 28 + 1)::VARCHAR, 2, '0') || ' ' || {_pick(V.MONTHS.split('|'), f'({i} // 28) % 12')} || ' ' || "
            f"({S.FIRST_YEAR} + {i} // 336)::VARCHAR")
    ssn = (f"(900 + {i} % 100)::VARCHAR || '-' || lpad((1 + ({i} // 100) % 99)::VARCHAR, 2, '0') || '-' || "
           f"lpad((1 + ({i} // 9900) % 9999)::VARCHAR, 4, '0')")
    body = f"('{S.CARD_BIN}' || lpad((({i} * {S.CARD_MULT} + 777) % 1000000000)::VARCHAR, 9, '0'))"
    dig = lambda k: f"substr(reverse({body}), {k + 1}, 1)::INTEGER"
    terms = " + ".join(
        (f"(CASE WHEN {dig(k)} * 2 > 9 THEN {dig(k)} * 2 - 9 ELSE {dig(k)} * 2 END)" if k % 2 == 0 else dig(k))
        for k in range(15))
    card = f"{body} || ((10 - ({terms}) % 10) % 10)::VARCHAR"
    ip = f"(240 + ({i} // 16777216) % 16)::VARCHAR || '.' || (({i} // 65536) % 256)::VARCHAR || '.' || (({i} // 256) % 256)::VARCHAR || '.' || ({i} % 256)::VARCHAR"
    cases = {"PERSON": person, "EMAIL": email, "PHONE": phone, "ORGANIZATION": org, "ADDRESS": address,
             "DATE": date, "SSN": ssn, "CREDIT_CARD": card, "IP_ADDRESS": ip}
    return "CASE " + " ".join(f"WHEN {t} = '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE '{V.REDACTED}' END"


def bucket_sql(t: str, key: str, buckets: int = 1024) -> str:
    return f"((('0x' || substr(md5({t} || chr(1) || {key}), 1, 8))::BIGINT) % {buckets})::INTEGER"


CORPUS_DOCS = f"""
cdocs AS (SELECT doc_id::BIGINT AS doc_id, text FROM documents
          UNION ALL SELECT doc_id, text FROM pii_units),
cunits AS (
  SELECT doc_id::BIGINT AS doc_id, 'paragraph' AS unit_kind, unit_no::INTEGER AS unit_no, text,
         (coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY unit_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS unit_offset
  FROM (SELECT doc_id, unnest(parts) AS text, unnest(generate_series(0, len(parts) - 1)) AS unit_no
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM cdocs))
)"""


def pipeline_ctes(src: str = "cunits", base: list[str] | None = None) -> list[str]:
    """First-run redaction of ``src`` units.

    Produces ``kept`` (findings after overlaps), ``keys``, ``newmap`` and
    ``mapped`` (kept findings with replacement)."""
    det, all_name = detector_ctes(src, "p")
    ctes = ([CORPUS_DOCS] if base is None else base) + det
    ctes += resolve_ctes("kept", all_name)
    ctes += [
        f"""keys AS (
  SELECT pii_type, norm_key, arg_min(surface, ord) AS surface FROM (
    SELECT pii_type, {normalize_key('value')} AS norm_key, {collapse_ws('value')} AS surface,
           (doc_id, CASE unit_kind WHEN 'paragraph' THEN 0 WHEN 'cell' THEN 1 ELSE 2 END, unit_no, -start_pos) AS ord
    FROM kept) WHERE length(norm_key) > 0 GROUP BY pii_type, norm_key)""",
        f"""newmap AS (
  SELECT pii_type, norm_key, surface, id, {surrogate_sql('pii_type', 'id')} AS replacement
  FROM (SELECT *, (row_number() OVER (PARTITION BY pii_type ORDER BY {bucket_sql('pii_type', 'norm_key')}, norm_key) - 1)::BIGINT AS id
        FROM keys))""",
        f"""mapped AS (
  SELECT k.*, m.replacement FROM (SELECT *, {normalize_key('value')} AS norm_key FROM kept) k
  LEFT JOIN newmap m USING (pii_type, norm_key))""",
    ]
    return ctes


def with_corpus_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([CORPUS.strip()] + [c.strip() for c in ctes])


def redact_documents_sql() -> str:
    ctes = pipeline_ctes()
    ctes.append(f"""edits AS (
  SELECT m.doc_id, (m.start_pos + u.unit_offset) AS s, (m.end_pos + u.unit_offset) AS e, m.replacement
  FROM mapped m JOIN cunits u USING ({KEY}))""")
    ctes.append("""pieces AS (
  SELECT doc_id, s, e, replacement, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev_e
  FROM edits)""")
    ctes.append("""spliced AS (
  SELECT p.doc_id,
         string_agg(substr(d.text, p.prev_e + 1, p.s - p.prev_e) || p.replacement, '' ORDER BY p.s)
           || substr(d.text, max(p.e) + 1) AS text
  FROM pieces p JOIN cdocs d USING (doc_id) GROUP BY p.doc_id, d.text)""")
    return with_corpus_rec(*ctes) + """
SELECT d.doc_id, coalesce(s.text, d.text) AS text FROM cdocs d LEFT JOIN spliced s USING (doc_id)"""


def resolve_overlaps_sql() -> str:
    det, all_name = detector_ctes("corpus", "p")
    return with_corpus_rec(*(det + resolve_ctes("kept", all_name))) + f"""
SELECT {KEY}, pii_type, value, start_pos, end_pos, source FROM kept"""


def mapping_new_keys_sql() -> str:
    return with_corpus_rec(*pipeline_ctes()) + """
SELECT pii_type, norm_key, surface, replacement, id FROM newmap"""


def surrogate_uniqueness_sql() -> str:
    return with_corpus_rec(*pipeline_ctes()) + """
SELECT pii_type, count(*)::BIGINT AS n_keys, count(DISTINCT replacement)::BIGINT AS n_replacements,
       count(DISTINCT surface)::BIGINT AS n_surfaces
FROM newmap GROUP BY pii_type"""


def category_counts_sql() -> str:
    cats = " UNION ALL ".join(f"SELECT '{c}' AS category, {i}::INTEGER AS rank" for i, c in enumerate(V.CATEGORIES))
    return with_corpus_rec(*pipeline_ctes(), f"cats AS ({cats})") + f"""
SELECT c.category, c.rank, count(DISTINCT k.key)::BIGINT AS distinct_values
FROM cats c LEFT JOIN (SELECT pii_type, {summary_key('value')} AS key FROM kept
                       WHERE length({summary_key('value')}) > 0) k ON k.pii_type = c.category
GROUP BY c.category, c.rank"""


def normalize_key_sql() -> str:
    det, all_name = detector_ctes("corpus", "p")
    return with_corpus(*det) + f"""
SELECT DISTINCT pii_type, value, {normalize_key('value')} AS norm_key, {summary_key('value')} AS summary_key
FROM {all_name}"""


def mobile_number_sql() -> str:
    det, _ = detector_ctes("corpus", "p")
    digits = "regexp_replace(value, '\\P{Nd}', '', 'g')"
    mobile = (f"CASE WHEN starts_with({digits}, '91') AND length({digits}) = 12 THEN substr({digits}, 3, 10) "
              f"WHEN starts_with({digits}, '0091') AND length({digits}) = 14 THEN substr({digits}, 5, 10) "
              f"WHEN starts_with({digits}, '0') AND length({digits}) = 11 THEN substr({digits}, 2, 10) "
              f"ELSE {digits} END")
    return with_corpus(*det) + f"""
SELECT {KEY}, value, start_pos, end_pos,
       CASE WHEN length({mobile}) = 10 AND substr({mobile}, 1, 1) IN ('6', '7', '8', '9') THEN {mobile} END AS mobile
FROM p_phone"""


# --------------------------------------------------------------------------
# audits over persons
# --------------------------------------------------------------------------

POS = "(doc_id, CASE unit_kind WHEN 'paragraph' THEN 0 WHEN 'cell' THEN 1 ELSE 2 END, unit_no, start_pos)"


def _unique_persons_cte() -> str:
    return f"""up AS (
  SELECT person_key, arg_min(value, pos) AS value, arg_min(source, pos) AS source,
         arg_min(confidence, pos) AS confidence, min(pos) AS pos
  FROM (SELECT {summary_key('value')} AS person_key, {collapse_ws('value')} AS value, source, confidence,
               {POS} AS pos FROM kept WHERE pii_type = 'PERSON')
  WHERE length(person_key) > 0 GROUP BY person_key)"""


def unique_persons_sql() -> str:
    return with_corpus_rec(*pipeline_ctes(), _unique_persons_cte()) + """
SELECT person_key, value, source, confidence, pos[1] AS first_doc_id, pos[3] AS first_unit_no,
       pos[4] AS first_start FROM up"""


def person_sources_sql() -> str:
    return with_corpus_rec(*pipeline_ctes(), _unique_persons_cte()) + """
SELECT source, count(*)::BIGINT AS persons FROM up GROUP BY source"""


def person_sample_sql(n: int = V.SAMPLE_SIZE) -> str:
    return with_corpus_rec(*pipeline_ctes(), _unique_persons_cte()) + f"""
SELECT position, value, source, remaining FROM (
  SELECT row_number() OVER (ORDER BY pos[1], pos[3], pos[4], person_key)::INTEGER AS position, value, source,
         greatest(count(*) OVER () - {n}, 0)::BIGINT AS remaining FROM up) WHERE position <= {n}"""


# --------------------------------------------------------------------------
# mapping edge, second run (suppression + lookup), table cells
# --------------------------------------------------------------------------

def mapping_file_roundtrip_sql() -> str:
    return mapping_new_keys_sql()


def mapping_json_roundtrip_sql() -> str:
    return with_corpus_rec(*pipeline_ctes()) + "\nSELECT pii_type, surface, replacement FROM newmap"


def _second_run_ctes(ctes: list[str] | None = None, found: str = "p_all") -> list[str]:
    """A run over the findings ``found`` with the mapping of a first run."""
    ctes = ctes or pipeline_ctes()
    ctes += [
        "fakes AS (SELECT DISTINCT " + normalize_key("replacement") + " AS fake FROM newmap)",
        f"""raw2 AS (SELECT *, {normalize_key('value')} AS norm FROM {found})""",
        """supp AS (SELECT r.* FROM raw2 r WHERE length(r.norm) > 0 AND EXISTS (
            SELECT 1 FROM fakes g WHERE length(g.fake) > 0
              AND (contains(g.fake, r.norm) OR contains(r.norm, g.fake))))""",
        f"""left2 AS (SELECT r.* EXCLUDE (norm) FROM raw2 r
            WHERE NOT EXISTS (SELECT 1 FROM supp s WHERE s.doc_id = r.doc_id AND s.unit_kind = r.unit_kind
              AND s.unit_no = r.unit_no AND s.seq = r.seq AND s.start_pos = r.start_pos))""",
    ]
    ctes += resolve_ctes("kept2", "left2")
    ctes += [
        f"""keys2 AS (
  SELECT pii_type, norm_key, arg_min(surface, ord) AS surface FROM (
    SELECT pii_type, {normalize_key('value')} AS norm_key, {collapse_ws('value')} AS surface,
           (doc_id, CASE unit_kind WHEN 'paragraph' THEN 0 WHEN 'cell' THEN 1 ELSE 2 END, unit_no, -start_pos) AS ord
    FROM kept2) WHERE length(norm_key) > 0 GROUP BY pii_type, norm_key)""",
        f"""new2 AS (
  SELECT n.pii_type, n.norm_key, n.surface, coalesce(b.base, 0) + row_number() OVER (
           PARTITION BY n.pii_type ORDER BY {bucket_sql('n.pii_type', 'n.norm_key')}, n.norm_key) - 1 AS id
  FROM (SELECT k.* FROM keys2 k
        WHERE NOT EXISTS (SELECT 1 FROM newmap m WHERE m.pii_type = k.pii_type AND m.norm_key = k.norm_key)) n
  LEFT JOIN (SELECT pii_type, max(id) + 1 AS base FROM newmap GROUP BY pii_type) b USING (pii_type))""",
        f"""map2 AS (SELECT pii_type, norm_key, replacement FROM newmap UNION ALL
             SELECT pii_type, norm_key, {surrogate_sql('pii_type', 'id')} FROM new2)""",
        f"""mapped2 AS (SELECT k.*, m.replacement FROM (SELECT *, {normalize_key('value')} AS norm_key FROM kept2) k
             LEFT JOIN map2 m USING (pii_type, norm_key))""",
    ]
    return ctes


def _redacted_docs_ctes() -> list[str]:
    """First run, then its redacted documents as units ``runits``."""
    ctes = pipeline_ctes()
    ctes.append(f"""edits AS (
  SELECT m.doc_id, (m.start_pos + u.unit_offset) AS s, (m.end_pos + u.unit_offset) AS e, m.replacement
  FROM mapped m JOIN cunits u USING ({KEY}))""")
    ctes.append("""pieces AS (
  SELECT doc_id, s, e, replacement, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev_e
  FROM edits)""")
    ctes.append("""spliced AS (
  SELECT p.doc_id,
         string_agg(substr(d.text, p.prev_e + 1, p.s - p.prev_e) || p.replacement, '' ORDER BY p.s)
           || substr(d.text, max(p.e) + 1) AS text
  FROM pieces p JOIN cdocs d USING (doc_id) GROUP BY p.doc_id, d.text)""")
    ctes.append("""rdocs AS (SELECT d.doc_id, coalesce(s.text, d.text) AS text FROM cdocs d LEFT JOIN spliced s USING (doc_id))""")
    ctes.append("""runits AS (
  SELECT doc_id::BIGINT AS doc_id, 'paragraph' AS unit_kind, unit_no::INTEGER AS unit_no, text
  FROM (SELECT doc_id, unnest(parts) AS text, unnest(generate_series(0, len(parts) - 1)) AS unit_no
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM rdocs)))""")
    det, _ = detector_ctes("runits", "r")
    return ctes + det


def suppress_generated_sql() -> str:
    ctes = _redacted_docs_ctes() + [
        "fakes AS (SELECT DISTINCT " + normalize_key("replacement") + " AS fake FROM newmap)",
        f"""rraw AS (SELECT *, {normalize_key('value')} AS norm FROM r_all)""",
    ]
    return with_corpus_rec(*ctes) + f"""
SELECT {KEY}, pii_type, value, start_pos, end_pos FROM rraw r WHERE length(r.norm) > 0 AND EXISTS (
  SELECT 1 FROM fakes g WHERE length(g.fake) > 0 AND (contains(g.fake, r.norm) OR contains(r.norm, g.fake)))"""


def mapping_lookup_sql() -> str:
    return with_corpus_rec(*_second_run_ctes()) + f"""
SELECT {KEY}, pii_type, value, start_pos, end_pos, replacement FROM mapped2"""


def mapping_append_sql() -> str:
    halves = [CORPUS_DOCS, "half_a AS (SELECT * FROM cunits WHERE doc_id % 2 = 0)", "half_b AS (SELECT * FROM cunits WHERE doc_id % 2 = 1)"]
    second, name = detector_ctes("half_b", "s")
    ctes = _second_run_ctes(pipeline_ctes("half_a", halves) + second, name)
    return with_corpus_rec(*ctes) + f"""
SELECT pii_type, norm_key, surface, replacement, id FROM newmap UNION ALL
SELECT pii_type, norm_key, surface, {surrogate_sql('pii_type', 'id')}, id FROM new2"""


def redact_conversations_sql() -> str:
    units = """vunits AS (SELECT (conv_id * 100000 + turn)::BIGINT AS doc_id, 'cell' AS unit_kind, 0::INTEGER AS unit_no, text FROM conversations)"""
    ctes = pipeline_ctes("vunits", base=[units])
    ctes.append(f"""vpieces AS (
  SELECT {KEY}, start_pos AS s, end_pos AS e, replacement,
         coalesce(lag(end_pos) OVER (PARTITION BY {KEY} ORDER BY start_pos), 0) AS prev_e FROM mapped)""")
    ctes.append("""vspliced AS (
  SELECT p.doc_id, string_agg(substr(u.text, p.prev_e + 1, p.s - p.prev_e) || p.replacement, '' ORDER BY p.s)
           || substr(u.text, max(p.e) + 1) AS text
  FROM vpieces p JOIN vunits u USING (doc_id) GROUP BY p.doc_id, u.text)""")
    return with_corpus_rec(*ctes) + """
SELECT c.conv_id, c.turn, coalesce(s.text, c.text) AS text
FROM conversations c LEFT JOIN vspliced s ON s.doc_id = c.conv_id * 100000 + c.turn"""


TABLE_UNITS = f"""
ctable AS (SELECT c_custkey, c_name, p.text AS note FROM customer JOIN pii_units p ON p.doc_id - {PII_DOC_BASE} = c_custkey),
tunits AS (SELECT c_custkey::BIGINT AS doc_id, 'cell' AS unit_kind, 0::INTEGER AS unit_no, c_name AS text FROM ctable
           UNION ALL SELECT c_custkey::BIGINT, 'cell', 1::INTEGER, note FROM ctable)"""


def redact_table_cells_sql() -> str:
    ctes = pipeline_ctes("tunits", base=[TABLE_UNITS])
    ctes.append(f"""tpieces AS (
  SELECT {KEY}, start_pos AS s, end_pos AS e, replacement,
         coalesce(lag(end_pos) OVER (PARTITION BY {KEY} ORDER BY start_pos), 0) AS prev_e FROM mapped)""")
    ctes.append(f"""tspliced AS (
  SELECT p.doc_id, p.unit_no, string_agg(substr(u.text, p.prev_e + 1, p.s - p.prev_e) || p.replacement, ''
           ORDER BY p.s) || substr(u.text, max(p.e) + 1) AS text
  FROM tpieces p JOIN tunits u USING ({KEY}) GROUP BY p.doc_id, p.unit_no, u.text)""")
    return with_corpus_rec(*ctes) + """
SELECT t.c_custkey, coalesce(a.text, t.c_name) AS c_name, coalesce(b.text, t.note) AS note
FROM ctable t LEFT JOIN tspliced a ON a.doc_id = t.c_custkey AND a.unit_no = 0
LEFT JOIN tspliced b ON b.doc_id = t.c_custkey AND b.unit_no = 1"""


LABELLED_LABEL_RE = (
    f"(?i)((?:registered{WS}+office|corporate{WS}+office|registered{WS}+address|office{WS}+address"
    f"|residential{WS}+address|permanent{WS}+address|correspondence{WS}+address|mailing{WS}+address"
    f"|communication{WS}+address|address){WS}*(?:of|is)?{WS}*[:,\\-]?{WS}*)"
    f"([^.\\n;]{{5,250}}?(?:\\b{D}{{6}}\\b|\\b(?:Maharashtra|India)\\b))"
)
LABELLED_AHEAD_RE = ("(?i)^[^.\\n;]{0,250}\\b(?:village|taluka|district|road|marg|lane|nagar|colony|apartment|"
                     "tower|building|floor|sector|pune|mumbai|maharashtra|india|pincode|pin)")


def detect_address_labelled_sql() -> str:
    cte = spans_cte("la", "corpus", LABELLED_LABEL_RE, group=True)
    return with_corpus(cte) + f"""
SELECT l.{KEY.replace(', ', ', l.')}, l.value, l.start_pos, l.end_pos FROM la l JOIN corpus u USING ({KEY})
WHERE regexp_matches(substr(u.text, l.start_pos + 1), {q(LABELLED_AHEAD_RE)})"""


# --------------------------------------------------------------------------
# NER: stand-in tagger candidates, validation and audits
# --------------------------------------------------------------------------

WORDCH = r"[\p{L}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]"
NOTW = r"[^\p{L}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]"


def uword_re(terms: list[str], flags: str = "(?i)") -> str:
    """``\\b(?:terms)\\b`` with a Unicode word boundary, as an existence test."""
    return f"{flags}(?:^|{NOTW})(?:" + "|".join(terms) + f")(?:{NOTW}|$)"


def _strip_chars(x: str) -> str:
    return f"regexp_replace({x}, '^[.,''’-]+|[.,''’-]+$', '', 'g')"


def _words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END)"


def person_gate_sql(value: str) -> str:
    from ..operators.ner import PY_DIGIT
    v = f"regexp_replace(regexp_replace({py_strip(value)}, '[*^&§†‡]+$', ''), '{WS}+', ' ', 'g')"
    lower = casefold(v)
    w = _words(py_strip(v))
    stripped = f"list_transform({w}, lambda x: {_strip_chars(casefold('x'))})"
    caps = (f"len(list_filter(list_transform({w}, lambda x: {_strip_chars('x')}), "
            f"lambda x: regexp_matches(x, '^\\p{{Lu}}')))")
    non_person = str_list(dict.fromkeys(V.PERSON_NON_NAME_WORDS + V.PERSON_GATE_EXTRA_WORDS))
    alpha = f"length(regexp_replace({v}, '[^\\p{{L}}]', '', 'g'))"
    return f"""(length({v}) BETWEEN {V.PERSON_MIN_CHARS} AND {V.PERSON_MAX_CHARS}
      AND len({w}) BETWEEN {V.PERSON_MIN_WORDS} AND {V.PERSON_MAX_WORDS}
      AND NOT regexp_matches({v}, {q(PY_DIGIT)}) AND strpos({v}, '@') = 0 AND strpos({lower}, 'www.') = 0
      AND NOT regexp_matches({v}, '[/:\\t\\n]') AND {lower} NOT IN ({", ".join(q(x) for x in V.PERSON_BLOCKLIST)})
      AND NOT coalesce(regexp_full_match({w}[1], '[A-Za-z]\\.?'), false)
      AND NOT list_has_any({stripped}, {non_person})
      AND NOT regexp_matches({lower}, {q(uword_re(V.LOCATION_COMPOUND_WORDS, ''))})
      AND length({v}) > 0 AND {alpha} / length({v}) >= {V.ALPHA_RATIO}
      AND {caps} >= 2)"""


def shape_sql(value: str) -> tuple[str, str]:
    """(score, reasons list) of the name-shape score."""
    from ..operators.ner import PY_DIGIT
    v = collapse_ws(value)
    lower = casefold(v)
    w = _words(v)
    lw = _words(lower)
    n = f"length({v})"
    bad = f"list_sort(list_distinct(list_intersect({lw}, {str_list(V.PERSON_NON_NAME_WORDS)})))"
    alpha_ok = f"(length(regexp_replace({v}, '[^\\p{{L}}]', '', 'g')) / {n} >= {V.ALPHA_RATIO})"
    caps = (f"len(list_filter(list_transform({w}, lambda x: regexp_replace(x, {q(V.SHAPE_LETTERS)}, '', 'g')), "
            f"lambda x: regexp_matches(x, '^\\p{{Lu}}')))")
    conds = [
        (f"{n} < {V.PERSON_MIN_CHARS} OR {n} > {V.PERSON_MAX_CHARS}", "0", "[]::VARCHAR[]"),
        (f"len({w}) < {V.PERSON_MIN_WORDS} OR len({w}) > {V.PERSON_MAX_WORDS}", "1", "['reasonable length']"),
        (f"regexp_matches({v}, {q(PY_DIGIT)})", "-5", "['contains number']"),
        (f"strpos({v}, '@') > 0", "-5", "['email']"),
        (f"strpos({lower}, 'www.') > 0", "-5", "['website']"),
        (f"regexp_matches({v}, '[/:\\t\\n]')", "-4", "['contains separator']"),
        (f"{lower} IN ({', '.join(q(x) for x in V.PERSON_BLOCKLIST)})", "-5", "['blocked phrase']"),
        (f"len({bad}) > 0", "-4", f"['non-person words: ' || array_to_string({bad}, ', ')]"),
    ]
    cap_pts = f"(CASE WHEN {caps} = len({w}) THEN 1 WHEN {caps} >= 2 THEN 0 ELSE -1 END)"
    cap_reason = (f"(CASE WHEN {caps} = len({w}) THEN 'proper capitalization' WHEN {caps} >= 2 "
                  f"THEN 'partially capitalized' ELSE 'poor capitalization' END)")
    score = "CASE " + " ".join(f"WHEN {c} THEN {s}" for c, s, _ in conds) + \
        f" ELSE 3 + (CASE WHEN {alpha_ok} THEN 1 ELSE -2 END) + {cap_pts} END"
    reasons = "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, _, r in conds) + \
        (f" ELSE ['reasonable length', '2-5 words', CASE WHEN {alpha_ok} THEN 'mostly alphabetic' "
         f"ELSE 'not mostly alphabetic' END, {cap_reason}] END")
    return score, reasons


def org_gate_sql(value: str) -> str:
    v = collapse_ws(value)
    lower = casefold(v)
    ends = " OR ".join(f"ends_with({lower}, {q(e)})" for e in V.ORG_TRUNCATED_ENDINGS)
    terms = " OR ".join(f"contains({lower}, {q(t)})" for t in V.ORG_DOCUMENT_TERMS)
    suffix = " OR ".join(f"ends_with({lower}, {q(t)})" for t in V.ORG_STRONG_SUFFIXES)
    ind = " OR ".join(f"contains({lower}, {q(t)})" for t in V.ORG_SPECIAL_INDICATORS)
    return f"""(length({v}) BETWEEN {V.ORG_MIN_CHARS} AND {V.ORG_MAX_CHARS}
      AND NOT regexp_matches({lower}, '^the{WS}+offer(?:{NOTW}|$)')
      AND NOT regexp_matches({lower}, '^the{WS}+issue(?:{NOTW}|$)')
      AND NOT ({ends}) AND {lower} NOT IN ({", ".join(q(x) for x in V.ORG_BLOCKLIST)})
      AND NOT ({terms}) AND {lower} NOT IN ({", ".join(q(x) for x in V.ORG_GENERIC_NAMES)})
      AND (({suffix}) OR ({ind})))"""


def ner_ctes(src: str = "corpus", p: str = "") -> list[str]:
    """CTEs of the stand-in tagger and its validation; names start with ``p``."""
    from ..operators.ner import CAPITALISED_RUN
    lowerv = casefold("value")
    org = " OR ".join([f"ends_with({lowerv}, {q(t)})" for t in V.ORG_STRONG_SUFFIXES]
                      + [f"contains({lowerv}, {q(t)})" for t in V.ORG_SPECIAL_INDICATORS])
    shape_score, shape_reasons = shape_sql("c.value")
    ctx = ("substr(u.text, greatest(c.start_pos - 100, 0) + 1, "
           "least(length(u.text), c.end_pos + 100) - greatest(c.start_pos - 100, 0))")
    pc = f"regexp_matches({ctx}, {q(uword_re(V.PERSON_CONTEXT_TERMS))})"
    npc = f"regexp_matches({ctx}, {q(uword_re(V.NON_PERSON_CONTEXT_TERMS))})"
    overlap = (f"list_sort(list_intersect(list_distinct(list_transform(regexp_extract_all(c.value, '([A-Za-z]+)', 1), "
               f"lambda x: lower(x))), {str_list(V.SENTENCE_WORDS)}))")
    return [
        f"{p}nblank AS (SELECT * FROM {src} WHERE regexp_matches(text, '[^{PYWS}]'))",
        spans_cte(f"{p}runs", f"{p}nblank", CAPITALISED_RUN),
        f"""{p}cands AS (SELECT *, CASE WHEN {org} THEN 'ORG' ELSE 'PERSON' END AS label,
              regexp_replace({casefold('value')}, '{WS}+', ' ', 'g') AS pnorm FROM {p}runs)""",
        f"""{p}first AS (SELECT * EXCLUDE (rn) FROM (
              SELECT *, row_number() OVER (PARTITION BY {KEY}, label, pnorm ORDER BY start_pos) AS rn FROM {p}cands)
            WHERE label = 'ORG' OR rn = 1)""",
        f"""{p}scored AS (
  SELECT c.{KEY.replace(', ', ', c.')}, c.value, c.label, c.start_pos, c.end_pos,
         {person_gate_sql('c.value')} AS gate,
         (2 + ({shape_score}) + CASE WHEN {pc} THEN 3 ELSE 0 END - CASE WHEN {npc} THEN 3 ELSE 0 END
            - CASE WHEN len({overlap}) > 0 THEN 4 ELSE 0 END)::INTEGER AS conf_score,
         list_concat(['ner PERSON'], {shape_reasons},
            CASE WHEN {pc} THEN ['person context'] ELSE []::VARCHAR[] END,
            CASE WHEN {npc} THEN ['non-person context'] ELSE []::VARCHAR[] END,
            CASE WHEN len({overlap}) > 0 THEN ['sentence-like words: ' || array_to_string({overlap}, ', ')]
                 ELSE []::VARCHAR[] END) AS conf_reasons,
         {org_gate_sql('c.value')} AS org_ok
  FROM {p}first c JOIN {p}nblank u USING ({KEY}))""",
        f"""{p}ner AS (
  SELECT {KEY}, value, label, start_pos, end_pos,
         CASE WHEN label = 'PERSON' THEN gate AND conf_score >= {V.ACCEPT_SCORE} ELSE org_ok END AS accepted,
         CASE WHEN label = 'PERSON' THEN CASE WHEN gate THEN conf_score ELSE {V.SHAPE_REJECT_SCORE} END END AS score,
         CASE WHEN label = 'PERSON' THEN CASE WHEN gate THEN conf_reasons
              ELSE [{q(V.SHAPE_REJECT_REASON)}] END END AS reasons
  FROM {p}scored)""",
    ]


def ner_first_mention_sql() -> str:
    return with_corpus(*ner_ctes()) + f"\nSELECT {KEY}, label, value, start_pos, end_pos FROM first"


def ner_person_score_sql() -> str:
    return with_corpus(*ner_ctes()) + f"""
SELECT {KEY}, value, start_pos, end_pos, accepted, score, array_to_string(reasons, ' | ') AS reasons
FROM ner WHERE label = 'PERSON'"""


def ner_organizations_sql() -> str:
    return with_corpus(*ner_ctes()) + f"""
SELECT {KEY}, value, start_pos, end_pos FROM ner WHERE label = 'ORG' AND accepted"""


def ner_candidate_table_sql() -> str:
    """The person gate with part-of-speech counts; the other columns as without them."""
    turn = "((doc_id + start_pos) % 5)"
    pos_ok = f"({turn} IN (2, 3) OR {turn} = 4)"        # two proper nouns; one and an initial; no counts: the shape decides
    return with_corpus(*ner_ctes()) + f"""
SELECT {KEY}, label, value, start_pos, end_pos,
       CASE WHEN label = 'PERSON' THEN accepted AND {pos_ok} ELSE accepted END AS accepted,
       CASE WHEN label = 'PERSON' THEN CASE WHEN {pos_ok} THEN score ELSE {V.SHAPE_REJECT_SCORE} END END AS score
FROM ner"""


def ner_totals_sql() -> str:
    return with_corpus(*ner_ctes()) + """
SELECT doc_id, unit_kind, unit_no, count(*)::BIGINT AS candidates, count_if(accepted)::BIGINT AS accepted,
       count_if(NOT accepted)::BIGINT AS rejected
FROM ner WHERE label = 'PERSON' GROUP BY GROUPING SETS ((doc_id, unit_kind, unit_no), (doc_id), ())"""


def ner_rejection_reasons_sql() -> str:
    return with_corpus(*ner_ctes()) + f"""
SELECT reason, count(*)::BIGINT AS count, min(pos)[1] AS first_doc_id, min(pos)[3] AS first_unit_no,
       min(pos)[4] AS first_start
FROM (SELECT reasons[-1] AS reason, {POS} AS pos FROM ner WHERE label = 'PERSON' AND NOT accepted)
GROUP BY reason"""


def ner_samples_sql(n: int = V.SAMPLE_SIZE) -> str:
    return with_corpus(*ner_ctes()) + f"""
SELECT {KEY}, accepted, position, value, score, remaining FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY}, accepted ORDER BY start_pos)::INTEGER AS position,
         greatest(count(*) OVER (PARTITION BY {KEY}, accepted) - {n}, 0)::BIGINT AS remaining
  FROM ner WHERE label = 'PERSON') WHERE position <= {n}"""


def surrogate_ids_sql() -> str:
    return with_corpus_rec(*pipeline_ctes()) + """
SELECT pii_type, replacement, id FROM newmap"""


def redact_null_ids_sql() -> str:
    """First-seen surfaces follow the ids, a missing one first, so keys with several spellings may differ
    from the run with all ids; the replacement depends on the key alone."""
    return f"""
SELECT r.doc_id AS nr, CASE WHEN r.doc_id % 3 <> 0 THEN r.doc_id END AS doc_id, r.text FROM ({redact_documents_sql()}) r"""
