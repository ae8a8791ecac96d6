"""Main text of web pages by nearest-URL page differencing.

1. **Lines.**  A tolerant one-pass scan turns a page into text lines (one per
   block element), each with what its markup says: page furniture (navigation,
   header, footer, sidebar, form, advert, notice, reader comments, hidden),
   the article, the main part, or open.  Scripts, styles and the head give none.
2. **Pairs.**  Pages are ordered by host and URL path; a run of pages with the
   same lines outside page furniture (copies, mirrors) counts as one, and each
   page is paired with the closer of the two different pages beside its run on
   its host (edit distance of the paths).
   The order is made by range partitioning, so a host with a third of all pages
   is spread over tasks; what lies across a partition border comes from
   one row of every partition.
3. **Difference.**  The line hashes of both pages are aligned by longest common
   subsequence.  Shared lines are furniture of the site and are deleted.
4. **Text.**  If the markup names an article, its lines are text but for shared
   ones that are no sentences (share bars, "read more", repeated labels): neighbours share
   passages of real articles, so shared sentences stay, and so does an article that the
   neighbour shares as a whole.  So is what the
   difference leaves of the main part around it, and of the open lines if that is
   more than the article and main part together (the article is a teaser).
   Without an article the text is what the difference leaves of the main part, or
   of the open lines; a page that shares all of them with its neighbour is a part
   of it and keeps them.

Defined results: null or empty html gives an empty text; a null or unparsable
url is a host of its own with an empty path; rows equal in page_id, url and html
get the same result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import shuffle_partitions, written

OPEN, MAIN, ARTICLE, FURNITURE = 0, 1, 2, 3

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style textarea".split())                  # without an end tag, up to the end of the page
SKIPPED = frozenset("template noscript iframe svg title datalist".split())          # only from a tag to its own end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img object canvas math semantics annotation mi mn mo ms mtext mspace "
                   "mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts".split())
FURNITURE_TAGS = frozenset("nav footer aside form button dialog menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# A class or id is furniture if all its parts are words of these two sets, one of the first among them.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup sidebar widget widgets nav navbar navigation "
    "menu breadcrumb breadcrumbs pagination pager header masthead topbar footer copyright share sharing social related recommended "
    "comment comments commentlist respond disqus replies reply login search skip".split())
FILLERS = frozenset("site page top bottom left right main global user reader the bar box area list section container wrapper block "
                    "form links item unit slot".split())
COMMENTS = re.compile(r"(?:user|reader|post|article)?[-_]?(?:comment|comments|replies|reply|respond|disqus)", re.I)
BODY_NAME = re.compile(r"(?:article|entry|post|story)[-_]?(?:body|content|text)\Z", re.I)


def furniture_name(name: str) -> bool:
    parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+", name)]
    return any(x in WORDS for x in parts) and all(x in WORDS or x in FILLERS for x in parts)


def element_ends(page: str, tag: str) -> dict[int, int]:
    """Start of every ``tag`` element that has an end tag, and where its end tag ends."""
    quoted = r"""(?>[^>"']+|"[^"]*"|'[^']*')*+"""
    any_tag = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b.*?(?:</\1\b[^>]*>|\Z)|<(/?){tag}(?=[\s/>])({quoted})>", re.S | re.I)
    out, opened = {}, []
    for m in any_tag.finditer(page):
        if m[2] == "" and not m[3].rstrip().endswith("/"):
            opened.append(m.start())
        elif m[2] and opened:
            out[opened.pop()] = m.end()
    return out


class Lines:
    """The text lines of one page: ``text``, ``kind``, ``linked`` (nothing but link text) and ``title`` (in an ``h1``)."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.kind: list[int] = []
        self.linked: list[bool] = []
        self.title: list[bool] = []
        self._parts: list[str] = []
        self._plain = False                 # text outside links in the current block
        self._title = False                 # text of an h1 in it
        self._state = OPEN
        self._scan(page)

    def _flush(self):
        if self._parts:
            line = " ".join(entities.unescape("".join(self._parts)).split())
            if line:
                self.text.append(line)
                self.kind.append(self._state)
                self.linked.append(not self._plain)
                self.title.append(self._title)
            self._parts, self._plain, self._title = [], False, False

    def _scan(self, page: str):
        stack: list[tuple[str, int]] = []   # open elements and the state outside each
        ends_of: dict[str, dict[int, int]] = {}
        links, at = 0, 0
        while m := TOKEN.match(page, at):
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if m[0][0] != "<" or m[0] == "<":
                    self._parts.append(m[0])
                    if not links and not m[0].isspace():
                        self._plain = True
                    if not m[0].isspace() and any(t == "h1" for t, _ in stack):
                        self._title = True
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if tag == "br" or tag == "p" and not any(t == "p" for t, _ in stack):
                    self._flush()
                if any(t == tag for t, _ in stack):
                    while stack:
                        name, outer = stack.pop()
                        links -= name == "a"
                        if name not in INLINE or outer != self._state:
                            self._flush()
                            self._state = outer
                        if name == tag:
                            break
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                continue
            attributes = m[3] if m[2] else m[6]
            closed = attributes.rstrip().endswith("/")
            if closed and tag in ("svg", "math"):
                continue
            if tag in SKIPPED:
                if tag not in ends_of:
                    ends_of[tag] = element_ends(page, tag)
                at = ends_of[tag].get(m.start(), at)
                continue
            if tag == "head":
                close = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = close.start() if close else at
                continue
            if tag not in INLINE:
                self._flush()
                # A block ends an open paragraph; a list item or cell ends its like.
                ends = {"li": "li", "tr": "tr", "td": "td", "th": "td", "dt": "dd", "dd": "dt", "option": "option"}.get(tag, "p")
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in INLINE:
                    k -= 1
                if k >= 0 and stack[k][0] == ends:
                    while len(stack) > k:
                        name, self._state = stack.pop()
                        links -= name == "a"
            if tag in VOID or closed and tag not in INLINE:
                continue
            state = self._inside(tag, attributes)
            if state != self._state:
                self._flush()
            stack.append((tag, self._state))
            links += tag == "a"
            self._state = state
        self._flush()

    def _inside(self, tag: str, attributes: str) -> int:
        """State of the text inside an element."""
        a = {}
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                a.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = (a.get("class", "") + " " + a.get("id", "")).split()
        comments = any(COMMENTS.match(n) for n in names)
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
        if tag in ("html", "body"):
            return self._state
        if hidden or comments and tag not in INLINE:
            return FURNITURE
        if tag == "article" or a.get("itemprop") == "articleBody":
            return max(self._state, ARTICLE)
        if self._state == FURNITURE:
            return FURNITURE
        if tag in FURNITURE_TAGS or a.get("role", "").lower() in FURNITURE_ROLES:
            return FURNITURE
        if tag == "header" and self._state != ARTICLE:
            return FURNITURE
        if tag not in INLINE and any(map(furniture_name, names)):
            return FURNITURE
        if tag == "main" or a.get("role") == "main" or any(BODY_NAME.match(n) for n in names):
            return max(self._state, MAIN)
        return self._state

    def hashes(self) -> list[int]:
        return [xxhash.xxh64_intdigest(t.encode()) - (1 << 63) for t in self.text]


def _row(a: list, b: list) -> int:
    """Bit-parallel last row of the subsequence table of ``a`` against ``b``: bit j is 0 where b[:j+1] gains one."""
    where: dict = {}
    for j, v in enumerate(b):
        where.setdefault(v, []).append(j)
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        match = 0
        for j in where.get(v, ()):
            match |= 1 << j
        hit = row & match
        row = ((row + hit) | (row - hit)) & full
    return row


def _lengths(a: list, b: list) -> np.ndarray:
    """Subsequence lengths of ``a`` against b[:j], j = 0..len(b)."""
    bits = np.unpackbits(np.frombuffer(_row(a, b).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


WALK = 1 << 26         # bits of the rows kept for walking back; longer pairs are halved first


def shared_lines(a: list, b: list) -> list[bool]:
    """For each element of ``a`` whether it is in one longest common subsequence with ``b``: common ends
    trimmed, long pairs halved at the best split (Hirschberg), so that memory grows with the lines only."""
    out = [False] * len(a)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        low, x, j, y = todo.pop()
        while low < x and j < y and a[low] == b[j]:
            out[low] = True
            low, j = low + 1, j + 1
        while x > low and y > j and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            out[x] = True
        if low == x or j == y:
            continue
        if (x - low) * (y - j) > WALK and x - low > 1:
            mid = (low + x) // 2
            best = _lengths(a[low:mid], b[j:y]) + _lengths(a[mid:x][::-1], b[j:y][::-1])[::-1]
            cut = j + int(best.argmax())
            todo += [(low, mid, j, cut), (mid, x, cut, y)]
        else:
            for i in _walk(a[low:x], b[j:y]):
                out[low + i] = True
    return out


def _walk(a: list, b: list) -> list[int]:
    """Places of ``a`` in one longest common subsequence, from all rows of the table."""
    where: dict = {}
    for j, v in enumerate(b):
        where.setdefault(v, []).append(j)
    full = (1 << len(b)) - 1
    rows, out = [full], []
    for v in a:
        row, match = rows[-1], sum(1 << j for j in where.get(v, ()))
        hit = row & match
        rows.append(((row + hit) | (row - hit)) & full)
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


#: A line that ends like a sentence (quotes and brackets may follow the stop).
PROSE = re.compile(r"""[.!?:;…。！？][\s"'’”»)\]]*\Z""")


def main_text(lines: Lines, shared: list[bool]) -> str:
    """The lines that make up the text, joined by one space."""
    of = {kind: [i for i, k in enumerate(lines.kind) if k == kind] for kind in (ARTICLE, MAIN, OPEN)}
    bare = [lines.linked[i] for i in of[OPEN]] + [False]         # two or more lines of bare links in a row are a menu
    of[OPEN] = [i for n, i in enumerate(of[OPEN]) if not (bare[n] and (bare[n + 1] or n and bare[n - 1]))]
    left = {kind: [i for i in mine if not shared[i]] for kind, mine in of.items()}
    if of[ARTICLE]:
        # A neighbour may share sentences and the title of a real article, but another shared line is a part of the site.
        mine = of[ARTICLE] if not left[ARTICLE] else [i for i in of[ARTICLE] if not shared[i] or
                                                      (lines.title[i] or PROSE.search(lines.text[i])) and not lines.linked[i]]
        mine = mine + left[MAIN]
        if any(shared) and sum(len(lines.text[i]) for i in left[OPEN]) > sum(len(lines.text[i]) for i in mine):
            mine += left[OPEN]
    else:
        mine = left[MAIN] or of[MAIN] or left[OPEN] or of[OPEN]
    return " ".join(lines.text[i] for i in sorted(mine))


KEY = ["page_id", "url_hash", "html_hash"]


def neighbours(keys: DataFrame) -> DataFrame:
    """``KEY`` of every page and of its nearest page on the same host (n_page_id, ...).
    Pages in a row with equal ``seq`` are never neighbours; without that column all differ."""
    order = ["host", "path", *KEY]
    if "seq" not in keys.columns:
        keys = keys.withColumn("seq", F.xxhash64(*KEY))
    parts = shuffle_partitions(keys.sparkSession)
    placed = written(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "pages")
    row = F.struct(*order, "seq")
    w = Window.partitionBy("part").orderBy(*order)
    ends = placed.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))      # one row per partition
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lag("high").over(by_part).alias("before"), F.lead("low").over(by_part).alias("after"))
    near = placed.select("part", *order, "seq", F.lag(row).over(w).alias("prev"), F.lead(row).over(w).alias("next")) \
        .join(F.broadcast(ends), "part") \
        .withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after"))
    # The page beyond a run of equal pages is known at the run's end and carried over the run.
    same = lambda c: F.coalesce((F.col(f"{c}.host") == F.col("host")) & (F.col(f"{c}.seq") == F.col("seq")), F.lit(False))
    beyond = lambda c: F.when(~same(c), F.struct(F.col(c).alias("page")))
    near = near.withColumn("low", beyond("prev")).withColumn("high", beyond("next"))
    runs = near.groupBy("part").agg(F.max(F.when(F.col("low").isNotNull(), F.struct(row.alias("at"), "low")))["low"].alias("low"),
                                    F.min(F.when(F.col("high").isNotNull(), F.struct(row.alias("at"), "high")))["high"].alias("high"))
    carried = lambda c, v: F.last(c, ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", carried("low", by_part).alias("low_part"), carried("high", Window.orderBy(F.desc("part"))).alias("high_part"))
    down = Window.partitionBy("part").orderBy(*[F.desc(c) for c in order])
    held = lambda c, v: F.last(c, ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("low", held("low", w)).withColumn("high", held("high", down)).join(F.broadcast(runs), "part") \
        .withColumn("prev", F.coalesce("low", "low_part")["page"]).withColumn("next", F.coalesce("high", "high_part")["page"])
    far = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.levenshtein("path", f"{c}.path"))
    near = near.withColumn("d_prev", far("prev")).withColumn("d_next", far("next"))
    pick = F.when(F.col("d_prev").isNull(), F.when(F.col("d_next").isNotNull(), F.col("next"))) \
        .when(F.col("d_next").isNull() | (F.col("d_prev") <= F.col("d_next")), F.col("prev")).otherwise(F.col("next"))
    return near.withColumn("pick", pick).where("pick is not null").select(*KEY, *[F.col(f"pick.{c}").alias(f"n_{c}") for c in KEY])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row."""
    page = pages.select(F.coalesce(pages[id_col].cast("long"), F.lit(-(1 << 63))).alias("page_id"), pages[url_col].cast("string").alias("url"),
                        pages[html_col].cast("string").alias("html"),
                        F.xxhash64(pages[url_col]).alias("url_hash"), F.xxhash64(pages[html_col]).alias("html_hash"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [Lines(h or "") for h in batch.column("html").to_pylist()]
            found = [p.hashes() for p in pages]
            seq = [xxhash.xxh64_intdigest(array("q", [h for h, k in zip(f, p.kind, strict=True) if k != FURNITURE]).tobytes()) - (1 << 63)
                   for p, f in zip(pages, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in (*KEY, "host", "path")], pa.array(seq, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                [*KEY, "host", "path", "seq", "lines"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    kinds = ", ".join(f"{c} long" for c in KEY)
    lines = written(page.select(*KEY, host.alias("host"), path.alias("path"), "html")
                    .mapInArrow(outline, f"{kinds}, host string, path string, seq long, lines array<long>"), "lines")
    pairs = neighbours(lines.select(*KEY, "host", "path", "seq").distinct())
    other = lines.select(*[F.col(c).alias(f"n_{c}") for c in KEY], "lines").dropDuplicates([f"n_{c}" for c in KEY])
    beside = pairs.join(other, [f"n_{c}" for c in KEY]).select(*KEY, "lines")
    both = page.join(beside, KEY, "left").select("page_id", "url", "html", "lines")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, shared = [], []
            for h, near in zip(batch.column("html").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                own = Lines(h or "")
                same = shared_lines(own.hashes(), near) if near else [False] * len(own.text)
                texts.append(main_text(own, same))
                shared.append(sum(same))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(shared, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_shared"])

    out = both.mapInArrow(task, "page_id long, url string, text string, n_chars long, n_shared long")
    return out.withColumn("page_id", F.expr(f"nullif(page_id, {-(1 << 63)})"))


def op9_pagetext(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
