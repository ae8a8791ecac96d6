"""Secret scan with corpus-wide ownership frequency, DataFrame functions only.

Every text is scanned for three base kinds (assignments, access keys, long hex
runs) and for other token-like strings.  All candidates are hashed and counted
over the corpus by distinct repositories and distinct owners: a value confined to
``max_owners`` owners and ``max_repos`` repositories is a live-looking credential; one
seen under more owners, or in more repositories even of one owner (a documentation key
that a large source repeats), is a widely copied example.  Base matches always stay;
a token-like string is reported only if it is owner-specific.  Every reported span
carries both counts.

The texts are read once and never shuffled.  Candidate rows (hash, owner,
repository, place) are deduplicated and counted in steps that combine before
each shuffle, so a value copied into a third of all rows is one row per task.

Defined results: null or empty text has no spans; offsets are code points, end
exclusive; rows that share doc_id and text get the same result; a null owner or
repository counts as one owner or repository; U+E000 in a text is handled;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

MARK = "\uE000"
STEP = 256                       # spans gathered at a time, so that building the list stays near-linear
KINDS = ["assign", "access", "hex", "token"]      # order of kinds at equal starts

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"           # the maximal runs of [0-9a-f]+ with 24 or more characters
TOKEN = ASSIGN + r"|([A-Za-z0-9+/_-]{20,})"       # a value after a keyword belongs to its assignment

SPAN = "array<struct<kind:int,start:int,end:int,hash:bigint>>"


def matches(text: Column, pattern: str, kind: int, keep, value=lambda m: m) -> Column:
    """All matches of ``pattern`` that ``keep`` accepts, as ``SPAN``.  Odd pieces
    of the text split at marked matches are the matches; their places are
    running sums of piece lengths."""
    safe = F.translate(text, MARK, "\uFFFD")                  # never part of a match, same length
    pieces = F.split(F.regexp_replace(safe, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    empty = F.array().cast(SPAN)

    def one(acc, piece):
        end = acc["at"] + F.length(piece)
        hit = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"),
                       F.xxhash64(value(piece)).alias("hash"))
        out = F.when((acc["i"] % 2 == 1) & keep(piece), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), out.alias("out"))

    def some(acc, ps, first):
        inner = F.aggregate(F.slice(ps, first, STEP), F.struct(acc["at"], acc["i"], empty.alias("out")), one)
        return F.struct(inner["at"].alias("at"), inner["i"].alias("i"), F.concat(acc["out"], inner["out"]).alias("out"))

    def fold(ps):                         # over a bound value: the text is split once
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(ps), F.lit(STEP)), start, lambda acc, first: some(acc, ps, first),
                           lambda acc: acc["out"])

    found = F.get(F.transform(F.array(pieces), fold), F.lit(0))
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(empty)


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """(doc_id, body, repo, owner, base, token): candidate spans of every row."""
    text = docs[text_col].cast("string")
    base = F.concat(
        matches(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, lambda m: F.regexp_extract(m, ASSIGN, 2)),
        matches(text, ACCESS, 1, lambda m: F.length(m) >= 20),
        matches(text, HEX, 2, lambda m: F.lit(True)))
    token = matches(text, TOKEN, 3, lambda m: (F.regexp_extract(m, TOKEN, 3) != "") & m.rlike("[0-9]") & m.rlike("[a-z]")
                    & m.rlike("[A-Z]") & ~m.rlike(f"{ACCESS}|{HEX}"))
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("body"),
                       docs[repo_col].cast("string").alias("repo"), docs[owner_col].cast("string").alias("owner"),
                       F.array_sort(base).alias("base"), token.alias("token"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of every candidate value, over the whole corpus."""
    seen = found.select("repo", "owner", F.explode(F.concat("base", "token")).alias("s")) \
        .groupBy(F.col("s.hash").alias("hash"), "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = seen.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"))
    return by_owner.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, max_owners: int = 2, max_repos: int = 10, id_col: str = "doc_id", text_col: str = "text",
                 repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(doc_id, base, spans, n_live, n_copied) for every row: base spans, all
    reported spans in order with the owners and repositories of their values, and how
    many reported spans hold an owner-specific or a widely copied value."""
    found = written(scan(docs, id_col, text_col, repo_col, owner_col), "secrets")
    places = found.where("size(base) + size(token) > 0").select("doc_id", "body", F.explode(F.concat("base", "token")).alias("s")) \
        .select("doc_id", "body", "s", F.col("s.hash").alias("hash")).distinct()
    judged = places.join(ownership(found), "hash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)) \
        .where(F.col("live") | (F.col("s.kind") < 3))
    per_row = judged.groupBy("doc_id", "body").agg(
        F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"),
                                             "n_owners", "n_repos"))).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))
    f, p = found.alias("f"), per_row.alias("p")
    rows = f.join(p, F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.body") == F.col("p.body")), "left")
    ordered = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return rows.select(F.col("f.doc_id").alias("doc_id"), ordered.alias("base"),
                       F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,n_owners:bigint,n_repos:bigint>>")).alias("spans"),
                       F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract columns over all documents; an owner is a source, a repository a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    most = lambda c: F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).alias(f"most_{c[2:]}")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan_secrets(docs).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                                     F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
                                     "n_live", "n_copied", most("n_owners"), most("n_repos"))
