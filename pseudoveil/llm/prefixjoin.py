"""Jaccard self-join of shingle sets by a grouped prefix join.

A text is the set of its distinct word shingles (64-bit XXH64).  Two sets link at
``100 * |intersection| >= percent * |union|``.

1. **Classes.**  Texts with equal sets become one class, combined before the shuffle.
2. **Loners.**  Linked sets of at most N tokens differ in at most d = floor(2N (1-t)/(1+t)) tokens, so of
   d + 1 parts into which a hash divides all tokens one is equal in both.  Sets that share no
   (size band, part, content) with another set link with nothing and go no further; the rows of
   this step are a sixth of the tokens, and a shared one nearly always means near copies.
3. **Order.**  The prefix of a set is its first tokens in a global order, rare ones first: by
   the number of sets that hold the token, then by hash.  One shuffle of (token, set) rows
   finds the tokens of several sets and their numbers.  Tokens of one set come first in
   the order and can be shared with nobody, so a set with more of them than its prefix has
   tokens is done: it links with nothing.
4. **Groups.**  Classes with the same size and the same prefix (but for tokens that nobody
   shares) become one group.
   The inverted index holds groups: linked sets share a token of their prefixes
   (n - ceil(t n) + 1 tokens), and at the first shared one the tokens that are left must
   still reach the overlap, which also filters by size.
   Lists are kept by token and size band, bands overlapping by one, so that sets of too
   different sizes do not meet.
5. **Verification** is exact, on whole sets.  A pair goes there only if the 512-bit parity
   sketches of its sets differ in no more bits than the sets may differ in tokens (every token
   flips one bit, so the sketch never drops a link).  A crowd of near copies has a square of
   links, of which the result needs the components only.  So every group and every token
   list is first checked as a star, against one member, a few times over with other
   members; then components are computed and *all* remaining candidates of different
   components are expanded to their members and verified.  In a list only members
   outside its main component start such candidates.  No candidate is dropped
   but those whose ends are connected already.  Only the texts of candidates are read again.
6. **Components.**  Links feed the connected-components job.

Hot keys: a list or member of a crowd is joined with its tiny rows spread over salts; sets
travel to balanced keys only.  The rows (token, set) of one token pass through one task as a
stream; nothing of them is gathered.  Work that stays with the square of a list is the
sketch comparison of members that agree in a prefix token but in no component.

Defined results: a null or word-free text has an empty set, is linked with nothing and is
its own component; a text with fewer words than a shingle has its word sequence as only
element; repeated rows give repeated result rows, and rows that share an id are judged
each by its own text; a row without an id is linked with nothing and has a null component;
an empty table gives no rows; columns other than ``id_col`` and ``text_col`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.key_filter import bits_for, key_filter, may_hold
from .simhash import joined_words
from .storage import components, written
from .words import mix64, text_slices, words, xxh64

SALTS = 8              # places over which the rows of one key are spread
STAR = 1000            # members of a star checked by one copy of its centre
STARS = 2              # times that lists are checked as stars before the rest is expanded
WIDE = 1.5             # width of the size bands of the parts, at least
WORDS = 8              # 64-bit words of a parity sketch


# --------------------------------------------------------------------------
# shingle sets inside tasks
# --------------------------------------------------------------------------

def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of every text, ordered by both, and set sizes."""
    w = words(column)
    if not len(w.start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(w.n_docs, np.int64)
    buf, at = joined_words(w)
    stop = at + (w.end - w.start)
    count = w.per_doc()
    first = np.cumsum(count) - count
    n = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(w.n_docs), n)
    word = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(doc))
    h = xxh64(buf, at[word], stop[word + np.minimum(count[doc], shingle) - 1])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
    doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=w.n_docs).astype(np.int64)


def per_set(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of the values of every set, modulo 2**64; 0 for an empty one."""
    total = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    end = np.cumsum(size)
    return total[end] - total[end - size]


def names(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit name of every set of hashes."""
    with np.errstate(over="ignore"):
        return per_set(mix64(h), size), per_set(mix64(h ^ np.uint64(0x9E3779B97F4A7C15)), size)


def parity_sketches(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(sets, WORDS) uint64: bit b tells whether an odd number of the set's tokens falls on b."""
    out = np.zeros((len(size), WORDS), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        first = (np.cumsum(size) - size)[full]
        bit = mix64(h ^ np.uint64(0xD1B54A32D192ED03))
        one = np.left_shift(np.uint64(1), bit & np.uint64(63))
        word = (bit >> np.uint64(6)) % np.uint64(WORDS)
        for w in range(WORDS):
            out[full, w] = np.bitwise_xor.reduceat(np.where(word == np.uint64(w), one, np.uint64(0)), first)
    return out


def part_keys(h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of keys of every set): one for each part in each band of the set.  A set stands in the
    band of its size and in the next one, too, if a linked set may be there."""
    wide = max(WIDE, 1.01 * 100 / percent)                               # linked sets are at most one band apart
    band = np.floor(np.log(np.maximum(size, 1)) / math.log(wide) + 1e-9).astype(np.int64)
    again = np.ceil(size * 100 / percent) >= np.floor(wide ** (band + 1))
    owner = np.r_[np.flatnonzero(size), np.flatnonzero((size > 0) & again)]
    late = np.r_[np.zeros(np.count_nonzero(size), np.int64), np.ones(len(owner) - np.count_nonzero(size), np.int64)]
    order = np.lexsort((late, owner))
    owner, late = owner[order], late[order]
    at = band[owner] + late                                              # band of every (set, band)
    largest = np.ceil(wide ** (at + 1)).astype(np.int64)
    parts = 2 * largest * (100 - percent) // (100 + percent) + 1
    first = (np.cumsum(size) - size)[owner]
    n = size[owner]
    which = np.repeat(np.arange(len(owner)), n)                          # tokens of every (set, band)
    token = h[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(which))]
    start = np.cumsum(parts) - parts
    slot = start[which] + (mix64(token) % parts[which].astype(np.uint64)).astype(np.int64)
    by_slot = np.argsort(slot, kind="stable")
    slot, content = slot[by_slot], mix64(token ^ np.uint64(0x94D049BB133111EB))[by_slot]
    keys = np.zeros(int(parts.sum()), np.uint64)
    if len(slot):
        cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        with np.errstate(over="ignore"):
            keys[slot[cut]] = np.add.reduceat(content, cut)
    inner = np.arange(len(keys)) - np.repeat(start, parts)
    place = mix64((np.repeat(at, parts) << 40 | inner).astype(np.uint64))
    return mix64(keys ^ place), np.bincount(owner, weights=parts, minlength=len(size)).astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# --------------------------------------------------------------------------
# 1-2. classes and prefixes
# --------------------------------------------------------------------------

def lists_of(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), signed(values))


def named_sets(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, sketch, parts): size, name, sketch and part keys of the set of every text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                _, h, n = shingle_sets(part.column(1), shingle)
                s1, s2 = names(h, n)
                sketch = lists_of(parity_sketches(h, n).ravel(), np.full(len(n), WORDS))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), signed(s1), signed(s2), sketch, lists_of(*part_keys(h, n, percent))],
                                                 ["doc_id", "n", "s1", "s2", "sketch", "parts"])

    return rows.mapInArrow(task, "doc_id long, n long, s1 long, s2 long, sketch array<long>, parts array<long>")


def company(sets: DataFrame) -> DataFrame:
    """(s1) of the sets that share a part with another one."""
    # The filter that the join below implies, stated here so that both uses read one shuffle.
    parts = sets.select("s1", F.explode("parts").alias("part")).where("part is not null and s1 is not null").repartition("part")
    shared = parts.groupBy("part").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("part")
    return parts.join(shared.hint("shuffle_hash"), "part", "left_semi").select("s1").distinct()


def set_tokens(rows: DataFrame, shingle: int) -> DataFrame:
    """(token, s1): the tokens of the sets; copies met in one slice count once."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                doc, h, n = shingle_sets(part.column(1), shingle)
                s1, _ = names(h, n)
                once = np.zeros(len(n), bool)
                once[np.unique(s1, return_index=True)[1]] = True
                mine = once[doc]
                yield pa.RecordBatch.from_arrays([signed(h[mine]), signed(s1[doc[mine]])], ["token", "s1"])

    return rows.mapInArrow(task, "token long, s1 long")


def prefix_length(n, percent: int):
    return n - F.ceil(F.lit(percent) * n / F.lit(100)) + 1


def prefix_places(rows: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, n, token, pos): the tokens in the prefixes of the classes (node, n, s1) that other sets hold, too."""
    # The filter that the joins below imply, stated here so that both uses read one shuffle.
    bits = bits_for(classes.count())
    held = key_filter(classes.select(F.xxhash64("doc_id")), bits)
    tokens = set_tokens(rows.where(may_hold(held, F.xxhash64("doc_id"), bits)), shingle).where("token is not null and s1 is not null").repartition("token")
    several = tokens.groupBy("token").agg(F.min("s1").alias("low"), F.max("s1").alias("high"), F.count("*").alias("k")).where("low <> high")
    back = tokens.join(several.select("token", "k").hint("shuffle_hash"), "token").select("s1", "token", "k")
    mine = Window.partitionBy("s1")
    ranked = back.withColumn("i", F.row_number().over(mine.orderBy("k", "token")) - 1).withColumn("r", F.count("*").over(mine))
    placed = ranked.join(classes.select("s1", "node", "n"), "s1").withColumn("pos", F.col("n") - F.col("r") + F.col("i"))
    return placed.where(F.col("pos") < prefix_length(F.col("n"), percent)).select("node", "n", "token", "pos", "r")


def salted(small: DataFrame) -> DataFrame:
    """Rows of a join's one-row-per-key side, a copy for every salt."""
    return small.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))


def salt(c: str):
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("salt")


def token_lists(places: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(token, band, gid, pos): lists of several places.  A token's places by size band, and every group of
    several members as a list of its own (band -1)."""
    width = math.log(100 / percent) * (1 + 1e-9)             # a ratio of exactly percent / 100 stays below one band
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")       # sizes within the ratio are at most one band apart
    leads = groups.select("gid").withColumnRenamed("gid", "node")
    banded = places.join(leads, "node", "left_semi").select(F.col("node").alias("gid"), "token", "pos", F.explode(F.array(band, band + 1)).alias("band"))
    several = banded.groupBy("token", "band").agg(F.count("*").alias("k")).where("k > 1").select("token", "band")
    shared = banded.select("token", "band", "gid", "pos", salt("gid")).join(salted(several), ["token", "band", "salt"]).drop("salt")
    own = groups.where("k > 1").select(F.col("gid").alias("token"), F.lit(-1).alias("band"), "gid", F.lit(0).cast("long").alias("pos"))
    return shared.union(own)


def overlap(nx, ny, percent: int):
    """Shared tokens that sets of these sizes need."""
    return F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent))


def alike(nx, ny, percent: int):
    return F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent


def possible(percent: int):
    """May the sets of two places x and y of a token reach the overlap, if it is their first shared one?"""
    nx, ny = F.col("x.n"), F.col("y.n")
    left = F.least(nx - F.col("x.pos"), ny - F.col("y.pos"))
    return alike(nx, ny, percent) & (left >= overlap(nx, ny, percent))


def close(nx, ny, x, y, percent: int):
    """Do the sketches x and y differ in no more bits than sets of these sizes that link may differ in tokens?"""
    differ = reduce(add, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(WORDS)])
    return alike(nx, ny, percent) & (differ <= nx + ny - F.lit(2) * overlap(nx, ny, percent))


# --------------------------------------------------------------------------
# 4. verification
# --------------------------------------------------------------------------

def whole_sets(rows: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(node, items): the sets of the needed classes (node, doc_id, s1, s2), one text of each."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                _, h, n = shingle_sets(part.column(1), shingle)
                s1, s2 = names(h, n)
                mine = (part.column(2).to_numpy() == s1.view(np.int64)) & (part.column(3).to_numpy() == s2.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lists_of(h, n)], ["node", "items"]).filter(pa.array(mine))

    bits = bits_for(needed.count())
    held = key_filter(needed.select(F.xxhash64("doc_id")), bits)         # texts of no candidate meet no shuffle
    texts = rows.where(may_hold(held, F.xxhash64("doc_id"), bits)).join(needed, "doc_id").select("node", "text", "s1", "s2")
    return texts.mapInArrow(task, "node long, items array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, copies) that link.  ``b`` may be the centre of a large star: its set goes out in ``copies`` copies."""
    p = pairs.select("a", "b", "copies", F.pmod(F.xxhash64("a"), F.col("copies")).alias("copy"))
    centres = p.select("b", "copies").distinct().join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    centres = centres.select("b", "copies", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    met = p.join(centres, ["b", "copies", "copy"]).select("a", "b", "y")
    both = met.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    sized = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("common"))
    return sized.where(F.col("common") * 100 >= (F.col("nx") + F.col("ny") - F.col("common")) * percent).select("a", "b")


LIST = ["token", "band"]


def stars(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, copies): members of every list of several components against one of them."""
    facts = lists.groupBy(*LIST).agg(F.count("*").alias("k"), F.min("comp").alias("low"), F.max("comp").alias("high"),
                                     F.min(F.struct("turn", "rep", "comp", "n", "sketch")).alias("c")).where("low <> high")
    centre = facts.select(*LIST, F.col("c.rep").alias("b"), F.col("c.comp").alias("centre_comp"), F.col("c.n").alias("m"),
                          F.col("c.sketch").alias("centre_sketch"), F.ceil(F.col("k") / F.lit(STAR)).alias("copies"))
    return lists.select(*LIST, "rep", "comp", "n", "sketch", salt("rep")).join(salted(centre), [*LIST, "salt"]) \
        .where((F.col("comp") != F.col("centre_comp")) & close(F.col("n"), F.col("m"), F.col("sketch"), F.col("centre_sketch"), percent)) \
        .select(F.col("rep").alias("a"), "b", "copies")


def outside(lists: DataFrame) -> DataFrame:
    """Members that are not in the main component of their list; lists of one component have none."""
    sizes = lists.groupBy(*LIST, "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy(*LIST).agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    return lists.select("*", salt("rep")).join(salted(main.select(*LIST, F.col("top.comp").alias("main"))), [*LIST, "salt"]) \
        .where("comp <> main").drop("salt", "main")


def remaining(lists: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b, copies): all candidates of different components, expanded to the members of their groups."""
    slim = lists.select(*LIST, "gid", "pos", "n", "comp", "rep", F.when(F.col("k") == 1, F.col("sketch")).alias("sketch"))
    near = F.coalesce(close(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"), percent), F.lit(True))     # parts of one member
    met = outside(slim).alias("x").join(slim.alias("y"), LIST).where("x.comp <> y.comp").where(possible(percent) & near).select(
        F.col("x.gid").alias("gx"), F.col("x.comp").alias("cx"), F.col("y.gid").alias("gy"), F.col("y.comp").alias("cy")).distinct()
    a = members.select(F.col("gid").alias("gx"), F.col("comp").alias("cx"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = members.select(F.col("gid").alias("gy"), F.col("comp").alias("cy"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return met.join(a, ["gx", "cx"]).join(b, ["gy", "cy"]).where(close(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"), percent)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).cast("long").alias("copies"))


def links(rows: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, comp) of all classes (node, doc_id, n, s1, s2, sketch) that link with another one."""
    places = written(prefix_places(rows, classes, shingle, percent), "prefix-places")
    prefix = places.groupBy("node").agg(F.min("n").alias("n"), F.min("r").alias("r"), F.bit_xor(F.xxhash64("token", "pos")).alias("g1"),
                                        F.bit_xor(F.xxhash64("pos", "token")).alias("g2"))
    named = written(prefix, "prefix-names")
    groups = written(named.groupBy("n", "r", "g1", "g2").agg(F.min("node").alias("gid"), F.count("*").alias("k")), "prefix-groups")
    lists = written(token_lists(places, groups, percent), "prefix-lists")
    # Members of the groups that stand in a list.
    listed = salted(groups.join(lists.select("gid").distinct(), "gid", "left_semi").select("gid", "n", "r", "g1", "g2"))
    members = named.select("node", "n", "r", "g1", "g2", salt("node")).join(listed, ["n", "r", "g1", "g2", "salt"]).select("gid", "node")
    members = written(classes.select("node", "n", "doc_id", "s1", "s2", "sketch").join(members, "node"), "prefix-members")
    comp = members.select("node", F.col("node").alias("comp")).limit(0)
    found, sets, turn = None, None, 0
    while True:
        labelled = members.join(comp, "node", "left").select("gid", "node", "n", "sketch", F.coalesce("comp", "node").alias("comp"))
        # One row for each component in a group; other centres every time.
        parts = labelled.groupBy("gid", "comp").agg(F.min(F.struct("node", "n", "sketch")).alias("rep"), F.count("*").alias("k")) \
            .select("gid", "comp", "k", F.col("rep.node").alias("rep"), "rep.n", "rep.sketch")
        entries = written(lists.join(parts, "gid").withColumn("turn", F.xxhash64(F.lit(turn), "rep") if turn else F.lit(0).cast("long")),
                          "prefix-entries")
        pairs = written((stars(entries, percent) if turn < STARS else remaining(entries, labelled, percent))
                        .groupBy("a", "b").agg(F.max("copies").alias("copies")), "set-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        if sets is not None:
            ends = ends.join(sets.select("node"), "node", "left_anti")
        needed = written(members.join(ends, "node", "left_semi").select("node", "doc_id", "s1", "s2"), "needed-sets")
        more = written(whole_sets(rows, needed, shingle), "shingle-sets")
        sets = more if sets is None else sets.union(more)
        new = written(verified(pairs, sets, percent), "set-links")
        none = new.isEmpty()
        if not none:
            found = new if found is None else found.union(new)
            comp = written(components(found).select("node", F.col("component").alias("comp")), "set-components")
        if turn == STARS:
            return comp
        turn = STARS if none else turn + 1               # stars without a link: expand the rest


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, component_id) for every row of ``docs``."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    table = written(named_sets(rows, shingle, percent), "named-sets")
    usable = table.where("n > 0 and doc_id is not null")
    equal = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch"),
                                           F.count("*").alias("rows"))
    classes = written(equal.withColumn("node", F.monotonically_increasing_id()), "set-classes")
    near = written(classes.join(company(usable), "s1", "left_semi"), "set-candidates")
    comp = links(rows, near, shingle, percent)
    low = classes.select("node", "s1", "s2", "doc_id", "rows").join(comp, "node", "left")
    linked = low.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    several = low.where("comp is not null").join(linked, "comp").select("s1", "s2", "component_id") \
        .union(low.where("comp is null and rows > 1").select("s1", "s2", F.col("doc_id").alias("component_id")))
    out = table.select("doc_id", "n", "s1", "s2", salt("doc_id")).join(salted(several), ["s1", "s2", "salt"], "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n", own.alias("component_id"))


def op13_prefixjoin(spark, sf_dir: str) -> DataFrame:
    """Contract columns: 3-word shingles, Jaccard similarity of 0.9 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, shingle=3, percent=90).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
