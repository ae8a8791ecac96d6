"""Original -> fake mapping as a table (F1-F4, F6).

``mapping`` columns: ``pii_type, norm_key, surface, replacement, id``.
``(pii_type, norm_key)`` is unique; ``replacement`` is unique except for
``[REDACTED]``.  JSON keeps no ids: a loaded row's id is read back from its fake
(:func:`.surrogates.surrogate_id`), null for a fake that is not one of ours.

New keys get dense ids per type: a key hashes to one of ``buckets`` buckets, is
ranked by ``norm_key`` inside it, and the bucket counts give each bucket its
offset.  Ids go on above the largest one in the mapping, so a later run never
changes old rows and may use another bucket count.  No global sort; the same
input always gives the same ids.

A candidate fake is refused if the mapping already uses it, or if it equals,
contains or is part of a value that was observed as an original.  Refused keys
take the next ids in another round; nothing is capped.  Observed values that no
fake of a type avoids (``le`` in ``@example.net``) refuse none of its fakes, or no
key would ever get one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vocab as V
from ..functions.text import collapse_ws, normalize_key
from ..session import written
from .findings import distinct_values, values_inside, values_within
from .free_ids import MOST, Candidates, part_strings, passed_over
from .surrogates import surrogate_id, surrogate_of

MAPPING_SCHEMA = "pii_type string, norm_key string, surface string, replacement string, id bigint"
DEFAULT_BUCKETS = 1024      # window groups per type for ranking new keys; raise it with the number of distinct keys


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING_SCHEMA)


def bucket_of(pii_type: Column, norm_key: Column, buckets: int) -> Column:
    """Stable hash bucket; md5 so that any SQL engine can recompute it."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\u0001", pii_type, norm_key)), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets)).cast("int")


def finding_keys(fd: DataFrame, order: Column) -> DataFrame:
    """One row per ``(pii_type, norm_key)`` with the first-seen surface form.

    ``order`` ranks occurrences (first = smallest).  Blank keys are skipped.
    """
    return (
        fd.select("pii_type", normalize_key(F.col("value")).alias("norm_key"),
                  collapse_ws(F.col("value")).alias("surface"), order.alias("_order"))
        .groupBy("pii_type", "norm_key")
        .agg(F.min_by("surface", "_order").alias("surface"))
    )


def new_keys(keys: DataFrame, mapping: DataFrame) -> DataFrame:
    return keys.join(mapping.select("pii_type", "norm_key"), ["pii_type", "norm_key"], "left_anti")


def dense_ids(keys: DataFrame, buckets: int) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... per type in the order of (bucket, norm_key)."""
    keyed = keys.withColumn("bucket", bucket_of(F.col("pii_type"), F.col("norm_key"), buckets))
    counts = keyed.groupBy("pii_type", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pii_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pii_type", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    w = Window.partitionBy("pii_type", "bucket").orderBy("norm_key")
    return keyed.withColumn("in_bucket", F.row_number().over(w) - 1).join(offsets, ["pii_type", "bucket"]) \
        .withColumn("rank", F.col("offset") + F.col("in_bucket")).drop("bucket", "in_bucket", "offset")


def with_ids(mapping: DataFrame) -> DataFrame:
    """``mapping`` with the ids that its fakes stand for where they are null."""
    if mapping.where("id is null").isEmpty():
        return mapping
    return mapping.withColumn("id", F.coalesce("id", surrogate_id(F.col("pii_type"), F.col("replacement"))))


AHEAD = 1024               # fakes judged together at least; eight times as many each time they run out
DRY = 1 << 17              # so many clean fakes without a free one: the type has none
LOCAL = 1_000_000          # keys whose places in the queue the driver counts out; more of them are placed round by round
BLOCK = 10_000             # places sent out in a row


class _Fakes:
    """The fakes that may be given: of each type the ids of clean parts, judged in windows."""

    def __init__(self, spark: SparkSession, types: list[str], observed: DataFrame, used: DataFrame | None):
        self.spark, self.observed, self.used = spark, observed, used
        parts = sorted(set().union(*map(part_strings, types)))
        # Two fixed lists of words and their substrings at most.
        held = values_inside(observed, self._table({"norm": parts}, "norm string")).distinct().collect() if parts else []
        inside: dict[str, set[str]] = {}
        for r in held:
            inside.setdefault(r["norm"], set()).add(r["fake"])
        self.passed = {t: passed_over(t, inside) for t in types}
        self.clean = {t: Candidates(t, {x for x in part_strings(t) if inside.get(x, set()) - self.passed[t]}) for t in types}
        self.lax: set[str] = set()

    def _table(self, columns: dict, schema: str) -> DataFrame:
        return self.spark.createDataFrame(pa.table(columns)).to(StructType.fromDDL(schema))

    def relax(self, pii_type: str) -> None:
        """No fake of this type avoids all observed values: it may hold them, but still equals and is part of none."""
        self.lax.add(pii_type)
        self.clean[pii_type] = Candidates(pii_type, set())

    def judged(self, windows: dict[str, tuple[int, int]]) -> DataFrame:
        """(pii_type, id, replacement, refused) of the candidates from ``lo`` up to ``hi`` of each type.
        ``refused``: the fake is in use or equals, contains or is part of an observed value."""
        none = self.spark.range(0).select(F.lit("").alias("pii_type"), "id", F.lit("").alias("replacement"))
        parts = [self.spark.range(lo, hi).select(F.lit(t).alias("pii_type"), i.alias("id"))
                 .withColumn("replacement", surrogate_of(t, F.col("id")))
                 for t, (a, b) in windows.items() for lo, hi, i in self.clean[t].ids(a, b)]
        offered = written(reduce(DataFrame.unionByName, parts or [none]).withColumn("norm", normalize_key(F.col("replacement"))), "offered")
        fakes = offered.select("norm")
        strict = offered.where(~F.col("pii_type").isin(*self.lax)) if self.lax else offered
        inside = values_inside(self.observed, strict.select("norm"))
        over = [(t, v) for t, vs in self.passed.items() if t in windows and t not in self.lax for v in vs]
        if over:
            types, values = map(list, zip(*over, strict=True))
            inside = inside.join(strict.select("norm", "pii_type"), "norm").join(
                F.broadcast(self._table({"pii_type": types, "fake": values}, "pii_type string, fake string")), ["pii_type", "fake"], "left_anti")
        like_observed = inside.select("norm").unionByName(values_within(fakes, self.observed)).distinct().withColumn("_like", F.lit(True))
        out, refused = offered.join(like_observed, "norm", "left"), F.coalesce("_like", F.lit(False))
        if self.used is not None:
            out = out.join(self.used.distinct().withColumn("_used", F.lit(True)), "replacement", "left")
            refused = refused | F.coalesce("_used", F.lit(False))
        return written(out.select("pii_type", "id", "replacement", refused.alias("refused")), "judged")


def _by_type(df: DataFrame, value: Column) -> dict[str, int]:
    """One number for each of the types."""
    return {r["pii_type"]: r["n"] for r in df.groupBy("pii_type").agg(value.alias("n")).collect() if r["n"] is not None}


def queue_places(n: int, start: int, free: np.ndarray) -> np.ndarray:
    """The ids that ``n`` keys in a queue get: key after key takes the next id from ``start`` on and, if that is none of
    the ``free`` ones, goes to the end of the queue."""
    out, left, at, used = np.empty(n, np.int64), np.arange(n), start, 0
    while left.size:
        at += (int(free[used]) - at) // left.size * left.size           # rounds of nothing but refused ids change no key
        end = int(np.searchsorted(free, at + left.size))
        hit = free[used:end] - at
        out[left[hit]] = free[used:end]
        left, at, used = np.delete(left, hit), at + left.size, end
    return out


def _place_all(left: DataFrame, many: dict[str, int], at: dict[str, int], fakes: _Fakes, buckets: int) -> DataFrame:
    """``left`` with their ids and fakes: the driver gets as many free ids as there are keys and counts out the places."""
    free = {t: np.empty(0, np.int64) for t in many}
    judged: list[DataFrame] = []
    to, dry, ahead = {t: fakes.clean[t].below(at[t]) for t in many}, dict.fromkeys(many, 0), AHEAD
    while want := {t: n - free[t].size for t, n in many.items() if free[t].size < n}:
        for t in want:
            if t not in fakes.lax and (dry[t] >= DRY or to[t] >= fakes.clean[t].count):
                fakes.relax(t)
                judged = [j.where(F.col("pii_type") != t) for j in judged]
                free[t], to[t], dry[t], want[t] = free[t][:0], fakes.clean[t].below(at[t]), 0, many[t]
        windows = {t: (to[t], min(to[t] + n + n // 8 + ahead, fakes.clean[t].count)) for t, n in want.items()}
        more = fakes.judged(windows)
        judged.append(more)
        got = more.where(~F.col("refused")).select("pii_type", "id").toArrow()
        ids, types = got["id"].to_numpy(), got["pii_type"].combine_chunks()
        for t, (lo, hi) in windows.items():
            new = np.sort(ids[pc.equal(types, t).to_numpy(zero_copy_only=False)])
            dry[t] = 0 if new.size else dry[t] + hi - lo
            free[t], to[t] = np.concatenate([free[t], new]), hi
        ahead *= 8
    blocks = [(t, i, ids[i:i + BLOCK]) for t, n in many.items() for ids in [queue_places(n, at[t], free[t])] for i in range(0, n, BLOCK)]
    types, firsts, ids = zip(*blocks, strict=True)
    places = left.sparkSession.createDataFrame(pa.table({"pii_type": types, "first": firsts, "ids": pa.array(ids, pa.list_(pa.int64()))})) \
        .select("pii_type", "first", F.posexplode("ids").alias("at", "id")).select("pii_type", (F.col("first") + F.col("at")).alias("rank"), "id")
    placed = dense_ids(left, buckets).join(places, ["pii_type", "rank"])
    return placed.join(reduce(DataFrame.unionByName, judged).drop("refused"), ["pii_type", "id"])


def assign_surrogates(new: DataFrame, mapping: DataFrame, buckets: int = DEFAULT_BUCKETS,
                      observed: DataFrame | None = None) -> DataFrame:
    """Give each new key a unique replacement; returns rows in mapping schema.
    ``observed``: ``norm_key`` of all values seen as originals.

    The keys of a type stand in a queue in their order.  In a round each one takes the next id, and those whose
    fake is refused go on to the next round.  Only ids whose fakes have clean parts (:mod:`.free_ids`) are judged, in
    windows that reach over many rounds, since every judgement reads all observed values.  Up to ``LOCAL`` keys
    are placed together, by as many free ids."""
    spark = new.sparkSession
    keys = written(new.select("pii_type", "norm_key", "surface"), "keys")
    known = F.col("pii_type").isin(*V.CATEGORIES)
    if observed is None:      # the new and the loaded keys
        observed = keys.select("norm_key").union(mapping.select("norm_key"))
    observed = distinct_values(observed.select(F.col("norm_key").alias("fake")), "observed")
    out = keys.where(~known).select("pii_type", "norm_key", "surface", F.lit(V.REDACTED).alias("replacement"),
                                    F.lit(None).cast("bigint").alias("id"))
    left = keys.where(known)
    many = _by_type(left, F.count("*"))
    if not many:
        return out
    loaded = not mapping.isEmpty()
    at = dict.fromkeys(many, 0) | (_by_type(with_ids(mapping).where(known), F.max("id") + 1) if loaded else {})
    fakes = _Fakes(spark, sorted(many), observed, mapping.select("replacement").where(F.col("replacement") != V.REDACTED) if loaded else None)
    for t, n in many.items():
        if fakes.clean[t].count - fakes.clean[t].below(at[t]) < 2 * n:
            fakes.relax(t)
    judged, until, ahead = None, {}, AHEAD
    while sum(many.values()) > LOCAL:
        windows = {t: (max(at[t], until.get(t, 0)), fakes.clean[t].below(at[t] + n) + ahead) for t, n in many.items() if at[t] + n > until.get(t, 0)}
        if windows:
            more = fakes.judged({t: (fakes.clean[t].below(lo), hi) for t, (lo, hi) in windows.items()})
            judged = more if judged is None else judged.unionByName(more)
            until |= {t: fakes.clean[t].id_of(hi) or MOST for t, (_, hi) in windows.items()}
            ahead *= 8
        first = F.coalesce(*[F.when(F.col("pii_type") == t, F.lit(at[t]).cast("long")) for t in many])
        ids = dense_ids(left, buckets).withColumn("id", first + F.col("rank")).drop("rank")
        placed = written(ids.join(judged, ["pii_type", "id"], "left"), "placed")         # ids of unclean parts were not judged
        refused = F.coalesce("refused", F.lit(True))
        out = out.unionByName(placed.where(~refused).select(*out.columns))
        left = placed.where(refused).select(*keys.columns)
        at = {t: i + many.get(t, 0) for t, i in at.items()}
        many = _by_type(left, F.count("*"))
        if many:
            here = F.coalesce(*[F.when(F.col("pii_type") == t, F.col("id") >= at[t]) for t in many])
            free = _by_type(judged.where(here & ~F.col("refused")), F.min("id"))
            for t, n in many.items():
                if t not in free and t not in fakes.lax and (until[t] == MOST or fakes.clean[t].below(until[t]) - fakes.clean[t].below(at[t]) >= DRY):
                    fakes.relax(t)
                    judged, until[t] = judged.where(F.col("pii_type") != t), at[t]
                at[t] += max(free.get(t, until[t]) - at[t], 0) // n * n
    if not many:
        return out
    return out.unionByName(written(_place_all(left, many, at, fakes, buckets), "placed").select(*out.columns))


def merge_mapping(mapping: DataFrame, new: DataFrame) -> DataFrame:
    return mapping.unionByName(new.select(*mapping.columns))
