"""Centroid clustering of fixed-point vectors by bit planes and popcounts.

A vector has 64 integer components.  Bit b of all 64 components together is one
64-bit word, its *bit plane* b; the highest plane is the sign and weighs
``-2**(B-1)`` (two's complement), every other one ``2**b``.  With the planes of a
vector U and of a centroid C

    u . c  =  sum over a, b of  weight(a) * weight(b) * popcount(U_a & C_b)

exactly, and ``|u - c|^2 = |u|^2 + |c|^2 - 2 u.c``.  A vector of B planes takes
8 B bytes, however the components are stored in the input.

1. **Packing.**  One pass over the input writes (id, planes, |u|^2).  A batch uses
   as many planes as its largest component needs; planes are sign-extended when
   batches meet.
2. **Rounds.**  Every task assigns its vectors with AND and popcount and returns,
   for each centroid, the number of vectors and the component sums (plane by
   plane: counts of set bits times the plane's weight).  Only these k rows of a
   task are shuffled and added up; k centroids reach the driver.
3. **Result.**  A last pass assigns once more; the k inertias are joined back.

The centroids are k x 64 numbers whatever the input size, so they go out with
the task functions.  A vector that occurs very often is no hot key: vectors are
never grouped.

Defined results: vectors that are null, have another length than 64, or hold a
null or non-finite entry are left out; repeated rows count and are returned as
often as they occur; start vectors with equal hashes (repeated ids) are ordered by
their planes, rows without an id come last; fewer than k vectors give fewer
centroids, an empty table gives no rows; columns other than ``id_col`` and
``vector_col`` are ignored.  Components beyond 2**27 in fixed point raise an
error, since squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .vectors import batches_of, fixed_point, matrix, vector_rows

WIDTH = 64             # components of a vector, one bit of a plane each
LARGEST = 1 << 27      # of a component, so that 64 squared differences fit in 63 bits


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) uint64: plane b holds bit b of all components of a row."""
    out = np.empty((len(x), bits), np.uint64)
    for b in range(bits):
        on = ((x >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def bits_needed(x: np.ndarray) -> int:
    """Planes of a two's complement form that holds every component of ``x``."""
    if not x.size:
        return 1
    return max(int(x.max()).bit_length(), int(~x.min()).bit_length() if x.min() < 0 else 0) + 1


def weights(bits: int) -> np.ndarray:
    """What a set bit of each plane is worth."""
    w = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def dots(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact dot products (n, k) of vectors and centroids given as planes."""
    wu, wc = weights(u.shape[1]), weights(c.shape[1])
    out = np.zeros((len(u), len(c)), np.int64)
    for a in range(u.shape[1]):
        for b in range(c.shape[1]):
            out += np.bitwise_count(u[:, a, None] & c[None, :, b]).astype(np.int64) * (wu[a] * wc[b])
    return out


def distances(u: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, k) of packed vectors to integer centroids."""
    c = planes(centroids, bits_needed(centroids))
    return norms[:, None] + (centroids * centroids).sum(axis=1)[None, :] - 2 * dots(u, c)


def plane_sums(u: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """(k, 64) component sums of the packed vectors of each cluster."""
    out = np.zeros((k, WIDTH), np.int64)
    w = weights(u.shape[1])
    for c in np.unique(cluster):
        mine = np.ascontiguousarray(u[cluster == c])
        for b in range(u.shape[1]):
            ones = np.unpackbits(mine[:, b].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[c] += ones.sum(axis=0, dtype=np.int64) * w[b]
    return out


def packed(column: pa.Array) -> np.ndarray:
    """The planes column of a batch as (n, bits); rows with fewer planes are sign-extended."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    bits = int(size.max())
    if (size == bits).all():
        return flat.reshape(-1, bits)
    first = np.cumsum(size) - size
    return flat[first[:, None] + np.minimum(np.arange(bits)[None, :], size[:, None] - 1)]


def pack(table: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, norm, planes) of every usable vector."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            rows, values = matrix(batch.column(1), WIDTH)
            if not len(rows):
                continue
            x = fixed_point(values, scale)
            if max(int(x.max()), -int(x.min())) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} in fixed point")
            p = planes(x, bits_needed(x))
            at = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array((x * x).sum(axis=1)),
                                              pa.ListArray.from_arrays(at, pa.array(p.ravel().view(np.int64)))],
                                             ["id", "norm", "planes"])

    return vector_rows(table, id_col, vector_col).mapInArrow(task, "id long, norm long, planes array<long>")


def components_of(row_planes: list[int]) -> list[int]:
    """The integer components that a list of planes stands for."""
    out = [0] * WIDTH
    for b, word in enumerate(row_planes):
        worth = -(1 << b) if b == len(row_planes) - 1 else 1 << b
        out = [v + (worth if word >> j & 1 else 0) for j, v in enumerate(out)]
    return out


def start_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``1:<id>``; equal hashes (repeated ids) go by their planes."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    sign = F.array_repeat(F.element_at("planes", -1), F.lit(WIDTH) - F.size("planes"))
    full = F.concat("planes", sign)                                      # the same for a vector whatever its batch
    low = vectors.select(order.alias("h"), full.alias("full")).orderBy(F.col("h").asc_nulls_last(), "full").limit(k)
    return np.array([components_of(r["full"]) for r in low.collect()], np.int64).reshape(-1, WIDTH)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of every vector, the smaller number on ties."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            d = distances(packed(batch.column(2)), batch.column(1).to_numpy(), centroids)
            best = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)),
                                              pa.array(d[np.arange(len(d)), best])], ["id", "cluster", "distance"])

    return vectors.mapInArrow(task, "id long, cluster int, distance long")


def move(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: centroids replaced by floor(sum / count) of their vectors; empty ones stay."""
    k = len(centroids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, WIDTH), object), np.zeros(k, np.int64)
        for batch in batches_of(batches):
            u = packed(batch.column(2))
            best = distances(u, batch.column(1).to_numpy(), centroids).argmin(axis=1)
            sums = sums + plane_sums(u, best, k)
            count += np.bincount(best, minlength=k)
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(found, WIDTH).astype(np.int32)), pa.array(np.tile(np.arange(WIDTH), len(found)).astype(np.int32)),
            pa.array([int(v) for c in found for v in sums[c]], pa.decimal128(38, 0)), pa.array(np.repeat(count[found], WIDTH))],
            ["cluster", "at", "total", "n"])

    part = vectors.mapInArrow(task, "cluster int, at int, total decimal(38,0), n long")
    out = centroids.copy()
    for r in part.groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():      # k x 64 rows
        out[r["cluster"], r["at"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, id_col: str = "vec_id",
            vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every usable vector after ``rounds`` rounds, final centroids)."""
    vectors = written(pack(table, scale, id_col, vector_col), "planes")
    centroids = start_centroids(vectors, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = move(vectors, centroids)
    return written(assign(vectors, centroids), "assigned"), centroids


def op11_bitplanes(spark, sf_dir: str) -> DataFrame:
    """Contract columns: 16 centroids, three rounds, components in 64ths."""
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = assigned.groupBy("cluster").agg(total.alias("s")).collect()                                               # 16 rows at most
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    everything = sum(int(r["s"]) for r in sums)
    facts = spark.createDataFrame([(r["cluster"], int(r["s"]), everything, names[r["cluster"]]) for r in sums],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
