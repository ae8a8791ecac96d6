"""Filter of key hashes (one hash function of a Bloom filter) from Spark's bitmap aggregates.

A set of hashes becomes an array of bitmaps of 32768 bits, at most ``MAX_BITS`` bits together (8 MB).
Used as a scalar subquery it goes out once per query and is tested inside the scan's stage, so rows
that cannot be in the set never meet a shuffle.  A row that passes may still be none of the set:
whoever uses the filter joins exactly afterwards.  Beyond ``MAX_BITS / 16`` keys it lets more rows through, and
in the end all of them: slower, never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP = 1 << 15           # bits of one bitmap of Spark's bitmap functions
MAX_BITS = 1 << 26
BITS_PER_KEY = 16


def bits_for(n_keys: int) -> int:
    """Filter size: a power of two, about 16 bits a key, 4 KB to 8 MB."""
    return min(MAX_BITS, max(BITMAP, 1 << (BITS_PER_KEY * max(n_keys, 1) - 1).bit_length()))


def _at(h: Column, bits: int) -> Column:
    return F.pmod(h, F.lit(bits))


def key_filter(hashes: DataFrame, bits: int) -> Column:
    """Scalar subquery: the filter of the 64-bit hashes in the only column of ``hashes``."""
    at = _at(F.col(hashes.columns[0]), bits)
    parts = hashes.select(F.shiftright(at, 15).cast("int").alias("part"), (at % BITMAP).alias("bit")) \
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    by_part = F.map_from_entries(F.collect_list(F.struct("part", "bitmap")))          # 8 MB at most
    return parts.agg(by_part.alias("parts")).select(F.transform(
        F.sequence(F.lit(0), F.lit(bits // BITMAP - 1)), lambda i: F.try_element_at("parts", i)).alias("filter")).scalar()


def may_hold(filter_: Column, h: Column, bits: int) -> Column:
    """Whether the hash ``h`` may be in the filter (false: certainly not)."""
    at = _at(h, bits)
    bit = (at % BITMAP).cast("int")
    byte = F.substring(F.get(filter_, F.shiftright(at, 15).cast("int")), F.shiftright(bit, 3) + 1, F.lit(1))
    worth = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), bit % 8 + 1)
    return F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(worth) > 0, F.lit(False))
