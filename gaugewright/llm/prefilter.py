"""Filters of bounded size that keep rows without any counterpart out of a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for a key, and all bits at least and at most: 64 MB are broadcast at most, whatever the number of keys. With more keys a filter lets more rows pass, which costs time only.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 29


@dataclass
class KeyFilter:
    """Bitmaps of 32,768 bits by number. Keys may lie in ``parts`` parts (a power of two), each with as many bits of its own."""

    bitmaps: DataFrame
    bits: int
    parts: int
    part: Callable[[Column], Column] | None

    def bit(self, key: Column) -> Column:
        own = F.pmod(F.xxhash64(key), F.lit(self.bits // self.parts))
        return own if self.part is None else self.part(key).cast("long") * (self.bits // self.parts) + own

    def held(self, bitmap: Column, key: Column) -> Column:
        at = F.bitmap_bit_position(self.bit(key))
        byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) > 0

    def marked(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``_gw_held``: false only for keys that are none of the filter's. Its size is bounded, so it is broadcast."""
        bucket = F.bitmap_bucket_number(self.bit(rows[column]))
        joined = rows.join(F.broadcast(self.bitmaps), bucket == F.col("_gw_bucket"), "left")
        return joined.withColumn("_gw_held", F.coalesce(self.held(F.col("_gw_bitmap"), rows[column]), F.lit(False))).drop("_gw_bucket", "_gw_bitmap")


def build_filter(keys: DataFrame, column: str, *, parts: int = 1, part: Callable[[Column], Column] | None = None) -> KeyFilter:
    """A filter of the keys in ``column`` of ``keys`` (a written table, which is counted)."""
    bits = max(LEAST_BITS * parts, min(MOST_BITS, 1 << (BITS_EACH * max(1, keys.count()) - 1).bit_length()))
    made = KeyFilter(keys, bits, parts, part)
    bit = made.bit(F.col(column))
    made.bitmaps = keys.groupBy(F.bitmap_bucket_number(bit).alias("_gw_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_gw_bitmap"))
    return made


def passing(rows: DataFrame, held: KeyFilter, column: str) -> DataFrame:
    """Rows whose key the filter may hold.

    An exact inner join must follow. (The optimizer moves a semi join below this one, which then saves nothing.)
    """
    return held.marked(rows, column).where("_gw_held").drop("_gw_held")


def without(rows: DataFrame, keys: DataFrame, column: str, *, further: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """``rows`` but for those whose key is in the first column of ``keys`` (a written table); only rows that the filter holds are shuffled.

    ``further``: expressions over ``rows`` that must also equal columns of ``keys``. ``where``: only rows of which it is true can go. A null key equals null.
    """
    name, *_ = keys.columns
    marked = build_filter(keys, name).marked(rows, column)
    held = F.col("_gw_held") & F.coalesce(F.lit(True) if where is None else where, F.lit(False))
    own = [rows[c] for c in rows.columns]
    sure = marked.where(~held).select(*own)
    maybe = marked.where(held).select(*own, *[e.alias(f"_gw_{k}") for k, e in (further or {}).items()])
    gone = keys.select(F.col(name).alias("_gw_key"), *[F.col(k).alias(f"_gw_key_{k}") for k in further or ()], F.lit(True).alias("_gw_gone")).distinct()
    same = maybe[column].eqNullSafe(F.col("_gw_key"))
    for k in further or ():
        same = same & (F.col(f"_gw_{k}") == F.col(f"_gw_key_{k}"))
    rest = maybe.join(gone, same, "left").where(F.col("_gw_gone").isNull()).select(*[maybe[c] for c in rows.columns])
    return sure.unionByName(rest)
