"""Sharding by jump consistent hashing, with DataFrame expressions only.

The published algorithm (a 64-bit linear congruential generator whose upper bits give the next jump)
needs no ring table: the identifier and the number of shards decide, and one more shard takes rows
only into itself. Its loop is an ``aggregate`` over a constant sequence; 64-bit products are made of
smaller ones, since overflow is an error under ANSI rules.

Slots number the rows of a shard without gaps. No task sees a whole shard: rows fall into
(shard, part) groups of about ``group_rows`` rows by further bits of the generator, groups are counted,
and a row's slot is its group's offset plus its place in the group.

Cases:

* a null text has no bytes (size 8, CRC 0), like an empty one
* a null identifier goes where identifier 0 goes; its slots come last in its group
* rows repeated with one identifier share a shard and get different slots
* further columns, of whatever name, are not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.session import materialize

#: Fixed value of the published generator.
MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF
C_HIGH, C_LOW = MULTIPLIER >> 32, MULTIPLIER & MASK


def _times(word: Column, small: int) -> tuple[Column, Column]:
    """The lower 32 bits of word * small, and what goes beyond, for values under 2**32."""
    low = word.bitwiseAND(0xFFFF) * F.lit(small)
    high = F.shiftright(word, 16) * F.lit(small)
    whole = low + high.bitwiseAND(0xFFFF) * F.lit(65536)
    return whole.bitwiseAND(MASK), F.shiftright(whole, 32) + F.shiftright(high, 16)


def next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64, of a key in two halves."""
    base, carry = _times(low, C_LOW)
    cross, _ = _times(high, C_LOW)
    up = carry + (low * F.lit(C_HIGH)).bitwiseAND(MASK) + cross
    one = base + F.lit(1)
    return (up + F.shiftright(one, 32)).bitwiseAND(MASK), one.bitwiseAND(MASK)


def halves(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(MASK)


def jump_hash(key: Column, shards: int) -> Column:
    """A struct with ``shard``, of ``shards``, and ``grown``, of one more."""
    high, low = halves(key)
    fields = ("high", "low", "jump", "shard", "grown")
    zero = F.lit(0).cast("long")
    start = F.struct(*[c.alias(n) for c, n in zip((high, low, zero, zero, zero), fields, strict=True)])

    def step(at: Column, _: Column) -> Column:
        up, down = next_state(at["high"], at["low"])
        jump = F.floor((at["jump"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(up, 1) + F.lit(1)).cast("double"))).cast("long")
        shard = F.when(at["jump"] < shards, at["jump"]).otherwise(at["shard"])
        moved = F.struct(*[c.alias(n) for c, n in zip((up, down, jump, shard, at["jump"]), fields, strict=True)])
        return F.when(at["jump"] <= shards, moved).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)


def assign_shards(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: identifier, ``size``, ``text_crc32``, ``law`` (key), ``shard``, ``slot``, ``grown_shard``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.octet_length(text).cast("long") + 8).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        jump_hash(F.col(id_col), shards).alias("_jump"),
        F.shiftright(next_state(*halves(F.col(id_col)))[0], 1).alias("_spread"),
    ).select("_id", "_size", "_crc", "_spread", F.col("_jump.shard").alias("_shard"), F.col("_jump.grown").alias("_grown"))
    slim = materialize(slim, "shard-rows")
    parts = max(1, -(-slim.count() // (shards * group_rows)))
    rows = slim.withColumn("_part", F.pmod(F.col("_spread"), F.lit(parts)))
    groups = rows.groupBy("_shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("_shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = Window.partitionBy("_shard", "_part").orderBy(F.col("_id").asc_nulls_last(), "_crc", "_size")
    placed = rows.withColumn("_place", F.row_number().over(place) - 1)
    return placed.join(offsets, ["_shard", "_part"]).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_offset") + F.col("_place")).cast("long").alias("slot"),
        F.col("_grown").cast("int").alias("grown_shard"),
    )
