"""Sets of documents as bitmaps: 64 documents in a long, rows (keys, block, bits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, block, bits of rows (keys, doc_id); document d is bit d mod 64 of block d div 64. Rows may repeat."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("doc_id", F.lit(64)).cast("int"))
    return rows.where("doc_id is not null").select(*keys, F.floor(F.col("doc_id") / 64).cast("long").alias("block"), bit.alias("bit")).groupBy(*keys, "block").agg(F.bit_or("bit").alias("bits"))


def unpack(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, doc_id of rows (keys, block, bits)."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(F.lit(1)) == 1)
    return rows.select(*keys, "block", F.explode(places).alias("place_")).select(*keys, (F.col("block") * 64 + F.col("place_")).alias("doc_id"))


def both(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def without(a: Column, b: Column) -> Column:
    """a and not b."""
    return a.bitwiseAND(F.bitwise_not(b))


def size(a: Column) -> Column:
    """Number of documents; 0 for null."""
    return F.coalesce(F.bit_count(a), F.lit(0)).cast("long")
