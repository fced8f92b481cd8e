"""A bitmap of key hashes, broadcast to drop rows without a partner before a shuffle.

Its size is fixed: ``BITS`` bits in at most ``BITS`` / 64 rows of two numbers. Keys that share a bit pass as well, and
with very many keys nearly all pass; the join that follows decides, so results never depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scintlake.session import stage

BITS = 1 << 24


def _place(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def bitmap(df: DataFrame, *keys: Column) -> DataFrame:
    """(word, bits) of the keys of ``df``."""
    at = df.select(_place(list(keys)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    return stage(at.select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "bitmap")


def marked(df: DataFrame, held: DataFrame, *keys: Column) -> DataFrame:
    """``df`` with ``maybe``: false only for rows whose key isn't in the bitmap."""
    own = df.columns
    at = df.withColumn("_at", _place(list(keys)))
    joined = at.join(F.broadcast(held.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))), F.shiftright("_at", 6) == F.col("_word"), "left")
    bit = F.call_function("shiftright", F.col("_bits"), F.col("_at").bitwiseAND(63).cast("int")).bitwiseAND(1)
    return joined.select(*own, (F.coalesce(bit, F.lit(0)) == 1).alias("maybe"))


def held_rows(df: DataFrame, held: DataFrame, *keys: Column) -> DataFrame:
    return marked(df, held, *keys).filter("maybe").drop("maybe")
