"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soundpairs.functions.times import col
from soundpairs.session import settled

_SPREAD = 4096


def first_row(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key.

    ``row_number() = 1`` lets Catalyst put a group limit before the shuffle, so every
    task sends at most one row per key however many copies a key has.
    """
    ranked = Window.partitionBy(*keys).orderBy(*[col(o) for o in order])
    return (
        df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key, with their 1-based ``rank``."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked).cast("long")).where(
        F.col("rank") <= k
    )


def numbered(df: DataFrame, out: str = "place") -> DataFrame:
    """1-based place of every row in the order ``df`` has, without a window over all rows.

    Only one count per partition passes through one task.
    """
    placed = settled(df.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(starts, "_part").withColumn(out, F.col("_before") + F.col("_id") - F.col("_first") + 1).drop(
        "_id", "_part", "_first", "_before")


def spread_null_text(key: Column, pos: Column) -> Column:
    """Text join key whose nulls scatter instead of meeting in one task; they match nothing."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.pmod(F.hash(pos), F.lit(_SPREAD)).cast("string")))


def spread_null_ms(key: Column, pos: Column) -> Column:
    """The same for times, using values below every legal time."""
    below = F.lit(-(10**17)).cast("long") - F.pmod(F.hash(pos), F.lit(_SPREAD)).cast("long")
    return F.coalesce(key, below)


def lookup(df: DataFrame, facts: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Left join to one-row-per-key ``facts``; rows with a null key keep apart and find nothing."""
    keyed = df.withColumn("_key", spread_null_text(F.col(key).cast("string"), F.col(pos)))
    return keyed.join(facts.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")
