"""Distinct counts that merge: exact bitmaps per scope and day, ORed into any longer period or wider scope.

Ids are dealt into bitmaps of a fixed number of positions, so a state is rows of bounded size, however many
people a scope has; a new day adds its bitmaps and no earlier fact is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.buckets import start


def day_sets(facts: DataFrame, scope: list[str], day: str, member: str) -> DataFrame:
    """(scope, day, bucket, members): bitmaps of the members (integers; null ones are none) seen in each scope and day."""
    rows = facts.where(F.col(member).isNotNull()).select(*scope, F.col(day).alias("day"), F.bitmap_bucket_number(F.col(member).cast("long")).alias("bucket"), F.bitmap_bit_position(F.col(member).cast("long")).alias("position"))
    return rows.groupBy(*scope, "day", "bucket").agg(F.bitmap_construct_agg("position").alias("members"))


def added(sets: DataFrame, more: DataFrame) -> DataFrame:
    """State after more bitmaps of the same scopes and days; adding the same ones again changes nothing."""
    keys = [c for c in sets.columns if c != "members"]
    return sets.unionByName(more).groupBy(*keys).agg(F.bitmap_or_agg("members").alias("members"))


def merged(sets: DataFrame, scope: list[str], kind: str) -> DataFrame:
    """(scope, period_start, bucket, members): bitmaps of days as those of weeks or months, in the given part of the scope."""
    return sets.groupBy(*scope, start(kind, F.col("day").cast("timestamp_ntz")).alias("period_start"), "bucket").agg(F.bitmap_or_agg("members").alias("members"))


def counted(sets: DataFrame, keys: list[str], name: str = "people") -> DataFrame:
    """Number of members per key."""
    return sets.groupBy(*keys).agg(F.sum(F.bitmap_count("members")).alias(name))
