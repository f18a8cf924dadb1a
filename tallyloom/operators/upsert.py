"""Keyed writes as pure table functions: each returns the new state of a table."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_wins(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The version of each key that is largest by order; combined map-side, without a window."""
    rest = [c for c in versions.columns if c not in keys]
    best = versions.groupBy(*keys).agg(F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest])).alias("v"))
    return best.select(*keys, *[F.col(f"v._{c}").alias(c) for c in rest])


def preserving(old: DataFrame, new: DataFrame, keys: list[str], owned: tuple[str, ...] = ()) -> DataFrame:
    """new over old, keeping old values where new ones are NULL and always in owned columns."""
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in keys])
    joined = old.join(renamed, keys, "full")
    value = {c: F.coalesce(c, f"_{c}") if c in owned else F.coalesce(f"_{c}", c) for c in old.columns if c not in keys}
    return joined.select(*keys, *[v.alias(c) for c, v in value.items()])


def if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def lowest(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A floor that may only be lowered."""
    return old.select(*keys, column).unionByName(new.select(*keys, column)).groupBy(*keys).agg(F.min(column).alias(column))


def accumulated(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    return old.select(*keys, column).unionByName(new.select(*keys, column)).groupBy(*keys).agg(F.sum(column).alias(column))


def replaced(old: DataFrame, fresh: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of affected buckets exchanged for fresh ones; other buckets stay."""
    return old.join(affected, keys, "left_anti").unionByName(fresh.join(affected, keys, "left_semi"))


def write_buckets(fresh: DataFrame, path: str, partitions: list[str]) -> None:
    """Overwrite only the partitions that fresh holds."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def changes(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """What a replacement of old by fresh would do, without doing it: keys with change (added, gone or changed) and both rows.

    Each side has one row a key; keys and values are compared null-safely; rows that stay as they are are not told.
    """
    rest = [c for c in old.columns if c not in keys]
    side = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*rest).alias(name))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))
    both = side(old, "old").join(side(fresh, "new"), on, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    told = [F.when(F.col("old").isNull(), F.col(f"new_{k}")).otherwise(F.col(f"old_{k}")).alias(k) for k in keys]
    return both.select(*told, change.alias("change"), "old", "new").where("change is not null")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, by the file system of its path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class KeyedTable:
    """A table of one row a key, in hash buckets; a load rewrites the buckets it touches and no others.

    The number of buckets stays with the table: choose it so that a bucket fits a task. A load is merged aside and
    then put in place of its buckets, so it never reads what it writes, and giving it again changes nothing.
    """

    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows").drop("bucket")

    def load(self, batch: DataFrame) -> int:
        """Merge a batch by key, the largest by order winning; the number of buckets written again."""
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return 0
        if exists(spark, f"{self.path}/rows"):
            old = spark.read.schema(new.schema).parquet(f"{self.path}/rows").where(F.col("bucket").isin(touched))
            new = old.unionByName(new)
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        last_wins(new, ["bucket", *self.keys], list(self.order)).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(aside)
        merged = spark.read.schema(new.schema).parquet(aside)
        write_buckets(merged.repartition(len(touched), "bucket"), f"{self.path}/rows", ["bucket"])
        place = spark._jvm.org.apache.hadoop.fs.Path(aside)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return len(touched)


@dataclass(frozen=True)
class Ledger:
    """A table that is only appended to, in batches of rows with a run_id; a batch given again takes its own place."""

    path: str

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add rows under the batch's name; earlier batches are neither read nor written."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("run_id").parquet(f"{self.path}/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("batch")
