"""State that a stream keeps: first occurrences per key, and a rollup maintained bucket by bucket."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.functions.buckets import start
from tallyloom.operators.upsert import last_wins, write_buckets
from tallyloom.streaming.arrivals import affected, daily

#: Where the state of keyed operators lives; the default store can't hold it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class FirstOccurrence(StatefulProcessor):
    """The smallest time seen of a key; told when it is new or lowered, so a late, earlier event corrects it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        least = min((int(part["at_micros"].min()) for part in rows if len(part)), default=None)
        known = self.first.get()[0] if self.first.exists() else None
        if least is not None and (known is None or least < known):
            self.first.update((least,))
            yield pd.DataFrame([(*key, least)])

    def close(self) -> None:
        pass


def first_occurrences(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys and at_micros of a stream's keys whenever their first time is new or lowered; in update mode.

    No watermark is set: an event may be late by any time. The store keeps one number a key. Null times are none.
    """
    schema = StructType([*[StructField(k, rows.schema[k].dataType) for k in keys], StructField("at_micros", LongType())])
    return timed(rows, keys, at).groupBy(*keys).transformWithStateInPandas(statefulProcessor=FirstOccurrence(), outputStructType=schema, outputMode="Update", timeMode="None")


def touched_lowest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """As first_occurrences, but a key is told, with its lowest time so far, by every batch that has rows of it.

    The state is that of Spark's own aggregate: rows are combined before the shuffle and no Python runs, so a
    batch costs little a partition. first_occurrences is for readers that must see changes only.
    """
    return timed(rows, keys, at).groupBy(*keys).agg(F.min("at_micros").alias("at_micros"))


def timed(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys and time in microseconds of the rows that have a time."""
    return rows.select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("at_micros")).where("at_micros is not null")


def lowest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of lowered times; each batch has its folder, so a repeated one changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def lowest_of(told: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First time of each key from all that a stream told."""
    return told.groupBy(*keys).agg(F.timestamp_micros(F.min("at_micros")).cast("timestamp_ntz").alias(at))


@dataclass(frozen=True)
class MaintainedDaily:
    """Daily counts of events (event_id, ts, event_type, user_id, value) that follow a stream, whatever arrives when.

    A batch's events are stored by day; the days it touches, and only those, are computed again from all their
    events and put in place of the old ones. A repeated batch overwrites what it wrote, a repeated event counts once.
    """

    path: str

    def sink(self, batch: DataFrame, number: int) -> None:
        spark, bucketed = batch.sparkSession, batch.withColumn("bucket", start("day", "ts"))
        bucketed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/facts/batch={number}")
        fresh = self.computed(spark, affected(batch, "day", "ts"))
        write_buckets(fresh, f"{self.path}/daily", ["bucket"])

    def computed(self, spark, days: DataFrame) -> DataFrame:
        """Counts of the given days (bucket) from stored events; other days' files are not read."""
        listed = [r.bucket for r in days.collect()]  # calendar days
        facts = spark.read.parquet(f"{self.path}/facts").where(F.col("bucket").isin(listed)).drop("batch", "bucket")
        return daily(last_wins(facts, ["event_id"], ["ts"]))

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/daily")
