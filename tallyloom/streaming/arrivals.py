"""Incremental recomputation: cursors, affected buckets, and streams into keyed state.

Late data is never dropped: arriving rows name the buckets they touch, and those are computed
again from all their rows. An event-time watermark would drop late rows, so none is set here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.buckets import start
from tallyloom.operators.upsert import last_wins, replaced


def affected(arrived: DataFrame, kind: str, ts: str, trailing: DataFrame | None = None) -> DataFrame:
    """Buckets that arrived rows touch, and trailing ones that are always computed again."""
    touched = arrived.select(start(kind, ts).alias("bucket")).distinct()
    return touched if trailing is None else touched.union(trailing.select("bucket")).distinct()


def daily(events: DataFrame) -> DataFrame:
    """Counts and sums of events per day and type."""
    return events.groupBy(start("day", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


def recomputed(old: DataFrame, everything: DataFrame, arrived: DataFrame) -> DataFrame:
    """Daily rollup after arrival: only affected buckets are computed again."""
    buckets = affected(arrived, "day", "ts").withColumnRenamed("bucket", "bucket")
    fresh = daily(everything.withColumn("bucket", start("day", "ts")).join(buckets, "bucket", "left_semi").drop("bucket"))
    return replaced(old, fresh, buckets, ["bucket"])


def latest_cursor(cursors: DataFrame, done: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Cursors advanced by a clean pass; a cursor never moves back."""
    both = cursors.select(*keys, at).unionByName(done.select(*keys, at))
    return both.groupBy(*keys).agg(F.max(at).alias(at))


def drain(spark: SparkSession, source: str, schema, sink: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*.parquet", files: int | None = None, through: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Process everything that is available at a path, at least once a row, with a durable cursor.

    files bounds the files of a batch; through is what the stream passes before the sink, in the given output mode.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true" if files else "false")
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    query = (through(stream) if through else stream).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keyed_sink(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each key's latest version; writing a batch again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        last_wins(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def event_windows(events: DataFrame, length: str = "7 days", offset: str = "4 days") -> DataFrame:
    """Tumbling windows of a week from Monday, as a stream or a batch."""
    ts = F.col("ts").cast("timestamp")
    return events.groupBy(F.window(ts, length, length, offset).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.to_date("w.start").alias("week_start"), "event_type", "events")


def start_points(cursors: DataFrame, history: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Where each pass starts: the cursor if the history still holds it, else NULL, which reads everything again.

    A rewritten history would otherwise leave a hole that nothing shows; writes are upserts, so reading again is safe.
    """
    seen = history.join(cursors.select(*keys, at).where(F.col(at).isNotNull()).distinct(), [*keys, at], "left_semi").select(*keys, at).distinct().withColumn("_seen", F.lit(True))
    joined = cursors.join(seen, [*keys, at], "left")
    state = F.when(F.col(at).isNull(), "first").when(F.col("_seen"), "resumed").otherwise("rewritten")
    return joined.select(*keys, F.when(F.col("_seen"), F.col(at)).alias(at), state.alias("state"))


def advanced(cursors: DataFrame, runs: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Cursors after runs (keys, at, status): only clean ones move a cursor; a partial run's data stay, its cursor does not."""
    return latest_cursor(cursors, runs.where("status = 'ok'"), keys, at)


def rebuild_modes(wanted: DataFrame, stored: DataFrame, key: str, version: str, rebuild: bool = False) -> DataFrame:
    """(key, mode): whether each key's rollup is computed afresh: asked for, nothing stored, another formula version, or not."""
    have = stored.groupBy(key).agg(F.count(F.when(F.col("version") != version, 1)).alias("stale"))
    mode = F.when(F.lit(rebuild), "rebuild").when(F.col("stale").isNull(), "first-run").when(F.col("stale") > 0, "version-change").otherwise("incremental")
    return wanted.select(key).distinct().join(have, key, "left").select(key, mode.alias("mode"))
