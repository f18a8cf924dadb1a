"""Checks that data and results hold what they promise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.buckets import start
from tallyloom.functions.search import contained
from tallyloom.functions.text import EMAIL
from tallyloom.operators.conform import commits_enriched, counted_commits
from tallyloom.session import ship, stored
from tallyloom.sources.adapter import Activity


def bucket_mismatches(a: Activity) -> DataFrame:
    """Rows whose stored buckets differ from buckets derived again; there must be none."""
    bad = (F.date_sub("day_start", F.weekday("day_start")) != F.col("week_start")) | (F.trunc("day_start", "month") != F.col("month_start")) | (F.to_date("authored_at") != F.col("day_start"))
    return commits_enriched(a).agg(F.count(F.when(bad, 1)).alias("mismatches"), F.count("*").alias("rows_checked"))


def bucket_properties(moments: DataFrame, ts: str = "ts") -> DataFrame:
    """Per day that occurs, and the 21 days from the first of 2026: its week starts on a Monday, not after it, and less than 7 days before."""
    fixed = moments.sparkSession.range(21).select(F.date_add(F.lit("2026-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    day = moments.select(F.to_date(ts).alias("day")).where("day is not null").union(fixed).distinct()
    week = start("week", F.col("day").cast("timestamp_ntz"))
    return day.select("day", week.alias("week_start"), ((F.weekday(week) == 0) & (week <= F.col("day")) & (F.datediff("day", week) < 7)).cast("long").alias("holds"))


def conservation(a: Activity) -> DataFrame:
    """Totals by day, week and month agree with the number of rows; commits are counted once, by their stored buckets."""
    buckets = ("day_start", "week_start", "month_start")
    rows = stored(counted_commits(a).groupBy(*buckets).agg(F.count("*").alias("n")), "days")
    per = [rows.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("buckets")).select(F.lit(c).alias("period"), "total", "buckets") for c in buckets]
    return per[0].unionByName(per[1]).unionByName(per[2])


def same(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def without_catalog(metrics: DataFrame, catalog: DataFrame) -> DataFrame:
    """Metric keys that no catalog row describes."""
    return metrics.select("metric_key").distinct().join(catalog.select("metric_key"), "metric_key", "left_anti")


def undisclosed(catalog: DataFrame) -> DataFrame:
    """Proxy metrics that do not say what they stand for or cannot see."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return catalog.where((F.col("is_proxy") == 1) & (blank("proxy_statement") | blank("cannot_see"))).select("metric_key")


def unfinished(runs: DataFrame, own: int | None = None) -> DataFrame:
    """Runs still marked as running besides one's own: their cursors may not be trusted."""
    other = F.lit(True) if own is None else F.col("run_id") != own
    return runs.where((F.col("status") == "running") & other).select("run_id")


def limited(due: DataFrame, order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of what is due, and (due, taken, deferred), so that a limited pass never looks complete."""
    counts = due.agg(F.count("*").alias("due")).select("due", F.least("due", F.lit(most)).alias("taken"), F.greatest(F.col("due") - most, F.lit(0)).alias("deferred"))
    return due.orderBy(order).limit(most), counts


def identifiers_in(texts: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """Texts that hold an email-shaped string or any needle, ignoring case, wherever it stands in the text; any number of needles."""
    ship(texts.sparkSession)
    shaped = texts.where(F.col(text).rlike(EMAIL)).withColumn("found", F.lit("email-shaped"))
    return contained(texts, needles, text).unionByName(shaped)


def disclosed(texts: DataFrame, needles: DataFrame, allowed: DataFrame, text: str = "text") -> DataFrame:
    """identifiers_in with `collision`: the needle is part of an allowed name (name), so it is reported but no breach."""
    hits = identifiers_in(texts, needles, text)
    inside = contained(allowed.select("name"), needles, "name").select("found").distinct().withColumn("collision", F.lit(True))
    return hits.join(inside, "found", "left").select(*texts.columns, "found", F.coalesce("collision", F.lit(False)).alias("collision"))
