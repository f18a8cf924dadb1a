"""Calendar buckets in UTC: day, week from Monday, month; labels, spines and partial flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("day", "week", "month")


def start(kind: str, ts: str | Column) -> Column:
    """First day of the bucket that ts falls in."""
    return F.date_trunc(kind, F.col(ts) if isinstance(ts, str) else ts).cast("date")


def iso_label(day: Column) -> Column:
    """ISO week label; year and week both follow the week's Thursday."""
    thursday = F.date_add(F.date_trunc("week", day).cast("date"), 3)
    return F.concat(F.date_format(thursday, "yyyy"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def following(kind: str, bucket: Column) -> Column:
    """First day of the next bucket."""
    return {"day": F.date_add(bucket, 1), "week": F.date_add(bucket, 7), "month": F.add_months(bucket, 1)}[kind]


def partial(kind: str, bucket: Column, ceiling: Column) -> Column:
    """1 if the bucket ends after the day that follows the ceiling."""
    return (following(kind, bucket) > F.date_add(ceiling, 1)).cast("long")


def pivoted(df: DataFrame, ts: str) -> DataFrame:
    """Every row once per period kind, from one scan."""
    kinds = [F.struct(F.lit(k).alias("period_kind"), start(k, ts).alias("period_start")) for k in KINDS]
    return df.withColumn("_p", F.explode(F.array(*kinds))).select("*", "_p.period_kind", "_p.period_start").drop("_p")


def spine(keys: DataFrame, bounds: DataFrame, kind: str, name: str) -> DataFrame:
    """Every key with every bucket from bounds.lo to bounds.hi (one row each)."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[kind]
    buckets = bounds.where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, {step})")).alias(name))
    return keys.join(F.broadcast(buckets))  # calendar buckets: a few thousand at most


def hours(first: Column, last: Column) -> Column:
    """Exact difference in hours."""
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(3.6e9)


def ratio(a: Column, b: Column, scale: float = 100.0) -> Column:
    """scale * a / b in doubles; NULL where b is 0 or NULL."""
    return F.lit(scale) * a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def window_start(until: Column, days: int = 0, months: int = 0) -> Column:
    """First day of a window that ends at until; an empty bound is refused when it is read."""
    first = F.add_months(F.date_sub(until, days), -months)
    return F.when(first.isNull(), F.raise_error(F.lit("no bound of the window"))).otherwise(first)
