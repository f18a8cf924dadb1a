"""Weekly planning numbers: the scorecard with its trends, what moves right now, and the multi-line share beside its base rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.buckets import ratio
from tallyloom.functions.text import has_body
from tallyloom.operators.rollups import n, r6

#: A merged review needed rework if it took more revision rounds than this.
ROUNDS = 2


def arrow(now: Column, before: Column) -> Column:
    """Trend of a number against the week before; NULL where either is unknown."""
    return F.when(now > before, "up").when(now < before, "down").when(now == before, "flat")


def scorecard(items: DataFrame) -> DataFrame:
    """Per team and week: planned against merged, rework rate, cost a merge and top failure cause, with trends.

    items: team, week_start, planned, merged (booleans), rounds, cost, failure (a cause or NULL). Cost is all that the team
    spent, whatever it went to. Of causes equally frequent the smaller name is told. The week before is the calendar week before, so a team
    without it has no trend; ratios without a denominator are NULL. Counts of causes are reduced before they are compared.
    """
    key = ["team", "week_start"]
    merged, planned = F.col("merged"), F.col("planned")
    sums = items.groupBy(*key).agg(n(planned).alias("planned"), n(planned & merged).alias("planned_merged"), n(merged).alias("merged"), n(merged & (F.col("rounds") > ROUNDS)).alias("reworked"), F.sum("cost").alias("cost"))
    causes = items.where("failure is not null").groupBy(*key, "failure").agg(F.count("*").alias("c")).groupBy(*key).agg(F.min(F.struct((-F.col("c")).alias("minus"), "failure"))["failure"].alias("top_failure"))
    numbers = {"planned_pct": ratio(F.col("planned_merged"), F.col("planned")), "rework_pct": ratio(F.col("reworked"), F.col("merged")), "cost_per_merge": F.try_divide(F.col("cost"), F.col("merged"))}
    rows = sums.join(causes, key, "left").select(*key, "planned", "planned_merged", "merged", "reworked", "top_failure", *[r6(c).alias(name) for name, c in numbers.items()])
    before = rows.select("team", F.date_add("week_start", 7).alias("week_start"), *[F.col(name).alias(f"{name}_before") for name in numbers])
    return rows.join(before, key, "left").select(*rows.columns, *[arrow(F.col(name), F.col(f"{name}_before")).alias(f"{name}_trend") for name in numbers])


def newest(items: DataFrame, labels: DataFrame, group: str = "team", most: int = 25) -> DataFrame:
    """The most recently updated items of each group with their labels, in order of name and joined by commas.

    items: group, item, updated_at; labels: item, label. Ties go to the smaller item; labels are joined for what is kept only.
    """
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last("updated_at"), "item")
    kept = items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    named = labels.join(kept.select("item").distinct(), "item", "left_semi").groupBy("item").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
    return kept.join(named, "item", "left").withColumn("labels", F.coalesce("labels", F.lit("")))


def multiline_share(commits: DataFrame, key: list[str]) -> DataFrame:
    """Share of commits whose message has a body, with the declared base rate and how far both agree.

    commits: the keys, message, is_ai_assisted (0 or 1). Trailers and blank lines are no body, as a trailer is what the share is compared
    with. An unknown message (NULL) leaves the denominator. The share says little without the base rate, so both are one row.
    """
    body, declared = has_body(F.col("message")) == 1, F.col("is_ai_assisted") == 1
    per = commits.where("message is not null").groupBy(*key).agg(F.count("*").alias("commits"), n(body).alias("multiline"), n(declared).alias("declared"), n(body & declared).alias("both"))
    share = lambda a, b: r6(ratio(F.col(a), F.col(b)))
    return per.select(*key, "commits", share("multiline", "commits").alias("multiline_pct"), share("declared", "commits").alias("base_rate_pct"), share("both", "multiline").alias("precision_pct"), share("both", "declared").alias("recall_pct"))
