"""Conformed views: the one place where attribution, population and buckets are defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.buckets import hours, start
from tallyloom.sources.adapter import Activity, first_agent


def steerer_state() -> Column:
    """known, machine, or unknown (which is a gap in measurement, never a person)."""
    return F.when(F.col("login").isNull(), "unknown").when((F.col("is_bot") == 1) | (F.col("is_excluded") == 1), "machine").otherwise("known")


def commits_enriched(a: Activity) -> DataFrame:
    """Every commit with both attributions and its buckets."""
    agent = F.col("agents").isNotNull()
    return a.commits.join(a.repos, "repo_id").select(
        "repo_id",
        F.col("full_name").alias("repo_full_name"),
        "owner",
        "is_shallow",
        "sha",
        "pr_id",
        "identity_id",
        "login",
        "authored_at",
        start("day", "authored_at").alias("day_start"),
        start("week", "authored_at").alias("week_start"),
        start("month", "authored_at").alias("month_start"),
        "is_merge",
        "insertions",
        agent.cast("int").alias("is_ai_assisted"),
        F.col("login").isNull().cast("int").alias("is_unattributed"),
        F.coalesce("is_bot", F.lit(0)).alias("is_bot"),
        steerer_state().alias("steerer_state"),
        F.when(agent, "agent").otherwise("unknown").alias("executor_state"),
        first_agent(F.col("agents")).alias("executor_agent_key"),
        "agents",
    )


def prs_enriched(a: Activity) -> DataFrame:
    """Every review with class, attribution pair, cycle time and merge buckets."""
    agent = F.col("agents").isNotNull()
    return a.pull_requests.join(a.repos, "repo_id").select(
        "pr_id",
        "repo_id",
        F.col("full_name").alias("repo_full_name"),
        "owner",
        "is_shallow",
        "identity_id",
        "login",
        "state",
        "created_at",
        "first_commit_at",
        "merged_at",
        start("day", "merged_at").alias("merged_day_start"),
        start("week", "merged_at").alias("merged_week_start"),
        start("month", "merged_at").alias("merged_month_start"),
        F.when(F.col("merged_at").isNotNull() & F.col("first_commit_at").isNotNull(), hours(F.col("first_commit_at"), F.col("merged_at"))).alias("cycle_time_hours"),
        F.coalesce("class", F.lit("unclassified")).alias("class"),
        F.coalesce("is_revert", F.lit(0)).alias("is_revert"),
        agent.cast("int").alias("is_ai_assisted"),
        steerer_state().alias("steerer_state"),
        F.when(agent, "agent").otherwise("unknown").alias("executor_state"),
    )


def counted_commits(a: Activity) -> DataFrame:
    """Commits that metrics count: no merges, no machines, no truncated histories."""
    return commits_enriched(a).where("steerer_state in ('known', 'unknown') and is_shallow = 0 and is_merge = 0")


def merged_prs(a: Activity) -> DataFrame:
    """Merged reviews that metrics count."""
    return prs_enriched(a).where("steerer_state in ('known', 'unknown') and is_shallow = 0 and state = 'MERGED' and merged_at is not null")


def scoped(df: DataFrame) -> DataFrame:
    """Every row once for its repository and once for its organisation."""
    scopes = F.array(F.struct(F.lit("repo").alias("scope"), F.col("repo_full_name").alias("scope_key")), F.struct(F.lit("org").alias("scope"), F.col("owner").alias("scope_key")))
    return df.withColumn("_s", F.explode(scopes)).select("*", "_s.scope", "_s.scope_key").drop("_s")


def per_person(rows: DataFrame, buckets: list[str], **measures: Column) -> DataFrame:
    """Measures (sums) of every scope, bucket and person.

    Rows are counted per repository and person before they are scoped, so only counts are doubled;
    distinct people then are rows, and no distinct count expands the facts.
    """
    who = ["identity_id", "steerer_state"]
    counted = rows.groupBy("repo_full_name", "owner", *buckets, *who).agg(*[m.alias(name) for name, m in measures.items()])
    return scoped(counted).groupBy("scope", "scope_key", *buckets, *who).agg(*[F.sum(name).alias(name) for name in measures])
