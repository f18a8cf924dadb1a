"""Delivery, quality, concentration and adoption rollups over the conformed views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.buckets import following, iso_label, pivoted, ratio, spine, start
from tallyloom.operators.conform import commits_enriched, counted_commits, merged_prs, per_person, prs_enriched, scoped
from tallyloom.session import stored
from tallyloom.sources.adapter import Activity, agents_in

WINDOW_DAYS, FLOOR_PRS, COHORT = 90, 3, 5
#: Ranks of the two values whose mean is the median, and of the nearest-rank p75, of n values.
MIDDLES = {"low": lambda n: F.expr(f"({n} + 1) div 2"), "high": lambda n: F.expr(f"({n} + 2) div 2")}
QUARTILES = MIDDLES | {"third": lambda n: F.greatest(F.lit(1), F.expr(f"(75 * {n} + 99) div 100"))}


def n(column: Column) -> Column:
    """Number of rows where a condition holds."""
    return F.count(F.when(column, 1))


def r6(column: Column) -> Column:
    return F.round(column.cast("double"), 6)


def p50(column: str) -> Column:
    return F.percentile(column, F.lit(0.5))


def p75(column: str) -> Column:
    """Nearest rank, as the smallest value with at least three quarters of the values at or below it."""
    return F.expr(f"percentile_disc(0.75) within group (order by {column})")


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Per keys (never NULL): n, and the exact values at given ranks, whatever the size of a group.

    Equal values are counted before the shuffle. Cells of one unit are summed up in order, and
    only the cell that holds a rank is opened; so no task sorts more than a group's cells or one
    cell's distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("cell", F.floor("v"))
    up_to = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = counts.groupBy(*keys, "cell").agg(F.sum("c").alias("c"))
    summed = cells.select(*keys, "cell", "c", F.sum("c").over(up_to).alias("upto"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank("n").cast("long").alias("rank")) for name, rank in ranks.items()])).alias("r")
    asked = summed.select(*keys, "cell", "n", (F.col("upto") - F.col("c")).alias("before"), "upto", wanted).where("r.rank > before and r.rank <= upto").select(*keys, "cell", "n", "before", "r.name", "r.rank")
    inside = Window.partitionBy(*keys, "cell", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = counts.join(asked, [*keys, "cell"]).withColumn("reach", F.col("before") + F.sum("c").over(inside))
    hits = opened.where("rank > reach - c and rank <= reach")
    return hits.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])


def median() -> Column:
    """The median from the two middle values that at_ranks gives."""
    return (F.col("low") + F.col("high")) / 2


def weekly_delivery(a: Activity) -> DataFrame:
    """Merged reviews, contributors and cycle times per scope and week, on a dense spine."""
    columns = ["repo_full_name", "owner", "identity_id", "steerer_state", F.col("merged_week_start").alias("week_start"), "cycle_time_hours"]
    prs = stored(merged_prs(a).select(*columns), "merged")
    key = ["scope", "scope_key", "week_start"]
    people = per_person(prs, ["week_start"], prs=F.count("*")).groupBy(*key).agg(F.sum("prs").alias("prs_merged"), F.count("identity_id").alias("active_contributors"))
    cycle = at_ranks(scoped(prs), key, "cycle_time_hours", QUARTILES).select(*key, r6(median()).alias("cycle_p50"), r6(F.col("third")).alias("cycle_p75"))
    rolled = stored(people.join(cycle, key, "left"), "weekly")
    bounds = rolled.agg(F.min("week_start").alias("lo"), F.max("week_start").alias("hi"))
    keys = rolled.select("scope", "scope_key").distinct()
    dense = spine(keys, bounds, "week", "week_start")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("prs_merged", "active_contributors")]
    return dense.join(rolled, key, "left").select(*key, *zero, "cycle_p50", "cycle_p75")


def period_pivot(a: Activity) -> DataFrame:
    """Commit counts per repository for all three period kinds, from one scan of days of people."""
    days = counted_commits(a).groupBy("repo_full_name", "day_start", "identity_id").agg(F.count("*").alias("commits"))
    people = pivoted(days, "day_start").groupBy("period_kind", "period_start", "repo_full_name", "identity_id").agg(F.sum("commits").alias("commits"))
    return people.groupBy("period_kind", "period_start", "repo_full_name").agg(F.sum("commits").alias("commits"), F.count("identity_id").alias("authors"))


def cycle_percentiles(a: Activity) -> DataFrame:
    """Median and nearest-rank p75 of cycle times per scope and month."""
    key = ["scope", "scope_key", "month_start"]
    prs = scoped(merged_prs(a)).withColumn("month_start", F.col("merged_month_start"))
    return at_ranks(prs, key, "cycle_time_hours", QUARTILES).select(*key, "n", r6(median()).alias("p50"), r6(F.col("third")).alias("p75"))


def bus_factor(a: Activity) -> DataFrame:
    """Fewest authors that cover half of a month's commits, and the first one's share.

    Authors of as many commits are one level, so a month sorts its distinct counts, not its authors.
    """
    key = ["scope", "scope_key", "month_start"]
    per = per_person(counted_commits(a).where("identity_id is not null"), ["month_start"], n=F.count("*"))
    levels = per.groupBy(*key, "n").agg(F.count("*").alias("people"))
    order = Window.partitionBy(*key).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.col("n") * F.col("people")
    summed = levels.select(*key, "n", (F.sum("people").over(order) - F.col("people")).alias("ahead"), (F.sum(mine).over(order) - mine).alias("before"), F.sum(mine).over(order).alias("upto"), F.sum(mine).over(Window.partitionBy(*key)).alias("tot"))
    half = (F.col("before") * 2 < F.col("tot")) & (F.col("upto") * 2 >= F.col("tot"))
    needed = F.col("ahead") + F.ceil((F.col("tot") - 2 * F.col("before")) / (2 * F.col("n")))
    return summed.groupBy(*key).agg(F.max(F.when(half, needed)).cast("long").alias("bus_factor"), r6(ratio(F.max("n"), F.max("tot"))).alias("top_share"), F.max("tot").alias("commits"))


def agent_counts(a: Activity) -> DataFrame:
    """Assisted commits per scope, week and agent, and of all of them; a commit credits each of its agents."""
    key = ["scope", "scope_key", "week_start"]
    sets = counted_commits(a).where("is_ai_assisted = 1").groupBy("repo_full_name", "owner", "week_start", "agents").agg(F.count("*").alias("c"))
    each = scoped(sets).select(*key, "c", F.explode(F.array_append(agents_in(F.col("agents")), F.lit(None).cast("string"))).alias("agent_key"))
    per = each.groupBy(*key, "agent_key").agg(F.sum("c").alias("n"))  # the row without a key counts all
    total = F.max(F.when(F.col("agent_key").isNull(), F.col("n"))).over(Window.partitionBy(*key))  # a bucket has a row an agent
    return per.withColumn("total", total).where("agent_key is not null")


def agent_mix(a: Activity) -> DataFrame:
    """The leading agent of each bucket (ties to the smaller key) and its share."""
    key = ["scope", "scope_key", "week_start"]
    best = agent_counts(a).groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("minus"), "agent_key")).alias("b"), F.max("total").alias("total"))
    return best.select(*key, F.col("b.agent_key").alias("agent_key"), (-F.col("b.minus")).alias("commits"), r6(ratio(-F.col("b.minus"), F.col("total"))).alias("share"))


def agent_share(a: Activity) -> DataFrame:
    """Every agent's share of assisted commits; shares may add up to more than 100."""
    return agent_counts(a).select("scope", "scope_key", "week_start", "agent_key", F.col("n").alias("numerator"), F.col("total").alias("denominator"), r6(ratio(F.col("n"), F.col("total"))).alias("value"))


def long_form(wide: DataFrame, metrics: dict[str, tuple[str, str, float, Column]], unavailable: dict[str, str] | None = None) -> DataFrame:
    """A row a metric with value, numerator, denominator, sample size and note, from columns of wide.

    metrics: key -> (numerator, denominator, scale, note). Metrics that can't be computed from
    activity have a row as well, of NULLs and the reason.
    """
    null = F.lit(None)

    def row(key: str, numerator: Column, denominator: Column, value: Column, note: Column) -> Column:
        return F.struct(F.lit(key).alias("metric_key"), numerator.cast("long").alias("numerator"), denominator.cast("long").alias("denominator"), value.cast("double").alias("value"), denominator.cast("long").alias("sample_size"), note.cast("string").alias("note"))

    rows = [row(k, F.col(x), F.col(y), r6(ratio(F.col(x), F.col(y), s)), note) for k, (x, y, s, note) in metrics.items()]
    rows += [row(k, null, null, null, F.lit(why)) for k, why in (unavailable or {}).items()]
    return wide.select("scope", "scope_key", "period_start", F.explode(F.array(*rows)).alias("m")).select("scope", "scope_key", "period_start", "m.*")


def gap_note(count: str, what: str) -> Column:
    """How many rows a metric could not use, where there are any."""
    return F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(f" {what}")))


#: Metrics that activity data can't give, and why.
UNAVAILABLE = {
    "effectiveness.dxi": "unavailable: taken from a survey, not from activity",
    "risk.ownership_concentration": "unavailable: defined by file path, and paths are not read",
}


def ratio_metrics(a: Activity) -> DataFrame:
    """Quality ratios in long form with numerator and denominator; NULL where not computable."""
    classified = F.col("class") != "unclassified"
    counts = dict(
        merged=F.count("*"), classified=n(classified), bugfix=n(F.col("class") == "bugfix"), reverts=n(F.col("is_revert") == 1), feature=n(F.col("class") == "feature"),
        assisted=n(F.col("is_ai_assisted") == 1), unclassified=n(~classified), unknown=n(F.col("steerer_state") == "unknown"),
    )
    per = merged_prs(a).groupBy("repo_full_name", "owner", F.col("merged_week_start").alias("period_start")).agg(*[c.alias(k) for k, c in counts.items()])
    wide = scoped(per).groupBy("scope", "scope_key", "period_start").agg(*[F.sum(k).alias(k) for k in counts])
    gap, none = gap_note("unclassified", "unclassified"), F.lit(None)
    metrics = {
        "quality.defect_ratio": ("bugfix", "classified", 100.0, gap),
        "quality.revert_rate": ("reverts", "classified", 100.0, gap),
        "impact.innovation_ratio": ("feature", "classified", 100.0, gap),
        "adoption.ai_pr_share": ("assisted", "merged", 100.0, none),
        "meta.unclassified_pr_share": ("unclassified", "merged", 100.0, none),
        "meta.unknown_steerer_pr_share": ("unknown", "merged", 100.0, none),
    }
    return long_form(wide, metrics, UNAVAILABLE)


def commit_metrics(a: Activity) -> DataFrame:
    """Adoption, leverage and coverage metrics of commits, long form, from one pass over people's counts."""
    people = per_person(counted_commits(a), ["week_start"], commits=F.count("*"), agent=n(F.col("executor_state") == "agent"))
    known, person = F.col("steerer_state") == "known", F.col("identity_id").isNotNull()
    wide = people.groupBy("scope", "scope_key", F.col("week_start").alias("period_start")).agg(
        F.sum("commits").alias("commits"), F.sum("agent").alias("agent"), F.sum(F.when(known, F.col("commits")).otherwise(0)).alias("known"), F.sum(F.when(known, F.col("agent")).otherwise(0)).alias("known_agent"),
        F.sum(F.col("commits") - F.col("agent")).alias("unknown_exec"), F.sum(F.when(known, 0).otherwise(F.col("commits"))).alias("unknown"),
        n(known & person).alias("steerers"), n(person).alias("contributors"), n(person & (F.col("agent") > 0)).alias("with_agent"),
    )
    gap, none = gap_note("unknown", "without a known steerer"), F.lit(None)
    metrics = {
        "adoption.ai_commit_share": ("agent", "commits", 100.0, none),
        "adoption.ai_commit_share_known_steerer": ("known_agent", "known", 100.0, gap),
        "adoption.executor_unknown_share": ("unknown_exec", "commits", 100.0, none),
        "adoption.contributors_with_ai_share": ("with_agent", "contributors", 100.0, none),
        "leverage.commits_per_steerer": ("known", "steerers", 1.0, gap),
        "meta.unknown_steerer_share": ("unknown", "commits", 100.0, none),
        "meta.identity_resolution_pct": ("known", "commits", 100.0, none),
    }
    return long_form(wide, metrics)


def throughput(a: Activity) -> DataFrame:
    """Opened and merged reviews on their own axes, and merged per contributor, by week."""
    key = ["scope", "scope_key", "week_start"]
    prs = prs_enriched(a).where("steerer_state in ('known', 'unknown') and is_shallow = 0")
    opened = scoped(prs.groupBy("repo_full_name", "owner", start("week", "created_at").alias("week_start")).agg(F.count("*").alias("c"))).groupBy(*key).agg(F.sum("c").alias("prs_opened"))
    people = per_person(merged_prs(a).withColumn("week_start", F.col("merged_week_start")), ["week_start"], prs=F.count("*"))
    known = F.col("steerer_state") == "known"
    merged = people.groupBy(*key).agg(F.sum("prs").alias("prs_merged"), F.count("identity_id").alias("contributors"), F.count(F.when(known, F.col("identity_id"))).alias("steerers"), F.sum(F.when(known, F.col("prs")).otherwise(0)).alias("known_prs"))
    both = opened.join(merged, key, "full")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("prs_opened", "prs_merged", "contributors", "steerers")]
    return both.select(*key, *zero, r6(ratio(F.col("prs_merged"), F.col("contributors"), 1.0)).alias("throughput"), r6(ratio(F.col("known_prs"), F.col("steerers"), 1.0)).alias("prs_per_steerer"))


def attribution_pair(a: Activity) -> DataFrame:
    """The two axes of attribution per organisation, all cells from one scan; people are counted as rows."""
    agent = F.col("executor_state") == "agent"
    per = commits_enriched(a).where("is_merge = 0 and is_shallow = 0").groupBy("owner", "steerer_state", "identity_id").agg(F.count("*").alias("commits"), n(agent).alias("agent"))

    def cell(state: str, what: Column) -> Column:
        return F.sum(F.when(F.col("steerer_state") == state, what).otherwise(0))

    ours, none = F.col("agent"), F.col("commits") - F.col("agent")
    cells = [cell("known", ours).alias("known_agent"), cell("known", none).alias("known_unknown"), cell("unknown", ours).alias("unknown_agent"), cell("unknown", none).alias("unknown_unknown"), cell("machine", F.col("commits")).alias("machine"), F.sum("commits").alias("commits"), n((F.col("steerer_state") == "known") & (F.col("agent") > 0)).alias("people_with_agents")]
    return per.groupBy("owner").agg(*cells)


def first_assisted(a: Activity) -> DataFrame:
    """First assisted commit of each known person in each scope."""
    rows = counted_commits(a).where("steerer_state = 'known' and is_ai_assisted = 1")
    per = rows.groupBy("repo_full_name", "owner", "identity_id").agg(F.min("authored_at").alias("first_at"))
    return scoped(per).groupBy("scope", "scope_key", "identity_id").agg(F.min("first_at").alias("first_at"))


def adopters_cumulative(a: Activity) -> DataFrame:
    """Adopters up to each month's end: new adopters, summed along a dense spine."""
    return cumulative(first_assisted(a))


def cumulative(firsts: DataFrame) -> DataFrame:
    """adopters_cumulative of first times (scope, scope_key, identity_id, first_at)."""
    first = firsts.withColumn("month_start", start("month", "first_at"))
    new = first.groupBy("scope", "scope_key", "month_start").agg(F.count("*").alias("new_adopters"))
    bounds = first.agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi"))
    dense = spine(first.select("scope", "scope_key").distinct(), bounds, "month", "month_start")
    up_to = Window.partitionBy("scope", "scope_key").orderBy("month_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = dense.join(new, ["scope", "scope_key", "month_start"], "left").withColumn("new_adopters", F.coalesce("new_adopters", F.lit(0)))
    return filled.select("scope", "scope_key", "month_start", "new_adopters", F.sum("new_adopters").over(up_to).alias("adopters"))


def mature(firsts: DataFrame, last: DataFrame, days: int) -> DataFrame:
    """First assisted commits whose window after is over by the last observed day (one row)."""
    return firsts.join(F.broadcast(last)).where(F.date_add(F.to_date("first_at"), days) <= F.col("last_day")).drop("last_day")


def adopters(a: Activity, days: int) -> DataFrame:
    """mature over all counted commits."""
    return mature(first_assisted(a), counted_commits(a).agg(F.max("day_start").alias("last_day")), days)


def before_after_volume(a: Activity) -> DataFrame:
    """Median change of personal commit counts in the windows before and after adoption, in every scope.

    Commits are counted once per person, time and assistance; first times, the last day and the windows are read from that.
    """
    who = ["scope", "scope_key", "identity_id"]
    person = ["repo_full_name", "owner", "identity_id"]
    counts = counted_commits(a).groupBy(*person, "steerer_state", "authored_at").agg(F.count("*").alias("c"), F.max("is_ai_assisted").alias("assisted"))
    times = stored(counts, "personal-times")
    known = times.where("steerer_state = 'known'")
    firsts = scoped(known.where("assisted = 1").groupBy(*person).agg(F.min("authored_at").alias("first_at"))).groupBy(*who).agg(F.min("first_at").alias("first_at"))
    width = F.expr(f"interval {WINDOW_DAYS} days")
    grown = mature(firsts, times.agg(F.max(F.to_date("authored_at")).alias("last_day")), WINDOW_DAYS)
    near = grown.join(scoped(known).select(*who, "authored_at", "c"), who).where((F.col("authored_at") >= F.col("first_at") - width) & (F.col("authored_at") < F.col("first_at") + width))
    side = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    per = near.groupBy(*who).agg(side(F.col("authored_at") < F.col("first_at")).alias("before"), side(F.col("authored_at") >= F.col("first_at")).alias("after"))
    deltas = per.where("before > 0").withColumn("delta", ratio(F.col("after") - F.col("before"), F.col("before")))
    key = ["scope", "scope_key"]
    deltas = stored(deltas, "personal-changes")
    sums = deltas.groupBy(*key).agg(F.count("*").alias("people"), F.sum("before").alias("commits_before"), F.sum("after").alias("commits_after"))
    return sums.join(at_ranks(deltas, key, "delta", MIDDLES), key).select(*key, "people", r6(median()).alias("median_delta_pct"), "commits_before", "commits_after")


def before_after_cycle(a: Activity, days: int = WINDOW_DAYS, least: int = FLOOR_PRS) -> DataFrame:
    """Median of personal changes of median cycle time around adoption, with enough reviews on both sides, in every scope."""
    who = ["scope", "scope_key", "identity_id"]
    prs = scoped(merged_prs(a)).where("steerer_state = 'known' and cycle_time_hours is not null").select(*who, "merged_at", "cycle_time_hours")
    width = F.expr(f"interval {days} days")
    near = adopters(a, days).join(prs, who).where((F.col("merged_at") >= F.col("first_at") - width) & (F.col("merged_at") < F.col("first_at") + width))
    phased = near.withColumn("phase", F.when(F.col("merged_at") < F.col("first_at"), 0).otherwise(1))
    sides = at_ranks(phased, [*who, "phase"], "cycle_time_hours", MIDDLES).withColumn("med", median())
    side = lambda p, c: F.max(F.when(F.col("phase") == p, F.col(c)))
    per = sides.groupBy(*who).agg(side(0, "n").alias("before_n"), side(1, "n").alias("after_n"), side(0, "med").alias("before_p50"), side(1, "med").alias("after_p50"))
    enough = per.where((F.col("before_n") >= least) & (F.col("after_n") >= least) & (F.col("before_p50") > 0))
    deltas = enough.withColumn("delta", ratio(F.col("after_p50") - F.col("before_p50"), F.col("before_p50")))
    key = ["scope", "scope_key"]
    return at_ranks(deltas, key, "delta", MIDDLES).select(*key, F.col("n").alias("people"), r6(median()).alias("median_delta_pct"))


def cycle_after_adoption(a: Activity) -> DataFrame:
    """The same with two years on each side and one review, for people who seldom have three merged within a window."""
    return before_after_cycle(a, 730, 1)


def author_period(a: Activity) -> DataFrame:
    """Commits and merged reviews per person, repository and week: both kinds of counts united, then added up in one shuffle."""
    key = ["identity_id", "repo_full_name", "week_start"]
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    c = counted_commits(a).where("identity_id is not null").groupBy(*key).agg(F.count("*").alias("commits"), n(F.col("is_ai_assisted") == 1).alias("ai_commits"), F.sum("insertions").alias("insertions")).withColumn("prs_merged", zero)
    p = merged_prs(a).where("identity_id is not null").groupBy("identity_id", "repo_full_name", F.col("merged_week_start").alias("week_start")).agg(F.count("*").alias("prs_merged")).select(*key, zero.alias("commits"), zero.alias("ai_commits"), none.alias("insertions"), "prs_merged")
    sums = ("commits", "ai_commits", "prs_merged", "insertions")
    return c.unionByName(p).groupBy(*key).agg(*[F.sum(x).alias(x) for x in sums])


def spine_dense(a: Activity) -> DataFrame:
    """Monthly commits of every repository, with zeros where nothing happened."""
    rows = counted_commits(a).groupBy("repo_full_name", "month_start").agg(F.count("*").alias("commits"))
    dense = spine(a.repos.where("is_shallow = 0").select(F.col("full_name").alias("repo_full_name")), rows.agg(F.min("month_start").alias("lo"), F.max("month_start").alias("hi")), "month", "month_start")
    return dense.join(rows, ["repo_full_name", "month_start"], "left").select("repo_full_name", "month_start", F.coalesce("commits", F.lit(0)).alias("commits"))


def top_n_fold(a: Activity, top: int = 3) -> DataFrame:
    """The largest repositories of each organisation, the remainder folded into one additive group."""
    volume = merged_prs(a).groupBy("owner", "repo_full_name").agg(F.count("*").alias("prs"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("prs"), "repo_full_name"))
    folded = volume.withColumn("panel", F.when(rank <= top, F.col("repo_full_name")).otherwise("OTHER"))
    return folded.groupBy("owner", "panel").agg(F.sum("prs").alias("prs"), F.count("*").alias("repos"))


def change_table(a: Activity) -> DataFrame:
    """Earlier against later half of the complete weeks; `new` where the earlier half is empty."""
    prs = merged_prs(a).select("repo_full_name", F.col("merged_week_start").alias("w"), "merged_at")
    bounds = prs.agg(F.min("w").alias("lo"), start("week", F.max("merged_at")).alias("current"))
    rows = prs.join(F.broadcast(bounds)).where("w < current")  # the last week is in progress
    weeks = F.datediff("current", "lo") / 7
    later = F.datediff("w", "lo") / 7 >= F.floor(weeks / 2)
    per = rows.groupBy("repo_full_name").agg(n(~later).alias("earlier"), n(later).alias("later"))
    change = F.when(F.col("earlier") == 0, "new").when(F.col("later") > F.col("earlier"), "up").when(F.col("later") < F.col("earlier"), "down").otherwise("flat")
    return per.select("repo_full_name", "earlier", "later", change.alias("trend"), r6(ratio(F.col("later") - F.col("earlier"), F.col("earlier"))).alias("change_pct"))


def precision_recall(a: Activity, least: float = 25.0) -> DataFrame:
    """How well size stands in for declared assistance, per organisation; counts and rates."""
    proxy, truth = F.col("insertions") >= least, F.col("is_ai_assisted") == 1
    per = counted_commits(a).groupBy("owner").agg(n(proxy & truth).alias("tp"), n(proxy & ~truth).alias("fp"), n(~proxy & truth).alias("fn"), F.count("*").alias("n"))
    return per.select("owner", "tp", "fp", "fn", "n", r6(ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), r6(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), r6(ratio(F.col("tp") + F.col("fn"), F.col("n"))).alias("base_rate"))


def first_trailer_dates(a: Activity) -> DataFrame:
    """When the first agent's trailer appears in each scope, and whose it is (ties to the smaller key)."""
    per = counted_commits(a).where("is_ai_assisted = 1").groupBy("repo_full_name", "owner", "agents").agg(F.min("authored_at").alias("at"))
    first = scoped(per).select("scope", "scope_key", "at", F.array_min(agents_in(F.col("agents"))).alias("agent_key")).groupBy("scope", "scope_key").agg(F.min(F.struct("at", "agent_key")).alias("f"))
    return first.select("scope", "scope_key", F.to_date("f.at").alias("first_ai_trailer_date"), F.col("f.agent_key").alias("agent_key"))


def iso_week_series(a: Activity) -> DataFrame:
    """Commits per ISO week label."""
    people = counted_commits(a).groupBy("week_start", "identity_id").agg(F.count("*").alias("commits"))
    return people.groupBy(iso_label(F.col("week_start")).alias("iso_week")).agg(F.sum("commits").alias("commits"), F.count("identity_id").alias("authors"))


def cohort_suppression(a: Activity) -> DataFrame:
    """Adopter shares with value and numerator withheld for small cohorts; the denominator stays."""
    people = counted_commits(a).where("identity_id is not null").groupBy("repo_full_name", "month_start", "identity_id").agg(F.max("is_ai_assisted").alias("adopter"))
    rows = people.groupBy("repo_full_name", "month_start").agg(F.count("*").alias("denominator"), F.sum("adopter").alias("numerator"))
    small = F.col("denominator") < COHORT
    note = F.nullif(F.concat_ws("; ", F.when(small, "suppressed: cohort below floor"), F.when(F.col("numerator") == 0, "no adopter")), F.lit(""))
    return rows.select("repo_full_name", "month_start", F.when(~small, F.col("numerator")).alias("numerator"), "denominator", r6(F.when(~small, ratio(F.col("numerator"), F.col("denominator")))).alias("value"), note.alias("note"))


def orphan_prs(a: Activity) -> DataFrame:
    """Merged reviews without any commit."""
    return a.pull_requests.where("state = 'MERGED'").join(a.commits.select("pr_id"), "pr_id", "left_anti").select("pr_id", "repo_id", "identity_id")


def in_subquery(a: Activity) -> DataFrame:
    """Commits of busy repositories, by semi joins on one key and on a pair of keys."""
    busy = a.commits.groupBy("repo_id").agg(F.count("*").alias("c"), F.avg("insertions").alias("m")).where("m > 25.5").select("repo_id")
    pairs = a.pull_requests.where("state = 'OPEN'").select("repo_id", "pr_id").distinct()
    kept = a.commits.join(busy, "repo_id", "left_semi").join(pairs, ["repo_id", "pr_id"], "left_semi")
    return kept.groupBy("repo_id").agg(F.count("*").alias("commits"), F.countDistinct("pr_id").alias("prs"))


def envelope_counters(a: Activity) -> DataFrame:
    """One row of counters about what was and was not counted."""
    c = commits_enriched(a).agg(F.count("*").alias("commits"), n(F.col("is_merge") == 1).alias("merges"), n(F.col("steerer_state") == "machine").alias("machine_commits"), n(F.col("is_unattributed") == 1).alias("unattributed"), n(F.col("is_shallow") == 1).alias("in_shallow"), n(F.col("is_ai_assisted") == 1).alias("assisted"), F.min("day_start").alias("first_day"), F.max("day_start").alias("last_day"))
    p = prs_enriched(a).agg(F.count("*").alias("prs"), n(F.col("state") == "MERGED").alias("merged"), n(F.col("class") == "unclassified").alias("unclassified"), n(F.col("cycle_time_hours").isNull() & (F.col("state") == "MERGED")).alias("no_cycle_time"))
    return c.join(p)  # one row each


def excluded_actors(a: Activity) -> DataFrame:
    """Work of machines and excluded people, counted on both axes."""
    bots = commits_enriched(a).where("is_merge = 0 and steerer_state = 'machine'").agg(F.count("*").alias("bot_commits"))
    return bots.join(prs_enriched(a).where("steerer_state = 'machine' and state = 'MERGED' and merged_at is not null").agg(F.count("*").alias("bot_prs_merged")))


def partial_buckets(a: Activity, ceiling: str = "1998-06-15") -> DataFrame:
    """Weeks and months of a repository's commits up to a ceiling, flagged where the bucket is not over."""
    until = F.lit(ceiling).cast("date")
    rows = pivoted(counted_commits(a), "authored_at").where((F.col("day_start") <= until) & F.col("period_kind").isin("week", "month"))
    flag = F.when(F.col("period_kind") == "week", (following("week", F.col("period_start")) > F.date_add(until, 1)).cast("long")).otherwise((following("month", F.col("period_start")) > F.date_add(until, 1)).cast("long"))
    return rows.groupBy("owner", "period_kind", "period_start").agg(F.count("*").alias("commits")).select("owner", "period_kind", "period_start", "commits", flag.alias("is_partial"))
