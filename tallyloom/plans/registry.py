"""Name -> callable for every activity query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.buckets import ratio, start
from tallyloom.functions.rules import first_pattern, matches_any
from tallyloom.functions.text import blocks, body_chars, capped, flattened, for_script, has_body, normal_url
from tallyloom.operators import classify, gates, mining, pages, quality, rollups, sessions, upsert
from tallyloom.operators.conform import commits_enriched, prs_enriched
from tallyloom.operators.rollups import n, r6
from tallyloom.plans import records, runbook, scale
from tallyloom.session import shared_dir, ship, table
from tallyloom.sources.adapter import Activity
from tallyloom.streaming import arrivals


def over(f):
    """A query from a function of the activity model."""
    return lambda spark, sf_dir: f(Activity(spark, sf_dir))


def q02(a: Activity) -> DataFrame:
    return commits_enriched(a).select("repo_full_name", "owner", "sha", "identity_id", "day_start", "week_start", "month_start", F.col("is_merge").cast("long").alias("is_merge"), F.col("is_ai_assisted").cast("long").alias("is_ai_assisted"), F.col("is_unattributed").cast("long").alias("is_unattributed"), "steerer_state", "executor_state", "executor_agent_key", "insertions")


def q03(a: Activity) -> DataFrame:
    return prs_enriched(a).select("pr_id", "repo_full_name", "owner", "identity_id", "state", "merged_day_start", "merged_week_start", "merged_month_start", r6(F.col("cycle_time_hours")).alias("cycle_time_hours"), "class", F.col("is_revert").cast("long").alias("is_revert"), F.col("is_ai_assisted").cast("long").alias("is_ai_assisted"), "steerer_state", "executor_state")


def q23(a: Activity) -> DataFrame:
    """Two loads of the same keys; the later one wins."""
    rows = a.raw("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("seen_at"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("quantity"))
    latest = upsert.last_wins(rows, ["l_orderkey", "l_linenumber"], ["seen_at", "l_partkey", "l_suppkey", "quantity"])
    return latest.groupBy("l_linenumber").agg(F.count("*").alias("keys"), F.round(F.sum("quantity"), 2).alias("quantity"), F.max("seen_at").cast("date").alias("last_seen"), F.sum("l_partkey").alias("parts")).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


def q23b(a: Activity) -> DataFrame:
    """Column-preserving upsert, insert-if-absent, lowering floor and accumulating counter, in one row per key class."""
    orders = a.raw("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("price"))
    old = orders.where("s = 'F'").groupBy("k").agg(F.max("price").alias("price"), F.lit("old").alias("note"))
    new = orders.where("s = 'P'").groupBy("k").agg(F.max(F.when(F.col("price") > 200000, F.col("price"))).alias("price"), F.lit("new").alias("note"))
    kept = upsert.preserving(old, new, ["k"], owned=("note",)).groupBy("note").agg(F.count("*").alias("keys"), F.round(F.sum("price"), 2).alias("price")).select(F.concat(F.lit("preserving/"), F.coalesce("note", F.lit("none"))).alias("step"), "keys", "price")
    absent = upsert.if_absent(old, new, ["k"]).groupBy("note").agg(F.count("*").alias("keys"), F.round(F.sum("price"), 2).alias("price")).select(F.concat(F.lit("if_absent/"), "note").alias("step"), "keys", "price")
    floor = upsert.lowest(old, new, ["k"], "price").agg(F.lit("lowest").alias("step"), F.count("*").alias("keys"), F.round(F.sum("price"), 2).alias("price"))
    total = upsert.accumulated(old, new, ["k"], "price").agg(F.lit("accumulated").alias("step"), F.count("*").alias("keys"), F.round(F.sum("price"), 2).alias("price"))
    return kept.unionByName(absent).unionByName(floor).unionByName(total)


def late(events: DataFrame) -> DataFrame:
    """Events that arrive after the first load: every seventh, spread over all days."""
    return events.where("event_id % 7 = 0 and event_id % 2 = 0")


def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    arrived = late(events)
    buckets = arrivals.affected(arrived, "day", "ts", events.select(start("day", "ts").alias("bucket")).distinct().orderBy(F.desc("bucket")).limit(2))
    return buckets.select(F.col("bucket").alias("day"))


def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    arrived = late(events)
    first = arrivals.daily(events.join(arrived.select("event_id"), "event_id", "left_anti"))
    return arrivals.recomputed(first, events, arrived).select(F.col("bucket").alias("day"), "event_type", "events", "users", "value")


def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, labels and branches composed from reviews, classified; classes and rules counted."""
    titles = ["feat(ui): {n} panel", "Fix crash in view {n}", "chore(deps): bump lib to {n}", 'Revert "feat {n}"', "Update the thing {n}", "docs: page {n}", "v1.2.{n}", "Add support for {n}", "WIP: exploring {n}", "Opaque {n}"]
    labels = ["", "type: bug", "enhancement", "bug, enhancement", "needs-review", "kind/docs", ""]
    heads = ["mf/x", "feature/{n}", "hotfix/{n}", "develop", "", "mf/y", "mf/z", "dependabot/npm/{n}", "mf/q", "release/{n}", "mf/r"]
    number = F.col("o_orderkey") % 1000
    pick = lambda values: F.replace(F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int")), F.lit("{n}"), number.cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pick(titles).alias("title"), pick(labels).alias("label_csv"), pick(heads).alias("head_ref"), F.lit("main").alias("base_ref"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("has_issue_link"), F.lit(0).alias("is_dep_bot"))
    done = classify.classified(rows)
    return done.groupBy("class", F.when(F.col("class") == "unclassified", F.col("gap")).otherwise(F.col("rule")).alias("reason"), "method").agg(F.count("*").alias("prs"), F.sum("is_revert").alias("reverts"), F.sum((F.col("confidence") < 0.7).cast("int")).alias("weak"), F.min("o_orderkey").alias("first_pr"))


def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = [("metal", "brass|steel|tin"), ("early", "^[a-f]"), ("promo", "promo"), ("vowel", "[aeiou]{2}"), ("other", ".")]
    parts = table(spark, sf_dir, "part").select(first_pattern(F.concat_ws(" ", "p_name", "p_type"), patterns).alias("hit"), "p_retailprice")
    return parts.groupBy("hit").agg(F.count("*").alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"))


def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", has_body(F.col("text")).alias("has_body"), body_chars(F.col("text")).alias("body_chars"), F.length(capped(flattened(F.col("text")), 80)).cast("long").alias("subject_chars"))


def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("needle"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), "text"))
    return quality.identifiers_in(docs, needles).select("doc_id", "found")


def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.findings(table(spark, sf_dir, "pages")).select("page_id", "severity", "code")


def q32b(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.findings(table(spark, sf_dir, "pages"))


def q32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pages.internal_links(table(spark, sf_dir, "pages"))


def q32d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reached from each host's first page, by round."""
    ship(spark)
    return pages.crawled(table(spark, sf_dir, "pages"))


def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.severity_histogram(q32(spark, sf_dir))


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.signals(turns_of(spark, sf_dir)).select("session", "turns", "actions", "verifications", "errors", "forced", "chars", F.length("prompt").cast("long").alias("prompt_chars"))


def incidents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents from event streams of users: a session is a user's day."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session"), "user_id").agg(F.count("*").alias("turns"), n(F.col("event_type") == "click").alias("actions"), n(F.col("event_type") == "view").alias("verifications"), n(F.col("event_type") == "error").alias("errors"), n(F.col("event_type") == "signup").alias("recoveries"), n((F.col("event_type") == "error") & (F.col("value") > 50)).alias("gaps"), n((F.col("event_type") == "click") & (F.col("value") > 90)).alias("forced"), n(F.col("event_type") == "purchase").alias("deploys"), F.sum(F.floor("value")).cast("long").alias("chars"))
    return sessions.incidents(per)


def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_of(spark, sf_dir).select("session", "code", "evidence")


def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incidents_of(spark, sf_dir).withColumn("user_group", F.floor(F.col("session") / 100) % 10)
    return sessions.recurrence(found, ["user_group", "code"]).select(F.col("user_group").cast("long").alias("user_group"), "code", "incidents", "exemplar", "session")


def q35b(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incidents_of(spark, sf_dir).withColumn("day", F.col("session") % 100)
    return sessions.trend(found.where("day between 15 and 21"), found.where("day between 8 and 14"))


def ci_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check evidence composed from reviews and their lines."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))).alias("ls"))
    rows = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lines = F.coalesce("ls", F.array())
    run = lambda x: F.struct(F.concat(F.lit("check-"), x["l_linenumber"]).alias("name"), F.when((x["l_linestatus"] == "O") & (x["l_partkey"] % 2 == 0), "queued").otherwise("completed").alias("status"), F.when(x["l_returnflag"] == "R", "failure").otherwise("success").alias("conclusion"))
    return rows.select(
        "o_orderkey",
        F.transform(lines, run).alias("check_runs"),
        F.expr("if(o_orderkey % 4 = 0, array(struct('lint' as context, if(o_orderkey % 8 = 0, 'success', 'pending') as state)), cast(array() as array<struct<context:string,state:string>>))").alias("commit_statuses"),
        F.expr("if(o_orderkey % 3 = 0, array('check-1'), cast(array() as array<string>))").alias("expected_checks"),
        F.expr("if(o_orderkey % 2 = 0, array('ci.yml'), cast(array() as array<string>))").alias("pr_workflows"),
        (F.col("o_orderkey") % 11 != 0).alias("check_runs_ok"),
        (F.col("o_orderkey") % 13 != 0).alias("commit_statuses_ok"),
        F.lit(True).alias("expected_checks_ok"),
        F.lit(True).alias("pr_workflows_ok"),
    )


def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci_payloads(spark, sf_dir).withColumn("v", gates.ci_verdict()).groupBy("v.classification", "v.reason").agg(F.count("*").alias("prs"))


def q37b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head decisions and merge authority over composed heads."""
    o = table(spark, sf_dir, "orders")
    reviewed = F.sha1(F.col("o_orderkey").cast("string").cast("binary"))
    live = F.when(F.col("o_orderkey") % 3 == 0, reviewed).when(F.col("o_orderkey") % 3 == 1, F.sha1(F.concat(F.col("o_orderkey").cast("string"), F.lit("x")).cast("binary"))).otherwise(F.lit("short"))
    policies = F.filter(F.array(F.when(F.col("o_orderkey") % 2 == 0, "ship"), F.when(F.col("o_orderkey") % 5 == 0, "hold")), lambda x: x.isNotNull())
    return o.groupBy(gates.head_decision(reviewed, live, F.col("o_orderkey") % 2).alias("decision"), gates.merge_authority(policies).alias("authority")).agg(F.count("*").alias("prs"))


def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    scope = F.when(F.col("p_size") % 2 == 0, "runtime").otherwise("development")
    manifest = F.when(F.col("p_size") % 3 == 0, "Tests/pkg.json").otherwise("app/pkg.json")
    bump = F.element_at(F.array(*map(F.lit, ("patch", "minor", "major"))), (F.col("p_size") % 3 + 1).cast("int"))
    direct, runtime = F.col("p_partkey") % 2 == 0, F.col("p_size") % 2 == 0
    risk = gates.bump_risk(bump, direct, runtime, F.col("p_partkey") % 50 == 0)
    action = gates.merge_action(F.col("p_partkey") % 10 != 1, F.col("p_partkey") % 15 != 2, risk, direct)
    return p.groupBy(gates.alert_priority(severity, scope, manifest).alias("priority"), risk.alias("risk"), action.alias("action")).agg(F.count("*").alias("alerts"))


def q38b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness scores, tiers and grades of suppliers' composed dimensions."""
    s = table(spark, sf_dir, "supplier")
    dims = [((F.col("s_suppkey") * (i + 3)) % 11).alias(name) for i, name in enumerate(gates.READINESS)]
    scored = s.select("s_suppkey", *dims).withColumn("score", gates.readiness_score(F.col("s_suppkey") % 3 != 0))
    red, yellow = F.col("s_suppkey") % 4, F.col("s_suppkey") % 3
    return scored.select("s_suppkey", F.round("score", 6).alias("score"), gates.readiness_tier(F.col("score")).alias("tier"), gates.grade(red, yellow, F.col("s_suppkey") % 7 != 0).alias("grade"))


def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of part types and names, selected by ordered globs: all that match, and the first."""
    rules = [("ring", ["*/*/ring"]), ("small", ["SMALL/**"]), ("warm", ["**/hot/*", "PROMO/*/g?zmo"]), ("flat", ["*"]), ("any", ["**"])]
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_type", F.replace("p_name", F.lit(" "), F.lit("/"))).alias("path"))
    hits = F.filter(F.array(*[F.when(matches_any(F.col("path"), globs, segments=True), F.lit(name)) for name, globs in rules]), lambda x: x.isNotNull())
    found = parts.select("p_partkey", hits.alias("hits")).select("p_partkey", F.explode("hits").alias("rule"), F.element_at("hits", 1).alias("first_rule"))
    return found.groupBy("rule").agg(F.count("*").alias("paths"), n(F.col("rule") == F.col("first_rule")).alias("first_hits"))


def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 3).select(F.col("a"), F.col("b"), "together")


def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return mining.hotspots(li, "l_partkey", "p_size", "l_suppkey").select("l_partkey", "churn", "authors", F.col("size").cast("long").alias("size"), "score").orderBy(F.desc("score"), "l_partkey").limit(50)


def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    nodes = o.select(F.col("o_orderkey").alias("node"))
    edges = o.where("o_orderkey > 1").select(F.floor(F.col("o_orderkey") / 3).alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("weight"))
    return mining.waves(nodes, edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage ledger made of events."""
    method = F.when(F.col("event_type") == "error", "llm").when(F.col("event_type") == "view", "script-with-fallback").otherwise("script")
    return table(spark, sf_dir, "events").select(F.dayofmonth("ts").cast("long").alias("run_id"), F.when(F.col("user_id") % 2 == 0, "commit").otherwise("pr").alias("unit_kind"), method.alias("method"), F.when(F.col("value") > 50, F.col("event_type")).alias("detail"))


def coverage_by_run(ledger: DataFrame) -> DataFrame:
    script, mixed = F.col("method") == "script", F.col("method") == "script-with-fallback"
    per = ledger.groupBy("run_id", "unit_kind").agg(F.count("*").alias("total"), n(script).alias("n_script"), n(mixed).alias("n_script_fallback"), n(F.col("method") == "llm").alias("n_llm"))
    return per.select("*", F.round(ratio(F.col("n_script") + F.col("n_script_fallback"), F.col("total")), 4).alias("coverage_pct"), F.round(ratio(F.col("n_script"), F.col("total")), 4).alias("pure_script_pct"))


def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_by_run(coverage(spark, sf_dir))


def q44b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a ledger that was appended to batch by batch, one of them twice."""
    ledger, rows = upsert.Ledger(f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"), coverage(spark, sf_dir)
    for batch, part in (("early", "run_id < 12"), ("late", "run_id >= 12"), ("early", "run_id < 12")):
        ledger.append(rows.where(part), batch)
    return coverage_by_run(ledger.read(spark).withColumn("run_id", F.col("run_id").cast("long")))


def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage(spark, sf_dir).where("method = 'llm'")
    return rows.groupBy("unit_kind", F.coalesce("detail", F.lit("(no reason recorded)")).alias("reason")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "unit_kind", "reason").limit(25)


def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a drained stream with a durable cursor; batches may repeat, counts do not."""
    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    batch = table(spark, sf_dir, "events")
    sink = arrivals.keyed_sink(f"{work}/out", ["event_id"], ["ts"])
    arrivals.drain(spark, sf_dir, batch.schema, sink, f"{work}/cursor", "events.parquet")
    merged = upsert.last_wins(spark.read.parquet(f"{work}/out").drop("batch"), ["event_id"], ["ts"])
    return arrivals.daily(merged).select(F.col("bucket").alias("day"), "event_type", "events", "users", "value")


def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.event_windows(table(spark, sf_dir, "events"))


def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in normal form, and blocks of comments in page text."""
    p = table(spark, sf_dir, "pages")
    noisy = F.concat(F.replace(F.col("url"), F.lit("http"), F.lit("HTTP")), F.lit("#part"))
    return p.select("page_id", normal_url(noisy).alias("url"), F.size(blocks(F.col("html"), "note")).cast("long").alias("notes"), (F.length(for_script(F.to_json(F.struct(F.lit("</x>").alias("a"))))) > 0).cast("long").alias("safe"))


def q49(a: Activity) -> DataFrame:
    """Receipts with hex-encoded fields, encoded, decoded and compared; stale ones marked."""
    r = a.raw("customer").select("c_custkey", F.hex(F.encode("c_name", "UTF-8")).alias("name_hex"), "c_name", F.col("c_acctbal"))
    back = r.withColumn("name", F.decode(F.unhex("name_hex"), "UTF-8"))
    return back.groupBy((F.col("name") == F.col("c_name")).cast("long").alias("round_trip"), F.when(F.col("c_acctbal") < 0, "stale").otherwise("fresh").alias("state")).agg(F.count("*").alias("receipts"), F.min("name_hex").alias("first_hex"))


def q50(a: Activity) -> DataFrame:
    """Weekly scorecard: planned, merged, rework, and the most frequent class of work (ties by name)."""
    prs = prs_enriched(a).where("is_shallow = 0").withColumn("week_start", start("week", "created_at"))
    per = prs.groupBy("week_start").agg(F.count("*").alias("planned"), n(F.col("state") == "MERGED").alias("merged"), n(F.col("is_revert") == 1).alias("reverts"))
    top = prs.groupBy("week_start", "class").agg(F.count("*").alias("c")).groupBy("week_start").agg(F.min(F.struct((-F.col("c")).alias("m"), "class"))["class"].alias("top_class"))
    return per.join(top, "week_start").select("*", F.round(ratio(F.col("merged"), F.col("planned")), 4).alias("merged_pct"), F.round(ratio(F.col("reverts"), F.col("merged")), 4).alias("rework_pct"))


def q51(a: Activity) -> DataFrame:
    """Regressions: kinds of failure on the head (later half of a year) that the base did not have, and drift of digests."""
    e = a.raw("events").select("user_id", "event_type", F.dayofmonth("ts").alias("d"))
    base, head = e.where("d <= 15 and event_type = 'error'").select("user_id").distinct(), e.where("d > 15 and event_type = 'error'").select("user_id").distinct()
    fresh = head.join(base, "user_id", "left_anti").withColumn("kind", F.lit("regression"))
    gone = base.join(head, "user_id", "left_anti").withColumn("kind", F.lit("fixed"))
    return fresh.unionByName(gone).unionByName(base.join(head, "user_id", "left_semi").withColumn("kind", F.lit("still")))


def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret-shaped tokens per document."""
    d = table(spark, sf_dir, "documents")
    kinds = {"cloud-key": r"AKIA[0-9A-Z]{16}", "token": r"token = \"[0-9a-f]{40}\"", "password": r"password=[0-9a-f]{8,}", "private-key": r"-----BEGIN"}
    rows = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in kinds.items()]), lambda x: x.isNotNull())
    return d.select("doc_id", F.explode(rows).alias("kind"))


QUERIES = {
    "q01_weekly_delivery": over(rollups.weekly_delivery),
    "q02_commits_enriched": over(q02),
    "q03_prs_enriched": over(q03),
    "q04_period_pivot": over(rollups.period_pivot),
    "q05_cycle_percentiles": over(rollups.cycle_percentiles),
    "q06_bus_factor": over(rollups.bus_factor),
    "q07_agent_mix": over(rollups.agent_mix),
    "q08_agent_share": over(rollups.agent_share),
    "q09_ratio_metrics": over(rollups.ratio_metrics),
    "q09b_commit_metrics": over(rollups.commit_metrics),
    "q09c_throughput": over(rollups.throughput),
    "q10_attribution_pair": over(rollups.attribution_pair),
    "q11_adopters_cumulative": over(rollups.adopters_cumulative),
    "q12_before_after_volume": over(rollups.before_after_volume),
    "q13_before_after_cycle": over(rollups.before_after_cycle),
    "q13b_cycle_after_adoption": over(rollups.cycle_after_adoption),
    "q13c_first_trailer_dates": over(rollups.first_trailer_dates),
    "q14_author_period": over(rollups.author_period),
    "q15_spine_dense": over(rollups.spine_dense),
    "q16_top_n_fold": over(rollups.top_n_fold),
    "q17_change_table": over(rollups.change_table),
    "q18_precision_recall": over(rollups.precision_recall),
    "q19_iso_week_series": over(rollups.iso_week_series),
    "q20_cohort_suppression": over(rollups.cohort_suppression),
    "q21_orphan_prs": over(rollups.orphan_prs),
    "q22_in_subquery": over(rollups.in_subquery),
    "q23_upsert_latest": over(q23),
    "q23b_upserts": over(q23b),
    "q24_affected_buckets": q24,
    "q25_incremental_equals_full": q25,
    "q26_bucket_property_check": lambda spark, sf_dir: quality.bucket_properties(table(spark, sf_dir, "events")),
    "q26b_bucket_mismatches": over(quality.bucket_mismatches),
    "q27_conservation": over(quality.conservation),
    "q28_classify_titles": q28,
    "q29_pattern_first_match": q29,
    "q30_body_measure": q30,
    "q31_pii_scan": q31,
    "q32_page_findings": q32,
    "q32b_page_findings_all": q32b,
    "q32c_crawl_frontier": q32c,
    "q32d_crawl_rounds": q32d,
    "q33_session_signals": q33,
    "q34_incident_taxonomy": q34,
    "q35_recurrence": q35,
    "q35b_incident_trend": q35b,
    "q36_severity_histogram": q36,
    "q37_ci_verdict": q37,
    "q37b_head_decisions": q37b,
    "q38_risk_matrix": q38,
    "q38b_readiness": q38b,
    "q39_glob_join": q39,
    "q40_cooccurrence": q40,
    "q41_hotspots": q41,
    "q42_topological_waves": q42,
    "q43_envelope_counters": over(rollups.envelope_counters),
    "q43b_excluded_actors": over(rollups.excluded_actors),
    "q43c_partial_buckets": over(rollups.partial_buckets),
    "q44_coverage_by_run": q44,
    "q44b_ledger": q44b,
    "q45_backlog": q45,
    "q46_stream_daily_counts": q46,
    "q47_event_windows": q47,
    "q48_url_forms": q48,
    "q49_receipts": over(q49),
    "q50_scorecard": over(q50),
    "q51_regressions": over(q51),
    "q52_secret_scan": q52,
}


def queries() -> dict:
    """Every activity query."""
    return QUERIES | runbook.QUERIES | records.QUERIES | scale.QUERIES
