"""Queries over mission logs, catalogues, runs, cursors and review lists, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.buckets import ratio, start, window_start
from tallyloom.functions.text import section
from tallyloom.operators import classify, missions, pages, quality, sessions
from tallyloom.operators.conform import commits_enriched, prs_enriched
from tallyloom.operators.rollups import n, ratio_metrics
from tallyloom.session import table
from tallyloom.sources import framed
from tallyloom.sources.adapter import Activity
from tallyloom.streaming import arrivals

#: Log messages that an event stands for, by its number modulo their count.
MESSAGES = (
    "Bash command: git checkout -b feat/x", "Bash command: git commit -m x", "Bash command: git push origin", "Bash command: git push --force origin", "Bash command: gh pr create", "Bash command: gh issue close 5",
    "Bash command: git log --remotes", "Bash command: curl https://x.org", "Edit file_path: src/a.py", "Write file_path: src/b.py", "Write file_path: reports/c.md", "Read file_path: .claude/skills/ops/SKILL.md", "Agent started",
    "error: ENOENT no such file", "Bash command: cat RULES.md", "error: boom", "Bash command: retry build", "AskUserQuestion again", "usage input_tokens: 120 output_tokens: 30", "task: deploy the site", "bootstrap", "invoking claude", "first token", "all done",
)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of mission logs, written as a stream writes them and parsed again; a session is four days of a user."""
    e = table(spark, sf_dir, "events")
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    raw = F.concat(F.lit("data: "), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.struct(message.alias("text")).alias("message"))))
    lines = e.select((F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 4)).alias("session"), F.col("event_id").alias("seq"), raw.alias("value"))
    parsed = sessions.events_of(lines, keep=("seq",))
    return parsed.select("session", F.to_timestamp_ntz("timestamp").alias("at"), "seq", F.col("text").alias("message"))


LOG = """
WITH e AS (SELECT (user_id * 10 + extract(day FROM ts) // 4)::BIGINT AS session, ts, event_id, event_id % 24 AS k FROM events),
s AS (SELECT session, count(*) AS lines, count(*) FILTER (k IN (0,1,2,3,4,5,6,7,8,9,10,12,14,16)) AS actions, count(*) FILTER (k = 12) AS workers, count(*) FILTER (k = 8) AS edits, count(*) FILTER (k = 17) AS questions, count(*) FILTER (k = 7) AS verifications, count(*) FILTER (k IN (13, 15)) AS errors, count(*) FILTER (k = 13) AS gaps, count(*) FILTER (k = 16) AS recoveries,
  count(*) FILTER (k = 3) AS forced, count(*) FILTER (k = 9) AS unexpected_writes, bool_or(k = 9) AS wrote_code, bool_or(k = 14) AS rules_read, count(*) FILTER (k = 11) AS skills, bool_or(k = 0) AS branched, bool_or(k = 1) AS committed, bool_or(k IN (2, 3)) AS pushed, bool_or(k = 3) AS force_pushed, bool_or(k = 4) AS pr_created, bool_or(k = 5) AS issue_closed, bool_or(k = 6) AS push_verified, bool_or(k = 7) AS curled,
  bool_or(k = 19) AS deploys, 120 * count(*) FILTER (k = 18) AS input_tokens, 30 * count(*) FILTER (k = 18) AS output_tokens, min(ts) FILTER (k = 20) AS started, min(ts) FILTER (k = 21) AS called, min(ts) FILTER (k = 22) AS answered, min(ts) FILTER (k = 23) AS done, max(ts) AS ended_at FROM e GROUP BY 1),
i AS (SELECT session, 'SV' AS code, 'no-verification' AS rule, actions || ' actions' AS evidence FROM s WHERE actions > 5 AND verifications = 0 UNION ALL SELECT session, 'MB', 'rules-read-yet-errors', errors || ' errors' FROM s WHERE rules_read AND errors >= 2
  UNION ALL SELECT session, 'SF', 'no-recovery', errors || ' errors' FROM s WHERE errors >= 2 AND recoveries = 0 UNION ALL SELECT session, 'UA', 'deployment-unchecked', 'seen in commands' FROM s WHERE deploys AND NOT curled UNION ALL SELECT session, 'UB', 'forced-commands', forced || ' forced' FROM s WHERE forced > 0
  UNION ALL SELECT session, 'ID', 'writes-elsewhere', unexpected_writes || ' unexpected_writes' FROM s WHERE unexpected_writes > 3 UNION ALL SELECT session, 'SG', 'missing-capability', gaps || ' gaps' FROM s WHERE gaps > 0 UNION ALL SELECT session, 'CF', 'many-workers', workers || ' workers' FROM s WHERE workers >= 3
  UNION ALL SELECT session, 'SV', 'committed-to-main', 'seen in commands' FROM s WHERE committed AND NOT branched AND NOT pr_created UNION ALL SELECT session, 'SF', 'never-pushed', 'seen in commands' FROM s WHERE committed AND NOT pushed
  UNION ALL SELECT session, 'UA', 'closed-unverified', 'seen in commands' FROM s WHERE issue_closed AND NOT push_verified UNION ALL SELECT session, 'UB', 'force-pushed', 'seen in commands' FROM s WHERE force_pushed)
"""


def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missions.incidents(missions.signals(log_lines(spark, sf_dir)))


def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = missions.signals(log_lines(spark, sf_dir))
    k = F.col("session")
    tasks = signal.select("session", F.when(k % 2 == 0, "Implement x").otherwise("look at x").alias("task"), (k % 3 != 0).alias("has_report"))
    kept = missions.compliance(signal, tasks)
    return kept.select("session", *[F.col(c).cast("long").alias(c) for c in kept.columns if c != "session"])


Q64 = LOG + """SELECT session, (questions = 0)::BIGINT AS r1_headless, (edits = 0 AND NOT wrote_code)::BIGINT AS r3_no_code, (skills > 0)::BIGINT AS r4_read_skills, (verifications > 0)::BIGINT AS r6_verify, (session % 3 <> 0)::BIGINT AS r7_report, branched::BIGINT AS r_branch, pushed::BIGINT AS r_push, (pr_created OR session % 2 <> 0)::BIGINT AS r_pr FROM s"""


def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missions.missed(missions.signals(log_lines(spark, sf_dir))).groupBy(F.coalesce("missed", F.lit("none")).alias("missed")).agg(F.count("*").alias("sessions"))


Q65 = LOG + """, c AS (SELECT session, bool_or(code = 'SF') AS sf, bool_or(code = 'SV') AS sv, bool_or(code = 'UA') AS ua, bool_or(code = 'SG') AS sg FROM i GROUP BY 1)
SELECT CASE WHEN sf AND NOT pushed THEN 'push-and-verify' WHEN sv AND committed AND NOT branched THEN 'branch-and-review' WHEN ua AND issue_closed THEN 'verify-before-closing' WHEN sv THEN 'verify-before-exit' WHEN sg THEN 'load-the-skill' WHEN ua THEN 'check-the-deployment' ELSE 'none' END AS missed, count(*) AS sessions FROM s LEFT JOIN c USING (session) GROUP BY 1"""


def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    return missions.timings(missions.signals(lines), lines.groupBy("session").agg(F.max("at").alias("ended_at")))


Q66 = LOG + """SELECT session, (epoch_us(called) // 1000 - epoch_us(started) // 1000) AS cold_start_ms, (epoch_us(answered) // 1000 - epoch_us(called) // 1000) AS first_token_ms, (epoch_us(ended_at) // 1000 - epoch_us(done) // 1000) AS done_to_ended_ms, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, round(input_tokens * 3e-6 + output_tokens * 15e-6, 6) AS cost FROM s"""


def q67(a: Activity) -> DataFrame:
    """Cursors of repositories against their histories: those of rewritten ones start over; then which runs move them."""
    commits = commits_enriched(a).select("repo_id", "sha")
    newest = commits.groupBy("repo_id").agg(F.max("sha").alias("sha"))
    k = F.col("repo_id")
    cursors = newest.select("repo_id", F.when(k % 5 == 0, F.lit(None)).when(k % 3 == 0, F.concat(F.lit("gone-"), "sha")).otherwise(F.col("sha")).alias("sha"))
    starts = arrivals.start_points(cursors, commits, ["repo_id"], "sha")
    runs = newest.select("repo_id", F.concat(F.lit("z"), "sha").alias("sha"), F.when(k % 2 == 0, "ok").otherwise("partial").alias("status"))
    after = arrivals.advanced(cursors, runs, ["repo_id"], "sha").select("repo_id", F.col("sha").alias("after"))
    return starts.withColumnRenamed("sha", "starts_at").join(after, "repo_id").select("repo_id", "starts_at", "state", "after")


Q67 = """, m AS (SELECT repo_id, max(sha) AS sha FROM ce GROUP BY 1)
SELECT repo_id, CASE WHEN repo_id % 5 <> 0 AND repo_id % 3 <> 0 THEN sha END AS starts_at, CASE WHEN repo_id % 5 = 0 THEN 'first' WHEN repo_id % 3 = 0 THEN 'rewritten' ELSE 'resumed' END AS state,
  CASE WHEN repo_id % 2 = 0 THEN 'z' || sha WHEN repo_id % 5 = 0 THEN NULL WHEN repo_id % 3 = 0 THEN 'gone-' || sha ELSE sha END AS after FROM m"""


def q68(a: Activity) -> DataFrame:
    """Which repositories' rollups are computed afresh, and why."""
    commits = commits_enriched(a).select(F.col("repo_full_name").alias("repo"), "repo_id", "week_start").distinct()
    stored = commits.where("repo_id % 4 != 0").select("repo", F.when((F.col("repo_id") % 3 == 0) & (F.dayofmonth("week_start") < 8), "1-old").otherwise("1-new").alias("version"))
    modes = arrivals.rebuild_modes(commits, stored, "repo", "1-new").withColumn("run", F.lit("plain"))
    return modes.unionByName(arrivals.rebuild_modes(commits, stored, "repo", "1-new", rebuild=True).withColumn("run", F.lit("rebuild")))


Q68 = """, w AS (SELECT DISTINCT repo_full_name AS repo, repo_id, week_start FROM ce), m AS (SELECT repo, CASE WHEN repo_id % 4 = 0 THEN 'first-run' WHEN repo_id % 3 = 0 AND bool_or(extract(day FROM week_start) < 8) THEN 'version-change' ELSE 'incremental' END AS mode FROM w GROUP BY repo, repo_id)
SELECT repo, mode, 'plain' AS run FROM m UNION ALL SELECT repo, 'rebuild', 'rebuild' FROM m"""


def q69(a: Activity) -> DataFrame:
    """A limited pass over reviews without a class, and what it defers."""
    due = prs_enriched(a).where("class = 'unclassified'").select("pr_id")
    batch, counts = quality.limited(due, "pr_id", 500)
    return counts.join(batch.agg(F.min("pr_id").alias("first_pr"), F.max("pr_id").alias("last_pr")))  # one row each


Q69 = """, d AS (SELECT pr_id FROM pe WHERE class = 'unclassified'), b AS (SELECT pr_id FROM d ORDER BY pr_id LIMIT 500)
SELECT (SELECT count(*) FROM d) AS due, (SELECT count(*) FROM b) AS taken, (SELECT count(*) FROM d) - (SELECT count(*) FROM b) AS deferred, (SELECT min(pr_id) FROM b) AS first_pr, (SELECT max(pr_id) FROM b) AS last_pr"""

CATALOG = [
    ("quality.defect_ratio", 0, None, None), ("quality.revert_rate", 0, None, None), ("impact.innovation_ratio", 1, "classes stand for intent", ""), ("adoption.ai_pr_share", 1, "trailers stand for use", "use without a trailer"),
    ("meta.unclassified_pr_share", 0, None, None), ("effectiveness.dxi", 0, None, None), ("adoption.multiline_commit_share", 1, None, "anything else"),
]


def q70(a: Activity) -> DataFrame:
    """What a dashboard refuses or warns of: metrics without a catalogue row, proxies that don't disclose themselves, runs never finished."""
    catalog = a.spark.createDataFrame(CATALOG, "metric_key string, is_proxy int, proxy_statement string, cannot_see string")
    e = a.raw("events").select(F.dayofmonth("ts").cast("long").alias("run_id"), "event_type").groupBy("run_id").agg(F.when(n(F.col("event_type") == "error") % 3 == 0, "running").otherwise("ok").alias("status"))
    rows = [
        quality.without_catalog(ratio_metrics(a), catalog).select(F.lit("no catalogue row").alias("kind"), F.col("metric_key").alias("what")),
        quality.undisclosed(catalog).select(F.lit("undisclosed proxy").alias("kind"), F.col("metric_key").alias("what")),
        quality.unfinished(e, 1).select(F.lit("unfinished run").alias("kind"), F.col("run_id").cast("string").alias("what")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


Q70 = """SELECT * FROM (VALUES ('no catalogue row', 'meta.unknown_steerer_pr_share'), ('no catalogue row', 'risk.ownership_concentration'), ('undisclosed proxy', 'impact.innovation_ratio'), ('undisclosed proxy', 'adoption.multiline_commit_share')) v(kind, what)
UNION ALL SELECT 'unfinished run', d::VARCHAR FROM (SELECT extract(day FROM ts)::BIGINT AS d FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') % 3 = 0) WHERE d <> 1"""


def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget of each week: spending against the cap, cost of a success, share wasted on failures, direction."""
    e = table(spark, sf_dir, "events").select(start("week", "ts").alias("week_start"), "event_type", "value")
    bad, good = F.col("event_type") == "error", F.col("event_type") == "purchase"
    per = e.groupBy("week_start").agg(F.round(F.sum("value"), 2).alias("spent"), F.round(F.coalesce(F.sum(F.when(bad, F.col("value"))), F.lit(0.0)), 2).alias("wasted"), n(good).alias("merged"))
    prior = per.select(F.date_add("week_start", 7).alias("week_start"), F.col("spent").alias("before"))
    cap = F.lit(7 * 10_000.0)
    trend = F.when(F.col("before").isNull(), "new").when(F.col("spent") > F.col("before"), "up").when(F.col("spent") < F.col("before"), "down").otherwise("flat")
    return per.join(prior, "week_start", "left").select("week_start", "spent", F.round(ratio(F.col("spent"), cap), 3).alias("cap_pct"), F.round(ratio(F.col("spent"), F.col("merged"), 1.0), 3).alias("cost_per_merged"), F.round(ratio(F.col("wasted"), F.col("spent")), 3).alias("waste_pct"), trend.alias("trend"))


Q71 = """WITH w AS (SELECT date_trunc('week', ts)::DATE AS week_start, round(sum(value), 2) AS spent, round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 2) AS wasted, count(*) FILTER (event_type = 'purchase') AS merged FROM events GROUP BY 1)
SELECT w.week_start, w.spent, round(100.0::DOUBLE * w.spent / 70000, 3) AS cap_pct, round(w.spent / nullif(w.merged, 0), 3) AS cost_per_merged, round(100.0::DOUBLE * w.wasted / nullif(w.spent, 0), 3) AS waste_pct, CASE WHEN p.spent IS NULL THEN 'new' WHEN w.spent > p.spent THEN 'up' WHEN w.spent < p.spent THEN 'down' ELSE 'flat' END AS trend FROM w LEFT JOIN w p ON p.week_start + 7 = w.week_start"""

LOGINS = ("jane{n}", "dependabot{n}", "x{n}[bot]", "Renovate-{n}", "web-flow", "web-flow{n}", "codecov{n}", "github-actions")
TRAILERS = ("Jane <jane@acme.org>", "Copilot <c@x.org>", "Aider (m) <aider@x.org>", "Helper <noreply@my.ai>", "Cursor Agent <cursoragent@x.com>", "dependabot[bot] <a@b.c>")


def picked(values: tuple[str, ...], key: Column) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int")), F.lit("{n}"), key.cast("string"))


def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why logins are machines, and whose agents sign, over composed logins and trailers."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(classify.bot_reason(picked(LOGINS, k), F.when(k % 9 == 0, "Bot").otherwise("User")).alias("reason"), classify.agent_of(picked(TRAILERS, k)).alias("agent"))
    return c.groupBy(F.coalesce("reason", F.lit("person")).alias("reason"), F.coalesce("agent", F.lit("nobody")).alias("agent")).agg(F.count("*").alias("people"))


Q72 = """SELECT CASE WHEN c_custkey % 9 = 0 THEN 'account_type' ELSE ['person', '^dependabot', '\\[bot\\]$', '^renovate', '^web-flow$', 'person', '^codecov', '^github-actions'][c_custkey % 8 + 1] END AS reason, ['nobody', 'copilot', 'aider', 'other-ai', 'cursor', 'nobody'][c_custkey % 6 + 1] AS agent, count(*) AS people FROM customer GROUP BY ALL"""


def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of a composed listing, the first day that any of their sources asks for, and where a window before it begins."""
    k = F.col("c_custkey")
    listed = table(spark, sf_dir, "customer").select(F.concat(F.lit("r"), k % 1000).alias("full_name"), (k % 5 == 0).alias("is_archived"), (k % 7 == 0).alias("is_fork"), (k % 11 == 0).alias("is_empty"), F.when(k % 13 != 0, "main").alias("default_branch"))
    found = framed.targets(listed, 3).agg(F.count("*").alias("targets"))
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    floors = orders.agg(F.min("o_orderdate").alias("f")).unionByName(events.agg(F.min("ts").alias("f"))).agg(F.to_date(F.min("f")).alias("floor"))
    return found.join(floors).select("targets", "floor", window_start(F.col("floor"), 182).alias("half_a_year_before"), window_start(F.col("floor"), 0, 23).alias("months_before"))  # one row each


Q73 = """WITH t AS (SELECT DISTINCT c_custkey % 1000 AS r FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0), f AS (SELECT least((SELECT min(o_orderdate) FROM orders), (SELECT min(ts) FROM events))::DATE AS floor)
SELECT (SELECT count(*) FROM t) AS targets, floor, floor - 182 AS half_a_year_before, (floor - INTERVAL 23 MONTH)::DATE AS months_before FROM f"""


def q74(a: Activity) -> DataFrame:
    """The review queue: the 500 people with the most unreviewed work, as lines with tabs, and one line of counts as JSON."""
    per = commits_enriched(a).where("identity_id is not null").groupBy("identity_id").agg(F.count("*").alias("commits"), n(F.col("executor_state") == "agent").alias("assisted"))
    queue = per.orderBy(F.desc("commits"), "identity_id").limit(500).select(F.concat_ws("\t", "identity_id", "commits", "assisted").alias("line"))
    envelope = per.agg(F.to_json(F.struct(F.count("*").alias("people"), F.sum("commits").alias("commits"), F.sum("assisted").alias("assisted"))).alias("line"))
    return queue.unionByName(envelope)


Q74 = """, p AS (SELECT identity_id, count(*) AS commits, count(*) FILTER (is_ai_assisted = 1) AS assisted FROM ce WHERE identity_id IS NOT NULL GROUP BY 1)
SELECT identity_id || chr(9) || commits || chr(9) || assisted AS line FROM (SELECT * FROM p ORDER BY commits DESC, identity_id LIMIT 500) UNION ALL SELECT '{"people":' || count(*) || ',"commits":' || sum(commits)::BIGINT || ',"assisted":' || sum(assisted)::BIGINT || '}' FROM p"""


def q75(a: Activity) -> DataFrame:
    """Open reviews by kind and age, how many merged since, and branches whose reviews were merged, where over five."""
    prs = prs_enriched(a)
    until = prs.agg(F.max(F.to_date("created_at")).alias("until"))
    k = F.col("pr_id")
    rows = prs.join(F.broadcast(until)).withColumn("age", F.datediff("until", "created_at"))  # one row
    kind = F.when(F.col("class") == "chore", "dependency").otherwise("feature")
    opened = rows.where("state = 'OPEN'").groupBy(kind.alias("kind"), F.when(F.col("age") > 365, "stale").otherwise("fresh").alias("state")).agg(F.count("*").alias("reviews"))
    since = rows.where("state = 'MERGED' and age <= 730").agg(F.lit("velocity").alias("kind"), F.lit("merged").alias("state"), F.count("*").alias("reviews"))
    branches = rows.where(k % 3 != 0).select("repo_full_name", F.concat(F.lit("b/"), k).alias("branch"))
    merged = rows.where("state = 'MERGED'").select("repo_full_name", F.concat(F.lit("b/"), k).alias("branch"))
    left = branches.join(merged, ["repo_full_name", "branch"], "left_semi").groupBy(F.col("repo_full_name").alias("kind")).agg(F.count("*").alias("reviews")).where("reviews > 5").select("kind", F.lit("stale branches").alias("state"), "reviews")
    return opened.unionByName(since).unionByName(left)


Q75 = """, u AS (SELECT max(created_at)::DATE AS until FROM pe), r AS (SELECT pe.*, (until - created_at::DATE) AS age FROM pe, u)
SELECT CASE WHEN class = 'chore' THEN 'dependency' ELSE 'feature' END AS kind, CASE WHEN age > 365 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS reviews FROM r WHERE state = 'OPEN' GROUP BY ALL
UNION ALL SELECT 'velocity', 'merged', count(*) FROM r WHERE state = 'MERGED' AND age <= 730 UNION ALL SELECT repo_full_name, 'stale branches', count(*) FROM r WHERE state = 'MERGED' AND pr_id % 3 <> 0 GROUP BY 1 HAVING count(*) > 5"""


def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of composed reviews: lines under a heading, its marker within the first lines, and pictures in it."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("# Intro\nx\n## Evidence\n"), F.when(k % 3 == 0, "verdict: ok\n").otherwise("none\n"), F.when(k % 2 == 0, "![a](b.png)\n![c](d.png)\n").otherwise(""), F.when(k % 5 == 0, "").otherwise("# Next\n![z](z.png)"))
    lines = section(text, "evidence")
    rows = table(spark, sf_dir, "part").select(F.size(lines).alias("lines"), F.exists(F.slice(lines, 1, 3), lambda x: x.rlike("^verdict:")).alias("marked"), F.size(F.filter(lines, lambda x: x.rlike(r"^!\[[^\]]*\]\("))).alias("pictures"))
    return rows.groupBy(F.col("lines").cast("long").alias("lines"), F.col("marked").cast("long").alias("marked"), F.col("pictures").cast("long").alias("pictures")).agg(F.count("*").alias("parts"))


Q76 = """SELECT (1 + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS lines, (p_partkey % 3 = 0)::BIGINT AS marked, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS pictures, count(*) AS parts FROM part GROUP BY ALL"""


def q77(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with sites' robots files, sitemaps and alternate origins, over composed responses of suppliers."""
    k = F.col("s_suppkey")
    site = F.concat(F.lit("https://s"), k, F.lit(".org/"))
    s = table(spark, sf_dir, "supplier")

    def response(kind: str, status: Column, body: Column, redirects: Column, final: Column) -> DataFrame:
        return s.select(site.alias("site"), F.lit(kind).alias("kind"), status.cast("int").alias("status"), body.cast("string").alias("body"), redirects.cast("int").alias("redirects"), final.alias("final_url"))

    zero, empty = F.lit(0), F.lit("")
    fetched = response("robots", F.when(k % 4 == 0, 404).otherwise(200), F.when(k % 3 == 0, "User-agent: *\nDisallow: /\n").otherwise("User-agent: *\nDisallow: /tmp\n"), zero, site)
    fetched = fetched.unionByName(response("sitemap", F.when(k % 5 == 0, 404).otherwise(200), F.when(k % 6 == 0, "<html>").otherwise('<?xml version="1.0"?><urlset><url/></urlset>'), zero, site))
    fetched = fetched.unionByName(response("alternate", F.lit(200), empty, k % 3, F.when(k % 7 == 0, "https://other.org/").otherwise(site)))
    return pages.site_findings(fetched).groupBy("severity", "code").agg(F.count("*").alias("sites"), F.min("site").alias("first_site"))


Q77 = """WITH k AS (SELECT s_suppkey AS k, 'https://s' || s_suppkey || '.org/' AS site FROM supplier), f AS (SELECT site, 'Critical' AS severity, 'robots-block-all' AS code FROM k WHERE k % 4 <> 0 AND k % 3 = 0 UNION ALL SELECT site, 'Medium', 'robots-unavailable' FROM k WHERE k % 4 = 0 UNION ALL SELECT site, 'High', 'sitemap-invalid' FROM k WHERE k % 5 <> 0 AND k % 6 = 0 UNION ALL SELECT site, 'High', 'sitemap-missing' FROM k WHERE k % 5 = 0 OR k % 6 = 0
  UNION ALL SELECT site, 'Critical', 'duplicate-host' FROM k WHERE k % 7 = 0 UNION ALL SELECT site, 'Critical', 'alternate-host-200' FROM k WHERE k % 7 <> 0 AND k % 3 = 0 UNION ALL SELECT site, 'Medium', 'alternate-host-chain' FROM k WHERE k % 7 <> 0 AND k % 3 = 2)
SELECT severity, code, count(*) AS sites, min(site) AS first_site FROM f GROUP BY ALL"""


def over(f):
    """A query from a function of the activity model."""
    return lambda spark, sf_dir: f(Activity(spark, sf_dir))


QUERIES = {
    "q63_mission_incidents": q63,
    "q64_rule_compliance": q64,
    "q65_missed_opportunity": q65,
    "q66_mission_timing": q66,
    "q67_cursor_starts": over(q67),
    "q68_rebuild_modes": over(q68),
    "q69_limited_batch": over(q69),
    "q70_self_checks": over(q70),
    "q71_budget": q71,
    "q72_bots_and_agents": q72,
    "q73_targets_and_floors": q73,
    "q74_review_queue": over(q74),
    "q75_open_reviews": over(q75),
    "q76_sections": q76,
    "q77_site_findings": q77,
}
#: SQL by query; those in MODELLED follow the common model of the activity queries.
SQL = {"q63_mission_incidents": LOG + "SELECT session, code, rule, evidence FROM i", "q64_rule_compliance": Q64, "q65_missed_opportunity": Q65, "q66_mission_timing": Q66, "q70_self_checks": Q70, "q71_budget": Q71, "q72_bots_and_agents": Q72, "q73_targets_and_floors": Q73, "q76_sections": Q76, "q77_site_findings": Q77}
MODELLED = {"q67_cursor_starts": Q67, "q68_rebuild_modes": Q68, "q69_limited_batch": Q69, "q74_review_queue": Q74, "q75_open_reviews": Q75}
