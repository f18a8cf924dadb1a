"""Queries of the operators made for inputs without a bound: searches, graphs, keyed state, mergeable sets; with their DuckDB SQL."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import globs
from tallyloom.functions.buckets import start
from tallyloom.operators import distincts, history, pages, planning, quality, rollups, upsert
from tallyloom.operators.conform import counted_commits, scoped
from tallyloom.session import shared_dir, ship, table
from tallyloom.sources.adapter import Activity
from tallyloom.streaming import arrivals, keyed


def q31b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All people's names and beginnings of benchmark texts, looked for in documents and rendered lines."""
    b, s = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "supplier")
    needles = table(spark, sf_dir, "customer").select(F.col("c_name").alias("needle")).unionByName(b.select(F.substring("text", 1, 40).alias("needle")))
    rendered = s.select((-F.col("s_suppkey") - 1).alias("doc_id"), F.concat(F.lit("from "), F.upper("s_name"), F.lit(" to CUSTOMER#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.when(F.col("s_suppkey") % 4 == 0, " at a@b.org").otherwise("")).alias("text"))
    allowed = b.where("item_id % 2 = 0").select(F.col("text").alias("name"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(rendered)
    return quality.disclosed(texts, needles, allowed).select("doc_id", "found", F.col("collision").cast("long").alias("collision"))


Q31B = r"""WITH n AS (SELECT DISTINCT lower(needle) AS n FROM (SELECT c_name AS needle FROM customer UNION ALL SELECT substr(text, 1, 40) FROM benchmark) WHERE needle <> ''),
t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -s_suppkey - 1, 'from ' || upper(s_name) || ' to CUSTOMER#' || lpad(s_suppkey::VARCHAR, 9, '0') || CASE WHEN s_suppkey % 4 = 0 THEN ' at a@b.org' ELSE '' END FROM supplier),
h AS (SELECT doc_id, n AS found FROM (SELECT doc_id, lower(text) AS low FROM t) JOIN n ON contains(low, n) UNION ALL SELECT doc_id, 'email-shaped' FROM t WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')),
c AS (SELECT DISTINCT n FROM (SELECT lower(text) AS low FROM benchmark WHERE item_id % 2 = 0) JOIN n ON contains(low, n))
SELECT doc_id, found, (c.n IS NOT NULL)::BIGINT AS collision FROM h LEFT JOIN c ON found = c.n"""


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ext = F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".md").otherwise(".txt")
    return table(spark, sf_dir, "orders").select(k.alias("change"), F.concat(F.lower("o_orderstatus"), F.lit("/c"), F.col("o_custkey"), F.lit("/"), k, ext).alias("path"))


def q39b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's path against a glob of every customer: what each kind of glob hits, and for how many paths its line is the last."""
    ship(spark)
    k = F.col("c_custkey")
    glob = F.when(k % 4 == 0, F.concat(F.lit("**/c"), k, F.lit("/*.py"))).when(k % 4 == 1, F.concat(F.lit("f/c"), k, F.lit("/**"))).when(k % 4 == 2, F.concat(F.lit("*/c"), k, F.lit("/?*.md"))).otherwise(F.concat(F.lit("*/c"), k, F.lit("?/*.txt")))
    patterns = table(spark, sf_dir, "customer").select(k.alias("line"), glob.alias("glob"))
    every = globs.matched(changed_paths(spark, sf_dir), patterns, "path", segments=True)
    per = every.groupBy("change").agg(F.max("line").alias("last"), F.collect_list("line").alias("lines"))
    told = per.select("last", F.explode("lines").alias("line"))
    return told.groupBy((F.col("line") % 4).alias("kind")).agg(F.count("*").alias("hits"), F.count(F.when(F.col("line") == F.col("last"), 1)).alias("last_hits"), F.sum("line").alias("lines"))


Q39B = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, lower(o_orderstatus) AS s FROM orders), p AS (SELECT c_custkey AS line FROM customer),
m AS (SELECT k, line FROM o JOIN p ON line = c WHERE (line % 4 = 0 AND k % 3 = 0) OR (line % 4 = 1 AND s = 'f') OR (line % 4 = 2 AND k % 3 = 1)
  UNION ALL SELECT k, line FROM o JOIN p ON line = c // 10 WHERE line % 4 = 3 AND line > 0 AND k % 3 = 2),
l AS (SELECT *, max(line) OVER (PARTITION BY k) AS last FROM m)
SELECT line % 4 AS kind, count(*) AS hits, count(*) FILTER (line = last) AS last_hits, sum(line)::BIGINT AS lines FROM l GROUP BY 1"""


def q78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history a customer, made of orders with branchings and merges: commits after each customer's cursor."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    back = [F.lag("o_orderkey", i).over(w).alias(f"p{i}") for i in (1, 2, 3)]
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("commit"), *back)
    k = F.col("commit")
    first = F.when(k % 7 == 0, F.coalesce("p2", "p1")).otherwise(F.col("p1"))
    parents = o.select("commit", F.explode(F.array_distinct(F.array_compact(F.array(first, F.when(k % 3 == 0, F.col("p3")))))).alias("parent"))
    ranges = o.groupBy(F.col("o_custkey").alias("range_id")).agg(F.max("commit").alias("branch"), F.max(F.when(k % 4 == 1, k)).alias("cursor"))
    return history.commits_in_range(o.select("commit"), parents, ranges).groupBy("range_id").agg(F.count("*").alias("commits"), F.min("commit").alias("first_commit"), F.max("commit").alias("last_commit"), F.sum("commit").alias("sum_commits"))


Q78 = """WITH RECURSIVE o AS (SELECT o_custkey AS c, o_orderkey AS k, lag(o_orderkey, 1) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2, lag(o_orderkey, 3) OVER w AS p3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT k, CASE WHEN k % 7 = 0 THEN coalesce(p2, p1) ELSE p1 END AS p FROM o UNION SELECT k, p3 FROM o WHERE k % 3 = 0),
r AS (SELECT c, max(k) AS branch, max(k) FILTER (k % 4 = 1) AS cursor FROM o GROUP BY 1),
a AS (SELECT c, branch AS k FROM r UNION SELECT a.c, e.p FROM a JOIN e ON e.k = a.k WHERE e.p IS NOT NULL),
b AS (SELECT c, cursor AS k FROM r WHERE cursor IS NOT NULL UNION SELECT b.c, e.p FROM b JOIN e ON e.k = b.k WHERE e.p IS NOT NULL),
d AS (SELECT * FROM a EXCEPT SELECT * FROM b)
SELECT c AS range_id, count(*) AS commits, min(k) AS first_commit, max(k) AS last_commit, sum(k)::BIGINT AS sum_commits FROM d GROUP BY 1"""


def q79(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct people by week and month, of a type of event and of all, from one pass of bitmaps a day."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), start("day", "ts").alias("day"), F.col("user_id"))
    days = distincts.day_sets(e, ["scope"], "day", "user_id")
    out = None
    for kind in ("week", "month"):
        for keys in (["scope"], []):
            part = distincts.counted(distincts.merged(days, keys, kind), [*keys, "period_start"]).select(F.lit(kind).alias("period_kind"), "period_start", (F.col("scope") if keys else F.lit("all")).alias("scope"), "people")
            out = part if out is None else out.unionByName(part)
    return out


Q79 = """WITH e AS (SELECT *, ts::DATE AS d FROM events), p AS (SELECT 'week' AS period_kind, date_trunc('week', d)::DATE AS period_start, event_type, user_id FROM e UNION ALL SELECT 'month', date_trunc('month', d)::DATE, event_type, user_id FROM e)
SELECT period_kind, period_start, event_type AS scope, count(DISTINCT user_id) AS people FROM p GROUP BY ALL UNION ALL SELECT period_kind, period_start, 'all', count(DISTINCT user_id) FROM p GROUP BY ALL"""


def arriving(rows: DataFrame, key: str, slots: int = 4) -> tuple[str, int]:
    """Rows as files of a new folder in the order of a hash, so that late ones are among them; the folder, and its files a slot.

    A batch takes as many files as a slot has, so the number of batches does not grow with the files.
    """
    place = f"{shared_dir(rows.sparkSession)}/arriving-{uuid.uuid4().hex}"
    for slot in range(slots):
        rows.where(F.pmod(F.xxhash64(key), F.lit(slots)) == slot).write.parquet(f"{place}/{slot}")
    files = rows.sparkSession.read.option("recursiveFileLookup", "true").schema(rows.schema).parquet(place).inputFiles()
    return place, max(1, -(-len(files) // slots))


@contextmanager
def setting(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for the time of a block."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def q80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative adopters from first assisted changes that a stream keeps as state, whatever the order of arrival."""
    keys = ["repo_full_name", "owner", "identity_id"]
    rows = counted_commits(Activity(spark, sf_dir)).where("steerer_state = 'known' and is_ai_assisted = 1").select(*keys, "sha", "authored_at")
    source, files = arriving(rows, "sha")
    told = f"{source}-told"
    with setting(spark, keyed.STORE):
        arrivals.drain(spark, source, rows.schema, keyed.lowest_sink(told), f"{source}-cursor", files=files, through=lambda s: keyed.touched_lowest(s, keys, "authored_at"), mode="update")
    first = keyed.lowest_of(spark.read.parquet(told), keys, "first_at")
    return rollups.cumulative(scoped(first).groupBy("scope", "scope_key", "identity_id").agg(F.min("first_at").alias("first_at")))


def q81(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts kept by a stream: every batch computes again the days it touches."""
    events = table(spark, sf_dir, "events")
    source, files = arriving(events, "event_id", 2)
    kept = keyed.MaintainedDaily(f"{source}-kept")
    arrivals.drain(spark, source, events.schema, kept.sink, f"{source}-cursor", files=files)
    return kept.read(spark).select(F.col("bucket").alias("day"), "event_type", "events", "users", "value")


def q82(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of versions of lines into a keyed table in hash buckets: the latest of each key, by line number."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("seen_at"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("quantity"))
    kept = upsert.KeyedTable(f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", ("l_orderkey", "l_linenumber"), ("seen_at", "l_partkey", "l_suppkey", "quantity"), buckets=spark.sparkContext.defaultParallelism)
    for half in (1, 0):
        kept.load(rows.where(F.col("l_suppkey") % 2 == half))
    return kept.read(spark).groupBy(F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.count("*").alias("keys"), F.round(F.sum("quantity"), 2).alias("quantity"), F.max("seen_at").cast("date").alias("last_seen"), F.sum("l_partkey").alias("parts"))


def q83(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry run of a replacement: what late events, and the loss of one type on odd days, would change in the daily counts."""
    events = table(spark, sf_dir, "events")
    daily = lambda df: df.groupBy(start("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("events"))
    old = daily(events.where("event_id % 7 > 0 and not (event_type = 'view' and dayofmonth(ts) = 4)"))
    fresh = daily(events.where("dayofmonth(ts) % 2 = 0 or event_type <> 'error'").where("event_id % 7 > 0 or dayofmonth(ts) < 9"))
    return upsert.changes(old, fresh, ["day", "event_type"]).select("day", "event_type", "change", F.col("old.events").alias("events_before"), F.col("new.events").alias("events_after"))


Q83 = """WITH o AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE event_id % 7 > 0 AND NOT (event_type = 'view' AND day(ts) = 4) GROUP BY ALL),
f AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE (day(ts) % 2 = 0 OR event_type <> 'error') AND (event_id % 7 > 0 OR day(ts) < 9) GROUP BY ALL)
SELECT day, event_type, CASE WHEN o.n IS NULL THEN 'added' WHEN f.n IS NULL THEN 'gone' ELSE 'changed' END AS change, o.n AS events_before, f.n AS events_after FROM o FULL JOIN f USING (day, event_type) WHERE o.n IS DISTINCT FROM f.n"""


def q32e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl of every site from its first page within five places; what is deferred is told."""
    ship(spark)
    return pages.crawled_within(table(spark, sf_dir, "pages")).select("url", "host", F.col("round").cast("long").alias("round"), "state")


Q32E = r"""WITH p AS (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS root, regexp_replace(CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*$') THEN url || '/' ELSE url END, '#.*$', '') AS url, html FROM pages),
f AS (SELECT host, min(url) AS url FROM p GROUP BY 1),
l AS (SELECT DISTINCT p.host, root || unnest(regexp_extract_all(html, '<a [^>]*href="(/[^"#]*)', 1)) AS url FROM p JOIN f USING (host, url)),
n AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY substr(md5(url), 1, 2), url) AS place FROM l WHERE url NOT IN (SELECT url FROM f))
SELECT url, host, 0::BIGINT AS round, 'queued' AS state FROM f UNION ALL SELECT url, host, 1, CASE WHEN place < 5 THEN 'queued' ELSE 'deferred' END FROM n"""


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of their region's team: planned by priority, merged by status, with rounds and cost from their lines."""
    a = Activity(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("rounds"), F.sum(F.col("l_quantity").cast("long")).alias("cost"))
    people = table(spark, sf_dir, "customer").join(a.repos, F.col("c_nationkey") == F.col("repo_id")).select("c_custkey", F.col("owner").alias("team"))
    o = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("team", F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("updated_at"), start("week", "o_orderdate").alias("week_start"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("planned"), (F.col("o_orderstatus") == "F").alias("merged"), F.coalesce("rounds", F.lit(0)).alias("rounds"), F.coalesce("cost", F.lit(0)).alias("cost"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("failure"))


WORK_ITEMS = """WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'R') AS rounds, sum(l_quantity::BIGINT)::BIGINT AS cost FROM lineitem GROUP BY 1),
w AS (SELECT r_name AS team, o_orderkey AS item, o_orderdate AS updated_at, date_trunc('week', o_orderdate)::DATE AS week_start, o_orderpriority IN ('1-URGENT', '2-HIGH') AS planned, o_orderstatus = 'F' AS merged, coalesce(rounds, 0) AS rounds, coalesce(cost, 0) AS cost, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS failure
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN l ON k = o_orderkey)"""


def q50b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.scorecard(work_items(spark, sf_dir))


Q50B = WORK_ITEMS + """, s AS (SELECT team, week_start, count(*) FILTER (planned) AS planned, count(*) FILTER (planned AND merged) AS planned_merged, count(*) FILTER (merged) AS merged, count(*) FILTER (merged AND rounds > 2) AS reworked, sum(cost) AS cost FROM w GROUP BY ALL),
c AS (SELECT team, week_start, failure AS top_failure FROM (SELECT team, week_start, failure, row_number() OVER (PARTITION BY team, week_start ORDER BY count(*) DESC, failure) AS r FROM w WHERE failure IS NOT NULL GROUP BY team, week_start, failure) WHERE r = 1),
x AS (SELECT s.team, s.week_start, planned, planned_merged, merged, reworked, top_failure, round(100.0::DOUBLE * planned_merged / nullif(planned, 0), 6) AS planned_pct, round(100.0::DOUBLE * reworked / nullif(merged, 0), 6) AS rework_pct, round(cost::DOUBLE / nullif(merged, 0), 6) AS cost_per_merge FROM s LEFT JOIN c USING (team, week_start))
SELECT x.*, CASE WHEN x.planned_pct > b.planned_pct THEN 'up' WHEN x.planned_pct < b.planned_pct THEN 'down' WHEN x.planned_pct = b.planned_pct THEN 'flat' END AS planned_pct_trend, CASE WHEN x.rework_pct > b.rework_pct THEN 'up' WHEN x.rework_pct < b.rework_pct THEN 'down' WHEN x.rework_pct = b.rework_pct THEN 'flat' END AS rework_pct_trend,
  CASE WHEN x.cost_per_merge > b.cost_per_merge THEN 'up' WHEN x.cost_per_merge < b.cost_per_merge THEN 'down' WHEN x.cost_per_merge = b.cost_per_merge THEN 'flat' END AS cost_per_merge_trend FROM x LEFT JOIN x b ON b.team = x.team AND b.week_start + 7 = x.week_start"""


def q75b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 newest open items of each team, with the flags of their lines as labels."""
    labels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.explode(F.array(F.concat(F.lit("flag-"), "l_returnflag"), F.concat(F.lit("status-"), "l_linestatus"))).alias("label"))
    return planning.newest(work_items(spark, sf_dir).where("not merged").select("team", "item", "updated_at"), labels).select("team", "item", F.to_date("updated_at").alias("updated"), F.col("rank").cast("long").alias("rank"), "labels")


Q75B = WORK_ITEMS + """, n AS (SELECT team, item, updated_at, row_number() OVER (PARTITION BY team ORDER BY updated_at DESC, item) AS rank FROM w WHERE NOT merged),
b AS (SELECT item, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT item, unnest(['flag-' || l_returnflag, 'status-' || l_linestatus]) AS label FROM n JOIN lineitem ON l_orderkey = item WHERE rank <= 25) GROUP BY 1)
SELECT team, item, updated_at::DATE AS updated, rank, coalesce(labels, '') AS labels FROM n LEFT JOIN b USING (item) WHERE rank <= 25"""


def q18b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-line share by source over whole texts as messages; every third has a trailer."""
    k = F.col("doc_id")
    message = F.when(k % 5 == 0, F.regexp_replace("text", r"(?s)\n.*", "")).otherwise(F.col("text"))
    signed = F.when(k % 3 == 0, F.concat(message, F.lit("\n\nCo-Authored-By: x <x@y>"))).otherwise(message)
    rows = table(spark, sf_dir, "documents").select("source", F.when(k % 17 != 0, signed).alias("message"), (k % 3 == 0).cast("int").alias("is_ai_assisted"))
    return planning.multiline_share(rows, ["source"])


Q18B = r"""WITH m AS (SELECT source, doc_id % 3 = 0 AS ai, CASE WHEN doc_id % 17 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN split_part(text, chr(10), 1) ELSE text END || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'Co-Authored-By: x <x@y>' ELSE '' END END AS t FROM documents),
b AS (SELECT source, ai, len(list_filter(list_transform(string_split(t, chr(10))[2:], lambda x: regexp_replace(x, '[ 	
]+$', '')), lambda x: x <> '' AND NOT regexp_matches(x, '^[ 	]*[A-Za-z-]+:[ 	]'))) > 0 AS body FROM m WHERE t IS NOT NULL)
SELECT source, count(*) AS commits, round(100.0::DOUBLE * count(*) FILTER (body) / count(*), 6) AS multiline_pct, round(100.0::DOUBLE * count(*) FILTER (ai) / count(*), 6) AS base_rate_pct, round(100.0::DOUBLE * count(*) FILTER (body AND ai) / nullif(count(*) FILTER (body), 0), 6) AS precision_pct, round(100.0::DOUBLE * count(*) FILTER (body AND ai) / nullif(count(*) FILTER (ai), 0), 6) AS recall_pct FROM b GROUP BY 1"""

QUERIES = {"q18b_multiline_share": q18b, "q50b_scorecard_trends": q50b, "q75b_newest_items": q75b, "q32e_bounded_crawl": q32e, "q80_first_occurrence_stream": q80, "q81_maintained_daily": q81, "q82_bucketed_upsert": q82, "q83_dry_run": q83, "q78_commit_ranges": q78, "q79_distinct_people": q79, "q31b_identifier_scan": q31b, "q39b_glob_patterns": q39b}
SQL = {"q18b_multiline_share": Q18B, "q50b_scorecard_trends": Q50B, "q75b_newest_items": Q75B, "q32e_bounded_crawl": Q32E, "q83_dry_run": Q83, "q78_commit_ranges": Q78, "q79_distinct_people": Q79, "q31b_identifier_scan": Q31B, "q39b_glob_patterns": Q39B}
