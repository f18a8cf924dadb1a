"""Queries over composed inputs for the smaller operators, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import runbook
from tallyloom.session import shared_dir, table
from tallyloom.sources import framed


def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit records written as framed text and read back."""
    o = table(spark, sf_dir, "orders")
    stat = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit(" 1 file changed, "), F.col("o_orderkey") % 97, F.lit(" insertions(+)"))).otherwise(F.concat(F.lit(" 2 files changed, "), F.col("o_orderkey") % 97, F.lit(" insertions(+), 3 deletions(-)")))
    fields = [F.sha1(F.col("o_orderkey").cast("string").cast("binary")), F.concat(F.lit("U"), F.col("o_custkey"), F.lit("@Ex.org")), F.lit("n"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("o_orderkey") % 7 == 0, "a b").otherwise("a"), F.lit("s"), F.when(F.col("o_orderkey") % 4 == 0, "x <x@y>\u001dz <z@y>").otherwise(""), stat]
    rows = framed.framed(o.select(F.concat_ws("\u001f", *fields).alias("value")))
    return rows.groupBy(F.to_date("authored_at").alias("day")).agg(F.count("*").alias("commits"), F.countDistinct("email").alias("emails"), F.sum("is_merge").alias("merges"), F.sum(F.size("trailers")).alias("trailers"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count("files_changed").alias("measured"))


Q53 = """SELECT o_orderdate::DATE AS day, count(*) AS commits, count(DISTINCT o_custkey) AS emails, count(*) FILTER (o_orderkey % 7 = 0) AS merges, sum(CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS trailers, sum(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 97 END)::BIGINT AS insertions, sum(CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 0 ELSE 3 END)::BIGINT AS deletions, count(*) FILTER (o_orderkey % 5 <> 0) AS measured FROM orders GROUP BY 1"""


def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("size"), F.max("l_suppkey").alias("s"))
    counted = pages.join(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total")), "l_orderkey")
    broken = counted.withColumn("total", F.when((F.col("l_orderkey") % 9 == 0) & (F.col("l_linenumber") == 1), F.col("total") + 1).otherwise(F.col("total"))).withColumn("size", F.when((F.col("l_orderkey") % 10 == 0) & (F.col("l_linenumber") == 2), 0).otherwise(F.col("size")))
    return framed.complete_pages(broken, "l_orderkey", "size", "total").groupBy("is_complete").agg(F.count("*").alias("collections"), F.sum("pages").alias("pages"), F.sum("collected").alias("items"))


Q54 = """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, count(*) AS size FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey AS k, count(*) AS total FROM lineitem GROUP BY 1),
b AS (SELECT p.k, CASE WHEN p.k % 10 = 0 AND n = 2 THEN 0 ELSE size END AS size, CASE WHEN p.k % 9 = 0 AND n = 1 THEN total + 1 ELSE total END AS total FROM p JOIN t ON p.k = t.k),
c AS (SELECT k, count(*) AS pages, sum(size) AS collected, count(DISTINCT total) = 1 AND sum(size) = max(total) AND count(*) FILTER (size = 0 AND total > 0) = 0 AS ok FROM b GROUP BY 1)
SELECT ok::BIGINT AS is_complete, count(*) AS collections, sum(pages)::BIGINT AS pages, sum(collected)::BIGINT AS items FROM c GROUP BY 1"""

OVERRIDES = ["# comment", "email\tcustomer#*1@acme.org\tfamily", "email\tCustomer#12@acme.org\tliteral", "alias\tp3\tp4", "bot\tp5\t", "human\tp5\tyes", "exclude\tp6\t", "oops\tx\ty", "name\tp7\t", "email\tcustomer#2?@acme.org\tsecond", "bot\tp8\t"]


def rules(spark: SparkSession) -> DataFrame:
    return framed.overrides(spark.createDataFrame([(i + 1, x) for i, x in enumerate(OVERRIDES)], "line long, value string"))


def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    emails = c.select(F.concat(F.lit("customer#"), F.col("c_custkey"), F.lit("@acme.org")).alias("email"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("p"), F.col("c_custkey"))).alias("login"))
    return runbook.resolved_identities(emails, rules(spark)).groupBy(F.coalesce(F.when(F.col("source") == "manual", F.col("login")), F.col("source"), F.lit("none")).alias("outcome")).agg(F.count("*").alias("emails"), F.min("email").alias("first_email"))


Q55 = """WITH e AS (SELECT 'customer#' || c_custkey || '@acme.org' AS email, c_custkey AS k FROM customer),
r AS (SELECT email, CASE WHEN regexp_matches(email, '^customer#2.@acme.org$') THEN 'second' WHEN email = 'customer#12@acme.org' THEN 'literal' WHEN regexp_matches(email, '^customer#.*1@acme.org$') THEN 'family' WHEN k % 3 <> 0 THEN 'api' ELSE 'none' END AS outcome FROM e)
SELECT outcome, count(*) AS emails, min(email) AS first_email FROM r GROUP BY 1"""


def q55b(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey")).alias("login"), (F.col("c_custkey") % 2).cast("int").alias("is_bot"), F.lit(0).alias("is_excluded"))
    return runbook.flags_after(people, rules(spark)).select("login", F.col("is_bot").cast("long").alias("is_bot"), F.col("is_excluded").cast("long").alias("is_excluded"))


Q55B = """SELECT 'p' || c_custkey AS login, CASE c_custkey WHEN 5 THEN 0 WHEN 8 THEN 1 ELSE c_custkey % 2 END::BIGINT AS is_bot, CASE WHEN c_custkey IN (3, 6) THEN 1 ELSE 0 END::BIGINT AS is_excluded FROM customer"""


def q55c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override files, one for every thousand people, written and read back: each line's state by its number in its file."""
    k = F.col("c_custkey")
    line = F.when(k % 11 == 0, "# comment").when(k % 11 == 1, "").when(k % 11 == 2, F.concat(F.lit("oops\t"), k, F.lit("\ty"))).when(k % 11 == 3, F.concat(F.lit("name\t"), k, F.lit("\t"))).when(k % 11 == 4, "bot\t").otherwise(F.concat(F.lit("email\t"), k, F.lit("@x.org\tp"), k))
    thousand = table(spark, sf_dir, "customer").groupBy(F.floor(k / 1000).alias("part")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines"))
    place = f"{shared_dir(spark)}/overrides-{uuid.uuid4().hex}"
    thousand.select("part", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("value")).write.partitionBy("part").text(place)
    rows = framed.overrides(framed.numbered_lines(spark, place, "*.txt"), "file")
    return rows.groupBy(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "directive", F.coalesce("error", F.lit("ok")).alias("state")).agg(F.count("*").alias("lines"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


Q55C = """WITH l AS (SELECT c_custkey AS k, c_custkey // 1000 AS part, row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) AS line FROM customer)
SELECT part, CASE k % 11 WHEN 2 THEN 'oops' WHEN 3 THEN 'name' WHEN 4 THEN 'bot' ELSE 'email' END AS directive, CASE k % 11 WHEN 2 THEN 'unknown directive' WHEN 3 THEN 'no value' WHEN 4 THEN 'no key' ELSE 'ok' END AS state, count(*) AS lines, min(line) AS first_line, max(line) AS last_line FROM l WHERE k % 11 > 1 GROUP BY ALL"""


def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of composed configurations of suppliers and their flows."""
    k = F.col("s_suppkey")
    repo = F.when(k % 7 == 0, "bad").when(k % 15 == 0, "acme/other").when(k % 16 == 0, "acme/template").otherwise("acme/web")
    env = F.concat(F.lit('"local":{"captcha":"'), F.when(k % 3 == 0, "").otherwise("disabled"), F.lit('"},"preview":{"mode":"on-demand","site_key":"'), F.when(k % 18 == 0, "key ").otherwise("key"), F.lit('"}'), F.when(k % 4 != 0, F.concat(F.lit(',"production":{"url":"'), F.when(k % 5 == 0, "http://x").otherwise("https://x.org"), F.lit('","captcha":"'), F.when(k % 6 == 0, "").otherwise("required"), F.lit('"}'))).otherwise(""))
    config = F.concat(F.lit('{"repo":"'), repo, F.lit('","environments":'), F.when(k % 14 == 0, "null").otherwise(F.concat(F.lit("{"), env, F.lit("}"))), F.lit(',"critical":['), F.when(k % 8 == 0, "").otherwise('"login","pay"'), F.lit("]}"))
    s = table(spark, sf_dir, "supplier")
    none, words = F.lit(None).cast("string"), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    flows = s.where(k % 9 != 0).select(k.alias("config_id"), F.lit("login").alias("name"), F.lit(True).alias("readable"), (k % 2 == 0).alias("interactive"), F.lit(True).alias("captcha"), (k % 11 == 0).alias("captcha_optional"), F.when(k % 10 == 0, words("renders")).otherwise(words("Renders", "token ", "submission", "success-ui", "backend-boundary")).alias("assertions"), F.when(k % 2 == 0, "none").otherwise("required").alias("evidence"), none.alias("kind"), words().alias("regions"), words().alias("locales"))
    flows = flows.unionByName(s.select(k.alias("config_id"), F.lit("pay").alias("name"), (k % 13 != 0).alias("readable"), F.lit(False).alias("interactive"), F.lit(False).alias("captcha"), F.lit(None).cast("boolean").alias("captcha_optional"), words().alias("assertions"), none.alias("evidence"), F.lit("i18n").alias("kind"), F.when(k % 12 == 0, words("header")).otherwise(words("header", "main", "form", "footer")).alias("regions"), words("en", "EN", "").alias("locales")))
    configs = s.select(k.alias("config_id"), F.when(k % 17 == 0, "{broken").otherwise(config).alias("config"))
    return runbook.contract_findings(configs, flows, expected="acme/web").groupBy("code", "subject").agg(F.count("*").alias("configs"), F.min("config_id").alias("first_config"))


Q56 = """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 14 = 0 AS bare, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 15 = 0 THEN 'acme/other' WHEN s_suppkey % 16 = 0 THEN 'acme/template' ELSE 'acme/web' END AS repo FROM supplier), k AS (SELECT * FROM s WHERE k % 17 <> 0), c AS (SELECT * FROM k WHERE k % 8 <> 0), l AS (SELECT * FROM c WHERE k % 9 <> 0), f AS (
  SELECT k, 'config-unreadable' AS code, '' AS subject FROM s WHERE k % 17 = 0 UNION ALL SELECT k, 'identity-missing', '' FROM k WHERE repo = '' UNION ALL SELECT k, 'template-identity', repo FROM k WHERE repo = 'acme/template' UNION ALL SELECT k, 'identity-mismatch', repo FROM k WHERE repo IN ('acme/other', 'acme/template')
  UNION ALL SELECT k, 'environments-missing', '' FROM k WHERE bare UNION ALL SELECT k, 'environment-local-missing', '' FROM k WHERE bare UNION ALL SELECT k, 'environment-preview-missing', '' FROM k WHERE bare UNION ALL SELECT k, 'preview-mode-invalid', '' FROM k WHERE bare
  UNION ALL SELECT k, 'environment-production-missing', '' FROM k WHERE bare OR k % 4 = 0 UNION ALL SELECT k, 'production-url-invalid', CASE WHEN bare OR k % 4 = 0 THEN '' ELSE 'http://x' END FROM k WHERE bare OR k % 4 = 0 OR k % 5 = 0
  UNION ALL SELECT k, 'local-captcha-implicit', '' FROM k WHERE bare OR k % 3 = 0 UNION ALL SELECT k, 'captcha-site-key-whitespace', 'preview' FROM k WHERE NOT bare AND k % 18 = 0 UNION ALL SELECT k, 'critical-smoke-empty', '' FROM k WHERE k % 8 = 0
  UNION ALL SELECT k, 'critical-flow-missing', 'login' FROM c WHERE k % 9 = 0 UNION ALL SELECT k, 'interactive-browser-evidence-required', 'login' FROM l WHERE k % 2 = 0 UNION ALL SELECT k, 'production-captcha-optional', 'login' FROM l WHERE k % 11 = 0 UNION ALL SELECT k, 'captcha-contract-incomplete', 'login' FROM l WHERE k % 10 = 0
  UNION ALL SELECT k, 'production-captcha-not-required', '' FROM l WHERE bare OR k % 6 = 0 OR k % 4 = 0 UNION ALL SELECT k, 'flow-unreadable', 'pay' FROM c WHERE k % 13 = 0 UNION ALL SELECT k, 'i18n-visible-copy-incomplete', 'pay' FROM c WHERE k % 13 <> 0 AND k % 12 = 0 UNION ALL SELECT k, 'i18n-locales-incomplete', 'pay' FROM c WHERE k % 13 <> 0)
SELECT code, subject, count(*) AS configs, min(k) AS first_config FROM f GROUP BY ALL"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["src/app.py", "conf/.env", "keys/a.pem", "test_app.py", "tests/test_app.py", "lib/x.spec.ts", "data/db.sqlite", "docs/readme.md", "app/migrations/1.sql", "auth/session.rb", "web/page.tsx"]
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", pick.alias("path"))


def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(spark, sf_dir)
    kind = F.coalesce(runbook.suspect_file(F.col("path")), F.when(runbook.misplaced_test(F.col("path")), "misplaced test"))
    return p.select("path", kind.alias("finding")).where("finding is not null").groupBy("path", "finding").agg(F.count("*").alias("files"))


Q57 = """SELECT * FROM (SELECT CASE p_partkey % 11 WHEN 1 THEN 'conf/.env' WHEN 2 THEN 'keys/a.pem' WHEN 3 THEN 'test_app.py' WHEN 5 THEN 'lib/x.spec.ts' WHEN 6 THEN 'data/db.sqlite' END AS path, CASE p_partkey % 11 WHEN 1 THEN 'dotenv' WHEN 2 THEN 'private key' WHEN 3 THEN 'misplaced test' WHEN 5 THEN 'misplaced test' WHEN 6 THEN 'database' END AS finding, count(*) AS files FROM part GROUP BY ALL) WHERE path IS NOT NULL"""


def q58(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk tiers of diffs: parts of one size are one diff."""
    diff = paths(spark, sf_dir).groupBy("p_size").agg(F.collect_set("path").alias("paths"), F.count("*").alias("n"))
    sub = F.filter("paths", lambda p: ~p.rlike("auth") | (F.col("p_size") % 3 == 0))
    risk = runbook.diff_risk(F.filter(sub, lambda p: ~p.rlike("migr") | (F.col("p_size") % 2 == 0)), F.col("p_size") * 20, F.when(F.col("p_size") % 5 == 0, "import sdk").otherwise(""), F.lit(False))
    ui = runbook.ui_trigger(F.col("paths"), ["web/**"], ["css"])
    return diff.select(F.col("p_size").cast("long").alias("p_size"), risk["tier"].alias("tier"), risk["reasons"].alias("reasons"), ui.cast("long").alias("ui"))


Q58 = """WITH d AS (SELECT p_size AS s, bool_or(p_partkey % 11 = 8) AND s % 2 = 0 AS mig, bool_or(p_partkey % 11 = 9) AND s % 3 = 0 AS auth, bool_or(p_partkey % 11 = 10) AS ui FROM part GROUP BY 1)
SELECT s::BIGINT AS p_size, CASE WHEN mig OR auth OR s % 5 = 0 OR s * 20 > 400 THEN 'HIGH' WHEN s * 20 <= 150 THEN 'LOW' ELSE 'MEDIUM' END AS tier, concat_ws(',', CASE WHEN mig THEN 'migration' END, CASE WHEN auth THEN 'auth-surface' END, CASE WHEN s % 5 = 0 THEN 'boundary' END, CASE WHEN s * 20 > 400 THEN 'large' END) AS reasons, ui::BIGINT AS ui FROM d"""


def q59(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inherited methods of nations' metrics, and the ladder of resolution reasons over customers."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    source = F.element_at(F.array(*map(F.lit, ("api", "manual", "mailmap", "import"))), (k % 4 + 1).cast("int"))
    ladder = c.select(runbook.resolution(source, (k % 2).cast("int"), (k % 10 == 0).cast("int"), (k % 6 != 0).cast("int"), (k % 8 != 0).cast("int"), (k % 14 != 0).cast("int")).alias("r")).groupBy("r.method", "r.detail").agg(F.count("*").alias("n"))
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("classified"), F.count(F.when(F.col("c_acctbal") < F.col("c_nationkey") * 400 - 1000, 1)).alias("llm"), F.count(F.when(F.col("c_acctbal") > 9900, 1)).alias("weak"))
    return ladder.unionByName(per.groupBy(runbook.inherited_method(F.col("classified"), F.col("llm"), F.col("weak")).alias("method")).agg(F.count("*").alias("n")).withColumn("detail", F.lit("inherited")))


Q59 = """WITH c AS (SELECT c_custkey AS k FROM customer), l AS (SELECT CASE WHEN k % 2 = 1 AND k % 4 = 1 THEN 'script-with-fallback|manual confirmation' WHEN k % 2 = 1 THEN 'script-with-fallback|pre-existing link, source=import' WHEN k % 10 = 0 THEN 'llm|interrupted by a rate limit' WHEN k % 6 = 0 THEN 'llm|not resolved yet' WHEN k % 8 = 0 THEN 'llm|no sample commit' WHEN k % 14 = 0 THEN 'llm|sample outside the scope' ELSE 'llm|no login for this address' END AS x FROM c),
p AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < c_nationkey * 400 - 1000) AS llm, count(*) FILTER (c_acctbal > 9900) AS weak FROM customer GROUP BY 1)
SELECT split_part(x, '|', 1) AS method, split_part(x, '|', 2) AS detail, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT CASE WHEN llm * 2 > n THEN 'llm' WHEN weak > 0 THEN 'script-with-fallback' ELSE 'script' END, 'inherited', count(*) FROM p GROUP BY 1"""


def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined but unreferenced names, digest drift, and documented claims against source tokens."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    unused = runbook.defined_not_referenced(c.select(F.col("c_nationkey").alias("name")), s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("name")), "name").select(F.lit("unreferenced").alias("kind"), F.col("name").cast("string").alias("name"))
    a = s.where("s_suppkey % 5 != 0").select(F.col("s_name").alias("name"), F.md5(F.col("s_suppkey").cast("string").cast("binary")).alias("digest"))
    b = s.where("s_suppkey % 7 != 0").select(F.col("s_name").alias("name"), F.md5((F.col("s_suppkey") + (F.col("s_suppkey") % 3 == 0).cast("int")).cast("string").cast("binary")).alias("digest"))
    drifted = runbook.drift(a, b).select(F.col("state").alias("kind"), "name")
    claims = s.select(F.concat(F.lit("--flag"), F.col("s_suppkey")).alias("claim"))
    sources = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("use --flag"), F.col("s_suppkey"), F.lit(" or --flag"), F.col("s_suppkey"), F.lit("x")).alias("text"))
    return unused.unionByName(drifted).unionByName(runbook.claims_without_source(claims, sources).select(F.col("verdict").alias("kind"), F.col("claim").alias("name")))


Q60 = """SELECT 'unreferenced' AS kind, n::VARCHAR AS name FROM (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))
UNION ALL SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'extra' WHEN s_suppkey % 3 = 0 THEN 'drifted' ELSE 'same' END, s_name FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 7 = 0)
UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'OK' ELSE 'DRIFT' END, '--flag' || s_suppkey FROM supplier"""


def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion decisions, resumed reviews, claim checks and settings over composed inputs."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sha = F.sha1(k.cast("string").cast("binary"))
    state = F.when(k % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"v":1,"head_sha":"'), F.when(k % 3 == 0, "other").otherwise(sha), F.lit('","findings":['), F.when(k % 4 == 0, '{"status":"open"}').otherwise(""), F.lit("]}")))
    decision = o.select(F.concat(F.lit("promotion/"), runbook.review_promotion(F.when(k % 7 == 0, "no").otherwise("ready"), sha, state)).alias("outcome"))
    prs = o.select(k.alias("pr"), F.when(k % 2 == 0, F.array(k + 1)).otherwise(F.array().cast("array<bigint>")).alias("closes"), F.concat(F.lit("fix/"), k, F.lit("-x")).alias("head"))
    branches = o.select(F.concat(F.lit("fix/"), k, F.lit("-x")).alias("branch")).unionByName(o.where(k % 3 == 0).select(F.concat(F.lit("old_"), k).alias("branch")))
    again = runbook.resumed(o.select(k.alias("issue")), prs, branches).select(F.concat(F.lit("resume/"), F.when(F.col("pr").isNull(), "none").when(F.col("pr") == F.col("issue"), "branch").otherwise("exact")).alias("outcome"))
    body = F.when(k % 2 == 0, "see https://x.org").when(k % 3 == 0, "curl output").otherwise("plain")
    claim = o.select(F.concat(F.lit("claim/"), runbook.claim_check(F.when(k % 5 == 0, "ok").otherwise("site is down"), body, F.when(k % 4 == 0, 500).otherwise(200))).alias("outcome"))
    told = o.select(F.concat(F.lit("status/"), framed.setting(F.when(k % 6 == 0, "noise").otherwise("a=1 deploy_status=done sha=x"), "deploy_status", "failed")).alias("outcome"))
    return decision.unionByName(again).unionByName(claim).unionByName(told).groupBy("outcome").agg(F.count("*").alias("n"))


Q61 = """WITH o AS (SELECT o_orderkey AS k FROM orders), x AS (
  SELECT 'promotion/' || CASE WHEN k % 7 = 0 THEN 'needs-work:negative-verdict' WHEN k % 5 = 0 THEN 'needs-work:invalid-review-state' WHEN k % 3 = 0 THEN 'needs-work:review-state-head-mismatch' WHEN k % 4 = 0 THEN 'needs-work:blocking-findings' ELSE 'promote' END AS outcome FROM o
  UNION ALL SELECT 'resume/' || CASE WHEN k % 2 = 1 AND (k - 1) IN (SELECT k FROM o) THEN 'exact' WHEN k % 3 <> 0 THEN 'branch' ELSE 'none' END FROM o
  UNION ALL SELECT 'claim/' || CASE WHEN k % 5 = 0 THEN 'standard' WHEN k % 2 = 0 AND k % 4 = 0 THEN 'confirmed' WHEN k % 2 = 0 THEN 'unverified' WHEN k % 3 = 0 THEN 'needs-review' ELSE 'unverified-no-evidence' END FROM o
  UNION ALL SELECT 'status/' || CASE WHEN k % 6 = 0 THEN 'failed' ELSE 'done' END FROM o)
SELECT outcome, count(*) AS n FROM x GROUP BY 1"""


def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest deployment of each commit, newest rows of each key, and mailmap lines."""
    o = table(spark, sf_dir, "orders")
    deployments = o.select(F.col("o_custkey").alias("sha"), F.when(F.col("o_orderstatus") == "P", "failure").otherwise("success").alias("state"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.concat(F.lit("https://d/"), F.col("o_orderkey")).alias("url"))
    last = runbook.latest_deployment(deployments, "sha", ["at", "id"]).select(F.lit("deployment").alias("kind"), F.col("sha").alias("k"), F.col("url").alias("v"))
    top = runbook.newest_first(o.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 2).select(F.lit("newest").alias("kind"), F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("string").alias("v"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("a"), F.col("c_custkey"), F.lit("@x")).alias("canonical"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("b"), F.col("c_custkey"), F.lit("@x")).alias("other"))
    lines = runbook.mailmap(c).select(F.lit("mailmap").alias("kind"), F.lit(0).cast("long").alias("k"), F.col("line").alias("v"))
    return last.unionByName(top).unionByName(lines)


Q62 = """SELECT 'deployment' AS kind, o_custkey AS k, 'https://d/' || o_orderkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r = 1
UNION ALL SELECT 'newest', o_custkey, o_orderkey::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 2
UNION ALL SELECT 'mailmap', 0, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' <a' || c_custkey || '@x>' ELSE c_name || ' <a' || c_custkey || '@x> <b' || c_custkey || '@x>' END FROM customer"""

QUERIES = {"q53_framed_log": q53, "q54_page_completeness": q54, "q55_overrides": q55, "q55b_override_flags": q55b, "q55c_override_errors": q55c, "q56_contract_findings": q56, "q57_suspect_files": q57, "q58_diff_risk": q58, "q59_method_ladders": q59, "q60_set_differences": q60, "q61_decisions": q61, "q62_latest_by_key": q62}
SQL = {"q53_framed_log": Q53, "q54_page_completeness": Q54, "q55_overrides": Q55, "q55b_override_flags": Q55B, "q55c_override_errors": Q55C, "q56_contract_findings": Q56, "q57_suspect_files": Q57, "q58_diff_risk": Q58, "q59_method_ladders": Q59, "q60_set_differences": Q60, "q61_decisions": Q61, "q62_latest_by_key": Q62}
