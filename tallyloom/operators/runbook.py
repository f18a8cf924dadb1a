"""Smaller decisions and reconciliations, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.globs import matched
from tallyloom.functions.rules import glob_regex, matches_any
from tallyloom.session import ship

#: File names that hardly belong in a repository, by first hit.
SUSPECT = [
    (".env", "dotenv"), (".env.local", "local env"), ("credentials.json", "credentials"), ("service-account.json", "service account"), ("*.pem", "private key"), ("*.key", "private key"), ("*.pyc", "bytecode"), (".DS_Store", "metadata"),
    ("Thumbs.db", "thumbnails"), ("*.swp", "swap file"), ("*.swo", "swap file"), (".idea/", "IDE config"), (".vscode/launch.json", "debug config"), ("*.sqlite", "database"), ("*.db", "database"),
]
ENVIRONMENTS, REGIONS_NEEDED = ("local", "preview", "production"), 2
#: What a captcha contract and a translated page must assert, and words of templates.
CAPTCHA_ASSERTIONS, VISIBLE_REGIONS, TEMPLATES = ("renders", "token", "submission", "success-ui", "backend-boundary"), ("header", "main", "form", "footer"), "booster-pack|example|template|changeme|localhost"


def suspect_file(path: Column) -> Column:
    """Why a file is suspect, by its name, else NULL."""
    name, chain = F.substring_index(path, "/", -1), None
    for glob, reason in SUSPECT:
        hit = name.rlike(glob_regex(glob))
        chain = F.when(hit, reason) if chain is None else chain.when(hit, reason)
    return chain


def misplaced_test(path: Column) -> Column:
    """A test file outside any test directory."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    return name.rlike(r"(^test_.*|.*[._-](test|spec))\.[a-z]+$") & ~F.arrays_overlap(parts, F.array(*map(F.lit, ("test", "tests", "spec", "__tests__", "e2e", "cypress"))))


def diff_risk(paths: Column, changed: Column, added: Column, docs_only: Column) -> Column:
    """HIGH, LOW or MEDIUM with every reason that fired."""
    reasons = F.filter(
        F.array(
            F.when(F.exists(paths, lambda p: p.rlike("/migrations/")), "migration"),
            F.when(F.exists(paths, lambda p: F.lower(p).rlike("auth|token|jwt|secret|cred|session")), "auth-surface"),
            F.when(F.lower(added).rlike("import .*(client|sdk)|http|queue"), "boundary"),
            F.when(changed > 400, "large"),
        ),
        lambda x: x.isNotNull(),
    )
    tier = F.when(F.size(reasons) > 0, "HIGH").when(docs_only | (changed <= 150), "LOW").otherwise("MEDIUM")
    return F.struct(tier.alias("tier"), F.array_join(reasons, ",").alias("reasons"))


def inherited_method(classified: Column, llm: Column, weak: Column) -> Column:
    """A metric's method follows the weakness of what it was computed from."""
    return F.when(classified == 0, "script").when(llm * 2 > classified, "llm").when(weak > 0, "script-with-fallback").otherwise("script")


def resolution(source: Column, have: Column, interrupted: Column, resolved: Column, has_sample: Column, in_scope: Column) -> Column:
    """Method and reason of an identity's resolution; the first reason that holds."""
    from tallyloom.functions.rules import first_hit

    known = have == 1
    return first_hit(
        [
            (known & (source == "api"), {"method": "script", "detail": "api"}),
            (known & (source == "manual"), {"method": "script-with-fallback", "detail": "manual confirmation"}),
            (known & (source == "mailmap"), {"method": "script-with-fallback", "detail": "mailmap"}),
            (known, {"method": "script-with-fallback", "detail": F.concat(F.lit("pre-existing link, source="), source)}),
            (interrupted == 1, {"method": "llm", "detail": "interrupted by a rate limit"}),
            (resolved == 0, {"method": "llm", "detail": "not resolved yet"}),
            (has_sample == 0, {"method": "llm", "detail": "no sample commit"}),
            (in_scope == 0, {"method": "llm", "detail": "sample outside the scope"}),
        ],
        {"method": "llm", "detail": "no login for this address"},
    )


def resolved_identities(emails: DataFrame, rules: DataFrame) -> DataFrame:
    """emails (email, login) with override rules (line, directive, key, value) applied: the last matching line wins.

    Literal addresses join by equality; globs, any number of them, are matched by their common trie.
    """
    ship(emails.sparkSession)
    usable = rules.where("error is null and directive = 'email'")
    wild = F.col("key").rlike(r"[*?]")
    exact = usable.where(~wild).select(F.lower("key").alias("email"), F.col("line").cast("long").alias("line"))
    hits = emails.select("email").distinct()
    hits = matched(hits, usable.where(wild), "email", glob="key").select("email", "line").unionByName(exact)
    last = hits.groupBy("email").agg(F.max("line").alias("line")).join(usable.select(F.col("line").cast("long").alias("line"), "value"), "line").select("email", "value")
    return emails.join(last, "email", "left").select("email", F.coalesce("value", "login").alias("login"), F.when(F.col("value").isNotNull(), "manual").when(F.col("login").isNotNull(), "api").alias("source"))


def flags_after(people: DataFrame, rules: DataFrame) -> DataFrame:
    """people (login, is_bot, is_excluded) after bot, human, exclude and alias directives, each by its last line."""
    acts = rules.where("error is null and directive in ('bot', 'human', 'exclude', 'alias')").select(F.col("key").alias("login"), "line", "directive")
    last = acts.groupBy("login").agg(F.max(F.when(F.col("directive").isin("bot", "human"), F.struct("line", "directive")))["directive"].alias("kind"), F.max(F.when(F.col("directive").isin("exclude", "alias", "human"), F.struct("line", "directive")))["directive"].alias("shut"))
    bot = F.when(F.col("kind") == "bot", 1).when(F.col("kind") == "human", 0).otherwise(F.col("is_bot"))
    out = F.when(F.col("shut").isin("exclude", "alias"), 1).when(F.col("shut") == "human", 0).otherwise(F.col("is_excluded"))
    return people.join(last, "login", "left").select("login", bot.alias("is_bot"), out.alias("is_excluded"))


def mailmap(links: DataFrame) -> DataFrame:
    """One line per address: `Name <canonical> <other>`, or without the second address where they are the same."""
    return links.select(F.when(F.lower("canonical") == F.lower("other"), F.format_string("%s <%s>", "name", "canonical")).otherwise(F.format_string("%s <%s> <%s>", "name", "canonical", "other")).alias("line"))


def review_promotion(verdict: Column, live: Column, state: Column) -> Column:
    """Decision of the first check from its verdict, the live head and the review state (JSON)."""
    s = F.from_json(state, "v int, head_sha string, findings array<struct<status:string>>")
    broken = s.isNull() | F.coalesce(s["v"] != 1, F.lit(True)) | s["findings"].isNull()
    open_ = F.exists(s["findings"], lambda f: f["status"].isin("open", "confirmed"))
    return (
        F.when(F.coalesce(verdict, F.lit("")) != "ready", "needs-work:negative-verdict")
        .when(~F.coalesce(live.rlike("^[0-9a-f]{40}$"), F.lit(False)) | broken, "needs-work:invalid-review-state")
        .when(F.coalesce(s["head_sha"], F.lit("")) != live, "needs-work:review-state-head-mismatch")
        .when(F.coalesce(open_, F.lit(False)), "needs-work:blocking-findings")
        .otherwise("promote")
    )


CONFIG = "repo string, environments map<string,struct<url:string,mode:string,captcha:string,site_key:string>>, critical array<string>"


def contract_findings(configs: DataFrame, flows: DataFrame, mode: str = "production", expected: str | None = None) -> DataFrame:
    """(config_id, code, subject) of everything wrong with configurations (config_id, config) and their flows.

    flows: (config_id, name, readable, interactive, captcha, captcha_optional, assertions, evidence,
    kind, regions, locales). An unreadable or missing part is a finding, never a pass; of an
    unreadable configuration or flow nothing else is said.
    """
    c = F.from_json("config", CONFIG, {"mode": "PERMISSIVE"})
    rows = configs.select("config_id", c.alias("c"), F.try_parse_json("config").isNotNull().alias("readable"))
    env = F.coalesce(F.col("c.environments"), F.create_map().cast("map<string,struct<url:string,mode:string,captcha:string,site_key:string>>"))
    repo = F.coalesce(F.col("c.repo"), F.lit(""))
    at = lambda name, field: F.try_element_at(env, F.lit(name))[field]
    no, shaped = F.lit(False), repo.rlike(r"^[^/\s]+/[^/\s]+$")
    url = F.coalesce(at("production", "url"), F.lit(""))
    code = lambda cond, name, subject="": F.when(cond, F.struct(F.lit(name).alias("code"), (subject if isinstance(subject, Column) else F.lit(subject)).alias("subject")))
    spaced = lambda name: F.coalesce(at(name, "site_key") != F.trim(at(name, "site_key")), no)
    rules = [
        code(~shaped, "identity-missing"),
        code(shaped & F.lower(repo).rlike(TEMPLATES), "template-identity", repo),
        *([code(shaped & (F.lower(repo) != expected.lower()), "identity-mismatch", repo)] if expected else []),
        code(F.col("c.environments").isNull(), "environments-missing"),
        *[code(~F.map_contains_key(env, F.lit(e)), f"environment-{e}-missing") for e in ENVIRONMENTS],
        code(~(url.rlike("^https://") & ~url.rlike("localhost|127\\.0\\.0\\.1")), "production-url-invalid", url),
        code(~F.coalesce(at("local", "captcha").isin("disabled", "required"), no), "local-captcha-implicit"),
        code(~F.coalesce(at("preview", "mode").isin("on-demand", "existing", "disabled"), no), "preview-mode-invalid"),
        *[code(spaced(e), "captcha-site-key-whitespace", e) for e in ("preview", "production")],
        code(F.size(F.coalesce(F.col("c.critical"), F.array().cast("array<string>"))) == 0, "critical-smoke-empty"),
    ]
    said = F.when(F.col("readable"), F.filter(F.array(*rules), lambda x: x.isNotNull())).otherwise(F.array(code(F.lit(True), "config-unreadable")))
    own = rows.select("config_id", F.explode(said).alias("f")).select("config_id", "f.*")
    wanted = rows.where("readable").select("config_id", F.explode("c.critical").alias("name"), F.coalesce(at("production", "captcha"), F.lit("")).alias("required")).where(F.trim("name") != "")
    joined = wanted.join(flows.withColumnRenamed("readable", "known"), ["config_id", "name"], "left")
    live, seen = F.lit(mode in ("production", "cron")), F.lit(mode in ("production", "preview", "cron"))
    words = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    lacks = lambda have, need: F.size(F.array_except(F.array(*map(F.lit, need)), words(F.col(have)))) > 0
    captcha, i18n, name = F.coalesce("captcha", no), F.coalesce(F.col("kind") == "i18n", no), F.col("name")
    flow_rules = [
        code(seen & (F.coalesce("interactive", no) | captcha) & (F.coalesce("evidence", F.lit("")) != "required"), "interactive-browser-evidence-required", name),
        code(live & captcha & F.coalesce("captcha_optional", no), "production-captcha-optional", name),
        code(live & captcha & lacks("assertions", CAPTCHA_ASSERTIONS), "captcha-contract-incomplete", name),
        code(live & captcha & (F.col("required") != "required"), "production-captcha-not-required"),
        code(i18n & lacks("regions", VISIBLE_REGIONS), "i18n-visible-copy-incomplete", name),
        code(i18n & (F.size(words(F.col("locales"))) < REGIONS_NEEDED), "i18n-locales-incomplete", name),
    ]
    told = F.when(F.col("known").isNull(), F.array(code(F.lit(True), "critical-flow-missing", name))).when(~F.col("known"), F.array(code(F.lit(True), "flow-unreadable", name))).otherwise(F.filter(F.array(*flow_rules), lambda x: x.isNotNull()))
    of_flows = joined.select("config_id", F.explode(told).alias("f")).select("config_id", "f.*")
    return own.unionByName(of_flows.distinct())


def claims_without_source(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Documented tokens with OK or DRIFT by whether the very token (no substring) occurs in the sources."""
    tokens = sources.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_./-]+"), F.lit(0))).alias("claim")).distinct().withColumn("seen", F.lit(1))
    return claims.join(tokens, "claim", "left").select("claim", F.when(F.col("seen") == 1, "OK").otherwise("DRIFT").alias("verdict"))


def resumed(issues: DataFrame, prs: DataFrame, branches: DataFrame) -> DataFrame:
    """The open review of each issue: one that closes it, else the one on the only branch with the number as a segment."""
    exact = prs.select(F.explode("closes").alias("issue"), "pr").groupBy("issue").agg(F.min("pr").alias("exact_pr"))
    numbered = branches.select("branch", F.explode(F.array_distinct(F.regexp_extract_all("branch", F.lit(r"(?<![^-_/])(\d+)(?![^-_/])"), F.lit(1))).cast("array<bigint>")).alias("issue"))
    only = numbered.groupBy("issue").agg(F.count("*").alias("n"), F.min("branch").alias("branch")).where("n = 1").join(prs.select(F.col("head").alias("branch"), F.col("pr").alias("branch_pr")), "branch")
    return issues.join(exact, "issue", "left").join(only.select("issue", "branch_pr"), "issue", "left").select("issue", F.coalesce("exact_pr", "branch_pr").alias("pr"))


def drift(installed: DataFrame, source: DataFrame) -> DataFrame:
    """Installed against source digests by name."""
    both = installed.select("name", F.col("digest").alias("i")).join(source.select("name", F.col("digest").alias("s")), "name", "full")
    return both.select("name", F.when(F.col("i").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("i") == F.col("s"), "same").otherwise("drifted").alias("state"))


def defined_not_referenced(defined: DataFrame, used: DataFrame, name: str) -> DataFrame:
    return defined.select(name).distinct().join(used.select(name).distinct(), name, "left_anti")


def latest_deployment(deployments: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The newest successful deployment of each commit."""
    good = deployments.where("state = 'success'")
    return good.groupBy(by).agg(F.max(F.struct(*order, "url")).alias("d")).select(by, "d.*")


def claim_check(title: Column, body: Column, status: Column) -> Column:
    """How far a severe claim is verified, from its words, a production URL, its status and evidence."""
    severe = F.lower(F.concat_ws(" ", title, body)).rlike(r"\bp[01]\b|\b500\b|\bdown\b|\bbroken\b|\bproduction\b")
    has_url = body.rlike(r"https://(?!github\.com)[^\s]+")
    evidence = F.lower(body).rlike("curl|screenshot|error log|stack trace")
    return F.when(~severe, "standard").when(has_url & (status.isNull() | (status >= 500)), "confirmed").when(has_url, "unverified").when(evidence, "needs-review").otherwise("unverified-no-evidence")


def ui_trigger(paths: Column, globs: list[str], extensions: list[str]) -> Column:
    """Whether any path is of the user interface: by glob, else by extension."""
    return F.exists(paths, lambda p: matches_any(p, globs, segments=True) | F.substring_index(p, ".", -1).isin(*extensions))


def newest_first(df: DataFrame, key: list[str], order: str, most: int) -> DataFrame:
    """The newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
