"""Mission logs: signals of a session's messages, incident rules, rule compliance, what was missed, timing and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tools, words and commands that the rules look for.
TOOLS = ("Read", "Bash", "Edit", "Write", "Grep", "Glob", "Agent", "WebFetch", "WebSearch", "TodoWrite", "TodoRead", "AskUserQuestion")
ACTIONS = ("Bash", "Edit", "Write", "Agent")
VERIFY = r"curl |gh pr view|gh pr merge|gh pr list|gh run"
ERRORS = r"enoent|permission denied|timeout|crash|error:|exception:"
GAPS = r"enoent|command not found|no such file|not installed|permission denied"
RECOVERY = r"retry|fix|debug|error|fail"
DEPLOY = r"\b(deploy|publish|vercel|heroku|production|live|release)\b"
FORCED = r"--force|--no-verify|--skip|-f "
EXPECTED_PATHS = r"reports/|tmp/|\.claude/"
FEATURE = r"implement|feature|add|build|create|fix|update"
MARKERS = {"started": r"container start|ecs task started|bootstrap", "called": r"claude api|anthropic\.messages\.create|invoking claude", "answered": r"first token|stream started|content_block_start", "done": r"\bdone\b"}


def tool_of(message: Column) -> Column:
    """The first tool that a message names, else the empty string."""
    return F.regexp_extract(message, rf"\b({'|'.join(TOOLS)})\b", 1)


def command_of(message: Column) -> Column:
    """The shell command in a message, else the empty string."""
    return F.trim(F.regexp_extract(message, r'command["\s:]+(.+?)(?:,\s*"|\}|$)', 1))


def path_of(message: Column) -> Column:
    """The file path in a message, else the empty string."""
    return F.regexp_extract(message, r'file_path["\s:]+([^\s",}]+)', 1)


def signals(lines: DataFrame) -> DataFrame:
    """Signals per session from log lines (session, at, seq, message); one aggregate, combined map-side.

    The prompt is the first message with `task:` by at and seq. A null message is an empty one.
    """
    text = F.coalesce("message", F.lit(""))
    low = F.lower(text)
    tool = tool_of(text)
    command = F.when(tool == "Bash", command_of(text)).otherwise("")
    path = F.when(tool.isin("Read", "Write"), path_of(text)).otherwise("")
    rows = lines.select("session", "at", "seq", low.alias("low"), tool.alias("tool"), command.alias("cmd"), path.alias("path"))
    cmd, low = F.col("cmd"), F.col("low")
    n = lambda c: F.count(F.when(c, 1))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    wrote = (F.col("tool") == "Write") & (F.col("path") != "")
    pushed = cmd.rlike(r"git\s+push")
    error = low.rlike(ERRORS)
    number = lambda name: F.sum(F.nullif(F.regexp_extract(low, rf'{name}["\s:]+(\d+)', 1), F.lit("")).cast("long"))
    found = rows.groupBy("session").agg(
        F.count("*").alias("lines"),
        n(F.col("tool").isin(*ACTIONS)).alias("actions"),
        n((F.col("tool") == "Agent") | cmd.rlike(r"\bclaude\s+(-p|--print)\b")).alias("workers"),
        n(F.col("tool") == "Edit").alias("edits"),
        n(F.col("tool") == "AskUserQuestion").alias("questions"),
        n(cmd.rlike(VERIFY)).alias("verifications"),
        n(error).alias("errors"),
        n(error & low.rlike(GAPS)).alias("gaps"),
        n(F.lower(cmd).rlike(RECOVERY)).alias("recoveries"),
        n(cmd.rlike(FORCED)).alias("forced"),
        n(wrote & ~F.lower("path").rlike(EXPECTED_PATHS)).alias("unexpected_writes"),
        any_(wrote & F.col("path").rlike("src/|app/")).alias("wrote_code"),
        any_(F.lower(cmd).contains("rules.md") | (wrote & F.lower("path").contains("rules"))).alias("rules_read"),
        n((F.col("tool") == "Read") & F.col("path").contains(".claude/skills/")).alias("skills"),
        any_(cmd.rlike(r"git\s+(checkout\s+-b|switch\s+-c)")).alias("branched"),
        any_(cmd.rlike(r"git\s+commit")).alias("committed"),
        any_(pushed).alias("pushed"),
        any_(pushed & cmd.rlike("--force| -f ")).alias("force_pushed"),
        any_(cmd.contains("gh pr create")).alias("pr_created"),
        any_(F.lower(cmd).contains("gh issue close")).alias("issue_closed"),
        any_(cmd.rlike(r"git\s+log.*--remotes|gh\s+api.*commits/|git\s+log.*origin/")).alias("push_verified"),
        any_(F.lower(cmd).contains("curl")).alias("curled"),
        F.min(F.when(low.contains("task:"), F.struct("at", "seq", F.left(low, F.lit(500)).alias("text"))))["text"].alias("prompt"),
        number("input_tokens").alias("input_tokens"),
        number("output_tokens").alias("output_tokens"),
        *[F.min(F.when(low.rlike(p), F.col("at"))).alias(name) for name, p in MARKERS.items()],
    )
    return found.withColumn("to_main", F.col("committed") & ~F.col("branched"))


def incidents(signal: DataFrame) -> DataFrame:
    """(session, code, rule, evidence): every one of the twelve rules that a session's signals meet."""

    def rule(condition: Column, code: str, name: str, count: str | None = None) -> Column:
        evidence = F.concat(F.col(count).cast("string"), F.lit(f" {count}")) if count else F.lit("seen in commands")
        return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(name).alias("rule"), evidence.alias("evidence")))

    rules = [
        rule((F.col("actions") > 5) & (F.col("verifications") == 0), "SV", "no-verification", "actions"),
        rule(F.col("rules_read") & (F.col("errors") >= 2), "MB", "rules-read-yet-errors", "errors"),
        rule((F.col("errors") >= 2) & (F.col("recoveries") == 0), "SF", "no-recovery", "errors"),
        rule(F.coalesce(F.col("prompt").rlike(DEPLOY), F.lit(False)) & ~F.col("curled"), "UA", "deployment-unchecked"),
        rule(F.col("forced") > 0, "UB", "forced-commands", "forced"),
        rule(F.col("unexpected_writes") > 3, "ID", "writes-elsewhere", "unexpected_writes"),
        rule(F.col("gaps") > 0, "SG", "missing-capability", "gaps"),
        rule(F.col("workers") >= 3, "CF", "many-workers", "workers"),
        rule(F.col("to_main") & ~F.col("pr_created"), "SV", "committed-to-main"),
        rule(F.col("committed") & ~F.col("pushed"), "SF", "never-pushed"),
        rule(F.col("issue_closed") & ~F.col("push_verified"), "UA", "closed-unverified"),
        rule(F.col("force_pushed"), "UB", "force-pushed"),
    ]
    return signal.select("session", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("i")).select("session", "i.*")


def missed(signal: DataFrame) -> DataFrame:
    """(session, missed): the first thing that would have helped most, NULL where nothing did."""
    codes = incidents(signal).groupBy("session").agg(F.collect_set("code").alias("codes"))
    has = lambda c: F.array_contains("codes", c)
    ladder = (
        F.when(has("SF") & ~F.col("pushed"), "push-and-verify")
        .when(has("SV") & F.col("to_main"), "branch-and-review")
        .when(has("UA") & F.col("issue_closed"), "verify-before-closing")
        .when(has("SV"), "verify-before-exit")
        .when(has("SG"), "load-the-skill")
        .when(has("UA"), "check-the-deployment")
    )
    return signal.join(codes, "session", "left").select("session", ladder.alias("missed"))


def compliance(signal: DataFrame, tasks: DataFrame) -> DataFrame:
    """Whether each rule was kept, from signals and tasks (session, task, has_report); a missing task is no feature."""
    feature = F.coalesce(F.lower("task").rlike(FEATURE), F.lit(False))
    return signal.join(tasks, "session", "left").select(
        "session",
        (F.col("questions") == 0).alias("r1_headless"),
        ((F.col("edits") == 0) & ~F.col("wrote_code")).alias("r3_no_code"),
        (F.col("skills") > 0).alias("r4_read_skills"),
        (F.col("verifications") > 0).alias("r6_verify"),
        F.coalesce("has_report", F.lit(False)).alias("r7_report"),
        F.col("branched").alias("r_branch"),
        F.col("pushed").alias("r_push"),
        (F.col("pr_created") | ~feature).alias("r_pr"),
    )


def millis(first: Column, last: Column) -> Column:
    """Milliseconds between two markers, NULL where one is missing."""
    return F.unix_millis(last.cast("timestamp")) - F.unix_millis(first.cast("timestamp"))


def timings(signal: DataFrame, ended: DataFrame, price_in: float = 3e-6, price_out: float = 15e-6) -> DataFrame:
    """Delays between a session's markers in ms, its tokens and what they cost at prices a token; ended: (session, ended_at)."""
    cost = F.coalesce("input_tokens", F.lit(0)) * price_in + F.coalesce("output_tokens", F.lit(0)) * price_out
    joined = signal.join(ended, "session", "left")
    return joined.select("session", millis(F.col("started"), F.col("called")).alias("cold_start_ms"), millis(F.col("called"), F.col("answered")).alias("first_token_ms"), millis(F.col("done"), F.col("ended_at")).alias("done_to_ended_ms"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.round(cost, 6).alias("cost"))
