"""Session logs: signals per session, ordered incident rules, recurrence and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that mark deployments, recovery, missing tools, and forced commands.
DEPLOY = r"\b(deploy|publish|vercel|heroku|production|live|release)\b"
RECOVERY, GAP, FORCE = r"retry|fix|debug|error|fail", r"enoent|command not found|no such file|not installed|permission denied", r"--force|--no-verify|--skip|-f "
RECURRING = 3


def events_of(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed records of a log stream: `data: ` lines, without the end mark; bad JSON is kept and flagged."""
    payload = lines.where(F.startswith("value", F.lit("data: "))).select("session", *keep, F.substring("value", 7, 1 << 30).alias("raw")).where(F.trim("raw") != "[DONE]")
    schema = "timestamp string, message struct<type:string,tool:string,text:string,is_error:boolean>"
    parsed = payload.withColumn("e", F.from_json("raw", schema, {"mode": "PERMISSIVE"}))
    return parsed.select("session", *keep, "raw", "e.timestamp", "e.message.*", F.col("e.message").isNull().alias("is_bad"))


def signals(turns: DataFrame) -> DataFrame:
    """Per session: activity, verification, errors and intent, from turns (session, turn, role, text)."""
    low = F.lower("text")
    n = lambda c: F.count(F.when(c, 1))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return turns.groupBy("session").agg(
        F.count("*").alias("turns"),
        n(assistant).alias("actions"),
        n(assistant & low.rlike("curl|gh pr view")).alias("verifications"),
        n(low.rlike("error|fail")).alias("errors"),
        n(low.rlike(RECOVERY) & assistant).alias("recoveries"),
        n(low.rlike(GAP)).alias("gaps"),
        n(low.rlike(FORCE)).alias("forced"),
        n(low.rlike(DEPLOY) & user).alias("deploys"),
        F.min(F.when(user, F.struct("turn", "text")))["text"].alias("prompt"),
        F.sum(F.length("text")).alias("chars"),
    )


def incidents(signal: DataFrame) -> DataFrame:
    """(session, code, description, evidence): every rule that a session's signals meet."""

    def when(condition: Column, code: str, description: str, evidence: Column) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(description).alias("description"), evidence.alias("evidence")))

    text = lambda c, what: F.concat(F.col(c).cast("string"), F.lit(f" {what}"))
    rules = [
        when((F.col("actions") > 5) & (F.col("verifications") == 0), "SV", "much activity without verification", text("actions", "actions")),
        when((F.col("errors") >= 2) & (F.col("recoveries") == 0), "SF", "errors without visible recovery", text("errors", "errors")),
        when((F.col("deploys") > 0) & (F.col("verifications") == 0), "UA", "deployment without a check of the response", text("deploys", "requests")),
        when(F.col("forced") > 0, "UB", "forced or skipped checks", text("forced", "commands")),
        when(F.col("gaps") > 0, "SG", "missing tools or permissions", text("gaps", "errors")),
        when(F.col("turns") >= 12, "CF", "many turns", text("turns", "turns")),
    ]
    return signal.select("session", "chars", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("i")).select("session", "chars", "i.*")


def recurrence(found: DataFrame, keys: list[str], least: int = RECURRING) -> DataFrame:
    """Groups with enough incidents, and the one of the longest evidence (ties to the smallest session)."""
    best = F.max(F.struct(F.length("evidence").alias("n"), (-F.col("session")).alias("first"), "evidence"))
    grouped = found.groupBy(*keys).agg(F.count("*").alias("incidents"), best.alias("b"))
    return grouped.where(F.col("incidents") >= least).select(*keys, "incidents", F.col("b.evidence").alias("exemplar"), (-F.col("b.first")).alias("session"))


def trend(current: DataFrame, prior: DataFrame, key: str = "code") -> DataFrame:
    """Counts of both periods by key, missing ones as 0, and the direction."""
    joined = current.groupBy(key).agg(F.count("*").alias("c")).join(prior.groupBy(key).agg(F.count("*").alias("p")), key, "full")
    c, p = F.coalesce("c", F.lit(0)), F.coalesce("p", F.lit(0))
    return joined.select(key, c.alias("current"), p.alias("prior"), F.when(c < p, "improving").when(c > p, "worsening").otherwise("stable").alias("trend"))
