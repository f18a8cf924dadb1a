"""Fail-closed evidence gates and decision matrices as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.rules import first_hit

SOURCES = ("check_runs", "commit_statuses", "expected_checks", "pr_workflows")


def ci_verdict() -> Column:
    """classification and reason from check_runs, commit_statuses, expected_checks, pr_workflows and their `_ok` flags.

    Anything that was not collected, is malformed, missing, pending or failed blocks.
    """
    runs, statuses, expected, workflows = (F.col(s) for s in SOURCES)

    def block(reason: str | Column) -> dict:
        return {"classification": "block", "reason": reason}

    observed = F.array_union(F.transform(runs, lambda r: r["name"]), F.transform(statuses, lambda s: s["context"]))
    missing = F.filter(expected, lambda e: ~F.coalesce(F.array_contains(observed, e), F.lit(False)))
    pending = F.filter(runs, lambda r: F.coalesce(r["status"], F.lit("")) != "completed")
    failed = F.filter(runs, lambda r: F.coalesce(r["conclusion"], F.lit("")) != "success")
    bad_status = F.filter(statuses, lambda s: F.coalesce(s["state"], F.lit("")) != "success")
    # the first run that is pending or failed decides, in the order given
    troubled = F.filter(runs, lambda r: (F.coalesce(r["status"], F.lit("")) != "completed") | (F.coalesce(r["conclusion"], F.lit("")) != "success"))
    first = F.element_at(troubled, 1)
    rules = [(~F.coalesce(F.col(f"{s}_ok"), F.lit(False)), block(f"{s} lookup failed")) for s in SOURCES]
    rules += [
        (runs.isNull() | statuses.isNull() | expected.isNull() | workflows.isNull(), block("CI evidence has an invalid shape")),
        (F.exists(expected, lambda x: x.isNull()) | F.exists(workflows, lambda x: x.isNull()), block("expected CI evidence has an invalid shape")),
        (F.exists(runs, lambda r: r.isNull() | (F.coalesce(r["name"], F.lit("")) == "")), block("invalid check-run record")),
        (F.exists(statuses, lambda s: s.isNull() | (F.coalesce(s["context"], F.lit("")) == "")), block("invalid commit-status record")),
        (F.size(missing) > 0, block(F.concat(F.lit("expected check missing: "), F.element_at(missing, 1)))),
        ((F.size(runs) == 0) & (F.size(statuses) == 0) & (F.size(expected) > 0), block("no check runs returned despite configured expected check")),
        ((F.size(runs) == 0) & (F.size(statuses) == 0) & (F.size(workflows) > 0), block("no check runs returned despite configured pull-request workflow")),
        ((F.size(runs) == 0) & (F.size(statuses) == 0), {"classification": "na", "reason": "no CI configured"}),
        ((F.size(pending) + F.size(failed) > 0) & (F.coalesce(first["status"], F.lit("")) != "completed"), block(F.concat(F.lit("check pending: "), first["name"]))),
        (F.size(failed) > 0, block(F.concat(F.lit("check not successful: "), first["name"]))),
        (F.size(bad_status) > 0, block(F.concat(F.lit("commit status not successful: "), F.element_at(bad_status, 1)["context"]))),
    ]
    return first_hit(rules, {"classification": "pass", "reason": "all observed checks successful"})


def head_decision(reviewed: Column, live: Column, restarts: Column) -> Column:
    """promote only the head that was reviewed; one restart; anything else is blocked."""
    sha = "^[0-9a-f]{40}$"
    whole = F.coalesce(reviewed.rlike(sha) & live.rlike(sha), F.lit(False))
    return F.when(~whole, "blocked").when(reviewed == live, "promote").when(restarts == 0, "restart").otherwise("blocked")


def merge_authority(policies: Column) -> Column:
    """auto only if exactly one policy matches and it is `ship`."""
    return F.when((F.size(policies) == 1) & (F.element_at(policies, 1) == "ship"), "auto").otherwise("manual")


def exploitability(scope: Column, manifest: Column) -> Column:
    return F.when(scope == "runtime", "network-reachable").when(F.lower(manifest).rlike("test|spec|__tests__|cypress"), "test-only").otherwise("dev-only")


#: The decision matrix of alerts and the risk of version bumps.
PRIORITY = {
    "critical__network-reachable": "P0", "critical__dev-only": "P1", "high__network-reachable": "P1", "critical__test-only": "P2", "high__dev-only": "P2", "high__test-only": "P2", "medium__network-reachable": "P2",
    "medium__dev-only": "backlog", "medium__test-only": "backlog", "low__network-reachable": "backlog",
}


def alert_priority(severity: Column, scope: Column, manifest: Column) -> Column:
    matrix = F.create_map(*map(F.lit, chain.from_iterable(PRIORITY.items())))
    return F.coalesce(matrix[F.concat_ws("__", severity, exploitability(scope, manifest))], F.lit("dismiss"))


def bump_risk(bump: Column, direct: Column, runtime: Column, core: Column) -> Column:
    return F.when(core, "High").when((bump == "major") & direct & runtime, "High").when((bump == "major") | ((bump == "minor") & direct), "Medium").otherwise("Low")


def merge_action(build_ok: Column, tests_ok: Column, risk: Column, direct: Column) -> Column:
    return F.when(~build_ok | ~tests_ok | (risk == "High"), "flag").when((risk == "Medium") & direct, "write-tests").otherwise("auto-merge")


#: Weights of the readiness dimensions, in percent.
READINESS = {"env": 20, "tests": 25, "context": 15, "ci": 10, "tasks": 10, "secrets": 10, "wiring": 5, "health": 5}


def readiness_score(wired: Column | None = None) -> Column:
    """Weighted mean of the dimensions' scores (0 to 10); without wiring its weight goes to tests."""
    has = F.lit(True) if wired is None else wired
    total = F.lit(0.0)
    for name, weight in READINESS.items():
        w = F.when(has, weight).otherwise(weight + READINESS["wiring"]) if name == "tests" else F.when(has, weight).otherwise(0) if name == "wiring" else F.lit(weight)
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w
    return total / 100


def readiness_tier(score: Column) -> Column:
    return F.when(score >= 8, "READY").when(score >= 6, "NEARLY READY").when(score >= 4, "NEEDS WORK").otherwise("NOT READY")


def grade(red: Column, yellow: Column, documented: Column) -> Column:
    """Letter of ceil(red + yellow / 2) among the applicable signals; F without documents."""
    score = F.ceil(red + yellow * 0.5)
    return F.when(~documented, "F").when(score == 0, "A").when(score == 1, "B").when(score == 2, "C").otherwise("D")
