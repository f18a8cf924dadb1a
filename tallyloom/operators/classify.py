"""Classification of reviews by title, labels and branches: ten ordered stages, first hit wins."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.rules import first_hit, first_pattern
from tallyloom.functions.text import capped

# Vocabularies of the classification rules, by the class they mean.
TYPE_CLASS = {
    "feature": ["feat", "feature"],
    "bugfix": ["fix", "bugfix", "bug", "hotfix", "security", "sec"],
    "refactor": ["perf", "refactor", "remove", "cleanup", "deprecate"],
    "chore": ["style", "build", "ci", "chore", "infra", "ops", "config", "release"],
    "docs": ["docs", "doc"],
    "test": ["test", "tests", "spec", "specs"],
    "deps": ["deps", "dep"],
    "revert": ["revert"],
}
LABEL_CLASS = {
    "bugfix": ["bug", "bugfix", "bug-fix", "defect", "regression", "fix", "hotfix", "security"],
    "feature": ["feature", "enhancement", "feat", "new feature", "new-feature", "improvement"],
    "docs": ["documentation", "docs", "doc"],
    "test": ["test", "tests", "testing"],
    "refactor": ["refactor", "refactoring", "tech-debt", "technical-debt", "cleanup", "performance", "perf"],
    "chore": ["chore", "maintenance", "housekeeping", "ci", "build", "infrastructure", "infra", "release"],
    "revert": ["revert"],
    "deps": ["dependencies", "deps", "dependency", "dependabot", "renovate"],
}
BRANCH_CLASS = {
    "feature": ["feature", "feat", "features"],
    "bugfix": ["fix", "bugfix", "bug", "fixes", "hotfix", "patch"],
    "chore": ["chore", "task", "maint", "maintenance", "ci", "build", "release", "rel"],
    "docs": ["docs", "doc"],
    "refactor": ["refactor", "refac", "cleanup", "perf"],
    "test": ["test", "tests"],
    "deps": ["deps", "dependencies"],
}
# Branches of promotions and of dependency tools, verbs of titles, agents and machines.
PROMOTED, TARGETS = ("develop", "dev", "staging", "stage", "release", "rc"), ("main", "master", "production", "prod", "release", "stable")
DEPENDENCY_BRANCH = r"^(dependabot|renovate|snyk-fix|greenkeeper|depfu|pyup|whitesource|mend)[/_-]"
VERBS = [
    ("chore", "verb:release", 0.60, "release", r"^(bump|prepare|cut|tag) (the )?(version|release)|^release[ :]"),
    ("deps", "verb:bump", 0.60, "", r"^(bump|upgrade|revendor|vendor) |^update .+ (to|from) v?[0-9]|^update (dependenc|package|gem|npm|yarn|pnpm|cargo|go\.mod|lock|vendor)"),
    ("docs", "verb:docs", 0.60, "", r"^(document|readme|changelog)|^(add(s|ed|ing)?|update[sd]?|improve[sd]?|fix(es|ed)?) (the )?(docs|documentation|readme|changelog|comment)"),
    ("test", "verb:test", 0.60, "", r"^(add(s|ed|ing)?|write|writes|improve[sd]?|fix(es|ed)?) (unit |integration |e2e |flaky |failing )*(test|spec)|^(test|spec)(s|ing)? "),
    ("bugfix", "verb:fix", 0.55, "", r"^(fix(es|ed|ing)?|resolve[sd]?|correct(s|ed)?|repair(s|ed)?|patch(es|ed)?|handle|prevent|guard against|escape|sanitiz|sanitis) "),
    ("refactor", "verb:refactor", 0.55, "", r"^(refactor|rename|extract|simplify|reorganis|reorganiz|restructure|deduplicate|dedupe|inline|split|move|remove|delete|drop|replace|convert|migrate|switch|unify|consolidate|normalis|normaliz|modernis|moderniz|deprecate|stop|avoid|reduce|optimis|optimiz|tidy) |^clean ?up |^(speed up|improve performance|make .*(thread|ractor|memory)[- ]safe)"),
    ("feature", "verb:add", 0.55, "", r"^(add(s|ed|ing)?|implement(s|ed)?|introduce[sd]?|create[sd]?|support|enable|allow|expose|extend|expand) "),
]
AGENTS = [
    ("claude", r"(^|[^a-z])claude([^a-z]|$)|anthropic\.com|noreply@anthropic"), ("copilot", r"copilot"), ("codex", r"(^|[^a-z])codex([^a-z]|$)|chatgpt|openai\.com"), ("cursor", r"cursor(agent|\.(com|sh))|@cursor"),
    ("devin", r"devin(-ai)?|cognition"), ("gemini", r"gemini|google-labs-jules|jules@"), ("aider", r"aider(\.chat)?"), ("windsurf", r"windsurf|codeium"), ("amp", r"ampcode|@amp\."), ("ona", r"ona\.com|@ona\b|gitpod"),
    ("opencode", r"opencode|openhands|all-hands"), ("ci-agent", r"(^|[^a-z])ci-agent([^a-z]|$)"), ("other-ai", r"noreply@.*(ai|agent)|@[a-z0-9.-]*\.ai($|>)"),
]
BOTS = [
    r"\[bot\]$", r"^dependabot", r"^renovate", r"^snyk-", r"^greenkeeper", r"^github-actions", r"^ci-agent-app$", r"^claude(-|$)", r"^copilot(-|$)", r"^web-flow$", r"^imgbot", r"^allcontributors", r"^codecov", r"^semantic-release-bot$",
    r"^cursoragent$", r"^devin-ai-integration", r"^sweep-ai", r"^codegen-sh", r"^ona-agent",
]


def lookup(by_class: dict[str, list[str]]) -> Column:
    """A map literal from word to class."""
    pairs = [(w, c) for c, words in by_class.items() for w in words]
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def label_set(label_csv: Column) -> Column:
    """Labels, trimmed, in lower case, without prefixes such as `type:`."""
    clean = F.transform(F.split(F.lower(label_csv), ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(type|kind|cat|category|area|t|c|a|p)[:/ -]+", "")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def classified(rows: DataFrame, heuristics: bool = True) -> DataFrame:
    """rows (title, label_csv, head_ref, base_ref, has_issue_link, is_dep_bot) with class, rule, method, confidence, is_revert, subtype and gap."""
    blank = {c: F.coalesce(c, F.lit("")) for c in ("title", "label_csv", "head_ref", "base_ref")}
    low = rows.withColumns({"_t": F.lower(blank["title"]), "_h": F.lower(blank["head_ref"]), "_b": F.lower(blank["base_ref"]), "_l": label_set(blank["label_csv"])})
    prefix = r"^([a-z][a-z-]*)(\([^)]*\))?!?:"
    low = low.withColumns({"_type": F.regexp_extract("_t", prefix, 1), "_scope": F.regexp_replace(F.regexp_extract("_t", prefix, 2), r"[()]", ""), "_seg": F.when(F.col("_h").rlike(r"^[a-z0-9._]+[/_-]"), F.regexp_extract("_h", r"^([a-z0-9._]+)[/_-]", 1)).when(F.col("_h").rlike("^[a-z]+$"), F.col("_h")).otherwise("")})
    types, labels, branches = lookup(TYPE_CLASS), lookup(LABEL_CLASS), lookup(BRANCH_CLASS)
    low = low.withColumns({"_class": F.array_distinct(F.filter(F.transform("_l", lambda x: labels[x]), lambda c: c.isNotNull())), "_hit": F.array_min(F.filter("_l", lambda x: labels[x].isNotNull())), "_verb": F.regexp_replace(F.regexp_replace("_t", r"^\[[^\]]*\][ \t]*", ""), r"^[a-z0-9/_.-]+:[ \t]+", "")})
    t, h, kind, labelled = F.col("_t"), F.col("_h"), F.col("_type"), F.col("_l")

    def has(*names: str) -> Column:
        return F.arrays_overlap(labelled, F.array(*map(F.lit, names)))

    def out(cls, rule, method: str, confidence: float, revert: Column | int = 0, subtype: Column | str = "") -> dict:
        return {"class": cls, "rule": rule, "method": method, "confidence": confidence, "is_revert": (revert if isinstance(revert, Column) else F.lit(revert)).cast("int"), "subtype": subtype}

    def subtype(word: Column) -> Column:
        return F.when(word.isin("hotfix", "release"), word).otherwise("")

    sure, weak = "script", "script-with-fallback"
    one_label = F.size("_class") == 1
    rules = [
        (h.rlike(r"^revert-[0-9]+-"), out("revert", "revert:head-branch", sure, 0.99, 1)),
        (kind == "revert", out("revert", "revert:cc-prefix", sure, 0.95, 1)),
        (t.rlike("^revert[ :\"']") | (t == "revert"), out("revert", "revert:title", sure, 0.95, 1)),
        (t.rlike("^reapply[ :\"']"), out("chore", "revert:reapply-rollforward", weak, 0.60)),
        (h.rlike(r"^revert[/_-]"), out("revert", "revert:head-prefix", weak, 0.80, 1)),
        (has("revert"), out("revert", "revert:label", weak, 0.80, 1)),
        (F.coalesce(F.col("is_dep_bot"), F.lit(0)) != 0, out("deps", "deps:bot-author", sure, 0.99)),
        (h.rlike(DEPENDENCY_BRANCH), out("deps", "deps:head-branch", sure, 0.95)),
        ((kind != "") & F.col("_scope").rlike("^(dev-?)?deps"), out("deps", "deps:cc-scope", sure, 0.95)),
        (t.rlike("^bump .+ from .+ to "), out("deps", "deps:bump-title", sure, 0.90)),
        (has("dependencies", "deps", "dependency"), out("deps", "deps:label", weak, 0.85)),
        (types[kind].isNotNull(), out(types[kind], F.concat(F.lit("cc:"), kind), sure, 0.95, 0, subtype(kind))),
        (t.rlike(r"^release[ :v_-]|^v?[0-9]+\.[0-9]+\.[0-9]+([ )]|$)"), out("chore", "release:title", weak, 0.70, 0, "release")),
        (h.rlike(r"^(release|rc)[/_-]"), out("chore", "release:head-branch", weak, 0.75, 0, "release")),
        (one_label, out(F.element_at("_class", 1), F.concat(F.lit("label:"), F.col("_hit")), weak, 0.80, F.element_at("_class", 1) == "revert", subtype(F.col("_hit")))),
        (branches[F.col("_seg")].isNotNull(), out(branches[F.col("_seg")], F.concat(F.lit("branch:"), F.col("_seg")), weak, 0.70, 0, subtype(F.col("_seg")))),
        (h.isin(*PROMOTED) & F.col("_b").isin(*TARGETS) & (h != F.col("_b")), out("chore", "release:promotion", weak, 0.60, 0, "release")),
        (t.rlike(r"^(automated )?cherry[- ]pick|^\[?backport\]?[ :]") | h.rlike("^(backport|cherry-pick|automated-cherry-pick)") | has("backport", "cherry-pick"), out("chore", "backport:cherry-pick", weak, 0.80)),
    ]
    if heuristics:
        rules += [(F.col("_verb").rlike(p), out(c, rule, weak, conf, 0, sub)) for c, rule, conf, sub, p in VERBS]
    gap = F.concat_ws(
        "+",
        F.when(kind == "", "no-cc-prefix").otherwise(F.concat(F.lit("unmapped-cc-prefix("), kind, F.lit(")"))),
        F.when(F.size("_class") > 1, "label-conflict").when(F.size("_l") == 0, "no-labels").otherwise("no-mapped-label"),
        F.when(blank["head_ref"] == "", "no-head-ref").otherwise("no-branch-pattern"),
        F.lit("no-title-verb" if heuristics else "heuristics-disabled"),
        F.when(F.coalesce(F.col("has_issue_link"), F.lit(0)) != 0, "has-issue-link"),
    )
    needs = F.concat(F.lit("needs-llm labels=["), capped(blank["label_csv"], 60), F.lit("] head=["), capped(blank["head_ref"], 40), F.lit("]"))
    nothing = {"class": "unclassified", "rule": needs, "method": "llm", "confidence": F.lit(None).cast("double"), "is_revert": F.lit(0), "subtype": ""}
    done = low.withColumn("_r", first_hit(rules, nothing))
    return done.select(*rows.columns, "_r.*", F.when(F.col("_r.class") == "unclassified", gap).alias("gap"))


def agent_of(trailer: Column) -> Column:
    """Key of the first agent pattern that a trailer matches, else NULL."""
    return first_pattern(trailer, AGENTS)


def bot_reason(login: Column, account_type: Column, own: tuple[str, ...] = ()) -> Column:
    """Why a login is a machine: the account type, else the first pattern (one's own come last), else NULL."""
    return F.when(account_type == "Bot", "account_type").otherwise(first_pattern(login, [(p, p) for p in [*BOTS, *own]]))
