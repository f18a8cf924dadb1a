"""Searches for many strings and many globs against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import globs, search
from tallyloom.functions.rules import glob_regex
from tallyloom.operators import quality, runbook
from tallyloom.sources import framed


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_needles_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(search, "PART_BYTES", size)
    rng = random.Random(size)
    word = lambda n: "".join(rng.choice("abAB#é") for _ in range(n))
    needles = [word(rng.randint(1, 5)) for _ in range(40)] + ["", None, "a", "A", "Éa"]
    texts = [(i, word(rng.randint(0, 60)), 1) for i in range(80)] + [(90, None, 2), (91, "", 3), (92, "xyz", 4), (1, "ab", 1), (1, "ab", 1)]
    df = spark.createDataFrame(texts, "id int, text string, found2 int").repartition(3)
    got = sorted((r.id, r.found) for r in search.contained(df, spark.createDataFrame([(x,) for x in needles], "needle string")).collect())
    lowered = {x.lower() for x in needles if x}
    assert got == sorted((i, x) for i, t, _ in texts if t for x in lowered if x in t.lower())
    assert search.contained(df, spark.createDataFrame([], "needle string")).count() == 0


def test_collisions_are_told_apart(spark):
    texts = spark.createDataFrame([(1, "by JDoe and eve"), (2, "m@x.org"), (3, "ok")], "id int, text string")
    needles = spark.createDataFrame([("jdoe",), ("Eve",), ("zed",)], "needle string")
    allowed = spark.createDataFrame([("acme/jdoe-website",), ("acme/zed",)], "name string")
    got = {(r.id, r.found): r.collision for r in quality.disclosed(texts, needles, allowed).collect()}
    assert got == {(1, "jdoe"): True, (1, "eve"): False, (2, "email-shaped"): False}


@pytest.mark.parametrize("segments", [False, True])
def test_globs_against_their_regular_expressions(segments):
    rng = random.Random(segments)
    parts = ["a", "b", "ab", "*", "?", "/", "/", "**", "**/", ".", "x.y", "[", "(", "+"]
    patterns = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(400)})
    trie = globs.GlobTrie([(g, i) for i, g in enumerate(patterns)], segments)
    rules = [re.compile(glob_regex(g, segments).replace("$", r"\Z")) for g in patterns]
    for _ in range(1500):
        text = "".join(rng.choice(["a", "b", "ab", "/", "/", ".", "x.y", "[", "+"]) for _ in range(rng.randint(0, 7)))
        assert sorted(trie.lines(text)) == [i for i, r in enumerate(rules) if r.match(text)], text
    assert trie.lines(None) == []


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_many_patterns_last_line_wins(spark, monkeypatch, size):
    monkeypatch.setattr(globs, "PART_BYTES", size)
    monkeypatch.setattr(globs, "REMEMBERED", 50)
    patterns = [(i, f"src/m{i % 40}/**" if i % 3 else f"**/f{i % 25}.p?") for i in range(120)] + [(500, None), (None, "*")]
    paths = [(i, f"src/m{i % 50}/d/f{i % 30}.py", "x") for i in range(200)] + [(900, None, "x"), (901, "", "x")]
    df = spark.createDataFrame(paths, "id int, path string, glob string").repartition(2)
    wanted = {i: [n for n, g in patterns if g and n is not None and p is not None and re.match(glob_regex(g, True), p)] for i, p, _ in paths}
    rules = spark.createDataFrame(patterns, "line long, glob string")
    got = {}
    for r in globs.matched(df, rules, "path", segments=True).collect():
        got.setdefault(r.id, []).append(r.line)
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in wanted.items() if x}
    last = {r.id: r.line for r in globs.matched(df, rules, "path", segments=True, last=True).collect()}
    assert last == {i: max(x) for i, x in wanted.items() if x}
    assert globs.matched(df, rules.where("false"), "path").count() == 0


@pytest.mark.parametrize("segments, shapes, crowd", [(False, 64, 64), (True, 64, 64), (True, 3, 64), (True, 64, 2), (False, 64, 2)])
def test_globs_by_keys_against_their_regular_expressions(spark, monkeypatch, segments, shapes, crowd):
    monkeypatch.setattr(globs, "FEW_BYTES", 0)
    monkeypatch.setattr(globs, "SHAPES", shapes)
    monkeypatch.setattr(globs, "CROWD", crowd)
    monkeypatch.setattr(globs, "LETTERS", 3)
    rng = random.Random(shapes + crowd)
    parts = ["a", "b", "ab", "*", "?", "/", "/", "**", "**/", ".", "x.y", "[", "(", "+", "\\", "é", "\n", "$", "😀", "aabab"]
    patterns = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(500)})
    rules = [re.compile("(?s)" + glob_regex(g, segments)[:-1] + r"\Z") for g in patterns]
    said = ["a", "b", "ab", "/", "/", ".", "x.y", "[", "+", "\\", "é", "\n", "$", "😀", "aabab"]
    texts = ["", "\n", "a/", "/a", "//", None] + ["".join(rng.choice(said) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts += [re.sub(r"[*?]", lambda m: rng.choice(["a", "b", "é"]), g) for g in patterns]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "", "x")], "id int, path string, glob string").repartition(3)
    lines = spark.createDataFrame([(i, g) for i, g in enumerate(patterns)] + [(1000, "a/b"), (1001, "a/b"), (1001, "a/b"), (1002, None)], "line long, glob string")
    got = sorted((r.id, r.line) for r in globs.matched(df, lines, "path", segments=segments).collect())
    wanted = [(i, n) for i, t in enumerate(texts) for n, r in enumerate(rules) if t is not None and r.match(t)] + [(i, n) for i, t in enumerate(texts) if t == "a/b" for n in (1000, 1001)]
    assert got == sorted(wanted + [(0, n) for i, n in wanted if i == 0])
    last = {r.id: r.line for r in globs.matched(df, lines, "path", segments=segments, last=True).collect()}
    assert last == {i: max(n for k, n in wanted if k == i) for i, _ in wanted}


def test_many_globs_with_letters_need_no_trie(spark, monkeypatch):
    """Every trie is one more pass over the texts, and grows with the patterns; 15,000 globs and 150,000 paths took 18 s of tasks."""
    monkeypatch.setattr(globs, "GlobTrie", None)
    kinds = ["**/c{}/*.py", "f/c{}/**", "*/c{}/?*.md", "*/c{}?/*.txt"]
    patterns = spark.createDataFrame([(k, kinds[k % 4].format(k)) for k in range(3000)], "line long, glob string")
    paths = [f"{s}/c{k}/{k}{ext}" for k in range(0, 3000, 7) for s in "fo" for ext in (".py", ".md", ".txt")]
    got = {(r.path, r.line) for r in globs.matched(spark.createDataFrame([(p,) for p in paths], "path string"), patterns, "path", segments=True).collect()}
    rules = {k: re.compile(glob_regex(kinds[k % 4].format(k), True)) for k in range(3000)}
    assert got == {(p, k) for p in paths for k in {int(p.split("/")[1][1:]), int(p.split("/")[1][1:]) // 10} if rules[k].match(p)}


def test_more_override_globs_than_a_plan_could_hold(spark):
    lines = [(i + 1, f"email\tu{i}*@x.org\tp{i}") for i in range(3000)] + [(4000, "email\tU7@x.org\tseven"), (4001, "email\tu1?@x.org\tteen"), (4002, "bot\tp1\t")]
    emails = spark.createDataFrame([(f"u{i}@x.org", None if i % 2 else f"l{i}") for i in range(40)] + [("z@x.org", None), ("y@x.org", "y")], "email string, login string")
    got = {r.email: (r.login, r.source) for r in runbook.resolved_identities(emails, framed.overrides(spark.createDataFrame(lines, "line long, value string"))).collect()}
    assert got["u7@x.org"] == ("seven", "manual") and got["u12@x.org"] == ("teen", "manual") and got["u30@x.org"] == ("p30", "manual")
    assert got["z@x.org"] == (None, None) and got["y@x.org"] == ("y", "api") and len(got) == 42


def test_lines_and_files_of_a_folder(spark, tmp_path):
    for name, text in {"a/o.tsv": "# c\n\nbot\tx\t\noops\ty\r\n", "b/o.tsv": "email\tk\tv", "b/empty.tsv": "", "vendor/lib/o.txt": "x", "src/vendor.py": "abc"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    lines = framed.numbered_lines(spark, str(tmp_path), "*.tsv")
    assert sorted((r.file.split("/")[-2], r.line, r.value) for r in lines.collect()) == [("a", 1, "# c"), ("a", 2, ""), ("a", 3, "bot\tx\t"), ("a", 4, "oops\ty"), ("b", 1, "email\tk\tv")]
    rules = {(r.file.split("/")[-2], r.line): r.error for r in framed.overrides(lines, "file").collect()}
    assert rules == {("a", 3): None, ("a", 4): "unknown directive", ("b", 1): None}
    found = framed.tracked_files(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 2)[1], r.bytes) for r in found.collect()) == [("a", 20), ("b", 9), ("src", 3)]
    assert framed.tracked_files(spark, str(tmp_path), ("none",)).count() == 4
