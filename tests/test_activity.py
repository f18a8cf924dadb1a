"""Rollups on a small hand-made fixture, and invariants on the supplied tables."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import buckets, text
from tallyloom.operators import mining, missions, pages, quality, rollups, sessions, upsert
from tallyloom.plans import registry
from tallyloom.sources import framed
from tallyloom.sources.adapter import Activity
from tallyloom.streaming import arrivals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def activity(spark):
    return Activity(spark, SF)


def test_weeks_start_on_monday_and_labels_follow_thursday(spark):
    days = [dt.date(2019, 12, 30), dt.date(2020, 12, 28), dt.date(2015, 12, 28), dt.date(2021, 1, 4)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r.x for r in df.select(buckets.iso_label(F.col("d")).alias("x")).collect()] == ["2020-W01", "2020-W53", "2015-W53", "2021-W01"]
    assert quality.bucket_properties(df, "d").where("holds = 0").isEmpty() and quality.bucket_properties(df, "d").count() == 25


def test_percentiles_are_median_and_nearest_rank(spark):
    df = spark.createDataFrame([(24.0,), (96.0,)], "v double")
    assert df.agg(rollups.p50("v").alias("a"), rollups.p75("v").alias("b")).first() == (60.0, 96.0)


def test_ratios_are_null_without_a_denominator(spark):
    assert spark.range(1).select(buckets.ratio(F.lit(1), F.lit(0)).alias("x")).first().x is None


def test_invariants(activity):
    assert quality.bucket_mismatches(activity).first().mismatches == 0
    assert len({r.total for r in quality.conservation(activity).collect()}) == 1
    catalog = activity.spark.createDataFrame([("quality.defect_ratio",)], "metric_key string")
    assert quality.without_catalog(rollups.ratio_metrics(activity), catalog).count() == 7


def test_cycle_percentiles_agree_with_window_ranks(activity):
    by_rank = rollups.cycle_percentiles(activity).where("scope = 'org'").select("scope_key", "month_start", "p50", "p75")
    direct = rollups.scoped(rollups.merged_prs(activity)).where("scope = 'org' and cycle_time_hours is not null").groupBy("scope_key", F.col("merged_month_start").alias("month_start")).agg(rollups.r6(rollups.p50("cycle_time_hours")).alias("p50"), rollups.r6(rollups.p75("cycle_time_hours")).alias("p75"))
    assert quality.same(by_rank, direct)


def test_body_measure(spark):
    messages = ["subject", "subject\n\nbody line one\nbody two\n", "s\n\nCo-Authored-By: x <y>\n", "s\n\nSee: this \n  indented \r\n", None]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    got = df.select(text.has_body(F.col("m")).alias("h"), text.body_chars(F.col("m")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 21), (0, 0), (1, 10), (None, None)]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.normal_url(F.lit("HTTPS://Ex.Org:443?q=1#f")).alias("u"),
        text.section(F.lit("# A\nx\n## Goal\none\ntwo\n# B\nz"), "goal").alias("s"),
        text.blocks(F.lit("<!-- note a --> x <!-- note b -->"), "note").alias("b"),
        text.for_script(F.lit("</script><!--")).alias("j"),
    ).first()
    assert row.u == "https://ex.org/?q=1" and row.s == ["one", "two"] and row.b == ["a", "b"] and row.j == "<\\/script><\\!--"


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, x string, n int")
    new = spark.createDataFrame([(1, None, 7), (3, "c", 1)], "k int, x string, n int")
    assert sorted(map(tuple, upsert.preserving(old, new, ["k"]).collect())) == [(1, "a", 7), (2, "b", 6), (3, "c", 1)]
    assert sorted(r.k for r in upsert.if_absent(old, new, ["k"]).collect()) == [1, 2, 3]
    assert dict(map(tuple, upsert.lowest(old, new, ["k"], "n").collect())) == {1: 5, 2: 6, 3: 1}
    assert dict(map(tuple, upsert.accumulated(old, new, ["k"], "n").collect())) == {1: 12, 2: 6, 3: 1}
    both = old.unionByName(new)
    assert dict((r.k, r.n) for r in upsert.last_wins(both, ["k"], ["n"]).collect()) == {1: 7, 2: 6, 3: 1}


def test_incremental_equals_full(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    arrived = events.where("event_id % 5 = 0")
    first = arrivals.daily(events.where("event_id % 5 != 0"))
    assert quality.same(arrivals.recomputed(first, events, arrived), arrivals.daily(events))


def test_waves_break_cycles_at_the_weakest_edge(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "b", 0.5), ("b", "d", 1.0)], "src string, dst string, weight double")
    assert {r.node: r.wave for r in mining.waves(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2}


def test_cooccurrence_of_large_changes(spark):
    rows = [("big", i) for i in range(250)] + [("wide", i) for i in range(240, 400)] + [("c", 3), ("c", 7), ("c", 7), ("d", 245), ("d", 3), ("e", None), (None, 3), (None, 7), ("f", 999)]
    sets, together = {}, {}
    for c, i in rows:
        if i is not None:
            sets.setdefault(c, set()).add(i)
    for items in sets.values():
        for a in items:
            for b in items:
                if a < b:
                    together[a, b] = together.get((a, b), 0) + 1
    got = mining.cooccurrence(spark.createDataFrame(rows, "c string, i int"), "c", "i", 2).collect()
    assert {(r.a, r.b): r.together for r in got} == {p: n for p, n in together.items() if n >= 2}


def without_cycles(edges):
    """Edges (src, dst, weight) after every strongly connected component lost its weakest edge, again and again."""
    edges = set(edges)
    while True:
        reach = {}
        for src, dst, _ in edges:
            reach.setdefault(src, set()).add(dst)

        def from_(x):
            seen, waiting = set(), [x]
            while waiting:
                for y in reach.get(waiting.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        waiting.append(y)
            return seen

        ahead = {x: from_(x) for x in reach}
        parts = {frozenset(y for y in ahead[x] if x in ahead.get(y, ())) for x in ahead if x in ahead[x]}
        if not parts:
            return edges
        for part in parts:
            inside = [e for e in edges if e[0] in part and e[1] in part]
            edges.discard(min(inside, key=lambda e: (e[2] is not None, e[2] or 0, e[0], e[1])))


def waves_brute(nodes, edges):
    best = {}
    for src, dst, w in edges:
        if src != dst and ((src, dst) not in best or (w is not None, w or 0) < (best[src, dst] is not None, best[src, dst] or 0)):
            best[src, dst] = w
    nodes, edges, out, wave = set(nodes), without_cycles((s, d, w) for (s, d), w in best.items()), {}, 0
    while nodes:
        free = nodes - {e[1] for e in edges}
        out |= dict.fromkeys(free, wave)
        wave += 1
        nodes -= free
        edges = {e for e in edges if e[0] not in free}
    return out


def test_waves_of_odd_graphs(spark):
    # three cycles of three, the first before the second, a pair and a loop
    edges = [(i, i // 3 * 3 + (i + 1) % 3, None if i == 4 else i / 2) for i in range(9)] + [(2, 3, 9.0), (9, 10, 1.0), (7, 7, 0.0)]
    nodes = [*range(11), None]
    got = mining.waves(spark.createDataFrame([(x,) for x in nodes], "node int"), spark.createDataFrame(edges, "src int, dst int, weight double"))
    assert {r.node: r.wave for r in got.collect()} == waves_brute(nodes, edges)
    assert mining.waves(spark.createDataFrame([], "node int"), spark.createDataFrame([], "src int, dst int, weight double")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_waves_of_random_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice([None, 1.0, 2.0, float(rng.randrange(9))])) for _ in range((16, 26)[seed])]
    got = mining.waves(spark.createDataFrame([(x,) for x in range(n)], "node int"), spark.createDataFrame(edges, "src int, dst int, weight double"))
    assert {r.node: r.wave for r in got.collect()} == waves_brute(range(n), edges)


def test_a_thousand_cycles_are_broken_in_a_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(mining, "cut", lambda df: rounds.append(1) or df.checkpoint())
    edges = spark.range(3000).select(F.col("id").alias("src"), F.expr("id div 3 * 3 + (id + 1) % 3").alias("dst"), F.expr("double(id % 3)").alias("weight"))
    got = mining.waves(spark.range(3000).toDF("node"), edges).groupBy(F.expr("node % 3").alias("k"), "wave").count().collect()
    assert {(r.k, r.wave): r["count"] for r in got} == {(1, 0): 1000, (2, 1): 1000, (0, 2): 1000}
    assert len(rounds) < 40


def test_waves_cover_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    orders = [(r[0], float(r[1])) for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").collect()]
    keys = {k for k, _ in orders}
    wanted = waves_brute(keys, {(k // 3, k, w) for k, w in orders if k > 1 and k // 3 in keys})
    assert {r.node: r.wave for r in registry.queries()["q42_topological_waves"](spark, sf_dir).collect()} == wanted


PAGE = '<html lang="en"><head><title>T</title><link rel="canonical" href="/a"><meta name="description" content="d"><meta property="og:title" content="t"><meta property="og:description" content="d"><script type="application/ld+json">{}</script></head><body><h1>x</h1><a href="/b">b</a></body></html>'


def test_page_findings(spark):
    rows = [(1, "https://ex.org/a", PAGE), (2, "http://ex.org/b", "<html><body><h1>1</h1><h1>2</h1><img src=x></body>"), (3, "https://ex.org/c", None), (4, "https://ex.org/d", PAGE.replace("{}", "{").replace('href="/a"', 'href="https://ex.org/z"'))]
    found = pages.findings(spark.createDataFrame(rows, "page_id long, url string, html string"))
    codes = {}
    for r in found.collect():
        codes.setdefault(r.page_id, set()).add(r.code)
    assert codes[1] == {"canonical-relative"}
    assert {"not-https", "canonical-missing", "title-missing", "description-missing", "h1-count", "html-lang-missing", "open-graph-incomplete", "jsonld-static-missing", "image-alt-missing"} == codes[2]
    assert {"canonical-not-self", "jsonld-invalid"} == codes[4]
    assert spark.range(1).select(pages.robots_blocks_all(F.lit("User-agent: *\nDisallow: /\n")).alias("x")).first().x


def test_sessions(spark):
    lines = ['data: {"timestamp": "t", "message": {"type": "tool", "tool": "Bash", "text": "x", "is_error": true}}', "data: [DONE]", "noise", "data: {bad"]
    df = spark.createDataFrame([(1, v) for v in lines], "session int, value string")
    assert sorted(r.is_bad for r in sessions.events_of(df).collect()) == [False, True]
    a = spark.createDataFrame([("SV",), ("SV",), ("UB",)], "code string")
    b = spark.createDataFrame([("SV",), ("CF",)], "code string")
    assert {r.code: r.trend for r in sessions.trend(a, b).collect()} == {"SV": "worsening", "UB": "worsening", "CF": "improving"}


HEAD = '<meta name="description" content="d"><meta property="og:title" content="t"><meta property="og:description" content="d"><script type="application/ld+json">{}</script>'
#: Per page: its URL, what stands in its head and body besides, and the codes that follow.
AUDITED = [
    ("https://a.org/1", '<link rel="nofollow canonical" href="https://a.org/1">', "<h1>x</h1>", set()),
    ("https://a.org/2", '<link rel="canonical" href="/2">', "<h1>x</h1>", {"canonical-relative"}),
    ("https://a.org/3", '<link rel="canonical" href="https://a.org/1">', "<h1>x</h1>", {"canonical-not-self"}),
    ("https://a.org/4", '<link rel="canonical" href="https://a.org/4"><link rel="canonical" href="https://a.org/4">', "<h1>x</h1>", {"canonical-multiple"}),
    ("https://a.org/5", '<link rel="canonical" href="https://a.org/5"><meta name="robots" content="NoIndex">', "<h1>x</h1>", {"noindex"}),
    ("https://a.org/6", '<link rel="canonical" href="https://a.org/6"><link rel="alternate" hreflang="de" href="http://a.org/6"><link rel="alternate" hreflang="DE" href="https://a.org/de/6">', "<h1>x</h1>", {"hreflang-duplicate", "hreflang-not-https", "hreflang-no-self"}),
    ("https://a.org/7", '<link rel="canonical" href="https://a.org/7"><link rel="alternate" hreflang="en" href="https://A.org:443/7#x">', "<h1>x</h1>", set()),
    ("https://a.org/8", '<link rel="canonical" href="https://a.org/8"><meta property="og:url" content="https://a.org/9"><script type="application/ld+json">{broken</script>', "<h1>x</h1>", {"og-url-conflict", "jsonld-invalid"}),
    ("http://a.org/9", "", '<h1>x</h1><h1>y</h1><img src="z"><img src="w" alt="">', {"not-https", "canonical-missing", "h1-count", "image-alt-missing"}),
]


def test_every_page_code(spark):
    rows = [(i, url, f'<html lang="en"><head><title>t</title>{HEAD}{head}</head><body>{body}</body></html>') for i, (url, head, body, _) in enumerate(AUDITED)]
    rows.append((99, "https://a.org/99", ""))
    got = {i: set() for i, *_ in rows}
    for r in pages.findings(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].add(r.code)
    assert [got[i] for i in range(len(AUDITED))] == [codes for *_, codes in AUDITED]
    assert got[99] == {"canonical-missing", "title-missing", "description-missing", "h1-count", "html-lang-missing", "open-graph-incomplete", "jsonld-static-missing"}


def test_crawl_visits_each_page_once(spark):
    links = {"a": ["b", "c"], "b": ["a", "d"], "c": ["d", "gone"], "d": ["a"], "e": ["a"], "f": []}
    rows = [(i, f"https://x.org/{k}", "".join(f'<a href="/{v}">l</a>' for v in out) + '<a href="https://y.org/a">away</a>') for i, (k, out) in enumerate(links.items())] + [(9, None, "<a href=x>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rounds, last, n = {"a": 0}, ["a"], 0
    while last:
        n += 1
        last = sorted({v for k in last for v in links[k] if v in links} - set(rounds))
        rounds |= dict.fromkeys(last, n)
    assert {r.url[-1]: r.round for r in pages.crawled(df).collect()} == rounds
    assert {r.url[-1]: r.round for r in pages.crawled(df, spark.createDataFrame([("https://x.org/e",), ("https://x.org/none",)], "url string")).collect()} == {"e": 0, "a": 1, "b": 2, "c": 2, "d": 3}


@pytest.mark.parametrize("factor", [1, 2, 3, 50])
def test_a_bounded_crawl_keeps_to_its_budget(spark, factor):
    rng = random.Random(7)
    pages_of = {f"https://{h}.org/{i}": sorted({f"https://{h}.org/{rng.randrange(30)}" for _ in range(4)}) for h in ("a", "b", "c") for i in range(20)}
    rows = [(i, url, "".join(f'<a href="{v}">l</a>' for v in links) + '<a href="https://z.org/1">away</a>') for i, (url, links) in enumerate(pages_of.items())]
    roots = ["https://a.org/1", "https://a.org/2", "https://b.org/0", "https://c.org/25"]
    got = pages.crawled_within(spark.createDataFrame(rows, "page_id long, url string, html string"), factor, spark.createDataFrame([(x,) for x in roots], "url string"))
    state, last, n = {x: (0, "queued") for x in roots}, roots, 0
    budget = {"a": 2 * factor, "b": factor, "c": factor}
    while last:
        n += 1
        met = sorted({v for u in last for v in pages_of.get(u, ())} - set(state), key=lambda u: (hashlib.md5(u.encode()).hexdigest()[:2], u))
        last = []
        for u in met:
            queued = sum(1 for x, (_, s) in state.items() if s == "queued" and x[8] == u[8]) < budget[u[8]]
            state[u] = (n, "queued" if queued else "deferred")
            last += [u] * queued
    assert {r.url: (r.round, r.state) for r in got.collect()} == state


def test_elements_nested_and_unclosed(spark):
    html = '<title>a<b>b</b></title><h1>one <h1>two</h1> tail</h1></h1><script>var x;</script><script type="Application/LD+JSON"> {} </script><img alt><img SRC=x><a>no</a><a href="">e</a><a href="/p">p</a><a href="http://[x">q</a><title>c</title><h1>open'
    df = spark.createDataFrame([(1, "https://x.org/d/", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.parsed(df).collect()}
    assert (got[1].title, got[1].h1, got[1].jsonld) == ("abc", ["one two tail", "two", "open"], ["{}"])
    assert [tuple(i) for i in got[1].images] == [("", True), ("x", False)] and got[1].anchors == ["https://x.org/p", "http://[x"]
    assert got[2].title == "" and got[3].h1 == [] and got[3].lang == ""


def test_exact_ranks_of_ties_and_wide_values(spark):
    rows = [(g, float(v)) for g, values in {"one": [7], "ties": [3] * 9 + [4], "wide": range(0, 4000, 3), "near": [5 + i / 1e4 for i in range(501)]}.items() for v in values]
    df = spark.createDataFrame([*rows, ("none", None)], "g string, v double")
    got = {r.g: (r.n, r.med, r.third) for r in rollups.at_ranks(df, ["g"], "v", rollups.QUARTILES).withColumn("med", rollups.median()).collect()}
    wanted = {}
    for g in {g for g, _ in rows}:
        x = sorted(v for k, v in rows if k == g)
        n = len(x)
        wanted[g] = (n, (x[(n + 1) // 2 - 1] + x[(n + 2) // 2 - 1]) / 2, x[max(1, (75 * n + 99) // 100) - 1])
    assert got == wanted


def test_refusals(spark):
    listed = spark.createDataFrame([("r", False, False, False, "main"), ("s", True, False, False, "main")], "full_name string, is_archived boolean, is_fork boolean, is_empty boolean, default_branch string")
    assert framed.targets(listed).count() == 1
    with pytest.raises(ValueError):
        framed.targets(listed, 2)
    with pytest.raises(ValueError):
        framed.targets(listed.limit(0))
    with pytest.raises(Exception, match="no bound"):
        spark.range(1).select(buckets.window_start(F.lit(None).cast("date"), 3)).collect()


def test_missions_of_odd_lines(spark):
    lines = [("s", 1, 'Write file_path: "app/x.py", "y"'), ("s", 2, None), ("s", 3, ""), ("t", 1, "Bash command: claude -p go"), ("t", 2, "Error: a TIMEOUT"), ("t", 2, "error: permission denied")]
    df = spark.createDataFrame([(s, dt.datetime(2020, 1, 1, 0, 0, i), i, m) for s, i, m in lines], "session string, at timestamp_ntz, seq int, message string")
    signal = missions.signals(df)
    got = {(r.session, r.code, r.rule) for r in missions.incidents(signal).collect()}
    assert got == {("t", "SF", "no-recovery"), ("t", "SG", "missing-capability")}
    kept = {r.session: r for r in missions.compliance(signal, spark.createDataFrame([], "session string, task string, has_report boolean")).collect()}
    assert not kept["s"].r3_no_code and kept["t"].r3_no_code and kept["s"].r_pr and not kept["s"].r7_report
    assert {r.session: r.missed for r in missions.missed(signal).collect()} == {"s": None, "t": "push-and-verify"}


def test_written_buckets_replace_only_their_own(spark, tmp_path):
    schema = "k int, day string"
    path = str(tmp_path / "buckets")
    upsert.write_buckets(spark.createDataFrame([(1, "a"), (2, "b")], schema), path, ["day"])
    upsert.write_buckets(spark.createDataFrame([(3, "b")], schema), path, ["day"])
    assert sorted((r.k, r.day) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]
