"""Commit ranges and mergeable distinct counts against brute force."""

import datetime as dt
import random

import pytest

from tallyloom.operators import distincts, history


def ancestors(parents, start, known):
    seen, waiting = set(), [start] if start in known else []
    while waiting:
        x = waiting.pop()
        if x not in seen:
            seen.add(x)
            waiting.extend(p for p in parents.get(x, ()) if p in known)
    return seen


@pytest.mark.parametrize("seed,n,merges,forks", [(1, 60, 0.3, 0.3), (2, 250, 0.02, 0.02), (3, 40, 0.0, 0.0), (4, 50, 0.8, 0.6)])
def test_ranges_of_random_histories(spark, seed, n, merges, forks):
    rng = random.Random(seed)
    parents = {}
    for i in range(1, n):
        up = [i - 1 if rng.random() >= forks else rng.randrange(i)]
        if rng.random() < merges:
            up.append(rng.randrange(i))
        parents[i] = up if rng.random() > 0.02 else []
    name = {i: f"c{rng.randrange(10**6)}-{i}" for i in range(n)}
    ranges = [(r, rng.choice([None, name[rng.randrange(n)], name[rng.randrange(n)], "gone"]), name[rng.randrange(n)] if r else "gone") for r in range(25)] + [(30, name[n - 1], name[n - 1]), (31, None, None)]
    rows = [(name[c], name[p]) for c, up in parents.items() for p in up]
    known = set(name.values()) - {name[n // 2]} if seed == 1 else set(name.values())
    by_name = {name[c]: [name[p] for p in up] for c, up in parents.items()}
    got = history.commits_in_range(spark.createDataFrame([(c,) for c in known] * 2, "commit string"), spark.createDataFrame(rows + rows[:3], "commit string, parent string"), spark.createDataFrame(ranges, "range_id int, cursor string, branch string"))
    wanted = {(r, c) for r, cursor, branch in ranges for c in ancestors(by_name, branch, known) - ancestors(by_name, cursor, known)}
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_a_history_without_commits(spark):
    none = history.commits_in_range(spark.createDataFrame([], "commit string"), spark.createDataFrame([], "commit string, parent string"), spark.createDataFrame([(1, None, "a")], "range_id int, cursor string, branch string"))
    assert none.count() == 0


def test_bitmaps_merge_into_distinct_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(70)), rng.choice([None, rng.randrange(40), 40_000 + rng.randrange(50), -rng.randrange(30)])) for _ in range(900)]
    facts = spark.createDataFrame(rows, "s string, d date, who long")
    early, late = (distincts.day_sets(facts.where(c), ["s"], "d", "who") for c in ("d < '2024-02-10'", "d >= '2024-02-05'"))
    sets = distincts.added(distincts.added(early, late), late)
    for kind, first in (("week", lambda d: d - dt.timedelta(d.weekday())), ("month", lambda d: d.replace(day=1))):
        for scope in ([], ["s"]):
            people = {}
            for s, d, who in rows:
                if who is not None:
                    people.setdefault((*([s] if scope else []), first(d)), set()).add(who)
            got = distincts.counted(distincts.merged(sets, scope, kind), [*scope, "period_start"]).collect()
            assert {tuple(r)[:-1]: r.people for r in got} == {k: len(v) for k, v in people.items()}
