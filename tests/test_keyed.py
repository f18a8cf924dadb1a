"""Streams with keyed state, maintained rollups, bucketed upserts and dry runs: equal to batch results after late data, replay and restart."""

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import upsert
from tallyloom.operators.quality import same
from tallyloom.session import ship
from tallyloom.streaming import arrivals, keyed

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def store(spark):
    ship(spark)
    for k, v in keyed.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in keyed.STORE:
        spark.conf.unset(k)


def arriving(events, folder, slots, seed):
    """Files of events in an arbitrary order of arrival."""
    names = list(range(slots))
    random.Random(seed).shuffle(names)
    for i, k in enumerate(names):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(slots)) == k).coalesce(1).write.parquet(f"{folder}/{i}")


def firsts(spark, source, work, schema, files=1, state=keyed.first_occurrences):
    told = lambda s: state(s, ["user_id", "event_type"], "ts")
    arrivals.drain(spark, source, schema, keyed.lowest_sink(f"{work}/told"), f"{work}/cursor", files=files, through=told, mode="update")
    return keyed.lowest_of(spark.read.parquet(f"{work}/told"), ["user_id", "event_type"], "ts")


@pytest.mark.parametrize("state", [keyed.first_occurrences, keyed.touched_lowest])
def test_first_occurrences_follow_any_order_and_restart(spark, store, tmp_path, state):
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id < 6").unionByName(spark.read.parquet(f"{SF}/events.parquet").where("user_id = 7").withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    batch = lambda df: df.where("ts is not null").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    arriving(events.where("event_id % 3 > 0"), source, 2, 1)
    assert same(firsts(spark, source, work, events.schema, state=state), batch(events.where("event_id % 3 > 0")))
    before = spark.read.parquet(f"{work}/told").count()
    arriving(events.where("event_id % 3 = 0"), f"{source}/late", 1, 2)  # a restart finds its state; late, earlier events lower it
    assert same(firsts(spark, source, work, events.schema, state=state), batch(events))
    assert spark.read.parquet(f"{work}/told").count() > before


def test_maintained_counts_equal_a_full_computation(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source, table = str(tmp_path / "in"), keyed.MaintainedDaily(str(tmp_path / "out"))
    arriving(events.where("event_id % 4 > 0"), source, 2, 3)
    arrivals.drain(spark, source, events.schema, table.sink, str(tmp_path / "cursor"), files=1)
    assert same(table.read(spark).select(*arrivals.daily(events).columns), arrivals.daily(events.where("event_id % 4 > 0")))
    late = events.where("event_id % 4 = 0 and dayofmonth(ts) = 9")
    untouched = {f: os.path.getmtime(f) for f in glob.glob(f"{table.path}/daily/bucket=*/*.parquet") if "-09/" not in f}
    table.sink(late.unionByName(late.limit(3)), 7)
    table.sink(late, 7)  # the same batch again
    now = {f: os.path.getmtime(f) for f in glob.glob(f"{table.path}/daily/bucket=*/*.parquet") if "-09/" not in f}
    assert now == untouched and len(now) > 5
    assert same(table.read(spark).select(*arrivals.daily(events).columns), arrivals.daily(events.where("event_id % 4 > 0").unionByName(late)))


def test_a_dry_run_tells_what_would_change(spark):
    schema = "day string, kind string, n int, v double"
    old = spark.createDataFrame([("a", "x", 1, 1.0), ("b", None, 2, None), ("c", "x", 3, 0.5), ("d", "x", None, None)], schema)
    new = spark.createDataFrame([("a", "x", 1, 1.0), ("b", None, 2, 7.0), ("e", "x", 4, None), ("d", "x", None, None)], schema)
    got = {(r.day, r.kind): (r.change, r.old and r.old.n, r.new and r.new.v) for r in upsert.changes(old, new, ["day", "kind"]).collect()}
    assert got == {("b", None): ("changed", 2, 7.0), ("c", "x"): ("gone", 3, None), ("e", "x"): ("added", None, None)}
    assert upsert.changes(old, old, ["day", "kind"]).isEmpty()


def test_loads_rewrite_only_their_buckets(spark, tmp_path):
    table = upsert.KeyedTable(str(tmp_path / "t"), ("k",), ("at", "v"), buckets=16)
    rng, state = random.Random(4), {}
    assert table.load(spark.createDataFrame([], "k int, at int, v string")) == 0
    for load, keys in enumerate((300, 3, 1, 40)):
        rows = [(rng.randrange(400) if load != 2 else None, rng.randrange(9), f"{load}-{i}") for i in range(keys)]
        rows += rows[:2]
        before = set(glob.glob(f"{table.path}/rows/bucket=*/*.parquet"))
        batch = spark.createDataFrame(rows, "k int, at int, v string")
        written = table.load(batch)
        after = set(glob.glob(f"{table.path}/rows/bucket=*/*.parquet"))
        assert len(after - before) == written <= min(16, len(rows)) and len(after) <= 16
        for k, at, v in rows:
            state[k] = max(state.get(k, (-1, "")), (at, v))
        assert table.load(batch) == written  # again
        assert {r.k: (r.at, r.v) for r in table.read(spark).collect()} == state
        assert table.read(spark).count() == len(state)
    assert not glob.glob(f"{table.path}/aside-*")
    shutil.rmtree(table.path)
