"""Ranges of a commit history: what a branch reaches and a cursor does not.

Histories are long and mostly straight. Commits that have one parent, which has no other child, are links of
a chain; pointer doubling gives each its chain and its place in it, in as many rounds as the longest
chain's length has digits in base two. Reachability then goes from chain to chain in rounds, for all ranges at
once; their number follows from merges and branchings, not from the length of the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import shared_dir


def chains(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit, chain, place): the oldest commit of its chain, and how many links lie before it."""
    born = parents.groupBy("commit").agg(F.count("*").alias("n"), F.min("parent").alias("up"))
    only = parents.groupBy("parent").agg(F.count("*").alias("children")).where("children = 1").select(F.col("parent").alias("up"))
    links = born.where("n = 1").join(only, "up", "left_semi").select("commit", "up")
    ahead = commits.join(links, "commit", "left").select("commit", F.coalesce("up", "commit").alias("chain"), F.col("up").isNotNull().cast("long").alias("place")).checkpoint()
    while True:
        jump = ahead.select(F.col("commit").alias("chain"), F.col("chain").alias("further"), F.col("place").alias("more"))
        after = ahead.join(jump, "chain").select("commit", F.col("further").alias("chain"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")).checkpoint()
        ahead = after.drop("moved")
        if after.where("moved").isEmpty():
            return ahead


def reached(starts: DataFrame, placed: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chain, upto): per start (keys, commit) the chains it reaches and up to which place."""
    begun = starts.join(placed, "commit").groupBy(*keys, "chain").agg(F.max("place").alias("upto"))
    older = parents.join(placed.where("commit = chain").select("commit"), "commit", "left_semi").select(F.col("commit").alias("from"), F.col("parent").alias("commit"))
    ways = older.join(placed, "commit").select("from", "chain", F.col("place").alias("upto")).checkpoint()
    found = last = begun.checkpoint()
    while not last.isEmpty():
        told = ways.join(last.select(*keys, F.col("chain").alias("from")).distinct(), "from").groupBy(*keys, "chain").agg(F.max("upto").alias("upto"))
        both = found.withColumn("old", F.col("upto")).unionByName(told.withColumn("old", F.lit(None).cast("long")))
        merged = both.groupBy(*keys, "chain").agg(F.max("upto").alias("upto"), F.max("old").alias("old")).checkpoint()
        last = merged.where("old is null").select(*keys, "chain", "upto")  # a chain left by its oldest commit was left before
        found = merged.select(*keys, "chain", "upto")
    return found


def commits_in_range(commits: DataFrame, parents: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, commit) of each range (range_id, cursor, branch): reachable from branch, itself included, and not from cursor.

    commits (commit), parents (commit, parent): a merge has several rows, a first commit none. A null cursor, or one that
    the history does not hold, excludes nothing, so everything is read again; an unknown branch has no commit. Edges to or
    from unknown commits (a shallow clone's) and repeated ones count as none or one. The graph must have no cycle.
    """
    shared_dir(commits.sparkSession)  # where checkpoints go
    known = commits.select("commit").where("commit is not null").distinct().checkpoint()
    edges = parents.select("commit", "parent").where("commit != parent").distinct().join(known, "commit", "left_semi").join(known.select(F.col("commit").alias("parent")), "parent", "left_semi").select("commit", "parent").checkpoint()
    placed = chains(known, edges)
    ends = ranges.select("range_id", F.explode(F.array(F.struct(F.lit("branch").alias("side"), F.col("branch").alias("commit")), F.struct(F.lit("cursor").alias("side"), F.col("cursor").alias("commit")))).alias("e")).select("range_id", "e.side", "e.commit").where("commit is not null").distinct()
    found = reached(ends, placed, edges, ["range_id", "side"])
    per = found.groupBy("range_id", "chain").agg(F.max(F.when(F.col("side") == "branch", F.col("upto"))).alias("upto"), F.max(F.when(F.col("side") == "cursor", F.col("upto"))).alias("floor")).where("upto > coalesce(floor, -1)")
    return placed.join(per, "chain").where("place <= upto and place > coalesce(floor, -1)").select("range_id", "commit")
