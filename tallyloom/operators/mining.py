"""History mining: hotspots, temporal coupling, dependency waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import shared_dir, stored

#: Changes of up to so many items are paired in a row; larger ones in chunks of about so many.
CHUNK = 100


def cooccurrence(changes: DataFrame, change: str, item: str, least: int = 2) -> DataFrame:
    """Pairs of items changed together at least `least` times, whatever the size of the changes.

    Items of fewer changes than that can be in no result and go first. A change of up to ``CHUNK`` items is one
    row; the items of a larger one are dealt into chunks, and a cell holds one chunk or two, so no row grows with the largest change.
    A change or item that is null counts as one like any other, but a null item pairs with nothing.
    """
    every = changes.select(F.col(change).alias("change"), F.col(item).alias("item")).where("item is not null").distinct()
    every = stored(every, "changed-items")
    often = every.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item")
    kept = every.join(often, "item", "left_semi")
    wide = kept.groupBy("change").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(F.col("change").alias("wide"), F.ceil(F.col("n") / CHUNK).cast("int").alias("m"))
    wide = stored(wide, "wide-changes")
    if wide.isEmpty():
        small, large = kept, None
    else:
        small = kept.join(wide, F.col("change").eqNullSafe(F.col("wide")), "left_anti")
        large = kept.join(wide, F.col("change").eqNullSafe(F.col("wide")))
    rows = small.groupBy("change").agg(F.sort_array(F.collect_list("item")).alias("xs"))
    pairs = rows.select("xs", F.posexplode("xs").alias("i", "a")).select("a", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("b"))
    if large is not None:
        pairs = pairs.unionByName(chunked_pairs(large))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)


def chunked_pairs(sized: DataFrame) -> DataFrame:
    """(a, b), a < b, of the items of changes (change, item, m) that are dealt into m chunks."""
    mine = sized.withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    x, y = F.least("chunk", "other"), F.greatest("chunk", "other")
    of = lambda which: F.collect_list(F.when(F.col("chunk") == which, F.col("item")))
    cells = mine.groupBy("change", x.alias("x"), y.alias("y")).agg(of(x).alias("xs"), of(y).alias("ys"))
    first = cells.select("xs", "ys", (F.col("x") == F.col("y")).alias("one"), F.posexplode("xs").alias("i", "a"))
    rest = F.when(F.col("one"), F.slice("xs", F.col("i") + 2, F.size("xs"))).otherwise(F.col("ys"))
    pairs = first.select("a", F.explode(rest).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def hotspots(changes: DataFrame, item: str, size: str, author: str) -> DataFrame:
    """Items by churn times size, worst first."""
    per = changes.groupBy(item).agg(F.count("*").alias("churn"), F.countDistinct(author).alias("authors"), F.max(size).alias("size"))
    return per.withColumn("score", F.round(F.col("churn") * F.col("size").cast("double"), 6))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut; one call is one job over all that is left."""
    return df.checkpoint()


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) without those that lead from a node that nothing leads to, or to one that leads nowhere, until none is left out."""
    n = edges.count()
    while n:
        from_, to = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = cut(edges.join(from_, "dst", "left_semi").join(to, "src", "left_semi").select("src", "dst", "weight"))
        if (left := edges.count()) == n:
            break
        n = left
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of strongly connected components, of at least one for each part of the graph that holds a cycle.

    Colours go forward first: a node's is the greatest node that reaches it. Backward from each node of its own
    colour, within the colour, its component is met. All colours spread in the same rounds.
    """
    colours = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("root", F.col("node")))
    while True:
        told = edges.join(colours.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("root").alias("told"))
        spread = cut(colours.join(told, "node", "left").select("node", F.greatest("root", "told").alias("root"), F.coalesce(F.col("told") > F.col("root"), F.lit(False)).alias("moved")))
        colours = spread.select("node", "root")
        if spread.where("moved").isEmpty():
            break
    of = lambda end: colours.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    inner = cut(edges.join(of("src"), "src").join(of("dst"), "dst").where("src_root = dst_root").select("src", "dst", F.col("src_root").alias("root")))
    found = last = cut(colours.where("node = root"))
    while not last.isEmpty():
        back = inner.join(last.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "root").distinct()
        last = cut(back.join(found.select("node"), "node", "left_anti"))
        found = cut(found.unionByName(last))
    return found


def cycle_breakers(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): the edges to drop so that no cycle is left.

    Every strongly connected component loses its weakest edge (smallest weight, then src, dst; a null weight is the
    smallest); what is left of it is treated likewise. Components of a round are found and cut together, so
    the number of rounds follows from the deepest one, not from their number.
    """
    dropped, open_ = edges.limit(0).select("src", "dst", "weight"), trimmed(edges)
    while not open_.isEmpty():
        parts = components(open_)
        of = lambda end: parts.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))  # noqa: B023, E731
        inside = open_.join(of("src"), "src").join(of("dst"), "dst").where("src_root = dst_root")
        order = F.struct(F.col("weight").isNotNull().alias("known"), "weight", "src", "dst")
        weakest = cut(inside.groupBy("src_root").agg(F.min(order).alias("e")).select("e.src", "e.dst", "e.weight"))
        dropped = cut(dropped.unionByName(weakest))
        open_ = trimmed(open_.join(weakest.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight"))
    return dropped


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, wave): wave 0 has no open dependency; edges (src, dst, weight) say dst waits for src.

    Where only cycles and what waits for them are left, the edges that break all cycles (``cycle_breakers``) are dropped and the
    waves start anew without them; a graph without cycles never pays for the search. Of several edges between two nodes the weakest counts. Rounds go on until every node has its wave. A null
    node waits for nothing; an edge with a null end is none. State stays in DataFrames; every round cuts its lineage by checkpoint.
    """
    shared_dir(nodes.sparkSession)  # where checkpoints go
    single = F.min(F.struct(F.col("weight").isNotNull().alias("known"), "weight"))["weight"].alias("weight")
    every, kept = cut(nodes.select("node").distinct()), cut(edges.where("src != dst").groupBy("src", "dst").agg(single))
    open_nodes, open_edges = every, kept
    done, wave = open_nodes.limit(0).select("node", F.lit(0).alias("wave")), 0
    while not open_nodes.isEmpty():
        free = cut(open_nodes.join(open_edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            kept = cut(kept.join(cycle_breakers(open_edges).select("src", "dst"), ["src", "dst"], "left_anti"))
            open_nodes, open_edges, done, wave = every, kept, done.limit(0), 0
            continue
        done = done.unionByName(free.select("node", F.lit(wave).alias("wave")))
        wave += 1
        if wave % 32 == 0:  # the plan stays short
            done = cut(done)
        closed = free.select(F.col("node").alias("_node"))
        open_nodes = cut(open_nodes.join(closed, F.col("node").eqNullSafe(F.col("_node")), "left_anti"))
        open_edges = cut(open_edges.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
    return done.select("node", F.col("wave").cast("int").alias("wave"))
