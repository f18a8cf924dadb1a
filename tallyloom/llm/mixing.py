"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a digest of their ids and laid end to end, repeated up
to ``epochs`` times, and cut into blocks of equally many tokens. Slots are laid over the unit
interval: slot i stands at the i-th van der Corput point, and the cumulative target shares of
the sources decide whose slot it is. Slots are ranked per source, and the r-th slot of a source
takes the source's r-th block: ``schedule`` joins slots with the pieces of documents that
their blocks hold, so a mix can be read in the order of slots, and ``mix`` sums the pieces up.

A source takes its target, rounded to a word: its last block is cut there, and blocks that it
still lacks after the last point (one or two, as a stretch of the unit interval has one point
more or less than its share) come in closing slots behind all others. This holds alike for a
source of one word and for one of a third of all rows.

Everything is DataFrame code. Running sums never meet in one task: rows are divided into lanes
by ranges of their order, lanes are summed first, and only lane totals are summed in order.

Defined results: a null or empty text has size 0 and gives 0; null and empty sources are
sources (null comes last); targets are water-filled, so that none exceeds epochs times its
source's size; an empty table gives an empty result; a repeated row is one more document;
equal (source, doc_id) rows are ordered by size, and rows equal in all these are alike; rows
without an id are ordered like rows of one id, and any number of them is divided into lanes;
very long texts are counted like any other; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, width, written

#: At most so many points are scheduled, a power of two: a block has this share of all tokens.
SLOTS = 1 << 16
#: A table of per-source rows is broadcast up to so many sources; beyond, it is joined by shuffle.
FEW = 100_000


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_lanes(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df as a written table with a lane: lanes are ranges of the order, about equally full (nulls come last).

    Columns that tell all rows apart make every lane bounded, whatever is repeated in the others.
    """
    ranged = df.repartitionByRange(width(df.sparkSession), *[F.asc_nulls_last(c) for c in order])
    return written(ranged.withColumn("lane", F.spark_partition_id()), name)


def running(df: DataFrame, group: list[str], order: list[str], **amounts: Column) -> DataFrame:
    """Exclusive running sums of amounts over group in the given order of a table in lanes, without one task for a group."""
    ordered = [F.asc_nulls_last(c) for c in order]
    inside = Window.partitionBy(*group, "lane").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = df.groupBy(*group, "lane").agg(*[F.sum(a).alias(f"_{n}") for n, a in amounts.items()])
    lanes = lanes.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("lane").alias("_lane"), *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in amounts])
    same = F.col("lane") == F.col("_lane")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    summed = df.select("*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(n) for n, a in amounts.items()])
    kept = [c for c in df.columns if c not in amounts]
    return summed.join(lanes, same).select(*kept, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in amounts])


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Per source: its place by code point and target. sizes: (source, source_size).

    Water-filling in closed form: in order of cap / weight, a source is capped if what would be
    left to it and its successors, shared by weight, exceeds its cap. Sources come in order of
    cap / weight, so the capped ones are a prefix, and the level of the first free one is that of all.
    """
    placed = running(in_lanes(sizes, ["source"], "mix-sources"), [], ["source"], place=F.lit(1)).drop("lane")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    with_cap = placed.select("*", pick.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap"))
    by_level = in_lanes(with_cap.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "place"], "mix-caps")
    behind = running(by_level, [], ["ratio", "place"], caps=F.col("cap"), weighed=F.col("weight"))
    sums = by_level.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (F.col("all_size") - F.col("caps")).cast("double") / (F.col("all_weight") - F.col("weighed"))
    levelled = behind.crossJoin(F.broadcast(sums)).withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    first = levelled.agg(F.min(F.when(~F.col("capped"), F.struct("ratio", "place", "level")))["level"].alias("all_level"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("all_level") * F.col("weight"))
    return levelled.crossJoin(F.broadcast(first)).select("source", "source_size", "place", target.alias("target"))


def mirrored(x: Column, bits: int) -> Column:
    """The lowest bits of x in reverse order: the place of slot x among all points, and the slot of a place."""
    out = F.lit(0).cast("long")
    for j in range(bits):
        out = out + F.shiftleft(F.shiftright(x, j).bitwiseAND(F.lit(1).cast("long")), bits - 1 - j)
    return out


def slots_of(goal: DataFrame, block: int, bits: int, drawn: int) -> DataFrame:
    """(place, rank, slot) of every block that a source takes. goal: place, given (words), before (words of the sources ahead).

    Of 2^bits points the k-th from the left is slot mirrored(k). A source owns the points from
    before / drawn on, up to its end; its ranks number its own slots, of which there are at most 2^bits.
    Closing slots stand behind all points: the first of every source is slot 2^bits, ordered by place.
    """
    n, wide = 1 << bits, "decimal(38, 0)"
    needed = F.floor((F.col("given") + block - 1) / F.lit(block)).cast("long")

    def edge(words: Column) -> Column:
        return F.floor((words.cast(wide) * n + (drawn - 1)) / F.lit(max(drawn, 1)).cast(wide)).cast("long")

    bounds = goal.where("given > 0").select("place", needed.alias("needed"), edge(F.col("before")).alias("low"), edge(F.col("before") + F.col("given")).alias("high"))
    points = bounds.where("low < high").withColumn("k", F.explode(F.sequence("low", F.col("high") - 1)))
    rank = (F.row_number().over(Window.partitionBy("place").orderBy("slot")) - 1).cast("long")
    own = points.select("place", "needed", mirrored(F.col("k"), bits).alias("slot")).withColumn("rank", rank).where("rank < needed")
    owned = F.col("high") - F.col("low")
    closing = bounds.where(owned < F.col("needed")).withColumn("rank", F.explode(F.sequence(owned, F.col("needed") - 1)))
    return own.select("place", "rank", "slot").unionByName(closing.select("place", "rank", (n + F.col("rank") - owned).alias("slot")))


def pieces(docs: DataFrame, weights: tuple[int, ...], epochs: int, n_slots: int, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Every document with each piece of it that lies in a block of its source (one row without a piece, if none does), and the slots."""
    sized = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *keep, F.monotonically_increasing_id().alias("row_number")),
        "mix-sizes",
    )
    per_source = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    total = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    bits = min(n_slots.bit_length() - 1, max(total - 1, 0).bit_length())
    block = max(1, -(-total // (1 << bits)))

    goal = targets(per_source, weights, epochs).withColumn("given", F.round("target").cast("long"))
    goal = written(running(in_lanes(goal, ["place"], "mix-goals"), [], ["place"], before=F.col("given")).drop("lane"), "mix-targets")
    n_sources, drawn = goal.agg(F.count("*"), F.coalesce(F.sum("given"), F.lit(0))).first()
    slots = written(slots_of(goal, block, bits, drawn), "mix-slots")

    small = F.broadcast if n_sources <= FEW else (lambda df: df)
    digest = F.md5(F.concat_ws("/", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = sized.join(small(goal.drop("before").withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("digest", digest)
    order = ["digest", "doc_id", "size", *keep, "row_number"]
    laid = running(in_lanes(keyed, ["place", *order], "mix-lanes"), ["place"], order, start=F.col("size"))

    def inside(epoch: int) -> Column:
        low = F.col("start") + epoch * F.col("source_size")
        high = F.least(low + F.col("size"), F.col("given"))

        def piece(r: Column) -> Column:
            begin = F.greatest(low, r * block)
            return F.struct(r.alias("rank"), F.lit(epoch).alias("epoch"), (begin - low).alias("at"), (F.least(high, (r + 1) * block) - begin).alias("words"))

        ranks = F.sequence(F.floor(low / F.lit(block)), F.floor((high - 1) / F.lit(block)))
        return F.when(high > low, F.transform(ranks, piece))

    every = F.explode_outer(F.flatten(F.array_compact(F.array(*map(inside, range(epochs))))))
    cut = laid.select("row_number", "doc_id", "source", "place", "size", "source_size", "target", *keep, every.alias("piece"))
    return cut.select(*[c for c in cut.columns if c != "piece"], "piece.*"), slots


def schedule(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """The mix piece by piece: slot, place and rank of the block, the document, its epoch (from 0), the piece's first word (from 0) and words.

    Read in order of slot, place, epoch and lane of documents, any stretch of it has the sources near their weights.
    """
    cut, slots = pieces(docs, weights, epochs, n_slots, id_col, text_col, source_col, keep)
    return cut.join(slots, ["place", "rank"]).select("slot", "place", "rank", "source", "doc_id", "epoch", "at", "words", *keep)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, n_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and the columns to keep of every document; these order equal rows."""
    cut, slots = pieces(docs, weights, epochs, n_slots, id_col, text_col, source_col, keep)
    each = ["row_number", "doc_id", "size", "source_size", "target", "source", *keep]
    placed = cut.join(slots, ["place", "rank"], "left")
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("long")
    return placed.groupBy(*each).agg(taken.alias("taken")).select("doc_id", "size", "source_size", "target", "taken", "source", *keep)
