"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts are a group and go to one shard, unless the group is larger than a
piece may be; such a hot group is divided into pieces by the number of the row, so equal or missing ids divide it as well. Every piece is a
vector (bytes, tokens, rows), each component as a share of the whole table's. A piece goes to
the shard where the dot product of its vector with the shard's residual capacity is highest.

Pieces are placed in tiers by size: the largest in one task, then those of each further tier in
``TIER`` times as many lanes, to which they are dealt by hash. A piece that could upset a lane of
the next tier belongs to this one, so a lane of any tier but the last gets a bounded number of
pieces, whatever the number of partitions. A lane packs its pieces, largest first, against its
share of the capacity that earlier tiers left; it holds one vector a shard, so its memory is
constant, and lanes need nothing of each other.

The law is `bytes`: sizes (UTF-8 bytes of the text plus ``OVERHEAD``) are near equal.

Defined results: a null text has no bytes and no tokens, and null texts are a group; an empty
text likewise; an empty table gives an empty result; repeated rows, and rows that share an id or
have none, get slots of their own and count like any, also within a hot group; very long texts are measured, not held, and are pieces like any other; only the two named columns
are read, so others can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import width, written
from tallyloom.llm.mixing import running, word_count

OVERHEAD = 8
#: A group is kept whole up to 1/PIECE of a shard; a piece is large from 1/LARGE of a lane's shard on.
PIECE, LARGE = 2, 4
#: Lanes of a tier for each of the one before.
TIER = 64
#: A lane packs about so many pieces at least, as few pieces can't be balanced.
LANE_PIECES = 20_000
#: Weight of a component in the dot product: bytes are what the law promises.
IMPORTANCE = (256.0, 1.0, 1.0)


def packer(n_shards: int, totals: tuple[float, float, float], taken: list[list[float]]):
    """A function that places vectors one after another by the dot product with residual capacity.

    Capacity follows the load: a shard's due share of what was placed so far and the next
    vector, less what it has; so a lane needs no totals of its own beforehand.
    """
    scale = np.array([1.0 / t if t else 0.0 for t in totals])
    held = np.array(taken, dtype=np.float64) * scale if taken else np.zeros((n_shards, 3))
    free = np.maximum(1.0 / n_shards - held, 0.0)
    due = np.divide(free, free.sum(axis=0), out=np.full_like(free, 1.0 / n_shards), where=free.sum(axis=0) > 0)
    load, placed, weight = np.zeros((n_shards, 3)), np.zeros(3), np.array(IMPORTANCE)

    def place(vector: np.ndarray) -> int:
        nonlocal placed
        v = vector * scale
        placed = placed + v
        room = due * placed - load
        shard = int(np.argmax(room @ (weight * v)))
        load[shard] += v
        return shard

    return place


def pack(pieces: DataFrame, n_shards: int, totals: tuple, taken: list, lanes: int) -> DataFrame:
    """shard of each piece (key, piece, bytes, tokens, rows), in as many lanes."""
    import pyarrow as pa

    def run(batches):
        place = packer(n_shards, totals, taken)
        for batch in batches:
            vectors = np.column_stack([batch.column(i).to_numpy().astype(np.float64) for i in (2, 3, 4)])
            shards = np.fromiter((place(v) for v in vectors), np.int32, len(vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shards)], names=["key", "piece", "shard"])

    dealt = pieces.repartition(lanes, "key", "piece").sortWithinPartitions(F.desc("bytes"), "key", "piece")
    return dealt.select("key", "piece", "bytes", "tokens", "rows").mapInArrow(run, "key string, piece long, shard int")


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in a shard) of every row."""
    spark = docs.sparkSession
    lanes = width(spark)
    text = F.col(text_col)
    utf8 = text.cast("string").cast("binary")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(utf8), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(F.coalesce(utf8, F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.md5(utf8), F.lit("")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = written(narrow, "shard-rows")  # rows keep their numbers from here on
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = narrow.groupBy("key").agg(*sums)
    total = narrow.agg(*sums).first()
    totals = tuple(float(x or 0) for x in total)
    most = [max(1.0, t / n_shards / PIECE) for t in totals]
    cuts = F.ceil(F.greatest(F.col("bytes") / most[0], F.col("rows") / most[2]) * 2)
    # a group this large is one of PIECE * n_shards a component at most
    hot = groups.where((F.col("rows") > 1) & ((F.col("bytes") > most[0]) | (F.col("rows") > most[2]))).select(F.col("key").alias("hot_key"), cuts.alias("cuts"))
    rows = narrow.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    rows = rows.withColumn("piece", F.when(F.col("cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("cuts"))).cast("long")).drop("hot_key", "cuts")
    pieces = written(rows.groupBy("key", "piece").agg(*sums), "shard-pieces")

    tiers, most_lanes = [1], max(1, min(lanes, pieces.count() // LANE_PIECES))
    while tiers[-1] < most_lanes:
        tiers.append(min(most_lanes, tiers[-1] * TIER))
    placed, load, ceiling = None, np.zeros((n_shards, 3)), None
    for packed, finer in zip(tiers, [*tiers[1:], None]):
        # at most n_shards * finer * LARGE pieces in all exceed the floor
        floor = max(1.0, totals[0] / n_shards / finer / LARGE) if finer else 0.0
        tier = pieces.where((F.col("bytes") > floor) & (F.lit(True) if ceiling is None else F.col("bytes") <= ceiling))
        done = pack(tier, n_shards, totals, load.tolist(), packed)
        if finer:
            done = written(done, "shard-tier")
            put = done.join(tier, ["key", "piece"]).groupBy("shard").agg(*[F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")])
            for r in put.collect():  # a row a shard
                load[r.shard] += (float(r.bytes), float(r.tokens), float(r.rows))
        placed, ceiling = done if placed is None else placed.unionByName(done), floor

    put = rows.join(placed, ["key", "piece"]).select("doc_id", "size", "text_crc32", "shard", "key", "row")
    put = put.withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)))
    put = written(put, "shard-placed")
    return running(put, ["shard"], ["row"], slot=F.lit(1)).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), F.col("key").alias("group_key"))
