"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

A document is its ids and an end id. One longer than a sequence is cut into pieces of a sequence's
length, the last of which may be shorter; no other is cut. A piece goes where the sum of the squared
counts of open sequences per residual gap becomes smallest, ties to the smaller gap that is left.
Pieces come longest first, and a new sequence is opened only where no open one has room.

Pieces of one length are interchangeable, so the rule is applied to the histogram of lengths, which
has one row a length whatever the size of the table. Pieces of one length are placed ``SHARES`` times
at most per gap: one by one up to that number of them, in equal shares beyond. The outcome is a list of
ranges "the pieces of length L and rank r to r + n go to sequences s to s + n at offset o", which is
broadcast (its size is bounded by the number of lengths, not of pieces); each piece finds its range by
its rank among those of its length, counted by lanes so that a frequent length is no single task's.

Defined results: a null or empty text is the end id alone; a text of any length is cut whole; rows
repeated or sharing an id, or having none, are packed one by one; equal lengths are placed in
order of lanes and rows; an empty table gives an empty result; only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bpe_batch import batch_encoder
from tallyloom.llm.common import id_and_text, width, written
from tallyloom.llm.mixing import running

#: Pieces of one length are placed in about so many shares.
SHARES = 256
#: Bits of a rank within a length.
RANK_BITS = 44


def pieces_of(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with the number of the row they come from."""
    import pyarrow as pa

    content = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end, step = array("I", [end_id]).tobytes(), 4 * capacity
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        encoder = batch_encoder(content.value)
        for batch in batches:
            at, cut = [], []
            for i, ids in enumerate(encoder.encode_each(batch.column(1))):
                ids += end
                for p, k in enumerate(range(0, len(ids), step)):
                    part = ids[k : k + step]
                    at.append(i)
                    cut.append((p, k // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            piece, start, length, crc, part = zip(*cut) if cut else ((),) * 5
            cols = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 2)] + [pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(part, pa.binary())] * keep_ids, names=names)

    return id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def sum_of_squares(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): where the counted pieces of each length go."""
    gaps = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by what is free in them; full ones aren't open
    where: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # the same as ranges (first, number)
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left, share = 0, counts[length], -(-counts[length] // SHARES)
        while left:
            n = min(left, share)
            have, after = gaps[length:], gaps[: capacity + 1 - length]
            # change of the sum for n pieces, over n: n sequences leave their gap and come to a smaller one or are full
            change = np.where(have > 0, 2 * (after - have) + 2 * n, np.iinfo(np.int64).max)
            if have[0]:
                change[0] = n - 2 * have[0]
            rest = int(change.argmin())
            if not have[rest]:  # no open one has room
                n = left if 2 * length > capacity else n
                moved = [(sequences, n)]
                sequences, rest, offset = sequences + n, capacity - length, 0
            else:
                n, offset, moved = min(n, int(have[rest])), capacity - length - rest, []
                gaps[length + rest] -= n
                wanted = n
                while wanted:
                    first, number = where[length + rest].pop()
                    take = min(number, wanted)
                    if take < number:
                        where[length + rest].append((first + take, number - take))
                    moved.append((first, take))
                    wanted -= take
            if rest:
                gaps[rest] += n
                where[rest].extend(moved)
            for first, number in moved:
                plan.append((length, rank, number, first, offset))
                rank += number
            left -= n
    return plan


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece (and its ids, if keep_ids)."""
    import pyarrow as pa

    if not 0 < capacity < 1 << (63 - RANK_BITS):
        raise ValueError(f"a sequence holds 1 to {(1 << (63 - RANK_BITS)) - 1} tokens, not {capacity}")
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer_json, capacity, end_id, keep_ids, id_col, text_col), "pack-pieces")
    pieces = pieces.withColumn("lane", F.pmod(F.col("row") + F.col("piece"), F.lit(width(spark))))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    plan = np.array(sum_of_squares(counts, capacity), dtype=np.int64).reshape(-1, 5)
    keys = (plan[:, 0] << RANK_BITS) + plan[:, 1]
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], plan[order, 1], plan[order, 3], plan[order, 4]))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"

    def run(batches):
        first_keys, first_rank, first_sequence, offset = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(first_keys, (length << RANK_BITS) + rank, side="right") - 1
            cols = [batch.column(c) for c in kept] + [pa.array(first_sequence[at] + rank - first_rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "sequence_id", "offset"])

    ranked = running(pieces, ["length"], ["row", "piece"], rank=F.lit(1)).withColumn("rank", F.col("rank").cast("long"))
    return ranked.select(*kept, "rank").mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence, from pieces packed with keep_ids; a sequence is of bounded length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
