"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector. A histogram of the scores narrows down, level by
level, the interval that holds a query's k-th score, until that interval is one score wide.
Then the vectors scoring at least that are kept and ranked, ties to the smaller id.

Queries are handled in blocks of a bounded number, one pass of the vectors a level; a block's
result is written before the next one begins, so neither plans nor broadcasts add up. A
partition reports only the histogram bins from its own k-th score upward, as no lower bin can
hold the k-th score of all; so it reports at most k bins a query. Spark adds the bins up and finds
the one that holds the k-th score; the driver gets that one bin a query.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no
part, neither as query nor as candidate; vectors of another length than the query's are not
its candidates; an id given to several vectors asks with each, ranked together; a query with fewer
than k candidates returns them all; rows that share the query's id are the query itself; repeated
candidate rows are returned once each; a null id takes no part; an empty table gives an empty
result; only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import folder

#: Queries a block at most, in expectation; vectors scored at a time; bins a level.
BLOCK, STEP, BINS = 2048, 2048, 1 << 14


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for the vectors that take part."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"))


def matrices(batches):
    """(ids, int matrix) by length of vector, in steps of bounded size."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            for k in range(0, len(at), STEP):
                part = at[k : k + STEP]
                yield int(d), ids[part], flat[(starts[part][:, None] + np.arange(d))]


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where they hold them exactly."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


NEVER = np.iinfo(np.int64).min


def kth_of(best: np.ndarray, more: np.ndarray, k: int) -> np.ndarray:
    """The k highest of each row of both."""
    both = np.concatenate([best, more], axis=1)
    return np.partition(both, both.shape[1] - k, axis=1)[:, -k:]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query over all vectors."""
    spark = vectors.sparkSession
    rows = quantised(vectors.select(id_col, vec_col), id_col, vec_col, scale)
    asked = quantised(vectors.where(is_query).select(id_col, vec_col), id_col, vec_col, scale)
    n_asked, largest, longest = asked.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_asked:
        return empty
    bound = int(rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]) * int(largest) * int(longest)
    blocks = -(-n_asked // BLOCK)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    place = folder(spark, "top-k")
    for b in range(blocks):
        block = sorted(map(tuple, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).distinct().collect()))
        if not block:
            continue
        by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for d in {len(v) for _, v in block}:
            at = np.array([i for i, (_, v) in enumerate(block) if len(v) == d])
            by_length[d] = (at, np.array([block[i][0] for i in at]), np.array([block[i][1] for i in at], dtype=np.int64))
        shared = spark.sparkContext.broadcast(by_length)
        low, need = np.full(len(block), -bound, dtype=np.int64), np.full(len(block), k, dtype=np.int64)
        open_, wide = np.ones(len(block), dtype=bool), 2 * bound + 1
        while wide > 1:
            step = -(-wide // BINS)
            counts = rows.mapInArrow(histogram(shared, low, wide, step, k), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
            wanted = spark.createDataFrame([(i, int(x)) for i, x in enumerate(need)], "q int, need long")  # as many rows as the block has queries
            reached = counts.select("q", "bin", "n", above.alias("cum")).join(F.broadcast(wanted), "q").where("cum >= need")
            hits = reached.groupBy("q").agg(F.min(F.struct("cum", "bin", "n")).alias("hit"))
            hit_of = {r.q: r.hit for r in hits.collect()}  # a row a query of the block
            for q in range(len(block)):
                hit = hit_of.get(q)
                if hit is None:
                    open_[q] = False
                elif open_[q]:
                    low[q] += hit.bin * step
                    need[q] -= hit.cum - hit.n
            wide = step
        low[~open_] = NEVER
        best = rows.mapInArrow(survivors(shared, low, k), "query_id long, vec_id long, score long")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return ranked
        ranked.write.parquet(f"{place}/block={b}")
        shared.unpersist()
    return spark.read.schema(empty.schema).parquet(f"{place}/block=*")


def histogram(shared, low: np.ndarray, wide: int, step: int, k: int):
    """Counts of the scores in [low, low + wide), in bins of step, from the partition's k-th score upward."""
    import pyarrow as pa

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d, ids, v in matrices(batches):
            if d not in shared.value:
                continue
            at, qids, q = shared.value[d]
            s = scores(q, v)
            s[qids[:, None] == ids[None, :]] = NEVER
            best = kept[d] = kth_of(kept.get(d, np.full((len(at), k), NEVER)), s, k)
            first = low[at][:, None]
            hit = (s >= np.maximum(best.min(axis=1)[:, None], first)) & (s != NEVER) & (s - first < wide)
            rows, cols = np.nonzero(hit)
            keys = rows * BINS + (s[rows, cols] - low[at][rows]) // step
            old = seen.get(d, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            keys, place = np.unique(np.concatenate([old[0], keys]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([old[1], np.ones(len(rows))]), minlength=len(keys)).astype(np.int64)
            least = np.maximum((np.maximum(best.min(axis=1), low[at]) - low[at]) // step, 0)
            stay = keys % BINS >= least[keys // BINS]
            seen[d] = (keys[stay], n[stay])
        for d, (keys, n) in seen.items():
            at = shared.value[d][0]
            yield pa.RecordBatch.from_arrays([pa.array(at[keys // BINS].astype(np.int32)), pa.array((keys % BINS).astype(np.int32)), pa.array(n)], names=["q", "bin", "n"])

    return run


def survivors(shared, low: np.ndarray, k: int):
    """Of each query the partition's k best rows among those that score at least low, ties to the smaller id."""
    import pyarrow as pa

    def run(batches):
        kept: dict[int, list[list[np.ndarray]]] = {}
        for d, ids, v in matrices(batches):
            if d not in shared.value:
                continue
            at, qids, q = shared.value[d]
            s = scores(q, v)
            hit = (s >= low[at][:, None]) & (qids[:, None] != ids[None, :])
            rows, cols = np.nonzero(hit)
            old = kept.get(d, [np.zeros(0, np.int64)] * 3)
            rows, got, val = (np.concatenate(x) for x in zip(old, (rows, ids[cols], s[rows, cols])))
            order = np.lexsort((got, -val, rows))
            rows, got, val = rows[order], got[order], val[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept[d] = [x[place < k] for x in (rows, got, val)]
        for d, (rows, got, val) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[d][1][rows]), pa.array(got), pa.array(val)], names=["query_id", "vec_id", "score"])

    return run
