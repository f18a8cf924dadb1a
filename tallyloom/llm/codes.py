"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Components are integers, floor(scale * x). A vector is cut into equal consecutive parts; each part position
has a codebook of ``entries`` entries, which starts as that part of the vectors with the smallest ids. A
round broadcasts the codebooks (their size is fixed by entries and length), and Arrow batches compute all
distances by the expansion |v|^2 - 2 v.c + |c|^2 with one exact integer matrix product a part, take the first
smallest, and add up components per entry; the tasks' sums are merged by a grouped shuffle into one row
an entry and component, from which the next codebooks come. Products run in doubles where these hold every
partial sum exactly, else in 64-bit integers.

Defined results: vectors that are null or hold a null or non-finite component are dropped. Vectors
that are empty, or not of the first (smallest id) vector's length, take no part and come back with null code and errors, and so do all
if that length is no multiple of the number of parts; they add nothing to label_error, which is null where a label has no coded
vector. Repeated rows and ids count each; a null id comes after all others and its row is coded like any. With fewer vectors than entries the
codebook has as many entries as vectors; starting entries of one id come in order of their components.
Distances that 64 bits can't hold raise OverflowError. An empty table gives an empty result. Only the three named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import written

#: Vectors whose distances are held at a time.
STEP = 2048


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, v, label of the vectors without null or non-finite components."""
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    return named.where(F.col("v").isNotNull() & finite)


def integers(lists, d: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lists have d components, and these as an integer matrix."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == d)
    starts = np.concatenate([[0], np.cumsum(sizes)])[at]
    x = np.floor(lists.flatten().to_numpy(zero_copy_only=False)[starts[:, None] + np.arange(d)] * float(scale))
    if np.abs(x).max(initial=0) >= 2.0**31:
        raise OverflowError("a component's distance does not fit 64 bits")
    return at, x.astype(np.int64)


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and the squared distance to it, of each row."""
    top = int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0))
    bound = v.shape[1] * (top[0] + top[1]) ** 2
    if bound >= 2**63:
        raise OverflowError("a distance does not fit 64 bits")
    if bound < 2**53:
        product = (v.astype(np.float64) @ book.astype(np.float64).T).astype(np.int64)
    else:
        product = v @ book.T
    distance = (v * v).sum(axis=1)[:, None] - 2 * product + (book * book).sum(axis=1)[None, :]
    first = distance.argmin(axis=1)
    return first, distance[np.arange(len(v)), first]


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks as an array (part, entry, component)."""
    import pyarrow as pa

    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vec_col, label_col)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("vec_id", "v").limit(1).collect()
    d = len(first[0].v) if first else 0
    width = d // parts if d % parts == 0 else 0
    books = np.zeros((parts, 0, width), dtype=np.int64)
    if width:
        start = kept.where(F.size("v") == d).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
        books = integers(pa.array([r.v for r in start], pa.list_(pa.float64())), d, scale)[1].reshape(-1, parts, width).transpose(1, 0, 2)

    def sums(shared):
        def run(batches):
            books = shared.value
            total, number = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                v = integers(batch.column(0), d, scale)[1]
                for k in range(0, len(v), STEP):
                    for p in range(parts):
                        part = v[k : k + STEP, p * width : (p + 1) * width]
                        entry = nearest(part, books[p])[0]
                        order = np.argsort(entry, kind="stable")
                        used, at = np.unique(entry[order], return_index=True)
                        total[p, used] += np.add.reduceat(part[order], at, axis=0)
                        number[p] += np.bincount(entry, minlength=books.shape[1])
            p, e = np.nonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(list(total[p, e]), pa.list_(pa.int64())), pa.array(number[p, e])], names=["part", "entry", "total", "n"])

        return run

    for _ in range(rounds if width else 0):
        shared = spark.sparkContext.broadcast(books)
        told = kept.select("v").mapInArrow(sums(shared), "part int, entry int, total array<long>, n long")
        merged = told.select("part", "entry", "n", F.posexplode("total").alias("position", "component")).groupBy("part", "entry", "position").agg(F.sum("component").alias("component"), F.sum("n").alias("n"))
        books = books.copy()
        for r in merged.collect():  # as many rows as the codebooks have components
            books[r.part, r.entry, r.position] = r.component // r.n
        shared.unpersist()

    final = spark.sparkContext.broadcast(books)

    def code(batches):
        books = final.value
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if width:
                at, v = integers(batch.column(1), d, scale)
                for k in range(0, len(v), STEP):
                    found = [nearest(v[k : k + STEP, p * width : (p + 1) * width], books[p]) for p in range(parts)]
                    index, error = np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)
                    for i, row, e in zip(at[k : k + STEP].tolist(), index.tolist(), error.tolist()):
                        codes[i], errors[i] = "".join(f"{x:0{digits}x}" for x in row), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    digits = max(1, len(f"{max(entries - 1, 0):x}"))
    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(code, f"vec_id long, label {label}, code string, error long"), books


def compressed(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and the digest of the codebooks."""
    coded, books = encode(vectors, **options)
    coded = written(coded, "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
