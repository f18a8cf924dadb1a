"""N-gram Jaccard self-join by T-occurrence search, and the components of its links.

Two texts link when the Jaccard similarity of their sets of word n-grams reaches num/den. For
sizes a and b that is an overlap of T = ceil(num (a + b) / (num + den)).

1. Every text gets a 128-bit digest of its set; equal sets are one class, represented by the
   smallest doc_id. Shingle frequencies are gathered over all texts in a table of fixed size.
2. Shingles are ordered rare first (by that table, ties by hash). Linked sets share one of
   their first n - ceil(num n / den) + 1 shingles, so sets meet in a block per prefix shingle;
   the block is named by the smallest set that has the shingle, so that blocks of many shared
   shingles fall together. Blocks are also apart by levels of sizes, and
   sets whose profiles (counts of shingles by range of hash) already differ too much part.
3. In a block the T-occurrence problem is solved for every set by DivideSkip: the shingles'
   inverted lists are divided into long and short ones, the short lists are merged with a
   heap, and sets that reach T less the number of long lists are looked up in the long lists
   by binary search. Sets already known to be connected are not compared again, so a block
   gives a spanning forest instead of all pairs.
4. Blocks over ``BLOCK`` sets or ``LOAD`` shingles are cut into chunks that all hold the block's
   first set. Where some are not connected to it after that (usually none are), the block's sets
   meet again by parts: linked sets differ in at most d shingles, so of d + 1 ranges of hashes at
   least one holds the same shingles in both. Only groups that agree in a part and are not
   connected yet are searched, again by chunks; what is then still apart is searched against all.
5. Links are joined into components by Spark.

No step drops a candidate, so components are exact up to 64-bit collisions of shingle hashes.

Defined results: a null or empty text, or one of white space alone, has no shingle, links with
nothing and is its own component; a text of fewer than n words has its whole sequence as one
shingle; rows that share a doc_id count as one document that links wherever any of them does;
an empty table gives an empty result; texts of any length are read whole; repeated rows are
equal sets; only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import free_worker, id_and_text, width, written
from tallyloom.llm.graph import components

#: Sets of a block compared in one task; counters of the frequency table, and rows or counters given at once.
BLOCK, COUNTERS, PART = 512, 1 << 20, 1 << 16
#: Sets of a block whose profiles are compared in one task; blocks of more pass as they are.
COMPARED = 2048
#: Shingles of a block that are held in one task.
LOAD = 1 << 22
#: Most ids (of 16 bytes with their label) that are broadcast to the texts.
FEW = 1 << 20
#: Factor between levels of sizes: only sets of sizes that can link meet in a block.
LEVEL = 1.5
#: Factor between levels of sizes where sets meet by parts.
BAND = 1.1
#: Cost of a binary probe against a step of the merge, which decides how many lists are long.
PROBE_COST = 0.01
#: Entries or probes that are held at once; entries that are counted in the time of a probe.
STEPS, PROBED = 1 << 18, 10
ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct n-gram hashes of texts."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mixed(out + h[k : len(h) - n + 1 + k] * ODD[k % len(ODD)])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digest(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def key64(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def profile(shingles: np.ndarray, num: int, den: int) -> bytes:
    """Numbers of shingles per range of hashes, in a power of two of ranges that grows with the set.

    What two profiles differ by is a lower bound of what the sets differ by (also where a number
    is cut off at a byte); that many ranges tell unrelated sets from linked ones.
    """
    apart = 2 * (den - num) / (den + num)
    ranges = 1 << max(4, math.ceil(math.log2(max(1.0, 1.5 * (apart / 1.128) ** 2 * len(shingles)))))
    at = (shingles >> np.uint64(64 - int(math.log2(ranges)))).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=ranges), 255).astype(np.uint8).tobytes()


def survey(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, key, profile) of every row, and the log frequency class of each counter."""
    import pyarrow as pa

    schema = "doc_id long, n_shingles long, key binary, profile binary, part int, counts binary"

    def run(batches):
        free_worker()
        shingler, counts = Shingler(n), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sizes, keys, profiles, held, load = [], [], [], [], 0
            for text in batch.column(1):
                s = shingler(text.as_py())
                sizes.append(len(s))
                keys.append(digest(s) if len(s) else None)
                profiles.append(profile(s, num, den) if len(s) else None)
                held.append(s)
                load += len(s)
                if load > COUNTERS:
                    counts += np.bincount((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                    held, load = [], 0
            if load:
                counts += np.bincount((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(profiles, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        parts = [zlib.compress(counts[k : k + PART].astype("<u4").tobytes(), 1) for k in range(0, COUNTERS, PART)]
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=names)

    names = ["doc_id", "n_shingles", "key", "profile", "part", "counts"]
    rows = written(docs.mapInArrow(run, schema), "shingle-sets")

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.frombuffer(zlib.decompress(counts.as_py()), "<u4").astype(np.int64)
                sums[part] = sums[part] + c if part in sums else c
        out = [(p, np.minimum(255, np.round(8 * np.log2(c + 1.0))).astype(np.uint8).tobytes()) for p, c in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["part", "classes"])

    summed = rows.where("part is not null").select("part", "counts").repartition(COUNTERS // PART, "part").mapInArrow(add, "part int, classes binary")
    classes = np.zeros(COUNTERS, np.uint8)
    for part, c in summed.collect():  # COUNTERS bytes in all
        classes[part * PART : (part + 1) * PART] = np.frombuffer(c, np.uint8)
    return rows.where("part is null").select("doc_id", "n_shingles", "key", "profile"), classes


def prefixes(docs: DataFrame, n: int, num: int, den: int, classes: np.ndarray) -> DataFrame:
    """(shingle, set, n): the prefix shingles and size of every set; a task gives those of equal sets once."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        free_worker()
        shingler, order, seen = Shingler(n), shared.value, set()
        for batch in batches:
            shingles, sets, sizes = [], [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                if not len(s) or (key := key64(digest(s))) in seen:
                    continue
                seen.add(key)
                first = len(s) + (-num * len(s) // den) + 1
                rare = np.lexsort((s, order[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:first]
                shingles.append(s[rare].view(np.int64))
                sets.append(np.full(first, key, np.int64))
                sizes.append(np.full(first, len(s), np.int32))
            if shingles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shingles, sets, sizes)], names=["shingle", "set", "n"])

    return docs.mapInArrow(run, "shingle long, set long, n int")


def viable(members: DataFrame, num: int, den: int) -> DataFrame:
    """Blocks (block, first, doc_id, n) divided into what can link at all, by the profiles' bound.

    members: (block, doc_id, n, profile), with at most ``COMPARED`` sets a block. Sets that can
    link with none of their block go.
    """
    import pyarrow as pa

    names = ["block", "first", "doc_id", "n"]

    def divide(rows: list[tuple[int, int, int, bytes]], out: list[tuple[int, bool, int, int]]) -> None:
        if len(rows) < 2:
            return
        sizes = np.array([r[2] for r in rows])
        counts = [np.frombuffer(r[3], np.uint8).astype(np.int32) for r in rows]
        least = min(map(len, counts))
        table = np.stack([c.reshape(least, -1).sum(axis=1) for c in counts])
        known, linked_ = Forest(len(rows)), np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            both = sizes[i + 1 :] + sizes[i]
            most = (both - np.abs(table[i + 1 :] - table[i]).sum(axis=1)) // 2
            for j in (np.flatnonzero((most >= -(-num * both // (num + den))) & (most > 0)) + i + 1).tolist():
                known.join(i, j)
                linked_[i] = linked_[j] = True
        for i in np.flatnonzero(linked_).tolist():
            root = known.root(i)
            out.append((xxhash.xxh3_64_intdigest(f"{rows[i][0]}/{rows[root][1]}".encode()) - (1 << 63), root == i, rows[i][1], rows[i][2]))

    def batch_of(out: list[tuple]):
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int32()))], names=names)

    def run(batches):
        free_worker()
        name, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != name:
                    divide(rows, out)
                    name, rows = row[0], []
                rows.append(row)
            yield batch_of(out)
        out = []
        divide(rows, out)
        yield batch_of(out)

    dealt = members.select("block", "doc_id", "n", "profile").repartition(width(members.sparkSession), "block").sortWithinPartitions("block", "doc_id")
    return dealt.mapInArrow(run, "block long, first boolean, doc_id long, n int")


class Forest:
    """Union-find over the places of a block."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def t_occurrence(sets: list[np.ndarray], queries: list[int], num: int, den: int, known: Forest) -> None:
    """Join in known all links between the queries and the sets of a block, by DivideSkip."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    entries = np.sort(place * m + owner)  # the inverted lists, one after another, each by owner
    starts = np.searchsorted(entries, np.arange(len(tokens) + 1) * m)
    lengths = np.diff(starts)
    listed = (entries % m).astype(np.int32)
    ends = np.cumsum(sizes)
    labels = np.array([known.root(i) for i in range(m)])  # what is connected, as known has it

    def counted(lists: np.ndarray) -> np.ndarray:
        """Of how many of the lists each set is."""
        seen = np.zeros(m, np.int64)
        for few in in_steps(lists, lengths[lists]):
            seen += np.bincount(listed[places(starts[few], lengths[few])], minlength=m)
        return seen

    for q in queries:
        size = int(sizes[q])
        fit = (sizes * den >= size * num) & (size * den >= sizes * num)
        apart = fit & (labels != labels[q])
        if not apart.any():
            continue
        least = -(-num * (size + int(sizes[fit].min())) // (num + den))
        mine = place[ends[q] - size : ends[q]]
        by_length = mine[np.argsort(lengths[mine], kind="stable")]
        n_long = min(least - 1, int(least / (PROBE_COST * math.log2(lengths[by_length[-1]] + 1) + 1)), size)
        short, long_ = by_length[: size - n_long], by_length[size - n_long :]
        seen = counted(short)
        needed = -(-num * (size + sizes) // (num + den))
        some = np.flatnonzero(apart & (seen > 0) & (seen + n_long >= needed))
        if not len(some):
            continue
        if lengths[long_].sum() < PROBED * len(some) * n_long:  # so many look-ups take longer than the lists themselves
            total = (seen + counted(long_))[some]
        else:
            total = seen[some]
            for few in np.array_split(np.arange(len(some)), -(-len(some) * n_long // STEPS) or 1):
                probe = (long_[None, :] * m + some[few, None]).ravel()
                at = np.minimum(np.searchsorted(entries, probe), len(entries) - 1)
                total[few] += (entries[at] == probe).reshape(len(few), n_long).sum(axis=1)
        for c in some[total >= needed[some]].tolist():
            if labels[c] != labels[q]:
                known.join(q, c)
                labels[labels == labels[c]] = labels[q]


def in_steps(lists: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Lists divided into runs of about ``STEPS`` entries; those of one entry, which hold their own set alone, left out."""
    lists, lengths = lists[lengths > 1], lengths[lengths > 1]
    return np.split(lists, np.flatnonzero(np.diff(np.cumsum(lengths) // STEPS)) + 1) if len(lists) else []


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def search(members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) found in the blocks of members (block, chunk, other, asks, doc_id, text).

    Rows of equal (block, chunk, other) are a block; those with asks are its queries.
    """
    import pyarrow as pa

    def links(rows: list[tuple[int, bool, str]], shingler: Shingler):
        ids = [r[0] for r in rows]
        sets = [shingler(r[2]) for r in rows]
        known = Forest(len(rows))
        t_occurrence(sets, [i for i, r in enumerate(rows) if r[1]], num, den, known)
        return [(ids[i], ids[known.root(i)]) for i in range(len(rows)) if known.root(i) != i]

    def run(batches):
        free_worker()
        shingler, name, rows = Shingler(n), None, []
        for batch in batches:
            found = []
            few = (batch.slice(k, 256) for k in range(0, batch.num_rows, 256))  # texts become objects a few at a time
            for block, chunk, other, asks, doc_id, text in (row for part in few for row in zip(*(part.column(i).to_pylist() for i in range(6)))):
                if (block, chunk, other) != name:
                    found += links(rows, shingler) if len(rows) > 1 else []
                    name, rows = (block, chunk, other), []
                rows.append((doc_id, asks, text))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])
        found = links(rows, shingler) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    keys = ["block", "chunk", "other"]
    dealt = members.select(*keys, "asks", "doc_id", "text").repartition(width(members.sparkSession), *keys).sortWithinPartitions(*keys, F.desc("asks"), "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def level(size: Column) -> Column:
    """Level of a size of set: the power of LEVEL below it."""
    return F.floor(F.log(size) / F.log(F.lit(LEVEL))).cast("int")


def linked(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    texts = id_and_text(docs, id_col, text_col)
    rows, classes = survey(texts, n, num, den)
    reps = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("profile").alias("profile"))
    reps = written(reps, "classes")
    # the digest's first 8 bytes, as prefixes() names sets; sets that share them only meet in a block
    named = reps.select(F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("set"), "rep", "n", "profile")
    # a set is at its own level of sizes, and at those that larger sets it can link with are at
    levels = F.sequence(level(F.col("n")), level(F.col("n") * den / num * (1 + 1e-9)))
    part = prefixes(texts, n, num, den, classes).select("shingle", "set", F.explode(levels).alias("level"))
    groups = part.groupBy("shingle", "level").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low < high")
    groups = written(groups.select("shingle", "level", F.xxhash64("level", "low").alias("block")), "shared-shingles")
    members = part.join(groups, ["shingle", "level"]).select("block", "set").distinct()
    members = blocks(members, named, num, den)
    # members grow with the documents: the join with their texts is by sorting at any size
    of_text = texts.where("text is not null")
    links = written(search(in_chunks(members).join(of_text.hint("merge"), "doc_id"), n, num, den), "links")
    links = by_parts(members, links, named, of_text, n, num, den)
    classed = rows.join(reps.select("key", "rep"), "key", "left")
    # an id of several rows links the classes that they are in
    several = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    same = classed.where("rep <> doc_id").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    comps = components(links.unionByName(same))
    out = classed.join(comps, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def blocks(members: DataFrame, named: DataFrame, num: int, den: int) -> DataFrame:
    """(block, first, doc_id, chunks) of members (block, set): what can link, and the chunks that a block is cut into."""
    members = written(members, "block-sets")
    sizes = members.groupBy("block").agg(F.count("*").alias("size"), F.min("set").alias("low")).where(F.col("size") > COMPARED)
    known = members.join(sizes, "block", "left").join(named, "set").withColumnRenamed("rep", "doc_id")
    passing = known.where("size is not null").select("block", (F.col("set") == F.col("low")).alias("first"), "doc_id", "n")
    divided = viable(known.where("size is null"), num, den)
    members = written(divided.unionByName(passing), "block-members")
    counts = members.groupBy("block").agg(chunks(F.col("n")).alias("chunks"))
    return written(members.drop("n").join(counts, "block"), "blocks")


def chunks(n: Column) -> Column:
    """Aggregate: the number of chunks of sets of n shingles."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(n) / LOAD)).cast("int")


def in_chunks(members: DataFrame) -> DataFrame:
    """Members as search() takes them: each in its own chunk, a block's first in all of them."""
    own = F.pmod(F.xxhash64("doc_id"), "chunks").cast("int")
    at = F.when(F.col("first"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    return members.select("block", F.explode(at).alias("chunk"), F.lit(0).alias("other"), F.lit(True).alias("asks"), "doc_id")


def unfinished(members: DataFrame, links: DataFrame) -> DataFrame | None:
    """(block, doc_id, chunks, label, apart) of the blocks of several chunks in which sets are apart from the first; None if there are none."""
    large = members.where("chunks > 1")
    if large.isEmpty():
        return None
    comps = components(links)
    labelled = large.join(comps, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")
    firsts = labelled.where("first").groupBy("block").agg(F.min("label").alias("first_label"))
    labelled = written(labelled.join(firsts, "block").withColumn("apart", F.col("label") != F.col("first_label")).drop("first_label", "first"), "large-blocks")
    left = labelled.where("apart").select("block").distinct()
    return None if left.isEmpty() else labelled.join(left, "block", "left_semi")


def parts(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(part, set, doc_id, label) of docs (doc_id, label, text): what each set holds of every range of hashes.

    A set is at its own level of sizes and at those that larger sets it can link with are at; the
    number of ranges is one more than what linked sets of that level can differ by.
    """
    import pyarrow as pa

    def of_set(s: np.ndarray):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s ^ ODD[0]))])
        low, high = (math.floor(math.log(x) / math.log(BAND)) for x in (len(s), len(s) * den / num * (1 + 1e-9)))
        for band in range(low, high + 1):
            ranges = 2 * math.ceil(BAND ** (band + 1)) * (den - num) // (den + num) + 1
            of = (s >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            held = np.diff(sums[np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))])
            yield mixed(held + mixed(np.arange(ranges, dtype=np.uint64) + np.uint64(band << 32) + ODD[1])).view(np.int64)

    def run(batches):
        free_worker()
        shingler = Shingler(n)
        for batch in batches:
            out, load = [], 0
            for doc_id, label, text in zip(*(batch.column(i) for i in range(3))):
                s = shingler(text.as_py())
                if not len(s):
                    continue
                for named in of_set(s):
                    out.append((named, *(np.full(len(named), x, np.int64) for x in (key64(digest(s)), doc_id.as_py(), label.as_py()))))
                    load += len(named)
                if load > PART:
                    yield batch_of(out)
                    out, load = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["part", "set", "doc_id", "label"])

    return docs.select("doc_id", "label", "text").mapInArrow(run, "part long, set long, doc_id long, label long")


def texts_of(ids: DataFrame, of_text: DataFrame) -> DataFrame:
    """Ids, distinct, with their texts: up to ``FEW`` of them go to the texts, beyond that both are sorted."""
    if ids.count() <= FEW:
        return of_text.join(F.broadcast(ids), "doc_id")
    return of_text.hint("merge").join(ids, "doc_id")


def by_parts(members: DataFrame, links: DataFrame, named: DataFrame, of_text: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The links, with those of large blocks' sets that chunks did not connect to the block's first set."""
    left = unfinished(members, links)
    if left is None:
        return links
    # the texts of those blocks are written once, so that the searches below shuffle no others
    sets = written(texts_of(written(left.select("doc_id", "label").distinct(), "large-ids"), of_text), "large-texts")
    of_large = sets.select("doc_id", "text")
    held = written(parts(sets, n, num, den), "parts")
    groups = held.groupBy("part").agg(F.min("set").alias("low"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    again = held.select("part", "set").join(groups.select("part", F.xxhash64("low").alias("block")), "part").select("block", "set").distinct()
    again = blocks(again, named, num, den)
    links = written(search(in_chunks(again).join(of_large.hint("merge"), "doc_id"), n, num, den).unionByName(links), "links")
    left = unfinished(again, links)
    if left is None:
        return links
    # each set that is apart asks all chunks of its block; every set is found in as many copies as there are chunks of those
    left = left.join(named.select(F.col("rep").alias("doc_id"), "n"), "doc_id")
    left = left.join(left.where("apart").groupBy("block").agg(chunks(F.col("n")).alias("others")), "block")
    own = F.pmod(F.xxhash64("doc_id"), "chunks").cast("int")
    found = left.select("block", own.alias("chunk"), F.explode(F.sequence(F.lit(1), F.col("others"))).alias("other"), F.lit(False).alias("asks"), "doc_id")
    asking = (F.pmod(F.xxhash64("doc_id", F.lit(1)), "others") + 1).cast("int")
    asked = left.where("apart").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), asking.alias("other"), F.lit(True).alias("asks"), "doc_id")
    return written(search(found.unionByName(asked).join(of_large.hint("merge"), "doc_id"), n, num, den).unionByName(links), "links")
