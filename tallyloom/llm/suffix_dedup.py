"""Removal of repeated byte strings, by a sampled suffix array sorted deep-shallow.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed.

1. Suffixes are sampled by content: a window of ``length`` bytes contains w = length - GRAM + 1
   grams, and the gram of the smallest hash is its anchor. Equal windows have their anchor at
   the same offset, so any two equal windows meet at an anchor; about 2 of w positions are one.
2. Anchors that occur once are dropped by a counting pass. So are those of which all that any
   window at them can hold is the same everywhere: they are repeats already.
3. The suffixes at the remaining anchors are sorted within their group (equal gram): multikey
   quicksort on 8-byte characters to a shallow depth, then blind tries for groups whose common
   prefix is longer. Along the sorted suffixes the running minimum of the common prefixes is
   how far two occurrences agree to the right; the common part to the left is compared. Where
   both add up to ``length``, the bytes between are a repeat.
4. Large groups are divided by the bytes that a range of window offsets has in common, first
   by Spark (over ``GROUP`` suffixes), then in the task; so no task gets an unbounded group.
5. Texts that occur several times are removed whole if they hold a window, and are searched
   once.

Identities of texts, grams and contexts are 64-bit hashes.

Defined results: a null text is empty; a text under ``length`` bytes keeps everything and
nothing in it is a repeat; an empty table gives an empty result; repeated rows are copies of
each other; rows of one doc_id and different texts are different documents; a kept sequence
may end within a character, as bytes are removed; very long texts are hashed in
segments; only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, width, written
from tallyloom.llm.ngram_join import ODD, mixed

GRAM = 32
#: Suffixes of a group handled in one task; suffixes compared pair by pair; bytes sorted by quicksort; bytes hashed at a time.
GROUP, PAIRS, SHALLOW, SEGMENT = 50_000, 48, 64, 1 << 20


# ---- sampling ---------------------------------------------------------------------------


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position, as one integer."""
    return np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))


def sampled(texts: list[bytes], length: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text of at least length bytes: (place, positions, gram hashes, context hashes, whether a context is whole)."""
    w, out = length - GRAM + 1, []
    at = [i for i, t in enumerate(texts) if len(t) >= length]
    start = 0
    while start < len(at):
        stop, size = start, 0
        while stop < len(at) and (size == 0 or size + len(texts[at[stop]]) <= SEGMENT):
            size += len(texts[at[stop]])
            stop += 1
        part = at[start:stop]
        start = stop
        ends = np.cumsum([len(texts[i]) for i in part])
        begins = ends - [len(texts[i]) for i in part]
        raw = np.frombuffer(b"".join([texts[i] for i in part]), np.uint8)
        x = words_at(raw)
        h = np.zeros(len(raw) - GRAM + 1, np.uint64)
        for k in range(0, GRAM, 8):
            h = mixed(h + x[k : k + len(h)] * ODD[k // 8])
        h |= np.uint64(1)
        low = sliding(h, w, np.minimum)  # of the window that starts at each position
        for e in ends[:-1]:
            low[e - length + 1 : e] = 0  # windows across two texts
        # a gram is an anchor if it is the smallest of any window with it
        padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
        chosen = np.flatnonzero(sliding(padded, w, np.maximum) == h)
        text_of = np.searchsorted(ends, chosen, side="right")
        left, right = chosen - (w - 1), chosen + length
        whole = (left >= begins[text_of]) & (right <= ends[text_of])
        ctx = np.zeros(len(chosen), np.uint64)
        inside = left[whole]
        c = np.zeros(len(inside), np.uint64)
        span = w - 1 + length
        for k in [*range(0, span - 8, 8), span - 8]:
            c = mixed(c + x[inside + k])
        ctx[whole] = c
        cut = np.searchsorted(text_of, np.arange(len(part) + 1))
        for i, a, b, first in zip(part, cut, cut[1:], begins):
            out.append((i, chosen[a:b] - first, h[chosen[a:b]], ctx[a:b], whole[a:b]))
    return out


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """(gram, ctx, key, pos, stop) of every anchor of every distinct text; ctx is null at a text's borders.

    Anchors that a text repeats with the same context are given once; their repeats are given
    as an interval (gram null, pos to stop).
    """
    import pyarrow as pa

    names = ["gram", "ctx", "key", "pos", "stop"]
    w = length - GRAM + 1

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                keys, raws = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    if key not in seen:  # a task gives equal texts once
                        seen.add(key)
                        keys.append(key)
                        raws.append(text.as_py() or b"")
                cols: list[list] = [[], [], [], [], []]
                for i, pos, gram, ctx, whole in sampled(raws, length):
                    keep = np.ones(len(pos), bool)
                    same, inverse, n = np.unique(np.where(whole, ctx, np.arange(len(pos), dtype=np.uint64)), return_inverse=True, return_counts=True)
                    again = whole & (n[inverse] > 1)
                    if again.any():
                        order = np.flatnonzero(again)
                        first = np.zeros(len(pos), bool)
                        first[order[np.unique(inverse[order], return_index=True)[1]]] = True
                        keep = ~again | first
                        runs = merged(pos[order] - (w - 1), pos[order] + length)
                        for a, b in runs:
                            cols[0].append(None), cols[1].append(None), cols[2].append(keys[i]), cols[3].append(a), cols[4].append(b)
                    kept = np.flatnonzero(keep)
                    cols[0] += gram[kept].view(np.int64).tolist()
                    cols[1] += [c if ok else None for c, ok in zip(ctx[kept].view(np.int64).tolist(), whole[kept].tolist())]
                    cols[2] += [keys[i]] * len(kept)
                    cols[3] += pos[kept].tolist()
                    cols[4] += [None] * len(kept)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return texts.select("key", F.col("text").cast("binary")).mapInArrow(run, "gram long, ctx long, key long, pos int, stop int")


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals as maximal runs; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([fresh[1:], [True]])
    return list(zip(starts[fresh].tolist(), reach[last].tolist()))


# ---- deep-shallow sorting ---------------------------------------------------------------


def common(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix; low bytes are known to agree."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def deep_shallow(strings: list[bytes], known: int) -> tuple[list[int], list[int]]:
    """Order of the strings, and each one's common prefix with the one before it. known bytes agree."""
    order: list[int] = []
    prefix: list[int] = []

    def emit(i: int) -> None:
        prefix.append(common(strings[order[-1]], strings[i], known) if order else 0)
        order.append(i)

    stack = [(list(range(len(strings))), known)]
    while stack:
        items, depth = stack.pop()
        if len(items) == 1:
            emit(items[0])
        elif depth >= known + SHALLOW:
            for i in blind_trie([strings[i] for i in items], depth):
                emit(items[i])
        else:
            # a character is 8 bytes and how many of them the string has
            chars = [(strings[i][depth : depth + 8], len(strings[i]) - depth if len(strings[i]) - depth < 8 else 8) for i in items]
            pivot = sorted((chars[0], chars[len(chars) // 2], chars[-1]))[1]
            less, more = [i for i, c in zip(items, chars) if c < pivot], [i for i, c in zip(items, chars) if c > pivot]
            equal = [i for i, c in zip(items, chars) if c == pivot]
            if more:
                stack.append((more, depth))
            stack.append((equal, depth + 8 if pivot[1] == 8 else known + SHALLOW))
            if less:
                stack.append((less, depth))
    return order, prefix


def blind_trie(strings: list[bytes], depth: int) -> list[int]:
    """Order of strings that agree up to depth: a trie that keeps only where strings part."""
    # a leaf is a list of equal strings' places; a node is (position, {byte or -1 at the end: child})
    root: list | tuple = [0]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, tuple):
            at, children = node
            node = children.get(s[at] if at < len(s) else -1) or next(iter(children.values()))
        t = strings[node[0]]
        n = common(s, t, min(depth, len(s), len(t)))
        if n == len(s) == len(t):
            node.append(i)
            continue
        above, byte, node = None, None, root
        while isinstance(node, tuple) and node[0] < n:
            above, byte = node, s[node[0]]
            node = node[1][byte]
        mine = s[n] if n < len(s) else -1
        if isinstance(node, tuple) and node[0] == n:
            node[1][mine] = [i]
            continue
        fork = (n, {t[n] if n < len(t) else -1: node, mine: [i]})
        if above is None:
            root = fork
        else:
            above[1][byte] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


# ---- groups -----------------------------------------------------------------------------


class Group:
    """Occurrences of one gram: which offsets of windows before the anchor are repeats.

    Of every occurrence only the smallest and largest such offset matter, as all its windows
    share the anchor and so cover one run of bytes.
    """

    def __init__(self, left: list[bytes], right: list[bytes], length: int):
        self.back, self.right, self.length = [x[::-1] for x in left], right, length
        self.whole = [a + b for a, b in zip(left, right)]
        self.low = [length] * len(left)
        self.high = [-1] * len(left)

    def found(self, i: int, low: int, high: int) -> None:
        self.low[i], self.high[i] = min(self.low[i], low), max(self.high[i], high)

    def search(self, members: list[int], a: int, b: int) -> None:
        """Repeats among members at the offsets a to b."""
        length = self.length
        members = [i for i in members if len(self.back[i]) >= a and len(self.right[i]) >= length - b]
        if len(members) < 2:
            return
        if a == b:
            for i in members:  # they share the whole window
                self.found(i, a, a)
        elif len(members) <= PAIRS:
            self.pairs(members, a, b)
        else:
            mid = (a + b) // 2
            for x, y in ((a, mid), (mid + 1, b)):
                parts: dict[bytes, list[int]] = {}
                for i in members:
                    n = len(self.back[i])
                    if n >= x and len(self.right[i]) >= length - y:
                        parts.setdefault(self.whole[i][n - x : n + length - y], []).append(i)
                for part in parts.values():
                    self.search(part, x, y)

    def pairs(self, members: list[int], a: int, b: int) -> None:
        order, prefix = deep_shallow([self.right[i] for i in members], min(GRAM, self.length - b))
        for k, one in enumerate(order):
            i, reach = members[one], self.length
            for n in range(k + 1, len(order)):
                reach = min(reach, prefix[n])
                j = members[order[n]]
                first = max(a, self.length - reach)
                if first > b:
                    break
                if self.low[i] <= first and self.low[j] <= first and self.high[i] >= min(b, len(self.back[i])) and self.high[j] >= min(b, len(self.back[j])):
                    continue
                last = min(b, common(self.back[i], self.back[j]))
                if first <= last:
                    self.found(i, first, last)
                    self.found(j, first, last)


def repeats(members: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, start, stop) of the repeats among members (node, first, last, doc_id, key, pos, left, right)."""
    import pyarrow as pa

    names = ["doc_id", "key", "start", "stop"]

    def solve(rows: list[tuple], out: list[tuple]) -> None:
        if len(rows) < 2:
            return
        group = Group([r[4] for r in rows], [r[5] for r in rows], length)
        group.search(list(range(len(rows))), rows[0][0][1], rows[0][0][2])
        for r, low, high in zip(rows, group.low, group.high):
            if high >= 0:
                out.append((r[1], r[2], r[3] - high, r[3] - low + length))

    def batch_of(out: list[tuple]):
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=names)

    def run(batches):
        name, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for node, first, last, doc_id, key, pos, left, right in zip(*cols):
                if (node, first, last) != name:
                    solve(rows, out)
                    name, rows = (node, first, last), []
                if not rows or rows[-1][1:4] != (doc_id, key, pos):
                    rows.append((name, doc_id, key, pos, left, right))
            yield batch_of(out)
        out = []
        solve(rows, out)
        yield batch_of(out)

    keys = ["node", "first", "last"]
    # dealt by a hash of the keys: where a join has shuffled by the keys themselves Spark leaves out a repartition by
    # them, and as it knows of no need for the groups here, it may read that shuffle map by map, which tears them
    dealt = members.select(*keys, "doc_id", "key", "pos", "left", "right").repartition(width(members.sparkSession), F.xxhash64(*keys)).sortWithinPartitions(*keys, "key", "pos", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, key long, start int, stop int")


def divided(members: DataFrame, length: int) -> list[DataFrame]:
    """Repeats of all groups; those over GROUP suffixes are divided by shared bytes until they are smaller."""
    found = []
    while True:
        sizes = members.groupBy("node", "first", "last").agg(F.count("*").alias("size"))
        sizes = written(sizes.where("size > 1"), "suffix-groups")
        large = sizes.where(F.col("size") > GROUP)
        if large.isEmpty():
            found.append(written(repeats(members, length), "repeats"))
            return found
        keys = ["node", "first", "last"]
        large = F.broadcast(large.select(*keys))  # at most a row for every GROUP members
        found.append(written(repeats(members.join(large, keys, "left_anti"), length), "repeats"))
        hot = members.join(large, keys, "left_semi")
        leaf = hot.where("first = last")
        found.append(written(leaf.select("doc_id", "key", (F.col("pos") - F.col("last")).alias("start"), (F.col("pos") - F.col("first") + length).alias("stop")), "repeats"))
        mid = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("first").alias("x"), mid.alias("y")), F.struct((mid + 1).alias("x"), F.col("last").alias("y")))).alias("half")
        split = hot.where("first < last").select("node", "doc_id", "key", "pos", "left", "right", halves)
        x, y, n = F.col("half.x"), F.col("half.y"), F.octet_length("left")
        split = split.where((n >= x) & (F.octet_length("right") >= length - y))
        core = F.concat(F.substring("left", n - x + 1, x), F.substring("right", F.lit(1), F.lit(length) - y))
        members = written(split.select(F.xxhash64("node", x, core).alias("node"), x.alias("first"), y.alias("last"), "doc_id", "key", "pos", "left", "right"), "suffix-halves")


# ---- the operator -----------------------------------------------------------------------


def joined_by_text(texts: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """texts with other's columns, by doc_id and key; a null doc_id is one like any other."""
    other = other.withColumnsRenamed({"doc_id": "_doc", "key": "_key"})
    return texts.join(other, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")), how).drop("_doc", "_key")


def contexts(members: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Members (gram, doc_id, key, pos) with the bytes that windows at them can hold on each side."""
    import pyarrow as pa

    w = length - GRAM + 1
    by_text = members.groupBy("doc_id", "key").agg(F.collect_list(F.struct("gram", "pos")).alias("marks"))  # at most a text's anchors

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = []
                for doc_id, key, text, marks in zip(*(part.column(i).to_pylist() for i in range(4))):
                    for m in marks:
                        p = m["pos"]
                        rows.append((m["gram"], 0, w - 1, doc_id, key, p, text[max(0, p - w + 1) : p], text[p : p + length]))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["node", "first", "last", "doc_id", "key", "pos", "left", "right"])

    joined = joined_by_text(texts, by_text, "inner").select("doc_id", "key", F.col("text").cast("binary"), "marks")
    return joined.mapInArrow(run, "node long, first int, last int, doc_id long, key long, pos int, left binary, right binary")


def cut_out(texts: DataFrame, intervals: DataFrame) -> DataFrame:
    """Digests of the texts without the intervals (doc_id, key, start, stop)."""
    import pyarrow as pa

    per = intervals.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # at most a text's anchors
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py() or b""
                spans = batch.column(2)[i].as_py()
                runs = merged(np.array([s["start"] for s in spans]), np.array([s["stop"] for s in spans])) if spans else []
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], names=names)

    joined = joined_by_text(texts, per, "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    texts = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.xxhash64("text"))
    ids = written(texts.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes")), "text-keys")
    classes = ids.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"))
    copied = classes.where((F.col("copies") > 1) & (F.col("n_bytes") >= length))

    marks = anchors(texts.where(F.octet_length("text") >= length), length)
    occurrence = F.xxhash64("key", "pos")
    grams = marks.where("gram is not null").groupBy("gram").agg(F.min(occurrence).alias("one"), F.max(occurrence).alias("other"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2"), F.max(F.col("ctx").isNull()).alias("border"))
    # a gram that occurs again; alike: with one and the same whole context everywhere
    grams = written(grams.where("one < other").select("gram", ((F.col("c1") == F.col("c2")) & ~F.col("border")).alias("alike")), "repeated-grams")
    # in one pass of the texts: occurrences of such grams, and the intervals (which join with nothing)
    marked = marks.withColumn("at", F.coalesce("gram", occurrence)).join(grams.withColumnRenamed("gram", "at"), "at", "left")
    hits = written(marked.where("gram is null or alike is not null").select("gram", "ctx", "key", "pos", "stop", "alike"), "suffix-hits")

    w = length - GRAM + 1
    full = [(F.col("pos") - (w - 1)).alias("start"), (F.col("pos") + length).alias("stop")]
    within = hits.where("gram is null").select("key", F.col("pos").alias("start"), "stop")
    alike = hits.where("gram is not null and alike").select("key", *full)
    mixed_ = hits.where("gram is not null and not alike")
    by_context = mixed_.where("ctx is not null").groupBy("gram", "ctx").agg(F.min(occurrence).alias("one"), F.max(occurrence).alias("other"))
    known = mixed_.join(by_context, ["gram", "ctx"], "left")
    same = known.where("one < other").select("key", *full)
    # of occurrences with the same whole context one stands for all
    asked = known.where("one is null or one = other or " + "one = xxhash64(key, pos)").select("gram", "key", "pos").distinct()

    named = asked.join(classes.select("key", F.col("rep").alias("doc_id")), "key")
    found = divided(written(contexts(named, texts, length), "suffix-contexts"), length)

    single = classes.where("copies = 1").select("key", F.col("rep").alias("doc_id"))
    intervals = written(within.unionByName(alike).unionByName(same).join(single, "key").select("doc_id", "key", "start", "stop"), "repeats")
    for f in found:
        intervals = intervals.unionByName(f)
    gone = ids.join(copied.select("key"), "key", "left_semi")
    nothing = hashlib.sha256(b"").hexdigest()
    gone = gone.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"))
    rest = texts.join(copied.select("key"), "key", "left_anti")
    return cut_out(rest, intervals).unionByName(gone)
