"""Runs of repeated words in whole texts, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a maximal stretch of words with a smallest period q and at least two periods' length. The
steps, each taken for all positions at once with arrays, over texts joined by separators that occur once:

1. Suffix tree, held as suffix array and lengths of common prefixes of neighbours: a node is an interval.
   Names of all stretches of 2^j words answer how far two positions agree, forward and backward.
2. LZ blocks: each is the longest stretch that also begins earlier. A leftmost occurrence of a square has
   its centre in a block and touches that block's start or end, so extending from the block's borders by every
   possible half length gives squares that cover the leftmost occurrence of every kind of square.
   Only primitive ones are kept, whose half is no power: others lie in runs of a smaller period.
3. Suffix-link walks: dropping a square's first word and adding it at the end is a step along a suffix link
   and an edge. As covering squares come first in their stretch, the j-th step is the square j words on, so a walk
   is a range of positions; the node each comes to marks its kind, once for all walks.
4. A marked node's interval lists all occurrences of its kind. Occurrences of one half length that are
   neighbours merge into a run.

Step 1 sorts names by doubling (a sort for each doubling of the longest repeat) instead of building the tree in
linear time; the other steps take time linear in words and occurrences but for a factor log n for extensions. Short texts
share one suffix array up to ``GROUP`` words; a longer text has its own.

Defined results: a null, empty or blank text has no words and no run; texts of any length are searched whole; a
null id (like any) keeps its row, and its words are never replaced by the planting rule; repeated rows are treated each; of runs with
equal exponents the first start, then the smaller period is told; an empty table gives an empty result; only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tallyloom.llm.common import WORD, id_and_text

#: Words of short texts that are searched together.
GROUP = 1 << 16


class Stretches:
    """Names of all stretches of 2^j symbols: equal stretches have equal names, in order of the stretches."""

    def __init__(self, t: np.ndarray):
        n = self.n = len(t)
        self.names = [np.unique(t, return_inverse=True)[1].astype(np.int32)]
        while n and (last := self.names[-1]).max() < n - 1:
            step = 1 << (len(self.names) - 1)
            key = last.astype(np.int64) * (n + 1)
            key[: n - step] += last[step:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            name = np.zeros(n, dtype=np.int32)
            name[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
            self.names.append(name)
        self.rank = self.names[-1]
        self.suffixes = np.empty(n, dtype=np.int64)
        self.suffixes[self.rank] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and j on agree (i differs from j)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for level in range(len(self.names) - 1, -1, -1):
            name = np.append(self.names[level], (-1, -2))  # places beyond the end differ
            same = (name[np.minimum(i, self.n)] == name[np.where(j < self.n, j, self.n + 1)]).astype(np.int64) << level
            i += same
            j += same
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and j, both included, agree (i differs from j; -1: none)."""
        i, j = i + 1, j + 1
        start = i.copy()
        for level in range(len(self.names) - 1, -1, -1):
            name, step = self.names[level], 1 << level
            inside = np.minimum(i, j) >= step
            same = (inside & (name[np.where(inside, i - step, 0)] == name[np.where(inside, j - step, 0)])).astype(np.int64) << level
            i -= same
            j -= same
        return start - i


class Minima:
    """Nearest place, from one on, whose value is below a bound."""

    def __init__(self, values: np.ndarray):
        self.n, self.least = len(values), [values]
        while 2 << (len(self.least) - 1) <= self.n:
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        at = at.copy()
        for level in range(len(self.least) - 1, -1, -1):
            first = at - (1 << level) + 1
            at -= ((first >= 0) & (self.least[level][np.maximum(first, 0)] >= bound)).astype(np.int64) << level
        return at

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The number of values where there is none."""
        at = at.copy()
        for level in range(len(self.least) - 1, -1, -1):
            held = self.least[level]
            at += ((at < len(held)) & (held[np.minimum(at, len(held) - 1)] >= bound)).astype(np.int64) << level
        return at


def ranges(first: np.ndarray, number: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., number of each, one after another."""
    ends = np.cumsum(number)
    return np.repeat(first - (ends - number), number) + np.arange(ends[-1] if len(ends) else 0)


def block_starts(s: Stretches) -> np.ndarray:
    """Starts of the LZ blocks: the longest earlier stretch begins at the nearest smaller place on either side in the suffix array."""
    n, place = s.n, np.arange(s.n)
    least = Minima(s.suffixes)
    longest = np.zeros(n, dtype=np.int64)
    for near in (least.left(place - 1, s.suffixes), least.right(place + 1, s.suffixes)):
        at = np.flatnonzero((near >= 0) & (near < n))
        here = s.suffixes[at]
        longest[here] = np.maximum(longest[here], s.forward(here, s.suffixes[near[at]]))
    steps, starts, i = np.maximum(longest, 1).tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    return np.array(starts, dtype=np.int64)


def covering_squares(t: np.ndarray, s: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of squares that cover the leftmost occurrence of every kind of square."""
    n, starts = s.n, block_starts(s)
    ends = np.append(starts[1:], n)
    size = ends - starts
    after = np.append(size[1:], 0)
    # centre in the block, second half over its end
    q, end = np.arange(n), np.repeat(ends, size)
    at = np.flatnonzero(end < n)
    at = at[t[end[at]] == t[at]]
    q, end = q[at], end[at]
    half = end - q
    ahead, behind = s.forward(end, q), s.backward(end - 1, q - 1)
    found = ahead + behind >= half
    first = [np.maximum(q - behind, q - half + 1)[found]]
    halves = [half[found]]
    # centre in the block, first half over its start
    half = ranges(np.ones(len(starts), dtype=np.int64), size + after)
    start = np.repeat(starts, size + after)
    q = start + half
    at = np.flatnonzero(q < n)
    at = at[t[q[at]] == t[start[at]]]
    q, start, half = q[at], start[at], half[at]
    ahead, behind = s.forward(start, q), s.backward(start - 1, q - 1)
    found = ahead + behind >= half
    first.append(np.maximum(start - behind, start - half + 1)[found])
    halves.append(half[found])
    pairs = np.unique(np.concatenate(halves) * (n + 1) + np.concatenate(first))
    return pairs % (n + 1), pairs // (n + 1)


def primitive(s: Stretches, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power of a shorter stretch."""
    most = int(half.max(initial=1))
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    ok, rest = np.ones(len(start), dtype=bool), half.copy()
    while (at := np.flatnonzero(rest > 1)).size:
        p = factor[rest[at]]
        period = half[at] // p
        ok[at] &= s.forward(start[at], start[at] + period) < 2 * half[at] - period
        rest[at] //= p
    return ok


def all_runs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of the symbols, by period and start."""
    none = np.zeros(0, dtype=np.int64)
    if len(t) < 2:
        return none, none, none
    s = Stretches(t)
    n = s.n
    start, half = covering_squares(t, s)
    keep = primitive(s, start, half)
    start, half = start[keep], half[keep]
    # walks: as far as the square can be turned in place, once around at most
    turns = np.minimum(s.forward(start, start + half) - half, half - 1) + 1
    at, half = ranges(start, turns), np.repeat(half, turns)
    prefixes = np.zeros(n, dtype=np.int64)
    prefixes[1:] = s.forward(s.suffixes[:-1], s.suffixes[1:])
    prefixes[0] = -1
    nodes, place = Minima(prefixes), s.rank[at].astype(np.int64)
    left, right = nodes.left(place, 2 * half), nodes.right(place + 1, 2 * half)
    kinds, one = np.unique(half * (n + 1) + left, return_index=True)
    left, right, half = left[one], right[one], half[one]
    # occurrences of each kind, merged where they are neighbours
    where = np.sort(np.repeat(half, right - left) * (n + 1) + s.suffixes[ranges(left, right - left)])
    if not len(where):
        return none, none, none
    new = np.flatnonzero(np.append(True, where[1:] != where[:-1] + 1))
    first, last = where[new], where[np.append(new[1:], len(where)) - 1]
    period = first // (n + 1)
    return first % (n + 1), last - first + 2 * period, period


def planted_words(words: list[str], doc_id: int | None) -> list[str]:
    """Words of one text, every tenth id's (by checksum) made periodic from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def grouped(texts):
    """Lists of (index, words) of about ``GROUP`` words at most, or of one longer text."""
    group, total = [], 0
    for i, words in texts:
        if group and total + len(words) > GROUP:
            yield group
            group, total = [], 0
        group.append((i, words))
        total += len(words)
    if group:
        yield group


def runs_of_texts(group: list[tuple[int, list[str]]], least: int, exponent: int):
    """(index, words, runs) of each text; runs are (start, length, period) by start, then period."""
    ids: dict[str, int] = {}
    symbols, begins = [], []
    for i, (_, words) in enumerate(group):
        begins.append(len(symbols))
        symbols.extend([ids.setdefault(w, len(ids)) for w in words])
        symbols.append(-1 - i)
    start, length, period = all_runs(np.array(symbols, dtype=np.int64))
    keep = (length >= least) & (length >= exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    text = np.searchsorted(begins, start, side="right") - 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    for x, b, size, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
        found.setdefault(x, []).append((b - begins[x], size, q))
    for x, (i, words) in enumerate(group):
        yield i, words, sorted(found.get(x, []), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; runs come by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def runs(docs: DataFrame, least: int = 24, exponent: int = 3, planted: bool = False, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of at least ``least`` words and ``exponent`` periods of every text: number, strongest one, digests (and with keep the runs and the collapsed text).

    With planted, some texts are made periodic first, which gives runs whose place is known beforehand.
    """
    import pyarrow as pa

    found = re.compile(WORD)
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows = [None] * batch.num_rows

            def texts():
                for i, text in enumerate(batch.column(1)):
                    words = found.findall(text.as_py() or "")
                    yield i, planted_words(words, doc_ids[i]) if planted else words

            for group in grouped(texts()):
                for i, words, all_ in runs_of_texts(group, least, exponent):
                    best, rest = strongest(all_), " ".join(collapsed(words, all_))
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in all_)
                    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    rows[i] = (len(all_), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())
                    if keep:
                        rows[i] += ([dict(zip(("start", "length", "period"), r)) for r in all_], rest)
            columns = list(zip(*rows)) if rows else [()] * (9 if keep else 7)
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [run_type, pa.string()] * keep
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + ["runs", "collapsed"] * keep
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)], names=names)

    if keep:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return id_and_text(docs, id_col, text_col).mapInArrow(search, schema)
