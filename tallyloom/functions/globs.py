"""Many globs against many texts: by keys of their literal parts, and by a trie of what has none.

Globs of more than ``FEW_BYTES`` are told apart by shape: which segments of a path (or which beginning and end) they
give as letters. A text has at most one key a shape, so texts meet the globs of their keys by a join that Spark deals
out, in time that grows with texts and globs but not with their product, and a regular expression decides. Globs
without letters at either end of what they hold, of rare shapes, of more than ``LOOPS`` stars, or of which over
``CROWD`` have the same key go to the trie, as all do where they are few.

The trie is walked as a nondeterministic automaton in Arrow batches. A node is a place in a pattern; patterns with a common beginning share nodes. Reading a letter leads from a set of
places to another one, and sets met before are remembered, so a text costs about one look-up a letter.
Patterns are split by hash into parts of at most ``PART_BYTES``, as many as their counted size needs, each a
broadcast of its own: there is no bound on their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import stored

#: Bytes of the patterns of one trie; sets of places that a trie remembers.
PART_BYTES, REMEMBERED = 8 << 20, 200_000
#: Bytes of patterns that a trie takes whatever they are; shapes that have keys, the largest first; letters of a key's part.
FEW_BYTES, SHAPES, LETTERS = 1 << 16, 64, 16
#: Stars of a pattern that a regular expression decides on; different patterns that one key leads to.
LOOPS, CROWD = 2, 64
#: Slots of a part's values by their hash, by which texts are left out before the join.
SLOTS = 256
#: What a regular expression takes for other than itself.
SIGNS = frozenset("\\^$.|?*+()[]{}")


def tokens(glob: str, segments: bool) -> Iterator[tuple[str, str]]:
    """(kind, letters) of a pattern: letter, one, star, and with segments deep and folders."""
    i = 0
    while i < len(glob):
        kind, n = "letter", 1
        if segments and glob.startswith("**/", i):
            kind, n = "folders", 3
        elif segments and glob.startswith("**", i):
            kind, n = "deep", 2
        elif glob[i] in "*?":
            kind = "star" if glob[i] == "*" else "one"
        yield kind, glob[i : i + n]
        i += n


def regex(found: list[tuple[str, str]], segments: bool) -> str:
    """Java's regular expression of a whole text."""
    of = {"one": "[^/]" if segments else ".", "star": "[^/]*" if segments else ".*", "deep": ".*", "folders": "(?:.*/)?"}
    return r"(?s)\A" + "".join(("\\" + c if c in SIGNS else c) if kind == "letter" else of[kind] for kind, c in found) + r"\z"


def outline(glob: str, segments: bool) -> tuple[str, list[str], str] | None:
    """Shape, values of its parts and regular expression of a pattern; None where a trie has to search it.

    A shape is `n` and the number of segments where that is fixed, and its parts: `f` or `b` and the place of a segment
    from the front or the back, then `w` (it is the value), `p` or `s` and a number of letters (it begins or ends
    with the value) or `l` and a number (its length, without a value).
    """
    found = list(tokens(glob, segments))
    if sum(kind in ("star", "deep", "folders") for kind, _ in found) > LOOPS:
        return None
    wide = [i for i, (kind, _) in enumerate(found) if kind in ("deep", "folders")]

    def cut(some: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
        out = [[]]
        for token in some:
            if segments and token[1] == "/":
                out.append([])
            else:
                out[-1].append(token)
        return out

    if wide:
        last = wide[-1]
        begins = found[last][0] == "folders" and (last == 0 or found[last - 1][1] == "/")
        front, back = cut(found[: wide[0]]), cut(found[last + 1 :])
        held = [(f"f{i}", x, True, i < len(front) - 1) for i, x in enumerate(front)]
        held += [(f"b{len(back) - i}", x, i > 0 or begins, True) for i, x in enumerate(back)]
        shape = []
    else:
        held = [(f"f{i}", x, True, True) for i, x in enumerate(cut(found))]
        shape = [f"n{len(held)}"]
    values = []
    for place, x, opens, closes in held:
        letters = [c if kind == "letter" else None for kind, c in x]
        if opens and closes and None not in letters:
            shape.append(f"{place}w")
            values.append("".join(letters))
            continue
        if opens and closes and all(kind != "star" for kind, _ in x):
            shape.append(f"{place}l{len(x)}")
        for side, ordered in (("p", letters if opens else []), ("s", letters[::-1] if closes else [])):
            n = min(LETTERS, ordered.index(None) if None in ordered else len(ordered))
            if n:
                shape.append(f"{place}{side}{n}")
                values.append("".join(ordered[:n] if side == "p" else ordered[:n][::-1]))
    return (" ".join(shape), values, regex(found, segments)) if values else None


def keys_of(shape: str, parts: Column, slots: dict[int, list[int]]) -> Column:
    """The key that a text of these segments has in a shape, null where it has none or no pattern can have it."""
    fits, values = [], []  # what must hold, with the share of texts that it may hold for
    for part in shape.split(" "):
        if part[0] == "n":
            fits.append((0.3, F.size(parts) == int(part[1:])))
            continue
        place, kind, n = re.fullmatch(r"([fb]\d+)([wpsl])(\d*)", part).groups()
        segment = F.get(parts, F.lit(int(place[1:])) if place[0] == "f" else F.size(parts) - int(place[1:]))
        if kind == "l":
            fits.append((0.2, F.length(segment) == int(n)))
            continue
        value = segment if kind == "w" else F.left(segment, F.lit(int(n))) if kind == "p" else F.right(segment, F.lit(int(n)))
        some = slots.get(len(values), [])
        fits.append((len(some) / SLOTS, slot(value).isin(some) & value.isNotNull()) if len(some) < SLOTS // 2 else (1, value.isNotNull()))
        values.append(value)
    return F.when(reduce(and_, [x for _, x in sorted(fits, key=lambda f: f[0])]), key(F.lit(shape), F.concat_ws("/", *values)))


def key(shape: Column, values: Column) -> Column:
    return F.xxhash64(shape, values)


def slot(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SLOTS))


class Node:
    __slots__ = ("letters", "one", "star", "deep", "folders", "loop", "gate", "lines", "number")

    def __init__(self, number: int, loop: str = "", gate: bool = False):
        self.letters: dict[str, Node] = {}
        self.one = self.star = self.deep = self.folders = None
        self.loop, self.gate, self.lines, self.number = loop, gate, [], number


class GlobTrie:
    """Patterns with `*` and `?`; with segments these stay within a path segment, `**` does not and `**/` is any folders or none."""

    def __init__(self, patterns: list[tuple[str, int]], segments: bool = False):
        self.patterns, self.segments = patterns, segments

    def __getstate__(self):
        return {"patterns": self.patterns, "segments": self.segments}

    def built(self) -> None:
        self.nodes = [Node(0)]
        for glob, line in self.patterns:
            self.add(glob, line)
        self.forget()

    def forget(self) -> None:
        """The nodes stay; sets of them are found anew."""
        self.sets: dict[tuple[int, ...], tuple[Node, ...]] = {}
        self.steps: dict[tuple[tuple[int, ...], str], tuple[int, ...]] = {}
        self.start = self.closed([self.nodes[0]])

    def child(self, node: Node, kind: str, loop: str = "", gate: bool = False) -> Node:
        if getattr(node, kind) is None:
            self.nodes.append(Node(len(self.nodes), loop, gate))
            setattr(node, kind, self.nodes[-1])
        return getattr(node, kind)

    def add(self, glob: str, line: int) -> None:
        node = self.nodes[0]
        for kind, c in tokens(glob, self.segments):
            if kind == "folders":
                gate = self.child(node, "folders", "any", True)  # what follows is reached at once or after a slash
                node = self.child(gate, "one")
            elif kind == "deep":
                node = self.child(node, "deep", "any")
            elif kind == "star":
                node = self.child(node, "star", "segment" if self.segments else "any")
            elif kind == "one":
                node = self.child(node, "one")
            else:
                if c not in node.letters:
                    self.nodes.append(Node(len(self.nodes)))
                    node.letters[c] = self.nodes[-1]
                node = node.letters[c]
        node.lines.append(line)

    def closed(self, nodes: list[Node]) -> tuple[int, ...]:
        """The set of places reached without reading on, as a key of ``sets``."""
        seen, waiting = {}, list(nodes)
        while waiting:
            node = waiting.pop()
            if node.number in seen:
                continue
            seen[node.number] = node
            if not node.gate:
                waiting.extend(x for x in (node.star, node.deep) if x is not None)
                if node.folders is not None:
                    waiting.extend((node.folders, node.folders.one))
        key = tuple(sorted(seen))
        self.sets[key] = tuple(seen[k] for k in key)
        return key

    def step(self, key: tuple[int, ...], c: str) -> tuple[int, ...]:
        out = []
        for node in self.sets[key]:
            if node.loop == "any" or (node.loop == "segment" and c != "/"):
                out.append(node)
            if node.gate:
                if c == "/":
                    out.append(node.one)
                continue
            if c in node.letters:
                out.append(node.letters[c])
            if node.one is not None and (not self.segments or c != "/"):
                out.append(node.one)
        return self.closed(out)

    def lines(self, text: str | None) -> list[int]:
        """Lines of the patterns that match the whole text."""
        if text is None:
            return []
        if "nodes" not in self.__dict__:
            self.built()
        if len(self.steps) > REMEMBERED:
            self.forget()
        key = self.start
        for c in text:
            after = self.steps.get((key, c))
            if after is None:
                after = self.steps[key, c] = self.step(key, c)
            if not after:
                return []
            key = after
        return [line for node in self.sets[key] if not node.gate for line in node.lines]


def matched(texts: DataFrame, patterns: DataFrame, text: str, glob: str = "glob", line: str = "line", segments: bool = False, last: bool = False) -> DataFrame:
    """A row of texts for every pattern (line, glob) that matches it whole, with the pattern's line; with last, one row with the greatest line.

    Null texts and globs match nothing; the empty glob matches the empty text; a pattern given on several lines counts on each.
    With last, rows are told apart by all their columns, so equal rows become one.
    """
    wanted = patterns.select(F.col(glob).alias("g"), F.col(line).cast("long").alias("l")).where("g is not null and l is not null")
    size = F.sum(F.octet_length("g") + 64)
    total = wanted.agg(size).first()[0] or 0
    wanted, out = wanted.distinct(), None
    if total > FEW_BYTES:
        outlined = with_outlines(wanted, segments)
        shapes = [r.shape for r in outlined.where("shape is not null").groupBy("shape").agg(size.alias("size")).orderBy(F.desc("size"), "shape").limit(SHAPES).collect()]
        if shapes:
            out = by_keys(texts, outlined.where(F.col("shape").isin(shapes)), shapes, text, segments)
        wanted = outlined.where(F.col("shape").isNull() | ~F.col("shape").isin(shapes)).select("g", "l")
        total = wanted.agg(size).first()[0] or 0
    out = by_trie(texts, wanted, -(-total // PART_BYTES), text, segments, last, out)
    if out is None:
        return texts.withColumn("line", F.lit(0).cast("long")).limit(0)
    return out.groupBy(*texts.columns).agg(F.max("line").alias("line")) if last else out


def with_outlines(wanted: DataFrame, segments: bool) -> DataFrame:
    """(g, l, shape, values, rule) of patterns (g, l); shape, values and rule are null where a trie has to search them."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = [outline(g, segments) or (None, None, None) for g in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string())))], names=["g", "l", "shape", "values", "rule"])

    each = stored(wanted.mapInArrow(run, "g string, l long, shape string, values array<string>, rule string"), "globs")
    crowded = each.where("shape is not null").select("shape", "values", "g").distinct().groupBy(F.col("shape").alias("s"), F.col("values").alias("v")).count().where(F.col("count") > CROWD)
    crowded = stored(crowded, "globs-crowded")
    if crowded.isEmpty():
        return each
    out = each.join(crowded, (F.col("shape") == F.col("s")) & (F.col("values") == F.col("v")), "left")
    return stored(out.select("g", "l", *[F.when(F.col("count").isNull(), F.col(c)).alias(c) for c in ("shape", "values", "rule")]), "globs")


def by_keys(texts: DataFrame, outlined: DataFrame, shapes: list[str], text: str, segments: bool) -> DataFrame:
    """A row of texts for every pattern of these shapes that matches it."""
    slots: dict[str, dict[int, list[int]]] = {}
    for r in outlined.select("shape", F.posexplode("values")).groupBy("shape", "pos").agg(F.collect_set(slot(F.col("col"))).alias("slots")).collect():
        slots.setdefault(r.shape, {})[r.pos] = r.slots
    whole = F.col(f"_row.`{text}`").cast("string")
    parts = F.split(whole, "/") if segments else F.array(whole)
    rows = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("_row")).select("_row", F.when(whole.isNotNull(), parts).alias("_parts"))
    # not as a filter after the explode: that becomes one method, too long for the JVM to compile
    asked = rows.select("_row", F.explode(F.array_compact(F.array(*[keys_of(s, F.col("_parts"), slots[s]) for s in shapes]))).alias("_key"))
    rules = outlined.select(key(F.col("shape"), F.concat_ws("/", "values")).alias("_key"), F.col("rule").alias("_rule"), F.col("l").alias("_line"))
    hit = asked.join(rules, "_key").where(F.rlike(whole, F.col("_rule")))
    return hit.select(*[F.col(f"_row.`{c}`").alias(c) for c in texts.columns], F.col("_line").alias("line"))


def by_trie(texts: DataFrame, wanted: DataFrame, parts: int, text: str, segments: bool, last: bool, out: DataFrame | None) -> DataFrame | None:
    """out with a row of texts for every pattern (g, l) that matches it, or with last for the last of a part."""
    import pyarrow as pa

    spark, schema = texts.sparkSession, texts.withColumn("line", F.lit(0).cast("long")).schema
    for part in range(parts):
        mine = wanted.where(F.pmod(F.xxhash64("g"), F.lit(parts)) == part).collect()  # about PART_BYTES
        shared = spark.sparkContext.broadcast(GlobTrie([(r.g, r.l) for r in mine], segments))

        def run(batches, shared=shared):
            for batch in batches:
                at, hits = [], []
                for i, value in enumerate(batch.column(batch.num_columns - 1)):
                    found = shared.value.lines(value.as_py())
                    found = [max(found)] if last and found else found
                    at.extend([i] * len(found))
                    hits.extend(found)
                rows = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(hits, pa.int64())], names=[*schema.names])

        hit = texts.withColumn("_text", F.col(text).cast("string")).mapInArrow(run, schema)
        out = hit if out is None else out.unionByName(hit)
    return out
