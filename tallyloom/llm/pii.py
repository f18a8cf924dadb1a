"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame code only.

Base: four regular expressions with their checks (address parts, Luhn, numbers of digits).

Method: base matches are the seeds. Lexical patterns are of two families: contexts (the pair of
words to the left and to the right of a token, each of them alone, or the border of its line or
text) and shapes (runs of letters as one letter, digits as nines, all other signs as they are).
Patterns and the instances seen in them form a graph. Round by round a pattern's confidence for a
kind is the mean score of its distinct instances for that kind, and a candidate scores the
noisy-or of the best confidence in either family. Candidates are tokens with digits or an at sign
that no base match touches, without the punctuation around them; among them are the pieces of
runs that the base drops whole, as it does not retry. Patterns count when enough distinct
instances support them; candidates of a high score become spans of that kind, if the kind's own
check (octets, Luhn, number of digits) holds for them as it does for seeds.

Positions are code points. Spark has no function for the positions of all matches; they follow
from the lengths of the matches and of the pieces between them (``split``), summed by a window.

The regular expressions match what the plain ones (``PLAIN``) match. Possessive quantifiers
keep Java's matcher from recursing on long repetitions, and the look-behind keeps it from
trying every place of a run in which no match can start.

Defined results: a null or empty text has no spans; repeated rows each get their spans; rows of
one doc_id and different texts get their own; overlapping matches of different kinds all stay;
an empty table gives an empty result; without seeds nothing is added; texts are read whole; only
the two named columns are read, so others can't clash (masking keeps them as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, written

KINDS = ("email", "ip", "card", "phone")
#: The patterns as agreed, for reference and tests.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be searched in it.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A token with a digit or an at sign.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
#: The word that ends or begins a piece of text, spaces aside.
LAST_WORD, FIRST_WORD = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)\x20*+\z", r"^\x20*+([^\x20\x09-\x0D]++)"
#: Stands for the neighbour at a line's or text's border; no word holds it.
BORDER = "\n"
#: Punctuation around a candidate.
BEFORE, BEHIND = r"""^[("'<\[{]++""", r"""[.,;:!?)"'>\]}]++\z"""
#: Distinct instances a pattern needs, confidence and score that count, rounds.
SUPPORT, CONFIDENT, ROUNDS = 5, 0.9, 3


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The check of a kind's matches."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def located(texts: DataFrame, patterns: dict[str, str], hints: dict[str, str]) -> DataFrame:
    """(doc_id, key, kind, match, start, stop, left, right) of every match of every pattern.

    left and right are the whole words next to it, in lower case, empty at a line's or text's border.
    Next to another match of its kind, the word is read from that match and the gap beyond it.
    """
    entries = []
    for kind, pattern in patterns.items():
        hint = hints.get(kind, "")
        has = F.lit(True) if kind == "token" else F.instr("text", hint) > 0 if hint else F.col("digit")
        entries.append(F.when(has, F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"))))
    with_matches = texts.where(F.col("digit") | (F.instr("text", "@") > 0)).withColumn("entry", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull() & (F.size(e["matches"]) > 0))))
    gaps = None
    for kind, pattern in patterns.items():
        cut = F.split("text", pattern, -1)
        gaps = F.when(F.col("entry.kind") == kind, cut) if gaps is None else gaps.when(F.col("entry.kind") == kind, cut)
    cut = with_matches.withColumn("gaps", gaps)
    n = F.size("entry.matches")
    none = F.array(F.lit(None).cast("string"))
    zipped = F.arrays_zip(
        F.col("entry.matches").alias("match"),
        F.slice("gaps", F.lit(1), n).alias("before"),
        F.slice("gaps", F.lit(2), n).alias("after"),
        F.concat(none, F.slice("entry.matches", F.lit(1), n - 1)).alias("match_before"),
        F.concat(none, F.slice("gaps", F.lit(1), n - 1)).alias("gap_before"),
        F.slice("entry.matches", F.lit(2), n).alias("match_after"),
        F.slice("gaps", F.lit(3), n).alias("gap_after"),
    )
    rows = cut.select("doc_id", "key", "row", F.col("entry.kind").alias("kind"), F.posexplode(zipped).alias("i", "m"))
    # an empty gap or one of spaces lies between two matches; at a text's border the outer ones are null
    blank = r"^\x20*+\z"
    before = F.when(F.col("m.before").rlike(blank), F.concat(F.coalesce("m.gap_before", F.lit("")), F.coalesce("m.match_before", F.lit("")), "m.before")).otherwise(F.col("m.before"))
    after = F.when(F.col("m.after").rlike(blank), F.concat("m.after", F.coalesce("m.match_after", F.lit("")), F.coalesce("m.gap_after", F.lit("")))).otherwise(F.col("m.after"))
    left, right = F.lower(F.regexp_extract(before, LAST_WORD, 1)), F.lower(F.regexp_extract(after, FIRST_WORD, 1))
    rows = rows.select("doc_id", "key", "row", "kind", "i", F.col("m.match").alias("match"), F.length("m.before").alias("gap"), left.alias("left"), right.alias("right"))
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.col("gap") + F.length("match")).over(order)
    placed = rows.select("doc_id", "key", "kind", "match", (stop - F.length("match")).alias("start"), stop.alias("stop"), "left", "right")
    token = F.col("kind") == "token"
    lead = F.when(token, F.length(F.regexp_extract("match", BEFORE, 0))).otherwise(0)
    tail = F.when(token, F.length(F.regexp_extract("match", BEHIND, 0))).otherwise(0)
    bare = F.when(token, F.regexp_replace(F.regexp_replace("match", BEFORE, ""), BEHIND, "")).otherwise(F.col("match"))
    return placed.select("doc_id", "key", "kind", bare.alias("match"), (F.col("start") + lead).alias("start"), (F.col("stop") - tail).alias("stop"), "left", "right")


def untouched(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens that no span overlaps: all in order of start in a text, with what spans reach before and begin after."""
    columns = ["doc_id", "key", "start", "stop", "match", "left", "right"]
    # tokens of repeated rows are made one before they meet
    both = tokens.select(*columns).distinct().select("*", F.lit(False).alias("base")).unionByName(spans.select(*columns, F.lit(True).alias("base")))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    forth = Window.partitionBy("doc_id", "key").orderBy("start", F.desc("base")).rowsBetween(*so_far)
    # what follows is read backwards, as Spark sums a frame that begins at the row anew for every row
    back = Window.partitionBy("doc_id", "key").orderBy(F.desc("start"), "base").rowsBetween(*so_far)
    reach, ahead = F.max(F.when(F.col("base"), F.col("stop"))).over(forth), F.min(F.when(F.col("base"), F.col("start"))).over(back)
    marked = both.withColumn("reach", reach).withColumn("ahead", ahead)
    free = ~F.col("base") & (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("ahead", F.col("stop")) >= F.col("stop"))
    return marked.where(free).select(*columns)


def shape(match: Column) -> Column:
    """Letters run together as `a`, every digit as `9`."""
    return F.regexp_replace(F.regexp_replace(match, r"\p{L}++", "a"), "[0-9]", "9")


def in_patterns(rows: DataFrame, instance: Column, *columns: str) -> DataFrame:
    """(family, pattern, instance, columns) of every pattern that a match is seen in, each once."""
    left, right = (F.when(F.col(side) == "", F.lit(BORDER)).otherwise(F.col(side)) for side in ("left", "right"))
    named = [("context", F.concat_ws("\t", left, right)), ("context", F.concat(left, F.lit("\t"))), ("context", F.concat(F.lit("\t"), right)), ("shape", shape(F.col("match")))]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), p.alias("pattern")) for f, p in named])).alias("p")
    return rows.select(each, instance.alias("instance"), *columns).select("p.*", "instance", *columns).distinct()


def checked(match: str) -> Column:
    """Whether the check of a row's kind holds for a match."""
    ok = F.lit(False)
    for kind in KINDS:
        ok = ok | ((F.col("kind") == kind) & valid(kind, F.col(match)))
    return ok


def bootstrapped(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, key, start, stop, kind) of the candidates that confident patterns discover."""
    graph = ["family", "pattern"]
    known = written(in_patterns(seeds, F.concat_ws(":", "kind", "match"), "kind"), "pii-seeds")
    open_ = written(in_patterns(candidates, F.col("match")), "pii-candidates")
    # per pattern: how many distinct instances of each kind, and of all
    sure = known.groupBy(*graph, "kind").agg(F.count("*").alias("sure"))
    everything = known.select(*graph, "instance").unionByName(open_).groupBy(*graph).agg(F.count("*").alias("all"))
    scores = None  # of candidates: (instance, kind, score)
    for _ in range(ROUNDS):
        if scores is None:
            support = sure
        else:
            more = open_.join(scores, "instance").groupBy(*graph, "kind").agg(F.sum("score").alias("more"))
            support = sure.join(more, [*graph, "kind"], "full").select(*graph, "kind", (F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0.0))).alias("sure"))
        rated = support.join(everything, graph).where((F.col("sure") >= SUPPORT) & (F.col("sure") / F.col("all") >= CONFIDENT / 2))
        confidence = rated.select(*graph, "kind", (F.col("sure") / F.col("all")).alias("confidence"))
        best = open_.join(confidence, graph).groupBy("instance", "kind", "family").agg(F.max("confidence").alias("best"))
        miss = F.sum(F.log(F.greatest(1 - F.col("best"), F.lit(1e-6))))
        scores = written(best.groupBy("instance", "kind").agg((1 - F.exp(miss)).alias("score")).where(checked("instance")), "pii-scores")
    # the kind of the highest score; ties to the kind listed first
    chosen = scores.where(F.col("score") >= CONFIDENT).groupBy("instance").agg(F.max(F.struct("score", (-place("kind")).alias("rank"), "kind")).alias("best"))
    return candidates.join(chosen, F.col("match") == F.col("instance")).select("doc_id", "key", "start", "stop", F.col("best.kind").alias("kind"))


def place(kind: str | Column) -> Column:
    """Place of a kind as listed."""
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind) if isinstance(kind, str) else kind)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, a key of the text, a number of the row, and whether the text has a digit."""
    texts = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return texts.select("doc_id", "text", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"), F.col("text").rlike("[0-9]").alias("digit"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, kind, start, stop, base) of every span of every distinct text of a doc_id."""
    texts = keyed(docs, id_col, text_col)
    every = located(texts, PATTERNS | {"token": CANDIDATE}, HINTS)
    every = written(every, "pii-matches")
    spans = written(every.where(F.col("kind") != "token").where(checked("match")).distinct(), "pii-base")
    candidates = written(untouched(every.where(F.col("kind") == "token"), spans), "pii-open")
    new = bootstrapped(spans, candidates)
    columns = ["doc_id", "key", "kind", "start", "stop"]
    return spans.select(*columns, F.lit(True).alias("base")).unionByName(new.select(*columns, F.lit(False).alias("base")))


def gathered(spans: DataFrame) -> DataFrame:
    """Per doc_id and key the spans in order of start, then kind: (start, place, stop, kind, base)."""
    each = F.struct("start", place("kind").alias("place"), "stop", "kind", "base")
    return spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(each)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row."""
    rows = keyed(docs, id_col, text_col).select("doc_id", "key")
    spans = written(gathered(found(docs, id_col, text_col)), "pii-spans").withColumnRenamed("doc_id", "d").withColumnRenamed("key", "k")
    out = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    all_ = F.coalesce("spans", F.expr("from_json('[]', 'array<struct<start:bigint,place:bigint,stop:bigint,kind:string,base:boolean>>')"))
    out = out.select("doc_id", all_.alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [n_of(base, kind).alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans by the first's."""
    spans = written(gathered(found(docs, id_col, text_col)), "pii-spans").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.concat(acc["text"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(inside, acc["text"]).otherwise(piece).alias("text"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    clean = F.aggregate("_spans", first, step, lambda acc: F.concat(acc["text"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    # a text without a digit or at sign holds no span and needs no join; the join doesn't change its kind with size
    may_hold = F.coalesce(text.cast("string").rlike("[0-9@]"), F.lit(False))
    out = docs.where(may_hold).join(spans.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("_doc")) & (key == F.col("_key")), "left")
    out = out.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(clean)).select(*docs.columns)
    return docs.where(~may_hold).unionByName(out)
