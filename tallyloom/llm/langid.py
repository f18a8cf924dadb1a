"""Language identification by word-first backoff.

A word known from training is scored by its per-language log frequency. A word not known is
scored by its character n-grams: the longest length of which any n-gram is known is used, the
mean of its n-grams' log frequencies is taken, and a penalty is added for each shorter step.

The model is fitted on a documented, bounded sample of labelled texts (``max_rows``, chosen by
a hash of the text) and holds at most ``max_words`` words and ``max_grams`` n-grams; so it has a
fixed size and is broadcast. Only text and lang of the training rows are seen by it.

Defined results: a text that is null or has no letter gets `und` and score 0; a whole text is
scored, whatever its length; equal texts score alike; with no labelled training text every
text is `und` with score 0; ties go to the language first by code point; repeated rows are each
scored; an empty table gives an empty result; the columns `lang_pred` and `score` of the input are
replaced, and no other plays a part.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import free_worker, id_and_text

UNKNOWN = "und"
GRAM_LENGTHS = (4, 3, 2, 1)
STEP_PENALTY = 0.5
CACHED = 150_000
#: Marks taken off a chunk's ends at once, as a shortcut.
EDGES = ".,;:!?\"'()[]{}%$#&*|-_/"


def letters_of(chunk: str) -> list[str]:
    """Runs of letters of a chunk, in lower case."""
    low = chunk.lower()
    if low.isalpha():
        return [low]
    bare = low.strip(EDGES)
    if bare.isalpha():
        return [bare]
    return "".join(c if c.isalpha() else " " for c in low).split()


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word with its borders; single letters have none."""
    framed = f" {word} " if n > 1 else word
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def fit(docs: DataFrame, is_training: Column, text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000, max_words: int = 60_000, max_grams: int = 60_000) -> dict:
    """Per-language log frequencies of words and n-grams over the sample.

    Words are counted by Spark; a word is counted once a task and language before the shuffle.
    n-grams are counted over the counted words, weighted by their counts.
    """
    import pyarrow as pa

    rows = docs.where(is_training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, (max_rows << 20) // total))

    def count(batches):
        from collections import Counter

        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                into = words.setdefault(lang, Counter())
                for chunk, n in Counter(text.split()).items():
                    for w in letters_of(chunk):
                        into[w] += n
        out = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
        for k in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out[k : k + 50_000])], names=["lang", "item", "n"])

    counted = rows.mapInArrow(count, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = counted.groupBy("item").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    top = words.orderBy(F.desc("total"), "item").limit(max_words).select("item", "by_lang").toArrow()  # max_words rows at most
    langs = sorted({lang for entries in top.column("by_lang").to_pylist() for lang, _ in entries})
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((top.num_rows, len(langs)))
    for i, entries in enumerate(top.column("by_lang").to_pylist()):
        for lang, n in entries:
            counts[i, place[lang]] = n
    known = {w: i for i, w in enumerate(top.column("item").to_pylist())}
    tables, grams, rows_before = [logged(counts)], {}, len(known)
    for n in GRAM_LENGTHS:
        sums: dict[str, np.ndarray] = {}
        for w, i in known.items():
            for g in grams_of(w, n):
                have = sums.get(g)
                if have is None:
                    sums[g] = counts[i].copy()
                else:
                    have += counts[i]
        best = sorted(sums, key=lambda g: (-sums[g].sum(), g))[: max_grams // len(GRAM_LENGTHS)]
        grams[n] = {g: rows_before + k for k, g in enumerate(best)}
        rows_before += len(best)
        tables.append(logged(np.array([sums[g] for g in best]).reshape(len(best), len(langs))))
    return {"langs": langs, "words": known, "grams": grams, "matrix": np.vstack(tables)}


def logged(counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log frequencies per column."""
    return np.log((counts + smooth) / (counts.sum(axis=0) + smooth * max(1, len(counts)))).astype(np.float32)


class Scorer:
    """Scores of texts by their chunks; a chunk's scores are computed once while it is cached."""

    def __init__(self, model: dict):
        self.langs, self.words, self.matrix = model["langs"], model["words"], model["matrix"]
        self.grams = [(n, model["grams"][n]) for n in GRAM_LENGTHS]
        self.table = np.zeros((CACHED, len(self.langs) + 1), np.float32)
        self.known: dict[str, int] = {}

    def learn(self, chunks: list[str]) -> None:
        """Rows of new chunks: number of words, then sums of their log frequencies per language.

        A word known as such has one entry; another has its longest known n-grams, which count
        by their mean, less a penalty for the steps.
        """
        entries, lengths, penalties, owners = [], [], [], []
        words, first = self.words, len(self.known)
        for k, c in enumerate(chunks):
            self.known[c] = first + k
            for w in letters_of(c):
                owners.append(k)
                have = words.get(w)
                if have is not None:
                    entries.append(have)
                    lengths.append(1)
                    penalties.append(0.0)
                    continue
                for steps, (n, table) in enumerate(self.grams, 1):
                    found = [x for g in grams_of(w, n) if (x := table.get(g)) is not None]
                    if found:
                        entries += found
                        lengths.append(len(found))
                        penalties.append(STEP_PENALTY * steps)
                        break
                else:
                    entries.append(0)  # nothing known: alike for all languages
                    lengths.append(1)
                    penalties.append(np.inf)
        if first + len(chunks) > len(self.table):
            self.table = np.vstack([self.table, np.zeros((first + len(chunks), self.table.shape[1]), np.float32)])
        rows = self.table[first : first + len(chunks)]
        rows[:] = 0
        if owners:
            n = np.array(lengths)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            scores = np.add.reduceat(self.matrix[np.array(entries)], starts, axis=0) / n[:, None] - np.array(penalties)[:, None]
            scores[np.isinf(penalties)] = -20.0
            at = np.array(owners)
            rows[:, 0] = np.bincount(at, minlength=len(chunks))
            for j in range(len(self.langs)):
                rows[:, j + 1] = np.bincount(at, weights=scores[:, j], minlength=len(chunks))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        split = [t.split() if t else [] for t in texts]
        filled = [i for i, chunks in enumerate(split) if chunks]
        if not filled:
            return out
        chunks = [c for i in filled for c in split[i]]
        new = set(chunks).difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known = {}
            new = set(chunks)
        self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        sizes = np.array([len(split[i]) for i in filled])
        sums = np.add.reduceat(self.table[at].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        if any(len(c) > 64 for c in new):
            self.known = {}  # long chunks hardly come again, and would hold memory
        for i, row in zip(filled, sums):
            if row[0] == 0:
                continue
            mean = row[1:] / row[0]
            best = int(np.argmax(mean))
            # confidence of the mean word, sharpened by how many words agree
            odds = np.exp(np.maximum((mean - mean[best]) * min(math.sqrt(row[0]) * 4, 60.0), -700))
            out[i] = (self.langs[best], float(min(1.0, 1.0 / odds.sum())))
        return out


def annotated(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score appended to every row (columns of these names are replaced)."""
    import pyarrow as pa

    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        free_worker()
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                langs, scores = zip(*scorer.texts(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    return annotated(id_and_text(docs, id_col, text_col), model).select("doc_id", "lang_pred", "score")
