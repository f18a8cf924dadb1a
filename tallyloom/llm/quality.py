"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), the
sum-of-squares identity, so a text is scored in time linear in its distinct words.

Features: words hashed to ``WORD_SLOTS`` slots (their counts, scaled to length 1), and each
structure statistic (length, lines, case, punctuation, repetition) and metadatum (numeric columns
named by the caller, such as ``n_chars``) as one of ``BINS`` quantile bins. Labels, lang, source and
doc_id are never features.

The model is fitted on at most about ``max_rows`` labelled texts, a documented parameter,
chosen by a hash of the id; quantiles come from the same sample. It has a fixed size.

Defined results: null and empty texts are scored by their statistics (all zero); with no
labelled row every score is 0.5; a label for an id that has several is the largest; documents
repeated or sharing an id are scored one by one; whole texts are read, whatever their length; a
null metadatum counts as -1; an empty table gives an empty result; columns that are not named play
no part, so none can clash.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_SLOTS, BINS, RANK = 1 << 15, 12, 8
STATS = ("bytes", "words", "lines", "word_length", "upper", "digits", "marks", "distinct", "top_word", "line_repeats", "long_words", "non_ascii", "bars", "letters")
CACHED = 400_000
UPPER, DIGITS, LETTERS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (48, 57), (97, 122)))
SPACES = b" \t\n\r\x0b\x0c"


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The structure statistics of one text."""
    n, w = len(raw), len(words)
    if not n:
        return [0.0] * len(STATS)

    def share(drop: bytes) -> float:
        return (n - len(raw.translate(None, drop))) / n

    upper, digits, lower, spaces = share(UPPER), share(DIGITS), share(LETTERS), share(SPACES)
    wide = len(raw.translate(None, bytes(range(128)))) / n
    lines = raw.split(b"\n")
    return [
        np.log1p(n), np.log1p(w), np.log1p(len(lines)), (n - spaces * n) / max(w, 1), upper, digits,
        max(0.0, 1 - upper - digits - lower - spaces - wide), len(counts) / max(w, 1), max(counts.values(), default=0) / max(w, 1),
        1 - len(set(lines)) / len(lines), sum(c for k, c in counts.items() if len(k) > 12) / max(w, 1), wide, raw.count(b"|") / n, lower + upper,
    ]


class Features:
    """Hashed words and statistics of texts; slots of words are cached."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        raw = (text or "").encode()
        words = raw.split()
        counts = Counter(words)
        if len(self.slots) > CACHED:
            self.slots.clear()
        slots, ids = self.slots, []
        for w in counts:
            s = slots.get(w)
            if s is None:
                s = zlib.crc32(w) % WORD_SLOTS
                if len(w) <= 64:
                    slots[w] = s
            ids.append(s)
        x = np.fromiter(counts.values(), np.float32, len(ids))
        if len(x):
            x /= np.sqrt((x * x).sum())
        return np.array(ids, dtype=np.int32), x, statistics(raw, words, counts)


def binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Slots of the bins that the statistics and metadata of a text fall into."""
    return WORD_SLOTS + np.arange(len(edges)) * BINS + (stats[:, None] > edges).sum(axis=1)


class Machine:
    """The factorisation machine: scoring, and fitting by AdaGrad."""

    def __init__(self, edges: np.ndarray, seed: int = 7):
        rng, size = np.random.default_rng(seed), WORD_SLOTS + len(edges) * BINS
        self.edges = edges
        self.w0, self.w, self.v = 0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32)

    def whole(self, ids: np.ndarray, x: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """A text's slots and values, words and bins together."""
        return np.concatenate([ids, binned(np.asarray(stats), self.edges)]), np.concatenate([x, np.full(len(self.edges), 0.5, np.float32)])

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        """Margin of each row, by the sum-of-squares identity, and what the gradient needs."""
        ids = np.concatenate([r[0] for r in rows])
        x = np.concatenate([r[1] for r in rows])
        starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        linear = np.add.reduceat(self.w[ids] * x, starts)
        return self.w0 + linear + 0.5 * (sums**2 - squares).sum(axis=1), (ids, x, starts, vx, sums)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), batch):
                at = order[k : k + batch]
                margin, (ids, x, starts, vx, sums) = self.margins([rows[i] for i in at])
                err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[at]).astype(np.float32) / len(at)
                each = np.repeat(np.arange(len(at)), np.diff(np.append(starts, len(ids))))
                slots, place = np.unique(ids, return_inverse=True)
                dw = np.bincount(place, weights=err[each] * x, minlength=len(slots)).astype(np.float32) + decay * self.w[slots]
                part = (err[each] * x)[:, None] * (sums[each] - vx)
                dv = np.stack([np.bincount(place, weights=part[:, f], minlength=len(slots)) for f in range(RANK)], axis=1).astype(np.float32) + decay * self.v[slots]
                d0 = float(err.sum())
                gw[slots] += dw * dw
                gv[slots] += dv * dv
                g0 += d0 * d0
                self.w[slots] -= rate * dw / np.sqrt(gw[slots])
                self.v[slots] -= rate * dv / np.sqrt(gv[slots])
                self.w0 -= rate * d0 / g0**0.5


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, label_col: str = "quality", max_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> Machine | None:
    """A machine fitted on a bounded sample of the labelled training rows; None without labels."""
    import pyarrow as pa

    known = labels.where(F.col(label_col).isNotNull() & is_training).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < max(1, (max_rows << 20) // total))
    # at most about max_rows ids of 12 bytes
    rows = described(docs, id_col, text_col, metadata).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label", "metadata")

    def run(batches):
        features = Features()
        for batch in batches:
            out = [features.of(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([o[0].tobytes() for o in out], pa.binary()), pa.array([o[1].tobytes() for o in out], pa.binary()), pa.array([np.array(o[2] + m).tobytes() for o, m in zip(out, batch.column(3).to_pylist())], pa.binary()), batch.column(2), batch.column(0)]
            yield pa.RecordBatch.from_arrays(cols, names=["ids", "x", "stats", "label", "doc_id"])

    got = rows.mapInArrow(run, "ids binary, x binary, stats binary, label int, doc_id long").orderBy("doc_id").limit(2 * max_rows).toArrow().to_pydict()
    if not got["label"]:
        return None
    stats = np.array([np.frombuffer(s) for s in got["stats"]])
    machine = Machine(np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T)
    rows_ = [machine.whole(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), s) for i, x, s in zip(got["ids"], got["x"], stats)]
    machine.fit(rows_, np.array(got["label"], dtype=np.float32))
    return machine


def described(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    """doc_id, text and the metadata as an array of doubles."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in metadata]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.array(*values).cast("array<double>").alias("metadata"))


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and predicted of every row; metadata are the columns that the machine was fitted with."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))

    def run(batches):
        model, features = pickle.loads(shared.value), Features()

        def of(text, more):
            ids, x, stats = features.of(text)
            return ids, x, stats + more

        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                if model is None:
                    scores = np.full(part.num_rows, 0.5)
                else:
                    margin, _ = model.margins([model.whole(*of(t.as_py(), m)) for t, m in zip(part.column(1), part.column(2).to_pylist())])
                    scores = 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return described(docs, id_col, text_col, metadata).mapInArrow(run, "doc_id long, score double, predicted int")
