"""Tandem runs, packing and vector codes against brute force, for odd tables too."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tallyloom.llm import codes, packing, tandem
from tallyloom.llm.bpe_batch import BatchEncoder
from tallyloom.llm.registry import queries, tokenizer_json

from .conftest import odd_rows, words

TEXTS = [(r[0], r[1]) for r in odd_rows()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- tandem runs


def brute_runs(t, least=0, exponent=2):
    """Every (start, length, smallest period) by comparing each word with the one q further on."""
    found = set()
    for q in range(1, len(t) // 2 + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, exponent * q) and not any(all(t[x] == t[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                found.add((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters = rng.choice([1, 2, 2, 3, 4])
        t = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4:
            t = ([rng.randrange(letters) for _ in range(rng.randint(1, 7))] * 20)[: rng.randint(0, 45)] + t[:12]
        got = list(zip(*(x.tolist() for x in tandem.all_runs(np.array(t, dtype=np.int64)))))
        assert len(set(got)) == len(got) and sorted(got, key=lambda r: (r[0], r[2])) == brute_runs(t), t


def test_runs_of_words_with_many_squares():
    fibonacci, thue = ["a", "ab"], [0]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while len(thue) < 256:
        thue += [1 - x for x in thue]
    for t in ([ord(c) for c in fibonacci[-1]], thue, [7] * 300, [1, 2] * 150 + [2] * 30):
        got = list(zip(*(x.tolist() for x in tandem.all_runs(np.array(t)))))
        assert sorted(got, key=lambda r: (r[0], r[2])) == brute_runs(t)
    start, length, period = tandem.all_runs(np.tile(np.arange(1000), 300))  # 300,000 words
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [1000])


def told(doc_id, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and w and h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w, 24, 3)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("group", [1 << 16, 50])
def test_runs_of_documents(spark, none, monkeypatch, group):
    monkeypatch.setattr(tandem, "GROUP", group)
    rng = random.Random(group)
    texts = TEXTS[:8] + TEXTS[10:] + [(100 + i, words(i, rng.randint(0, 150))) for i in range(60)]
    texts += [(200, "a b c " * 30 + words(3, 20) + " q" * 24), (201, " x" * 23), (202, " x" * 24), (203, "la le li lo " * 6), (None, "na ne " * 40), (204, words(9, 12) + "\t" + "\n".join([words(4, 8)] * 3))]
    docs = spark.createDataFrame([(i, t, 1, "k", 3) for i, t in texts], "doc_id long, text string, start long, runs string, period long").repartition(3)
    got = [tuple(r) for r in tandem.runs(docs, planted=True).collect()]
    assert Counter(got) == Counter(told(i, t, True) for i, t in texts)
    assert sum(r[1] > 0 for r in got) > 8
    plain = {r.doc_id: r for r in tandem.runs(docs.where("doc_id >= 200"), keep=True).collect()}
    assert [tuple(r) for r in plain[202].runs] == [(0, 24, 1)] and plain[202].collapsed == "x" and plain[201].n_runs == 0
    assert tandem.runs(none).count() == 0


# ---- packing


def brute_packing(lengths, capacity):
    """Longest first, each where the sum of squares becomes smallest; new only where none has room."""
    bins = []
    for n in sorted(lengths, reverse=True):
        gaps = Counter(capacity - sum(b) for b in bins if sum(b) < capacity)
        tried = []
        for g in sorted(x for x in gaps if x >= n):
            after = gaps.copy()
            after[g] -= 1
            if g > n:
                after[g - n] += 1
            tried.append((sum(x * x for x in after.values()), g - n, g))
        if tried:
            g = min(tried)[2]
            next(b for b in bins if capacity - sum(b) == g).append(n)
        else:
            bins.append([n])
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_sum_of_squares_rule(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.choice([1, 3, capacity // 2]) for _ in range(rng.randint(0, 150))]
    plan = packing.sum_of_squares(Counter(lengths), capacity)
    held = {}
    for length, _, number, first, offset in plan:
        for k in range(number):
            held.setdefault(first + k, []).append((offset, length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    shape = lambda bins: Counter(tuple(sorted(b)) for b in bins)
    assert len(held) == len(brute_packing(lengths, capacity))
    assert Counter(capacity - sum(n for _, n in p) for p in held.values()) == Counter(capacity - sum(b) for b in brute_packing(lengths, capacity))
    assert Counter(n for p in held.values() for _, n in p) == Counter(lengths)
    assert shape([[n for _, n in p] for p in held.values()]).total() == len(held)


def test_shares_of_frequent_lengths_stay_near_the_bound():
    counts = {n: 10**9 // n for n in range(1, 1500)} | {2048: 10**10, 700: 5 * 10**10}
    plan = packing.sum_of_squares(counts, 2048)
    ranks = {}
    for length, rank, number, _, _ in sorted(plan):
        assert rank == ranks.get(length, 0)
        ranks[length] = rank + number
    assert ranks == counts and len(plan) < 1_000_000
    free = max(p[3] + p[2] for p in plan) * 2048 - sum(n * c for n, c in counts.items())
    assert free >= 0


def test_encoder_is_the_library_s():
    from tokenizers import Tokenizer

    content = tokenizer_json()
    library, own = Tokenizer.from_str(content), BatchEncoder(content)
    library.no_truncation()
    rng = random.Random(2)
    texts = [t or "" for _, t in TEXTS] + ["~ a~b ¶ ~~", " a\x1cb \x85c\xa0d\u2003e  ", "a<|endoftext|>b <|startoftext|>", "don't WE'LL　x", "́a b́"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x300), rng.randrange(0x300, 0xD7FF), rng.randrange(0x10000, 0x20000)])) for _ in range(50)) for _ in range(500)]
    texts += [words(i, 300) for i in range(20)] + ["x" * n for n in (39, 40, 41, 300)]
    for _ in range(2):
        for t, ids in zip(texts, own.encode_each(pa.array(texts)), strict=True):
            assert list(array("I", ids)) == library.encode(t, add_special_tokens=False).ids, t


def packed_is_right(rows, texts, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    wanted = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p, k in enumerate(range(0, len(ids), capacity)):
            part = ids[k : k + capacity]
            wanted[i, p, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing_of_documents(spark, odd, none):
    rows = packing.pack(odd, tokenizer_json(), capacity=64).collect()
    assert packed_is_right(rows, TEXTS, 64)[0] > 0
    many = [(i if i % 3 else None, words(i % 400, 1 + i % 70) if i % 4 else "one text of a hot group") for i in range(1500)]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in many], "doc_id long, text string, length long, piece int").repartition(5)
    placed = packing.pack(docs, tokenizer_json(), capacity=256, keep_ids=True)
    used, bound = packed_is_right(placed.collect(), many, 256)
    assert used <= 1.01 * bound + 1
    joined = packing.sequences(placed).collect()
    assert len(joined) == used and all(len(r.ids) == 4 * r.n_tokens <= 1024 for r in joined)
    assert Counter(x for r in joined for x in array("I", bytes(r.ids)))[0] >= len(many)
    assert packing.pack(none, tokenizer_json()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, tokenizer_json(), capacity=0)


def test_packing_query_ranks_pieces_of_a_length(spark, tmp_path):
    docs = [(i if i % 5 else None, ("same text", None, words(i, 2500))[i % 3] if i % 3 < 2 or i % 20 == 2 else words(i % 30, 1 + i % 9), "en", "a", 1) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    placed = queries()["op12_best_fit_packing"](spark, str(tmp_path))
    assert placed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used, bound = packed_is_right(placed.collect(), [d[:2] for d in docs], 2048)
    assert used <= bound + 1


# ---- vector codes


def brute_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(order[0][1]) // parts
    sized = [r for r in order if len(r[1]) == w * parts]
    books = [[r[1][p * w : (p + 1) * w] for r in sized[:entries]] for p in range(parts)]

    def assign(v):
        out = []
        for p in range(parts):
            d = [sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        members = [[[] for _ in b] for b in books]
        for _, v, _ in sized:
            for p, (e, _) in enumerate(assign(v)):
                members[p][e].append(v[p * w : (p + 1) * w])
        books = [[[sum(c) // len(m) for c in zip(*m)] if m else old for m, old in zip(ms, b)] for ms, b in zip(members, books)]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    coded = [(i, "".join(f"{e:02x}" for e, _ in a), sum(d for _, d in a), lab) for i, v, lab in sized for a in [assign(v)]]
    by = Counter()
    for _, _, d, lab in coded:
        by[lab] += d
    odd = [(i, None, None, by.get(lab), digest) for i, v, lab in kept if len(v) != w * parts]
    return Counter([(i, c, d, by[lab], digest) for i, c, d, lab in coded] + odd)


def test_codes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(codes, "STEP", 7)
    rng = random.Random(8)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.uniform(-1, 1)) for _ in range(8)], rng.choice([0, 1, 1, None])) for i in range(90)]
    rows += [(1000 + i, [f32(0.5)] * 8, 1) for i in range(40)] + [(5, rows[5][1], 1), (6, [0.25] * 8, 2), (None, [0.125] * 8, None)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.1, None] + [0.0] * 6, 0), (203, [float("nan")] * 8, 0), (204, [float("inf")] + [0.0] * 7, 1), (205, [f32(0.1)] * 4, 1), (206, [f32(0.1)] * 9, 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, part int").repartition(4)
    for entries, rounds in ((16, 4), (256, 2), (1, 1)):
        got = Counter(tuple(r) for r in codes.compressed(df, entries=entries, rounds=rounds).collect())
        wanted = brute_codes(rows, 4, entries, rounds)
        if entries <= 16:  # one hexadecimal digit then
            wanted = Counter({(i, c and c[1::2], *rest): n for (i, c, *rest), n in wanted.items()})
        assert got == wanted
    assert codes.compressed(df.where("false")).count() == 0
    assert {r.code for r in codes.compressed(df.where("vec_id = 205"), parts=3).collect()} == {None}
    with pytest.raises(Exception, match="64 bits"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<float>, label int")).collect()


def test_distances_beyond_doubles_are_exact():
    rng = np.random.default_rng(1)
    v, book = rng.integers(-(2**28), 2**28, (20, 4)), rng.integers(-(2**28), 2**28, (9, 4))
    first, distance = codes.nearest(v, book)
    for i in range(20):
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(v[i], e)) for e in book]
        assert (int(first[i]), int(distance[i])) == (d.index(min(d)), min(d))
