"""The pipeline's stages on a small corpus, against brute force and on odd tables, and the registered names."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tallyloom.llm import langid, mixing
from tallyloom.llm.registry import tokenizer_json

from .conftest import words
from .test_operators import pii_brute, shingle_sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    base = words(1, 200).split()
    near = list(base)
    near[100] = "other"
    rows = [(i, words(100 + i, 60), "en", "s0") for i in range(20)] + [(50, " ".join(base), "en", "s1"), (51, " ".join(near), "en", "s1"), (52, "12345 !!", None, "s1"), (53, None, None, "s0"), (54, words(7, 80) + " write to me@host.org now", "en", "s2")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))


def test_stages_take_effect(spark):
    docs, kept = corpus(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == COLUMNS
        kept[name] = docs.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert ids["language"] == {*range(20), 50, 51, 54}
    assert ids["near_duplicates"] == {*range(20), 50, 54}
    assert "<email>" in next(r.text for r in kept["private"] if r.doc_id == 54)
    assert {r.text for r in kept["private"] if r.doc_id < 50} == {r.text for r in kept["near_duplicates"] if r.doc_id < 50}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == len(kept["mixture"]) and all(r.n_tokens > 0 for r in last)


def test_null_and_repeated_ids_keep_their_documents(spark):
    base = words(1, 200).split()
    near = " ".join(base[:100] + ["other"] + base[101:])
    rows = [(None, words(2, 60), "s0"), (None, words(3, 60), "s0"), (7, words(4, 60), "s0"), (7, words(5, 50), "s1"), (7, words(5, 50), "s0"), (None, " ".join(base), "s1"), (9, near, "s1"), (8, near, "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_duplicates"](spark, docs, "")
    shown = lambda df: sorted(((-1 if r.doc_id is None else r.doc_id), r.text, r.source) for r in df.collect())
    assert kept.columns == COLUMNS
    assert shown(kept) == sorted([(-1, words(2, 60), "s0"), (-1, words(3, 60), "s0"), (7, words(4, 60), "s0"), (7, words(5, 50), "s0"), (8, near, "s1")])
    # a source that is taken three times over: every row of it, whatever its id
    rows = [(None, words(20 + i, 20), "a") for i in range(3)] + [(7, words(30 + i, 20), "a") for i in range(3)] + [(7, words(30, 20), "a")] + [(100 + i, words(40 + i, 40), "b") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], docs.schema).repartition(3)
    mixed = stages["mixture"](spark, docs, "")
    assert mixed.columns == COLUMNS
    got = shown(mixed.where("source = 'a'"))
    assert got == sorted([((-1 if i is None else i), t, s) for i, t, s in rows if s == "a"] * 3)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def supplied(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").repartition(3).cache()


def told(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_language_stage_against_the_model(spark, supplied):
    model = langid.fit(supplied, F.lit(True))
    scorer, wanted = langid.Scorer(model), Counter()
    for r in supplied.collect():
        lang, score = scorer.texts([r.text])[0]
        if lang != "und" and score >= corpus_pipeline.SURE:
            wanted[(r.doc_id, r.text, r.lang or lang, r.source, r.n_chars)] += 1
    assert told(dict(corpus_pipeline.STAGES)["language"](spark, supplied, SF).collect()) == wanted


def test_near_duplicates_against_brute_force(spark, supplied):
    rows = supplied.collect()
    sets = [shingle_sets([(0, r.text)], 5)[0] for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        least[g] = min(least.get(g, r), r, key=lambda x: x.doc_id)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, supplied, SF).collect()
    assert told(got) == told(least.values()) and len(got) < len(rows)


def test_private_against_brute_force(spark, supplied):
    wanted = Counter()
    for r in supplied.collect():
        text, at = "", 0
        for kind, a, b in (x.split(":") for x in pii_brute(r.text)):
            if int(a) >= at:
                text += r.text[at : int(a)] + f"<{kind}>"
            at = max(at, int(b))
        text += (r.text or "")[at:]
        wanted[(r.doc_id, text if r.text is not None else None, r.lang, r.source, len(text) if r.text is not None else None)] += 1
    got = told(dict(corpus_pipeline.STAGES)["private"](spark, supplied, SF).collect())
    # so few seeds support no pattern, so nothing is masked but what the base finds
    assert got == wanted


def test_mixture_against_the_mix(spark, supplied):
    got = told(dict(corpus_pipeline.STAGES)["mixture"](spark, supplied, SF).collect())
    rows = {r.doc_id: r for r in supplied.collect()}
    assert len(rows) == supplied.count()
    wanted = Counter()
    for r in mixing.mix(supplied).collect():
        if r["size"]:
            wanted[tuple(rows[r.doc_id][c] for c in COLUMNS)] += int(r.taken / r["size"] + 0.5)
    assert got == +wanted


def test_tokens_against_the_library(spark, supplied):
    library = Tokenizer.from_str(tokenizer_json())
    library.no_truncation()
    library.no_padding()
    wanted = Counter()
    for r in supplied.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        wanted[(r.doc_id, len(ids), digest(b"".join(i.to_bytes(4, "little") for i in ids)), digest(library.decode(ids, skip_special_tokens=False).encode()))] += 1
    got = dict(corpus_pipeline.STAGES)["tokens"](spark, supplied, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == wanted


def test_odd_tables_pass_every_stage(spark, odd, none):
    """Rows are accounted for: what each stage may drop is dropped, and nothing else; clashing columns stay as they are."""
    texts = Counter(r.text for r in odd.collect())
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, odd, "")
    assert kept.columns == odd.columns
    assert {r.text for r in kept.collect()} <= {t for t in texts if t and any(c.isalpha() for c in t)}
    unique = stages["near_duplicates"](spark, odd, "")
    assert unique.columns == odd.columns
    left = Counter(r.text for r in unique.collect())
    wordless = {t for t in texts if not (t or "").split()}
    # of texts that link with nothing, one row an id; of each group of near copies, one
    assert set(left) >= wordless and all(left[t] <= texts[t] for t in left)
    masked = stages["private"](spark, odd, "").collect()
    assert len(masked) == sum(texts.values()) and Counter(r.text for r in masked)[None] == texts[None]
    mixed = stages["mixture"](spark, odd, "")
    assert mixed.columns == odd.columns and {r.text for r in mixed.collect()} <= {t for t in texts if (t or "").split()}
    assert stages["tokens"](spark, odd, "").count() == sum(texts.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name


def test_names():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "private", "mixture", "tokens"]


def test_stages_get_batches_of_few_texts_and_leave_a_number_that_is_set(spark):
    key, rows = corpus_pipeline.BATCH
    spark.conf.unset(key)
    try:
        corpus_pipeline.tokens(spark, corpus(spark), "")
        assert spark.conf.get(key) == str(rows)
        spark.conf.set(key, "77")
        corpus_pipeline.tokens(spark, corpus(spark), "")
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.unset(key)
