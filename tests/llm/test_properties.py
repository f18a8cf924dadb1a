"""Properties over generated inputs, without Spark."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import bpe, ngram_join, ogg, suffix_dedup
from tallyloom.llm.registry import tokenizer_json

LIBRARY = Tokenizer.from_str(tokenizer_json())
OWN = bpe.parsed(tokenizer_json())
texts = st.text(max_size=60) | st.text(alphabet=st.sampled_from("aAbz'sStTdD 1٣²½Ⅷ \t\n\x1c\x85\xa0 ééÇ漢ΑΣσςİıß!?<|>-_🎉‍ﬁẞ"), max_size=80)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_bpe_of_any_text(text):
    wanted = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(OWN.encode(text), "<u4")) == wanted
    assert OWN.decode(OWN.encode(text)) == LIBRARY.decode(wanted, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 1200), st.integers(0, 9))
def test_media_of_any_size(units, seed):
    payload = random.Random(seed).randbytes(64 * units)
    assert ogg.feature_of(ogg.multiplexed(payload))[0] == payload


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=120).map(str.encode), min_size=1, max_size=30))
def test_order_of_any_strings(strings):
    order, _ = suffix_dedup.deep_shallow(strings, 0)
    assert [strings[i] for i in order] == sorted(strings)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=25), min_size=2, max_size=12), st.sampled_from([(90, 100), (80, 100), (50, 100)]))
def test_t_occurrence_finds_all_links(sets, bound):
    num, den = bound
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    known = ngram_join.Forest(len(sets))
    ngram_join.t_occurrence(arrays, list(range(len(sets))), num, den, known)
    plain = ngram_join.Forest(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i < j and den * len(a & b) >= num * len(a | b):
                plain.join(i, j)
    assert [known.root(i) for i in range(len(sets))] == [plain.root(i) for i in range(len(sets))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b\x0c\r\x1cé", max_size=40))
def test_words_are_runs_of_anything_but_ascii_space(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [w.decode() for w in text.encode().lower().split()] == words


def near_copies(n, share, seed):
    """Sets of n copies of one text of 380 words, each word replaced with probability share."""
    rng = random.Random(seed)
    base = [rng.getrandbits(40) for _ in range(380)]
    shingler = ngram_join.Shingler(5)
    return [shingler(" ".join(str(rng.getrandbits(40) if rng.random() < share else w) for w in base)) for _ in range(n)]


@pytest.mark.parametrize("probed, steps", [(0, 1 << 18), (0, 50), (10, 50), (1 << 40, 1 << 18)])
def test_t_occurrence_by_probes_and_by_counts(monkeypatch, probed, steps):
    monkeypatch.setattr(ngram_join, "PROBED", probed)
    monkeypatch.setattr(ngram_join, "STEPS", steps)
    arrays = near_copies(40, 0.02, 3) + near_copies(20, 0.005, 4)
    known, plain = ngram_join.Forest(60), ngram_join.Forest(60)
    ngram_join.t_occurrence(arrays, list(range(60)), 80, 100, known)
    for i in range(60):
        for j in range(i):
            if 100 * len(np.intersect1d(arrays[i], arrays[j])) >= 80 * len(np.union1d(arrays[i], arrays[j])):
                plain.join(i, j)
    assert [known.root(i) for i in range(60)] == [plain.root(i) for i in range(60)]
    assert 2 < len({known.root(i) for i in range(60)}) < 60


def test_a_block_of_near_copies_that_are_apart_takes_no_merge_a_pair():
    arrays = near_copies(600, 0.02, 1)  # 20 s of CPU as a heap merged the lists, 1 s since
    known, began = ngram_join.Forest(600), time.process_time()
    ngram_join.t_occurrence(arrays, list(range(600)), 80, 100, known)
    assert 2 < len({known.root(i) for i in range(600)}) < 600
    assert time.process_time() - began < 8
