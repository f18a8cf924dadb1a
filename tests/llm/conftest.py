"""Small tables that hold every odd case: nulls, empty, blank, long, repeated and tied rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, size long, label int, block long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \t\n ", "one", "two words", base, base, " ".join(near), words(2, 3000), "x" * 70_000, "Ünïcödé ßtraße ΑΣ Σ 漢字かな 🎉 é", "<|startoftext|> inside <|endoftext|>",
        "mail a.b@c.de, +1 (212) 555-0100 and 4111 1111 1111 1111 from 10.0.0.255; not 999.1.1.1", base + " tail", "word " * 400, words(3, 90) + " " + base[:400] + " " + words(4, 90), words(5, 90) + " " + base[:400],
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "c")[i % 4], None, "k", 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [(5, base, "en", "b", 1, "k", 1, 2, 3, 4), (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
