import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, leaf int"


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "ti", "on", "é", "the", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: nulls, empty, blank, very long, copies, near
    copies, shared passages, periodic text, odd blanks."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 120)) for _ in range(30)]
    passage = words(rng, 60)
    texts = [None, "", "  \n ", "two words", words(rng, 8000), "ab " * 400, "x" * 300, "a  b \n\n c\t d", "it's <|endoftext|> 12.5 ü 漢字 🙂 ▁"]
    texts += base + base[:4] + base[:1] * 3
    texts += [" ".join(w if i != 7 else "changed" for i, w in enumerate(t.split(" "))) for t in base[4:8]]
    texts += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(6)]
    texts += ["line one is here again\n" * 12 + words(rng, 10), words(rng, 40).upper() + "!!"]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With nulls in every column, extra columns whose names operators use, a
    repeated row and a row without an id."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", None if t is None else len(t), "x", i) for i, t in corpus]
    rows += [rows[12], (None, "a text without an id " * 10, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
