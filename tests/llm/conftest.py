from __future__ import annotations

import random

import pytest

WORDS = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta", "eta.", "Theta", "iota", "kappa", "日本", "mu"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text, n_words, lang): nulls, empties, ties, repeats, a long text, near copies, clashing columns."""
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    shared = prose(rng, 60)
    rows = [None, "", "   \n\t ", "one", "ONE", "two words", base, base, " ".join(near), base.upper(), prose(rng, 6000), "a" * 5000]
    rows += [f"{prose(rng, 40)} {shared}\n{prose(rng, 30)}" for _ in range(4)]
    rows += ["loop " * 90, "line of words again\n" * 40, "x y " * 35]
    for k in range(12):  # a star: copies of one original, each with its own changes
        w = base.split(" ")
        for at in rng.sample(range(120), k % 5 * 2):
            w[at] = f"w{k}x{at}"
        rows.append(" ".join(w))
    rows += [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    return [(i * 3 + 1, t, "clash", "en") for i, t in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, n_words string, lang string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_words string, lang string")
