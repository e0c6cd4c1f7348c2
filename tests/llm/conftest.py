import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, t string"


@pytest.fixture
def docs(spark):
    """A table of documents from (id, text) or (id, text, source), with columns
    that clash with names used inside the operators."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def prose():
    import random

    rng = random.Random(3)
    return lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def odd(prose):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    long = "\n".join(prose(60) for _ in range(300))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, long), (6, long), (6, long), (None, "null id text " * 30), (7, "é" * 50 + "\n" + "é" * 50), (8, "a\x0bb c d")]
