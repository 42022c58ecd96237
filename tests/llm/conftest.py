import random

import pytest

EXTRA = "size string, block int, shard double, __src string, n long, class string, chunk string, node int"
CLASH = ("x", 1, 2.0, "y", 3, "z", "w", 4)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text, source), with extra columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *CLASH) for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(8)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, prose(rng, rng.randint(20, 200)), f"s{i % 3}") for i in range(30)]
    rows += [(100, base, "s0"), (101, base, "s1"), (102, " ".join(near), "s2"), (102, " ".join(near), "s2")]
    rows += [(200, None, "s0"), (201, "", None), (202, "   \n\t ", "s1"), (203, "one", "s1"), (204, "one", None), (None, base, "s0"), (None, None, None)]
    rows += [(300, prose(rng, 60_000, 50_000), "s1"), (301, "a" * 3000, "s2"), (302, "é中\U0001f600 " * 40, "s2")]
    return rows
