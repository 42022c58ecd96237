import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    around = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(around[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def typos(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcé") + word[i:], word[:i] + rng.choice("abcé") + word[i + 1 :]])


@pytest.mark.parametrize("tile", [3, 2048])
def test_variants_equal_brute_force(make_docs, odd_rows, tile):
    rng = random.Random(3)
    stems = ["abababab", "aaaaaaaa", "aaaaaaa", "Élèveraient", "CONNECTION", "bcbcbcb", *("".join(rng.choice("abcé") for _ in range(rng.randint(7, 10))) for _ in range(25))]
    words = [*stems, *(typos(rng, s) for s in stems * 12), *(typos(rng, typos(rng, s)) for s in stems * 4)]
    weight = [rng.choice([1, 2, 3, 40, 500]) for _ in words]
    rows = odd_rows + [(i if i % 9 else None, " ".join(rng.choices(words, weight, k=200)) + rng.choice([" É×÷é", "-", ""]), "s") for i in range(120)] + [(7, "zzzzzzz1zzzzzzz_zzzzzzz", "s")] * 2
    got = spelling.group_variants(make_docs(rows).repartition(5), tile=tile).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0]) and sum(r[3] is not None for r in want) > 20


@given(st.text("abé", min_size=1, max_size=6), st.text("abé", min_size=1, max_size=6))
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == near(a, b)


@given(st.lists(st.integers(1, 6), max_size=8), st.integers(1, 9))
def test_pairs_of_groups(size, most):
    got = [(int(a), int(b)) for i, j in spelling.pairs_of(np.array(size, int), most) for a, b in zip(i, j, strict=True)]
    ends = np.cumsum([0, *size])
    assert sorted(got) == sorted((a, b) for lo, hi in zip(ends, ends[1:], strict=False) for a in range(lo, hi) for b in range(a + 1, hi)) and len(got) == len(set(got))


def test_chains_of_forms_are_followed(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(19)] + [("x", "y")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.last_forms(forms).collect()} == {**{f"w{i:02}": "w19" for i in range(19)}, "x": "y"}


def test_one_key_of_very_many_words(spark):
    """All words share their rarest bigrams: tiles split the key and no pair is lost."""
    rng = random.Random(1)
    words = sorted({"qzj" + "".join(rng.choice("ab") for _ in range(9)) for _ in range(600)})
    rows = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(r["a"], r["b"]) for r in spelling.near_words(rows, tile=16).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}
    tiles = spelling.join_keys(rows).groupBy("key").count().agg(F.max("count")).first()[0]
    assert tiles > 16


def test_many_letters(spark):
    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéïöü") for _ in range(rng.randint(7, 11))) for _ in range(150)]
    letters = "abcdefghijklmnopqrstuvwxyzàéïöü"
    words = {*stems}
    for s in stems * 3:
        i = rng.randrange(len(s))
        words.add(rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i:], s[:i] + rng.choice(letters) + s[i + 1 :]]))
    words = sorted(w for w in words if len(w) >= 7)
    got = {(r["a"], r["b"]) for r in spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)} and len(got) > 300


def test_empty_table(make_docs, odd_rows):
    assert spelling.group_variants(make_docs(odd_rows).limit(0)).count() == 0
