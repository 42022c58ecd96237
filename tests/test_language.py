"""Back-off models of order 3 against plain dictionaries; subwords against naive merging."""

import math
import random

import pytest

from voxlake.operators import language as L
from voxlake.operators import text as X


def model_of(rng):
    """A random back-off model whose n-grams have all their parts."""
    words = ["a", "b", "c", "d"]
    m = {(w,): 0.25 for w in words}
    for h in words:
        for w in rng.sample(words, 2):
            m[h, w] = rng.uniform(0.1, 0.4)
    for h in [k for k in m if len(k) == 2]:
        for w in [w for w in words if (h[1], w) in m][:1]:
            m[(*h, w)] = rng.uniform(0.2, 0.7)
    return m


def bows(m):
    out = {}
    for k in sorted({g[:-1] for g in m if len(g) > 1}, key=len):
        seen = [g for g in m if g[:-1] == k]
        out[k] = (1 - sum(m[g] for g in seen)) / (1 - sum(prob(m, out, g[1:]) for g in seen))
    return out


def prob(m, bow, g):
    return m[g] if g in m else bow.get(g[:-1], 1.0) * prob(m, bow, g[1:])


def joint(m, bow, h):
    return math.prod(prob(m, bow, h[: i + 1]) for i in range(len(h)))


def prune(m, threshold):
    m = dict(m)
    for n in (3, 2):
        bow = bows(m)
        gone = []
        for g in [g for g in m if len(g) == n]:
            less = {k: v for k, v in m.items() if k != g}
            seen = [k for k in less if k[:-1] == g[:-1]]
            low = prob(m, bow, g[1:])
            new = (1 - sum(m[k] for k in seen)) / (1 - sum(prob(m, bow, k[1:]) for k in seen))
            left = 1 - sum(m[k] for k in seen) - m[g]
            d = -joint(m, bow, g[:-1]) * (m[g] * (math.log(low * new) - math.log(m[g])) + left * (math.log(new) - math.log(bow[g[:-1]])))
            if math.exp(d) - 1 < threshold and not any(k[:-1] == g for k in m if len(k) == n + 1):
                gone.append(g)
        m = {k: v for k, v in m.items() if k not in gone}
    return m, bows(m)


def frame(spark, m):
    rows = [(len(g), " ".join(g[:-1]), g[-1], math.log(p)) for g, p in m.items()]
    return L.with_weights(spark.createDataFrame(rows, "n int, hist string, word string, logp double"), 3)


def test_pruning_lookup_and_totals(spark):
    m = model_of(random.Random(2))
    model = frame(spark, m)
    bow = bows(m)
    ask = [(h, w) for h in ("", "a", "b a", "c d", "d d") for w in "abcd"]
    got = L.log_probability(spark.createDataFrame(ask, "hist string, word string"), model, 3).collect()
    assert len(got) == len(ask) and all(r["logp"] == pytest.approx(math.log(prob(m, bow, (*r["hist"].split(), r["word"])))) for r in got)
    assert all(r["total"] == pytest.approx(1.0) for r in L.normalization(model, 3).collect())
    kept, weights = prune(m, 0.003)
    assert 4 < len(kept) < len(m)
    out = {(*r["hist"].split(), r["word"]): r for r in L.prune(model, 3, 0.003).collect()}
    assert set(out) == set(kept)
    for g, r in out.items():
        assert (r["bow"] is None) == (g not in weights) and (g not in weights or r["bow"] == pytest.approx(math.log(weights[g])))
    wrong = model.withColumn("bow", model["bow"] + 0.1)
    assert any(abs(r["total"] - 1) > 0.01 for r in L.normalization(wrong, 3).collect())


def test_subwords(spark):
    merges = [("l", "o"), ("lo", "w</w>"), ("e", "r</w>"), ("lo", "w"), ("n", "e"), ("ne", "w")]
    rows = spark.createDataFrame([(1, "low lower newlow xUSAlow")], "id long, text string")
    cut = lambda **o: X.apply_bpe(rows, "id", "text", merges, **o).first()["text"]
    assert cut() == "low low@@ er new@@ low x@@ U@@ S@@ A@@ low"
    assert cut(glossaries=["USA"]).endswith("x@@ USA@@ low")
    assert cut(vocabulary={"low", "lo@@", "w@@", "er", "ne@@", "x@@"}) == "low lo@@ w@@ er ne@@ w@@ low x@@ U@@ S@@ A@@ low"


def test_weights_of_contexts_that_are_no_n_grams(spark):
    """b is a context without a probability of its own: its weight holds all the same where it is filled in, so that its total is one."""
    rows = [(1, "", "a", 0.6), (1, "", "</s>", 0.4), (2, "a", "</s>", 0.7), (2, "b", "a", 0.5)]
    m = spark.createDataFrame([(n, h, w, math.log(p)) for n, h, w, p in rows], "n int, hist string, word string, logp double")
    total = lambda **how: {r["hist"]: round(r["total"], 9) for r in L.normalization(L.with_weights(m, 2, **how), 2).collect()}
    assert total(fill=True) == {"": 1.0, "a": 1.0, "b": 1.0}
    assert total() == {"": 1.0, "a": 1.0, "b": 0.9}


def test_changes_leave_out_histories_without_a_probability(spark, monkeypatch):
    """A word whose share rounds to nothing is no unigram; n-grams after it have no change, as in the SQL's join."""
    from pyspark.sql import functions as F

    from voxlake.plans import PLANS
    from voxlake.plans import text_queries as T

    p = [(1, "", "a", 0.5), (1, "", "b", 0.0), (1, "", "</s>", 0.5), (2, "<s>", "a", 0.6), (2, "a", "</s>", 0.7), (2, "b", "a", 0.4)]
    monkeypatch.setattr(T.X, "kn_probabilities", lambda *_: spark.createDataFrame([(*r, 0.0) for r in p], "n int, hist string, word string, f double, left double"))
    got = PLANS.queries["e09_perplexity_changes"](spark, "/root/testdata/sf0.001").filter(F.col("change").isNotNull())
    assert sorted((r["hist"], r["word"]) for r in got.collect()) == [("<s>", "a"), ("a", "</s>")]


def test_lookup_of_long_histories_and_unknown_words(spark):
    """A trigram asked of a bigram model is found under its last words; words without a unigram count as the unknown one, in the history too."""
    m = {("a",): 0.5, ("b",): 0.3, (L.UNK,): 0.2, ("a", "b"): 0.6, (L.UNK, "a"): 0.7}
    bow = bows(m)
    rows = [(len(g), " ".join(g[:-1]), g[-1], math.log(p)) for g, p in m.items()]
    model = L.with_weights(spark.createDataFrame(rows, "n int, hist string, word string, logp double"), 2)
    as_known = lambda w: w if (w,) in m else L.UNK
    ask = [(h, w) for h in ("", "a", "b a", "a a a", "a z", "z a", "y z") for w in ("a", "b", "z")]
    want = {(h, w): math.log(prob(m, bow, tuple(map(as_known, (*h.split()[-1:], w))))) for h, w in ask}
    got = L.lookup(spark.createDataFrame(ask, "hist string, word string"), model, 2).collect()
    assert {(r["hist"], r["word"]): pytest.approx(r["logp"]) for r in got} == want and len(got) == len(ask)
    raw = L.log_probability(spark.createDataFrame([("b a", "b"), ("a b", "z")], "hist string, word string"), model, 2).collect()
    assert {r["word"]: r["logp"] for r in raw} == {"b": pytest.approx(math.log(0.6)), "z": L.UNKNOWN}
