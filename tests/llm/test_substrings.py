import hashlib
import random
from collections import Counter

from voxlake.llm import substrings


def brute(texts, window):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_of_all_kinds(make_docs):
    for seed in range(3):
        rng = random.Random(seed)
        letters = "ab" if seed == 1 else "abcdefé "
        base = "".join(rng.choice(letters) for _ in range(500))
        texts = []
        for _ in range(50):
            kind = rng.random()
            if kind < 0.3:
                t = base[rng.randint(0, 250) : rng.randint(250, 500)]
            elif kind < 0.5:
                c = list(base)
                for _ in range(rng.randint(1, 8)):
                    c[rng.randrange(500)] = rng.choice(letters)
                t = "".join(c)
            elif kind < 0.6:
                t = "a" * rng.randint(0, 150)
            elif kind < 0.7:
                t = ("abc" * 80)[: rng.randint(0, 240)]
            else:
                t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) + base[90 : 90 + rng.randint(0, 80)]
            texts.append(t)
        texts += [texts[0], None, "", "abc"]
        got = {r["doc_id"]: r for r in substrings.repeat_report(make_docs([(i, t, "s") for i, t in enumerate(texts)]).repartition(3), window=40, gram=10).collect()}
        for i, want in enumerate(brute([(t or "").encode() for t in texts], 40)):
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.repeat_report(docs).collect())
    assert got == sorted(brute([(t or "").encode() for _, t, _ in odd_rows], 400))
    out = substrings.remove_repeats(docs)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[301]["text"] == "" and texts[301]["n_chars"] == 0 and texts[200]["text"] is None


def test_very_long_text_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 64)
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(3000))
    texts = [t, t[100:1500] + "x" + t[1600:], "zz" + t[700:900]]
    got = {r["doc_id"]: r for r in substrings.repeat_report(make_docs([(i, x, "s") for i, x in enumerate(texts)]), window=40, gram=10).collect()}
    for i, want in enumerate(brute([x.encode() for x in texts], 40)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


def test_empty_table(make_docs, odd_rows):
    assert substrings.repeat_report(make_docs(odd_rows).limit(0)).count() == 0


def test_two_sizes_and_crowded_anchors(make_docs, monkeypatch):
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    texts = [word(rng.randint(0, 60)) + line[rng.randint(0, 12) : rng.randint(30, 70)] + word(rng.randint(0, 90)) for _ in range(60)]
    texts += [texts[3] + "q" + texts[4], texts[7], texts[7] + "tail", None, ""]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)]).repartition(3)
    wide, narrow = (brute([(t or "").encode() for t in texts], k) for k in (40, 25))
    original = substrings.repeated_spans
    for crowd in (substrings.CROWD, 2):
        monkeypatch.setattr(substrings, "repeated_spans", lambda *a, crowd=crowd: original(*a, crowd=crowd))
        for r in substrings.repeat_report(docs, window=40, gram=8, passage=25).collect():
            i = r["doc_id"]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == wide[i]
            assert (r["n_passage_bytes"], r["has_passage"]) == (narrow[i][1], narrow[i][1] > 0)


def test_a_hot_anchor_is_salted(spark):
    left = spark.range(6000).selectExpr("if(id < 4000, 1, id) as anchor", "id as place")
    right = left.groupBy("anchor").count().withColumnRenamed("count", "n")
    got = substrings.salted_join(left, right, "anchor", "n", ["place"])
    assert got.count() == 6000 and got.select("place").distinct().count() == 6000
