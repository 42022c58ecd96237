import random
import re

from voxlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + 5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_measures(make_docs, odd_rows):
    rng = random.Random(3)
    rows = odd_rows + [(5000 + i, "\n".join(" ".join(rng.choice("abcdefgh#") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30))), "s") for i in range(80)]
    got = quality.measure(make_docs(rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    key = lambda x: str(x)
    assert sorted([(r["doc_id"], *[r[n] for n in names]) for r in got.collect()], key=key) == sorted([(i, *brute(t)) for i, t, _ in rows], key=key)
    assert all(not (r["kept"] and r["base_failed"]) for r in got.collect())
    assert quality.measure(make_docs(rows).limit(0)).count() == 0


def test_many_different_words():
    rng = random.Random(1)
    words = [f"w{rng.randrange(9000)}" for _ in range(30_000)] * 2
    assert quality.Text(" ".join(words)).n_repeat_words == brute(" ".join(words))[4]


def test_clean_text_stays_and_junk_goes(make_docs):
    rng = random.Random(6)
    clean = " ".join(rng.choice("the of and river stone green walking house table window letters paper morning".split()) + str(rng.choice("abcdefgh")) for _ in range(300))
    rows = [(1, clean, "s"), (2, " ".join(w + "***" for w in clean.split()), "s"), (3, clean[:30] + "\n" + "\n".join(["buy now and save"] * 60), "s"), (4, None, "s")]
    docs = make_docs(rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1}
    assert {r["doc_id"] for r in quality.measure(docs).filter("kept").collect()} == {1}


def test_order_changes_no_verdict(make_docs, odd_rows):
    for t in (t for _, t, _ in odd_rows):
        assert quality.passes(quality.Text(t), quality.RULES) == quality.passes(quality.Text(t), quality.RULES[::-1])


def test_plan_puts_cheap_rejecting_rules_first(make_docs):
    import time

    def slow(t):
        time.sleep(0.002)
        return False

    docs = make_docs([(i, "x y z", "s") for i in range(50)])
    assert quality.plan_cascade(docs, [("slow", slow), ("rejects", lambda t: True)]) == [1, 0]
