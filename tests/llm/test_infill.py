import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.llm import infill

LETTERS = [*"<>PSM\nab", "<P>", "<S>", "\n\n", "é", "\U0001f600"]
HEX = lambda t: hashlib.sha256(t.encode()).hexdigest()


def step(state, ch):
    """The automaton, one character at a time."""
    pending = state % 4
    if pending != 3:
        pending = 3 if pending == 2 and ch == ">" else 2 if pending == 1 and ch in "PSM" else 1 if ch == "<" else 0
    return pending + 4 * (ch == "\n")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), min_size=1, max_size=12).map("".join))
def test_functions_of_chunks(text):
    exits, counts = infill.scan(text)
    for entry in range(8):
        state, begun = entry, 0
        for ch in text:
            begun += state >= 4
            state = step(state, ch)
        assert (exits[entry], counts[entry]) == (state, begun)


def brute(doc_id, text, rate=100, spm=50):
    lines = re.findall("[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, HEX(text), HEX(text)
    p, m, s = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), HEX(out), HEX(text)


@pytest.mark.parametrize("chunk,composed,rate", [(7, 3, 100), (100, 256, 60), (1 << 16, 256, 100)])
def test_report_equals_brute_force(make_docs, odd_rows, chunk, composed, rate, monkeypatch):
    import random

    monkeypatch.setattr(infill, "COMPOSED", composed)
    rng = random.Random(6)
    rows = [r for r in odd_rows if len(r[1] or "") < 20_000 or chunk > 50]
    rows += [(1000 + i, "".join(rng.choice(LETTERS[:8] if i % 3 else LETTERS) for _ in range(rng.randint(0, 60))), "s") for i in range(150)]
    rows += [(2000 + i, "".join(rng.choice([*"ab<>PS", "\n", "\n", "é"]).replace("S", "x") for _ in range(rng.randint(0, 300))), "s") for i in range(40)] + [(1, "a\nb\n" * 30, "s")] * 2 + [(2, "\n" * 50, "s"), (3, "x" * 90_000 + "\ny", "s")][: 2 if chunk > 50 else 1]
    got = infill.infill_report(make_docs(rows).repartition(5), chunk=chunk, rate=rate).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(i, t or "", rate) for i, t, _ in rows), key=str)


def test_pieces_give_the_outputs(make_docs):
    docs = make_docs([(i, f"line {i}\n" * 40, "s") for i in range(20)])
    whole, cut = {}, {}
    for r in infill.fill_in_middle(docs).collect():
        whole[r["doc_id"]] = r["output"]
    for r in sorted(infill.fill_in_middle(docs, chunk=50).collect(), key=lambda r: r["piece"]):
        cut.setdefault(r["doc_id"], []).append(r["output"])
    assert {i: "".join(x) for i, x in cut.items()} == whole and max(map(len, cut.values())) > 5
    assert max(len(x) for p in cut.values() for x in p) <= 50


def test_empty_table(make_docs, odd_rows):
    assert infill.infill_report(make_docs(odd_rows).limit(0)).count() == 0
