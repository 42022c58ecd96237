import itertools
import random

import numpy as np
import pyarrow as pa

from voxlake.llm import jaccard

from .conftest import prose


def brute(rows):
    sets = []
    for i, t, _ in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and i is not None else frozenset())
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, least[find(k)] if i is not None else None, links[k]) for k, (i, _, _) in enumerate(rows)]


def found(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()), key=str)


def test_odd_rows(make_docs, odd_rows):
    assert found(jaccard.jaccard_join(make_docs(odd_rows))) == sorted(brute(odd_rows), key=str)


def test_groups_larger_than_a_tile(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "NODE_TILE", 16)
    rng = random.Random(5)
    base = prose(rng, 150).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    rows += [(1000 + i, prose(rng, 100), "s") for i in range(40)]
    assert found(jaccard.jaccard_join(make_docs(rows))) == sorted(brute(rows), key=str)


def test_one_of_each_group_stays(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {i for i, c, _ in brute(odd_rows) if i is not None and i == c}
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want) and ids.count(None) == 2


def test_empty_table(make_docs, odd_rows):
    assert jaccard.jaccard_join(make_docs(odd_rows).limit(0)).count() == 0


def test_trie_nodes_are_the_shared_prefixes():
    rng = np.random.default_rng(2)
    rows = sorted((int(t), tuple(int(x) for x in p), i) for i, (t, p) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 3, (300, 4)), strict=True)))
    schema = pa.schema([("tree", pa.int16()), ("path", pa.binary()), ("id", pa.int64())])
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int16()), pa.array([np.array(r[1], ">u2").tobytes() for r in part], pa.binary()), pa.array([r[2] for r in part])], schema=schema) for part in (rows[k : k + size] for k in range(0, 300, size))]
        got = {}
        for b in jaccard.trie_nodes(4, 2)(iter(batches)):
            for d, node, _, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault((d, node), set()).add(i)
        want = {}
        for t, path, i in rows:
            for d in (2, 3, 4):
                want.setdefault((d, t, path[:d]), set()).add(i)
        assert sorted((k[0], sorted(v)) for k, v in got.items()) == sorted((k[0], sorted(v)) for k, v in want.items() if len(v) > 1)


def planted(rng, share, n=400):
    """Pairs of texts that have about a share of their shingles in common."""
    rows = []
    for i in range(n):
        w = prose(rng, 200, 10**6).split()
        v = list(w)
        cut = round(196 * (1 - 2 * share / (1 + share)))
        v[:cut] = prose(rng, cut, 10**6).split()
        rows += [(2 * i, " ".join(w), "s"), (2 * i + 1, " ".join(v), "s")]
    return rows


def test_prefixes_shorten_until_the_recall(make_docs, monkeypatch):
    rng = random.Random(3)
    rounds = []
    original = jaccard.found_share
    monkeypatch.setattr(jaccard, "found_share", lambda links, width, trees, prefix, threshold: rounds.append(prefix) or original(links, width, trees, prefix, threshold))
    for share, last in ((0.97, 6), (0.82, 4)):
        rounds.clear()
        got = jaccard.jaccard_join(make_docs(planted(rng, share))).collect()
        assert sum(r["n_links"] == 1 for r in got) >= 0.995 * 800
        assert rounds == list(range(6, rounds[-1] - 1, -1)) and (rounds[-1] == last if share > 0.9 else rounds[-1] <= last)


def test_rows_of_one_id_are_decided_each(make_docs):
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 100) for _ in range(4))
    near = a.split()
    near[50] = "changed"
    rows = [(1, a, "s"), (5, " ".join(near), "copy of 1"), (5, b, "clean"), (6, c, "s"), (6, d, "s"), (7, c + " ", "s"), (8, d, "s"), (8, d, "s"), (9, None, "s"), (9, "", "s"), (10, prose(rng, 60), "s")]
    kept = sorted((r["doc_id"], r["source"], r["text"] or "") for r in jaccard.keep_one(make_docs(rows)).collect())
    assert kept == sorted((i, s, t or "") for i, t, s in [rows[0], rows[2], rows[3], rows[4], rows[8], rows[9], rows[10]])
