import random

import pytest

from voxlake.operators import intervals as I

ROW = "file_id string, onset_ms long, offset_ms long"


def runs(marks):
    """Blocks of intervals that touch."""
    out = []
    for b, e in sorted(x for x in marks if x[1] > x[0]):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def brute(zones, words, segments, extend, horizon):
    """Milliseconds that are excluded, found by stepping from each zone's edge."""
    lex, bounds, blocks = runs(words), {t for b, e in segments if e > b for t in (b, e)}, runs(zones)
    out = set()
    for b, e in blocks:
        left = b
        while left > b - extend and not (left in bounds or any(x[1] == left for x in lex) or (left == b and any(x[0] <= b < x[1] for x in lex))):
            left -= 1
        right = e
        while right < e + extend and not (right in bounds or any(x[0] == right for x in lex) or (right == e and any(x[0] < e < x[1] for x in lex))):
            right += 1
        later = any(t >= e for t in bounds) or any(x[0] >= e or x[1] > e for x in lex) or any(x[0] > e for x in blocks)
        out |= set(range(left, right if later else horizon))
    return out


@pytest.mark.parametrize("bucket", [13, 600_000])
def test_zones_equal_stepping(spark, bucket):
    rng = random.Random(bucket)
    z, w, s, uem = [], [], [], []
    for f in range(30):
        name = f"f{f}"
        draw = lambda n, most: [(b, b + rng.randint(0, most)) for b in (rng.randrange(200) for _ in range(n))]
        z += [(name, *x) for x in draw(rng.randint(1, 5), 20)]
        w += [(name, *x) for x in draw(rng.randint(0, 6), 8)]
        s += [(name, *x) for x in draw(rng.randint(0, 3), 40)]
        uem.append((name, 0, 260))
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    zones = I.extended_zones(frame(z), frame(w), frame(s), ["file_id"], 9, bucket)
    got = {}
    for r in I.without_zones(frame(uem), zones, ["file_id"]).collect():
        got.setdefault(r["file_id"], set()).update(range(r["onset_ms"], r["offset_ms"]))
    for f in {r[0] for r in uem}:
        own = lambda rows: [r[1:] for r in rows if r[0] == f]  # noqa: B023, E731
        assert got.get(f, set()) == set(range(260)) - brute(own(z), own(w), own(s), 9, 260), f


def test_noscore_and_nonlex_side_by_side(spark):
    f = lambda rows: spark.createDataFrame([("f", *r) for r in rows], ROW)
    got = I.extended_zones(f([(1000, 2000), (2600, 3000), (9000, 9100), (9100, 9100)]), f([(3300, 3600), (8800, 9050)]), f([(0, 12_000)]), ["file_id"], 500).collect()
    assert sorted((r["onset_ms"], r["offset_ms"]) for r in got) == [(500, 2500), (2100, 3300), (9000, 9600)]
    assert I.extended_zones(f([(1, 2)]).limit(0), f([(1, 2)]), f([(1, 2)]), ["file_id"], 5).count() == 0


def fold(utts, words):
    """Utterances one after another, as lists."""
    order = sorted((u for u in utts if words.get(u[0])), key=lambda u: (u[1], u[0]))
    held = {u[0]: list(words[u[0]]) for u in order}
    out = {}
    for (a, ab, ae), (b, bb, be) in zip(order, order[1:], strict=False):
        if not held[a]:
            continue
        over = ae - bb
        if over > 0 and be <= ae:
            out[a], held[b] = held[a], []
            continue
        cut = next((i for i, (_, s, d) in enumerate(held[a]) if 2 * s + d > 2 * (ae - ab) - over), len(held[a]))
        out[a] = held[a][:cut]
        begin = next((i for i, (_, s, d) in enumerate(held[b]) if 2 * s + d > over), None)
        held[b] = [] if begin is None else held[b][begin:]
    if order:
        out[order[-1][0]] = held[order[-1][0]]
    return {(u, p) for u, ws in out.items() for p, _, _ in ws}


def test_word_overlaps_equal_a_fold(spark):
    rng = random.Random(4)
    utts, rows, want = [], [], set()
    for reco in range(60):
        own, words, t = [], {}, 0
        for k in range(rng.randint(1, 9)):
            t += rng.randint(0, 12)
            name = f"r{reco:02}-{k}"
            own.append((name, t, t + rng.randint(1, 30)))
            words[name] = []
            at = 0
            for p in range(rng.randint(0, 6)):
                at += rng.randint(0, 6)
                words[name].append((p, at, rng.randint(0, 9)))
        utts += [(f"r{reco:02}", *u) for u in own]
        rows += [(u, *x, "w") for u, ws in words.items() for x in ws]
        want |= fold(own, words)
    got = I.resolve_word_overlaps(spark.createDataFrame(rows, "utt string, pos int, start_ms long, dur_ms long, word string"), spark.createDataFrame(utts, "reco string, utt string, start_ms long, end_ms long"))
    assert {(r["utt"], r["pos"]) for r in got.collect()} == want and len(want) < len(rows)
