import random

import pytest

from voxlake.operators import tables as T


def variants(durs, allowed, factor):
    """One utterance after another, by walking up the ladder."""
    out = set()
    for utt, d in durs:
        if d < allowed[0]:
            i = 0
        elif d > allowed[-1]:
            i = len(allowed)
        else:
            i = next((k for k in range(1, len(allowed)) if allowed[k - 1] <= d <= allowed[k]), 1)
        far = lambda a: max(d / a, a / d) > factor  # noqa: B023, E731
        if i > 0:
            if far(allowed[i - 1]):
                continue
            out.add((utt, "pv1", allowed[i - 1], d / allowed[i - 1]))
        if i < len(allowed) and not far(allowed[i]):
            out.add((utt, "pv2", allowed[i], d / allowed[i]))
            if allowed[i] - d > 0.1:
                out.add((utt, "pv3", allowed[i], 1.0))
    return out


def test_ladder():
    got = T.duration_ladder(100, 60_000, 1.12)
    assert got[0][0] < 300 * 1.01 and all(a < b for (a, _), (b, _) in zip(got, got[1:], strict=False)) and all(n % 3 == 0 or (int(x - 25) / 10 + 1) % 3 == 0 for x, n in got)
    assert all(b <= 1.12 * a + 5 for (a, _), (b, _) in zip(got, got[1:], strict=False)) and got[-1][0] < 60_000
    assert T.duration_ladder(500, 400, 1.12) == []
    with pytest.raises(ValueError):
        T.duration_ladder(300, 60_000, 1.001)


@pytest.mark.parametrize("rungs", [1, 2, 30])
def test_variants_equal_walking(spark, rungs):
    rng = random.Random(rungs)
    ladder = [x for x, _ in T.duration_ladder(400, 10_000, 1.12)][:rungs]
    durs = [(i, float(rng.choice([rng.randint(1, 15_000), rng.choice(ladder), rng.choice(ladder) * 1.1, ladder[0] * 0.95]))) for i in range(400)]
    got = T.allowed_variants(spark.createDataFrame(durs, "utt long, dur double"), "utt", "dur", ladder, 1.12).collect()
    assert {tuple(r) for r in got} == variants(durs, ladder, 1.12) and len(got) == len({tuple(r) for r in got})
    assert T.allowed_variants(spark.createDataFrame(durs, "utt long, dur double"), "utt", "dur", [], 1.12).count() == 0
    assert T.allowed_variants(spark.createDataFrame([], "utt long, dur double"), "utt", "dur", ladder, 1.12).count() == 0
