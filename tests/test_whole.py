"""Orders over whole tables."""

import re

from voxlake.operators import text as X


def test_numeric_order_places_every_row(spark):
    names = [f"{s}{n}" for s in ("b", "a", "a#") for n in range(300)] + ["a", "b", "b007", "", "12"]
    got = X.numeric_order(spark.createDataFrame([(n,) for n in names], "name string").repartition(5), "name").collect()
    parts = {n: re.fullmatch(r"(.*?)([0-9]*)", n).groups() for n in names}
    want = sorted(names, key=lambda n: (parts[n][0], int(parts[n][1] or -1), n))
    assert [r["name"] for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(1, len(names) + 1))
