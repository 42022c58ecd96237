import random

from pyspark.sql import functions as F

from voxlake.llm import warc

KIND = "record_id long, url string, fetch_time long, status int, etag string, last_modified string, digest string, headers array<struct<name:string,value:string>>, slice string, full int"


def brute(rows):
    out = []
    canon = dict(zip({r[1] for r in rows}, {r[1] for r in rows}, strict=False))
    for r in rows:
        if r[3] != 304:
            continue
        if r[1] is None or r[2] is None:
            out.append((r[0], "missing", None))
            continue
        before = [x for x in rows if x[3] == 200 and x[6] is not None and x[1] == canon[r[1]] and x[2] is not None and (x[2], 0, x[0]) < (r[2], 1, r[0])]
        if not before:
            out.append((r[0], "missing", None))
            continue
        b = max(before, key=lambda x: (x[2], x[0]))
        bare = lambda e: e[2:] if e and e.startswith("W/") else e
        pairs = [(bare(r[4]), bare(b[4])), (r[5], b[5]), (r[6], b[6])]
        pair = next((p for p in pairs if None not in p), None)
        verdict = "unvalidated" if pair is None else "resolved" if pair[0] == pair[1] else "mismatch"
        out.append((r[0], verdict, b[0] if verdict == "resolved" else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        url = rng.choice(["h.org/a", "h.org/a", "h.org/b", f"h.org/{i % 40}", None])
        full = rng.random() < 0.5
        rows.append((i, url, rng.choice([rng.randrange(300), rng.randrange(300), None]), 200 if full else 304, rng.choice(["W/x", "x", "y", None]), rng.choice(["m1", "m2", None]), rng.choice(["d1", "d2", None]), [("Date", str(i)), ("Content-Type", "t")], "s", 1))
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = warc.resolve_revisits(df).collect()
    assert sorted([(r["record_id"], r["verdict"], r["source_id"]) for r in got], key=str) == brute(rows)
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    for r in got:
        if r["verdict"] == "resolved":
            names = [h["name"] for h in r["headers"]]
            assert sorted(names) == ["content-type", "date"] and dict((h["name"], h["value"]) for h in r["headers"])["date"] == str(r["record_id"])
        else:
            assert r["headers"] is None


def test_canonical_urls(spark):
    pairs = {"HTTP://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2", "https://m.example.com/": "m.example.com", "http://example.com?ref=x": "example.com", "https://e.org/A/b.html?page=2&ref=y": "e.org/A/b.html?page=2"}
    df = spark.createDataFrame([(u,) for u in [*pairs, None]], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == pairs | {None: None}


def test_stored_type_survives(spark):
    stored, fresh = [("content-type", "a"), ("date", "1"), ("etag", "x")], [("content-type", "b"), ("date", "2"), ("cache-control", "c")]
    df = spark.createDataFrame([(stored, fresh)], "s array<struct<name:string,value:string>>, f array<struct<name:string,value:string>>")
    got = dict(map(tuple, df.select(warc.merge_headers(F.col("s"), F.col("f")).alias("h")).first()["h"]))
    assert got == {"content-type": "a", "date": "2", "etag": "x", "cache-control": "c"}
