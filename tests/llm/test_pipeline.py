import random

import pytest

import corpus_pipeline
from voxlake.llm import jaccard, quality

from .conftest import prose

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(make_docs, odd_rows):
    rng = random.Random(12)
    passage = prose(rng, 70)
    rows = list(odd_rows)
    for i in range(60):
        rows.append((4000 + i, prose(rng, 120) + (" " + passage + " " if i % 6 == 0 else " ") + prose(rng, 60), f"s{i % 4}"))
    copy = rows[-1][1]
    rows += [(5000, copy, "s1"), (5001, copy.replace("w1 ", "v ", 1), "s2"), (5002, "buy now\n" * 50, "s1")]
    return rows, passage, make_docs(rows)


def test_stages_one_by_one(spark, corpus, tmp_path):
    rows, passage, docs = corpus
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{folder}/{i}")
        seen[name] = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    texts = {r["doc_id"]: r["text"] for r in seen[names[0]]}
    assert 5002 not in texts and 200 not in texts
    assert {r["doc_id"] for r in seen[names[0]]} == {i for i, t, _ in rows if not quality.too_few_or_repeated(quality.Text(t)) and quality.passes(quality.Text(t), quality.RULES)}
    kept = {r["doc_id"] for r in seen[names[1]]}
    assert {100, 4059} <= kept and not {101, 102, 5000, 5001} & kept
    after = {r["doc_id"]: r["text"] for r in seen[names[2]]}
    assert after.keys() == kept
    for i in kept - {None}:
        if 4000 <= i < 4060 and (i - 4000) % 6 == 0:
            assert passage not in after[i] and len(after[i]) < len(texts[i])
        elif i < 100:
            assert after[i] == texts[i]
    mixed = {}
    for r in seen[names[3]]:
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + 1
    assert mixed.keys() <= kept and max(mixed.values()) <= 3
    assert {r["doc_id"] for r in seen[names[4]]} == mixed.keys()
    assert sum(1 for r in seen[names[4]] if r["piece"] == 0) == sum(mixed.values())


def test_run_and_empty_documents(spark, corpus, tmp_path):
    _, _, docs = corpus
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_follow_the_threshold(make_docs):
    rng = random.Random(3)
    base = prose(rng, 200).split()
    close, far = list(base), list(base)
    close[100] = "other"
    for k in range(0, 200, 10):
        far[k] = "other"
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(make_docs([(1, " ".join(base), "s"), (2, " ".join(close), "s"), (3, " ".join(far), "s")])).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
