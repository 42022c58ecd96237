import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.llm import pieces

pytest.importorskip("public_tokenizers")
ALPHABET = [*"abcXYZ.,'é ÉßſΣσ日\t\n\r19-*%", " ", "  ", "    ", pieces.MARK, "<s>", "</s>", "<unk>", "<0x41>", "\x00", "�", "\U0001f600", "the", " the", "ing", " ", "　"]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.default_model())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), max_size=5))
def test_chunks_encode_and_decode_like_the_library(model, texts):
    assert model.by_chunk
    got = [np.frombuffer(x, "<i4") for x in model.encode([*texts, None], {})]
    want = model.model.encode([*texts, ""])
    assert [g.tolist() for g in got] == want
    assert model.decode(got) == [model.model.decode(w) for w in want]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=30))
def test_any_ids_decode_like_the_library(model, ids):
    assert model.decode([np.array(ids, np.int32)]) == [model.model.decode(ids)]


def test_ids_outside_the_model(model):
    with pytest.raises(ValueError):
        model.decode([np.array([32000], np.int32)])


@pytest.mark.parametrize("table_rows", [0, 40, 200_000])
def test_round_trip(make_docs, odd_rows, model, table_rows):
    rng = random.Random(5)
    rows = odd_rows + [(400 + i, "".join(rng.choice(ALPHABET) for _ in range(300)), "s") for i in range(150)] + [(600, "x" * 70_000 + " y" * 50_000, "s"), (601, " " * 5000, "s")]
    got = pieces.round_trip(make_docs(rows).repartition(5), table_rows=table_rows).collect()
    want = []
    for i, t, _ in rows:
        ids = model.model.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_table_holds_the_most_frequent(make_docs):
    docs = make_docs([(i, " ".join(f"w{k}" for k in range(i)), "s") for i in range(60)])
    table = {r["chunk"]: r["n"] for r in pieces.chunk_table(docs, rows=20).collect()}
    assert 0 < len(table) <= 20 and table == {f"w{k}": 59 - k for k in range(len(table))}


def test_empty_table_and_null_ids(spark, make_docs, odd_rows):
    assert pieces.round_trip(make_docs(odd_rows).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, None, "old"), (2, [], "old"), (3, [264, 28705], "old")], "ids_of long, ids array<int>, decoded string")
    assert sorted((r["ids_of"], r["decoded"]) for r in pieces.decode(rows).collect()) == [(1, None), (2, ""), (3, "a ")]
