import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.llm import packing

pytest.importorskip("public_tokenizers")
ALPHABET = [*"abcXYZ.,'’<|>é ÉßİſΣσ日 ́​\t\n19-*%", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "it's.", "  ", "...", "la***"]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40))
def test_chunks_encode_like_the_whole(encoder, parts):
    text = "".join(parts)
    words = encoder.split(text)
    encoder.learn([words])
    assert np.frombuffer(encoder.ids(words), "<u4").tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_best_fit_fills():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(5000)]
    where, offset, fills = packing.best_fit(lengths, 100)
    assert max(fills) <= 100 and len(fills) <= 1.02 * sum(lengths) / 100 + 4
    spans = {}
    for n, w, o in zip(lengths, where, offset, strict=True):
        spans.setdefault(w, []).append((o, n))
    for w, s in spans.items():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end == fills[w]


@pytest.mark.parametrize("capacity,task_items", [(4096, 200_000), (64, 40)])
def test_pieces_and_sequences(make_docs, odd_rows, encoder, capacity, task_items):
    rows = odd_rows + [(2000 + i, "word " * (i % 50), "s") for i in range(200)]
    got = packing.pack_documents(make_docs(rows).repartition(5), capacity=capacity, task_items=task_items, slack=2).collect()
    want, total = [], 0
    for i, t, _ in rows:
        ids = [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        want += [(i, s // capacity, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for s in range(0, len(ids), capacity)]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for o, n in sorted(s):
            assert o == end
            end += n
        assert end <= capacity
    assert len(sequences) <= 1.1 * -(-total // capacity) + 3


def test_empty_table(make_docs, odd_rows):
    assert packing.pack_documents(make_docs(odd_rows).limit(0)).count() == 0
