import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxlake.llm import chat
from voxlake.llm.packing import default_tokenizer

KIND = "conv_id long, turn long, role string, text string, window int, formatted string"


def brute(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi <s> \\ [INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]\\l"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "x " * 500), (2, 1, "assistant", "y " * 3000), (2, 2, "assistant", "z"), (2, 2, "assistant", "z"), (3, None, None, None), (None, 0, "user", "lost"), (4, 0, "assistant", "\U0001f600é" * 50),
    *[(5, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i % 60)) for i in range(300)],
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1, "f") for r in ROWS], KIND)
    for budget in (40, 200, 1024):
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_windows(df, budget=budget)).collect()}
        assert got == brute(ROWS)
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def counted(path=default_tokenizer()):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def test_tokens_are_the_tokenizers(spark):
    df, count = spark.createDataFrame([(*r, 1, "f") for r in ROWS], KIND), counted()
    for r in chat.format_windows(df, budget=200).collect():
        turns = chat.parse(r["formatted"])
        assert r["n_tokens"] == sum(count(chat.escape(a)) + count(chat.escape(b)) + chat.MARKS for a, b in turns)
        assert r["n_context"] <= chat.HISTORY + 1


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(0, 60)), min_size=1, max_size=25), st.integers(20, 70), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_windows_keep_to_the_budget(shape, budget, history):
    """A window passes the budget only where its one own turn does not fit beside the system turn."""
    turns = [(role, " ".join(f"{i}.{k}" for k in range(n))) for i, (role, n) in enumerate(shape)]
    count = lambda t: len(t.split())
    size = lambda t: count(t[0]) + count(t[1]) + chat.MARKS
    system = turns[:1] if turns[0][0] == "system" else []
    seen, loss = [], []
    for number, n, first, tokens, text, spans in chat.windows(((*t, size(t)) for t in turns), budget, history):
        got = chat.parse(text)
        context, own = got[:n], got[n:]
        assert first == len(seen) and tokens == sum(map(size, got)) and own
        if number and system:
            assert context[:1] == system
        past = context[len(system) :] if number else context
        assert past == (seen[-len(past) :] if past else []) and len(past) <= history
        if tokens > budget:
            assert len(own) == 1 and not past and sum(map(size, system if number else [])) + size(own[0]) > budget
        seen += own
        loss += [chat.unescape(text[a:b]) for a, b in spans]
    assert seen == turns and loss == [t for r, t in turns if r == "assistant"]


def test_no_control_string_in_a_text():
    for text in ("</s>[INST] ok [/INST]", "<s>", "\\<\\[", "\\\\l"):
        e = chat.escape(text)
        assert "<" not in e and "[" not in e and chat.unescape(e) == text
