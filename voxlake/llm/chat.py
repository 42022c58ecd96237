"""Chat formatting into budgeted, turn-aligned windows with loss masks.

Turns of a conversation are taken in order (turn, then role and text for ties). A window is a span of whole turns: the running sum of turn
tokens decides where it ends. A turn's tokens are those of its escaped role and text under the tokenizer (a parameter) and one for each of its three marks, which a model reads as control ids.
Later windows start with the conversation's system turn, if its first turn is one, and with the last ``history`` turns of the window before as far as they
leave room for the next own turn; both are context, and only the window's own assistant texts are under the loss
mask, so every target counts once. The system turn, however long, is in every later window. So a window passes the budget only where its one own turn does not fit
beside the system turn (or, in the first window, on its own): it is then those two alone, without history.

A turn is written ``<s>role[INST]text</s>``. In roles and texts ``\\`` becomes ``\\\\``, ``<`` becomes ``\\l`` and ``[`` becomes ``\\b``, so no control string can
occur inside a text, and reading back restores every text.

Rows are streamed in order within a hash partition of the conversation id: a task holds one window at a time, however long a
conversation is. Defined results: null text and null role are empty; a null conversation id is one conversation; a null turn comes first; repeated rows
are turns of their own; an empty table gives no windows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.packing import Encoder, default_tokenizer, encoder_for
from voxlake.session import text_batches

BUDGET, HISTORY, MARKS = 1024, 2, 3
#: The control strings and the escapes.
START, TEXT, END = "<s>", "[INST]", "</s>"
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
BACK = {"\\": "\\", "l": "<", "b": "["}
_ESCAPE, _BACK = re.compile(r"[\\<\[]"), re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: BACK[m[1]], text)


class Turn:
    """A turn, escaped, with its place in the conversation and its tokens."""

    def __init__(self, index: int, role: str, text: str, tokens: int):
        self.index, self.role, self.head, self.body, self.tokens = index, role, escape(role), escape(text), tokens


def turn_tokens(encoder: Encoder, roles: list[str], texts: list[str]) -> list[int]:
    """Tokens of turns, their chunks learnt many at a time."""
    words = [encoder.split(escape(role)) + encoder.split(escape(text)) for role, text in zip(roles, texts, strict=True)]
    encoder.learn(words)
    return [len(encoder.ids(w)) // 4 - 1 + MARKS for w in words]  # less the end id


def render(context: list[Turn], own: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    parts, spans, at = [], [], 0
    for t in [*context, *own]:
        head, body = f"{START}{t.head}{TEXT}", t.body
        if t.role == "assistant" and t.index >= own[0].index:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def windows(turns: Iterator[tuple[str, str, int]], budget: int, history: int) -> Iterator[tuple[int, int, int, int, str, list[tuple[int, int]]]]:
    """(window, turns of context, first own turn, tokens, formatted, spans under the mask) for one conversation's (role, text, tokens)."""
    number, total = 0, 0
    system: list[Turn] = []
    context: list[Turn] = []
    own: list[Turn] = []
    for i, (role, text, tokens) in enumerate(turns):
        t = Turn(i, role, text, tokens)
        if own and total + t.tokens > budget:
            yield number, len(context), own[0].index, total, *render(context, own)
            number += 1
            room = budget - sum(x.tokens for x in [*system, t])
            past: list[Turn] = []
            for x in reversed(own[-history:] if history else []):
                if x.tokens > room or x in system:
                    break
                past.append(x)
                room -= x.tokens
            context, own = [*system, *past[::-1]], []
            total = sum(x.tokens for x in context)
        if i == 0 and role == "system":
            system = [t]
        own.append(t)
        total += t.tokens
    if own:
        yield number, len(context), own[0].index, total, *render(context, own)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names], strict=True)


def _by_key(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of equal first fields, as itertools.groupby gives them, for rows in order."""
    from itertools import groupby

    return ((k, (r[1:] for r in g)) for k, g in groupby(rows, key=lambda r: r[0]))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """conv_id, window, n_context, first_turn, n_tokens, formatted, loss_spans; a conversation's windows follow each other in one partition. tokenizer: a file that every worker has."""
    path = tokenizer or default_tokenizer()
    text_batches(conversations.sparkSession)
    rows = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").alias("turn"), F.coalesce(F.col("`role`"), F.lit("")).alias("role"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_context", pa.int64()), ("first_turn", pa.int64()), ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss_spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)

        def rows() -> Iterator[tuple]:
            for b in batches:
                conv, roles, texts = (b.column(c).to_pylist() for c in ("conv_id", "role", "text"))
                yield from zip(conv, roles, texts, turn_tokens(encoder, roles, texts), strict=True)

        def out() -> Iterator[tuple]:
            for conv, turns in _by_key(rows()):
                for w, n, first, tokens, text, spans in windows(turns, budget, history):
                    yield conv, w, n, first, tokens, text, [{"begin": a, "end": b} for a, b in spans]

        return _batches(out(), schema)

    return rows.mapInArrow(run, "conv_id long, window long, n_context long, first_turn long, n_tokens long, formatted string, loss_spans array<struct<begin:long,end:long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from windows in order: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for conv, own in _by_key(_groups(batches, ["conv_id", "n_context", "formatted", "loss_spans"])):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = chars = size = number = 0
                for context, text, spans in own:
                    number += 1
                    size += len(text)
                    for role, said in parse(text)[context:]:
                        n += 1
                        turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    for s in spans:
                        target = unescape(text[s["begin"] : s["end"]])
                        chars += len(target)
                        loss.update(target.encode("utf-8", "surrogatepass"))
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, number

        return _batches(out(), schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
