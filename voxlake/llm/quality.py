"""Quality rules as a short-circuit cascade.

A sample (at most about SAMPLE_ROWS rows, chosen by a hash of the row) is run through every rule to estimate what the rule costs per
document and what share it rejects. The rules are then applied to all documents in descending order of rejection per cost,
and a document leaves the cascade at its first rejection. The order changes the work only: a document is kept if and only if no rule
rejects it, so results do not depend on the sample or on timings.

Measures that rules share (counts of words, symbols, repeated lines and windows) are computed once per document and lazily.
Defined results: null or empty text has no words and fails; ties, repeated rows and long texts need no special case; null ids pass through; an
empty table gives no rows; the columns of the input other than id and text are not read by ``measure``.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.session import text_batches

SAMPLE_ROWS = 2000
#: Blanks that part words, and the symbols that are counted.
BLANKS, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
LETTER = re.compile(rb"[A-Za-z\x80-\xff]").search  # a letter of ASCII, or anything beyond


class Text:
    """One document's measures."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        solid = np.frombuffer(self.raw.translate(None, BLANKS), np.uint8)
        return int(np.count_nonzero((solid & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = len(self.words)
        if n < 6:
            return 0
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, n)
        size = len(ids)
        if size < 6000:  # five ids fit into 63 bits
            key = (((a[:-4] * size + a[1:-3]) * size + a[2:-2]) * size + a[3:-1]) * size + a[4:]
        else:
            two = np.unique(a[:-1] * size + a[1:], return_inverse=True)[1]
            four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
            key = four[:-1] * size + a[4:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(len(key) + 4, np.int32)
        starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
        twice[starts] += 1
        np.subtract.at(twice, starts[starts + 5 < len(twice)] + 5, 1)
        return int(np.count_nonzero(np.cumsum(twice)[:n] > 0))

    @cached_property
    def lettered(self) -> int:
        """Words with a letter."""
        return sum(1 for w in self.words if LETTER(w))

    @cached_property
    def distinct(self) -> int:
        return len(set(self.words))


Rule = tuple[str, Callable[[Text], bool]]


def too_few_or_repeated(t: Text) -> bool:
    n = len(t.words)
    return n < 10 or 100 * t.n_repeat_words > 20 * n


#: Name, and a test that is true for a document to be rejected.
RULES: list[Rule] = [
    ("symbols", lambda t: 100 * t.n_symbols > 20 * len(t.words)),
    ("word length", lambda t: 5 * t.word_chars < 6 * len(t.words) or t.word_chars > 100 * len(t.words)),
    ("duplicate lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    ("letters", lambda t: 100 * t.lettered < 60 * len(t.words)),
    ("few different words", lambda t: len(t.words) >= 200 and 100 * t.distinct < 5 * len(t.words)),
]
BASE: Rule = ("base", too_few_or_repeated)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[Text]:
    for x in batch.column(column):
        yield Text(x.as_py())


def plan_cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> list[int]:
    """Order of the rules by estimated rejection per cost; one row per rule and task comes back to the driver."""
    text_batches(docs.sparkSession)
    total = docs.count()
    text, own = F.col(f"`{text_col}`"), [F.col(f"`{id_col}`")] if id_col in docs.columns else []
    some = docs.select(text.alias("text"))
    if total > sample_rows:  # by id and text: copies of one text are not drawn together
        some = docs.filter(F.pmod(F.xxhash64(*own, text), F.lit(1_000_000)) < int(1e6 * sample_rows / total) + 1).select(text.alias("text"))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, out = 0, [0.0] * len(rules), [0] * len(rules)
        for b in batches:
            for x in b.column(0):
                text = x.as_py()
                n += 1
                for i, (_, rejects) in enumerate(rules):
                    began = time.perf_counter()
                    out[i] += bool(rejects(Text(text)))
                    cost[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "n": [n] * len(rules), "cost": cost, "rejected": out})

    found = some.mapInArrow(tried, "rule long, n long, cost double, rejected long").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"))
    rate = {r["rule"]: (r["rejected"] / r["cost"] if r["cost"] else 0.0) for r in found.collect()}
    return sorted(range(len(rules)), key=lambda i: (-rate.get(i, 0.0), i))


def passes(text: Text, ordered: list[Rule]) -> bool:
    return not any(rejects(text) for _, rejects in ordered)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: id, the base measures, base_failed, kept."""
    rules = RULES if rules is None else rules
    ordered = [rules[i] for i in plan_cascade(docs, rules, text_col, id_col=id_col)]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in _texts(b, "text"):
                failed = BASE[1](t)
                got.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and passes(t, ordered)))
            columns = zip(*got, strict=True) if got else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, types, strict=True)]], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs' rows (all columns) that the base rule and the cascade keep: the base rule is one rule of the cascade here."""
    rules = [BASE, *(RULES if rules is None else rules)]
    ordered = [rules[i] for i in plan_cascade(docs, rules, text_col)]
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([passes(Text(x.as_py()), ordered) for x in b.column(where)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
