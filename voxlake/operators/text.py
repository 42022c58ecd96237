"""Family E: n-gram statistics, Kneser-Ney estimates, ARPA scoring, byte-pair merges and keyword hits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.session import stash

BOS, EOS = "<s>", "</s>"


def plain(x: Column) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.when(F.abs(x) < 5e-7, 0.0).otherwise(F.round(x, 6))


def words(text: str) -> Column:
    return F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda t: t != "")


def unigram_costs(rows: DataFrame, text: str) -> DataFrame:
    """(token, cost): -ln of the share of tokens, one sentence end per row counted."""
    t = rows.select(F.explode(F.concat(words(text), F.array(F.lit(EOS)))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = t.agg(F.sum("n").alias("total"))
    return t.join(F.broadcast(total)).select("token", F.round(-F.log(F.col("n") / F.col("total")), 6).alias("cost"))


def ngrams(rows: DataFrame, text: str, order: int) -> DataFrame:
    """(n, hist, word, cnt) for 1..order, with sentence marks; hist is the blank-joined history."""
    marked = rows.select(F.concat(F.array(F.lit(BOS)), words(text), F.array(F.lit(EOS))).alias("w"))
    t = marked.select("w", F.posexplode("w").alias("p", "word")).filter("p > 0")
    t = t.select("w", "p", "word", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("p") + 1))).alias("n"))
    hist = F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("p") - F.col("n") + 2), F.col("n") - 1), " ")
    return t.select("n", hist.alias("hist"), "word").groupBy("n", "hist", "word").agg(F.count("*").alias("cnt"))


def left_contexts(counts: DataFrame) -> DataFrame:
    """(n, hist, word, n_ctx): distinct words in front of each n-gram, from the counts one order up."""
    up = counts.filter("n > 1")
    rest = F.when(F.instr("hist", " ") > 0, F.expr("substring(hist, instr(hist, ' ') + 1)")).otherwise(F.lit(""))
    return up.select((F.col("n") - 1).alias("n"), rest.alias("hist"), "word").groupBy("n", "hist", "word").agg(F.count("*").alias("n_ctx"))


def discounts(counts: DataFrame) -> DataFrame:
    """(n, d): n1 / (n1 + 2 n2) from raw counts, n1 at least 0.001; order 1 is not discounted."""
    k = lambda x: F.sum(F.when(F.col("cnt") == x, 1).otherwise(0))
    t = counts.groupBy("n").agg(k(1).alias("n1"), k(2).alias("n2"))
    n1 = F.greatest(F.lit(0.001), F.col("n1").cast("double"))
    return t.select("n", F.when(F.col("n") == 1, 0.0).otherwise(F.round(n1 / (n1 + 2 * F.col("n2")), 6)).alias("d"))


def adjusted(counts: DataFrame, order: int) -> DataFrame:
    """(n, hist, word, c): raw counts for the highest order and sentence starts, distinct left contexts below."""
    ctx = left_contexts(counts)
    start = (F.col("n") == order) | F.col("hist").startswith(BOS)
    return counts.join(ctx, ["n", "hist", "word"], "left").select("n", "hist", "word", F.when(start, F.col("cnt")).otherwise(F.coalesce("n_ctx", "cnt")).alias("c"))


def kn_probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(n, hist, word, f, left): discounted share of each word after its history, and the mass the history leaves to lower orders. Counts are made once. A history is a window of the words seen behind it;
    words without a history, the whole vocabulary, are no window: their two sums are one row that is sent to all."""
    counts = stash(counts, "ngram-counts")
    t = adjusted(counts, order).join(F.broadcast(discounts(counts)), "n")  # one row per order
    less = F.greatest(F.lit(0.0), F.col("c") - F.col("d"))
    w = Window.partitionBy("n", "hist")
    long_ = t.filter("n > 1").withColumn("f", less / F.sum("c").over(w)).withColumn("left", plain(1 - F.sum("f").over(w)))
    one = stash(t.filter("n = 1"), "unigrams")
    one = one.join(F.broadcast(one.agg(F.sum("c").alias("total")))).withColumn("f", less / F.col("total"))
    one = one.join(F.broadcast(one.agg(plain(1 - F.sum("f")).alias("left"))))
    names = ["n", "hist", "word", F.round("f", 6).alias("f"), "left"]
    return long_.select(*names).unionByName(one.select(*names))


def backoff_weights(probs: DataFrame) -> DataFrame:
    """(n, hist, bow): mass left by a history over the lower-order mass of the words it has not seen."""
    p = probs.filter("n > 1")
    rest = F.when(F.instr("hist", " ") > 0, F.expr("substring(hist, instr(hist, ' ') + 1)")).otherwise(F.lit(""))
    low = probs.select((F.col("n") + 1).alias("n"), F.col("hist").alias("low"), "word", F.col("f").alias("g"))
    t = p.withColumn("low", rest).join(low, ["n", "low", "word"], "left").groupBy("n", "hist").agg((1 - F.sum("f")).alias("a"), (1 - F.sum(F.coalesce("g", F.lit(0.0)))).alias("b"))
    return t.select("n", "hist", plain(F.when(F.col("b") > 1e-6, F.col("a") / F.col("b")).otherwise(F.lit(1.0))).alias("bow"))


def pair_scores(pairs: DataFrame, uni: DataFrame, bi: DataFrame, bow: DataFrame) -> DataFrame:
    """(hist, word, lp) for distinct pairs (hist, word): log10 by bigrams, else back-off weight times unigram; words without a unigram are <unk>. The hints keep
    tables of n-grams from being broadcast: Spark takes what comes of an explode to be as small as the texts' files."""
    t = pairs.join(bi.select("hist", "word", F.col("p").alias("p2")).hint("merge"), ["hist", "word"], "left").join(uni.select("word", F.col("p").alias("p1")).hint("merge"), "word", "left")
    t = t.join(bow.select("hist", "bow").hint("merge"), "hist", "left")
    p = F.coalesce(F.when(F.col("p2") > 0, F.log10("p2")), F.log10(F.coalesce("bow", F.lit(1.0))) + F.coalesce(F.when(F.col("p1") > 0, F.log10("p1")), F.lit(-7.0)))
    return t.select("hist", "word", p.alias("lp"))


def score_sentences(rows: DataFrame, key: str, text: str, uni: DataFrame, bi: DataFrame, bow: DataFrame) -> DataFrame:
    """(key, n_tokens, logp) by pair_scores. Every row has a sentence start and end, so tokens meet the model by pairs of words, each looked up once, and never by one word.
    uni: (word, p); bi: (hist, word, p); bow: (hist, bow)."""
    marked = rows.select(key, F.concat(F.array(F.lit(BOS)), words(text), F.array(F.lit(EOS))).alias("w"))
    t = marked.select(key, "w", F.posexplode("w").alias("p", "word")).filter("p > 0").select(key, "word", F.element_at("w", F.col("p")).alias("hist"))
    found = pair_scores(t.select("hist", "word").distinct(), uni, bi, bow)
    return t.join(found.hint("merge"), ["hist", "word"]).groupBy(key).agg(F.count("*").alias("n_tokens"), F.round(F.sum("lp"), 4).alias("logp"))


# --- byte-pair encoding ----------------------------------------------------------------------------------------------


def pair_counts(vocabulary: DataFrame) -> DataFrame:
    """(a, b, n) over (symbols, freq)."""
    i = F.sequence(F.lit(1), F.size("symbols") - 1)
    pairs = F.when(F.size("symbols") > 1, F.transform(i, lambda k: F.struct(F.element_at("symbols", k).alias("a"), F.element_at("symbols", k + 1).alias("b"))))
    t = vocabulary.select("freq", F.explode(pairs).alias("x"))
    return t.groupBy("x.a", "x.b").agg(F.sum("freq").alias("n"))


def word_vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """(word, symbols, freq): characters, the last with the end mark."""
    t = rows.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    chars = F.split(F.col("word"), "")
    last = F.concat(F.element_at(chars, -1), F.lit("</w>"))
    return t.select("word", F.concat(F.slice(chars, 1, F.size(chars) - 1), F.array(last)).alias("symbols"), "freq")


def learn_bpe(vocabulary: DataFrame, merges: int, least: int = 2) -> list[tuple[str, str]]:
    """The best pair by (count, pair) again and again. The loop holds one pair per round on the driver; pairs are counted and words
    rewritten by the cluster, and lineage is cut every few rounds."""
    from voxlake.session import stash

    out, v = [], stash(vocabulary, "bpe")
    for k in range(merges):
        best = pair_counts(v).agg(F.max(F.struct("n", "a", "b")).alias("m")).first()["m"]
        if best is None or best["n"] < least:
            break
        out.append((best["a"], best["b"]))
        v = v.withColumn("symbols", merge_pair(F.col("symbols"), best["a"], best["b"]))
        if k % 8 == 7:
            v = stash(v, "bpe")
    return out


def merge_pair(symbols: Column, a: str, b: str) -> Column:
    """Joins every a followed by b, from the left."""
    text = F.concat(F.lit("\u0001"), F.array_join(symbols, "\u0001\u0001"), F.lit("\u0001"))
    both = F.replace(text, F.lit(f"\u0001{a}\u0001\u0001{b}\u0001"), F.lit(f"\u0001{a}{b}\u0001"))
    return F.split(F.substring(both, 2, 1 << 30).substr(F.lit(1), F.length(both) - 2), "\u0001\u0001")


def isolate(word: str, glossaries: list[str]) -> list[str]:
    """Word in pieces, glossary terms on their own."""
    pieces = [word]
    for g in glossaries:
        pieces = [x for p in pieces for x in ([p] if p == g or g not in p else [y for k, part in enumerate(p.split(g)) for y in ([g] if k else []) + [part] if y])]
    return pieces


def apply_bpe(rows: DataFrame, key: str, text: str, merges: list[tuple[str, str]], *, glossaries: list[str] | None = None, vocabulary: set[str] | None = None, mark: str = "@@") -> DataFrame:
    """(key, text) cut into subwords, all but the last of a word with the mark. Merges are taken in order of rank; glossary terms stay whole; subwords that the vocabulary (inner ones with the
    mark) lacks are taken apart again by their merges. merges, glossaries and vocabulary are driver-side lists. Words are cut once per batch."""
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}
    made = {a + b: (a, b) for a, b in reversed(merges)}
    terms = glossaries or []

    def merged(word: str) -> list[str]:
        s = [*word[:-1], word[-1] + "</w>"]
        while len(s) > 1:
            best = min(zip(s, s[1:], strict=False), key=lambda p: rank.get(p, len(merges)))
            if best not in rank:
                break
            out, fused = [], False
            for x in s:
                if out and (out[-1], x) == best and not fused:
                    out[-1] += x
                    fused = True
                else:
                    out.append(x)
                    fused = False
            s = out
        return s

    def apart(piece: str) -> list[str]:
        """Pieces end in </w> where they end a word."""
        name = piece.removesuffix("</w>") if piece.endswith("</w>") else piece + mark
        if name in vocabulary or piece not in made:
            return [piece]
        return [y for x in made[piece] for y in apart(x)]

    def cut(word: str) -> str:
        out = []
        for part in isolate(word, terms):
            if part in terms:
                out.append(part)
                continue
            s = merged(part)
            out += [x.removesuffix("</w>") for x in (s if vocabulary is None else [y for x in s for y in apart(x)])]
        return f"{mark} ".join(x for x in out if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, str] = {}
            out = []
            for t in b.column(1).to_pylist():
                w = (t or "").split()
                for x in w:
                    if x not in known:
                        known[x] = cut(x)
                out.append(" ".join(known[x] for x in w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "text"])

    return rows.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, text string")


# --- keyword hits ----------------------------------------------------------------------------------------------------


def keyword_thresholds(hits: DataFrame, seconds: float, beta: float = 999.9) -> DataFrame:
    """Per keyword: N / (T / beta + (beta - 1) / beta * N) with N the sum of scores; each hit's decision."""
    n = F.sum("score").over(Window.partitionBy("kwid"))
    bar = n / (seconds / beta + (beta - 1) / beta * n)
    return hits.withColumns({"threshold": F.round(bar, 6), "yes": F.col("score") > bar})


def drop_duplicate_hits(hits: DataFrame, within: float = 0.5) -> DataFrame:
    """Of hits of one keyword and utterance in order of time, those at least so far behind the last one kept. Hits more than that behind the hit before them are kept whatever came earlier, so only
    the stretches between such hits are folded, each on its own."""
    w = Window.partitionBy("kwid", "utt").orderBy("tbeg", "hit")
    fresh = F.coalesce(F.col("tbeg") - F.lag("tbeg").over(w) >= within, F.lit(True)).cast("int")
    t = hits.select("kwid", "utt", "hit", "tbeg", fresh.alias("__f")).withColumn("__run", F.sum("__f").over(w)).drop("__f")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = None, 0.0
        for b in batches:
            keep = []
            for r in zip(*[b.column(c).to_pylist() for c in ("kwid", "utt", "__run", "tbeg")], strict=True):
                stays = r[:3] != run or r[3] - last >= within
                if stays:
                    run, last = r[:3], r[3]
                keep.append(stays)
            yield b.filter(pa.array(keep, pa.bool_()))

    # a stretch lies in one partition, in order, and streams through the fold
    dealt = t.repartition("kwid", "utt", "__run").sortWithinPartitions("kwid", "utt", "__run", "tbeg", "hit")
    return dealt.mapInArrow(fold, t.schema).drop("__run")


def best_hits(hits: DataFrame, n: int) -> DataFrame:
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("kwid").orderBy(F.desc("score"), "hit"))).filter(F.col("rn") <= n)


def numeric_order(rows: DataFrame, column: str) -> DataFrame:
    """Adds place (from 1) of every row by the column's stem, then by its numeric suffix (none comes first), then by the whole text.
    Range slices are ranked inside and moved by the rows of the slices before, so no task sorts everything."""
    from voxlake.session import stash

    stem, num = (F.regexp_extract(F.col(column), "^(.*?)([0-9]*)$", k) for k in (1, 2))
    keys = {"__stem": stem, "__number": F.coalesce(F.nullif(num, F.lit("")), F.lit("-1")).cast("long")}
    order = [*keys, column]
    t = stash(rows.withColumns(keys).repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()), "numeric-order")
    base = t.groupBy("__slice").agg(F.count("*").alias("__n"))
    base = base.select("__slice", F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__slice").orderBy(*order))
    ranked = t.withColumn("__own", own).join(F.broadcast(base), "__slice")
    return ranked.withColumn("place", (F.col("__base") + F.col("__own")).cast("long")).drop("__slice", "__own", "__base", *keys)
