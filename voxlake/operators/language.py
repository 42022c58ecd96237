"""Back-off language models as tables (n, hist, word, logp, bow): natural logarithms, hist blank-joined and empty for order 1, bow the back-off weight of hist + word as a
context (null: none). Lookup, joint probability, normalization, entropy pruning, edits of single words, reversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.text import BOS, EOS
from voxlake.session import stash

UNKNOWN = -16.0
UNK = "<unk>"
#: Fixed value: log10 probability of a sentence start, which is only ever a context.
START = -99


def with_start(model: DataFrame) -> DataFrame:
    """A model (n, hist, word, logp) with the unigram of the sentence start, which carries its weight as a context."""
    start = model.limit(1).select(F.lit(1).alias("n"), F.lit("").alias("hist"), F.lit(BOS).alias("word"), (START * F.log(F.lit(10.0))).alias("logp"))
    return model.unionByName(start)


def shorter(hist: Column) -> Column:
    """A history without its first word."""
    return F.when(F.instr(hist, " ") > 0, F.substring(hist, F.instr(hist, " ") + 1, F.length(hist))).otherwise(F.lit(""))


def context(hist: Column, word: Column) -> Column:
    return F.when(hist == "", word).otherwise(F.concat(hist, F.lit(" "), word))


def order_of(hist: Column) -> Column:
    return F.when(hist == "", 1).otherwise(F.size(F.split(hist, " ")) + 1)


def last_words(hist: Column, n: int) -> Column:
    """The last n words of a history, all of a shorter one."""
    return F.array_join(F.reverse(F.slice(F.reverse(F.split(hist, " ")), 1, n)), " ") if n else F.lit("")


def contexts(model: DataFrame) -> DataFrame:
    """(hist, bow) of the contexts that have a back-off weight."""
    return model.filter("bow is not null").select(context(F.col("hist"), F.col("word")).alias("hist"), "bow")


def log_probability(rows: DataFrame, model: DataFrame, order: int, unknown: float = UNKNOWN) -> DataFrame:
    """rows (hist, word, ..) with logp, by back-off: the longest n-gram that the model has, after the weights of the longer histories. Every order is one pair of joins.
    Of a history longer than order - 1 the last words count, as a model of that order has no longer contexts."""
    bows = contexts(model)
    t = rows.withColumns({"__h": last_words(F.col("hist"), order - 1), "__bow": F.lit(0.0), "logp": F.lit(None).cast("double")})
    for n in range(order, 0, -1):
        here = F.col("logp").isNull() & (order_of(F.col("__h")) == n)
        own = model.filter(F.col("n") == n).select(F.col("hist").alias("__h"), "word", F.col("logp").alias("__p"))
        t = t.join(own, ["__h", "word"], "left").withColumn("logp", F.coalesce("logp", F.col("__bow") + F.col("__p"))).drop("__p")
        if n > 1:
            t = t.join(bows.withColumnsRenamed({"hist": "__h", "bow": "__b"}), "__h", "left")
            t = t.withColumns({"__bow": F.when(here, F.col("__bow") + F.coalesce("__b", F.lit(0.0))).otherwise(F.col("__bow")), "__h": F.when(here, shorter(F.col("__h"))).otherwise(F.col("__h"))}).drop("__b")
    return t.withColumn("logp", F.coalesce("logp", F.col("__bow") + unknown)).drop("__h", "__bow")


def known_words(rows: DataFrame, model: DataFrame, order: int, unk: str = UNK) -> DataFrame:
    """rows (hist, word, ..), hist of at most order - 1 words, with every word that the model has no unigram of written as the unknown one."""
    back = F.reverse(F.split(context(F.col("hist"), F.col("word")), " "))
    gone = rows.select(F.explode(back).alias("__u")).distinct().join(model.filter("n = 1").select(F.col("word").alias("__u")), "__u", "left_anti")
    t = rows.withColumn("__back", back)
    for i in range(order):
        own = gone.withColumnRenamed("__u", f"__u{i}")
        t = t.withColumn(f"__w{i}", F.get("__back", F.lit(i))).join(own, F.col(f"__w{i}") == F.col(f"__u{i}"), "left")
    word = [F.when(F.col(f"__u{i}").isNotNull(), F.lit(unk)).otherwise(F.col(f"__w{i}")) for i in range(order)]
    return t.withColumns({"hist": F.concat_ws(" ", *word[:0:-1]), "word": word[0]}).drop("__back", *[f"__{c}{i}" for c in "uw" for i in range(order)])


def lookup(rows: DataFrame, model: DataFrame, order: int, unknown: float = UNKNOWN, unk: str = UNK) -> DataFrame:
    """rows (hist, word, ..) with logp, as a model is asked from outside: words that it lacks count as its unknown word (unknown if it has none). Each distinct n-gram of at most order words is looked up once."""
    t = rows.withColumn("__s", last_words(F.col("hist"), order - 1))
    asked = t.select("__s", "word").distinct().select("__s", F.col("word").alias("__w"), F.col("__s").alias("hist"), "word")
    found = log_probability(known_words(asked, model, order, unk), model, order, unknown).select("__s", F.col("__w").alias("word"), "logp")
    return t.join(found, ["__s", "word"]).drop("__s")


def joint_probability(texts: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """texts (hist) with joint, the log probability of all its words in turn; a leading sentence start counts as a sentence end, as starts have none."""
    w = F.split("hist", " ")
    part = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.struct(F.array_join(F.slice(w, F.greatest(F.lit(1), i - order + 1), F.least(i - 1, F.lit(order - 1))), " ").alias("h"), F.element_at(w, i).alias("word")))
    t = texts.select("hist").distinct().select("hist", F.explode(part).alias("x")).select("hist", "x.h", F.when((F.col("x.h") == "") & (F.col("x.word") == BOS), EOS).otherwise(F.col("x.word")).alias("word"))
    p = log_probability(t.select(F.col("hist").alias("whole"), F.col("h").alias("hist"), "word"), model, order)
    return p.groupBy(F.col("whole").alias("hist")).agg(F.sum("logp").alias("joint"))


def seen_mass(high: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """high (hist, word, logp) with low, the log probability one order down, and by history numerator and denominator of its back-off weight: what the seen words leave in either order."""
    t = log_probability(high.select("hist", "word", F.col("logp").alias("own")).withColumn("full", F.col("hist")).withColumn("hist", shorter(F.col("hist"))), model, n - 1)
    t = t.select(F.col("full").alias("hist"), "word", F.col("own").alias("logp"), F.col("logp").alias("low"))
    mass = t.groupBy("hist").agg((1 - F.sum(F.exp("logp"))).alias("numerator"), (1 - F.sum(F.exp("low"))).alias("denominator"))
    return t.join(mass, "hist")


def perplexity_changes(model: DataFrame, n: int) -> DataFrame:
    """(hist, word, change): relative growth of perplexity if an n-gram of order n were left to its back-off."""
    tiny = F.lit(1e-12)
    t = seen_mass(model.filter(F.col("n") == n), model, n).join(contexts(model), "hist", "left").join(joint_probability(model.filter(F.col("n") == n), model, n), "hist")
    new = F.log(F.greatest(tiny, F.col("numerator") + F.exp("logp"))) - F.log(F.greatest(tiny, F.col("denominator") + F.exp("low")))
    gain = F.exp("logp") * (F.col("low") + new - F.col("logp")) + F.col("numerator") * (new - F.coalesce("bow", F.lit(0.0)))
    return t.select("hist", "word", (F.exp(-F.exp("joint") * gain) - 1).alias("change"))


def with_weights(model: DataFrame, order: int, least: int = 2, *, fill: bool = False) -> DataFrame:
    """Back-off weights of the contexts computed again, from low to high orders; contexts without n-grams have none. A context that is no n-gram of the model has no row for its weight;
    with fill it gets one, without a probability."""
    model = model.drop("bow").withColumn("bow", F.lit(None).cast("double"))
    for n in range(least, order + 1):
        mass = seen_mass(model.filter(F.col("n") == n), model, n).groupBy("hist").agg(F.first("numerator").alias("a"), F.first("denominator").alias("b"))
        w = mass.select("hist", F.when((F.col("a") > 1e-12) & (F.col("b") > 1e-12), F.log(F.col("a") / F.col("b"))).otherwise(F.lit(0.0)).alias("__w")).withColumnRenamed("hist", "__c")
        own = model.withColumn("__c", context(F.col("hist"), F.col("word")))
        out = own.join(w, "__c", "left").withColumn("bow", F.when(F.col("n") == n - 1, F.col("__w")).otherwise(F.col("bow"))).drop("__c", "__w")
        if fill:
            split = F.split("__c", " ")
            gaps = w.join(own.filter(F.col("n") == n - 1), "__c", "left_anti")
            out = out.unionByName(gaps.select(F.lit(n - 1).alias("n"), F.array_join(F.slice(split, 1, n - 2), " ").alias("hist"), F.element_at(split, -1).alias("word"), F.lit(None).cast("double").alias("logp"), F.col("__w").alias("bow")))
        model = stash(out, "language-model")
    return model


def prune(model: DataFrame, order: int, threshold: float, least: int = 2) -> DataFrame:
    """Entropy pruning from the highest order down: n-grams whose loss changes perplexity by less than the threshold go, unless a longer one that stays begins with them; then weights are
    computed again. One pass and one written table an order."""
    model = stash(model.select("n", "hist", "word", "logp", "bow"), "language-model")
    for n in range(order, max(least, 2) - 1, -1):
        needed = model.filter(F.col("n") == n + 1).select("hist").distinct().withColumnRenamed("hist", "__c")
        small = perplexity_changes(model, n).filter(F.col("change") < threshold).withColumn("__c", context(F.col("hist"), F.col("word"))).join(needed, "__c", "left_anti")
        model = stash(model.join(small.select(F.lit(n).alias("n"), "hist", "word"), ["n", "hist", "word"], "left_anti"), "language-model")
    return with_weights(model, order)


def normalization(model: DataFrame, order: int) -> DataFrame:
    """(n, hist, total): probability of the whole vocabulary after each history: the seen words, and through the back-off weight what the shorter history gives to the others."""
    totals = stash(model.filter("n = 1").groupBy(F.lit(1).alias("n"), F.lit("").alias("hist")).agg(F.sum(F.exp("logp")).alias("total")), "totals")
    for n in range(2, order + 1):
        t = seen_mass(model.filter(F.col("n") == n), model, n).groupBy("hist").agg((1 - F.first("numerator")).alias("seen"), (1 - F.first("denominator")).alias("low"))
        t = t.join(contexts(model), "hist", "left").withColumn("__s", shorter(F.col("hist")))
        below = totals.select(F.col("hist").alias("__s"), F.col("total").alias("__t"))
        t = t.join(below, "__s", "left").select(F.lit(n).alias("n"), "hist", (F.col("seen") + F.exp(F.coalesce("bow", F.lit(0.0))) * (F.coalesce("__t", F.lit(1.0)) - F.col("low"))).alias("total"))
        totals = stash(totals.unionByName(t), "totals")
    return totals


def limit_unknown(model: DataFrame, order: int, unk: str = UNK) -> DataFrame:
    """N-grams of order 3 and more whose last history word is the unknown one go; n-grams that end in it have no weight."""
    last = F.element_at(F.split("hist", " "), -1)
    out = model.filter(~((F.col("n") > 2) & (last == unk)))
    return out.withColumn("bow", F.when((F.col("word") == unk) & (F.col("n") < order), None).otherwise(F.col("bow")))


def adjust_unknown(model: DataFrame, scale: float, *, fixed: bool = False, unk: str = UNK) -> DataFrame:
    """Probabilities of the unknown word scaled, or (fixed) its unigram set."""
    if fixed:
        return model.withColumn("logp", F.when((F.col("word") == unk) & (F.col("n") == 1), F.log(F.lit(scale))).otherwise(F.col("logp")))
    return model.withColumn("logp", F.when(F.col("word") == unk, F.col("logp") + F.log(F.lit(scale))).otherwise(F.col("logp")))


def add_unigrams(model: DataFrame, words: DataFrame, scale: float) -> DataFrame:
    """Words (word, p) that the model lacks, as unigrams of scaled probability."""
    own = model.filter("n = 1").select("word")
    new = words.groupBy("word").agg(F.max("p").alias("p")).join(own, "word", "left_anti")
    return model.unionByName(new.select(F.lit(1).alias("n"), F.lit("").alias("hist"), "word", F.log(F.col("p") * scale).alias("logp"), F.lit(None).cast("double").alias("bow")))


def reverse(model: DataFrame) -> DataFrame:
    """The model that reads texts backwards: (n, hist, word, logp), words in reverse and sentence marks swapped. log p' = log p + weight + sum over lengths of log p of the n-gram's beginnings
    less that of the strings from its second word; n-grams that the model lacks and sentence starts count 0."""
    text = F.split(context(F.col("hist"), F.col("word")), " ")
    m = model.withColumn("w", text).withColumn("p", F.when((F.col("n") == 1) & (F.col("word") == BOS), 0.0).otherwise(F.col("logp")))
    x = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array(F.struct(F.array_join(F.slice("w", 1, i), " ").alias("t"), F.lit(1).alias("sign")), F.struct(F.array_join(F.slice("w", 2, i), " ").alias("t"), F.lit(-1).alias("sign"))))))
    terms = m.filter("n > 1").select(F.array_join("w", " ").alias("whole"), x.alias("x")).select("whole", "x.t", "x.sign")
    p = m.select(F.array_join("w", " ").alias("t"), "p")
    extra = terms.join(p, "t").groupBy("whole").agg(F.sum(F.col("sign") * F.col("p")).alias("extra"))
    back = F.transform(F.reverse("w"), lambda v: F.when(v == BOS, EOS).when(v == EOS, BOS).otherwise(v))
    t = m.withColumn("whole", F.array_join("w", " ")).join(extra, "whole", "left")
    return t.select("n", F.array_join(F.slice(back, 1, F.size(back) - 1), " ").alias("hist"), F.element_at(back, -1).alias("word"), (F.col("p") + F.coalesce("bow", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))).alias("logp"))
