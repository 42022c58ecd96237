"""Compositions: language-model vocabularies, sibling splits, score tables, training sets and losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxlake.fixtures import cte, view
from voxlake.operators import graph as G
from voxlake.operators import intervals as I
from voxlake.operators import kernels as N
from voxlake.operators import language as L
from voxlake.operators import metrics as M
from voxlake.operators import networks as W
from voxlake.operators import tables as T
from voxlake.operators import text as X
from voxlake.plans import graph_queries as C
from voxlake.plans import interval_queries as B
from voxlake.plans import metric_queries as D
from voxlake.operators.components import connected_components
from voxlake.plans.diarization import cluster_levels, predicted_clusters
from voxlake.plans.registry import Registry
from voxlake.plans.text_queries import NG, lines
from voxlake.session import stash, table
from voxlake.sources import ark
from voxlake.sources import formats as S

R = Registry()
_VOC = ", voc AS (SELECT word FROM cnt WHERE n = 1 AND cnt >= 20)"


def _vocabulary(counts):
    return counts.filter("n = 1 and cnt >= 20").select(F.col("word").alias("token"))


@R.add(NG + _VOC + ", t AS (SELECT *, unnest(string_split(CASE WHEN hist = '' THEN word ELSE concat(hist, ' ', word) END, ' ')) AS x FROM cnt), bad AS (SELECT DISTINCT n, hist, word FROM t ANTI JOIN voc ON voc.word = t.x WHERE x <> '<s>') SELECT * FROM cnt ANTI JOIN bad USING (n, hist, word)")
def a20_in_vocabulary_ngrams(spark, d):
    c = X.ngrams(lines(spark, d), "text", 3)
    t = c.withColumn("g", F.concat(F.when(F.col("hist") == "", F.array().cast("array<string>")).otherwise(F.split("hist", " ")), F.array("word")))
    bad = t.select("n", "hist", "word", F.explode("g").alias("token")).filter(F.col("token") != X.BOS).join(_vocabulary(c), "token", "left_anti").select("n", "hist", "word").distinct()
    return c.join(bad, ["n", "hist", "word"], "left_anti").select("n", "hist", "word", "cnt")


@R.add(NG + _VOC + " SELECT word FROM cnt WHERE n = 1 AND word <> '</s>' AND word NOT IN (SELECT word FROM voc)")
def a21_model_oovs(spark, d):
    c = X.ngrams(lines(spark, d), "text", 1)
    return c.filter(F.col("word") != X.EOS).join(_vocabulary(c).withColumnRenamed("token", "word"), "word", "left_anti").select("word")


@R.add("WITH j AS (SELECT o_orderkey, ntile(5) OVER (ORDER BY o_orderkey) AS job FROM orders) SELECT CAST(job AS INT) AS job, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem JOIN j ON o_orderkey = l_orderkey GROUP BY 1")
def a55_split_siblings(spark, d):
    j = T.block_split(table(spark, d, "orders").select("o_orderkey"), 5, "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")
    return table(spark, d, "lineitem").join(j, "l_orderkey").groupBy("job").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@R.add(f"{B.FULL}" + B._minus(", holes AS (SELECT file_id, onset_ms, offset_ms FROM merged_ref WHERE speaker_id = 'error')"))
def b09_noscore_zones(spark, d):
    zones = B.ref(spark, d).filter("speaker_id = 'error'").select("file_id", "onset_ms", "offset_ms")
    return I.subtract(B.uem(spark, d), zones, ["file_id"])


_EXTEND = 500
_ZONES = f"""{B.FULL}, kind AS (SELECT file_id, speaker_id, onset_ms, offset_ms FROM turns_ref WHERE offset_ms > onset_ms),
 lx AS (SELECT file_id, onset_ms, offset_ms FROM merged_ref WHERE speaker_id = 'purchase'), bd AS (SELECT file_id, unnest([onset_ms, offset_ms]) AS t FROM kind WHERE speaker_id IN ('signup', 'view')),
 nz AS (SELECT file_id, min(onset_ms) AS b, max(offset_ms) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY onset_ms, offset_ms) AS g FROM (SELECT file_id, onset_ms, offset_ms, CASE WHEN onset_ms <= max(offset_ms) OVER (PARTITION BY file_id ORDER BY onset_ms, offset_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM kind WHERE speaker_id IN ('click', 'error')) x) y GROUP BY file_id, g),
 l AS (SELECT file_id, b, max(onset_ms <= b AND offset_ms > b) AS inside, max(offset_ms) FILTER (offset_ms <= b) AS stop FROM nz LEFT JOIN lx USING (file_id) GROUP BY 1, 2), r AS (SELECT file_id, e, max(onset_ms < e AND offset_ms > e) AS inside, min(onset_ms) FILTER (onset_ms >= e) AS stop, max(offset_ms) AS last FROM nz LEFT JOIN lx USING (file_id) GROUP BY 1, 2),
 q AS (SELECT file_id, b, e, max(t) FILTER (t <= b) AS lb, min(t) FILTER (t >= e) AS rb FROM nz LEFT JOIN bd USING (file_id) GROUP BY 1, 2, 3),
 holes AS (SELECT file_id, CASE WHEN l.inside THEN b ELSE greatest(b - {_EXTEND}, l.stop, lb) END AS onset_ms, CASE WHEN rb IS NULL AND r.stop IS NULL AND NOT coalesce(last > e, FALSE) AND e = max(e) OVER (PARTITION BY file_id) THEN 1000000000000 WHEN r.inside THEN e ELSE least(e + {_EXTEND}, r.stop, rb) END AS offset_ms FROM q JOIN l USING (file_id, b) JOIN r USING (file_id, e))"""


@R.add(B._minus(_ZONES))
def b09_extended_zones(spark, d):
    """Zones of two kinds, extended to the nearest word or segment boundary, taken out of the scoring regions."""
    t = view(spark, d, "turns_ref")
    of = lambda *kinds: t.filter(F.col("speaker_id").isin(*kinds))
    return I.without_zones(B.uem(spark, d), I.extended_zones(of("click", "error"), of("purchase"), of("signup", "view"), ["file_id"], _EXTEND), ["file_id"])


@R.add(cte("turns_ref") + """, u0 AS (SELECT file_id AS reco, turn_id AS utt, onset_ms AS b, offset_ms AS e, (SELECT p_name FROM part WHERE p_partkey = turn_id % (SELECT count(*) FROM part)) AS name FROM turns_ref),
 wd AS (SELECT utt, i AS pos, string_split(name, ' ')[i + 1] AS word, i * (e - b) // len(string_split(name, ' ')) AS s, (e - b) // len(string_split(name, ' ')) AS dur FROM (SELECT *, unnest(range(0, len(string_split(name, ' ')))) AS i FROM u0 WHERE name IS NOT NULL) x),
 n AS (SELECT *, lag(e) OVER w - b AS own, lag(e) OVER w >= e AS inside, e - lead(b) OVER w AS ahead, lead(e) OVER w <= e AS holds FROM u0 WHERE name IS NOT NULL WINDOW w AS (PARTITION BY reco ORDER BY b, utt)),
 f AS (SELECT n.*, (SELECT min(pos) FROM wd WHERE wd.utt = n.utt AND 2 * s + dur > own) AS first FROM n), k AS (SELECT *, own IS NOT NULL AND ((own > 0 AND inside) OR first IS NULL) AS dies FROM f),
 g AS (SELECT *, sum(CASE WHEN dies THEN 0 ELSE 1 END) OVER (PARTITION BY reco ORDER BY b, utt) AS run FROM k), h AS (SELECT *, sum(CASE WHEN dies THEN 1 ELSE 0 END) OVER (PARTITION BY reco, run ORDER BY b, utt) % 2 = 1 AS empty FROM g),
 v AS (SELECT *, NOT lag(empty) OVER (PARTITION BY reco ORDER BY b, utt) AS cut FROM h),
 kept AS (SELECT wd.*, ahead, holds, e - b AS len FROM wd JOIN v USING (utt) WHERE NOT empty AND (NOT coalesce(cut, FALSE) OR pos >= first)),
 st AS (SELECT utt, min(pos) FILTER (ahead IS NOT NULL AND NOT coalesce(ahead > 0 AND holds, FALSE) AND 2 * s + dur > 2 * len - ahead) AS stop FROM kept GROUP BY 1)
 SELECT utt, CAST(pos AS INT) AS pos, word, s AS start_ms, dur AS dur_ms FROM kept JOIN st USING (utt) WHERE stop IS NULL OR pos < stop""")
def b28_word_overlaps(spark, d):
    """Words of turns (those of a part's name, spread over the turn) after neighbours' overlaps are resolved, turns inside others included."""
    t = view(spark, d, "turns_ref")
    part = table(spark, d, "part")
    name = part.select(F.col("p_partkey").alias("k"), F.split("p_name", " ").alias("w"))
    length = F.col("offset_ms") - F.col("onset_ms")
    words = t.withColumn("k", F.col("turn_id") % F.lit(part.count())).join(name, "k").select(F.col("turn_id").alias("utt"), length.alias("len"), F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    words = words.select("utt", "pos", "word", F.expr("pos * len div n").alias("start_ms"), F.expr("len div n").alias("dur_ms"))
    return I.resolve_word_overlaps(words, t.select(F.col("file_id").alias("reco"), F.col("turn_id").alias("utt"), F.col("onset_ms").alias("start_ms"), F.col("offset_ms").alias("end_ms")))


@R.add(cte("segments") + ", n AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM segments WINDOW w AS (PARTITION BY reco ORDER BY seq)), f AS (SELECT utt, start_ms, CASE WHEN pe > start_ms THEN (pe + start_ms) / 2.0 ELSE start_ms END AS b, CASE WHEN ns < end_ms THEN (ns + end_ms) / 2.0 ELSE end_ms END AS e FROM n), w AS (SELECT utt, start_ms + i * 250 AS t, b, e FROM f, (SELECT unnest(range(0, 6)) AS i) x) SELECT utt, t AS start_ms FROM w WHERE t + 125 >= b AND t + 125 < e")
def b28_resolve_word_overlaps(spark, d):
    """Words of 250 ms whose middle lies inside their utterance after overlaps are cut at the middle."""
    f = I.flatten_midpoint(view(spark, d, "segments"), "reco", "seq")
    w = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("t", F.col("start_ms") + F.col("i") * 250)
    return w.filter((F.col("t") + 125 >= F.col("flat_begin")) & (F.col("t") + 125 < F.col("flat_end"))).select("utt", F.col("t").alias("start_ms"))


@R.add()
def c30_cluster_levels(spark, d):
    return cluster_levels(C.x(spark, d))


@R.add()
def c56_frame_network(spark, d):
    rng = np.random.default_rng(1)
    layers = [([-1, 0, 1], rng.standard_normal((6, 24)) * 0.2, np.zeros(6)), ([0], rng.standard_normal((4, 6)) * 0.3, np.zeros(4))]
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda v: v.cast("double")))
    return W.embed(C.x(spark, d).select(F.col("node").alias("key"), frames.alias("frames")), layers)


@R.add()
def d19_score_table(spark, d):
    """One row of scores per file and one for all."""
    # what several scores read is written once: as one plan, their copies of it are more than the driver holds
    r, s = stash(B.ref(spark, d), "reference"), stash(B.sys_(spark, d), "system")
    uem, matrix = stash(B.uem(spark, d), "uem"), stash(M.overlap_matrix(r, s, ["file_id"]), "overlaps")
    c = stash(M.frame_contingency(r, s, "file_id", "speaker_id", 1000), "scores")
    own = lambda name: F.concat("file_id", F.lit("/"), name)
    every = c.unionByName(c.select(F.lit("ALL").alias("file_id"), own("ref").alias("ref"), own("sys").alias("sys"), "n"))
    total = lambda t, c: t.groupBy("file_id", F.col("speaker_id").alias(c)).agg(F.sum(F.col("offset_ms") - F.col("onset_ms")).alias("ms"))
    mapped = M.best_mapping(matrix, "file_id", "ms").groupBy("file_id").agg(F.sum("ms").alias("ms"))
    der = stash(M.der(I.atoms({"ref": r, "sys": s}, uem, ["file_id"]), mapped, uem).select("file_id", "der"), "der")
    jer = stash(M.jaccard_error(matrix, total(r, "ref"), total(s, "sys")), "jer")
    return stash(M.cluster_scores(every, ["file_id"]), "cluster-scores").join(der, "file_id", "left").join(jer, "file_id", "left")


@R.add(C.BASE + ", g AS (SELECT a.node, list_dot_product(a.v, b.v) / (a.len * b.len) AS c FROM n a JOIN n b ON b.reco = a.reco AND b.seq = 0) SELECT node, round(cos(least(pi(), acos(greatest(-1, least(1, c))) + 0.2::DOUBLE)), 5) AS arc, round(greatest(-1, least(1, c)) - 0.2::DOUBLE, 5) AS cosine FROM g")
def f02_margin_losses(spark, d):
    x = C.x(spark, d)
    first = x.filter("seq = 0").select("reco", F.col("embedding").alias("w"))
    c = x.join(first, "reco").select("node", G.dot(G.l2_normalize(F.col("embedding")), G.l2_normalize(F.col("w"))).alias("c"))
    return c.select("node", F.round(W.margin_logit(F.col("c"), "arc", 0.2), 5).alias("arc"), F.round(W.margin_logit(F.col("c"), "cos", 0.2), 5).alias("cosine"))


_HASH = "CAST(('0x' || substr(md5(CAST({0} AS STRING)), 1, 7)) AS BIGINT)"


def hashed(c):
    """The same number in every engine: the first 28 bits of a digest."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 7), 16, 10).cast("long")


@R.add(cte("utt2spk") + f" SELECT utt, spk, CASE WHEN {_HASH.format('spk')} % 10 < 9 THEN 'train' ELSE 'validation' END AS part FROM utt2spk")
def a56_train_validation(spark, d):
    """Speakers to train and validation by a hash: every utterance follows its speaker."""
    return view(spark, d, "utt2spk").withColumn("part", F.when(hashed(F.col("spk")) % 10 < 9, "train").otherwise("validation"))


@R.add("SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('7-', CAST(o_orderkey AS STRING))), o_orderkey) - 1 AS place FROM orders")
def a47_seeded_shuffle(spark, d):
    return T.shuffled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=7)


@R.add("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, low, i) AS (SELECT DISTINCT a, a, 0 FROM s UNION ALL SELECT node, min(low) AS low, i FROM (SELECT s.a AS node, least(x.low, y.low) AS low, x.i + 1 AS i FROM s JOIN r x ON x.node = s.a JOIN r y ON y.node = s.b WHERE x.i < 40) q GROUP BY node, i) SELECT node, low AS component FROM r WHERE i = 40")
def a44_class_closure(spark, d):
    """Classes that share a member, closed; the SQL spreads least labels forty steps, more than the graph is wide."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"))
    return connected_components(e)


_TRI = NG + ", uni AS (SELECT word, cnt::DOUBLE / (SELECT sum(cnt) FROM cnt WHERE n = 1) AS p FROM cnt WHERE n = 1), bi AS (SELECT hist, word, (cnt - 0.5::DOUBLE) / sum(cnt) OVER (PARTITION BY hist) AS p FROM cnt WHERE n = 2), bw AS (SELECT hist, 0.5::DOUBLE * count(*) / sum(cnt) AS bow FROM cnt WHERE n = 2 GROUP BY 1)"
_TRI += ", t AS (SELECT concat_ws(' ', hist, word) AS id, list_concat(['<s>'], string_split(concat_ws(' ', hist, word), ' '), ['</s>']) AS w FROM cnt WHERE n = 3), tk AS (SELECT id, w[i] AS word, w[i - 1] AS hist FROM (SELECT id, w, unnest(range(2, len(w) + 1)) AS i FROM t) x)"


@R.add(_TRI + " SELECT id, count(*) AS n_tokens, round(sum(coalesce(log10(bi.p), log10(coalesce(bow, 1.0)) + coalesce(log10(uni.p), -7.0))), 4) AS logp FROM tk LEFT JOIN bi ON bi.hist = tk.hist AND bi.word = tk.word LEFT JOIN uni ON uni.word = tk.word LEFT JOIN bw ON bw.hist = tk.hist GROUP BY 1")
def e08_joint_probability(spark, d):
    """log10 of each trigram's joint probability under the bigram model of its own text."""
    c = X.ngrams(lines(spark, d), "text", 3)
    one = c.filter("n = 1")
    uni = one.join(F.broadcast(one.agg(F.sum("cnt").alias("total")))).select("word", (F.col("cnt") / F.col("total")).alias("p"))
    b = c.filter("n = 2")
    bi = b.select("hist", "word", ((F.col("cnt") - 0.5) / F.sum("cnt").over(Window.partitionBy("hist"))).alias("p"))
    bow = b.groupBy("hist").agg((0.5 * F.count("*") / F.sum("cnt")).alias("bow"))
    t = c.filter("n = 3").select(F.concat_ws(" ", "hist", "word").alias("id"))
    return X.score_sentences(t.withColumn("text", F.col("id")), "id", "text", uni, bi, bow)


@R.add()
def e08_model_lookup(spark, d):
    """log p of every trigram and of its history under the bigram model, by back-off."""
    from voxlake.plans.text_queries import _bigram_model

    m = stash(_bigram_model(spark, d), "model")
    t = stash(X.ngrams(lines(spark, d), "text", 3).filter("n = 3").select("hist", "word"), "asked")
    return L.lookup(t, m, 2).join(L.joint_probability(t, m, 2), "hist").select("hist", "word", F.round("logp", 6).alias("logp"), F.round("joint", 6).alias("joint"))


def _labelled(k):
    """SQL of one level's labelled edges at k neighbours."""
    base = C.BASE.replace(f"rank < {C.K}", f"rank < {k}")
    dens = C.DENS.replace(f"/ {C.K - 1}", f"/ {k - 1}")
    return f"(WITH {base.split('WITH ', 1)[1]}, {C.EDGES.replace('>= 0.1', '>= 0.0')}, {dens}, w AS (SELECT *, sum(sim) OVER (PARTITION BY dst) AS t FROM edges) SELECT {k} AS k, w.reco, src, dst, w.sim, w.sim / CASE WHEN t <= 0 THEN 1 ELSE t END AS affine, x.label = y.label AS same, a.density > b.density AS mask FROM w JOIN dens a ON a.node = src JOIN dens b ON b.node = dst JOIN xvec x ON x.node = src JOIN xvec y ON y.node = dst)"


@R.add(f"SELECT k, reco, src, dst, sim, round(affine, 6) AS affine, same, mask FROM {_labelled(5)} UNION ALL SELECT k, reco, src, dst, sim, round(affine, 6), same, mask FROM {_labelled(10)}")
def f04_training_set(spark, d):
    """Labelled edges of the first level's graphs of several k: what an edge model is trained on."""
    return G.training_edges(C.x(spark, d), (5, 10)).select("k", "reco", "src", "dst", "sim", F.round("affine", 6).alias("affine"), "same", "mask")


@R.add()
def f04_training_levels(spark, d):
    """The same at every level: nodes of a level are the clusters of the one before."""
    return G.training_levels(C.x(spark, d), (5, 10), levels=3)


_LOSS = f"{C.BASE}, {C.EDGES}, {C.DENS}, {C._P}, t AS (SELECT dst AS node, sum(sim * (p1 - p0)) / count(*) AS pd FROM pr GROUP BY 1), m AS (SELECT avg(power(pd - density, 2)) AS mse FROM t JOIN dens USING (node)), e AS (SELECT CASE WHEN x.label = y.label THEN p1 ELSE 1 - p1 END AS p FROM pr JOIN dens a ON a.node = src JOIN dens b ON b.node = dst JOIN xvec x ON x.node = src JOIN xvec y ON y.node = dst WHERE a.density > b.density), f AS (SELECT avg(-ln(p)) AS ce, avg(-0.25::DOUBLE * power(1 - p, 2) * ln(p)) AS focal FROM e)"


@R.add(_LOSS + " SELECT round(mse, 6) AS mse, round(ce, 6) AS ce, round(focal, 6) AS focal, round(0.2::DOUBLE * mse + 0.8::DOUBLE * ce, 6) AS loss, round(0.2::DOUBLE * mse + 0.8::DOUBLE * focal, 6) AS focal_loss FROM m, f")
def f01_density_loss(spark, d):
    """Squared error of densities and, over edges to denser nodes, cross entropy or focal loss, weighed 1 - beta and beta."""
    scored = C._scored(spark, d)
    return G.joint_loss(scored, C.dens(spark, d), scored.join(C.c18_edge_labels(spark, d), ["src", "dst"]), beta=0.8, gamma=2.0, alpha=0.25)


@R.add("SELECT vec_id AS node, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total FROM embeddings")
def f07_saved_parameters(spark, d):
    """A checkpoint of parameters by (layer, place), written, read again and used."""
    w = table(spark, d, "embeddings").select(F.col("vec_id").alias("layer"), F.posexplode("embedding").alias("place", "value"))
    saved = stash(w.withColumn("value", F.col("value").cast("double")), "parameters")
    return saved.groupBy(F.col("layer").alias("node")).agg(F.round(F.sum("value"), 4).alias("total"))


@R.add(f"SELECT a.file_id, printf('%-12s %8.2f %8.2f', a.file_id, a.der, b.jer) AS line FROM ({D.R.oracle['d15_der']}) a JOIN ({D.R.oracle['d18_jer']}) b ON a.file_id = b.file_id UNION ALL SELECT '*** OVERALL ***', printf('%-12s %8.2f %8.2f', '*** OVERALL ***', 100.0::DOUBLE * sum(miss + fa + error) / sum(scored), avg(b.jer)) FROM ({D.R.oracle['d15_der']}) a JOIN ({D.R.oracle['d18_jer']}) b ON a.file_id = b.file_id")
def d20_score_table(spark, d):
    return M.score_lines(D._der(spark, d).join(D.d18_jer(spark, d), "file_id"))


def _written(spark, label):
    import uuid

    from voxlake.session import shared_dir

    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@R.add("SELECT c_mktsegment AS domain, c_name AS uri FROM customer")
def s11_domain_scan(spark, d):
    path = _written(spark, "recordings")
    table(spark, d, "customer").select(F.col("c_name").alias("uri"), F.col("c_mktsegment").alias("domain"), "c_nationkey").write.option("sep", "\t").option("header", True).csv(path)
    return S.read_domains(spark, path)


@R.add(cte("turns_ref") + " SELECT 'SPEAKER' AS type, file_id, '1' AS channel, onset_ms, offset_ms, speaker_id FROM turns_ref WHERE offset_ms > onset_ms")
def s04_turn_list(spark, d):
    """Turns written to several folders, named by a list, read together."""
    t = view(spark, d, "turns_ref")
    paths = []
    for k in range(3):
        paths.append(_written(spark, "turns"))
        S.write_turns(t.filter(F.col("turn_id") % 3 == k), paths[-1])
    listed = _written(spark, "turn-list")
    spark.createDataFrame([(p,) for p in paths], "value string").coalesce(1).write.text(listed)
    return S.read_turn_list(spark, listed)


@R.add("SELECT CAST(vec_id AS STRING) AS key, [CAST(label AS STRING), CAST(label % 3 AS STRING)] AS rest FROM embeddings")
def s19_label_files(spark, d):
    path = _written(spark, "labels")
    S.write_labels(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("utt"), F.concat_ws(" ", F.col("label").cast("string"), (F.col("label") % 3).cast("string")).alias("labels")), path)
    return S.read_table(spark, path)


@R.add("SELECT event_type AS kwid, CAST(user_id AS STRING) AS utt, value AS tbeg, 0.5::DOUBLE AS dur, floor(value) / 500 AS score FROM events")
def s20_hit_files(spark, d):
    path = _written(spark, "hits")
    h = table(spark, d, "events").select(F.col("event_type").alias("kwid"), F.col("user_id").cast("string").alias("utt"), F.col("value").alias("tbeg"), F.lit(0.5).alias("dur"), (F.floor("value") / 500).alias("score"))
    S.write_hits(h, path)
    return S.read_hits(spark, path)


@R.add(NG.replace("least(3, p)", "least(2, p)") + " SELECT n, CASE WHEN hist = '' THEN word ELSE concat(hist, ' ', word) END AS ngram, round(-log10(cnt + 1.0::DOUBLE), 6) AS logp, CASE WHEN n = 1 THEN -0.5::DOUBLE END AS bow FROM cnt")
def s21_model_file(spark, d):
    """A model written as text and read again."""
    c = X.ngrams(lines(spark, d), "text", 2)
    m = c.select("n", F.trim(F.concat_ws(" ", "hist", "word")).alias("ngram"), (-F.log10(F.col("cnt") + 1.0)).alias("logp"), F.when(F.col("n") == 1, -0.5).alias("bow"))
    numbered = T.running_sum(T.slices(S.arpa_lines(m), "n", "place", "line"), F.lit(1), "number", "n", "place", "line").select("number", "line")
    return S.parse_arpa(numbered)


@R.add(cte("xvec") + " SELECT reco, count(*) AS n, CAST(any_value(len(embedding)) AS INT) AS cols, round(sum(list_sum(list_transform(embedding, lambda v: v::DOUBLE))), 4) AS total FROM xvec GROUP BY 1")
def s17_repack(spark, d):
    """Vectors of a recording packed into one archive matrix each, rows in order, and read again."""
    path = _written(spark, "matrices")
    ark.write_matrices(C.x(spark, d), "reco", "seq", "embedding", path)
    ark.register(spark)
    t = spark.read.format("ark").load(path)
    return t.select(F.col("key").alias("reco"), F.col("rows").cast("long").alias("n"), "cols", F.round(F.aggregate("data", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))
