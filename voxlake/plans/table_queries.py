"""Family A over orders, lineitem, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.fixtures import cte, view
from voxlake.operators import tables as T
from voxlake.plans.registry import Registry
from voxlake.session import table

R = Registry()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("spk"), F.lower("text").alias("text"))


LINES = "lines AS (SELECT concat_ws('-', conv_id, turn) AS id, conv_id AS spk, lower(text) AS text FROM conversations)"
TOKENS = LINES + ", tokens AS (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda t: t <> '') AS w FROM lines) x)"
JOINED = "SELECT id, string_agg(v, ' ' ORDER BY pos) AS text FROM m GROUP BY id"


@R.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def a01_filter_semi(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.filter_keys(table(spark, d, "lineitem"), ids, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@R.add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def a02_filter_anti(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.filter_keys(table(spark, d, "lineitem"), ids, "l_orderkey", exclude=True).select("l_orderkey", "l_linenumber", "l_quantity")


_LISTS = "lists AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderkey % 4 + 1 AS INT) AS job FROM orders WHERE o_orderstatus = 'F')"


def _lists(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("job"))


@R.add(f"WITH {_LISTS} SELECT c_custkey, job, c_mktsegment FROM customer JOIN lists ON k = c_custkey")
def a03_route_jobs(spark, d):
    return T.route_to_jobs(table(spark, d, "customer"), _lists(spark, d), "c_custkey").select("c_custkey", "job", "c_mktsegment")


@R.add(f"WITH {_LISTS} SELECT c_custkey, count(job) AS n_jobs FROM customer LEFT JOIN lists ON k = c_custkey GROUP BY c_custkey")
def a03_route_coverage(spark, d):
    return T.route_coverage(table(spark, d, "customer"), _lists(spark, d), "c_custkey")


@R.add("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) < 80) AND p_type NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) < 80)")
def a04_remove_arcs(spark, d):
    p = table(spark, d, "part")
    bad = p.groupBy("p_brand").count().filter("count < 80").select(F.col("p_brand").alias("word"))
    return T.drop_arcs_with(p, bad, ["p_brand", "p_type"], "word").select("p_partkey", "p_brand", "p_type")


_VOCAB = "vocab AS (SELECT token FROM tokens GROUP BY token HAVING count(*) >= 20)"


def _vocab(spark, d):
    return T.tokens_of(_lines(spark, d), "id", "text").groupBy("token").count().filter("count >= 20")


@R.add(f"WITH {TOKENS}, {_VOCAB}, m AS (SELECT id, pos, CASE WHEN token IN (SELECT token FROM vocab) THEN token ELSE '<UNK>' END AS v FROM tokens) {JOINED}")
def a05_replace_oov(spark, d):
    return T.replace_oov(_lines(spark, d), _vocab(spark, d), "id", "text")


@R.add("SELECT l_orderkey AS k, min(l_returnflag) AS label FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def a06_single_label(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("labels"))
    return t.filter(F.size("labels") == 1).select("k", F.col("labels")[0].alias("label"))


@R.add("SELECT event_id, CASE event_type WHEN 'click' THEN '<eps>' WHEN '<eps>' THEN '#0' ELSE event_type END AS sym FROM events")
def a07_rewrite_symbols(spark, d):
    return table(spark, d, "events").select("event_id", T.map_field(F.col("event_type"), {"click": "<eps>", "<eps>": "#0"}).alias("sym"))


@R.add(cte("segments") + " SELECT utt, round((end_ms - start_ms) / 1000.0, 6) AS dur, CAST(floor(round(((end_ms - start_ms) / 1000.0 - 0.015) / 0.01, 6)) AS BIGINT) AS frames FROM segments")
def a08_durations(spark, d):
    dur = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    return view(spark, d, "segments").select("utt", F.round(dur, 6).alias("dur"), F.floor(F.round((dur - 0.015) / 0.01, 6)).cast("long").alias("frames"))


@R.add("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment IS NOT NULL")
def a09_positive_records(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 0 and c_mktsegment is not null").select("c_custkey", "c_acctbal")


@R.add(f"WITH {TOKENS}, {_VOCAB}, m AS (SELECT t.id, pos, CASE WHEN v.token IS NOT NULL THEN concat(t.token, '_1 ', t.token, '_2') ELSE t.token END AS v FROM tokens t LEFT JOIN vocab v ON v.token = t.token) {JOINED}")
def a10_map_permissive(spark, d):
    image = _vocab(spark, d).select("token", F.concat("token", F.lit("_1 "), "token", F.lit("_2")).alias("image"))
    return T.map_tokens(_lines(spark, d), image, "id", "text")


_IDS = "ids AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS i FROM vocab)"


def _ids(spark, d):
    return T.relabel_by_value(_vocab(spark, d).select("token", F.lit(0).alias("g")), ["g"], "token").select("token", F.col("new_label").alias("i"))


@R.add(f"WITH {TOKENS}, {_VOCAB}, {_IDS}, m AS (SELECT t.id, pos, CAST(coalesce(i, -1) AS STRING) AS v FROM tokens t LEFT JOIN ids USING (token)) {JOINED}")
def a11_sym2int(spark, d):
    t = T.tokens_of(_lines(spark, d), "id", "text").join(_ids(spark, d), "token", "left")
    return T.join_tokens(t, "id", F.coalesce("i", F.lit(-1)).cast("string"))


@R.add(f"WITH {TOKENS}, {_VOCAB}, m AS (SELECT id, pos, coalesce(v.token, '<oov>') AS v FROM tokens t LEFT JOIN vocab v ON v.token = t.token) {JOINED}")
def a12_int2sym(spark, d):
    ids = _ids(spark, d)
    numbers = T.tokens_of(_lines(spark, d), "id", "text").join(ids, "token", "left").select("id", "pos", F.coalesce("i", F.lit(-1)).alias("i"))
    back = numbers.join(ids, "i", "left")
    return T.join_tokens(back, "id", F.coalesce("token", F.lit("<oov>")))


@R.add("SELECT event_type AS label, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS id FROM events GROUP BY 1")
def a13_dense_ids(spark, d):
    return T.dense_ids(table(spark, d, "events"), "event_type", "event_id").select(F.col("event_type").alias("label"), "id")


@R.add("SELECT l_orderkey, l_linenumber, l_returnflag, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f, l_returnflag) - 1 AS new_label FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS f FROM lineitem) t")
def a14_relabel_appearance(spark, d):
    return T.relabel_by_appearance(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber").select("l_orderkey", "l_linenumber", "l_returnflag", "new_label")


@R.add("SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS new_label FROM lineitem")
def a15_relabel_value(spark, d):
    return T.relabel_by_value(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag").select("l_orderkey", "l_linenumber", "new_label")


@R.add("SELECT n_name AS symbol, CAST(n_nationkey AS BIGINT) AS id FROM nation UNION ALL SELECT concat('#', CAST(i AS STRING)), CAST(m + i AS BIGINT) FROM (SELECT max(n_nationkey) AS m FROM nation) a, (SELECT unnest([1,2,3]) AS i) b")
def a16_add_disambig(spark, d):
    return T.add_disambiguation(table(spark, d, "nation").select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("id")), 3)


@R.add("SELECT concat('p-', CAST(o_orderkey AS STRING)) AS utt, concat('p-', CAST(o_custkey AS STRING)) AS spk FROM orders")
def a17_rename_ids(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("p-"), F.col("o_orderkey").cast("string")).alias("utt"), F.concat(F.lit("p-"), F.col("o_custkey").cast("string")).alias("spk"))


_PIN = "^(ZH|CH|SH|[B-DF-HJ-NP-TW-Z])?(.*)$"


@R.add(f"WITH {TOKENS} SELECT DISTINCT token, regexp_extract(upper(token), '{_PIN}', 1) AS initial, regexp_extract(upper(token), '{_PIN}', 2) AS final FROM tokens WHERE regexp_matches(token, '^[a-z]+$')")
def a18_initial_final(spark, d):
    t = T.tokens_of(_lines(spark, d), "id", "text").filter(F.col("token").rlike("^[a-z]+$")).select("token").distinct()
    return t.select("token", F.regexp_extract(F.upper("token"), _PIN, 1).alias("initial"), F.regexp_extract(F.upper("token"), _PIN, 2).alias("final"))


@R.add("SELECT o_custkey AS spk, string_agg(CAST(o_orderkey AS STRING), ' ' ORDER BY o_orderkey) AS utts FROM orders GROUP BY 1")
def a22_spk2utt(spark, d):
    t = T.group_list(view(spark, d, "utt2spk"), "spk", "utt", "utt")
    return t.select("spk", F.array_join(F.transform("members", lambda u: u.cast("string")), " ").alias("utts"))


@R.add("SELECT o_orderkey AS utt, o_custkey AS spk FROM orders")
def a23_utt2spk(spark, d):
    return T.ungroup_list(T.group_list(view(spark, d, "utt2spk"), "spk", "utt", "utt"), "spk", "members", "utt").select("utt", "spk")


@R.add(cte("segments") + " SELECT reco, string_agg(utt, ' ' ORDER BY utt) AS utts FROM segments GROUP BY 1")
def a24_reco2utt(spark, d):
    return T.group_list(view(spark, d, "segments"), "reco", "utt", "utt").select("reco", F.array_join("members", " ").alias("utts"))


@R.add("SELECT conv_id AS reco, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def a25_merge_recordings(spark, d):
    return T.group_list(table(spark, d, "conversations"), "conv_id", "text", "turn").select(F.col("conv_id").alias("reco"), F.array_join("members", " ").alias("text"))


@R.add(cte("utt2dur") + " SELECT CAST(sum(dur) AS BIGINT) AS total, avg(dur) AS mean, max(dur) AS longest, (SELECT utt FROM utt2dur ORDER BY dur DESC, utt LIMIT 1) AS longest_key, min(dur) AS shortest, (SELECT utt FROM utt2dur ORDER BY dur, utt LIMIT 1) AS shortest_key FROM utt2dur")
def a26_segment_stats(spark, d):
    return T.segment_stats(view(spark, d, "utt2dur"), "utt", "dur")


@R.add(cte("turns_ref") + " SELECT file_id, count(DISTINCT speaker_id) AS n_speakers FROM turns_ref GROUP BY 1")
def a27_speaker_count(spark, d):
    return T.speakers_per_recording(view(spark, d, "turns_ref"), "file_id", "speaker_id")


@R.add(cte("utt2dur") + " SELECT CAST(sum(dur) AS DOUBLE) / 10 AS frames FROM utt2dur")
def a28_total_frames(spark, d):
    return view(spark, d, "utt2dur").agg((F.sum("dur").cast("double") / 10).alias("frames"))


@R.add(cte("utt2dur") + ", t AS (SELECT dur, CAST(floor(dur / 10.05) AS BIGINT) AS n FROM utt2dur ORDER BY utt LIMIT 10) SELECT round(CASE WHEN sum(dur) / 1000.0 / sum(n) > 0.01 AND sum(dur) / 1000.0 / sum(n) < 0.0102 THEN 0.01 ELSE sum(dur) / 1000.0 / sum(n) END, 6) AS shift FROM t")
def a29_frame_shift(spark, d):
    t = T.first_n(view(spark, d, "utt2dur"), 10, "utt").withColumn("n", F.floor(F.col("dur") / 10.05))
    s = F.sum("dur") / 1000.0 / F.sum("n")
    return t.agg(F.round(F.when((s > 0.01) & (s < 0.0102), 0.01).otherwise(s), 6).alias("shift"))


@R.add(cte("utt2dur") + ", b AS (SELECT dur, sum(dur) AS s FROM utt2dur GROUP BY dur), c AS (SELECT dur, sum(s) OVER (ORDER BY dur) AS u, sum(s) OVER (ORDER BY dur DESC) AS v, sum(s) OVER () * 5.0 / 100 AS bar FROM b) SELECT min(dur) FILTER (u > bar) AS lo, max(dur) FILTER (v > bar) AS hi FROM c")
def a30_coverage_range(spark, d):
    return T.coverage_range(view(spark, d, "utt2dur"), "dur", 5.0)


_LADDER = "SELECT CAST(i AS BIGINT) AS rung, CAST(round(round(500 * power(1.1, i)) / 10) * 10 AS BIGINT) AS dur_ms FROM range(0, 60) t(i)"


def _ladder(spark):
    return spark.range(60).select(F.col("id").alias("rung"), (F.round(F.round(500 * F.pow(F.lit(1.1), "id")) / 10) * 10).cast("long").alias("dur_ms"))


_RANGE = "b AS (SELECT dur, sum(dur) AS s FROM utt2dur GROUP BY dur), c AS (SELECT dur, sum(s) OVER (ORDER BY dur) AS u, sum(s) OVER (ORDER BY dur DESC) AS v, sum(s) OVER () * 5.0 / 100 AS bar FROM b), e AS (SELECT min(dur) FILTER (u > bar) AS lo, max(dur) FILTER (v > bar) AS hi FROM c)"
_SNAP = "CASE WHEN (trunc(x - 25) / 10 + 1) % 3 <> 0 THEN 10 * (3 * floor((trunc(x - 25) / 10 + 1) / 3) - 1) + 30 ELSE x END"
_RUNGS = f"{_RANGE}, raw(x, hi) AS (SELECT greatest(lo, 300)::DOUBLE, hi FROM e UNION ALL SELECT ({_SNAP}) * 1.12::DOUBLE, hi FROM raw WHERE ({_SNAP}) * 1.12::DOUBLE < hi), ladder AS (SELECT {_SNAP} AS dur_ms FROM raw WHERE x < hi)"


def _allowed(spark, d):
    """Rungs over the range that covers all but five percent of the time at each end."""
    r = T.coverage_range(view(spark, d, "utt2dur"), "dur", 5.0).first()
    return T.duration_ladder(r["lo"], r["hi"], 1.12) if r["lo"] is not None else []


@R.add(cte("utt2dur").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_RUNGS} SELECT dur_ms, CAST(trunc(trunc(dur_ms - 25) / 10 + 1) AS BIGINT) AS length FROM ladder")
def a31_duration_ladder(spark, d):
    return spark.createDataFrame(_allowed(spark, d), "dur_ms double, length long")


@R.add(cte("utt2dur").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_RUNGS}, m AS (SELECT min(dur_ms) AS first, max(dur_ms) AS last FROM ladder),
 x AS (SELECT utt, dur::DOUBLE AS d, max(dur_ms) FILTER (dur_ms < dur OR (dur_ms = dur AND dur = first)) AS lo, min(dur_ms) FILTER (dur_ms > dur OR (dur_ms = dur AND dur > first)) AS hi FROM utt2dur, ladder, m GROUP BY utt, dur),
 y AS (SELECT *, lo IS NULL OR greatest(d / lo, lo / d) <= 1.12::DOUBLE AS go, greatest(d / hi, hi / d) <= 1.12::DOUBLE AS near FROM x)
 SELECT utt, 'pv1' AS variant, lo AS dur_ms, d / lo AS speed FROM y WHERE go AND lo IS NOT NULL UNION ALL SELECT utt, 'pv2', hi, d / hi FROM y WHERE go AND near UNION ALL SELECT utt, 'pv3', hi, 1.0::DOUBLE FROM y WHERE go AND near AND hi - d > 0.1""")
def a32_allowed_variants(spark, d):
    """Copies of every utterance at the allowed durations next to its own."""
    return T.allowed_variants(view(spark, d, "utt2dur"), "utt", "dur", [x for x, _ in _allowed(spark, d)], 1.12)


@R.add(cte("utt2dur") + f", ladder AS ({_LADDER}), x AS (SELECT utt, dur, max(dur_ms) FILTER (dur_ms <= dur) AS lo, min(dur_ms) FILTER (dur_ms > dur) AS hi FROM utt2dur, ladder GROUP BY utt, dur) SELECT utt, lo, hi, dur::DOUBLE / lo <= 1.06 AS down, hi::DOUBLE / dur <= 1.06 AS up FROM x")
def a32_assign_rungs(spark, d):
    rungs = F.broadcast(_ladder(spark).agg(F.array_sort(F.collect_list("dur_ms")).alias("l")))  # 60 numbers
    t = view(spark, d, "utt2dur").join(rungs)
    lo, hi = F.array_max(F.filter("l", lambda x: x <= F.col("dur"))), F.array_min(F.filter("l", lambda x: x > F.col("dur")))
    t = t.select("utt", "dur", lo.alias("lo"), hi.alias("hi"))
    return t.select("utt", "lo", "hi", (F.col("dur") / F.col("lo") <= 1.06).alias("down"), (F.col("hi") / F.col("dur") <= 1.06).alias("up"))


@R.add("SELECT CAST(floor(value / 10) + 1 AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value >= 0 AND value < 500 GROUP BY 1")
def a33_histogram(spark, d):
    return T.histogram(table(spark, d, "events").filter("value >= 0 and value < 500"), "value", 0, 500, 50)


@R.add("SELECT p_brand AS word, p_type AS pron, round((count(*) + 1) / sum(count(*) + 1) OVER (PARTITION BY p_brand), 6) AS prob FROM part GROUP BY 1, 2")
def a34_pron_probs(spark, d):
    return T.pronunciation_probs(table(spark, d, "part").select(F.col("p_brand").alias("word"), F.col("p_type").alias("pron")), "word", "pron")


@R.add("WITH p AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS p FROM lineitem) SELECT l_linenumber AS word, round(greatest(0.01, least(0.99, (count(*) FILTER (l_returnflag = 'R') + 2 * any_value(p)) / (count(*) + 2))), 6) AS sil_prob FROM lineitem, p GROUP BY 1")
def a35_silence_probs(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("word"), (F.col("l_returnflag") == "R").cast("double").alias("s"))
    p = F.broadcast(t.agg(F.avg("s").alias("p")))  # one row
    n = t.groupBy("word").agg(F.sum("s").alias("k"), F.count("*").alias("n")).join(p)
    return n.select("word", F.round(F.greatest(F.lit(0.01), F.least(F.lit(0.99), (F.col("k") + 2 * F.col("p")) / (F.col("n") + 2))), 6).alias("sil_prob"))


@R.add("SELECT c_custkey AS key, 'customer' AS part FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def a36_combine(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("part"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("part")))


@R.add("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) t WHERE rn = 1")
def a37_first_per_key(spark, d):
    return T.first_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@R.add("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def a38_restrict_together(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return T.restrict_together({"documents": (docs, "doc_id"), "labels": (labels, "doc_id")})["documents"].select("doc_id", "lang")


@R.add("SELECT doc_id, CASE WHEN contains(text, chr(13)) THEN 'carriage return' WHEN regexp_matches(text, '[\\x{00a0}\\x{2000}-\\x{200b}\\x{3000}]') THEN 'odd blank' WHEN regexp_matches(text, '^\\s|\\s$') THEN 'outer blank' WHEN regexp_matches(text, '[<>#]') THEN 'reserved symbol' END AS fault FROM documents")
def a40_text_faults(spark, d):
    return table(spark, d, "documents").select("doc_id", T.text_faults(F.col("text")).alias("fault"))


@R.add("WITH t AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n FROM events), k AS (SELECT *, (row_number() OVER (ORDER BY event_id) * 103349) % 71147 / 71147.0::DOUBLE AS u FROM t WHERE n >= 50) SELECT event_id, event_type FROM t WHERE n < 50 UNION ALL SELECT event_id, event_type FROM k WHERE u < 50.0 / n")
def a41_cap_repeats(spark, d):
    return T.cap_repeats(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 50)


@R.add("SELECT 'both' AS part, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) a UNION ALL SELECT 'only documents', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) b")
def a42_set_checks(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return a.intersect(b).select(F.lit("both").alias("part"), "doc_id").unionByName(a.subtract(b).select(F.lit("only documents").alias("part"), "doc_id"))


@R.add("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def a45_first_n(spark, d):
    return T.first_n(table(spark, d, "orders").select("o_orderkey"), 100, "o_orderkey")


@R.add("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def a48_shortest_n(spark, d):
    return T.shortest_n(table(spark, d, "orders"), 100, "o_totalprice", "o_orderkey").select("o_orderkey")


@R.add("WITH t AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders), s AS (SELECT *, greatest(1, c // 4) AS k FROM t) SELECT o_custkey, o_orderkey FROM s WHERE p % k = 0 AND p < k * 4")
def a49_per_speaker_stride(spark, d):
    return T.stride_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)


@R.add("WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, coalesce(sum(n) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM b WHERE b < 500)")
def a50_whole_speakers(spark, d):
    return T.groups_until(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 500)


@R.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def a51_by_speaker_list(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return T.filter_keys(table(spark, d, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


@R.add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000))")
def a52_cascade_filter(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    o = T.filter_keys(table(spark, d, "orders"), c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.filter_keys(table(spark, d, "lineitem"), o, "l_orderkey").select("l_orderkey", "l_linenumber")


@R.add("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS INT) AS job FROM orders")
def a53_block_split(spark, d):
    return T.block_split(table(spark, d, "orders").select("o_orderkey"), 7, "o_orderkey")


@R.add("SELECT o_orderkey AS utt, o_custkey AS spk, concat(CAST(o_custkey AS STRING), '-', CAST(CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 3) AS BIGINT) AS STRING)) AS pseudo FROM orders")
def a57_pseudo_speakers(spark, d):
    return T.pseudo_speakers(view(spark, d, "utt2spk"), "spk", "utt", 3)


@R.add(cte("utt2dur") + " SELECT CASE WHEN f = 1.0 THEN CAST(utt AS STRING) ELSE concat('sp', CAST(f AS STRING), '-', CAST(utt AS STRING)) END AS utt, round(dur / f, 6) AS dur, f AS factor FROM utt2dur, (SELECT unnest([CAST(0.9 AS DOUBLE), 1.0, 1.1]) AS f) x")
def a59_perturb_speed(spark, d):
    return T.perturb_speed(view(spark, d, "utt2dur"), "utt", "dur", [0.9, 1.0, 1.1])


@R.add("SELECT event_id, user_id, coalesce(lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS shifted FROM events")
def a60_shift_features(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "events").select("event_id", "user_id", F.coalesce(F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), "value").alias("shifted"))


@R.add("SELECT vec_id, round(list_sum(list_transform(embedding[3:6], lambda x: CAST(x AS DOUBLE))), 5) AS s FROM embeddings")
def a61_select_columns(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(F.slice("embedding", 3, 4), F.lit(0.0), lambda a, x: a + x), 5).alias("s"))


_PHONES = "list_transform(range(1, length(token) + 1), lambda i: concat(substr(token, i, 1), CASE WHEN length(token) = 1 THEN '_S' WHEN i = 1 THEN '_B' WHEN i = length(token) THEN '_E' ELSE '_I' END))"
_SPELT = f"WITH {TOKENS}, sp AS (SELECT DISTINCT token, {_PHONES} AS phones FROM tokens WHERE regexp_matches(token, '^[a-z]+$'))"


def _spelt(spark, d):
    t = T.tokens_of(_lines(spark, d), "id", "text").filter(F.col("token").rlike("^[a-z]+$")).select("token").distinct()
    return t.select("token", T.position_phones(F.col("token")).alias("phones"))


@R.add(f"{_SPELT} SELECT token, array_to_string(phones, ' ') AS phones FROM sp")
def a19_position_phones(spark, d):
    return _spelt(spark, d).select("token", F.array_join("phones", " ").alias("phones"))


@R.add(f"{_SPELT}, u AS (SELECT DISTINCT unnest(phones) AS phone FROM sp), p AS (SELECT row_number() OVER (ORDER BY phone) - 1 AS id, phone, regexp_replace(phone, '_[BESI]$', '') AS base FROM u), b AS (SELECT base, row_number() OVER (ORDER BY min(id)) - 1 AS base_id FROM p GROUP BY 1) SELECT id, phone, base_id, base FROM p JOIN b USING (base)")
def a19_position_map(spark, d):
    u = _spelt(spark, d).select(F.explode("phones").alias("phone")).distinct()
    return T.position_free(T.with_rank(u, "phone").select(F.col("__rank").cast("long").alias("id"), "phone"))


@R.add("""WITH o AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY event_id) AS was FROM events) SELECT 'no orders' AS check, CAST(c_custkey AS STRING) AS key FROM customer ANTI JOIN orders ON o_custkey = c_custkey
 UNION ALL SELECT 'negative', CAST(c_custkey AS STRING) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no customer', CAST(o_orderkey AS STRING) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT 'repeated', CAST(l_orderkey AS STRING) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) x UNION ALL SELECT 'out of order', CAST(event_id AS STRING) FROM o WHERE ts < was
 UNION ALL SELECT 'outside its domain', CAST(l_orderkey AS STRING) FROM lineitem WHERE NOT (l_discount BETWEEN 0.01 AND 0.08) UNION ALL SELECT 'unknown type', CAST(event_id AS STRING) FROM events WHERE event_type NOT IN ('click', 'error', 'purchase', 'view')
 UNION ALL SELECT 'no line', CAST(o_orderkey AS STRING) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey""")  # fmt: skip
def a39_validate(spark, d):
    """Violations of a directory of tables: keys that the other side lacks, repeats, order and domains of values."""
    c, o, li, e = (table(spark, d, n) for n in ("customer", "orders", "lineitem", "events"))
    return T.violations(
        ("no orders", c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "c_custkey"), ("negative", c.filter("c_acctbal < 0"), "c_custkey"),
        ("no customer", o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "o_orderkey"), ("repeated", T.repeated_keys(li, "l_orderkey", "l_linenumber"), "l_orderkey"),
        ("out of order", T.out_of_order(e.select("event_id", "ts"), "event_id", "ts"), "event_id"), ("outside its domain", li.filter("not (l_discount between 0.01 and 0.08)"), "l_orderkey"),
        ("unknown type", e.filter("event_type not in ('click', 'error', 'purchase', 'view')"), "event_id"), ("no line", o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "o_orderkey"),
    )


_LEX = "lex AS (SELECT p_partkey, p_name AS word, trim(replace(p_type, ' ', '_B ')) AS pron FROM part), ph AS (SELECT phone FROM (SELECT unnest(string_split(pron, ' ')) AS phone FROM lex) x GROUP BY 1 HAVING count(*) >= 10)"


@R.add(f"""WITH {_LEX} SELECT 'repeated entry' AS check, word AS key FROM lex GROUP BY word, pron HAVING count(*) > 1 UNION ALL SELECT 'no pronunciation', word FROM lex WHERE pron = '' UNION ALL SELECT 'no word', CAST(p_partkey AS STRING) FROM lex WHERE trim(word) = ''
 UNION ALL SELECT 'reserved symbol', word FROM lex WHERE regexp_matches(word, '[<>#]') UNION ALL SELECT 'unknown phone', x.phone FROM (SELECT DISTINCT unnest(string_split(pron, ' ')) AS phone FROM lex) x ANTI JOIN ph ON ph.phone = x.phone
 UNION ALL SELECT 'unmarked last phone', word FROM lex WHERE NOT regexp_matches(pron, '_[BESI]$')""")  # fmt: skip
def a43_validate_lexicon(spark, d):
    lex = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("word"), F.trim(F.replace("p_type", F.lit(" "), F.lit("_B "))).alias("pron"))
    used = lex.select(F.explode(F.split("pron", " ")).alias("phone"))
    known = used.groupBy("phone").agg(F.count("*").alias("n")).filter("n >= 10").select("phone")
    return T.violations(
        ("repeated entry", T.repeated_keys(lex, "word", "pron"), "word"), ("no pronunciation", lex.filter("pron = ''"), "word"), ("no word", lex.filter("trim(word) = ''"), "p_partkey"),
        ("reserved symbol", lex.filter(F.col("word").rlike("[<>#]")), "word"), ("unknown phone", used.distinct().join(known, "phone", "left_anti"), "phone"),
        ("unmarked last phone", lex.filter(~F.col("pron").rlike("_[BESI]$")), "word"),
    )
