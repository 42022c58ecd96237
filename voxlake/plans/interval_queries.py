"""Family B over the turn views of events and the segment view of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.fixtures import MERGED_REF, MERGED_SYS, UEM, cte, view
from voxlake.operators import intervals as I
from voxlake.plans.registry import Registry

R = Registry()
BOTH = cte("turns_ref", "turns_sys")
FULL = f"{BOTH}, {MERGED_REF}, {MERGED_SYS}, {UEM}"
SPK = ["file_id", "speaker_id"]


def ref(spark, d):
    return I.merge(view(spark, d, "turns_ref"), SPK)


def sys_(spark, d):
    return I.merge(view(spark, d, "turns_sys"), SPK)


def uem(spark, d):
    return I.extent(view(spark, d, "turns_ref"), view(spark, d, "turns_sys"), keys=["file_id"])


#: Regions for clipping: the middle half of each file's extent, in two pieces.
REGIONS = "regions AS (SELECT file_id, onset_ms + (offset_ms - onset_ms) // 4 AS onset_ms, onset_ms + (offset_ms - onset_ms) // 2 - 60000 AS offset_ms FROM uem UNION ALL SELECT file_id, onset_ms + (offset_ms - onset_ms) // 2, onset_ms + 3 * ((offset_ms - onset_ms) // 4) FROM uem)"


def regions(spark, d):
    n = F.col("offset_ms") - F.col("onset_ms")
    q = lambda k: F.floor(n / k)
    u = uem(spark, d)
    a = u.select("file_id", (F.col("onset_ms") + q(4)).alias("onset_ms"), (F.col("onset_ms") + q(2) - 60000).alias("offset_ms"))
    return a.unionByName(u.select("file_id", (F.col("onset_ms") + q(2)).alias("onset_ms"), (F.col("onset_ms") + 3 * q(4)).alias("offset_ms")))


@R.add(BOTH + " SELECT turn_id, onset_ms, offset_ms FROM turns_sys WHERE onset_ms >= 0 AND onset_ms < offset_ms")
def b01_valid(spark, d):
    return I.valid(view(spark, d, "turns_sys")).select("turn_id", "onset_ms", "offset_ms")


_MERGED_FILE = MERGED_REF.replace("merged_ref", "merged_file").replace("file_id, speaker_id", "file_id")


@R.add(f"{BOTH}, {_MERGED_FILE} SELECT file_id, onset_ms, offset_ms FROM merged_file")
def b02_interval_merge(spark, d):
    return I.merge(view(spark, d, "turns_ref"), ["file_id"])


@R.add(f"{BOTH}, {MERGED_REF} SELECT * FROM merged_ref")
def b03_turn_merge(spark, d):
    return ref(spark, d)


@R.add(f"{BOTH}, {_MERGED_FILE} SELECT file_id, sum(offset_ms - onset_ms) / 1000.0 AS speech_s FROM merged_file GROUP BY 1")
def b03_speech_seconds(spark, d):
    m = I.merge(view(spark, d, "turns_ref"), ["file_id"])
    return m.groupBy("file_id").agg((F.sum(F.col("offset_ms") - F.col("onset_ms")).cast("double") / 1000).alias("speech_s"))


@R.add(f"{FULL}, {REGIONS} SELECT t.file_id, turn_id, greatest(t.onset_ms, r.onset_ms) AS onset_ms, least(t.offset_ms, r.offset_ms) AS offset_ms FROM turns_ref t JOIN regions r ON t.file_id = r.file_id AND t.onset_ms < r.offset_ms AND r.onset_ms < t.offset_ms")
def b04_turn_trim(spark, d):
    return I.clip(view(spark, d, "turns_ref"), regions(spark, d), ["file_id"]).select("file_id", "turn_id", "onset_ms", "offset_ms")


@R.add(f"{BOTH}, {UEM} SELECT * FROM uem")
def b05_uem_generate(spark, d):
    return uem(spark, d)


@R.add(f"{BOTH} SELECT file_id, min(onset_ms) AS onset_ms, max(offset_ms) AS offset_ms FROM turns_ref GROUP BY 1")
def b06_uem_from_reference(spark, d):
    return I.extent(view(spark, d, "turns_ref"), keys=["file_id"])


# A region is what remains of the extent after all holes: in the oracle, between each hole's reach so far and the next hole.
def _minus(holes: str) -> str:
    return f"""{holes}, h2 AS (SELECT file_id, greatest(h.onset_ms, u.onset_ms) AS b, least(h.offset_ms, u.offset_ms) AS e FROM holes h JOIN uem u USING (file_id) WHERE h.onset_ms < u.offset_ms AND u.onset_ms < h.offset_ms
 UNION ALL SELECT file_id, offset_ms, offset_ms FROM uem),
 h3 AS (SELECT file_id, b, coalesce(max(e) OVER (PARTITION BY file_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), (SELECT onset_ms FROM uem u WHERE u.file_id = h2.file_id)) AS reach FROM h2)
 SELECT file_id, reach AS onset_ms, b AS offset_ms FROM h3 WHERE reach < b"""


@R.add(f"{FULL}" + _minus(", holes AS (SELECT DISTINCT file_id, t - 250 AS onset_ms, t + 250 AS offset_ms FROM (SELECT file_id, unnest([onset_ms, offset_ms]) AS t FROM merged_ref) x)"))
def b07_collar_uem(spark, d):
    return I.collar_regions(uem(spark, d), ref(spark, d), ["file_id"], 250)


_CROWD = """ev AS (SELECT file_id, t, sum(x) AS x FROM (SELECT file_id, onset_ms AS t, 1 AS x FROM merged_ref UNION ALL SELECT file_id, offset_ms, -1 FROM merged_ref) a GROUP BY 1, 2),
 run AS (SELECT file_id, t, sum(x) OVER w AS n, lead(t) OVER w AS nx FROM ev WINDOW w AS (PARTITION BY file_id ORDER BY t)),
 holes AS (SELECT file_id, t AS onset_ms, nx AS offset_ms FROM run WHERE n >= 2)"""


@R.add(f"{FULL}" + _minus(", " + _CROWD))
def b08_overlap_exclude(spark, d):
    return I.exclude_overlap(uem(spark, d), ref(spark, d), ["file_id"])


ATOMS = """cuts AS (SELECT DISTINCT file_id, t FROM (SELECT file_id, unnest([onset_ms, offset_ms]) AS t FROM merged_ref UNION ALL SELECT file_id, unnest([onset_ms, offset_ms]) FROM merged_sys UNION ALL SELECT file_id, unnest([onset_ms, offset_ms]) FROM uem) x),
 spans AS (SELECT file_id, t AS onset_ms, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS offset_ms FROM cuts),
 atoms AS (SELECT s.file_id, s.onset_ms, s.offset_ms, (SELECT count(*) FROM merged_ref r WHERE r.file_id = s.file_id AND r.onset_ms < s.offset_ms AND s.onset_ms < r.offset_ms) AS n_ref,
 (SELECT count(*) FROM merged_sys r WHERE r.file_id = s.file_id AND r.onset_ms < s.offset_ms AND s.onset_ms < r.offset_ms) AS n_sys FROM spans s JOIN uem u ON s.file_id = u.file_id AND s.onset_ms < u.offset_ms AND u.onset_ms < s.offset_ms WHERE s.offset_ms IS NOT NULL)"""


def atom_frame(spark, d):
    return I.atoms({"ref": ref(spark, d), "sys": sys_(spark, d)}, uem(spark, d), ["file_id"])


@R.add(f"{FULL}, {ATOMS} SELECT * FROM atoms")
def b10_sweep_atoms(spark, d):
    return atom_frame(spark, d)


FRAMES = "frames AS (SELECT DISTINCT file_id, speaker_id, unnest(range(-((-onset_ms) // 100), -((-offset_ms) // 100))) AS frame FROM merged_ref)"


@R.add(f"{BOTH}, {MERGED_REF}, {FRAMES} SELECT file_id, speaker_id, count(*) AS n, min(frame) AS lo, CAST(sum(frame) AS BIGINT) AS s FROM frames GROUP BY 1, 2".replace("-((-onset_ms) // 100)", "(onset_ms + 99) // 100").replace("-((-offset_ms) // 100)", "(offset_ms + 99) // 100"))
def b11_frame_labels(spark, d):
    f = I.frame_labels(ref(spark, d), SPK, 100)
    return f.groupBy(*SPK).agg(F.count("*").alias("n"), F.min("frame").alias("lo"), F.sum("frame").alias("s"))


_CODE = "CASE speaker_id WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 ELSE 16 END"


@R.add(f"{BOTH}, {MERGED_REF}, {FRAMES}, c AS (SELECT file_id, frame, sum({_CODE}) AS code FROM frames GROUP BY 1, 2) SELECT file_id, CAST(code AS BIGINT) AS code, count(*) AS n FROM c GROUP BY 1, 2".replace("-((-onset_ms) // 100)", "(onset_ms + 99) // 100").replace("-((-offset_ms) // 100)", "(offset_ms + 99) // 100"))
def b12_powerset_frames(spark, d):
    index = F.expr("CASE speaker_id WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")
    f = I.powerset(I.frame_labels(ref(spark, d), SPK, 100), ["file_id"], index)
    return f.groupBy("file_id", "code").agg(F.count("*").alias("n"))


@R.add(cte("segments") + ", n AS (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM segments WINDOW w AS (PARTITION BY reco ORDER BY seq)) SELECT utt, CASE WHEN pe > start_ms THEN (pe + start_ms) / 2.0 ELSE start_ms END::DOUBLE AS flat_begin, CASE WHEN ns < end_ms THEN (ns + end_ms) / 2.0 ELSE end_ms END::DOUBLE AS flat_end FROM n")
def b13_midpoint_flatten(spark, d):
    return I.flatten_midpoint(view(spark, d, "segments"), "reco", "seq").select("utt", "flat_begin", "flat_end")


@R.add(cte("segments") + " SELECT utt, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY reco ORDER BY seq), end_ms)) AS flat_end FROM segments")
def b14_shift_flatten(spark, d):
    return I.flatten_shift(view(spark, d, "segments"), "reco", "seq").select("utt", "flat_end")


_FLAT = "flat AS (SELECT reco, seq, node % 3 AS label, seq * 750 AS b, (seq + 1) * 750 AS e FROM xvec)"
_RUNS = """SELECT reco, label, min(b) AS b, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY b) AS g FROM (SELECT *, CASE WHEN lag(label) OVER w = label AND lag(e) OVER w = b THEN 0 ELSE 1 END AS new FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY b)) x) y GROUP BY reco, label, g"""


def _flat(spark, d):
    x = view(spark, d, "xvec")
    return x.select("reco", "seq", (F.floor(F.col("node") / 30) % 3).alias("label"), (F.col("seq") * 750).alias("b"), ((F.col("seq") + 1) * 750).alias("e"))


_FLAT = _FLAT.replace("node % 3", "(node // 30) % 3")


@R.add(cte("xvec") + f", {_FLAT} " + _RUNS.format(k="reco", t="flat"))
def b15_label_merge(spark, d):
    return I.merge_labels(_flat(spark, d), "reco", "label", "b", "e")


_MULTI = "multi AS (SELECT reco, seq, unnest(CASE WHEN seq % 5 = 0 THEN [label, (label + 1) % 3] ELSE [label] END) AS label, b, e FROM flat)"


@R.add(cte("xvec") + f", {_FLAT}, {_MULTI} " + _RUNS.format(k="reco, label", t="multi"))
def b16_multilabel_merge(spark, d):
    t = _flat(spark, d)
    labels = F.when(F.col("seq") % 5 == 0, F.array("label", (F.col("label") + 1) % 3)).otherwise(F.array("label"))
    m = t.withColumn("label", F.explode(labels)).withColumn("k", F.concat_ws("|", "reco", "label"))
    return I.merge_labels(m.withColumn("kl", F.struct("reco", "label")), "kl", "label", "b", "e").select("kl.reco", "label", "b", "e")


@R.add(f"""{FULL}, f AS (SELECT file_id, (onset_ms + 9) // 10 AS b, (offset_ms + 9) // 10 AS e FROM merged_ref),
 g AS (SELECT *, CASE WHEN b - 50 <= max(e) OVER (PARTITION BY file_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f WHERE b < e),
 h AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY b, e) AS grp FROM g), m AS (SELECT file_id, min(b) AS b, max(e) AS e FROM h GROUP BY file_id, grp)
 SELECT m.file_id, b AS first_frame, CASE WHEN b = max(b) OVER (PARTITION BY m.file_id) AND e + 50 >= (offset_ms + 9) // 10 THEN (offset_ms + 9) // 10 ELSE e END AS end_frame FROM m JOIN uem USING (file_id)""")
def b17_speech_activity(spark, d):
    return I.speech_activity(ref(spark, d), uem(spark, d), "file_id")


SLICES = "slices AS (SELECT file_id, CAST(i AS BIGINT) AS seg, i * 600000 AS onset_ms, (i + 1) * 600000 AS offset_ms FROM uem, range(0, 144) t(i) WHERE i * 600000 < uem.offset_ms)"


def slices(spark, d):
    u = uem(spark, d).select("file_id", F.col("offset_ms").alias("z"))
    t = u.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(143).cast("long")))).filter(F.col("seg") * 600000 < F.col("z"))
    return t.select("file_id", "seg", (F.col("seg") * 600000).alias("onset_ms"), ((F.col("seg") + 1) * 600000).alias("offset_ms"))


_OVER = "o AS (SELECT s.file_id, seg, speaker_id, least(s.offset_ms, m.offset_ms) - greatest(s.onset_ms, m.onset_ms) AS dur, s.offset_ms - s.onset_ms AS len FROM slices s JOIN merged_ref m ON s.file_id = m.file_id AND s.onset_ms < m.offset_ms AND m.onset_ms < s.offset_ms)"


@R.add(f"{FULL}, {SLICES}, {_OVER} SELECT DISTINCT file_id, seg, speaker_id FROM o WHERE dur >= least(len, 20000)")
def b18_overlap_labels(spark, d):
    return I.overlap_labels(slices(spark, d), ref(spark, d), ["file_id"], ["seg"], 20000)


@R.add(f"{FULL}, {SLICES}, {_OVER}, n AS (SELECT file_id, seg, speaker_id, sum(dur) AS o FROM o GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY file_id, seg ORDER BY o DESC, speaker_id) AS rn FROM n) SELECT s.file_id, s.seg, coalesce(speaker_id, '0') AS label, CAST(coalesce(o, 0) AS BIGINT) AS overlap_ms FROM slices s LEFT JOIN b ON b.file_id = s.file_id AND b.seg = s.seg AND rn = 1")
def b19_best_overlap(spark, d):
    return I.best_overlap(slices(spark, d), ref(spark, d), ["file_id"], ["seg"])


@R.add(f"{FULL}, {SLICES}, x AS (SELECT t.file_id, turn_id, seg, t.onset_ms >= s.onset_ms AND t.offset_ms <= s.offset_ms AS inside, least(s.offset_ms, t.offset_ms) - greatest(s.onset_ms, t.onset_ms) AS dur FROM turns_ref t JOIN slices s ON t.file_id = s.file_id AND t.onset_ms < s.offset_ms AND s.onset_ms < t.offset_ms), y AS (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY inside DESC, dur DESC, seg) AS rn FROM x) SELECT file_id, turn_id, seg FROM y WHERE rn = 1")
def b20_fine_to_coarse(spark, d):
    s = slices(spark, d)
    x = I.overlap_join(view(spark, d, "turns_ref").select("file_id", "turn_id", "onset_ms", "offset_ms"), s, ["file_id"])
    inside = (F.col("onset_ms") >= F.col("b_begin")) & (F.col("offset_ms") <= F.col("b_end"))
    dur = F.least("offset_ms", "b_end") - F.greatest("onset_ms", "b_begin")
    return x.groupBy("file_id", "turn_id").agg(F.min(F.struct((~inside).alias("i"), (-dur).alias("d"), "seg")).alias("m")).select("file_id", "turn_id", "m.seg")


def _windows(longest: int, step: int, rest: int) -> str:
    return f"n AS (SELECT file_id, speaker_id, onset_ms, offset_ms, greatest(0, CAST(ceil((offset_ms - onset_ms - {longest} - {rest}) / {step}.0) AS BIGINT)) AS n FROM merged_ref), w AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n)"


@R.add(f"{BOTH}, {MERGED_REF}, {_windows(30000, 25000, 10000)} SELECT file_id, speaker_id, onset_ms + i * 25000 AS sub_begin, CASE WHEN i < n THEN onset_ms + i * 25000 + 30000 ELSE offset_ms END AS sub_end FROM w")
def b21_uniform_subsegments(spark, d):
    return I.uniform_subsegments(ref(spark, d), SPK).select(*SPK, "sub_begin", "sub_end")


@R.add(f"{BOTH}, {MERGED_REF}, {_windows(1500, 750, 0)}, v AS (SELECT file_id, speaker_id, greatest(onset_ms, least(onset_ms + i * 750, offset_ms - 1500)) AS b, offset_ms FROM w) SELECT file_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS begins, CAST(sum(least(b + 1500, offset_ms)) AS BIGINT) AS ends FROM v GROUP BY 1")
def b22_sliding_windows(spark, d):
    t = I.sliding(ref(spark, d), SPK)
    return t.groupBy("file_id").agg(F.count("*").alias("n"), F.sum("sub_begin").alias("begins"), F.sum("sub_end").alias("ends"))


@R.add(cte("segments") + " SELECT utt, start_ms + 300 AS start_ms, CAST(floor((start_ms + 300) / 10.0 + 0.5) AS BIGINT) AS first_frame FROM segments")
def b23_compose_offsets(spark, d):
    s = view(spark, d, "segments")
    sub = s.select("utt", F.lit(300).cast("long").alias("start_ms"))
    t = I.shift_to_recording(sub, s.withColumnRenamed("start_ms", "s0"), "utt", "s0")
    return t.select("utt", "start_ms", F.floor(F.col("start_ms") / 10.0 + 0.5).cast("long").alias("first_frame"))


@R.add(cte("segments") + ", p AS (SELECT utt, reco, seq, greatest(0, start_ms - 100) AS b, end_ms + 100 AS e FROM segments), n AS (SELECT *, lag(e) OVER w AS pe, lead(b) OVER w AS nb FROM p WINDOW w AS (PARTITION BY reco ORDER BY seq)) SELECT utt, CASE WHEN pe > b THEN (pe + b) / 2.0 ELSE b END::DOUBLE AS pad_begin, CASE WHEN nb < e THEN (nb + e) / 2.0 ELSE e END::DOUBLE AS pad_end FROM n")
def b24_pad_resolve(spark, d):
    return I.pad_and_resolve(view(spark, d, "segments"), "reco", "seq", 100, "start_ms", "end_ms").select("utt", "pad_begin", "pad_end")


@R.add(f"{BOTH}, {UEM} SELECT concat(file_id, '-all') AS utt, file_id, onset_ms, offset_ms FROM uem")
def b25_whole_utterance(spark, d):
    return uem(spark, d).select(F.concat("file_id", F.lit("-all")).alias("utt"), "file_id", "onset_ms", "offset_ms")


@R.add(cte("segments") + " SELECT utt, reco, w * 500 + start_ms AS start_ms FROM segments, (SELECT unnest([0, 1, 2]) AS w) x")
def b27_ctm_to_recording(spark, d):
    s = view(spark, d, "segments")
    words = s.select("utt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("w")).select("utt", (F.col("w") * 500).cast("long").alias("start_ms"))
    return I.shift_to_recording(words, s.withColumnRenamed("start_ms", "s0"), "utt", "s0").select("utt", "reco", "start_ms")


@R.add(f"{FULL}, {SLICES} SELECT file_id, seg, 'inter_segment_gap' AS label FROM slices s WHERE NOT EXISTS (SELECT 1 FROM merged_ref m WHERE m.file_id = s.file_id AND s.onset_ms < m.offset_ms AND m.onset_ms < s.offset_ms)")
def b29_placeholder_rows(spark, d):
    s = slices(spark, d)
    hit = I.overlap_join(s, ref(spark, d).select("file_id", "onset_ms", "offset_ms"), ["file_id"]).select("file_id", "seg").distinct()
    return s.join(hit, ["file_id", "seg"], "left_anti").select("file_id", "seg", F.lit("inter_segment_gap").alias("label"))


@R.add("SELECT vec_id, round(list_sum(list_transform(range(0, 150), lambda i: CAST(embedding[(i % len(embedding)) + 1] AS DOUBLE))), 5) AS s FROM embeddings")
def b30_wrapped_window(spark, d):
    from voxlake.session import table

    i = F.sequence(F.lit(0), F.lit(149))
    at = lambda k: F.element_at("embedding", (k % F.size("embedding") + 1).cast("int")).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(F.transform(i, at), F.lit(0.0), lambda a, x: a + x), 5).alias("s"))


@R.add(cte("segments") + " SELECT utt, round((12 * 10 + start_ms) / 1000.0, 3) AS tbeg FROM segments")
def b31_hit_time(spark, d):
    return view(spark, d, "segments").select("utt", F.round((F.col("start_ms") + 120) / 1000.0, 3).alias("tbeg"))


@R.add(f"{FULL}, {REGIONS} SELECT DISTINCT turn_id, t.file_id FROM turns_ref t JOIN regions r ON t.file_id = r.file_id AND r.onset_ms <= t.onset_ms AND t.onset_ms < r.offset_ms")
def d35_point_in_region(spark, d):
    return I.contained_in(view(spark, d, "turns_ref").select("turn_id", "file_id", F.col("onset_ms").alias("at")), regions(spark, d), ["file_id"], "at").select("turn_id", "file_id")
