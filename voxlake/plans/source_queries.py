"""Sources and sinks over lines made from the turn views, and kernels that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxlake.fixtures import cte, view
from voxlake.operators import kernels as N
from voxlake.plans.registry import Registry
from voxlake.session import table
from voxlake.sources import formats as S

R = Registry()
TURNS = cte("turns_ref", "turns_sys")
_LINE = "printf('SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', file_id, onset_ms / 1000.0::DOUBLE, (offset_ms - onset_ms) / 1000.0::DOUBLE, speaker_id)"


def lines(spark, d):
    return S.turn_lines(view(spark, d, "turns_ref")).withColumnRenamed("value", "line")


@R.add(TURNS + " SELECT 'SPEAKER' AS type, file_id, '1' AS channel, onset_ms, offset_ms, speaker_id FROM turns_ref WHERE offset_ms > onset_ms")
def s01_turn_scan(spark, d):
    return S.parse_turns(lines(spark, d))


@R.add(TURNS + f" SELECT {_LINE} AS value FROM turns_ref")
def s02_turn_sink(spark, d):
    return S.turn_lines(view(spark, d, "turns_ref"))


@R.add("SELECT line, CASE WHEN len(regexp_split_to_array(trim(line), '\\s+')) < 9 THEN 'too few fields' ELSE 'no number' END AS fault FROM (SELECT concat('SPEAKER f 1 ', CAST(event_id AS STRING), ' ', event_type, ' <NA> <NA> a', CASE WHEN event_id % 2 = 0 THEN ' <NA>' ELSE '' END) AS line FROM events) t")
def s03_turn_validator(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("SPEAKER f 1 "), F.col("event_id").cast("string"), F.lit(" "), "event_type", F.lit(" <NA> <NA> a"), F.when(F.col("event_id") % 2 == 0, " <NA>").otherwise(""))
    return S.turn_faults(e.select(line.alias("line")))


_REG = "SELECT file_id, min(onset_ms) AS onset_ms, max(offset_ms) AS offset_ms FROM turns_ref GROUP BY 1"


@R.add(TURNS + " " + _REG)
def s05_region_scan(spark, d):
    r = view(spark, d, "turns_ref").groupBy("file_id").agg(F.min("onset_ms").alias("onset_ms"), F.max("offset_ms").alias("offset_ms"))
    t = r.withColumn("file_id", F.concat(F.lit("audio/"), "file_id", F.lit(".wav")))
    return S.parse_regions(S.region_lines(t).withColumnRenamed("value", "line"))


@R.add(TURNS + f", r AS ({_REG}) SELECT printf('%s 1 %.3f %.3f', file_id, onset_ms / 1000.0::DOUBLE, offset_ms / 1000.0::DOUBLE) AS value FROM r")
def s06_region_sink(spark, d):
    return S.region_lines(view(spark, d, "turns_ref").groupBy("file_id").agg(F.min("onset_ms").alias("onset_ms"), F.max("offset_ms").alias("offset_ms")))


@R.add(TURNS + ", w AS (SELECT file_id, onset_ms, offset_ms, max(offset_ms) OVER (PARTITION BY file_id ORDER BY onset_ms, offset_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM turns_ref) SELECT file_id, onset_ms, offset_ms FROM w WHERE onset_ms < reach")
def s08_overlapping_regions(spark, d):
    return S.overlapping_regions(view(spark, d, "turns_ref").select("file_id", "onset_ms", "offset_ms"))


@R.add("SELECT p_brand AS token, p_type AS image FROM part")
def s09_word_map(spark, d):
    return S.parse_word_map(table(spark, d, "part").select(F.concat("p_brand", F.lit(" => "), "p_type", F.lit(" ;; note")).alias("line")))


@R.add(cte("segments") + " SELECT utt, reco, start_ms, end_ms FROM segments")
def s10_segment_scan(spark, d):
    s = view(spark, d, "segments").select(F.format_string("%s %s %.3f %.3f", "utt", "reco", F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0).alias("line"))
    return S.parse_segments(s)


@R.add("SELECT o_orderkey, concat('f', CAST(o_custkey AS STRING)) AS file, CAST(least(1000, 10 + o_orderkey % 7) AS BIGINT) AS row_lo, CAST(least(1000, 10 + o_orderkey % 2000) AS BIGINT) AS row_hi FROM orders")
def s22_range_suffix(spark, d):
    o = table(spark, d, "orders")
    outer = S.parse_range(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit("[10:1000]")))
    inner = S.parse_range(F.concat(F.lit("x["), (F.col("o_orderkey") % 7).cast("string"), F.lit(":"), (F.col("o_orderkey") % 2000).cast("string"), F.lit("]")))
    return o.select("o_orderkey", S.compose_range(outer, inner).alias("r")).select("o_orderkey", "r.file", "r.row_lo", "r.row_hi")


@R.add("SELECT event_type, count(*) AS n, min(event_id)::DOUBLE AS best, round(avg(event_id), 6) AS mean FROM events GROUP BY 1")
def s24_metric_scan(spark, d):
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("epoch loss="), F.col("event_id").cast("string"), F.lit(" done")).alias("line"))
    return S.scan_metrics(e, r"loss=([0-9.]+)", "event_type")


@R.add("SELECT event_type, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS warnings, CAST(sum(CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(sum(event_id % 10)::DOUBLE, 3) AS seconds FROM events GROUP BY 1")
def s25_log_rollup(spark, d):
    word = F.element_at(F.array(F.lit("WARNING"), F.lit("ERROR"), F.lit("LOG")), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, d, "events").select("event_type", F.concat(word, F.lit(" time="), (F.col("event_id") % 10).cast("string")).alias("line"))
    return S.log_rollup(e, "event_type")


# --- kernels ------------------------------------------------------------------------------------------------------


_SEC = "WITH RECURSIVE r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), k(user_id, rn, total, part) AS (SELECT user_id, rn, value, 0::BIGINT FROM r WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, CASE WHEN k.total + r.value > 300 AND k.total <> 0 THEN r.value ELSE k.total + r.value END, CASE WHEN k.total + r.value > 300 AND k.total <> 0 THEN part + 1 ELSE part END FROM k JOIN r ON r.user_id = k.user_id AND r.rn = k.rn + 1)"


@R.add(_SEC + " SELECT user_id, event_id, part FROM k JOIN r USING (user_id, rn)")
def a57_pseudo_by_seconds(spark, d):
    return N.pseudo_by_seconds(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 300.0)


@R.add()
def a54_balanced_split(spark, d):
    return N.balanced_split(table(spark, d, "orders"), "o_custkey", 8)


@R.add()
def a58_combine_short(spark, d):
    return N.combine_short(table(spark, d, "events").select("user_id", "event_id", "value").filter("value > 0"), "user_id", "event_id", "value", 60.0)


@R.add("WITH RECURSIVE t(lo, hi, need) AS (SELECT 0::BIGINT, (SELECT count(*) FROM orders), 100::BIGINT UNION ALL SELECT unnest([lo, lo + (hi - lo) // 2]), unnest([lo + (hi - lo) // 2, hi]), unnest([need // 2, need - need // 2]) FROM t WHERE need > 1), p AS (SELECT DISTINCT lo FROM t WHERE need = 1), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) SELECT o_orderkey FROM o JOIN p ON lo = r")
def a46_even_subset(spark, d):
    return N.even_subset(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@R.add()
def b26_segmentation(spark, d):
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return N.segment_frames(table(spark, d, "events").select("user_id", "event_id", kind.alias("kind")), "user_id", "event_id", "kind", longest=15, hard=30)


@R.add("SELECT CAST(i AS BIGINT) AS epoch, round(0.0001 + 0.5 * (0.01 - 0.0001) * (1 + cos(pi() * i / 100)), 8) AS lr FROM range(0, 100) t(i)")
def f03_cosine_schedule(spark, d):
    return spark.range(100).select(F.col("id").alias("epoch"), F.round(0.0001 + 0.5 * (0.01 - 0.0001) * (1 + F.cos(F.pi() * F.col("id") / 100)), 8).alias("lr"))


@R.add()
def flagship_diarization(spark, d):
    from voxlake.plans.diarization import diarize

    return diarize(spark, d)
