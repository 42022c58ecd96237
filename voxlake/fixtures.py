"""Domain views over the driver tables: one SQL text for the engine and for the oracle, parameterised by dialect only where it must be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlake.session import table

_TUS = {
    "spark": "timestampdiff(MICROSECOND, date_trunc('day', ts), ts)",
    "duckdb": "(epoch_us(ts) - epoch_us(date_trunc('day', ts)))",
}
_IDX = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


def _turns_ref(d: str) -> str:
    return f"""SELECT CAST(CAST(ts AS DATE) AS STRING) AS file_id, event_type AS speaker_id, event_id AS turn_id,
 CAST(floor({_TUS[d]} / 1000.0) AS BIGINT) AS onset_ms,
 CAST(floor({_TUS[d]} / 1000.0) AS BIGINT) + CAST(round(value * 1000) AS BIGINT) AS offset_ms FROM events WHERE value > 0"""


def _turns_sys(d: str) -> str:
    return f"""SELECT file_id, concat('spk', CAST(CASE WHEN turn_id % 13 = 0 THEN (k + 1) % 5 ELSE k END AS STRING)) AS speaker_id, turn_id,
 onset AS onset_ms, onset + dur AS offset_ms FROM (SELECT CAST(CAST(ts AS DATE) AS STRING) AS file_id, {_IDX} AS k, event_id AS turn_id,
 greatest(0, CAST(floor({_TUS[d]} / 1000.0) AS BIGINT) + ((event_id * 7) % 5 - 2) * 500) AS onset, CAST(round(value * 1000) AS BIGINT) AS dur
 FROM events WHERE value > 0 AND event_id % 11 <> 0) t"""


VIEWS = {
    "turns_ref": (("events",), _turns_ref),
    "turns_sys": (("events",), _turns_sys),
    "xvec": (("embeddings",), lambda d: "SELECT concat('rec', CAST(vec_id % 10 AS STRING)) AS reco, CAST(floor(vec_id / 10) AS BIGINT) AS seq, vec_id AS node, label, embedding FROM embeddings"),
    "segments": (("embeddings",), lambda d: "SELECT concat('rec', CAST(vec_id % 10 AS STRING), '-', lpad(CAST(CAST(floor(vec_id / 10) AS BIGINT) AS STRING), 6, '0')) AS utt, concat('rec', CAST(vec_id % 10 AS STRING)) AS reco, CAST(floor(vec_id / 10) AS BIGINT) AS seq, CAST(floor(vec_id / 10) AS BIGINT) * 750 AS start_ms, CAST(floor(vec_id / 10) AS BIGINT) * 750 + 1500 AS end_ms FROM embeddings"),
    "utt2spk": (("orders",), lambda d: "SELECT o_orderkey AS utt, o_custkey AS spk FROM orders"),
    "utt2dur": (("orders",), lambda d: "SELECT o_orderkey AS utt, o_custkey AS spk, CAST(round(o_totalprice) AS BIGINT) AS dur FROM orders"),
    "label_pairs": (("lineitem",), lambda d: "SELECT CAST(l_shipdate AS DATE) AS d, l_returnflag AS ref_label, CAST(l_linenumber AS STRING) AS sys_label FROM lineitem"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text("spark"))


def cte(*names: str) -> str:
    """WITH clause that gives the oracle the named views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]('duckdb')})" for n in names)


#: Common table expressions that the oracle needs again and again, by name; each may refer to views and to earlier ones.
MERGED_REF = """merged_ref AS (SELECT file_id, speaker_id, min(onset_ms) AS onset_ms, max(offset_ms) AS offset_ms FROM (
 SELECT *, sum(new) OVER (PARTITION BY file_id, speaker_id ORDER BY onset_ms, offset_ms, turn_id) AS grp FROM (
 SELECT *, CASE WHEN onset_ms < max(offset_ms) OVER (PARTITION BY file_id, speaker_id ORDER BY onset_ms, offset_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
 FROM turns_ref) a) b GROUP BY file_id, speaker_id, grp)"""
MERGED_SYS = MERGED_REF.replace("merged_ref", "merged_sys").replace("turns_ref", "turns_sys")
UEM = """uem AS (SELECT file_id, min(onset_ms) AS onset_ms, max(offset_ms) AS offset_ms FROM (SELECT file_id, onset_ms, offset_ms FROM turns_ref UNION ALL SELECT file_id, onset_ms, offset_ms FROM turns_sys) t GROUP BY file_id)"""
