"""Session and window aggregates over events, as batch queries of the streaming operators."""

from __future__ import annotations

from voxlake.plans.registry import Registry
from voxlake.session import table
from voxlake.streaming import sessions as T

R = Registry()


@R.add("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, min(ts) AS "begin" FROM h GROUP BY user_id, s""".replace('round(sum(value), 2) AS total, min(ts) AS "begin"', "CAST(epoch_us(min(ts)) AS BIGINT) AS begin_us"))
def x01_sessions(spark, d):
    from pyspark.sql import functions as F

    t = T.sessions(table(spark, d, "events"), "user_id", "2 hours")
    return t.select("user_id", "n", F.unix_micros("begin").alias("begin_us"))


@R.add("WITH b AS (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS b FROM events) SELECT event_type, CAST(epoch_us(b) AS BIGINT) AS begin_us, count(*) AS n FROM b GROUP BY 1, 2")
def x02_sliding_counts(spark, d):
    from pyspark.sql import functions as F

    return T.sliding_counts(table(spark, d, "events")).select("event_type", F.unix_micros("begin").alias("begin_us"), "n")
