"""Packets derived from an events table, by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.operators import segment
from netloom.schema import packets_of

# The view that turns events into packets; time is compressed ten thousand times.
VIEW = """
WITH e AS (
  SELECT event_id, user_id, event_type, value, {US} AS us, CAST({K} AS BIGINT) AS k FROM {EVENTS}
), p AS (
  SELECT event_id AS packet_id, user_id, k, CAST(floor(us / 10000) AS BIGINT) AS timestamp_us,
    CASE WHEN user_id % 5 = 0 THEN 17 WHEN user_id % 5 = 1 THEN 1 ELSE 6 END AS protocol,
    concat(CASE user_id % 7 WHEN 0 THEN '10.0.' WHEN 1 THEN '192.168.' WHEN 2 THEN '100.64.' WHEN 3 THEN '8.8.' WHEN 4 THEN '169.254.' WHEN 5 THEN '172.16.' ELSE '127.0.' END,
      CAST(CAST(floor(user_id / 250) AS BIGINT) AS VARCHAR(20)), '.', CAST(user_id % 250 + 1 AS VARCHAR(20))) AS cip,
    CASE user_id % 6 WHEN 0 THEN '93.184.216.34' WHEN 1 THEN '10.1.0.53' WHEN 2 THEN '224.0.0.251' WHEN 3 THEN '127.0.0.1' WHEN 4 THEN '169.254.9.9' ELSE '1.1.1.1' END AS sip,
    CASE WHEN user_id % 5 = 1 THEN 0 ELSE 1024 + user_id * 37 % 60000 END AS cport,
    CASE WHEN user_id % 5 = 1 THEN 0 ELSE CASE user_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 ELSE 53 END END AS sport,
    CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS rev,
    CASE WHEN user_id % 5 IN (0, 1) THEN 0 WHEN event_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN 18 ELSE 2 END
      WHEN event_type = 'view' THEN 16 WHEN event_type = 'click' THEN 24 WHEN event_type = 'purchase' THEN 17 WHEN k % 4 = 0 THEN 4 ELSE 16 END AS flags,
    CASE WHEN event_type IN ('view', 'signup') THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS data_length
  FROM e
), q AS (
  SELECT *, CASE WHEN protocol = 6 THEN k * 50 ELSE 0 END AS sequence_number, CASE WHEN protocol = 6 THEN 20 ELSE 8 END AS header_length,
    CASE WHEN protocol <> 6 OR k < 5 THEN 0 ELSE 1000 * (k % 4) END AS window_size
  FROM p
)
SELECT packet_id, timestamp_us, CAST(protocol AS BIGINT) AS protocol,
  CASE WHEN rev = 1 THEN sip ELSE cip END AS source_ip, CASE WHEN rev = 1 THEN cip ELSE sip END AS destination_ip,
  CAST(CASE WHEN rev = 1 THEN sport ELSE cport END AS BIGINT) AS source_port, CAST(CASE WHEN rev = 1 THEN cport ELSE sport END AS BIGINT) AS destination_port,
  CAST(flags AS BIGINT) AS flags, data_length, CAST(header_length AS BIGINT) AS header_length, data_length + header_length + 20 AS length, window_size, sequence_number,
  CASE WHEN protocol <> 6 THEN 0 ELSE
    coalesce(lag(sequence_number + data_length + CASE WHEN flags IN (2, 17, 18) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY timestamp_us, packet_id), 0) END AS sequence_number_ack,
  CAST(CASE WHEN protocol = 1 THEN CASE k % 4 WHEN 0 THEN 8 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 11 END END AS BIGINT) AS icmp_type, CAST(CASE WHEN protocol = 1 THEN k % 2 END AS BIGINT) AS icmp_code,
  CAST(flags % 2 AS BIGINT) AS fin_flag, CAST(floor(flags / 2) AS BIGINT) % 2 AS syn_flag, CAST(floor(flags / 4) AS BIGINT) % 2 AS rst_flag,
  CAST(floor(flags / 8) AS BIGINT) % 2 AS psh_flag, CAST(floor(flags / 16) AS BIGINT) % 2 AS ack_flag,
  CAST(0 AS BIGINT) AS urg_flag, CAST(0 AS BIGINT) AS ece_flag, CAST(0 AS BIGINT) AS cwr_flag
FROM q
"""
DUCKDB = VIEW.format(US="epoch_us(ts)", K="json_extract_string(props, '$.k')", EVENTS="events")


def _tasks(spark: SparkSession, count: int) -> int:
    """Tasks for the window over `count` events, as many as segmentation takes. Over more tasks than a threshold (200), a shuffle holds
    what each reader of files writes in memory; so long as a task gets no more than four times the events, which are narrow, it is kept to."""
    most = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return min(segment.tasks(spark, count), max(most, segment.tasks(spark, -(-count // 4))))


def packets(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Packets of the events table. The view's window over a user's events sorts them in as many tasks as adaptive execution leaves
    of spark.sql.shuffle.partitions, which are few; with `dealt`, tables of more events than one task's are dealt to a number that grows with
    the table. Plans that don't read sequence_number_ack drop the window and need no dealing."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dealt and (count := events.count()) > segment.TASK_PACKETS:
        events = events.repartition(_tasks(spark, count), "user_id")
    sql = VIEW.format(US="unix_micros(CAST(ts AS TIMESTAMP))", K="get_json_object(props, '$.k')", EVENTS="{events}")
    return packets_of(spark.sql(sql, events=events))
