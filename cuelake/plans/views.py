"""Cue tables made from the driver's tables: `cues`, one file for each user of events, meets every branch of the timeline
operators; `dec` decorates conversations for the text operators. The SQL runs in Spark and DuckDB alike but for ts_ms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CUES = """
WITH e AS (SELECT CAST(user_id AS {text}) AS file_id, event_id, {ts_ms} - 1704067200000 AS ts_ms, event_type, value FROM {events}),
c0 AS (SELECT file_id, event_id, event_id * 2 AS ord, event_type, value,
              ts_ms + 259200000 - CASE WHEN event_id % 97 = 0 THEN 200000000 ELSE 0 END AS from_ms FROM e),
c1 AS (SELECT file_id, event_id, ord, from_ms,
              from_ms + CASE WHEN event_type = 'error' THEN 100 WHEN event_id % 83 = 0 THEN -5000
                             ELSE CAST(round(value * 100) AS BIGINT) * 6000 END AS to_ms,
              CASE WHEN event_id % 71 = 0 THEN '' ELSE event_type END AS text FROM c0),
c2 AS (SELECT file_id, ord, from_ms, to_ms, text FROM c1
       UNION ALL SELECT file_id, ord + 1, from_ms, to_ms, text FROM c1 WHERE event_id % 50 = 0)
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY ord) AS BIGINT) AS pos,
       CAST(row_number() OVER (PARTITION BY file_id ORDER BY ord) AS BIGINT) AS idx, from_ms, to_ms, text FROM c2
"""
_DEC = """
SELECT CAST(conv_id AS {text}) AS file_id, turn AS pos, turn + 1 AS idx,
       CASE (conv_id + turn) % 9
         WHEN 0 THEN concat('[APPLAUSE]', chr(10), text)
         WHEN 1 THEN concat('NORA: ', text, ' [glass breaks]')
         WHEN 2 THEN concat('- [Mr. Finch] ', text)
         WHEN 3 THEN concat('(coughs) ', text, ' {{bell rings}}')
         WHEN 4 THEN concat('Get down,', chr(10), '[static', chr(10), 'crackling]', chr(10), text)
         WHEN 5 THEN concat('<i>', text, '</i>')
         WHEN 6 THEN concat('♪ ♪', chr(10), text)
         WHEN 7 THEN concat('  ', text, ' ', chr(10), ' ', chr(10), '____')
         ELSE text END AS text
FROM {conversations}
"""
CUES_SQL = _CUES.format(text="VARCHAR", ts_ms="epoch_us(ts) // 1000", events="events")
DEC_SQL = _DEC.format(text="VARCHAR", conversations="conversations")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_CUES.format(text="STRING", ts_ms="unix_millis(CAST(ts AS TIMESTAMP))", events="{events}"), events=events)


def dec(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # sql() formats its query, so braces in the text are doubled
    return spark.sql(_DEC.format(text="STRING", conversations="{conversations}").replace("{bell rings}", "{{bell rings}}"), conversations=conversations)
