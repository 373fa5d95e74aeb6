"""Cue, line, slot, interval and attempt tables derived from the given tables, in Spark and as SQL.

All times are integer milliseconds; the session time zone is UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table of numbers that one task windows; few bytes in a shuffle, several sorts' memory in a task.
TASK_ROWS = 250_000


def tasks_for(rows: DataFrame) -> int:
    """Into how many partitions ``rows``, a given table, is dealt, so that a task's share doesn't grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def running_start(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``start_ms`` and ``end_ms`` from ``duration_ms`` and ``gap_ms``, laid end to end within the key."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("duration_ms") + F.col("gap_ms")).over(before), F.lit(0)).cast("long")
    return df.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.col("role").alias("speaker"), F.posexplode(parts).alias("pos", "t"))
    s = s.withColumn("text", F.trim("t")).where("text <> ''")
    s = s.withColumn("cue_no", F.row_number().over(Window.partitionBy("media_id").orderBy("turn", "pos")).cast("long"))
    s = s.withColumn("duration_ms", F.greatest(F.lit(400), F.length("text") * 60).cast("long"))
    s = s.withColumn("gap_ms", ((F.col("media_id") * 7 + F.col("cue_no") * 13) % 5) * 300 - 300)
    return running_start(s, "media_id", ["cue_no"]).select("media_id", "cue_no", "speaker", "text", "duration_ms", "start_ms", "end_ms")


CUES = r"""
s AS (SELECT conv_id AS media_id, turn, role AS speaker,
        unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS t,
        generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), 1) AS pos FROM conversations),
s2 AS (SELECT media_id, speaker, trim(t) AS text, row_number() OVER (PARTITION BY media_id ORDER BY turn, pos) AS cue_no FROM s WHERE trim(t) <> ''),
s3 AS (SELECT *, greatest(400, 60 * length(text))::BIGINT AS duration_ms, ((media_id * 7 + cue_no * 13) % 5) * 300 - 300 AS gap_ms FROM s2),
s4 AS (SELECT *, coalesce(sum(duration_ms + gap_ms) OVER (PARTITION BY media_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM s3),
cues AS (SELECT media_id, cue_no, speaker, text, duration_ms, start_ms, start_ms + duration_ms AS end_ms FROM s4)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    return d.select("media_id", "lang", F.col("line_no").cast("long"), F.trim("t").alias("text")).where("text <> ''")


LINES = """
l AS (SELECT doc_id AS media_id, lang, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (SELECT media_id, lang, line_no::BIGINT AS line_no, trim(t) AS text FROM l WHERE trim(t) <> '')"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    s = items.select(
        F.col("l_orderkey").alias("media_id"), *order, (F.col("l_quantity") * 100).cast("long").alias("duration_ms"),
        (F.col("l_quantity") * 100 + F.col("l_quantity") * F.round(F.col("l_tax") * 100) * 5).cast("long").alias("audio_ms"),
        (F.round(F.col("l_discount") * 100) * 40).cast("long").alias("gap_ms"), F.col("l_returnflag").alias("label"),
    )
    s = s.repartition(tasks_for(items), "media_id")
    # one sort gives both the number and the start
    s = s.withColumn("cue_no", F.row_number().over(Window.partitionBy("media_id").orderBy(*order)).cast("long"))
    return running_start(s, "media_id", order).select("media_id", "cue_no", "duration_ms", "audio_ms", "label", "start_ms", "end_ms")


SLOTS = """
t AS (SELECT l_orderkey AS media_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS cue_no,
        (l_quantity * 100)::BIGINT AS duration_ms, (l_quantity * 100 + l_quantity * round(l_tax * 100) * 5)::BIGINT AS audio_ms,
        (round(l_discount * 100) * 40)::BIGINT AS gap_ms, l_returnflag AS label FROM lineitem),
t2 AS (SELECT *, coalesce(sum(duration_ms + gap_ms) OVER (PARTITION BY media_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM t),
slots AS (SELECT media_id, cue_no, duration_ms, audio_ms, label, start_ms, start_ms + duration_ms AS end_ms FROM t2)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("media_id"), "event_id", start.alias("start_ms"), (start + F.floor(F.col("value") * 60000)).alias("end_ms"), F.col("event_type").alias("label"), "value"
    )


INTERVALS = """
intervals AS (SELECT user_id AS media_id, event_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + floor(value * 60000)::BIGINT AS end_ms, event_type AS label, value FROM events)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.expr("event_type = 'error'").alias("failed"),
        F.expr("case event_type when 'error' then 500 when 'signup' then 429 else 200 end").alias("status"), F.col("event_type").alias("message"), F.col("value").alias("score"),
    )


ATTEMPTS = """
attempts AS (SELECT user_id AS job, event_id, epoch_us(ts) // 1000 AS ts_ms, event_type = 'error' AS failed,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 429 ELSE 200 END AS status, event_type AS message, value AS score FROM events)"""
