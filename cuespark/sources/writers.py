"""Sinks: rows to subtitle text, data sets, reports, manifests and cache snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.functions.text import srt_time


def srt_text(cues: DataFrame) -> DataFrame:
    """(media_id, content): the media's cues as subtitle text, blank ones left out, numbered from 1."""
    c = cues.where("trim(text) <> ''").withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "cue_no")))
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n")
    return c.groupBy("media_id").agg(joined.alias("content"))


def write_srt(cues: DataFrame, path: str) -> None:
    """One folder a media, each with the media's text as lines."""
    srt_text(cues).select("media_id", F.col("content").alias("value")).write.partitionBy("media_id").text(path)


def subtitle_text(blocks: DataFrame, on_missing: str = "original") -> DataFrame:
    """Blocks (media_id, header, block_no, timing, text, translated) to text; missing translations are the original or blank."""
    text = F.coalesce("translated", "text" if on_missing == "original" else F.lit(""))
    b = F.struct("block_no", F.concat_ws("\n", F.col("block_no").cast("string"), "timing", text, F.lit("")).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(b)), lambda x: x["b"]), "\n")
    return blocks.groupBy("media_id").agg(F.concat_ws("\n\n", F.nullif(F.max("header"), F.lit("")), joined).alias("content"))


def write_dataset(rows: DataFrame, path: str) -> None:
    """Accepted rows (reason null) as ``file|text`` lines, and the counts by reason as ``key=value`` lines."""
    rows.where("reason is null").select(F.concat_ws("|", "file", "text").alias("value")).write.text(f"{path}/metadata")
    report = rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("k")).count()
    report.select(F.concat_ws("=", "k", F.col("count").cast("string")).alias("value")).coalesce(1).write.text(f"{path}/report")


def report_json(df: DataFrame, by: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One JSON document per key: the count and the rows in order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("row")))), lambda x: x["row"])
    return df.groupBy(by).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total"), rows.alias("rows"))).alias("report"))


def upsert_cache(cache: DataFrame, new: DataFrame, key: str = "fingerprint", at: Sequence[str] = ("created_at",)) -> DataFrame:
    """The last written row of each key; write it to a new snapshot folder."""
    both = cache.unionByName(new)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("r")).select(key, "r.*")


def manifest(items: DataFrame, ok: str, order: Sequence[str], by: str) -> DataFrame:
    """Items numbered from 1 within their list, with whether each is usable."""
    return items.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).withColumn("ok", F.expr(ok))
