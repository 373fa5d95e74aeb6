"""Readers: files to rows. Each has a form over a frame of (media_id, content) and a form over a path.

Files are read whole, one row a file, by Spark's own readers, so paths of any store work; what
follows are splits and explodes inside that row. Bad blocks are left out, never fatal.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespark.functions import text as tx
from cuespark.operators.joins import shared_folder
from cuespark.operators.sequence import clamp_overlaps

TIMING = r"(\d+:\d{1,2}:\d{1,2}[,.]\d{1,3})\s*-->\s*(\d+:\d{1,2}:\d{1,2}[,.]\d{1,3})"
ASR = "struct<segments:array<struct<text:string,start:double,end:double,words:array<struct<text:string,word:string,start:double,end:double,probability:double>>>>,chunks:array<struct<text:string,timestamp:array<double>>>,language:string,duration:double>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, content): the file name without its ending, and the text without a byte-order mark and carriage returns."""
    f = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("media_id"), "value")
    return f.select("media_id", plain(F.col("value")).alias("content"))


def plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^\\x{FEFF}", ""), "\r\n?", "\n")


def parse_srt(files: DataFrame) -> DataFrame:
    """Cues at every timing line; the body runs to the next one, without the next cue's number; overlaps are clamped."""
    pieces = F.split(F.regexp_replace("content", TIMING, "\u0001$1\u0002$2\u0003"), "\u0001")
    p = files.select("media_id", F.posexplode(pieces).alias("cue_no", "piece")).where("cue_no > 0")
    start, rest = F.substring_index("piece", "\u0002", 1), F.substring_index("piece", "\u0002", -1)
    body = F.regexp_replace(F.substring_index(rest, "\u0003", -1), r"(\n\s*\d+\s*)*\s*$", "")
    out = p.select(
        "media_id", F.col("cue_no").cast("long"), tx.srt_ms(start).alias("start_ms"), tx.srt_ms(F.substring_index(rest, "\u0003", 1)).alias("end_ms"), tx.collapse(body).alias("text")
    ).where("end_ms > start_ms and text <> ''")
    return clamp_overlaps(out)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(whole_files(spark, path))


def parse_blocks(files: DataFrame, index: str = "optional", keep_newlines: bool = False) -> DataFrame:
    """Blank-line blocks: a number (required, optional, or taken from any digits), the timing, then the text."""
    b = files.select("media_id", F.posexplode(F.split(F.trim("content"), r"\n[ \t]*\n\s*")).alias("block_no", "block"))
    number = F.regexp_extract("block", r"^\s*(\d+)\s*\n", 1) if index != "digits" else F.regexp_replace(F.substring_index("block", "\n", 1), r"\D", "")
    timing = F.regexp_extract("block", TIMING, 0)
    text = F.trim(F.regexp_extract("block", TIMING + r"[^\n]*\n?((?s:.*))$", 3))
    out = b.select(
        "media_id", F.col("block_no").cast("long"), number.alias("number"), timing.alias("timing"),
        tx.srt_ms(F.regexp_extract("block", TIMING, 1)).alias("start_ms"), tx.srt_ms(F.regexp_extract("block", TIMING, 2)).alias("end_ms"),
        (text if keep_newlines else tx.collapse(text)).alias("text"),
    ).where("timing <> '' and text <> ''")
    return out.where("number <> ''") if index in ("required", "digits") else out


def read_srt_blocks(spark: SparkSession, path: str, index: str = "optional", keep_newlines: bool = False) -> DataFrame:
    return parse_blocks(whole_files(spark, path), index, keep_newlines)


def parse_subtitle_blocks(files: DataFrame) -> DataFrame:
    """(media_id, header, block_no, timing, text): all before the first timing is the header; without one the file is header."""
    lines = files.select("media_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("number", F.col("line").rlike(r"^\s*\d+\s*$") & F.lead("line").over(Window.partitionBy("media_id").orderBy("line_no")).contains("-->"))
    w = Window.partitionBy("media_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.where(~F.coalesce("number", F.lit(False))).withColumn("block_no", F.count(F.when(F.col("line").contains("-->"), 1)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("line").contains("-->"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    g = lines.groupBy("media_id", "block_no").agg(F.max(F.when(F.col("line").contains("-->"), F.trim("line"))).alias("timing"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))
    header = g.where("block_no = 0").select("media_id", F.col("text").alias("header"))
    return g.where("block_no > 0").join(header, "media_id", "left").select("media_id", F.coalesce("header", F.lit("")).alias("header"), "block_no", "timing", "text")


def parse_asr_json(files: DataFrame) -> DataFrame:
    """(media_id, segment_no, word_no, text, start_ms, end_ms) of a recogniser's result.

    Words without times take the segment's; without any words, the tokens of each chunk share its time.
    """
    j = files.select("media_id", F.from_json("content", ASR).alias("j"))
    s = j.select("media_id", F.posexplode("j.segments").alias("segment_no", "s"))
    ms = lambda x: F.round(x * 1000).cast("long")
    w = s.select("media_id", "segment_no", F.col("s.start").alias("ss"), F.col("s.end").alias("se"), F.posexplode("s.words").alias("word_no", "w"))
    start, end = F.coalesce("w.start", "ss"), F.coalesce("w.end", "se")
    words = w.select("media_id", "segment_no", "word_no", F.trim(F.coalesce("w.word", "w.text")).alias("text"), ms(start).alias("start_ms"), ms(F.when(end <= start, start + 0.05).otherwise(end)).alias("end_ms")).where("text <> ''")
    bare = j.join(words.select("media_id").distinct(), "media_id", "left_anti").select("media_id", F.posexplode("j.chunks").alias("segment_no", "c"))
    t = bare.select("media_id", "segment_no", ms(F.col("c.timestamp")[0]).alias("a"), ms(F.col("c.timestamp")[1]).alias("b"), F.split(F.trim("c.text"), r"\s+").alias("t"))
    step = (F.col("b") - F.col("a")) / F.size("t")
    spread = t.select("media_id", "segment_no", "a", step.alias("step"), F.posexplode("t").alias("word_no", "text"))
    at = lambda k: F.floor(F.col("a") + F.col("step") * k).cast("long")
    return words.unionByName(spread.select("media_id", "segment_no", "word_no", "text", at(F.col("word_no")).alias("start_ms"), at(F.col("word_no") + 1).alias("end_ms")))


def parse_draft_json(files: DataFrame, language: str | None = None) -> DataFrame:
    """Cues of an editor's draft: text material by id, microseconds to milliseconds, numbered by start."""
    schema = "struct<materials:struct<texts:array<struct<id:string,language:string,recognize_text:string>>>,tracks:array<struct<type:string,segments:array<struct<material_id:string,target_timerange:struct<start:long,duration:long>>>>>>"
    j = files.select("media_id", F.from_json("content", schema).alias("j"))
    texts = j.select("media_id", F.inline("j.materials.texts")).select("media_id", F.col("id").alias("material_id"), "language", F.col("recognize_text").alias("text"))
    tracks = j.select("media_id", F.posexplode("j.tracks").alias("track", "t")).where("t.type = 'text'")
    seg = tracks.select("media_id", "track", F.posexplode("t.segments").alias("pos", "s")).select("media_id", "track", "pos", "s.material_id", (F.col("s.target_timerange.start") / 1000).cast("long").alias("start_ms"), (F.col("s.target_timerange.duration") / 1000).cast("long").alias("duration_ms"))
    cues = seg.join(texts, ["media_id", "material_id"])
    spoken = cues.where("pos < 20 and language <> ''").groupBy("media_id", "track").agg(F.min_by("language", "pos").alias("spoken"))
    chosen = tracks.select("media_id", "track").join(spoken, ["media_id", "track"], "left")
    order = [F.when(F.col("spoken") == F.lit(language), 0).otherwise(1), "track"] if language else [F.desc("track")]
    chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("media_id").orderBy(*order))).where("r = 1").select("media_id", "track")
    out = cues.join(chosen, ["media_id", "track"]).where("duration_ms > 0 and trim(text) <> ''")
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "pos")).cast("long")
    return out.select("media_id", number.alias("cue_no"), "start_ms", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"), F.trim("text").alias("text"))


def utterances(rows: DataFrame, offset: Column) -> DataFrame:
    """(media_id, utterances) to cues shifted by a session's offset, with their words."""
    u = rows.select("media_id", offset.alias("offset"), F.explode("utterances").alias("u")).where("u.start_time is not null and u.end_time > u.start_time")
    words = F.transform("u.words", lambda w: F.struct((w["start_time"] + F.col("offset")).alias("start_ms"), (w["end_time"] + F.col("offset")).alias("end_ms")))
    out = u.select("media_id", (F.col("u.start_time") + F.col("offset")).alias("start_ms"), (F.col("u.end_time") + F.col("offset")).alias("end_ms"), F.col("u.text").alias("text"), words.alias("words"))
    return out.withColumn("cue_no", F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "end_ms", "text")).cast("long"))


def pipe_metadata(lines: DataFrame) -> DataFrame:
    """``file|text`` lines (column value); the number is the six digits of the file's name."""
    p = F.split("value", r"\|", 2)
    out = lines.where(F.size(p) == 2).select(F.trim(p[0]).alias("file"), tx.clean_text(p[1]).alias("text")).where("text <> ''")
    return out.withColumn("number", F.nullif(F.regexp_extract("file", r"(\d{6})\.wav$", 1), F.lit("")).cast("long"))


def encoded_metadata(lines: DataFrame, min_codes: int = 30) -> DataFrame:
    """``file|text|[codes]`` lines; ``reason`` says why a line is refused."""
    p = F.split("value", r"\|", 3)
    codes = F.from_json(F.get(p, F.lit(2)), "array<int>")
    out = lines.select(F.get(p, F.lit(0)).alias("file"), F.get(p, F.lit(1)).alias("text"), codes.alias("codes"))
    return out.withColumn("reason", F.when(F.coalesce(F.size("codes"), F.lit(-1)) < min_codes, "parse_or_codes"))


# Settings that a voice pack has where it doesn't say otherwise.
PACK_RENDER = {"speed": 1.0, "pitch": 0.0, "emotion": "neutral", "tail_pad_ms": 80, "max_stretch_ratio": 1.08}
PACK_QUALITY = {
    "cheap_gate_ratio_min": 0.5, "cheap_gate_ratio_max": 2.0, "chars_per_sec_min": 5.0, "chars_per_sec_max": 25.0,
    "tail_fade_threshold": 0.85, "tail_abrupt_threshold": 0.15, "asr_threshold": 0.85, "max_retry": 4,
}
PACK_TEXTS = {
    "model_version": "vieneu_case_a_lite_v4", "text_norm_version": "vi_norm_v1.3_tail", "ref_codes": "ref_codes.pt",
    "ref_text": "ref_text.txt", "merged_model_path": "merged_model_fp16.pt",
}
PACK_MODEL, PACK_CODEC, PACK_CACHE = "pnnbao-ump/VieNeu-TTS-0.3B", "neuphonic/distill-neucodec", "_FAST_TTS_CACHE_DO_NOT_DELETE/v4_cache"
#: Older names, in the order in which they are looked at.
PACK_ALIASES = {
    "voice_id": ("voice_id", "id"), "display_name": ("display_name", "name"), "model": ("model", "backbone"), "codec": ("codec",),
    "lora_path": ("lora_path", "loraDir"), "ref_audio": ("ref_audio", "refAudio"), "cache_dir": ("fastTtsCacheDir", "cache_dir"),
}
PACK_OLD_RENDER = {"speed": ("srtSpeechSpeed", "speechSpeed"), "pitch": ("pitch",), "emotion": ("emotion",), "tail_pad_ms": ("tailPadMs",)}


def with_pack_defaults(packs: DataFrame, pack: str = "pack", folder: str = "folder") -> DataFrame:
    """Columns of voice packs, sparse JSON objects in a VARIANT, with aliases resolved and defaults merged at every depth.

    A setting that the pack has, null too, is kept; else its older names count, else the default. A
    name counts where it is neither null nor empty. A pack is ``ready`` that has tuned weights, or a
    reference and the status ``ready``. All that the pack says stays in ``pack``.
    """
    v = F.col(pack)
    has = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    kinds = {str: "string", float: "double", int: "int"}

    def setting(paths: Sequence[str], default: object) -> Column:
        out = F.lit(default)
        for path in reversed(paths):
            out = F.when(has(path), F.try_variant_get(v, path, kinds[type(default)])).otherwise(out)
        return out

    def named(name: str, default: Column) -> Column:
        return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in PACK_ALIASES[name]], default)

    none = F.lit(None).cast("string")
    names = {"voice_id": F.col(folder), "display_name": F.col(folder), "model": F.lit(PACK_MODEL), "codec": F.lit(PACK_CODEC), "lora_path": none, "ref_audio": none, "cache_dir": F.concat(folder, F.lit("/" + PACK_CACHE))}
    render = F.struct(*[setting([f"$.render_settings.{k}", *[f"$.{x}" for x in PACK_OLD_RENDER.get(k, ())]], d).alias(k) for k, d in PACK_RENDER.items()])
    quality = F.struct(*[setting([f"$.quality_config.{k}"], d).alias(k) for k, d in PACK_QUALITY.items()])
    flag = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(False))
    out = packs.select(
        "*", *[named(k, d).alias(k) for k, d in names.items()], *[setting([f"$.{k}"], d).alias(k) for k, d in PACK_TEXTS.items()], render.alias("render_settings"), quality.alias("quality_config"),
        F.coalesce(F.try_variant_get(v, "$.createdAt", "string"), F.lit("")).alias("created_at"), F.try_variant_get(v, "$.id", "string").alias("pack_id"), F.try_variant_get(v, "$.status", "string").alias("status"),
        flag("hidden").alias("hidden"), flag("oneShotClone").alias("one_shot"),
    )
    return out.withColumn("ready", F.col("lora_path").isNotNull() | ((F.coalesce("status", F.lit("")) == "ready") & F.col("ref_audio").isNotNull()))


def read_packs(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Voice packs from JSON files, one object a file or (``whole=False``) a line; what doesn't parse as an object goes.

    ``folder`` is the object's ``packDir``, else the file's folder.
    """
    raw = spark.read.text(path, wholetext=whole).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("__dir"), F.try_parse_json("value").alias("pack"))
    raw = raw.where(F.schema_of_variant("pack").startswith("OBJECT"))
    return with_pack_defaults(raw.select(F.coalesce(F.try_variant_get("pack", "$.packDir", "string"), "__dir").alias("folder"), "pack"))


def listed_packs(packs: DataFrame, approved: Sequence[str] = ()) -> DataFrame:
    """Packs to choose from: not hidden, approved by id or made in one shot; the newest first."""
    shown = packs.where(~F.col("hidden") & (F.coalesce(F.col("pack_id").isin(*approved), F.lit(False)) | F.col("one_shot")))
    return shown.orderBy(F.desc("created_at"), "folder")


def parse_links(lines: DataFrame, order: str) -> DataFrame:
    """The first url of each line (column value), each once, in order of first sight."""
    u = lines.select(order, tx.first_url(F.col("value")).alias("url")).where("url is not null")
    return u.groupBy("url").agg(F.min(order).alias(order))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).where("url is not null and url <> ''")


def page_state(pages: DataFrame, html: str = "html", ident: str = "RENDER_DATA|ROUTER_DATA", parsed: bool = False) -> DataFrame:
    """The state that a page carries in a script element, decoded; null if there is none. ``parsed``: of the elements named, in order, the first whose state is JSON."""
    if not parsed:
        raw = F.regexp_extract(html, rf'(?s)<script id="(?:{ident})" type="application/json">(.*?)</script>', 1)
        return pages.withColumn("state", F.nullif(F.try_url_decode(raw), F.lit("")))
    cases = []
    for name in ident.split("|"):
        raw = F.try_url_decode(F.regexp_extract(html, rf'(?s)<script id="{name}" type="application/json">(.*?)</script>', 1))
        cases.append(F.when(F.try_parse_json(F.nullif(raw, F.lit(""))).isNotNull(), raw))
    return pages.withColumn("state", F.coalesce(*cases))


def page_items(states: DataFrame, key: str, item: str = "aweme_id", also: str = "video") -> DataFrame:
    """(key, item_id, path, item): every object inside ``state`` that has an item's id and the other key, at any depth; the first of each id and key.

    States are VARIANTs that are taken apart level by level, until no object or list that could
    hold an item is left; a level holds only such. ``path`` holds the places on the way, and its
    order decides what is first: an object before what it holds, a list's elements in their order,
    an object's fields in that of their names, as VARIANT keeps no other. Ids that are null, an empty
    text, the number zero or false are none. A state that doesn't parse has no items.
    """
    spark, folder = states.sparkSession, f"{shared_folder(states.sparkSession)}/items-{uuid.uuid4().hex}"
    mark = f'"{item}"'
    level = states.select(F.col(key), F.array().cast("array<int>").alias("path"), F.try_parse_json("state").alias("v")).where("v is not null")
    found, depth = None, 0
    while True:
        held = level.where(F.to_json("v").contains(mark))
        held.write.parquet(f"{folder}/{depth}")
        held = spark.read.schema(held.schema).parquet(f"{folder}/{depth}")
        if held.isEmpty():
            break
        ids = F.try_variant_get("v", f"$.{item}", "string")
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{item}", "variant"))
        named = F.when(kind == "STRING", ids != "").otherwise(~ids.isin("0", "false"))
        is_item = F.try_variant_get("v", f"$.{also}", "variant").isNotNull() & F.coalesce(named, F.lit(False))
        here = held.where(is_item).select(key, ids.alias("item_id"), "path", F.col("v").alias("item"))
        found = here if found is None else found.unionByName(here)
        inner = held.select(F.col(key).alias("__k"), "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = inner.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")).select(F.col("__k").alias(key), F.array_append("path", F.col("pos")).alias("path"), F.col("value").alias("v"))
        depth += 1
    if found is None:
        return held.select(key, F.lit("").alias("item_id"), "path", F.col("v").alias("item"))
    first = Window.partitionBy(key, "item_id").orderBy("path")
    return found.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id, rate, duration_ms, samples): 16-bit files, channels averaged, within -1 and 1; one file a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
                    rows.append((path, w.getframerate(), int(round(1000 * len(x) / w.getframerate())), x.astype(np.float32)))
            yield pd.DataFrame(rows, columns=["clip_id", "rate", "duration_ms", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "clip_id string, rate int, duration_ms long, samples array<float>")


def pair_markers(events: DataFrame) -> DataFrame:
    """Events (media_id, pos, at_ms, kind start or end) to intervals: an end closes the oldest open start; unmatched ends go."""
    w = Window.partitionBy("media_id").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("balance", F.sum(F.when(F.col("kind") == "start", 1).otherwise(-1)).over(run))
    low = F.coalesce(F.min("balance").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumn("lost", (F.col("kind") == "end") & (F.col("balance") < F.least(low, F.lit(0)))).where("not lost")
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("media_id", "kind").orderBy("pos")))
    a, b = e.where("kind = 'start'").select("media_id", "n", F.col("at_ms").alias("start_ms")), e.where("kind = 'end'").select("media_id", "n", F.col("at_ms").alias("end_ms"))
    return a.join(b, ["media_id", "n"]).select("media_id", "start_ms", "end_ms")


def text_units(df: DataFrame, text: str = "text") -> DataFrame:
    """(…, unit_no, unit): the lines of a text, or its sentences if it is a single line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?。！？])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    kept = [c for c in df.columns if c != text]
    return df.withColumn("__l", lines).select(*kept, F.posexplode(F.when(F.size("__l") > 1, F.col("__l")).otherwise(sentences)).alias("unit_no", "unit"))
