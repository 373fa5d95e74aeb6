"""Hand-written input and output for what SQL doesn't check."""

import json
import os
import re
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuespark.functions import text as tx
from cuespark.operators import expand as ex
from cuespark.operators import sequence as sq
from cuespark.operators import stats as st
from cuespark.plans import jobs
from cuespark.sources import readers as rd
from cuespark.sources import writers as wr
from cuespark.streaming import jobs as stream

SMALLEST = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_scalar_functions(spark):
    assert one(spark, "0:00:01,5", tx.srt_ms) == 1500 and one(spark, "bad", tx.srt_ms) is None
    assert one(spark, "bad", lambda c: tx.srt_ms(c, "zero")) == 0
    assert one(spark, "a &lt;b&gt; &amp;amp; <i>c</i>", tx.clean_text) == "a <b> &amp; c"
    assert one(spark, "&eacute;&#233;&#xE9;&copy&notit; &middot; &bogus; &amp;lt;", lambda c: tx.clean_text(c, "all")) == "ééé©¬it; · &bogus; &lt;"
    assert one(spark, "â€œquoteâ€\x9d", tx.repair_mojibake) == "“quote”" and one(spark, "plain “é”", tx.repair_mojibake) == "plain “é”"
    assert one(spark, "<b>Năm</b> 2,tang 15 nha so a7 1000 ,e\u0301", tx.normalize_text) == "Năm hai, tang mười lăm nha so a7 1000, é"
    assert one(spark, "xin chÃ o", tx.repair_mojibake) == "xin chÃ o" and one(spark, "cafÃ©", tx.repair_mojibake) == "café"
    assert one(spark, "hai 21 va 105 1000", tx.numbers_to_words) == "hai hai mươi mốt va một trăm lẻ năm 1000"
    assert one(spark, "Hi", tx.enforce_tail) == "Hi..." and one(spark, "a b c d", tx.enforce_tail) == "a b c d."
    tokens = lambda t: one(spark, t, lambda c: F.array_join(tx.compare_tokens(c), " "))
    assert tokens("Đường phố") == "duong pho" and tokens("khi haman TY") == "luc ham an tuy"
    assert tokens("hai mươi lăm; 25, 010 2025 115") == "hai lam hai lam muoi 2025 mot tram muoi lam" and tokens("mười muoi ba 10") == "muoi muoi ba muoi"
    assert one(spark, "Thôi.", lambda c: tx.enforce_tail(c, "clip")) == "Thôi..." and one(spark, " ".join("abcdefghi") + " this.", lambda c: tx.enforce_tail(c, "clip")).endswith("this.")
    assert one(spark, "漢字 => hello", tx.strip_source_residue) == "hello"
    assert one(spark, 'x {"a": 1} y', tx.salvage_json) == '{"a": 1}'
    assert one(spark, "go https://a.b/c), now", tx.first_url) == "https://a.b/c"
    assert one(spark, "ep10 part2", tx.natural_key) == "ep000000000010 part000000000002"


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿1\r\n00:00:00,000 --> 00:00:02.5\r\n<b>Xin</b>\r\nchào\r\n\r\n2\r\n0:00:02,000 --> 0:00:04,000\r\ntwo\r\n3\r\n00:00:05,000 --> 00:00:04,000\r\nbad\r\n".encode())
    got = [tuple(r) for r in rd.read_srt(spark, str(tmp_path)).select("media_id", "cue_no", "start_ms", "end_ms", "text").orderBy("cue_no").collect()]
    assert got == [("a", 1, 0, 2500, "<b>Xin</b> chào"), ("a", 2, 2500, 4000, "two")]
    cues = spark.createDataFrame([("m", 1, 0, 1000, "hi"), ("m", 2, 1000, 2000, " ")], "media_id string, cue_no long, start_ms long, end_ms long, text string")
    wr.write_srt(cues, str(tmp_path / "out"))
    assert wr.srt_text(cues).first()["content"] == "1\n00:00:00,000 --> 00:00:01,000\nhi\n"


def test_recogniser_json(spark):
    j = {"segments": [{"text": "a b", "start": 0.0, "end": 1.0, "words": []}], "chunks": [{"text": "a b", "timestamp": [0.0, 1.0]}]}
    got = rd.parse_asr_json(spark.createDataFrame([("m", json.dumps(j))], "media_id string, content string"))
    assert sorted(tuple(r)[3:] for r in got.collect()) == [("a", 0, 500), ("b", 500, 1000)]


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(struct.pack("<4h", 16384, 0, -16384, -16384))
    r = rd.read_wav(spark, str(tmp_path)).first()
    assert r["rate"] == 8000 and r["samples"] == [0.25, -0.5]


def test_dataset_sink(spark, tmp_path):
    wr.write_dataset(spark.createDataFrame([("a.wav", "t", None), ("b.wav", "u", "short")], "file string, text string, reason string"), str(tmp_path / "d"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "d" / "metadata")).collect()] == ["a.wav|t"]
    assert {r["value"] for r in spark.read.text(str(tmp_path / "d" / "report")).collect()} == {"accepted=1", "short=1"}


def test_packs(spark, tmp_path):
    packs = {
        "new": {"voice_id": "a", "render_settings": {"speed": 2, "pitch": None}, "createdAt": "2025-02", "oneShotClone": True, "status": "ready", "refAudio": "r.wav", "extra": {"kept": 1}},
        "old": {"id": "b", "name": "Bee", "speechSpeed": 1.5, "tailPadMs": 90, "loraDir": "lora", "createdAt": "2025-03", "quality_config": {"max_retry": 9}},
        "hidden": {"id": "c", "hidden": True, "oneShotClone": True},
        "other": {"id": "d", "createdAt": "2026"},
    }
    for name, pack in packs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "pack.json").write_text(json.dumps(pack))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "pack.json").write_text("[1, 2")
    got = rd.read_packs(spark, f"{tmp_path}/*/pack.json")
    assert got.count() == 4
    rows = rd.listed_packs(got, ["b"]).collect()
    assert [(r.folder, r.voice_id, r.display_name, r.ready, r.render_settings.speed, r.render_settings.pitch, r.render_settings.tail_pad_ms, r.quality_config.max_retry) for r in rows] == [
        ("old", "b", "Bee", True, 1.5, 0.0, 90, 9), ("new", "a", "new", True, 2.0, None, 80, 4)
    ]
    assert rows[1].cache_dir == "new/_FAST_TTS_CACHE_DO_NOT_DELETE/v4_cache" and rows[1].ref_codes == "ref_codes.pt" and rows[0].lora_path == "lora"
    assert rd.listed_packs(got).select(F.try_variant_get("pack", "$.extra.kept", "int")).collect()[0][0] == 1


def test_page_items(spark):
    state = {"z": [{"aweme_id": "1", "video": 1, "deep": [[[{"aweme_id": "2", "video": None}]]]}], "a": {"aweme_id": "1", "video": 2}, "no": [{"aweme_id": 0, "video": 1}, {"aweme_id": "0", "video": 1}, {"aweme_id": "3"}]}
    frame = spark.createDataFrame([(1, json.dumps(state)), (2, '{"cut'), (3, None), (4, "[]"), (5, '"aweme_id"')], "page_id int, state string")
    got = rd.page_items(frame, "page_id").select("page_id", "item_id", F.to_json(F.try_variant_get("item", "$.video", "variant")).alias("v"))
    assert sorted(map(tuple, got.collect())) == [(1, "0", "1"), (1, "1", "2"), (1, "2", "null")]
    assert rd.page_items(frame.limit(0), "page_id").count() == 0


def test_clamped_cues_never_overlap(spark):
    rng = np.random.default_rng(0)
    rows = [(int(m), k, int(s), int(s + n)) for k, (m, s, n) in enumerate(zip(rng.integers(0, 5, 300), rng.integers(0, 9000, 300), rng.integers(1, 900, 300), strict=True))]
    out = sq.clamp_overlaps(spark.createDataFrame(rows, "media_id long, cue_no long, start_ms long, end_ms long")).toPandas().sort_values(["media_id", "cue_no"])
    assert all((g.start_ms.to_numpy()[1:] >= g.end_ms.to_numpy()[:-1]).all() for _, g in out.groupby("media_id")) and (out.end_ms > out.start_ms).all()


def test_splitters_keep_the_text(spark):
    text = "One two three, four five. " * 30 + "x" * 90
    f = spark.createDataFrame([(1, text)], "id long, text string")
    for out, column, limit in ((ex.chunk_text(f, 50), "chunk", 50), (ex.split_caption(f, 40), "piece", 90)):
        parts = [r[column] for r in out.collect()]
        assert "".join("".join(parts).split()) == "".join(text.split()) and max(map(len, parts)) <= limit


def test_wrap_and_coverage(spark):
    assert one(spark, "aaa bbb ccc ddd", lambda c: ex.wrapped(c, 7, 2)) == "aaa bbb\nccc ddd"
    assert one(spark, "aaa bbb ccc ddd eee", lambda c: ex.wrapped(c, 3, 2)) == "aaa\nbbb ccc ddd eee"
    f = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "x", "d"])], "e array<string>, a array<string>")
    assert f.select(st.lcs_coverage(F.col("e"), F.col("a"))).first()[0] == 0.5


def test_model_failures_stay_in_their_rows(spark):
    f = spark.createDataFrame([(k, "ok" if k != 3 else "bad") for k in range(6)], "k long, text string")

    def model(_, part: pd.DataFrame) -> pd.DataFrame:
        if (part.text == "bad").any():
            raise ValueError("no")
        return pd.DataFrame({"n": part.text.str.len()})

    got = {r["k"]: (r["n"], r["error"]) for r in jobs.apply_model(f, model, "n long", batch=4).collect()}
    assert got[3] == (None, "no") and all(got[k] == (2, None) for k in (0, 1, 2, 4, 5))


def test_blocks_are_halved(spark):
    f = spark.createDataFrame([(1, k, f"t{k}") for k in range(1, 9)], "media_id long, cue_no long, text string")
    out = jobs.apply_blocks(f, lambda t: [x.upper() for x in t if x != "t5"], 8)
    assert [(r["reply"], r["kept"]) for r in out.orderBy("cue_no").collect()] == [(x, x == "t5") for x in ("T1", "T2", "T3", "T4", "t5", "T6", "T7", "T8")]
    with pytest.raises(Exception, match="BLOCK_COUNT_MISMATCH 0 of 1"):
        jobs.apply_blocks(f, lambda t: [x.upper() for x in t if x != "t5"], 8, on_fail="raise").collect()
    asked = jobs.apply_blocks(f, lambda t: [x.upper() for x in t], 8, least=4, accept=lambda a, b: a != "t5", on_fail="null")
    assert [r["reply"] for r in asked.orderBy("cue_no").collect()] == ["T1", "T2", "T3", "T4", None, None, None, None]


def test_stream_matches_its_batch_twin(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.expr("event_type = 'error'").alias("failed"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    s = stream.provider_health(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "30 days")
    q = s.writeStream.outputMode("complete").format("memory").queryName("health").start()
    q.processAllAvailable()
    q.stop()
    batch = stream.provider_health(events.withColumn("ts_ms", F.unix_millis("ts")))
    assert sorted(map(tuple, spark.table("health").collect())) == sorted(map(tuple, batch.collect()))


def _attempts(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = F.col("event_type")
    status = F.when(kind == "error", 500).when(kind == "signup", 401).otherwise(200).alias("status")
    return e.select(F.col("user_id").alias("job"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (kind == "error").alias("failed"), status, (F.col("value") > 20).alias("tail"), F.concat(F.lit("PROGRESS:"), F.col("value").cast("string"), F.lit(":"), kind).alias("line"))


def test_state_streams_match_their_batch_twins(spark, tmp_path):
    attempts = _attempts(spark)
    bounds = attempts.selectExpr("percentile_approx(ts_ms, array(0.3, 0.7), 10000) as b").first()["b"]
    for k, part in enumerate((f"ts_ms <= {bounds[0]}", f"ts_ms > {bounds[0]} and ts_ms <= {bounds[1]}", f"ts_ms > {bounds[1]}")):
        attempts.where(part).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in sorted((tmp_path / f"in{k}").glob("*.parquet")):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
            os.utime(tmp_path / "in" / f"{k}-{f.name}", (1_700_000_000 + k, 1_700_000_000 + k))
    arriving = lambda: spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cases = [
        ("ladder", stream.retry_state_stream(arriving()), st.retry_state(attempts), "complete"),
        ("progress", stream.progress_status_stream(arriving()), st.progress_status(attempts), "complete"),
    ]
    for name, streamed, batch, mode in cases:
        streamed.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        got, want = sorted(map(tuple, spark.table(name).collect())), sorted(map(tuple, batch.collect()))
        assert got == want and len(want) > 10, name


def test_worker_states_by_timers(spark, tmp_path):
    """Attempts come out of order over many micro-batches; workers are alive again by a timer; later ones than the watermark are dropped."""
    attempts = _attempts(spark).drop("line", "tail")
    cooling, rows = 3_600_000_000, attempts.orderBy("ts_ms", "event_id").collect()
    with pytest.raises(RuntimeError, match="RocksDB"):
        stream.worker_state_stream(spark.readStream.schema(attempts.schema).parquet(str(tmp_path)))
    # pairs of neighbours in time change places between batches; a last batch of another worker moves the watermark on
    end = rows[-1].ts_ms + 20_000 * 86_400_000
    parts = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    mixed = [parts[k ^ 1] if (k ^ 1) < len(parts) else parts[k] for k in range(len(parts))] + [[(-1, -1, end, False, 200)], [(-1, -2, end + 1, False, 200)]]
    late = [(rows[0].job, -3, rows[0].ts_ms - 1, True, 500)]
    for k, part in enumerate([*mixed, late, [(-1, -4, end + 2, False, 200)]]):
        spark.createDataFrame([tuple(r) for r in part], attempts.schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k:03d}-{f.name}")
            os.utime(tmp_path / "in" / f"{k:03d}-{f.name}", (1_700_000_000 + k, 1_700_000_000 + k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        arriving = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = stream.worker_state_stream(arriving, cooling, alarm=2, watermark="400 days", forget_ms=10_000 * 86_400_000)
        out.writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table("states").where("job >= 0")
    want = st.worker_state(attempts, cooling, alarm=2).select("event_id", "cooling", "errors", "alarm")
    assert sorted(map(tuple, got.where("kind = 'attempt'").select("event_id", "cooling", "errors", "alarm").collect())) == sorted(map(tuple, want.collect()))
    alive = set()
    for job in {r.job for r in rows}:
        failed = [r.ts_ms for r in rows if r.job == job and r.status == 401]
        alive |= {(job, t + cooling) for k, t in enumerate(failed) if k + 1 == len(failed) or failed[k + 1] > t + cooling}
    assert {(r.job, r.at_ms) for r in got.where("kind = 'alive'").collect()} == alive and alive


def test_cache_upserts_keep_the_last_row(spark, tmp_path):
    rows = [("a", 1, "old"), ("b", 5, "b"), ("a", 3, "new"), ("a", 2, "mid")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "fingerprint string, created_at long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "fingerprint string, created_at long, v string"
    for _ in range(2):  # the second run finds nothing new
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.cache_upserts(arriving, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = stream.read_cache(spark, str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == [("a", 3, "new"), ("b", 5, "b")] and len(list((tmp_path / "out").glob("batch=*"))) == 4


def test_cache_feed_drops_known_prints(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")], "fingerprint string, t string").select("fingerprint", F.to_timestamp("t").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream.cache_feed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["fingerprint"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_groups(spark):
    from cuespark.operators import grouping as gr

    rows = [(1, 1, 0, 1000, "Hello there", "a"), (1, 2, 1100, 2000, "my friend.", "a"), (1, 3, 2050, 2500, "Yes.", "b"), (1, 4, 9000, 12000, "A whole new sentence here.", "b"), (1, 5, 12050, 13000, "sentence here. And more", "b")]
    c = spark.createDataFrame(rows, "media_id long, cue_no long, start_ms long, end_ms long, text string, speaker string")
    got = lambda df: [(r["text"], r["members"]) for r in df.orderBy("group_no").collect()]
    assert got(gr.group_smart(c))[0] == ("Hello there, my friend. Yes.", 3)
    assert got(gr.group_natural(c))[0] == ("Hello there, my friend.", 2)
    assert got(gr.merge_short(c))[0][0] == "Hello there my friend. Yes." or got(gr.merge_short(c))[0][1] >= 2
    assert [r["text"] for r in gr.finalize_cues(c)[0].orderBy("start_ms").collect()][-1] == "sentence here. And more"
    assert got(gr.merge_tiny(c))[0] == ("Hello there my friend.", 2)
    assert one(spark, "one two three, four five six", lambda x: gr.long_cue_pieces(x, 10)) == ["one two th", "ree,", "four five ", "six"]
    assert one(spark, "漢字 漢字，abc", lambda x: gr.long_cue_pieces(x, 10)) == ["漢字漢字，", "abc"]
    pieces = gr.split_for_reading(c, 12).where("cue_no = 4").orderBy("piece_no").collect()
    assert pieces[0]["part_start"] == 9000 and pieces[-1]["part_end"] == 12000


def test_correct_tracks_applies_the_whole_glossary_of_each_track(spark):
    short = [f"w{k:02d}x" for k in range(40)]
    rows = [(m, k + 1, k * 1000, k * 1000 + 900, t) for m in (1, 2) for k, t in enumerate([*short[m - 1 :: 2], "say " + " and ".join(short)])]
    cues = spark.createDataFrame(rows, "media_id long, cue_no long, start_ms long, end_ms long, text string")
    glossary = lambda s: s.where("length(text) < 8").select("media_id", F.col("text").alias("wrong"), F.upper("text").alias("correct")).distinct()
    got = {r["media_id"]: r["text"] for r in jobs.correct_tracks(cues, glossary, lambda t: t)[0].where("cue_no = 21").collect()}
    for m in (1, 2):
        own = set(short[m - 1 :: 2])
        assert got[m] == "say " + " and ".join(x.upper() if x in own else x for x in short)
    assert {(r["media_id"], r["n"]) for r in jobs.correct_tracks(cues, glossary, lambda t: t)[1].where("rule = 'glossary'").collect()} == {(1, 21), (2, 21)}
    plain = spark.createDataFrame([("a", "b")], "wrong string, correct string")
    assert tx.apply_phrase_table(cues.limit(1).withColumn("text", F.lit("aa")), plain).first()["text"] == "bb"


def test_short_segments_are_merged_to_the_last(spark):
    """400 short cues of one speaker leave none that could still join."""
    from cuespark.operators.grouping import merge_short

    rows = [(1, k, k * 1000, k * 1000 + 900, f"w{k}", "a") for k in range(400)]
    got = merge_short(spark.createDataFrame(rows, "media_id long, cue_no long, start_ms long, end_ms long, text string, speaker string")).collect()
    assert sum(r["members"] for r in got) == 400
    assert all(r["end_ms"] - r["start_ms"] >= 1500 and len(r["text"]) >= 12 and len(r["text"].split()) >= 3 for r in got)


def test_merge_short_choices(spark):
    from cuespark.operators.grouping import merge_short

    long = "a text that is long enough"
    rows = [
        (1, 1, 0, 3000, long, "a"), (1, 2, 3500, 4000, "yes it was", "a"), (1, 3, 4100, 6000, long, "a"),  # the shorter neighbour
        (2, 1, 0, 3000, long, "a"), (2, 2, 3100, 3400, "STR", "b"), (2, 3, 3450, 6500, long, "c"),  # tiny: the nearer one
        (3, 1, 0, 3000, long, "a"), (3, 2, 3900, 5000, "so it is", "b"), (3, 3, 5000, 8000, long, "c"),  # not tiny: the one before
    ]
    got = merge_short(spark.createDataFrame(rows, "media_id long, cue_no long, start_ms long, end_ms long, text string, speaker string")).collect()
    assert sorted((r["media_id"], r["start_ms"], r["end_ms"]) for r in got) == [(1, 0, 3000), (1, 3500, 6000), (2, 0, 3000), (2, 3100, 6500), (3, 0, 5000), (3, 5000, 8000)]


def test_natural_keys_of_long_numbers(spark):
    from cuespark.functions.text import natural_key

    names = ["v9", "v10", "v999999999999", "v1000000000000", "v01000000000001", "v99999999999999999999", "v100000000000000000000"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", natural_key(F.col("n"))).collect()}
    assert sorted(names, key=got.get) == names and len(set(got.values())) == len(names)


def test_token_match_against_brute_force(spark):
    import random

    from cuespark.operators.stats import match_tokens

    rng = random.Random(8)
    pairs = [([rng.choice("abcdef") for _ in range(rng.randint(0, 90))], [rng.choice("abcdefg") for _ in range(rng.randint(0, 90))]) for _ in range(150)] + [(list("abc"), list("xxabc")), ([], [])]

    def lcs(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "k int, x array<string>, y array<string>")
    for r in df.select("x", "y", match_tokens(F.col("x"), F.col("y")).alias("m")).collect():
        x, y, m = r["x"], r["y"], r["m"]
        assert abs(m["coverage"] - lcs(x, y) / max(1, len(x))) < 1e-12
        assert m["extra_prefix"] == next((k for k, t in enumerate(y) if t in x[:3]), len(y)) and m["first_token"] == bool(x and y and x[0] == y[0])
        assert m["ok"] == (m["coverage"] >= 0.92 and m["extra_prefix"] <= 1)


def test_cues_from_words_of_two_scripts(spark):
    from cuespark.operators.expand import cues_from_words

    words = [(1, k, k * 500, k * 500 + 450, t) for k, t in enumerate(["你", "好", "。", "one", "two,", "three", "four."])]
    got = cues_from_words(spark.createDataFrame(words, "media_id long, cue_no long, start_ms long, end_ms long, text string"), 40, 800).orderBy("start_ms").collect()
    assert [r["text"] for r in got] == ["你好 。", "one two,", "three four."]


def test_insertions_by_source_and_their_survival(spark):
    from cuespark.operators.joins import insert_candidates, lost_insertions

    kind = "media_id long, {0}_id long, {0}_start long, {0}_end long, {0}_key string"
    final = spark.createDataFrame([(1, 1, 0, 2000, "thefirstcue"), (1, 2, 9000, 11000, "somethingelse")], kind.format("b"))
    cue = lambda s, ok, k, a, b, t: (1, k, a, b, t, s, ok)
    sources = spark.createDataFrame(
        [cue("x", True, 1, 0, 2000, "thefirstcue"), cue("x", True, 2, 4000, 6000, "amissingcue"), cue("y", True, 3, 4100, 6100, "amissingcue"), cue("x", True, 4, 9000, 11000, "wholly=unlike!"), cue("z", False, 5, 20000, 22000, "untrusted")],
        kind.format("a") + ", source string, trusted boolean",
    )
    track, events = insert_candidates(final, sources, ["x", "y", "z"])
    assert {r["a_id"]: r["class"] for r in events.collect()} == {1: "covered", 2: "inserted", 3: "covered", 4: "suspicious", 5: "report_only"}
    assert sorted((r["b_id"], r["source"]) for r in track.collect() if r["source"]) == [(2, "x")] and track.count() == 3
    assert [r["a_id"] for r in lost_insertions(events, final).collect()] == [2] and lost_insertions(events, track).count() == 0


def test_plans_hold_no_media_against_itself(spark):
    """Differences of intervals and tokens' alignment meet in buckets or in one order, never all rows of a media with all."""
    from cuespark.operators import sequence as sq

    x = spark.range(10).selectExpr("id % 2 as media_id", "id * 10 as start_ms", "id * 10 + 5 as end_ms", "id as word_no", "id as cue_no", "1 as n_tokens")
    plan = sq.subtract_intervals(x.limit(1), x)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan
    assert "Join" not in sq.align_by_token_count(x, x)._jdf.queryExecution().optimizedPlan().toString()


def registered(name, tables):
    """A query's SQL form over tables of its own."""
    import duckdb

    from cuespark import queries  # noqa: F401  fills the registry
    from cuespark.registry import ORACLES

    con = duckdb.connect()
    for table, frame in tables.items():
        con.register(table, frame)
    return con.execute(ORACLES[name]).fetchall()


def test_sql_counts_edits_in_characters():
    import duckdb

    from cuespark.queries import _EDITS

    pairs = pd.DataFrame({"a_key": ["äöüßéèabcd", "größe", "ab", "", "éa"], "b_key": ["xyzuvwabcd", "grüße", "abc", "ü", "aé"]})
    con = duckdb.connect()
    con.register("p", pairs)
    assert [r[0] for r in con.execute(f"SELECT {_EDITS} FROM p").fetchall()] == [6, 1, 1, 1, 2]  # in bytes 12 for the first


def test_sql_of_repair_leaves_what_has_no_fewer_marks():
    docs = pd.DataFrame({"doc_id": [1, 2, 3, 4, 5], "text": ["Äau", "schön", "Ä schön", "plain “é”", None]})
    assert dict(registered("txt3_repair_mojibake", {"documents": docs})) == {1: "Ã\x84au", 2: "schön", 3: "Ä schön", 4: "plain “é”", 5: None}


def test_compare_tokens_drops_muoi_without_a_fold(spark):
    tokens = lambda t: one(spark, t, lambda c: F.array_join(tx.compare_tokens(c), " "))
    assert tokens("hai muoi muoi ba") == "hai ba" and tokens("muoi muoi mot muoi muoia") == "muoi muoi mot muoia"
    assert tokens("25 muoi 10 muoi") == tokens("hai lam muoi 10 muoi") and tokens("mot 10 ty") == "mot muoi tuy" and tokens("...") == ""
    plan = spark.range(1).select(tx.compare_tokens(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "aggregate(" not in plan  # which copies all tokens for each one


def test_normalised_text_is_computed_once(spark):
    assert one(spark, "12 con, 1234 x5 7", tx.normalize_text) == "mười hai con, 1234 x5 bảy" and one(spark, "é ab", tx.normalize_text) == "é ab"
    plan = spark.range(1).select(tx.normalize_text(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("làm điêu") == 1


def test_python_holds_slices_of_an_arrow_batch(spark):
    df = spark.range(3 * ex.SLICE + 1).repartition(1).select(F.concat(F.col("id"), F.lit(" b")).alias("text"))
    seen = df.select(ex.in_slices(lambda t: [t, t], "array<string>", F.col("text")).alias("x"), "text")
    assert seen.where("x[0] = text and size(x) = 2").count() == 3 * ex.SLICE + 1


def test_blocks_share_an_arrow_batch(spark):
    rows = [(m, n, f"{m}.{n}") for m in range(30) for n in range(5, 0, -1)] + [(1, None, "x"), (2, 9, None)]
    df = spark.createDataFrame(rows, "media_id long, cue_no long, text string")
    out = jobs.apply_blocks(df, lambda texts: [f"{k} {t}" for k, t in enumerate(texts)], 4)
    assert out.where("not kept").count() == len(rows) and {r["reply"] for r in out.where("media_id = 3").collect()} == {"0 3.1", "1 3.2", "2 3.3", "3 3.4", "0 3.5"}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["seq22_stitch_shorts", "seq16_pack_blocks"])
def test_slots_are_dealt_by_their_rows(spark, monkeypatch, name):
    """A task's share of the slots doesn't grow with the table: one exchange, into as many partitions as the rows ask for."""
    from cuespark import queries, standins  # noqa: F401  fills the registry
    from cuespark.registry import QUERIES

    monkeypatch.setattr(standins, "TASK_ROWS", 100)
    n = standins.table(spark, SMALLEST, "lineitem").count()
    plan = QUERIES[name](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), (\w+)", plan)
    assert n > 800 and dealt == [(str(-(-n // 100)), "REPARTITION_BY_NUM")]


def test_unexplained_activity_deals_its_joins(spark, monkeypatch):
    """Joins and the order of pieces go to as many partitions as the rows ask for, whatever they take in a shuffle."""
    from cuespark import queries, standins  # noqa: F401  fills the registry
    from cuespark.registry import QUERIES

    monkeypatch.setattr(standins, "TASK_ROWS", 100)
    n = -(-standins.table(spark, SMALLEST, "lineitem").count() // 100)
    plan = QUERIES["mat7_unexplained_activity"](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), (\w+)", plan)
    assert {(k, why) for k, why in dealt[1:]} == {(str(n), "REPARTITION_BY_NUM")}  # the first is the last aggregation's


@pytest.mark.parametrize("tasks", [None, 7])
def test_subtract_intervals_lays_cuts_in_one_order(spark, tasks):
    from cuespark.operators import sequence as sq

    kind = "media_id long, start_ms long, end_ms long"
    base = [(1, 0, 100), (1, 100, 200), (2, 0, 50), (3, 5, 5), (4, None, None), (None, 0, 9), (5, 0, 10), (6, 0, 9_000_000)]
    cuts = [(1, 10, 20), (1, 20, 30), (1, 90, 120), (1, 150, 150), (5, -5, 40), (9, 0, 1), (None, 0, 9), (6, 3_599_990, 3_600_010), (6, 8_000_000, 9_500_000)]
    got = sq.subtract_intervals(spark.createDataFrame(base, kind), spark.createDataFrame(cuts, kind), tasks=tasks)
    want = [(1, 0, 10), (1, 30, 90), (1, 120, 150), (1, 150, 200), (2, 0, 50), (3, 5, 5), (4, None, None), (None, 0, 9), (6, 0, 3_599_990), (6, 3_600_010, 8_000_000)]
    order = lambda rows: sorted((tuple(-1 if v is None else v for v in r) for r in rows))
    assert order(got.collect()) == order(want)
    joins = got._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins == 1  # heads, tails and uncut intervals took three, and the first of them twice more
