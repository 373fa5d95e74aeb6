"""Aggregates and reports, ranking, scoring and gates."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def run_report(attempts: DataFrame) -> DataFrame:
    """One row over attempts (status, failed, hit, attempt, tail, degraded, seconds)."""
    n = F.count(F.lit(1))
    return attempts.agg(
        n.alias("total"), count_if(F.col("status") == 200).alias("ok"), count_if(F.col("failed")).alias("failed"),
        count_if(F.col("status") == 429).alias("limited"), F.round(count_if(F.col("status") == 200) / n, 4).alias("ok_share"),
        count_if(F.col("hit")).alias("hits"), F.round(count_if(F.col("hit")) / n, 4).alias("hit_rate"), count_if(F.col("attempt") > 1).alias("retried"),
        count_if(F.col("tail") & (F.col("attempt") > 1)).alias("tail_retries"), count_if(F.col("degraded")).alias("degraded"), F.round(n / F.sum("seconds"), 3).alias("per_second"),
    )


def track_stats(cues: DataFrame, by: Sequence[str] = ("media_id",), leaks: Sequence[str] = (), summaries: Sequence[str] = ()) -> DataFrame:
    """Counts of a track's cues; ``leaks`` and ``summaries`` are markers of what doesn't belong there."""
    from cuespark.functions.text import has_marker

    d = F.col("end_ms") - F.col("start_ms")
    cjk, solid = F.sum(F.regexp_count("text", F.lit(r"[\x{3400}-\x{9fff}]"))), F.sum(F.length(F.regexp_replace("text", r"\s", "")))
    return cues.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cues"), F.sum(F.length("text")).alias("chars"), count_if(d > 15000).alias("over_15s"),
        count_if(F.length("text") > 90).alias("over_90_chars"), F.round(F.avg(d), 3).alias("avg_ms"), F.max("end_ms").alias("last_ms"),
        F.round(F.coalesce(cjk / F.nullif(solid, F.lit(0)), F.lit(0.0)), 4).alias("cjk_share"),
        count_if(has_marker(F.col("text"), leaks)).alias("leaks"), count_if(has_marker(F.col("text"), summaries)).alias("summary_like"),
    )


def worker_metrics(attempts: DataFrame, order: str = "event_id") -> DataFrame:
    """Requests, failures and the last status of each job's worker."""
    return attempts.groupBy("job").agg(F.count(F.lit(1)).alias("requests"), count_if(F.col("failed")).alias("failures"), F.max_by("status", order).cast("long").alias("state"))


def group_by_profile(rows: DataFrame, *profile: Column, default: str = "__default__") -> DataFrame:
    """Rows and their time by the first profile given, so that a model is loaded once for each."""
    return rows.groupBy(F.coalesce(*profile, F.lit(default)).alias("profile")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("ms"))


def eta(done: DataFrame, totals: DataFrame, by: str = "job") -> DataFrame:
    """Progress of jobs: ``done`` rows (by, seconds) against ``totals`` (by, total, media_s, cached).

    ``eta_s`` goes by the mean so far; before any row is done by the fixed rates: 72 s for an hour
    of media and 3 s more, at least 15 s, and for cached rows 4 ms each, at least 1 s.
    """
    d = done.groupBy(by).agg(F.count(F.lit(1)).alias("done"), F.avg("seconds").alias("avg_s"))
    out = totals.join(d, by, "left").withColumn("done", F.coalesce("done", F.lit(0)))
    fixed = F.when(F.col("cached"), F.greatest(F.lit(1.0), F.col("total") * 0.004)).otherwise(F.greatest(F.lit(15.0), F.col("media_s") / 3600 * 72 + 3))
    left = F.when(F.col("done") > 0, F.col("avg_s") * (F.col("total") - F.col("done"))).otherwise(fixed)
    return out.select(by, "done", "total", F.round("avg_s", 6).alias("avg_s"), F.round(left, 4).alias("eta_s"))


def best_rendition(renditions: DataFrame, by: str, codecs: Sequence[str] = ("h264", "h265")) -> DataFrame:
    """Of renditions (by, id, width, height, size, codec) the one of most pixels, then size, then codec by its place in ``codecs``; ties by id."""
    bonus = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in codecs]), F.col("codec")), F.lit(0))
    return renditions.groupBy(by).agg(F.max_by("id", F.struct(F.col("width") * F.col("height"), "size", bonus, -F.col("id"))).alias("id"))


def choose_source(a: DataFrame, b: DataFrame, least: int = 5, share: float = 0.25) -> DataFrame:
    """Of two track statistics (media_id, cues), the first unless it is much sparser than the second."""
    j = a.select("media_id", F.col("cues").alias("a")).join(b.select("media_id", F.col("cues").alias("b")), "media_id", "full").na.fill(0, ["a", "b"])
    sparse = F.col("a") < F.greatest(F.lit(least), F.when(F.col("b") >= 20, F.col("b") * share).otherwise(0))
    return j.select("media_id", F.when(F.col("a") == 0, "none").when(sparse, "sparse").otherwise("ok").alias("reason"), F.when(sparse & (F.col("b") > F.col("a")), "b").otherwise("a").alias("source"))


def repeated_prefixes(cues: DataFrame, separator: str = r"[:,.]", n: int = 6) -> DataFrame:
    prefix = F.regexp_extract("text", rf"^([^\s:,.]{{1,{n}}}){separator}", 1)
    return cues.withColumn("prefix", prefix).where("prefix <> ''").groupBy("media_id", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def strip_prefixes(cues: DataFrame, near: DataFrame, n: int = 6, pad_ms: int = 1600, measure: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``stripped``: cues without a prefix that their media repeats, where the rest is no less like the other track's text near in time.

    Prefixes are up to ``n`` letters or digits before a blank or a mark. A cue without any text near
    keeps its prefix, as does one whose prefix stands in that text unless the rest is more like it.
    ``measure`` compares compact texts, by default by their matching parts.
    """
    from cuespark.functions.text import compact_key
    from cuespark.operators.joins import overlap_join

    pattern = rf"^([\x{{3400}}-\x{{9fff}}A-Za-z0-9]{{1,{n}}})[\s:：,，]+(.{{2,}})$"
    c = cues.withColumn("prefix", F.regexp_extract("text", pattern, 1)).withColumn("rest", F.trim(F.regexp_extract("text", pattern, 2)))
    twice = c.where("prefix <> ''").groupBy("media_id", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("media_id", "prefix")
    marked = c.join(twice, ["media_id", "prefix"], "left_semi")
    a = marked.select("media_id", F.col("cue_no").alias("a_id"), F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    b = near.select("media_id", F.col("cue_no").alias("b_id"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"), F.col("text").alias("b_text"))
    beside = overlap_join(a, b, pad_ms).groupBy("media_id", F.col("a_id").alias("cue_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("b_start", "b_id", "b_text"))), lambda x: x["b_text"]), " ").alias("beside"))
    like = measure or matching_ratio
    met = marked.join(beside, ["media_id", "cue_no"]).withColumn("now", like(compact_key(F.col("text")), compact_key(F.col("beside")))).withColumn("then", like(compact_key(F.col("rest")), compact_key(F.col("beside"))))
    inside = F.contains(F.col("beside"), F.col("prefix"))
    cut = met.where((F.col("rest") != "") & F.when(inside, F.col("then") > F.col("now")).otherwise(F.col("then") >= F.col("now"))).select("media_id", "cue_no", "rest")
    return cues.join(cut, ["media_id", "cue_no"], "left").withColumn("stripped", F.coalesce("rest", "text")).drop("rest")


def rejection_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of ``reason`` (null: accepted)."""
    return df.groupBy(*by, F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def dataset_summary(df: DataFrame, least: int = 500) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("ms"), F.round(F.sum("duration_ms") / 3600000, 4).alias("hours")).withColumn("enough", F.col("n") >= least)


def benchmark_packs(clips: DataFrame, fail: float = 0.82) -> DataFrame:
    return clips.groupBy("voice").agg(F.round(F.avg("score"), 6).alias("mean"), count_if(F.col("score") < fail).alias("fails"), F.min("score").alias("worst"))


def tier_breakdown(df: DataFrame, tiers: Sequence[str]) -> DataFrame:
    return df.groupBy("media_id").agg(*[count_if(F.col("tier") == t).alias(t) for t in tiers])


def provider_gate(attempts: DataFrame, share: float = 0.2, few: int = 20) -> DataFrame:
    out = attempts.groupBy("job").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("failed")).alias("failed"))
    return out.withColumn("gate", F.when(F.col("failed") == 0, "ok").when(F.col("failed") > F.col("n") * share, "unusable").when(F.col("failed") <= few, "fill").otherwise("unusable"))


def suspicious_timing(cues: DataFrame, durations: DataFrame, share: float = 0.6) -> DataFrame:
    last = cues.groupBy("media_id").agg(F.max("end_ms").alias("last_ms"))
    return durations.join(last, "media_id").withColumn("suspicious", (F.col("duration_ms") > 5000) & (F.col("last_ms") < F.col("duration_ms") * share))


def qa_report(events: DataFrame, caps: int, order: Sequence[str], salts: int = 64) -> DataFrame:
    """Per class its count and the first ``caps`` sample ids in order.

    Samples are chosen in ``salts`` parts of each class first, so a class of any size is never in one task.
    """
    part = events.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)))
    few = take_first(take_first(part, ["label", "salt"], [F.col(c) for c in order], caps), ["label"], [F.col(c) for c in order], caps)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("event_id").alias("id")))), lambda x: x["id"].cast("string")), ",")
    return events.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(few.groupBy("label").agg(ids.alias("samples")), "label")


def sum_rule_counts(df: DataFrame, counts: str = "counts") -> DataFrame:
    return df.select(F.explode(counts).alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("n"))


def signal_features(clips: DataFrame, samples: str = "samples", rate: int = 24_000, loud: float = 0.01, pad: int = 240) -> DataFrame:
    """Features of clips' samples within -1 and 1.

    ``peak``, ``rms`` and ``rms_db`` are those of the clip without its quiet ends (samples up to
    ``loud``, but ``pad`` of them beside the sound); ``seconds`` is the whole clip. Of the last
    150 ms, ``tail_first`` and ``tail_second`` are the mean levels of the halves and ``tail_ratio``
    their ratio, ``last_peak`` is the peak of the last 20 ms; these are null below 180 ms.
    """
    x = F.transform(samples, lambda v: v.cast("double"))
    out = clips.withColumn("__x", x).withColumn("__n", F.size("__x"))
    heard = F.filter(F.sequence(F.lit(1), F.col("__n")), lambda i: F.abs(F.element_at("__x", i)) > loud)
    out = out.withColumn("__i", F.when(F.col("__n") > 0, heard))
    lo, hi = F.greatest(F.lit(1), F.get("__i", F.lit(0)) - pad), F.least(F.col("__n"), F.element_at("__i", -1) - 1 + pad)
    out = out.withColumn("__a", F.when(F.size("__i") > 0, F.slice("__x", lo, F.greatest(F.lit(0), hi - lo + 1))).otherwise(F.col("__x")))
    total = lambda part, f: F.aggregate(part, F.lit(0.0), lambda acc, v: acc + f(v))
    mean = lambda part, f: total(part, f) / F.nullif(F.size(part), F.lit(0))
    k, last = int(0.15 * rate), max(1, int(0.02 * rate))
    tail = F.when(F.col("__n") >= int(0.18 * rate), F.slice("__x", F.col("__n") - k + 1, F.lit(k)))
    out = out.withColumn("__t", tail)
    return (
        out.withColumn("peak", F.coalesce(F.array_max(F.transform("__a", F.abs)), F.lit(0.0)))
        .withColumn("rms", F.sqrt(mean(F.col("__a"), lambda v: v * v))).withColumn("rms_db", 20 * F.log10(F.coalesce("rms", F.lit(0.0)) + 1e-12))
        .withColumn("seconds", F.greatest(F.lit(0.001), F.col("__n") / rate))
        .withColumn("tail_first", mean(F.slice("__t", F.lit(1), F.lit(max(1, k // 2))), F.abs)).withColumn("tail_second", mean(F.slice("__t", F.lit(max(1, k // 2) + 1), F.lit(k)), F.abs))
        .withColumn("tail_ratio", F.col("tail_second") / (F.col("tail_first") + 1e-9))
        .withColumn("last_peak", F.array_max(F.transform(F.slice("__t", F.lit(k - last + 1), F.lit(last)), F.abs)))
        .drop("__x", "__n", "__i", "__a", "__t")
    )


def cheap_gate(features: DataFrame) -> DataFrame:
    """``reasons`` a clip (features with target_ms and chars) is looked at again for."""
    from cuespark.functions.text import flags

    ratio, cps = F.col("seconds") / F.greatest(F.lit(0.001), F.col("target_ms") / 1000), F.col("chars") / F.col("seconds")
    held = (F.col("tail_ratio") > 0.85) & (F.col("tail_first") > 0.003)
    reasons = flags(
        ("low_rms", F.col("rms_db") < -45), ("clipping", (F.col("rms_db") > -3) | (F.col("peak") > 0.98)), ("duration_ratio", ~ratio.between(0.5, 2.0)),
        ("chars_per_sec", ~cps.between(5, 25)), ("no_fade_out", held), ("abrupt_end", ~held & (F.col("last_peak") > 0.15)),
    )
    return features.withColumn("reasons", reasons)


def staged_gate(clips: DataFrame, heavy, most: int = 4, most_tail: int = 4) -> DataFrame:
    """``heavy`` (a function of a frame that adds ``ok``) runs only where the cheap gate gave reasons and none is of the tail.

    Outcomes: ``fast`` without reasons; a clip with a tail issue (``tail``) isn't heard at all; what
    fails is tried again (``retry``, ``tail_retry``) until it has had ``most`` or ``most_tail``
    attempts (``attempts``, those before this one), then ``degraded``. Columns that aren't there count as false and 0.
    """
    has = lambda c, default: F.coalesce(c, F.lit(default)) if c in clips.columns else F.lit(default)
    c = clips.withColumn("__tail", has("tail", False)).withColumn("__left", has("attempts", 0))
    again = lambda name, n: F.when(F.col("__left") + 1 < n, name).otherwise("degraded")
    tail = c.where("__tail").withColumn("outcome", again("tail_retry", most_tail))
    passed = c.where((F.size("reasons") == 0) & ~F.col("__tail")).withColumn("outcome", F.lit("fast"))
    looked = heavy(c.where((F.size("reasons") > 0) & ~F.col("__tail"))).withColumn("outcome", F.when(F.col("ok"), "heavy").otherwise(again("retry", most))).drop("ok")
    return passed.unionByName(looked).unionByName(tail).drop("__tail", "__left")


def clip_score(df: DataFrame, coverage_min: float = 0.92, reject_prefix: bool = False, reject_first: bool = False, reject_short_last: float = 0.0, reject_head: bool = False, reject_tail: bool = False, first_weight: float = 0.0) -> DataFrame:
    """``score``, ``ok`` and ``reason`` of clips by their features; features that aren't there, or null, count for nothing.

    duration_ok, duration_reason; coverage, asr_ok, extra_prefix, first_match, fillers (counts or
    flags); last_s (seconds of the last word), last_min; artifacts, artifact_s; head_s, head_rms;
    islands, island_s; tail_rms, tail_peak; peak. A clip starts at 0, or 1000 where its duration is
    out of range. The reason is that of the last rule that refuses it. Scores have four decimals.
    """
    col = lambda c, default=0.0: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in df.columns else F.lit(default)
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    over = lambda x, limit, weight: F.greatest(F.lit(0.0), x - limit) * weight
    heard = F.col("coverage").isNotNull() if "coverage" in df.columns else F.lit(False)
    last_known = F.col("last_s").isNotNull() if "last_s" in df.columns else F.lit(False)
    prefix, fillers, artifacts = col("extra_prefix"), col("fillers"), col("artifacts")
    clear = flag("asr_ok", True) | (col("coverage") >= coverage_min) & (prefix <= 1)
    head = (col("head_s") > 0.10) & (col("head_rms") > 0.008)
    terms = [
        F.when(flag("duration_ok", True), 0.0).otherwise(1000.0), F.when(heard, (1 - col("coverage")) * 120 + 12 * prefix + F.when(flag("first_match", True), 0.0).otherwise(first_weight)).otherwise(0.0),
        F.when(heard, fillers * 1400).otherwise(0.0), F.when(last_known, over(col("last_min", 0.20), col("last_s"), 220.0)).otherwise(0.0), artifacts * 900 + col("artifact_s") * 1600,
        F.when(head, over(col("head_s"), 0.10, 650.0) + over(col("head_rms"), 0.008, 1200.0)).otherwise(0.0), col("islands") * 10 + col("island_s") * 20,
        over(col("tail_rms"), 0.018, 900.0) + over(col("tail_peak"), 0.20, 60.0), over(col("peak"), 0.97, 80.0),
    ]
    rules = [
        ("duration", ~flag("duration_ok", True)), ("asr_coverage", heard & ~clear), ("filler", heard & (fillers > 0)), ("extra_prefix", heard & F.lit(reject_prefix) & (prefix > 0)),
        ("first_token", heard & F.lit(reject_first) & ~flag("first_match", True)), ("short_last_word", last_known & (col("last_s") < reject_short_last)), ("artifact", artifacts > 0),
        ("voiced_head", head & F.lit(reject_head)), ("voiced_tail", (col("tail_rms") > 0.018) & F.lit(reject_tail)),
    ]
    reason = F.coalesce(*[F.when(c, F.lit(n)) for n, c in reversed(rules)])
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn("score", F.round(total, 4)).withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def pick_best(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that ends in a unique key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def take_first(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def pick_candidate(cands: DataFrame, by: Sequence[str]) -> DataFrame:
    """The candidate to keep of each key: rows (by, profile, rank, preferred, duration_s, words, chars, similarity, coverage, filler).

    Candidates too short for their text count only where all are. Where any has a similarity, the
    order is by similarity, coverage, no filler, rank of the profile and nearness to the expected
    duration; else the preferred profile, rank, nearness, the longer one. Ties by profile.
    """
    safe = F.greatest(F.lit(0.65), F.least(F.lit(8.0), F.greatest(F.col("words") / 5.0, F.col("chars") / 48.0)))
    c = cands.withColumn("__safe", F.col("duration_s") >= safe).withColumn("__off", F.abs(F.col("duration_s") - F.greatest(safe, F.col("words") / 3.2, F.col("chars") / 34.0)))
    whole = Window.partitionBy(*by)
    c = c.withColumn("__any", F.max("__safe").over(whole)).where("__safe or not __any").withColumn("__scored", F.max(F.col("similarity").isNotNull()).over(whole))
    c = c.where("similarity is not null or not __scored")
    scored = lambda x: F.when(F.col("__scored"), x)
    order = [
        F.desc(scored(F.col("similarity"))), F.desc(scored(F.col("coverage"))), F.asc(scored(F.col("filler").cast("int"))), F.desc(F.when(~F.col("__scored"), F.col("preferred").cast("int"))),
        F.desc("rank"), F.asc("__off"), F.desc(F.when(~F.col("__scored"), F.col("duration_s"))), F.asc("profile"),
    ]
    return pick_best(c, by, order).drop("__safe", "__off", "__any", "__scored")


def rescue_short(picked: DataFrame, cands: DataFrame, by: Sequence[str]) -> DataFrame:
    """``picked`` where it is long enough for its text, else the candidate nearest the expected duration of those that are, the longer of equally near ones.

    Candidates with an ``error`` don't count. ``replaced`` is the profile that gave way, null where none did.
    """
    safe = F.greatest(F.lit(0.65), F.least(F.lit(8.0), F.greatest(F.col("words") / 5.0, F.col("chars") / 48.0)))
    off = F.abs(F.col("duration_s") - F.greatest(safe, F.col("words") / 3.2, F.col("chars") / 34.0))
    sound = cands.where("error is null") if "error" in cands.columns else cands
    best = pick_best(sound.where(F.col("duration_s") >= safe), by, [off.asc(), F.desc("duration_s"), F.asc("profile")]).select(*by, F.struct(*cands.columns).alias("__b"))
    joined = picked.withColumn("__short", F.col("duration_s") < safe).join(best, list(by), "left")
    swap = F.col("__short") & F.col("__b").isNotNull()
    return joined.select(*by, *[F.when(swap, F.col(f"__b.{c}")).otherwise(F.col(c)).alias(c) for c in cands.columns if c not in by], F.when(swap, F.col("profile")).alias("replaced"))


def rank_references(refs: DataFrame, by: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """Of the ``k`` references (by, n_chars, hard_words, ok, coverage, extra) that look best by their text, the best by (ok, coverage - 0.25 extra)."""
    penalty = 4 * F.col("hard_words") + F.floor(F.abs(F.col("n_chars") - 75) / 20)
    few = take_first(refs.withColumn("penalty", penalty), by, [F.col("penalty"), *order], k)
    few = few.withColumn("score", F.col("coverage") - 0.25 * F.col("extra"))
    return pick_best(few, by, [F.desc(F.col("ok").cast("int")), F.desc("score"), *order])


def latest(df: DataFrame, by: str, at: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(by).agg(F.max_by(value, F.struct(*at)).alias(value))


def first_usable(results: DataFrame, by: str) -> DataFrame:
    """Of results (by, provider, priority, usable), the usable one of least priority and the skipped ones before it."""
    best = results.where("usable").groupBy(by).agg(F.min(F.struct("priority", "provider")).alias("b"))
    out = results.join(best, by, "left")
    skipped = F.sort_array(F.collect_list(F.when(~F.col("usable") & (F.col("b").isNull() | (F.col("priority") < F.col("b.priority"))), F.col("provider"))))
    return out.groupBy(by).agg(F.first("b.provider").alias("provider"), F.array_join(skipped, ",").alias("skipped"))


# Reasons with which no clip is taken for want of a better one.
HARD_REASONS = r"(?i)filler|artifact|extra.prefix|first.token|voiced.head"


def best_attempt(attempts: DataFrame, by: str = "job", accept: float = 0.001, best_effort: bool = True, coverage_min: float | None = None) -> DataFrame:
    """Attempts (by, attempt, ok, score, reason, coverage): the first good enough one (``early``), else the best that is ok, else the best of all.

    The last only with ``best_effort``, or where ``coverage_min`` is given and reached and the reason is not a hard one; else ``failed``.
    """
    w = Window.partitionBy(by)
    early = F.min(F.when(F.col("ok") & (F.col("score") <= accept), F.col("attempt"))).over(w)
    a = attempts.withColumn("early", early).where("early is null or attempt <= early")
    order = [F.when(F.col("attempt") == F.col("early"), 0).otherwise(1), F.when(F.col("ok"), 0).otherwise(1), F.col("score"), F.col("attempt")]
    out = pick_best(a, [by], order)
    near = F.lit(False) if coverage_min is None else (F.coalesce("coverage", F.lit(0.0)) >= coverage_min) & ~F.coalesce("reason", F.lit("")).rlike(HARD_REASONS)
    rest = F.when(F.lit(best_effort) | near, "best_effort").otherwise("failed")
    return out.withColumn("verdict", F.when(F.col("attempt") == F.col("early"), "early").when(F.col("ok"), "ok").otherwise(rest)).drop("early")


def lcs_coverage(expected: Column, actual: Column) -> Column:
    """Length of the longest common subsequence over the expected tokens; for short arrays (the state is one row of the table)."""
    zero = F.transform(actual, lambda _: F.lit(0))

    def line(row: Column, e: Column) -> Column:
        cells = F.arrays_zip(actual.alias("t"), row.alias("up"))
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("left"), F.lit(0).alias("corner"))

        def cell(acc: Column, c: Column) -> Column:
            value = F.when(c["t"] == e, acc["corner"] + 1).otherwise(F.greatest(acc["left"], c["up"]))
            return F.struct(F.array_append(acc["out"], value).alias("out"), value.alias("left"), c["up"].alias("corner"))

        return F.aggregate(cells, start, cell, lambda acc: acc["out"])

    best = F.aggregate(expected, zero, line, lambda row: F.coalesce(F.element_at(F.filter(F.array(F.array_max(row)), lambda x: x.isNotNull()), 1), F.lit(0)))
    return F.when(F.size(expected) > 0, best / F.size(expected)).otherwise(0.0)


def lcs_length(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence; a column of the table is one whole number's bits, so long texts are cheap."""
    where: dict[str, int] = {}
    for k, token in enumerate(left):
        where[token] = where.get(token, 0) | 1 << k
    open_, whole = (1 << len(left)) - 1, (1 << len(left)) - 1
    for token in right:
        hit = open_ & where.get(token, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & whole
    return len(left) - open_.bit_count()


def match_tokens(expected: Column, actual: Column) -> Column:
    """struct(coverage, extra_prefix, first_token, ok) of token arrays of any length, which are columns of the frame.

    ``coverage`` is the longest common subsequence over the expected tokens, ``extra_prefix`` the
    number of actual tokens before the first that is among the first three expected.
    """

    @F.pandas_udf("struct<coverage:double,extra_prefix:int,first_token:boolean,ok:boolean>")
    def run(e: pd.Series, a: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(e, a, strict=True):
            x, y = list(x) if x is not None else [], list(y) if y is not None else []
            near = set(x[:3])
            prefix = next((k for k, token in enumerate(y) if token in near), len(y))
            coverage = lcs_length(x, y) / max(1, len(x))
            rows.append((coverage, prefix, bool(x and y and x[0] == y[0]), coverage >= 0.92 and prefix <= 1))
        return pd.DataFrame(rows, columns=["coverage", "extra_prefix", "first_token", "ok"])

    return run(expected, actual)


def unexplained_activity(activity: DataFrame, words: DataFrame, points: DataFrame, pad_ms: int = 40, least_ms: int = 75, rms: float = 0.006, peak: float = 0.08, tasks: int | None = None) -> DataFrame:
    """What of the activity no padded word explains, if it lasts ``least_ms`` and its frames ``points(media_id, at_ms, rms, peak)`` are loud enough."""
    from cuespark.operators.joins import points_in
    from cuespark.operators.sequence import merge_intervals, subtract_intervals

    padded = words.select("media_id", (F.col("start_ms") - pad_ms).alias("start_ms"), (F.col("end_ms") + pad_ms).alias("end_ms"))
    rest = subtract_intervals(merge_intervals(activity).select("media_id", "start_ms", "end_ms"), padded, tasks=tasks).where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    rest = rest.select("media_id", F.col("start_ms").alias("a_id"), F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    level = points_in(rest, points, -1, tasks=tasks).groupBy("media_id", "a_start", "a_end").agg(F.max("rms").alias("rms"), F.max("peak").alias("peak"))
    return level.where((F.col("rms") >= rms) | (F.col("peak") >= peak)).select("media_id", F.col("a_start").alias("start_ms"), F.col("a_end").alias("end_ms"), "rms", "peak")


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, in the JVM."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n > 0, 1 - F.levenshtein(a, b) / n).otherwise(1.0)


def matching_ratio(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp similarity of lower-case texts, by Arrow batches; null counts as empty."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p.lower(), q.lower()).ratio() for p, q in zip(x.fillna(""), y.fillna(""), strict=True)])

    return ratio(a, b)


def safe_rewrite(old: Column, new: Column, markers: Sequence[str] = ()) -> Column:
    """Why a rewritten text is refused, null if it isn't."""
    from cuespark.functions.text import first_reason, has_marker

    n, m = F.length(old), F.length(new)
    return first_reason(
        ("empty", (new.isNull()) | (F.trim(new) == "")), ("multiline", new.contains("\n")),
        ("too_long", m > F.greatest(n + 28, F.floor(n * 1.75) + 8)), ("too_different", (F.least(n, m) >= 8) & (similarity_ratio(old, new) < 0.42)),
        ("marker", has_marker(new, markers) & ~has_marker(old, markers) if markers else F.lit(False)),
    )


def retry_state(attempts: DataFrame, order: Sequence[str] = ("ts_ms", "event_id"), most: int = 4) -> DataFrame:
    """The ladder's step after each job's failures: 1 punctuation, 2 speed, 3 alone, then degraded.

    Where the last failure is of the ``tail``, the clip is padded and done alone until it has failed ``most`` times.
    """
    n = attempts.groupBy("job").agg(count_if(F.col("failed")).alias("failures"), F.max_by(F.when(F.col("failed"), F.col("tail")), F.when(F.col("failed"), F.struct(*order))).alias("tail"))
    on_tail = F.coalesce("tail", F.lit(False))
    n = n.withColumn("on_tail", on_tail).drop("tail")
    return n.withColumn("step", F.when(F.col("failures") == 0, "done").when(F.col("on_tail"), F.when(F.col("failures") < most, "pad_tail_alone").otherwise("degraded")).when(F.col("failures") == 1, "punctuation").when(F.col("failures") == 2, "speed").when(F.col("failures") == 3, "alone").otherwise("degraded"))


def retry_schedule(attempts: DataFrame, give_up: int = 14) -> DataFrame:
    """Failures with their number n within job and class, and the seconds until the next try."""
    from cuespark.functions.text import classify_failure

    kind = classify_failure(F.col("status"), F.col("message"))
    f = attempts.withColumn("class", kind).where("class is not null")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("job", "class").orderBy("ts_ms", "event_id")))
    c, n = F.col("class"), F.col("n")
    delay = F.when(c == "rate_limit", F.least(90 + 45 * n, F.lit(900))).when(c == "blocked", 180 + 45 * n).when(c == "server", F.least(45 + 20 * n, F.lit(360))).otherwise(F.least(10 + 5 * n, F.lit(90)))
    return f.withColumn("delay_s", F.when(n > give_up, None).otherwise(delay).cast("long"))


def worker_state(attempts: DataFrame, cooling_ms: int = 1_800_000, auth: Column | None = None, alarm: int = 20) -> DataFrame:
    """Before each attempt: is the worker cooling after a failed log-in (``auth``)? After it: its balance of recent errors, never below 0, and whether that calls for an alarm."""
    auth = auth if auth is not None else F.col("status").isin(401, 403)
    w = Window.partitionBy("job").orderBy("ts_ms", "event_id")
    last = F.max(F.when(auth, F.col("ts_ms"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    move = F.when(F.col("failed"), 1).otherwise(-1)
    a = attempts.withColumn("cooling", F.coalesce(F.col("ts_ms") - last < cooling_ms, F.lit(False))).withColumn("sum", F.sum(move).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.least(F.lit(0), F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("errors", (F.col("sum") - floor).cast("long")).drop("sum")
    return a.withColumn("alarm", F.col("failed") & (F.col("errors") > 0) & (F.col("errors") % alarm == 0))


def progress_status(lines: DataFrame) -> DataFrame:
    """The last ``PROGRESS:percent:message`` of each job, the percentage within 0 and 100.

    Where lines have ``from_pct`` and ``to_pct``, the share of the whole that their stage takes, the percentage is of that.
    """
    p = r"^PROGRESS:(-?[0-9.]+):(.*)$"
    pct = F.coalesce(F.expr("try_cast(regexp_extract(line, '^PROGRESS:(-?[0-9.]+):', 1) as double)"), F.lit(0.0))
    if "from_pct" in lines.columns:
        pct = F.col("from_pct") + (F.col("to_pct") - F.col("from_pct")) * pct / 100
    x = lines.where(F.col("line").rlike(p)).select("job", "ts_ms", "event_id", F.least(F.greatest(pct, F.lit(0.0)), F.lit(100.0)).alias("pct"), F.regexp_extract("line", p, 2).alias("message"))
    return x.groupBy("job").agg(F.max_by(F.struct("pct", "message"), F.struct("ts_ms", "event_id")).alias("s")).select("job", "s.*")


def union_sources(frames: Sequence[tuple[str, DataFrame]], order: Sequence[str]) -> DataFrame:
    """All rows with their source's name, numbered within the media in the order given."""
    out = None
    for name, df in frames:
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumn("cue_no", F.row_number().over(Window.partitionBy("media_id").orderBy(*order)).cast("long"))


def missing_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("extra")))
