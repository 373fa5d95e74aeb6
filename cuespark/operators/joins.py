"""Joins by time and by key.

Time joins meet in buckets of time: an interval stands in each bucket that it touches, and a
pair counts in the first bucket that both share. A media with very many rows thus spreads over
its buckets, and no join compares all rows of a media. Rows of numbers take few bytes in a shuffle
and many in a task, so a caller who knows its rows names the ``tasks`` of a join.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "media_id"


def _bucketed(df: DataFrame, start: Column, end: Column, width: int, name: str) -> DataFrame:
    lo, hi = F.floor(start / width), F.floor(F.greatest(end, start) / width)
    return df.withColumn(f"{name}_lo", lo).withColumn("__bucket", F.explode(F.sequence(lo, hi)))


def dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """``df`` in ``tasks`` partitions by key, or in the session's number, below which a join deals again; as it is where no number is named."""
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), *by) if tasks else df


def overlap_join(a: DataFrame, b: DataFrame, pad_ms: int = 0, bucket_ms: int = 60_000, by: Sequence[str] = (KEY,), tasks: int | None = None) -> DataFrame:
    """Pairs of ``a`` (a_id, a_start, a_end) and ``b`` (b_id, b_start, b_end) of equal ``by`` that overlap within the pad."""
    x = _bucketed(a, F.col("a_start") - pad_ms, F.col("a_end") + pad_ms, bucket_ms, "a")
    y = _bucketed(b, F.col("b_start"), F.col("b_end"), bucket_ms, "b")
    x, y = (dealt(df, tasks, *by, "__bucket") for df in (x, y))
    met = x.join(y, [*by, "__bucket"]).where((F.col("a_start") - pad_ms < F.col("b_end")) & (F.col("b_start") < F.col("a_end") + pad_ms))
    met = met.where(F.col("__bucket") == F.greatest("a_lo", "b_lo")).drop("__bucket", "a_lo", "b_lo")
    return met.withColumn("overlap_ms", F.greatest(F.lit(0), F.least("a_end", "b_end") - F.greatest("a_start", "b_start")))


def overlap_ratio() -> Column:
    """Overlap as a share of the shorter interval."""
    return F.col("overlap_ms") / F.greatest(F.lit(1), F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")))


def near_duplicate(a: DataFrame, b: DataFrame, pad_ms: int = 2600) -> DataFrame:
    """Pairs near in time with equal compact texts (a_key, b_key), or one in the other if long enough."""
    met = overlap_join(a, b, pad_ms)
    n, m = F.length("a_key"), F.length("b_key")
    inside = (F.least(n, m) >= 5) & (F.least(n, m) >= 0.55 * F.greatest(n, m)) & (F.expr("contains(a_key, b_key)") | F.expr("contains(b_key, a_key)"))
    return met.where((F.col("a_key") == F.col("b_key")) | inside)


def assign_labels(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """The label of the turns that overlap a segment most; without any overlap, of the turn around its middle; ties by label.

    One join serves both: a segment meets turns over its span and its middle, and each label sums
    what it has of either.
    """
    middle = F.floor((F.col("a_start") + F.col("a_end")) / 2)
    wide = segments.select(
        KEY, "a_id", F.least("a_start", middle).alias("a_start"), F.greatest(F.col("a_end"), middle + 1).alias("a_end"), F.col("a_start").alias("__s"), F.col("a_end").alias("__e"), middle.alias("__m")
    )
    met = overlap_join(wide, turns.withColumnRenamed("label", "b_label"))
    shared = lambda lo, hi: F.greatest(F.lit(0), F.least(hi, F.col("b_end")) - F.greatest(lo, F.col("b_start")))
    sums = met.groupBy(KEY, "a_id", "b_label").agg(F.sum(shared(F.col("__s"), F.col("__e"))).alias("ms"), F.sum(shared(F.col("__m"), F.col("__m") + 1)).alias("mid"))
    best = sums.where("ms > 0 or mid > 0").groupBy(KEY, "a_id").agg(F.min(F.struct(-F.col("ms"), -F.col("mid"), "b_label"))["b_label"].alias("label"))
    return segments.join(best, [KEY, "a_id"], "left")


def speaker_name(label: Column) -> Column:
    """``X_n`` as ``Speaker n + 1``; other labels as they are."""
    n = F.regexp_extract(label, r"_(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("Speaker "), (n.cast("long") + 1).cast("string"))).otherwise(label)


def points_in(segments: DataFrame, points: DataFrame, margin_ms: int = 0, bucket_ms: int = 60_000, tasks: int | None = None) -> DataFrame:
    """Points (media_id, at_ms) strictly inside segments (media_id, a_id, a_start, a_end) by the margin."""
    x = _bucketed(segments, F.col("a_start"), F.col("a_end"), bucket_ms, "a").drop("a_lo")
    y = points.withColumn("__bucket", F.floor(F.col("at_ms") / bucket_ms))
    x, y = (dealt(df, tasks, KEY, "__bucket") for df in (x, y))
    return x.join(y, [KEY, "__bucket"]).where((F.col("at_ms") > F.col("a_start") + margin_ms) & (F.col("at_ms") < F.col("a_end") - margin_ms)).drop("__bucket")


def cache_lookup(rows: DataFrame, cache: DataFrame, min_size: int = 1024, version: Column | None = None, least_ms: int = 50) -> DataFrame:
    """``rows`` with ``hit`` and ``tier``, the first tier that holds the fingerprint validly.

    An entry (fingerprint, tier, size, version, duration_ms, failed) is valid if its artefact is
    large and long enough, it didn't fail its checks, and its version is the row's (where given).
    """
    good = cache.where((F.col("size") > min_size) & (F.col("duration_ms") > least_ms) & ~F.col("failed"))
    keys = ["fingerprint"] + (["version"] if version is not None else [])
    known = good.groupBy(*keys).agg(F.min("tier").alias("tier"))
    asked = rows.withColumn("version", version) if version is not None else rows
    return asked.join(known, keys, "left").withColumn("hit", F.col("tier").isNotNull())


def refresh_used(cache: DataFrame, looked_up: DataFrame, now: Column) -> DataFrame:
    """``cache`` with ``last_used`` set to ``now`` where a look-up hit the entry's fingerprint and tier."""
    used = looked_up.where("hit").select("fingerprint", "tier").distinct().withColumn("used", F.lit(True))
    return cache.join(used, ["fingerprint", "tier"], "left").withColumn("last_used", F.when(F.col("used"), now).otherwise(F.col("last_used"))).drop("used")


def pending(all_rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return all_rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def keep_only(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def apply_corrections(rows: DataFrame, corrections: DataFrame, accept: Column, order: str = "seq") -> DataFrame:
    """``corrections(media_id, cue_no, seq, fixed)``: the last of each cue is taken where ``accept`` (over text, fixed) holds."""
    last = corrections.groupBy(KEY, "cue_no").agg(F.max_by("fixed", order).alias("fixed"))
    out = rows.join(last, [KEY, "cue_no"], "left")
    ok = F.coalesce(accept, F.lit(False)) & (F.col("fixed") != F.col("text"))
    return out.withColumn("changed", ok).withColumn("text", F.when(ok, F.col("fixed")).otherwise(F.col("text"))).drop("fixed")


def zip_by_order(a: DataFrame, b: DataFrame, key: str, a_order: Sequence[str], b_order: Sequence[str]) -> DataFrame:
    """The n-th of ``a`` with the n-th of ``b`` in each key; surplus of ``b`` is ignored, rows of ``a`` without one stay with nulls."""
    x = a.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*a_order)))
    y = b.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*b_order)))
    return x.join(y, [key, "n"], "left")


def refresh_manifest(items: DataFrame, resolved: DataFrame, unresolved: Column) -> DataFrame:
    """Urls replaced by id where resolved; of the others, those that are ``unresolved`` go."""
    out = items.join(resolved.select("item_id", F.col("url").alias("new_url")), "item_id", "left")
    return out.where(F.col("new_url").isNotNull() | ~unresolved).withColumn("url", F.coalesce("new_url", "url")).drop("new_url")


def merge_prefer(flat: DataFrame, rich: DataFrame, values: Sequence[str]) -> DataFrame:
    """Full join on ``url``: flat rows first in their order, rich values preferred, then the remaining rich rows."""
    f = flat.select("url", F.col("pos").alias("fp"), *[F.col(v).alias(f"f_{v}") for v in values])
    r = rich.select("url", F.col("pos").alias("rp"), *[F.col(v).alias(f"r_{v}") for v in values])
    both = f.join(r, "url", "full")
    return both.select("url", F.col("fp").isNull().cast("int").alias("side"), F.coalesce("fp", "rp").alias("pos"), *[F.coalesce(f"r_{v}", f"f_{v}").alias(v) for v in values])


def reconcile(final: DataFrame, sources: DataFrame, min_ratio: float = 0.55, unlike: float = 0.38, least_chars: int = 8, fit: Column | None = None, similarity=None) -> DataFrame:
    """Source cues (media_id, source, trusted, a_id, a_start, a_end, a_key) classed against the final track.

    ``covered`` by an overlap of ``min_ratio``, or ``suspicious`` where all that covers it reads
    otherwise; ``near_duplicate`` of a cue near in time; ``candidate`` for insertion; ``report_only``
    where the source isn't trusted or the cue isn't ``fit`` (its text, its length).
    """
    from cuespark.operators.stats import similarity_ratio

    alike = (similarity or similarity_ratio)(F.col("a_key"), F.col("b_key"))
    met = overlap_join(sources, final, by=(KEY,)).where(overlap_ratio() >= min_ratio).groupBy(KEY, "source", "a_id").agg(F.max(alike).alias("best"))
    near = near_duplicate(sources, final).select(KEY, "source", "a_id").distinct().withColumn("near", F.lit(True))
    out = sources.join(met, [KEY, "source", "a_id"], "left").join(near, [KEY, "source", "a_id"], "left")
    span = F.col("a_end") - F.col("a_start")
    fit = fit if fit is not None else (F.length("a_key") >= 2) & span.between(200, 12_000)
    kind = (
        F.when((F.col("best") < unlike) & (F.length("a_key") >= least_chars), "suspicious").when(F.col("best").isNotNull(), "covered")
        .when(F.col("near"), "near_duplicate").when(F.col("trusted") & fit, "candidate").otherwise("report_only")
    )
    return out.select(*sources.columns, kind.alias("class"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where none is set and the master is local (tests)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cuespark-"))
    return context.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def insert_candidates(final: DataFrame, sources: DataFrame, order: Sequence[str], **rules) -> tuple[DataFrame, DataFrame]:
    """(final, events): the final track with the candidates of the sources named in ``order``, one source after the other.

    Each source is classed against the track with what came before; of candidates of one source
    that are near duplicates of each other only the first stays. Events are the source cues with
    their class, ``inserted`` for those that were.
    """
    track, events = final.select(KEY, "b_id", "b_start", "b_end", "b_key").withColumn("source", F.lit(None).cast("string")), None
    for name in order:
        judged = reconcile(track.drop("source"), sources.where(F.col("source") == name), **rules)
        new = judged.where("class = 'candidate'")
        as_b = new.select(KEY, F.col("a_id").alias("b_id"), F.col("a_start").alias("b_start"), F.col("a_end").alias("b_end"), F.col("a_key").alias("b_key"))
        later = near_duplicate(new, as_b).where("b_start < a_start or (b_start = a_start and b_id < a_id)").select(KEY, "a_id").distinct()
        inserted = new.join(later, [KEY, "a_id"], "left_anti").select(KEY, "a_id").withColumn("in", F.lit(True))
        judged = judged.join(inserted, [KEY, "a_id"], "left").withColumn("class", F.when(F.col("in"), "inserted").when(F.col("class") == "candidate", "near_duplicate").otherwise(F.col("class"))).drop("in")
        judged = _cut(judged)  # else each source's plan holds that of the one before several times
        events = judged if events is None else events.unionByName(judged)
        kept = judged.where("class = 'inserted'")
        track = track.unionByName(kept.select(KEY, F.col("a_id").alias("b_id"), F.col("a_start").alias("b_start"), F.col("a_end").alias("b_end"), F.col("a_key").alias("b_key"), "source"))
    return track, events


def lost_insertions(events: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Inserted cues of which the cleaned track has no near duplicate any more."""
    inserted, cleaned = events.where("class = 'inserted'"), cleaned.select(KEY, "b_id", "b_start", "b_end", "b_key")
    return inserted.join(near_duplicate(inserted, cleaned).select(KEY, "source", "a_id").distinct(), [KEY, "source", "a_id"], "left_anti")
