"""Ordered operators within a key: windows first, ordered folds where the state needs them.

Rows are cues (media_id, cue_no, start_ms, end_ms, text, ...). Order is start_ms, then cue_no.
Nothing is ordered across keys. Folds run over islands, rows between which a window has found
that no group can reach; only a media without such a place is one row of its fold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER = "media_id", ("start_ms", "cue_no")


def _w(key: str = KEY, order: Sequence[str] = ORDER):
    return Window.partitionBy(key).orderBy(*order)


def _before(key: str = KEY, order: Sequence[str] = ORDER):
    return _w(key, order).rowsBetween(Window.unboundedPreceding, -1)


def clamp_overlaps(cues: DataFrame) -> DataFrame:
    """Starts moved to the end of what came before; cues without time left go; ``cue_no`` from 1."""
    last = F.max("end_ms").over(_before())
    out = cues.withColumn("new_start", F.greatest("start_ms", F.coalesce(last, F.col("start_ms")))).where("end_ms > new_start")
    number = F.row_number().over(_w(order=("new_start", "cue_no"))).cast("long")
    return out.withColumn("cue_no", number).withColumn("start_ms", F.col("new_start")).drop("new_start")


def fit_timeline(slots: DataFrame, tight: float = 1.08, loose: float = 1.20, gap_ms: int = 200) -> DataFrame:
    """``verdict`` of audio against its slot: fit, borrow (from the gap to the next), retry or degraded."""
    nxt = F.lead("start_ms").over(_w(order=("cue_no",)))
    ratio = F.col("audio_ms") / F.col("duration_ms")
    gap = nxt - F.col("end_ms")
    verdict = (
        F.when(F.col("audio_ms").isNull() | (F.col("audio_ms") <= 0), "degraded").when(ratio <= tight, "fit")
        .when((ratio <= loose) & (F.coalesce(gap, F.lit(gap_ms)) >= gap_ms), "borrow").otherwise("retry")
    )
    return slots.withColumn("verdict", verdict).withColumn("pad_ms", F.when(ratio < 1, F.col("duration_ms") - F.col("audio_ms")).otherwise(0))


def overlap_next(slots: DataFrame) -> DataFrame:
    nxt = F.lead("start_ms").over(_w(order=("cue_no",)))
    return slots.withColumn("overlap_ms", F.coalesce(F.greatest(F.lit(0), F.col("start_ms") + F.col("audio_ms") - nxt), F.lit(0)).cast("long"))


def fill_gaps(cues: DataFrame, min_gap_ms: int = 20) -> DataFrame:
    """Rows (media_id, kind, start_ms, end_ms): the cues and a filler for every gap to the running end."""
    held = cues.withColumn("last", F.coalesce(F.max("end_ms").over(_before()), F.lit(0)))
    gaps = held.where(F.col("start_ms") - F.col("last") > min_gap_ms).select(KEY, F.lit("silence").alias("kind"), F.col("last").alias("start_ms"), F.col("start_ms").alias("end_ms"))
    return cues.select(KEY, F.lit("cue").alias("kind"), "start_ms", "end_ms").unionByName(gaps)


def merge_intervals(intervals: DataFrame, tolerance_ms: int = 0, by: Sequence[str] = (KEY,)) -> DataFrame:
    """Islands of intervals that touch within the tolerance, with the number of members."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    last = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(last.isNull() | (F.col("start_ms") > last + tolerance_ms), 1).otherwise(0)
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = intervals.withColumn("new", new).withColumn("island", island)
    return marked.groupBy(*by, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("members"))


def subtract_intervals(base: DataFrame, allowed: DataFrame, bucket_ms: int = 3_600_000, tasks: int | None = None) -> DataFrame:
    """What of ``base`` (media_id, start_ms, end_ms, disjoint) no interval of ``allowed`` covers.

    Both meet in buckets of time, so a media's intervals are never all held against each other. An
    interval's cuts and, after them, the interval itself are laid in one order: a cut ends the piece
    before it, the interval ends the last one. ``tasks`` deals the join and that order.
    """
    from cuespark.operators.joins import dealt, overlap_join

    asked = base.select(KEY, F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    cuts = merge_intervals(allowed).select(KEY, F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    met = overlap_join(asked, cuts, bucket_ms=bucket_ms, tasks=tasks).select(KEY, F.col("a_start").alias("start_ms"), F.col("a_end").alias("end_ms"), F.col("b_start").alias("a"), F.col("b_end").alias("b"), F.lit(False).alias("last"))
    none = F.lit(None).cast("long")
    laid = met.unionByName(base.select(KEY, "start_ms", "end_ms", none.alias("a"), none.alias("b"), F.lit(True).alias("last")))
    w = Window.partitionBy(KEY, "start_ms", "end_ms").orderBy("last", "a")
    laid = dealt(laid, tasks, KEY, "start_ms", "end_ms").withColumn("done", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("again", F.coalesce(F.lag("last").over(w), F.lit(False)))
    low, high = F.coalesce("done", "start_ms"), F.when(F.col("last"), F.col("end_ms")).otherwise(F.least("a", "end_ms"))
    whole, piece = F.col("last") & F.col("done").isNull(), ~F.col("again") & (high > low)
    return laid.where(whole | piece).select(KEY, low.alias("start_ms"), high.alias("end_ms"))


def islands_between(silences: DataFrame, low_ms: int, high_ms: int, side_ms: int = 0, edge_ms: int | None = None) -> DataFrame:
    """Sounds between neighbouring silences with a length in [low, high], both silences at least ``side_ms``.

    With ``edge_ms`` they also stand farther than that from the ends of the media's silences.
    """
    w = _w(order=("start_ms", "end_ms"))
    out = silences.withColumn("next_start", F.lead("start_ms").over(w)).withColumn("next_end", F.lead("end_ms").over(w))
    if edge_ms is not None:
        whole = Window.partitionBy(KEY)
        lo, hi = F.min("start_ms").over(whole), F.max("end_ms").over(whole)
        out = out.withColumn("lo", lo).withColumn("hi", hi).where((F.col("end_ms") - F.col("lo") > edge_ms) & (F.col("hi") - F.col("next_start") > edge_ms))
    length = F.col("next_start") - F.col("end_ms")
    out = out.where(length.between(low_ms, high_ms) & (F.col("end_ms") - F.col("start_ms") >= side_ms) & (F.col("next_end") - F.col("next_start") >= side_ms))
    return out.select(KEY, F.col("end_ms").alias("start_ms"), F.col("next_start").alias("end_ms"))


def cap_silences(silences: DataFrame, max_ms: int, slack_ms: int = 50, edge_ms: int = 200) -> DataFrame:
    """Cuts [start + max, end] of silences longer than the cap and its slack, but for those within ``edge_ms`` of the media's ends.

    The ends are columns ``media_start`` and ``media_end`` where there are any, else the first and the last silence's.
    """
    whole = Window.partitionBy(KEY)
    if "media_start" not in silences.columns:
        silences = silences.withColumn("media_start", F.min("start_ms").over(whole)).withColumn("media_end", F.max("end_ms").over(whole))
    inner = (F.col("start_ms") - F.col("media_start") > edge_ms) & (F.col("media_end") - F.col("end_ms") > edge_ms)
    long = silences.where((F.col("end_ms") - F.col("start_ms") > max_ms + slack_ms) & inner)
    return long.select(KEY, (F.col("start_ms") + max_ms).alias("start_ms"), "end_ms")


def edge_trim_plan(words: DataFrame, clips: DataFrame, pad_ms: int = 80, least_cut_ms: int = 30, most_cut_ms: int = 1500, least_ms: int = 350) -> DataFrame:
    """(media_id, from_ms, to_ms, trimmed) of clips (media_id, duration_ms, expected array) by their words (media_id, cue_no, start_ms, end_ms, text).

    The head is the first word equal to expected[0], else the first one among expected[0:3], else
    the first word; the tail is the last word equal to the last expected one, else the last word.
    No more than ``most_cut_ms`` goes at an end; a plan that cuts at most ``least_cut_ms`` or leaves
    at most ``least_ms`` is none.
    """
    w = words.join(clips.select(KEY, "expected"), KEY)
    first, near, last = F.col("text") == F.get("expected", F.lit(0)), F.array_contains(F.slice("expected", 1, 3), F.col("text")), F.col("text") == F.element_at("expected", -1)
    at = lambda c, how, when=None: how(F.when(when, F.col(c)) if when is not None else F.col(c))
    ends = w.groupBy(KEY).agg(
        F.coalesce(at("start_ms", F.min, first), at("start_ms", F.min, near), at("start_ms", F.min)).alias("lo"),
        F.coalesce(at("end_ms", F.max, last), at("end_ms", F.max)).alias("hi"),
    )
    out = clips.join(ends, KEY).withColumn("from_ms", F.greatest(F.least(F.col("lo") - pad_ms, F.lit(most_cut_ms)), F.lit(0)))
    out = out.withColumn("to_ms", F.least(F.greatest(F.col("hi") + pad_ms, F.col("duration_ms") - most_cut_ms), F.col("duration_ms")))
    kept = F.col("to_ms") - F.col("from_ms")
    trimmed = (F.col("duration_ms") - kept > least_cut_ms) & (kept > least_ms)
    return out.select(KEY, F.when(trimmed, F.col("from_ms")).otherwise(0).alias("from_ms"), F.when(trimmed, F.col("to_ms")).otherwise(F.col("duration_ms")).alias("to_ms"), trimmed.alias("trimmed"))


def silence_trim_plan(silences: DataFrame, clips: DataFrame, head_pad_ms: int = 35, tail_pad_ms: int = 75, final_pad_ms: int = 120, least_ms: int = 350, least_cut_ms: int = 30, at_start_ms: int = 10, at_end_ms: int = 30) -> DataFrame:
    """(media_id, from_ms, to_ms, trimmed) of clips (media_id, duration_ms, is_final) by their silences (media_id, start_ms, end_ms).

    A first silence that begins with the clip gives the start, a last one that ends with it the end,
    each with a pad; a final clip keeps more. No plan leaves ``least_ms`` or less, or is one that cuts ``least_cut_ms`` or less at both ends.
    """
    place = F.struct("start_ms", "end_ms")
    ends = silences.groupBy(KEY).agg(F.min(place).alias("head"), F.max(place).alias("tail"))
    c = clips.join(ends, KEY, "left")
    pad = F.when(F.coalesce("is_final", F.lit(False)), final_pad_ms).otherwise(tail_pad_ms) if "is_final" in clips.columns else F.lit(tail_pad_ms)
    start = F.when(F.col("head.start_ms") <= at_start_ms, F.greatest(F.lit(0), F.col("head.end_ms") - head_pad_ms)).otherwise(0)
    end = F.when(F.col("duration_ms") - F.col("tail.end_ms") <= at_end_ms, F.least(F.col("duration_ms"), F.col("tail.start_ms") + pad)).otherwise(F.col("duration_ms"))
    c = c.withColumn("from_ms", start.cast("long")).withColumn("to_ms", end.cast("long"))
    kept = (F.col("to_ms") > F.col("from_ms") + least_ms) & ~((F.col("from_ms") <= least_cut_ms) & (F.col("duration_ms") - F.col("to_ms") <= least_cut_ms))
    return c.select(KEY, F.when(kept, F.col("from_ms")).otherwise(0).alias("from_ms"), F.when(kept, F.col("to_ms")).otherwise(F.col("duration_ms")).alias("to_ms"), kept.alias("trimmed"))


def toggle_speaker(cues: DataFrame, gap_ms: int = 1200) -> DataFrame:
    """``toggled``: the speaker changes where the gap to the end before is longer than ``gap_ms``."""
    flip = F.when(F.col("start_ms") - F.lag("end_ms").over(_w()) > gap_ms, 1).otherwise(0)
    return cues.withColumn("flip", flip).withColumn("toggled", (F.sum("flip").over(_w().rowsBetween(Window.unboundedPreceding, 0)) % 2).cast("long")).drop("flip")


def ordered_fold(df: DataFrame, key: str, fields: Sequence[str], zero: Column, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> DataFrame:
    """``finish`` of a fold over the key's rows, as structs of ``fields`` in that order of sorting; ``value`` holds it."""
    ordered = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    return ordered.select(key, F.aggregate("rows", zero, merge, finish).alias("value"))


STRONG, CLAUSE = r"[.!?…。！？][\"')\]]*$", r"[,;:，；：][\"')\]]*$"


def group_cues(cues: DataFrame, max_span_ms: int = 8000, max_gap_ms: int = 550) -> DataFrame:
    """Greedy groups: a cue joins while 0 <= gap <= ``max_gap_ms`` and the group spans at most ``max_span_ms``; texts stand side by side."""
    return greedy(
        cues.select(KEY, "start_ms", "cue_no", "end_ms", F.lit(1).cast("long").alias("size"), "text"),
        lambda g, c: (c["start_ms"] - g["end_ms"]).between(0, max_gap_ms) & (c["end_ms"] - g["start_ms"] <= max_span_ms),
        apart=lambda p, c: too_far(p, c, (0, max_gap_ms), max_span_ms),
    )


def pack_blocks(rows: DataFrame, max_rows: int, max_size: int, marker: str = "\n") -> DataFrame:
    """Greedy blocks of rows (media_id, start_ms, cue_no, end_ms, size) of at most so many rows and size; ``text``, where there is any, is joined with the marker."""
    return greedy(
        rows, lambda g, c: (g["members"] < max_rows) & (g["size"] + c["size"] <= max_size), lambda g, c: F.concat(g["text"], F.lit(marker), c["text"]),
        apart=lambda p, c: p["size"] + c["size"] > max_size,
    )


def side_by_side(g: Column, c: Column) -> Column:
    return F.concat(g["text"], F.lit(" "), c["text"])


def too_far(p: Mapping[str, Column], c: Mapping[str, Column], gap: tuple[int, int], span_ms: int) -> Column:
    """Whether no group that ends with ``p`` can take ``c``: its end is at least that of ``p`` and at most ``reach``, its start no later than that of ``p``."""
    return (c["start_ms"] - p["reach"] > gap[1]) | (c["start_ms"] - p["end_ms"] < gap[0]) | (c["end_ms"] - p["start_ms"] > span_ms)


#: Rows of an island that are folded into one array of marks.
FOLDED = 256


def folded_groups(
    rows: DataFrame, fresh: Callable[[Column], Column], joins: Callable[[Column, Column], Column], grown: Callable[[Column, Column], Column], apart: Callable[[Mapping[str, Column], Mapping[str, Column]], Column] | None = None, key: str = KEY, order: Sequence[str] = ORDER
) -> DataFrame:
    """``rows`` with ``group_no`` in ``key``: each row joins the open group or opens the next one.

    ``apart(p, c)`` marks, by a window, rows that can't join whatever stands before: ``p`` has the
    columns of the row before and ``reach``, the furthest end before. Between two such rows is an
    island, and each is folded for itself: ``fresh(c)`` is the group that a row opens, ``joins(g, c)``
    tells whether it joins and ``grown(g, c)`` is the group then. A fold only yields a mark for each
    row, in arrays of FOLDED, so its cost grows with the rows and not with their square.
    """
    names, w = [c for c in rows.columns if c != key], _w(key, order)
    before = {c: F.lag(c).over(w) for c in names} | ({"reach": F.max("end_ms").over(_before(key, order))} if "end_ms" in names else {})
    cut = F.coalesce(apart(before, {c: F.col(c) for c in names}), F.lit(False)) if apart else F.lit(False)
    islands = rows.withColumn("__cut", cut.cast("int")).withColumn("__island", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fields = [*[c for c in order if c in names], *[c for c in names if c not in order]]
    lists = islands.groupBy(key, "__island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("row"))

    def step(acc: Column, c: Column) -> Column:
        g = acc["open"]
        told = lambda opens, group: F.struct(F.array_append(acc["marks"], F.lit(opens)).alias("marks"), group.alias("open"))
        return F.when(g.isNull(), told(True, fresh(c))).when(joins(g, c), told(False, grown(g, c))).otherwise(told(True, fresh(c)))

    none = F.when(F.lit(False), fresh(F.get("row", F.lit(0))))
    empty = F.array().cast("array<boolean>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("row") - 1) / FOLDED).cast("int")), lambda k: F.slice("row", k * FOLDED + 1, F.lit(FOLDED)))

    def stride(acc: Column, part: Column) -> Column:
        folded = F.aggregate(part, F.struct(empty.alias("marks"), acc["open"].alias("open")), step)
        return F.get(F.transform(F.array(folded), lambda x: F.struct(F.array_append(acc["done"], x["marks"]).alias("done"), x["open"].alias("open"))), F.lit(0))

    zero = F.struct(F.array().cast("array<array<boolean>>").alias("done"), none.alias("open"))
    marked = lists.withColumn("opens", F.aggregate(parts, zero, stride, lambda acc: F.flatten(acc["done"])))
    flat = marked.select(key, F.inline(F.arrays_zip("row", "opens"))).select(key, "row.*", "opens")
    number = F.sum(F.col("opens").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return flat.withColumn("group_no", number).drop("opens")


def greedy(rows: DataFrame, joins: Callable[[Column, Column], Column], glue: Callable[[Column, Column], Column] = side_by_side, apart: Callable[[Mapping[str, Column], Mapping[str, Column]], Column] | None = None) -> DataFrame:
    """Groups of rows (media_id, start_ms, cue_no, end_ms, size) in order. ``text`` (by ``glue``) and ``tag`` (the first row's) are kept where the rows have them."""
    extra = [c for c in ("text", "tag") if c in rows.columns]
    more = {"text": glue, "tag": lambda g, _: g["tag"]}
    fresh = lambda c: F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), F.lit(1).cast("long").alias("members"), c["size"].alias("size"), *[c[x].alias(x) for x in extra])
    grown = lambda g, c: F.struct(g["start_ms"].alias("start_ms"), F.greatest(g["end_ms"], c["end_ms"]).alias("end_ms"), (g["members"] + 1).alias("members"), (g["size"] + c["size"]).alias("size"), *[more[x](g, c).alias(x) for x in extra])
    place = F.struct("start_ms", "cue_no")
    found = [
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("members"), F.sum("size").alias("size"),
        F.min_by("cue_no", place).alias("first"), F.max_by("cue_no", place).alias("last"),
    ]
    if "text" in extra:
        pieces = F.array_sort(F.collect_list(F.struct("start_ms", "cue_no", "text")))
        found.append(F.aggregate(pieces, F.lit(None).cast("string"), lambda t, c: F.when(t.isNull(), c["text"]).otherwise(glue({"text": t}, c))).alias("text"))
    if "tag" in extra:
        found.append(F.min_by("tag", place).alias("tag"))
    return folded_groups(rows, fresh, joins, grown, apart).groupBy(KEY, "group_no").agg(*found)


def pair_fragile(cues: DataFrame, fragile: Column, max_gap_ms: int = 650) -> DataFrame:
    """Heads of non-overlapping pairs: ``fragile`` cues joined with the next one within the gap."""
    joins = fragile & (F.lead("start_ms").over(_w()) - F.col("end_ms") <= max_gap_ms)
    marked = cues.withColumn("joins", F.coalesce(joins, F.lit(False)))
    run = F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(_w().rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy(KEY, "run", "joins").orderBy(*ORDER))
    return marked.withColumn("run", run).withColumn("head", F.col("joins") & (place % 2 == 1)).drop("run", "joins")


def fixed_blocks(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("block", F.floor((F.row_number().over(_w(order=("cue_no",))) - 1) / n).cast("long"))


def sample_context(rows: DataFrame, budget: int = 14000, head: int = 100, run: int = 8, parts: int = 14) -> DataFrame:
    """The first rows and short runs spread over the rest, up to the first row that breaks the budget of characters."""
    w = _w(order=("cue_no",))
    r = rows.withColumn("rn", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(KEY)))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / parts))
    r = r.where((F.col("rn") <= head) | ((F.col("total") > 160) & ((F.col("rn") - 1) % step < run)))
    r = r.withColumn("chars", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.where(F.col("chars") <= budget).drop("total", "chars")


def with_neighbors(cues: DataFrame) -> DataFrame:
    w = _w()
    nxt = F.lead("text").over(w)
    return cues.withColumn("same_as_previous", F.coalesce(F.lag("text").over(w) == F.col("text"), F.lit(False))).withColumn(
        "next_word", F.coalesce(F.element_at(F.split(nxt, " "), 1), F.lit(""))
    )


def pick_reference(segments: DataFrame, enough_ms: int = 8000, most_ms: int = 15000, least_ms: int = 5000) -> DataFrame:
    """Slices for a speaker's reference: longest first up to ``enough_ms``, never over ``most_ms``; none below ``least_ms``."""
    w = Window.partitionBy(KEY, "speaker").orderBy(F.desc("duration_ms"), "cue_no")
    total = F.sum("duration_ms").over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = segments.withColumn("rank", F.row_number().over(w)).withColumn("total", total)
    s = s.where((F.col("total") - F.col("duration_ms") < enough_ms) & ((F.col("rank") == 1) | (F.col("total") <= most_ms)))
    s = s.withColumn("picked", F.sum("duration_ms").over(Window.partitionBy(KEY, "speaker")))
    return s.where(F.col("picked") >= least_ms).drop("rank", "total")


def mix_plan(slots: DataFrame, n: int = 80, tail_ms: int = 300) -> DataFrame:
    """(media_id, block, base_ms, length_ms, clips): delays of the clips are start_ms - base_ms."""
    b = fixed_blocks(slots, n).groupBy(KEY, "block")
    return b.agg(F.min("start_ms").alias("base_ms"), (F.max(F.col("start_ms") + F.col("audio_ms")) - F.min("start_ms") + tail_ms).alias("length_ms"), F.count(F.lit(1)).alias("clips"))


def activity_runs(frames: DataFrame, share: float = 0.72, factor: float = 0.45, least: float = 0.006, silence: int = 12, shortest_ms: int = 260, frame_ms: int = 30, pad_ms: int = 120, close_ms: int = 180) -> DataFrame:
    """Runs of frames (media_id, frame_no, rms) over a threshold from the media's own percentile.

    Gaps below ``silence`` frames close; what lasts at least ``shortest_ms`` is padded, and runs
    nearer than ``close_ms`` are one. Frame k covers [k, k + 1) times ``frame_ms``.
    """
    cut = frames.groupBy(KEY).agg(F.greatest(F.lit(least), F.percentile("rms", share) * factor).alias("cut"))
    voiced = frames.join(cut, KEY).where("rms >= cut").select(KEY, F.col("frame_no").alias("start_ms"), (F.col("frame_no") + 1).alias("end_ms"))
    runs = merge_intervals(voiced, silence - 1).where((F.col("end_ms") - F.col("start_ms")) * frame_ms >= shortest_ms)
    padded = runs.select(KEY, F.greatest(F.lit(0), F.col("start_ms") * frame_ms - pad_ms).alias("start_ms"), (F.col("end_ms") * frame_ms + pad_ms).alias("end_ms"))
    return merge_intervals(padded, close_ms - 1).select(KEY, "start_ms", "end_ms", F.col("members").alias("runs"))


def choose_separators(silences: DataFrame, n: Column) -> DataFrame:
    """The ``n`` longest silences of each media in time order: those inside first, the first and the last only where these are too few."""
    whole = Window.partitionBy(KEY)
    s = silences.withColumn("inner", (F.col("start_ms") > F.min("start_ms").over(whole)) & (F.col("end_ms") < F.max("end_ms").over(whole)))
    rank = F.row_number().over(whole.orderBy(F.desc("inner"), F.desc(F.col("end_ms") - F.col("start_ms")), "start_ms", "end_ms"))
    kept = s.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank", "inner")
    return kept.withColumn("separator_no", F.row_number().over(whole.orderBy("start_ms", "end_ms")).cast("long"))


def separators_by_share(cues: DataFrame, spans: DataFrame) -> DataFrame:
    """(media_id, cue_no, at_ms): where no silence serves, a cue ends at its cumulative share of characters of the media's span; the last cue has none."""
    w = _w(order=("cue_no",))
    c = cues.withColumn("upto", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum(F.length("text")).over(Window.partitionBy(KEY)))
    c = c.withColumn("next", F.lead("cue_no").over(w)).where("next is not null").select(KEY, "cue_no", "upto", "all").join(spans.select(KEY, "from_ms", "to_ms"), KEY)
    return c.select(KEY, "cue_no", (F.col("from_ms") + F.floor((F.col("to_ms") - F.col("from_ms")) * F.col("upto") / F.col("all"))).cast("long").alias("at_ms"))


def clip_ranges(separators: DataFrame, spans: DataFrame, keep_ms: int = 60) -> DataFrame:
    """The clips between separators (media_id, start_ms, end_ms) of a span (media_id, from_ms, to_ms), each keeping so much of the silence beside it."""
    ends = spans.select(KEY, F.col("from_ms").alias("s"), F.col("from_ms").alias("e")).unionByName(separators.select(KEY, F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    w = Window.partitionBy(KEY).orderBy("s", "e")
    out = ends.withColumn("next", F.lead("s").over(w)).withColumn("clip_no", F.row_number().over(w).cast("long")).join(spans.select(KEY, "from_ms", "to_ms"), KEY)
    out = out.select(KEY, "clip_no", F.greatest(F.col("e") - keep_ms, "from_ms").alias("start_ms"), F.least(F.coalesce(F.col("next") + keep_ms, "to_ms"), "to_ms").alias("end_ms"))
    return out.where("end_ms > start_ms")


def align_by_token_count(cues: DataFrame, words: DataFrame, pad_ms: int = 80) -> DataFrame:
    """Each cue takes the media's next ``n_tokens`` words (media_id, word_no from 1, start_ms, end_ms), the last one the rest; padded.

    Cues and words are laid in one order and each word takes the last cue that began, so no cue is held against all words.
    """
    w = _w(order=("cue_no",))
    hi = F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = cues.withColumn("hi", hi).where("n_tokens > 0").select(KEY, (F.col("hi") - F.col("n_tokens") + 1).alias("at"), F.lit(0).alias("word"), F.col("cue_no").alias("own"), F.lit(None).cast("long").alias("ws"), F.lit(None).cast("long").alias("we"))
    x = words.select(KEY, F.col("word_no").alias("at"), F.lit(1).alias("word"), F.lit(None).cast("long").alias("own"), F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    order = Window.partitionBy(KEY).orderBy("at", "word").rowsBetween(Window.unboundedPreceding, 0)
    met = c.unionByName(x).withColumn("cue_no", F.last("own", ignorenulls=True).over(order)).where("word = 1 and cue_no is not null")
    return met.groupBy(KEY, "cue_no").agg(F.greatest(F.lit(0), F.min("ws") - pad_ms).alias("start_ms"), (F.max("we") + pad_ms).alias("end_ms"), F.count(F.lit(1)).alias("words"))
