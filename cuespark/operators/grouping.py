"""Grouping, merging and clean-up of a media's cues where each step depends on the text so far.

Greedy groups are folds over islands (``sequence.folded_groups``). ``segment_words``, ``merge_short``
and ``finalize_cues`` look back and ahead at will: there one media's rows go to Python as one
frame, ordered by start and number; media are spread over the cluster by their key.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.functions.text import clean_text, has_cjk
from cuespark.operators.expand import allocate_time, caption_pieces, in_slices, solid_pieces
from cuespark.operators.sequence import CLAUSE as PAUSED, KEY, STRONG as ENDED, folded_groups, greedy, too_far

STRONG, CLAUSE = re.compile(r"[.!?…][\"')\]]*$"), re.compile(r"[,;:][\"')\]]*$")
MERGED = "media_id long, group_no long, start_ms long, end_ms long, text string, members long"


def per_media(cues: DataFrame, f: Callable[[list[dict]], list[dict]], schema: str = MERGED, columns: tuple[str, ...] = ("cue_no", "start_ms", "end_ms", "text")) -> DataFrame:
    """``f`` over each media's rows as dicts, in order; its rows are numbered as ``group_no``. A null text is empty, rows without media or times take no part."""
    fields = schema.split(", ")
    held = ", ".join(f"{name}: {kind}" for name, kind in (c.split(" ", 1) for c in fields if not c.startswith(f"{KEY} ")))

    def run(rows: list[dict]) -> list[dict]:
        ordered = sorted(rows, key=lambda r: (r["start_ms"], r["cue_no"] is None, r["cue_no"]))
        return [{"group_no": k, **r} for k, r in enumerate(f(ordered))]

    timed = cues.where(F.col(KEY).isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    rows = F.struct(*[F.coalesce("text", F.lit("")).alias("text") if c == "text" else F.col(c) for c in columns])
    media = timed.groupBy(KEY).agg(F.collect_list(rows).alias("__rows"))
    return media.select(F.col(KEY).cast("long").alias(KEY), F.inline(in_slices(run, f"array<struct<{held}>>", F.col("__rows"))))


def _texts(cues: DataFrame) -> DataFrame:
    tag = F.col("speaker") if "speaker" in cues.columns else F.lit("")
    return cues.select(KEY, "start_ms", "cue_no", "end_ms", F.lit(1).cast("long").alias("size"), "text", tag.alias("tag"))


def _merged(groups: DataFrame) -> DataFrame:
    return groups.select(KEY, "group_no", "start_ms", "end_ms", "text", "members")


def group_smart(cues: DataFrame, gap=(-80, 300), span_ms: int = 7500, chars: int = 210, enough: int = 70, strong_gap_ms: int = 180) -> DataFrame:
    """Cues joined across small gaps until the text is long enough and ends a sentence.

    A piece without a mark at its end gets a full stop where the gap to the next piece is wide or
    the piece is long, else a comma; a last comma becomes a full stop. All lengths are those of the
    marked text. A group ends with its last cue.
    """
    marked, ended = "[.!?,;:。！？，；：]$", "[.!?。！？]$"

    def closed(t: Column, wide: Column) -> Column:
        return F.when((t == "") | t.rlike(marked), t).otherwise(F.concat(t, F.when(wide | (F.length(t) >= enough), ".").otherwise(",")))

    def beside(a: Column, b: Column) -> Column:
        return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(" "), b))

    def whole(done: Column, last: Column) -> Column:
        return F.regexp_replace(beside(done, closed(last, F.lit(False))), ",$", ".")

    def upto(g: Column, c: Column) -> Column:
        return beside(g["done"], closed(g["last"], c["start_ms"] - g["end_ms"] >= strong_gap_ms))

    def joins(g: Column, c: Column) -> Column:
        now = whole(g["done"], g["last"])
        fits = (c["start_ms"] - g["end_ms"]).between(*gap) & (c["end_ms"] - g["start_ms"] <= span_ms)
        return fits & (F.length(whole(upto(g, c), c["text"])) <= chars) & ((F.length(now) < enough) | ~now.rlike(ended))

    group = lambda start, c, done: F.struct(start.alias("start_ms"), c["end_ms"].alias("end_ms"), done.alias("done"), c["text"].alias("last"))
    rows = cues.select(KEY, "start_ms", "cue_no", "end_ms", clean_text(F.col("text")).alias("text"))
    numbered = folded_groups(
        rows, lambda c: group(c["start_ms"], c, F.lit("")), joins, lambda g, c: group(g["start_ms"], c, upto(g, c)),
        lambda p, c: ~(c["start_ms"] - p["end_ms"]).between(*gap) | (c["end_ms"] - p["start_ms"] > span_ms),
    )
    members = numbered.groupBy(KEY, "group_no").agg(F.array_sort(F.collect_list(F.struct("start_ms", "cue_no", "end_ms", "text"))).alias("m"))
    following = lambda k: F.get("m", k + 1)["start_ms"] - F.get("m", k)["end_ms"]
    pieces = F.transform("m", lambda x, k: closed(x["text"], F.coalesce(following(k) >= strong_gap_ms, F.lit(False))))
    text = F.regexp_replace(F.array_join(F.filter(pieces, lambda x: x != ""), " "), ",$", ".")
    return members.select(KEY, "group_no", F.get("m", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("m", -1)["end_ms"].alias("end_ms"), text.alias("text"), F.size("m").cast("long").alias("members"))


def group_natural(cues: DataFrame, gap=(-50, 140), span_ms: int = 4200, chars: int = 95, enough: int = 18) -> DataFrame:
    """Shorter groups that stop after a sentence; a comma stands between pieces without a mark."""

    def joins(g: Column, c: Column) -> Column:
        done = (F.length(g["text"]) >= enough) & g["text"].rlike(ENDED)
        return ~done & (c["start_ms"] - g["end_ms"]).between(*gap) & (c["end_ms"] - g["start_ms"] <= span_ms) & (F.length(g["text"]) + 2 + F.length(c["text"]) <= chars)

    def glue(g: Column, c: Column) -> Column:
        marked = g["text"].rlike(ENDED) | g["text"].rlike(PAUSED)
        return F.concat(g["text"], F.when(marked, " ").otherwise(", "), c["text"])

    def apart(p, c):
        return too_far(p, c, gap, span_ms) | (F.length(p["text"]) + 2 + F.length(c["text"]) > chars)

    return _merged(greedy(_texts(cues), joins, glue, apart))


def build_chunks(cues: DataFrame, shortest_ms: int = 3000, longest_ms: int = 8500, gap_ms: int = 350, chars: int = 35, first: int | None = None) -> DataFrame:
    """Training chunks: closed once long enough in time and text; only spans within the bounds stay, the first of each media on demand."""
    rows = cues.select(KEY, "start_ms", "cue_no", "end_ms", (F.length("text") + 1).cast("long").alias("size"))

    def joins(g, c):
        done = (g["end_ms"] - g["start_ms"] >= shortest_ms) & (g["size"] - 1 >= chars)
        return ~done & (c["start_ms"] - g["end_ms"]).between(0, gap_ms) & (c["end_ms"] - g["start_ms"] <= longest_ms)

    out = greedy(rows, joins, apart=lambda p, c: too_far(p, c, (0, gap_ms), longest_ms)).where((F.col("end_ms") - F.col("start_ms")).between(shortest_ms, longest_ms) & (F.col("size") > chars))
    if first is None:
        return out
    return out.withColumn("r", F.row_number().over(Window.partitionBy(KEY).orderBy("group_no"))).where(F.col("r") <= first).drop("r")


# Ends of sentences and clauses over scripts, with a closing quote or bracket.
SENTENCE_END = re.compile(r"[.!?。！？।؟…؛܀։՝።၊][\"')\]]?(?:\s+|$)")
CLAUSE_END = re.compile(r"[,;:—、،؍](?:\s+|$)")


def segment_words(words: DataFrame, aim_ms: int = 4500, most_ms: int = 9000, least_chars: int = 12, chars: int = 140, gap_ms: int = 350, side_ms: int = 1500) -> DataFrame:
    """Words to segments: at a sentence's end from ``aim_ms`` on; when over the most, at a clause's end or a pause, else after the best word inside, else here.

    A word counts with the blank after it. The best word is the one that ends nearest ``aim_ms``,
    less 2 s after a sentence and 0.8 s after a clause, and leaves ``side_ms`` on both sides.
    """

    def run(rows: list[dict]) -> list[dict]:
        out, held, size = [], [], 0
        text = lambda x: " ".join(" ".join(w["text"] for w in x).split())

        def close(x: list[dict]) -> None:
            if text(x):
                out.append({"start_ms": x[0]["start_ms"], "end_ms": x[-1]["end_ms"], "text": text(x), "members": len(x)})

        for k, w in enumerate(rows):
            held.append(w)
            size += len(w["text"]) + 1
            span = w["end_ms"] - held[0]["start_ms"]
            full = span >= most_ms or size >= chars
            pause = k + 1 < len(rows) and rows[k + 1]["start_ms"] - w["end_ms"] >= gap_ms
            sentence, clause = SENTENCE_END.search(w["text"]), CLAUSE_END.search(w["text"])
            cut = 0
            if span >= aim_ms and size >= least_chars and sentence or full and (sentence or clause or pause):
                cut = len(held)
            elif full:
                inner = []
                for i in range(1, len(held)):
                    left, right = held[i - 1]["end_ms"] - held[0]["start_ms"], w["end_ms"] - held[i]["start_ms"]
                    if left >= side_ms and right >= side_ms:
                        end = held[i - 1]["text"]
                        inner.append((abs(left - aim_ms) - (2000 if SENTENCE_END.search(end) else 800 if CLAUSE_END.search(end) else 0), i))
                cut = min(inner)[1] if inner else len(held)
            if cut:
                close(held[:cut])
                held = held[cut:]
                size = sum(len(x["text"]) + 1 for x in held)
        if held:
            close(held)
        return out

    return per_media(words, run)


def merge_short(segments: DataFrame, short_ms: int = 1500, chars: int = 12, words: int = 3, near_ms: int = 600, tiny=(500, 4, 2000)) -> DataFrame:
    """Short segments folded into a neighbour until none is left that has one.

    The choice, in this order: of the neighbours of the same speaker that are near, the shorter
    one; the one before, then the one after, of the same speaker at any distance; for tiny
    segments (by time or characters, for which also a larger distance is near) the nearer
    neighbour, else the one before, else the one after.
    """
    tiny_ms, tiny_chars, tiny_near = tiny

    def run(rows: list[dict]) -> list[dict]:
        segs = [{**r, "members": 1} for r in rows]
        span = lambda s: s["end_ms"] - s["start_ms"]
        is_short = lambda s: span(s) < short_ms or len(s["text"]) < chars or len(s["text"].split()) < words

        def choice(k: int) -> int | None:
            s = segs[k]
            is_tiny = span(s) < tiny_ms or len(s["text"]) < tiny_chars
            far = {j: (s["start_ms"] - segs[j]["end_ms"] if j < k else segs[j]["start_ms"] - s["end_ms"]) for j in (k - 1, k + 1) if 0 <= j < len(segs)}
            same = [j for j in far if segs[j]["speaker"] == s["speaker"]]
            near = [j for j in same if far[j] <= (tiny_near if is_tiny else near_ms)]
            if near:
                return min(near, key=lambda j: (span(segs[j]), j))
            rest = same or sorted(far, key=lambda j: (far[j], j) if is_tiny else (j,))
            return rest[0] if rest else None

        moved = True
        while moved:
            moved, k = False, 0
            while k < len(segs):
                pick = choice(k) if is_short(segs[k]) else None
                if pick is None:
                    k += 1
                    continue
                a, b = sorted((k, pick))
                held = segs[pick]
                held.update(start_ms=min(segs[a]["start_ms"], held["start_ms"]), end_ms=max(segs[a]["end_ms"], segs[b]["end_ms"]), text=" ".join(f"{segs[a]['text']} {segs[b]['text']}".split()), members=segs[a]["members"] + segs[b]["members"])
                del segs[k]
                moved = True
        return segs

    return per_media(segments, run, MERGED + ", speaker string", ("cue_no", "start_ms", "end_ms", "text", "speaker"))


def merge_tiny(segments: DataFrame, mode: str = "tiny", most_chars: int = 84, cps: float = 17.0) -> DataFrame:
    """Tiny cues joined forward, within the limits of a readable cue.

    ``tiny``: under 1.2 s or 8 characters, of one speaker, no sentence end on the left, and read at
    no more than ``cps``. ``repair``: under 0.65 s or 8 characters, at most ``most_chars`` unless one
    is under 0.3 s or has up to 4 characters, and at most 6 s in all.
    """
    span = lambda x: x["end_ms"] - x["start_ms"]
    least = lambda f, g, c: F.least(f(g), f(c))
    n = lambda x: F.length(x["text"])

    def joins(g: Column, c: Column) -> Column:
        whole, size = c["end_ms"] - g["start_ms"], n(g) + 1 + n(c)
        if mode == "repair":
            tiny = (least(span, g, c) < 650) | (least(n, g, c) < 8)
            return tiny & ((size <= most_chars) | (least(span, g, c) < 300) | (least(n, g, c) <= 4)) & (whole <= 6000)
        tiny = (least(span, g, c) < 1200) | (least(n, g, c) < 8)
        return tiny & ~g["text"].rlike(ENDED) & (size <= most_chars) & (size * 1000 / F.greatest(F.lit(1), whole) <= cps) & g["tag"].eqNullSafe(c["tag"])

    def apart(p, c):
        if mode == "repair":
            return c["end_ms"] - p["start_ms"] > 6000
        return ~p["tag"].eqNullSafe(c["tag"]) | p["text"].rlike(ENDED) | (n(p) + 1 + n(c) > most_chars)

    return _merged(greedy(_texts(segments), joins, apart=apart))


# Labels of a display that stand beside what is said, and signs of a display's line.
DAILY, TASKS = re.compile(r"每日签到\s*[:：]\s*未进行"), re.compile(r"任务列表\s*[:：]\s*待领取任务\d+")
DISPLAY_LINE = re.compile(r"^\s*\d+|理解和配合|[·]+")
VISIBLE, EDGES = re.compile(r"[\s,，。.!！?？:：;；、·\-\[\]【】()（）]+"), " ，,、"


def marked_cues(cues: DataFrame, leaks: tuple[str, ...] = (), summaries: tuple[str, ...] = (), memory: int = 4, overlap: int = 6, long_chars: int = 80, long_ms: int = 15_000) -> DataFrame:
    """Every cue with what the clean-up made of it: ``kept`` and ``rules``, in order of ``group_no``.

    First pass: texts with a leak marker go (``leak``), and long texts over a long time with a
    summary marker (``summary``); a daily label before a task label, and a start that repeats at
    least ``overlap`` visible characters of the end of the last kept text, are cut off (``trimmed``);
    of equal texts among the last ``memory`` kept, the one with the longer time stays in the place of
    the first (``repeat``). Second pass, by start: a display line that holds all of the text before
    goes, and of neighbours with equal visible characters the longer time stays (``adjacent``).
    Texts are compared by their visible characters where the rule says so. A pass keeps four rows
    and one text; a media's rows are one frame.
    """
    key = lambda t: VISIBLE.sub("", t)

    def run(rows: list[dict]) -> list[dict]:
        span = lambda r: r["end_ms"] - r["start_ms"]
        for r in rows:
            r.update(text=r["text"].strip(), rules=[], kept=True)

        def drop(r: dict, rule: str) -> None:
            r["kept"] = False
            r["rules"].append(rule)

        first: list[dict] = []
        for r in rows:
            text = r["text"]
            if any(m in text for m in leaks):
                drop(r, "leak")
                continue
            if len(text) > long_chars and span(r) > long_ms and any(m in text for m in summaries):
                drop(r, "summary")
                continue
            if first and text:
                last = first[-1]["text"]
                if (DAILY.search(last) or TASKS.search(last)) and TASKS.search(text):
                    rest = re.sub(r"\s+", " ", DAILY.sub(" ", text)).strip(EDGES)
                    if rest:
                        text = rest
                        r["rules"].append("trimmed")
                before, now = key(last), key(text)
                n = next((n for n in range(min(len(before), len(now)), overlap - 1, -1) if now.startswith(before[-n:])), 0)
                rest = text.replace(before[-n:], "", 1).strip(EDGES) if n else ""
                if rest and key(rest) != now:
                    text = rest
                    r["rules"].append("trimmed")
                r["text"] = text
            twin = next((k for k in range(max(0, len(first) - memory), len(first)) if text and first[k]["text"] == text), None)
            if twin is None:
                first.append(r)
            elif span(r) > span(first[twin]):
                drop(first[twin], "repeat")
                first[twin] = r
            else:
                drop(r, "repeat")
        last = None
        for r in sorted(first, key=lambda r: r["start_ms"]):
            if last:
                before, now = key(last["text"]), key(r["text"])
                if before and before in now and before != now and DISPLAY_LINE.search(r["text"]):
                    drop(r, "adjacent")
                    continue
                if DAILY.search(last["text"]) and TASKS.search(r["text"]):
                    r["text"] = re.sub(r"\s+", " ", DAILY.sub(" ", r["text"])).strip(EDGES)
                    r["rules"].append("trimmed")
                if key(r["text"]) == before:
                    if span(r) > span(last):
                        drop(last, "adjacent")
                        last = r
                    else:
                        drop(r, "adjacent")
                    continue
            last = r
        return [{**r, "rules": r["rules"]} for r in rows]

    schema = "media_id long, group_no long, cue_no long, start_ms long, end_ms long, text string, kept boolean, rules array<string>"
    return per_media(cues, run, schema)


def finalize_cues(cues: DataFrame, leaks: tuple[str, ...] = (), summaries: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(the cues that ``marked_cues`` keeps, (media_id, rule, n) how often each rule struck)."""
    marked = marked_cues(cues, leaks, summaries)
    struck = marked.select(KEY, F.explode("rules").alias("rule")).groupBy(KEY, "rule").agg(F.count(F.lit(1)).alias("n"))
    return marked.where("kept").select(KEY, "cue_no", "start_ms", "end_ms", "text", "rules"), struck


# Ends of sentences and clauses, and words before which a text may be cut.
SENTENCE_CUT, CLAUSE_CUT = re.compile(r"[.!?。！？]+\s+"), re.compile(r"[,;:—，；：]\s+")
CONJUNCTIONS = (
    "and", "but", "or", "so", "however", "because", "although", "while", "therefore", "meanwhile",
    "y", "pero", "o", "et", "mais", "ou", "donc", "und", "aber", "oder", "weil",
)
CONJUNCTION_CUT = re.compile(rf"\s+(?:{'|'.join(sorted(CONJUNCTIONS, key=len, reverse=True))})\s+", re.IGNORECASE)


def reading_cut(text: str, chars: int) -> int | None:
    """Where to cut: of sentence ends, clause ends and conjunctions, in this order and then by nearness to the middle, the
    first that leaves both sides within ``chars``, else the first; without any, the blank nearest the middle."""
    n, half = len(text), len(text) / 2
    cuts = [(kind, c) for kind, found in enumerate(((m.end() for m in SENTENCE_CUT.finditer(text)), (m.end() for m in CLAUSE_CUT.finditer(text)), (m.start() + 1 for m in CONJUNCTION_CUT.finditer(text)))) for c in found if 0 < c < n]
    cuts.sort(key=lambda x: (x[0], abs(x[1] - half)))
    fitting = [c for _, c in cuts if len(text[:c].strip()) <= chars and len(text[c:].strip()) <= chars]
    if cuts:
        return fitting[0] if fitting else cuts[0][1]
    blanks = [i for i, ch in enumerate(text) if ch.isspace() and i]
    return min(blanks, key=lambda i: abs(i - n // 2), default=None)


def time_at(text: str, at: int, start: int, end: int, words: list[tuple[str, int, int]]) -> int:
    """The time of a cut: the end of the word that it falls in or after, else the share of the characters."""
    if not words:
        return start + (end - start) * at // max(1, len(text))
    place, last = 0, start
    for word, _, word_end in words:
        while place < len(text) and text[place].isspace():
            place += 1
        if at <= place:
            return last
        place += len(word)
        if at <= place:
            return word_end
        last = word_end
    return end


def reading_pieces(text: str, start: int, end: int, words: list[tuple[str, int, int]], chars: int, cps: float) -> list[tuple]:
    """Timed pieces (text, start, end, words), cut until each fits or has no place to cut."""
    todo, out = [(text.strip(), start, end, words)], []
    while todo:
        t, a, b, w = todo.pop()
        cut = None if len(t) <= chars and len(t) * 1000 <= cps * max(1, b - a) else reading_cut(t, chars)
        left, right = (t[:cut].rstrip(), t[cut:].lstrip()) if cut else ("", "")
        if left and right:
            at = time_at(t, cut, a, b, w)
            todo += [(right, at, b, [x for x in w if x[1] >= at]), (left, a, at, [x for x in w if x[2] <= at])]
        else:
            out.append((t, a, b, w))
    return out


def split_for_reading(segments: DataFrame, chars: int = 84, cps: float = 17.0) -> DataFrame:
    """Pieces (piece_no, piece, part_start, part_end, n_words) of at most ``chars`` characters and ``cps`` a second, where a cut exists.

    ``words``, an array of (text, start_ms, end_ms), gives the times of cuts where the segments have it; each
    piece keeps the words on its side. Without words, time is shared by characters; a segment without times is one piece.
    """
    timed = F.col("words") if "words" in segments.columns else F.lit(None).cast("array<struct<text:string,start_ms:long,end_ms:long>>")

    def run(text: str | None, start: int | None, end: int | None, words: list[dict] | None) -> list[dict]:
        text = "" if text is None else text
        if start is None or end is None:
            return [{"piece_no": 0, "piece": text.strip(), "part_start": None, "part_end": None, "n_words": 0}]
        pieces = reading_pieces(text, int(start), int(end), [(x["text"], x["start_ms"], x["end_ms"]) for x in words or ()], chars, cps)
        return [{"piece_no": k, "piece": p, "part_start": x, "part_end": y, "n_words": len(z)} for k, (p, x, y, z) in enumerate(pieces)]

    kept = [c for c in segments.columns if c != "words"]
    pieces = in_slices(run, "array<struct<piece_no:int,piece:string,part_start:long,part_end:long,n_words:int>>", F.col("text"), F.col("start_ms"), F.col("end_ms"), timed)
    return segments.withColumn("__p", pieces).select(*kept, F.inline("__p"))


def long_cue_pieces(text: Column, chars: int) -> Column:
    """Pieces that end after each mark, cut at every ``chars`` characters; texts with CJK lose their blanks."""
    bare = F.when(has_cjk(text), F.regexp_replace(text, r"(?U)\s+", "")).otherwise(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    parts = solid_pieces(F.split(bare, r"(?<=[，。！？；：、,.!?;:])"))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / chars).cast("int")), lambda k: F.substring(p, k * chars + 1, F.lit(chars)))
    return F.flatten(F.transform(parts, cut))


def split_long_cues(cues: DataFrame, most_ms: int = 7000, chars: int = 48, floor_ms: int = 600) -> DataFrame:
    """Cues over the time and the text limit, or far over the time with some text, are split at their marks and share the time; the others are one piece."""
    span, n = F.col("end_ms") - F.col("start_ms"), F.length("text")
    over = (span > most_ms) & ((n > chars) | ((span > 12_000) & (n > 18)))
    marked = cues.withColumn("__p", F.when(over, long_cue_pieces(F.col("text"), chars)))
    whole = F.coalesce(F.size("__p"), F.lit(0)) < 2
    rest = marked.where(whole).drop("__p").select("*", F.lit(0).alias("piece_no"), F.col("text").alias("piece"), F.length("text").alias("weight"), F.col("start_ms").alias("part_start"), F.col("end_ms").alias("part_end"))
    pieces = marked.where(~whole).select(*cues.columns, F.posexplode("__p").alias("piece_no", "piece")).withColumn("weight", F.length("piece"))
    split = allocate_time(pieces, floor_ms=floor_ms)
    return split.unionByName(rest.select(split.columns))


def funasr_segments(rows: DataFrame, chars: int = 28, floor_ms: int = 450) -> DataFrame:
    """Recogniser rows (media_id, row_no, sentences, text, timestamps, duration_ms) to segments (row_no, pos, start_ms, end_ms, text).

    Timed sentences of every row count. A row falls back where it has none and no earlier row of the
    media gave a segment: to its characters with their times, closed at a mark or ``chars``
    characters, where it has times at all (none come of fewer times than characters); else to pieces of its text that share the media's time by length, at
    least ``floor_ms`` each and none after its end. Tags and white space are not text.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"<\|[^|]*\|>", ""), r"(?U)\s+", "")
    one = "struct<start_ms:long,end_ms:long,text:string>"
    sentences = F.transform(F.coalesce("sentences", F.array().cast(rows.schema["sentences"].dataType)), lambda s: F.struct(s["start"].cast("long").alias("start_ms"), s["end"].cast("long").alias("end_ms"), bare(s["text"]).alias("text")))
    r = rows.withColumn("__t", F.coalesce(bare(F.col("text")), F.lit(""))).withColumn("__own", F.filter(sentences, lambda s: (s["text"] != "") & (s["end_ms"] > s["start_ms"])))

    def take(acc: Column, x: Column) -> Column:
        text, start = F.concat(acc["open"]["text"], x["c"]), F.coalesce(acc["open"]["start_ms"], x["t"][0])
        piece = F.struct(start.alias("start_ms"), x["t"][1].alias("end_ms"), text.alias("text"))
        empty = F.struct(F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit("").alias("text"))
        closes = x["c"].rlike("[。！？!?，、；;：]") | (F.length(text) >= chars)
        return F.when(F.coalesce(F.size(x["t"]), F.lit(0)) < 2, acc).when(closes, F.struct(F.array_append(acc["done"], piece).alias("done"), empty.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), piece.alias("open")))

    letters = F.filter(F.split("__t", ""), lambda c: c != "")
    pairs = F.slice(F.arrays_zip(letters.alias("c"), F.col("timestamps").alias("t")), F.lit(1), F.greatest(F.length("__t"), F.lit(1)))
    zero = F.struct(F.array().cast(f"array<{one}>").alias("done"), F.struct(F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit("").alias("text")).alias("open"))
    spelt = F.aggregate(pairs, zero, take, lambda acc: F.when(acc["open"]["text"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    parts = F.when(F.col("__t") == "", F.array().cast("array<string>")).otherwise(caption_pieces(F.col("__t"), chars))
    remaining, total = F.greatest(F.lit(500), F.col("duration_ms")), F.length("__t")

    def spread(acc: Column, p: Column) -> Column:
        end = F.least(F.col("duration_ms"), acc["at"] + F.greatest(F.lit(floor_ms), F.floor(remaining * F.length(p) / total))).cast("long")
        return F.struct(end.alias("at"), F.array_append(acc["done"], F.struct(acc["at"].alias("start_ms"), end.alias("end_ms"), p.alias("text"))).alias("done"))

    shared = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{one}>").alias("done")), spread, lambda acc: acc["done"])
    timed = F.coalesce(F.size("timestamps"), F.lit(0)) > 0
    back = F.when(~timed, shared).when(F.size("timestamps") >= F.length("__t"), spelt).otherwise(F.array().cast(f"array<{one}>"))
    r = r.withColumn("__back", back)
    gives = (F.size("__own") > 0) | (F.size("__back") > 0)
    first = F.min(F.when(gives, F.col("row_no"))).over(Window.partitionBy(KEY))
    chosen = F.when(F.size("__own") > 0, F.col("__own")).when(F.col("row_no") == F.col("__first"), F.col("__back")).otherwise(F.array().cast(f"array<{one}>"))
    return r.withColumn("__first", first).select(KEY, "row_no", F.posexplode(chosen).alias("pos", "s")).select(KEY, "row_no", "pos", "s.*")
