"""Operators without a SQL form, held on whole tables against plain Python that takes one row or one media at a time."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from cuespark import queries as q
from cuespark.functions import text as tx
from cuespark.operators import expand as ex
from cuespark.operators import grouping as gr
from cuespark.operators import sequence as sq
from cuespark.registry import QUERIES
from cuespark.standins import cues

SF = "/root/testdata/sf0.001"


def by_media(frame):
    out = collections.defaultdict(list)
    for r in frame.orderBy("media_id", "start_ms", "cue_no").collect():
        out[r["media_id"]].append(r)
    return out


# --- words to segments


def plain_segments(words):
    """Segments as (start, end, text), by indices into the words instead of a buffer."""
    sentence = lambda t: bool(re.search(r"""[.!?…]["')\]]?(\s+|$)""", t))
    clause = lambda t: bool(re.search(r"[,;:—](\s+|$)", t))
    out, a = [], 0
    emit = lambda i, j: out.append((words[i].start_ms, words[j].end_ms, " ".join(" ".join(w.text for w in words[i : j + 1]).split())))
    for b, w in enumerate(words):
        span, size = w.end_ms - words[a].start_ms, sum(len(x.text) + 1 for x in words[a : b + 1])
        full = span >= 9000 or size >= 140
        gap = words[b + 1].start_ms - w.end_ms if b + 1 < len(words) else 0
        if (span >= 4500 and size >= 12 and sentence(w.text)) or (full and (sentence(w.text) or clause(w.text) or gap >= 350)):
            emit(a, b)
            a = b + 1
        elif full:
            best = None
            for k in range(a, b):
                left, right = words[k].end_ms - words[a].start_ms, w.end_ms - words[k + 1].start_ms
                if left >= 1500 and right >= 1500:
                    score = abs(left - 4500) - (2000 if sentence(words[k].text) else 800 if clause(words[k].text) else 0)
                    if best is None or score < best[0]:
                        best = (score, k)
            k = best[1] if best else b
            emit(a, k)
            a = k + 1
    if a < len(words):
        emit(a, len(words) - 1)
    return out


def test_segments(spark):
    c = cues(spark, SF)
    got = collections.defaultdict(list)
    for r in QUERIES["seq19_segment_words"](spark, SF).orderBy("media_id", "group_no").collect():
        got[r.media_id].append((r.start_ms, r.end_ms, r.text))
    assert dict(got) == {m: plain_segments(rows) for m, rows in by_media(c).items()}
    words = c.select("media_id", "cue_no", "start_ms", "end_ms", F.posexplode(F.split("text", " ")).alias("k", "w"))
    words = words.select("media_id", (F.col("cue_no") * 1000 + F.col("k")).alias("cue_no"), (F.col("start_ms") + F.col("k") * 330).alias("start_ms"), (F.col("start_ms") + F.col("k") * 330 + 300).alias("end_ms"), F.col("w").alias("text"))
    got = collections.defaultdict(list)
    for r in gr.segment_words(words).orderBy("media_id", "group_no").collect():
        got[r.media_id].append((r.start_ms, r.end_ms, r.text))
    assert dict(got) == {m: plain_segments(rows) for m, rows in by_media(words).items()}


def test_segment_of_a_long_word(spark):
    words = spark.createDataFrame([(1, 1, 0, 10_000, "looong"), (1, 2, 10_100, 10_600, "one"), (1, 3, 10_700, 11_200, "two")], "media_id long, cue_no long, start_ms long, end_ms long, text string")
    assert [(r.start_ms, r.end_ms, r.text) for r in gr.segment_words(words).collect()] == [(0, 10_000, "looong"), (10_100, 11_200, "one two")]


# --- smart groups


def test_smart_groups_mark_their_pieces(spark):
    rows = [(1, 1, 0, 1000, "alpha beta"), (1, 2, 1250, 2000, "gamma delta"), (1, 3, 2050, 3000, "more"), (1, 4, 3900, 4000, "far")]
    c = spark.createDataFrame(rows, "media_id long, cue_no long, start_ms long, end_ms long, text string")
    got = [(r.start_ms, r.end_ms, r.text, r.members) for r in gr.group_smart(c).orderBy("group_no").collect()]
    assert got == [(0, 3000, "alpha beta. gamma delta, more.", 3), (3900, 4000, "far.", 1)]


def test_folds_run_over_islands(spark):
    """The fold's rows are keyed by island too, and a media of 200,000 cues is no problem, nor is one island of many rows."""
    many = spark.range(200_000).selectExpr("id div 1000000 as media_id", "id as cue_no", "id * 1000 as start_ms", "id * 1000 + 700 as end_ms", "concat('cue ', id, '.') as text")
    grouped = sq.group_cues(many)
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[media_id#\d+L, __island#\d+L\]", plan)
    assert grouped.agg(F.sum("members"), F.count("*")).first() == (200_000, 25_000)
    one = sq.pack_blocks(many.limit(50_000).selectExpr("media_id", "start_ms", "cue_no", "end_ms", "1L as size"), 7, 1000)
    assert one.agg(F.sum("members"), F.count("*")).first() == (50_000, 7143)


# --- clean-up of near duplicates


def visible(t):
    return re.sub(r"[\s,，。.!！?？:：;；、·\-\[\]【】()（）]+", "", t)


def plain_clean_up(rows, leaks, summaries, long_chars, long_ms):
    """{cue_no: (text, start, kept, rules)}: state is a list of ids, everything else is looked up."""
    text, rules, kept = {r.cue_no: r.text.strip() for r in rows}, collections.defaultdict(list), {r.cue_no: True for r in rows}
    span = {r.cue_no: r.end_ms - r.start_ms for r in rows}
    line = []

    def out(i, rule):
        kept[i] = False
        rules[i].append(rule)

    for r in rows:
        i = r.cue_no
        if any(m in text[i] for m in leaks):
            out(i, "leak")
            continue
        if len(text[i]) > long_chars and span[i] > long_ms and any(m in text[i] for m in summaries):
            out(i, "summary")
            continue
        if line:
            p, t = visible(text[line[-1]]), visible(text[i])
            sizes = [n for n in range(6, min(len(p), len(t)) + 1) if p.endswith(t[:n])]
            if sizes:
                shared = t[: max(sizes)]
                cut = text[i]
                if shared in cut:
                    at = cut.index(shared)
                    cut = (cut[:at] + cut[at + len(shared) :]).strip(" ，,、")
                if cut and visible(cut) != t:
                    text[i] = cut
                    rules[i].append("trimmed")
        same = [j for j in line[-4:] if text[j] == text[i] and text[i]]
        if not same:
            line.append(i)
        elif span[i] > span[same[0]]:
            out(same[0], "repeat")
            line[line.index(same[0])] = i
        else:
            out(i, "repeat")
    start = {r.cue_no: r.start_ms for r in rows}
    before = None
    for i in sorted(line, key=lambda i: start[i]):
        if before is not None:
            p, t = visible(text[before]), visible(text[i])
            if p and p != t and p in t and re.search(r"^\s*\d+|理解和配合|[·]+", text[i]):
                out(i, "adjacent")
                continue
            if p == t:
                loser = before if span[i] > span[before] else i
                out(loser, "adjacent")
                before = i if loser == before else before
                continue
        before = i
    return {i: (text[i], kept[i], rules[i]) for i in text}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_clean_up(spark, sf):
    c = q._repeated(spark, sf)
    seen = collections.Counter()
    for rows, got in ((by_media(c), collections.defaultdict(dict)),):
        for r in gr.marked_cues(c, ("dans le",), ("ment",), long_chars=40, long_ms=6000).collect():
            got[r.media_id][r.cue_no] = (r.text, r.kept, list(r.rules))
            seen.update(r.rules)
        assert dict(got) == {m: plain_clean_up(x, ("dans le",), ("ment",), 40, 6000) for m, x in rows.items()}
    assert sf == SF or all(seen[x] for x in ("leak", "summary", "trimmed", "repeat", "adjacent"))


def test_clean_up_keeps_what_only_looks_alike(spark):
    rows = [(1, 1, 0, 1000, "Same line here"), (1, 2, 1500, 3000, "another"), (1, 3, 4000, 9000, "same line, here!"), (1, 4, 9500, 9900, "每日签到：未进行"), (1, 5, 10_000, 10_500, "每日签到：未进行 任务列表：待领取任务2")]
    c = spark.createDataFrame(rows, "media_id long, cue_no long, start_ms long, end_ms long, text string")
    kept, struck = gr.finalize_cues(c)
    assert [(r.start_ms, r.end_ms, r.text) for r in kept.orderBy("start_ms").collect()] == [(0, 1000, "Same line here"), (1500, 3000, "another"), (4000, 9000, "same line, here!"), (9500, 9900, "每日签到：未进行"), (10_000, 10_500, "任务列表：待领取任务2")]
    assert [(r.rule, r.n) for r in struck.collect()] == [("trimmed", 2)]  # once in each pass


# --- reading pieces


def plain_reading(text, start, end, words):
    text = text.strip()
    if len(text) <= 84 and len(text) * 1000 / max(1, end - start) <= 17:
        return [(text, start, end, len(words))]
    found = []
    for kind, pattern, side in ((1, r"[.!?。！？]+\s+", "end"), (2, r"[,;:—，；：]\s+", "end"), (3, r"(?i)\s+(?:" + "|".join(sorted(gr.CONJUNCTIONS, key=lambda w: -len(w))) + r")\s+", "start")):
        for m in re.finditer(pattern, text):
            at = m.end() if side == "end" else m.start() + 1
            if 0 < at < len(text):
                found.append((kind, abs(at - len(text) / 2), at))
    found.sort(key=lambda x: x[:2])
    legal = [x[2] for x in found if max(len(text[: x[2]].strip()), len(text[x[2] :].strip())) <= 84]
    cut = legal[0] if legal else found[0][2] if found else None
    if cut is None:
        spaces = [i for i, ch in enumerate(text) if ch.isspace()]
        if not spaces:
            return [(text, start, end, len(words))]
        cut = sorted(spaces, key=lambda i: (abs(i - len(text) // 2), i))[0]
    at = start + (end - start) * cut // len(text)
    if words:
        at, place, last = end, 0, start
        for w in words:
            while place < len(text) and text[place].isspace():
                place += 1
            if cut <= place:
                at = last
                break
            if place + len(w.text) >= cut:
                at = w.end_ms
                break
            place, last = place + len(w.text), w.end_ms
    left, right = text[:cut].rstrip(), text[cut:].lstrip()
    if not left or not right:
        return [(text, start, end, len(words))]
    return plain_reading(left, start, at, [w for w in words if w.end_ms <= at]) + plain_reading(right, at, end, [w for w in words if w.start_ms >= at])


def test_reading_pieces(spark):
    c = q._worded(spark, SF)
    got = collections.defaultdict(list)
    for r in gr.split_for_reading(c).orderBy("media_id", "cue_no", "piece_no").collect():
        got[r.media_id, r.cue_no].append((r.piece, r.part_start, r.part_end, r.n_words))
    want = {(r.media_id, r.cue_no): plain_reading(r.text, r.start_ms, r.end_ms, r.words or []) for r in c.collect()}
    assert dict(got) == want
    for pieces in got.values():
        assert all(len(t) <= 84 and len(t) * 1000 <= 17 * max(1, b - a) or not re.search(r"\s", t) for t, a, b, _ in pieces)


# --- overlays


def plain_overlay(text):
    hits, edge = collections.Counter(), " ，,、:：.-"

    def sub(pattern, x, name):
        y = re.sub(pattern, " ", x)
        hits[name] += y != x
        return y

    lines = []
    for line in re.split(r"[\r\n]+", text):
        line = re.sub(r"\s+", " ", sub(r"@\s*[㐀-鿿A-Za-z0-9_]{1,12}", line.strip(), "watermark_or_code")).strip(edge)
        if line and not any(re.match(p, line) for p in tx.OVERLAY_ONLY):
            shown = [m for p in tx.OVERLAY_LABELS for m in re.findall(p, line)]
            for p in tx.OVERLAY_CODES:
                line = sub(p.replace(r"\x{9fff}", "鿿"), line, "watermark_or_code")
            for p in tx.OVERLAY_LABELS:
                line = sub(p, line, "ui_inline")
            if shown and not re.search("[㐀-鿿]", line):
                line = " ".join({visible(x): x.strip() for x in reversed(shown)}[k] for k in dict.fromkeys(visible(x) for x in shown) if k)
            else:
                for p in tx.OVERLAY_PHRASES:
                    hits[p] += p in line
                    line = line.replace(p, " ")
                line = re.sub(r"\s+", " ", line).strip(edge)
                if line and re.fullmatch(r"[\d\s:：.\-]+", line):
                    hits["watermark_or_code"] += 1
                    line = ""
        if visible(line):
            if visible(line) in map(visible, lines):
                hits["in_cue_duplicate"] += 1
            else:
                lines.append(line)
    whole = " ".join(lines)
    for _ in range(4):
        again = re.sub(r"(.{4,24})\s+\1", r"\1", whole)
        hits["in_cue_duplicate"] += again != whole
        whole = again
    return re.sub(r"\s+", " ", whole).strip(edge), ",".join(sorted(f"{k}={n}" for k, n in hits.items() if n))


def test_overlays(spark):
    rows = QUERIES["txt13_clean_overlay"](spark, SF).collect()
    assert [(r.text, r.hits) for r in rows] == [plain_overlay(r.before) for r in rows]
    struck = collections.Counter()
    for r in rows:
        struck.update({k: int(n) for k, n in (x.split("=") for x in r.hits.split(",") if x)})
    assert {r.rule: r.n for r in QUERIES["agg14_overlay_counts"](spark, SF).collect()} == dict(struck)
    odd = ["", "\n \n", "每日签到：未进行", "每日签到：未进行 经验值：零 能力：暂无 00110011", "他说 能力：暂无 12:30", "a-1234567b 1234567", "3 护士站 4", "one two one two one two", None]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").select("k", tx.clean_overlay(F.col("t")).alias("o")).orderBy("k")
    assert [(r.o.text, ",".join(sorted(f"{k}={n}" for k, n in r.o.hits.items()))) for r in frame.collect()] == [plain_overlay(t or "") for t in odd]


# --- captions


def plain_caption(text, limit):
    text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()
    out = []
    for sentence in filter(None, (p.strip() for p in re.split(r"(?<=[.!?。！？])\s*", text))):
        clauses = [sentence] if len(sentence) <= limit else [p.strip() for p in re.split(r"(?<=[,;:，；：、])\s*", sentence) if p.strip()]
        for c in clauses:
            if len(c) <= limit:
                out.append(c)
            elif re.search("[㐀-鿿]", c):
                out += [c[k : k + limit] for k in range(0, len(c), limit)]
            else:
                held = []
                for w in c.split():
                    if held and len(" ".join([*held, w])) > limit:
                        out.append(" ".join(held))
                        held = []
                    held.append(w)
                out.append(" ".join(held))
    return out


def test_captions(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    odd = [(-1, "漢字" * 50 + "，短。" + "a" * 90), (-2, "<b>x</b>y. z!?"), (-3, "")]
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + odd, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in ex.split_caption(frame).orderBy("doc_id", "piece_no").collect():
        got[r.doc_id].append(r.piece)
    for i, t in frame.collect():
        assert got[i] == plain_caption(t, 72), i


# --- chunks, timelines, tokens


def plain_request(text, limit=220):
    text, out = text.strip(), []
    while len(text) > limit:
        ends = [i for i in range(int(limit * 0.55), limit + 1) if i and text[i - 1] in ".!?;,: \t\n\r\f\v" or i and text[i - 1].isspace()]
        cut = max(ends, default=limit)
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [x for x in [*out, text] if x]


def plain_lookback(text, limit=180):
    out = []
    while len(text) > limit:
        places = [i for i in range(limit - 29, limit + 1) if text[i] in ".!?,; "]
        cut = places[-1] + 1 if places else limit
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [x for x in [*out, text] if x]


def plain_paragraphs(text, limit=3500):
    out = []
    while len(text) > limit:
        for mark in ("\n\n", "\n"):
            cut = text[: limit + len(mark)].rfind(mark)
            if cut >= 0:
                break
        else:
            cut = limit
        out.append(text[:cut])
        text = text[cut:].lstrip()
    return out + ([text] if text else [])


@pytest.mark.parametrize("name, plain, most", [("exp5_chunk_text", plain_request, 2000), ("exp5_chunk_lookback", plain_lookback, None), ("exp5_chunk_paragraphs", plain_paragraphs, None)])
def test_chunks(spark, name, plain, most):
    got = collections.defaultdict(list)
    for r in QUERIES[name](spark, SF).orderBy("doc_id", "chunk_no").collect():
        got[r.doc_id].append((r.chunk, r.error))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = [(None, "text_too_long")] if most and len(r.text.strip()) > most else [(c, None) for c in plain(r.text)]
        assert got[r.doc_id] == want, r.doc_id


def test_chunks_hold_a_text_once(spark):
    got = QUERIES["exp5_chunk_lookback"](spark, SF)
    held = got.select(sum(F.coalesce(F.sum(F.length(c)), F.lit(0)) for c, kind in got.dtypes if kind == "string")).first()[0]
    assert held <= spark.read.parquet(f"{SF}/documents.parquet").select(F.sum(F.length("text"))).first()[0]


def test_timeline_rules():
    long = "Trời đã tối rồi mà anh ấy vẫn chưa về nhà, nhưng lúc đó không ai biết chuyện gì đã xảy ra cả."
    assert ex.timeline_pieces(long, 65) == [("Trời đã tối rồi mà anh ấy vẫn chưa về nhà.", 0.24), ("Nhưng khi đó không ai biết chuyện gì đã xảy ra cả.", 0.0)]
    soft = "Cả nhà đã ngồi vào bàn ăn từ lâu rồi nhưng ông nội vẫn còn đứng ngoài sân nhìn trời."
    assert ex.timeline_pieces(soft, 65) == [("Cả nhà đã ngồi vào bàn ăn từ lâu rồi", 0.08), ("nhưng ông nội vẫn còn đứng ngoài sân nhìn trời.", 0.0)]
    clause = "Một hai ba bốn năm sáu bảy tám chín mười, mười một mười hai mười ba; mười bốn mười lăm mười sáu mười bảy mười tám mười chín."
    got = ex.timeline_pieces(clause, 50)
    assert got[0] == ("Một hai ba bốn năm sáu bảy tám chín mười,", 0.16) and " ".join(p for p, _ in got) == clause and got[-1][1] == 0.0
    # a piece doesn't end in a weak word where a mark comes soon after it
    weak = "Người ta nói rằng cô ấy là một người rất giỏi và, có thể nói như vậy, được mọi người yêu quý lắm đấy."
    assert all(ex.plain_tokens(p)[-1] not in ex.WEAK_LAST for p, _ in ex.timeline_pieces(weak, 40))
    assert ex.timeline_pieces("  ", 65) == [] and ex.timeline_pieces("Ngắn", 65) == [("Ngắn", 0.0)]


def test_timelines_keep_the_text(spark):
    rows = QUERIES["exp3_pause_timeline"](spark, SF).orderBy("conv_id", "turn", "piece_no").collect()
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r.conv_id, r.turn, r.text].append((r.piece, r.pause))
    for (_, _, text), parts in texts.items():
        assert " ".join(p for p, _ in parts).split() == text.split() and parts[-1][1] == 0.0 and all(s > 0 for _, s in parts[:-1])


def test_token_coverage(spark):
    def lcs(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    c = cues(spark, SF).select("media_id", "cue_no", tx.compare_tokens(F.col("text")).alias("t"))
    tokens = {(r.media_id, r.cue_no): r.t for r in c.collect()}
    rows = QUERIES["mat1_lcs_coverage"](spark, SF).collect()
    assert len(rows) > 100
    for r in rows:
        x, y = tokens[r.media_id, r.cue_no], tokens[r.media_id, r.cue_no + 1]
        coverage = lcs(x, y) / max(1, len(x))
        prefix = next((k for k, t in enumerate(y) if t in x[:3]), len(y))
        assert (r.coverage, r.extra_prefix, r.first_token, r.ok) == (round(coverage, 6), prefix, bool(x and y and x[0] == y[0]), coverage >= 0.92 and prefix <= 1)


def plain_merge(segments):
    """(start, end, text) after folding short segments: a list is scanned and rebuilt after every merge."""
    segs = [[s.start_ms, s.end_ms, s.text, s.speaker] for s in segments]
    words = lambda t: len(t.split())
    k = 0
    while k < len(segs):
        a, b, text, who = segs[k]
        if b - a >= 1500 and len(text) >= 12 and words(text) >= 3:
            k += 1
            continue
        tiny = b - a < 500 or len(text) < 4
        reach = 2000 if tiny else 600
        before, after = segs[k - 1] if k else None, segs[k + 1] if k + 1 < len(segs) else None
        gaps = {"before": a - before[1] if before else None, "after": after[0] - b if after else None}
        mine = {side: s for side, s in (("before", before), ("after", after)) if s and s[3] == who}
        close = [side for side in mine if gaps[side] <= reach]
        if len(close) == 2:
            side = "before" if before[1] - before[0] <= after[1] - after[0] else "after"
        elif close or mine:
            side = (close or list(mine))[0]
        elif before and after and tiny:
            side = "before" if gaps["before"] <= gaps["after"] else "after"
        else:
            side = "before" if before else "after" if after else None
        if side is None:
            k += 1
        elif side == "before":
            segs[k - 1 : k + 1] = [[before[0], max(before[1], b), f"{before[2]} {text}", before[3]]]
        else:
            segs[k : k + 2] = [[min(a, after[0]), after[1], f"{text} {after[2]}", after[3]]]
    again = any(b - a < 1500 or len(t) < 12 or words(t) < 3 for a, b, t, _ in segs)
    done = [(a, b, " ".join(t.split())) for a, b, t, _ in segs]
    return done if not again or len(segs) < 2 or len(segs) == len(segments) else plain_merge([Seg(*s) for s in segs])


Seg = collections.namedtuple("Seg", "start_ms end_ms text speaker")


def test_short_segments(spark):
    c = cues(spark, SF)
    got = collections.defaultdict(list)
    for r in gr.merge_short(c).orderBy("media_id", "group_no").collect():
        got[r.media_id].append((r.start_ms, r.end_ms, r.text))
    assert dict(got) == {m: plain_merge(rows) for m, rows in by_media(c).items()}


def test_corrected_tracks(spark):
    """Glossary, replies under the guard, glossary again, clean-up: each as plain Python over a media's rows."""
    from cuespark.operators.sequence import sample_context

    c = q._repeated(spark, SF)
    phrases = collections.defaultdict(dict)
    for r in q._glossary(sample_context(c)).collect():
        phrases[r.media_id][r.wrong] = r.correct

    def mapped(m, t):
        for wrong in sorted((w for w, x in phrases[m].items() if w and w != x), key=lambda w: (-len(w), w)):
            t = t.replace(wrong, phrases[m][wrong])
        return t

    Row = collections.namedtuple("Row", "cue_no start_ms end_ms text")
    want = {}
    for m, rows in by_media(c).items():
        fixed = []
        for r in rows:
            t = mapped(m, r.text)
            reply = t.strip() + "."
            ok = reply.strip() and "\n" not in reply and len(reply) <= max(len(t) + 28, int(len(t) * 1.75) + 8)
            fixed.append(Row(r.cue_no, r.start_ms, r.end_ms, mapped(m, reply if ok else t)))
        for i, (text, kept, rules) in plain_clean_up(fixed, ("dans le",), (), 80, 15_000).items():
            if kept:
                want[m, i] = (text, ",".join(rules))
    got = {(r.media_id, r.cue_no): (r.text, r.rules) for r in QUERIES["udf3_correct_tracks"](spark, SF).collect()}
    assert got == want


def test_nulls_and_empty_frames(spark):
    """Rows without text, times or a media end no job, and empty frames give none."""
    from cuespark.plans import jobs

    n = spark.createDataFrame([(1, 1, 0, 1000, None), (1, 2, 1100, 2000, ""), (1, 3, 2100, 3000, "x"), (None, 4, 0, 10, "y"), (2, 5, None, None, "z")], "media_id long, cue_no long, start_ms long, end_ms long, text string")
    spoken = n.withColumn("speaker", F.lit(None).cast("string"))
    parts = n.selectExpr("media_id", "cue_no as a_id", "start_ms as a_start", "end_ms as a_end", "text")
    lengths = n.selectExpr("media_id", "cue_no", "length(text) as chars", "cast(null as boolean) as force_single")
    replies = spark.createDataFrame([(1, 2, None), (2, 0, ""), (3, 1, "[1] a"), (4, None, "[1] a"), (None, 1, "x")], "reply_id long, expected long, reply string")
    heard = spark.createDataFrame([(1, 1, None, None, None, None), (1, 2, None, "ab", None, 1000), (3, 1, None, "ab", [[1, 2], None], 50)], "media_id long, row_no long, sentences array<struct<text:string,start:long,end:long>>, text string, timestamps array<array<long>>, duration_ms long")
    jobs_ = [
        (n, sq.group_cues, 3), (n, gr.group_smart, 4), (n, gr.group_natural, 4), (n, gr.segment_words, 1), (n, gr.marked_cues, 3), (n, gr.split_for_reading, 5), (n, gr.split_long_cues, 5), (spoken, gr.merge_short, 1),
        (spoken, gr.merge_tiny, 4), (parts, lambda f: ex.split_at_cuts(f, f.selectExpr("media_id", "a_start + 100 as at_ms")), 5), (lengths, lambda f: ex.length_batches(f, F.col("media_id") % 3), 5), (replies, ex.parse_indexed_reply, 5),
        (n, lambda f: ex.chunk_text(f, 10), 3), (n, lambda f: ex.pause_timeline(f, 20), 3), (n, ex.split_caption, 3), (heard, gr.funasr_segments, 2), (n, lambda f: jobs.apply_blocks(f, lambda x: [y.upper() for y in x], 4), 5),
    ]
    for frame, f, rows in jobs_:
        assert f(frame).count() == rows, f
        assert f(frame.limit(0)).count() == 0, f
    assert [r.status for r in ex.parse_indexed_reply(replies).orderBy("reply_id").collect()] == ["lines", "BLOCK_COUNT_MISMATCH", "BLOCK_COUNT_MISMATCH", "indexed", "BLOCK_COUNT_MISMATCH"]
