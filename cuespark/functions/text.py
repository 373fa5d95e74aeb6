"""Scalar functions over text, time and identity, as column expressions.

Every function takes columns and returns a column, so filters and projections stay in one
generated stage. Null in gives null out unless a line says otherwise.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters a to z that they decompose to; đ counts as d."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for k in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(x, y) for x, y in pairs if x != y and "a" <= y <= "z" and x == x.lower()] + [("đ", "d")]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


ACCENTED, PLAIN = _folding()

# Vietnamese words of the digits.
DIGITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")

# Marks of text that was decoded with the wrong charset.
MOJIBAKE = "Ã|Ä|Æ|áº|á»|Â|â€"


def srt_ms(c: Column, on_error: str = "null") -> Column:
    """``H:MM:SS,mmm`` (comma or dot, one to three digits) to milliseconds; null or 0 if it doesn't fit."""
    pattern = r"^\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*$"
    part = lambda k: F.regexp_extract(c, pattern, k)
    ms = (part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")) * 1000 + F.rpad(part(4), 3, "0").cast("long")
    fits = c.rlike(pattern)
    return F.when(fits, ms).otherwise(F.lit(0 if on_error == "zero" else None).cast("long"))


def srt_time(ms: Column) -> Column:
    """Milliseconds to ``HH:MM:SS,mmm``; negative is 0."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    hours = F.floor(t / 3600000)
    return F.concat(
        F.when(hours > 99, hours.cast("string")).otherwise(two(hours)), F.lit(":"), two(F.floor(t / 60000) % 60), F.lit(":"),
        two(F.floor(t / 1000) % 60), F.lit(","), F.lpad((t % 1000).cast("string"), 3, "0"),
    )


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def unescape(c: Column) -> Column:
    """The five entities of markup and the no-break space."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def only_where(c: Column, needed: Column, change: Callable[[pd.Series], pd.Series]) -> Column:
    """``change``, in Arrow batches, of the texts that need it; the others stay in the JVM and go to Python as nulls."""
    changed = F.pandas_udf(change, "string")(F.when(needed, c))
    return F.when(needed, changed).otherwise(c)


def unescape_all(c: Column) -> Column:
    """Every named and numeric character reference, as HTML has them, ended by a semicolon or not."""

    def change(x: pd.Series) -> pd.Series:
        return x.map(html.unescape, na_action="ignore")

    return only_where(c, c.rlike("&[#A-Za-z]"), change)


def nfc(c: Column) -> Column:
    """Letters and marks composed. Every text goes to Python once, so that what makes it is computed once."""

    def change(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")

    return F.pandas_udf(change, "string")(c)


def clean_text(c: Column, entities: str | None = "markup") -> Column:
    """Mojibake repaired, tags to blanks, entities read (``markup``: six of them in the JVM, ``all``: every one, by Arrow where there is any; None: none), white space collapsed."""
    c = F.regexp_replace(repair_mojibake(c), "<[^>]+>", " ")
    return collapse(unescape_all(c) if entities == "all" else unescape(c) if entities else c)


def _windows_1252() -> tuple[str, str]:
    """The signs that Windows-1252 has in place of control characters, and those."""
    signs = [(bytes([k]).decode("cp1252", errors="ignore"), chr(k)) for k in range(0x80, 0xA0)]
    return "".join(x for x, _ in signs if x), "".join(y for x, y in signs if x)


SIGNS, CONTROLS = _windows_1252()


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Windows-1252 or Latin-1 is read again, if that is valid and leaves fewer marks."""
    plain = F.translate(c, SIGNS, CONTROLS)
    suspect = c.rlike(MOJIBAKE) & ~plain.rlike(r"[^\x00-\xFF]")
    raw = F.encode(F.when(suspect, plain).otherwise(F.lit("")), "ISO-8859-1")
    again = raw.cast("string")
    better = F.is_valid_utf8(again) & (F.regexp_count(again, F.lit(MOJIBAKE)) < F.regexp_count(c, F.lit(MOJIBAKE)))
    return F.when(suspect & better, again).otherwise(c)


def normalize_text(c: Column, composed: bool = True) -> Column:
    """Text to be spoken: mojibake repaired, tags to blanks, no blank before a mark and one after it, numbers to 999 as words, composed characters."""
    c = collapse(F.regexp_replace(repair_mojibake(c), "<[^>]+>", " "))
    c = F.regexp_replace(c, r"(?iU)(?=l)\blàm\s*điêu\b", "làm điêu")
    c = F.regexp_replace(c, r"(?U)\s+([,.!?;:])", "$1")
    c = numbers_to_words(F.regexp_replace(c, r"(?U)([,.!?;:])(?=\S)", "$1 "))
    return F.trim(nfc(c) if composed else c)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


# Last words after which a clip is cut too soon.
RISKY_LAST = ("thôi", "phòng", "tiết", "này")


def enforce_tail(c: Column, mode: str = "speech", risky: Sequence[str] = RISKY_LAST, short: int | None = None) -> Column:
    """``speech``: a full stop where no mark ends the text, three for texts of up to three words. ``retry``: a full stop if
    there is no ``.!?``. ``clip``: three full stops for one, for texts of up to eight units or with a risky last word."""
    c = collapse(c)
    dotted = lambda x: F.concat(F.regexp_replace(x, r"\s*\.$", ""), F.lit("..."))
    if mode == "retry":
        return F.when((c == "") | c.rlike("[.!?]$"), c).otherwise(F.concat(c, F.lit(".")))
    if mode == "clip":
        last = F.lower(F.element_at(F.split(F.regexp_replace(c, r"[.!?…]+$", ""), " "), -1))
        return F.when(((unit_count(c) <= (short or 8)) | last.isin(*risky)) & c.endswith("."), dotted(c)).otherwise(c)
    closed = F.when((c == "") | c.rlike("[.!?…]$"), c).otherwise(F.concat(c, F.lit(".")))
    few = (word_count(c) <= (short or 3)) & closed.endswith(".") & ~closed.endswith("...")
    return F.when(few, dotted(closed)).otherwise(closed)


def number_words(n: Column) -> Column:
    """0 to 999 in Vietnamese words; null outside."""
    names = F.array(*[F.lit(d) for d in DIGITS])
    digit = lambda x: F.get(names, x.cast("int"))
    h, t, u = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    unit = F.when((u == 1) & (t > 1), "mốt").when((u == 5) & (t > 0), "lăm").otherwise(digit(u))
    tens = (
        F.when(t == 0, F.when(u == 0, "").otherwise(F.when(h > 0, F.concat(F.lit("lẻ "), digit(u))).otherwise(digit(u))))
        .when(t == 1, F.when(u == 0, "mười").otherwise(F.concat(F.lit("mười "), unit)))
        .otherwise(F.concat(digit(t), F.lit(" mươi"), F.when(u == 0, "").otherwise(F.concat(F.lit(" "), unit))))
    )
    words = F.trim(F.concat(F.when(h > 0, F.concat(digit(h), F.lit(" trăm "))).otherwise(""), tens))
    return F.when((n < 0) | (n > 999), None).when(n == 0, DIGITS[0]).otherwise(words)


def numbers_to_words(c: Column) -> Column:
    """Every number of one to three digits that stands as a word of its own is read out."""
    words = lambda x: F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    read = lambda x: F.array_join(F.transform(words(x), lambda w: F.when(w.rlike(r"^[0-9]{1,3}$"), number_words(w.cast("int"))).otherwise(w)), "")
    return let(c, lambda x: F.when(x.rlike("[0-9]"), read(x)).otherwise(x))


def flags(*conditions: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions]))


def safety_flags(c: Column) -> Column:
    n = F.length(F.trim(c))
    return flags(("too_short", n < 3), ("too_long", n > 300), ("bad_chars", c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]")))


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


# Tokens that are heard for one another, by what they count as.
TOKEN_ALIASES = {
    "khi": "luc", "haman": "ham an", "lamdieu": "lam dieu", "trongky": "tram ky", "trongki": "tram ky",
    "loi": "luoi", "lieng": "dieu", "yieu": "dieu", "yeu": "dieu", "hoa": "ngoa", "ngoai": "ngoa", "ty": "tuy", "ti": "tuy",
    "tiet": "tien", "thuc": "thuoc", "trong": "tram", "tre": "ke", "khe": "ke", "keo": "ke",
}
AS_READ = "\u0001"  # before a muoi that stays in any case
DIGIT_TOKENS = ("mot", "hai", "ba", "bon", "nam", "sau", "bay", "tam", "chin")


def number_tokens(n: Column) -> Column:
    """The folded words of 0 to 999, without ``muoi`` after a digit."""
    words = F.split(fold(number_words(n)), " ")
    after_digit = lambda i: F.coalesce(F.get(words, i - 1).isin(*DIGIT_TOKENS), F.lit(False))
    return F.filter(words, lambda w, i: ~((w == "muoi") & after_digit(i)))


def compare_tokens(c: Column, aliases: Mapping[str, str] | None = TOKEN_ALIASES) -> Column:
    """Tokens of the folded text: numbers to 999 as words, ``aliases`` (a token to one or more) applied, ``muoi`` after a digit word left out."""
    folded = fold(clean_text(c))
    known = F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair])
    number = lambda t: t.rlike("^0*[0-9]{1,3}$")
    kept = lambda t: F.regexp_replace(t, rf"(?<![^ ]){AS_READ}(?=muoi(?![^ ]))", "")
    held = lambda t: F.regexp_replace(t, r"(?<![^ ])muoi(?![^ ])", AS_READ + "muoi")

    def spelt(tokens: Column) -> Column:
        alias = lambda t: let(F.coalesce(F.try_element_at(known, t), t), lambda x: F.when(x.contains(" "), held(x)).otherwise(x))
        return F.array_join(F.transform(tokens, lambda t: F.when(number(t), held(F.array_join(number_tokens(t.cast("int")), " "))).otherwise(alias(t))), " ")

    # as one text: numbers and aliases where there are any, then each run of free muoi after a digit word goes
    plain = F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))
    special = "|".join(["0*[0-9]{1,3}", *map(re.escape, aliases or {})])
    said = let(plain, lambda p: F.when(p.rlike(f"(?<![^ ])(?:{special})(?![^ ])"), spelt(F.split(p, " "))).otherwise(p))
    said = let(said, lambda t: F.when(t.contains("muoi"), kept(F.regexp_replace(t, rf"(?<![^ ])({'|'.join(DIGIT_TOKENS)})(?: muoi(?![^ ]))+", "$1"))).otherwise(t))
    return let(said, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def compact_key(c: Column, kind: str = "similarity") -> Column:
    marks = r"[\s,.!?;:\"'“”‘’…()\-]+" if kind == "similarity" else r"[\s\p{P}\p{S}]+"
    return F.lower(F.regexp_replace(c, marks, ""))


def script_share(c: Column, low: int = 0x3400, high: int = 0x9FFF) -> Column:
    """The share of the characters that aren't white space in a range of code points."""
    solid = F.length(F.regexp_replace(c, r"\s", ""))
    inside = F.regexp_count(c, F.lit(f"[\\x{{{low:x}}}-\\x{{{high:x}}}]"))
    return F.when(solid > 0, inside / solid).otherwise(0.0)


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{3400}-\x{9fff}]")


def apply_phrases(c: Column, phrases: Mapping[str, str]) -> Column:
    """Replacements in order of falling length of what they replace, then by text."""
    for wrong in sorted(phrases, key=lambda x: (-len(x), x)):
        c = F.replace(c, F.lit(wrong), F.lit(phrases[wrong]))
    return c


#: Characters of a phrase table that may stand in one row beside every text.
PHRASE_CHARS = 4 << 20

# Signs that a model's own notes got into a text, and names of a phrase's two sides.
AI_NOTES = ("可能为误听", "或错译", "实际应为", "某位角色的名字", "系统名称", "不确定", "需要根据上下文")
PHRASE_WRONG, PHRASE_RIGHT = ("wrong", "asr", "source", "from"), ("correct", "target", "to")


def phrase_rows(maps: DataFrame, phrases: str = "phrases", by: Sequence[str] = ()) -> DataFrame:
    """(*by, wrong, correct) from JSON text: an object of wrong to right, or a list of objects that name the two sides.

    Left out are phrases that are empty, equal, longer than 24 and 32 characters, without a letter of
    Latin, CJK or a digit, or with a model's notes. Of several of a wrong side the last counts.
    """
    v = maps.select(*by, F.try_parse_json(phrases).alias("__v")).where("__v is not null")
    kind = F.schema_of_variant("__v")
    v = v.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    if by:
        v = v.select(*[F.col(b).alias(f"__{b}") for b in by], "__v")
    rows = v.lateralJoin(v.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    side = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("value", f"$.{n}", "string")), F.lit("")) for n in names])
    wrong = F.when(F.col("key").isNotNull(), F.trim("key")).otherwise(side(PHRASE_WRONG))
    right = F.when(F.col("key").isNotNull(), F.trim(F.try_variant_get("value", "$", "string"))).otherwise(side(PHRASE_RIGHT))
    rows = rows.select(*[F.col(f"__{b}").alias(b) for b in by], "pos", wrong.alias("wrong"), right.alias("correct"))
    noted = lambda c: F.exists(F.array(*[F.lit(m) for m in AI_NOTES]), lambda m: F.contains(c, m))
    kept = rows.where((F.col("wrong") != "") & (F.col("correct") != "") & (F.col("wrong") != F.col("correct")) & (F.length("wrong") <= 24) & (F.length("correct") <= 32))
    kept = kept.where(F.concat("wrong", "correct").rlike(r"[\x{3400}-\x{9fff}A-Za-z0-9]") & ~noted(F.col("wrong")) & ~noted(F.col("correct")))
    return kept.groupBy(*by, "wrong").agg(F.max_by("correct", "pos").alias("correct"))


def apply_phrase_table(df: DataFrame, phrases: DataFrame, text: str = "text", by: Sequence[str] = (), changed: str | None = None) -> DataFrame:
    """``phrases(*by, wrong, correct)`` applied by falling length of the wrong side; ``changed`` names a column that tells where a text was.

    They are one ordered array for each ``by``, joined to its rows. Without ``by`` there is one array for all rows,
    and more than PHRASE_CHARS characters in it are an error.
    """
    used = phrases.where("length(wrong) > 0 and wrong <> correct")
    if not by and (n := used.agg(F.sum(F.length("wrong") + F.length("correct"))).first()[0] or 0) > PHRASE_CHARS:
        raise ValueError(f"{n} characters of phrases for all rows; name the columns that they belong to in by")
    ordered = used.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.length("wrong")).alias("n"), "wrong", "correct"))).alias("__p"))
    out = F.aggregate("__p", F.col(text), lambda t, p: F.replace(t, p["wrong"], p["correct"]))
    joined = df.join(ordered, list(by), "left") if by else df.join(F.broadcast(ordered), how="left")
    fixed = joined.withColumn("__new", F.coalesce(out, text))
    flag = [(~F.col("__new").eqNullSafe(F.col(text))).alias(changed)] if changed else []
    return fixed.select(*[F.col("__new").alias(c) if c == text else F.col(c) for c in df.columns], *flag)


def has_marker(c: Column, markers: Sequence[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for m in markers:
        out = out | low.contains(m.lower())
    return out


# Labels of a display, codes and phrases that stand over a picture.
OVERLAY_LABELS = (
    r"每日签到\s*[:：]\s*未进行", r"任务列表\s*[:：]\s*待领取任务\d+", r"经验值\s*[:：]\s*零", r"能力\s*[:：]\s*(?:暂无|暂天)",
)
OVERLAY_ONLY = (
    r"^\s*(?:每日签到[:：]\s*未进行\s*)+$", r"^\s*(?:任务列表[:：]\s*待领取任务\d+\s*)+$", r"^\s*(?:经验值[:：]\s*零|能力[:：]\s*(?:暂无|暂天))\s*$",
)
OVERLAY_CODES = (
    r"\d{1,3}\s*[:：.\-]\s*\d{2,5}", r"[01]{8,}(?:\s*\d{3,5})?", r"(?<![A-Za-z])\d{5,}(?![A-Za-z])", r"\s+\d{3,5}(?=\s|$)", r"(?<=\s)\d{1,4}(?=\s|$)",
)
OVERLAY_PHRASES = ("护士站", "活垃圾", "汉回可", "处回可")
OVERLAY_HANDLE, OVERLAY_EDGES = r"@\s*[㐀-\x{9fff}A-Za-z0-9_]{1,12}", "[ ，,、:：.-]"


def visible_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s,，。.!！?？:：;；、·\-\[\]【】()（）]+", "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ruled(state: Column, name: str, change: Callable[[Column], Column]) -> Column:
    """A state (text, hits) after a rule: the changed text, and the rule's name among the hits if it changed."""
    return let(
        state,
        lambda s: let(change(s["text"]), lambda t: F.struct(t.alias("text"), F.when(t != s["text"], F.array_append(s["hits"], F.lit(name))).otherwise(s["hits"]).alias("hits"))),
    )


def clean_overlay(c: Column, labels: Sequence[str] = OVERLAY_LABELS, only: Sequence[str] = OVERLAY_ONLY, codes: Sequence[str] = OVERLAY_CODES, phrases: Sequence[str] = OVERLAY_PHRASES) -> Column:
    """struct(text, hits map): a text without what stands over a picture, and how often each rule struck.

    Line by line: handles and codes (``watermark_or_code``) go, labels (``ui_inline``) and phrases (each
    by its own name) go; a line of labels only stays as it is, one that has no CJK left but had
    labels keeps each of them once, a line of digits goes. Lines with the visible characters of an earlier one go
    (``in_cue_duplicate``), as do, up to four times, words that are said twice. One expression; every rule runs once a line.
    """
    edges = lambda x: F.regexp_replace(F.regexp_replace(x, rf"^{OVERLAY_EDGES}+", ""), rf"{OVERLAY_EDGES}+$", "")
    squeezed = lambda x: edges(F.regexp_replace(x, r"(?U)\s+", " "))
    solid = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    gone = lambda pattern: lambda t: F.regexp_replace(t, pattern, " ")
    none = F.array().cast("array<string>")
    state = lambda text, hits=none: F.struct(text.alias("text"), hits.alias("hits"))

    def line(x: Column) -> Column:
        # white space alone is no change by a handle
        s = let(ruled(state(solid(x)), "watermark_or_code", gone(OVERLAY_HANDLE)), lambda s: state(squeezed(s["text"]), s["hits"]))
        is_label = lambda t: F.lit(False) if not only else t.rlike("|".join(f"(?:{p})" for p in only))

        def inner(s: Column) -> Column:
            shown = F.flatten(F.array(*[F.regexp_extract_all(s["text"], F.lit(p), F.lit(0)) for p in labels])) if labels else none
            t = s
            for p in codes:
                t = ruled(t, "watermark_or_code", gone(p))
            for p in labels:
                t = ruled(t, "ui_inline", gone(p))

            def rest(t: Column) -> Column:
                u = t
                for p in phrases:
                    u = ruled(u, p, lambda x, p=p: F.replace(x, F.lit(p), F.lit(" ")))
                u = let(u, lambda v: state(squeezed(v["text"]), v["hits"]))
                u = ruled(u, "watermark_or_code", lambda v: F.regexp_replace(v, r"(?U)^[\d\s:：.\-]+$", ""))
                unique = F.aggregate(shown, none, lambda acc, h: F.when((visible_key(h) == "") | F.exists(acc, lambda y: visible_key(y) == visible_key(h)), acc).otherwise(F.array_append(acc, solid(h))))
                return F.when((F.size(shown) > 0) & ~has_cjk(t["text"]), state(F.array_join(unique, " "), t["hits"])).otherwise(u)

            return let(t, rest)

        return let(s, lambda s: F.when((s["text"] == "") | is_label(s["text"]), s).otherwise(inner(s)))

    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\r\n]+"), line)
    held = "struct<lines:array<string>,keys:array<string>,hits:array<string>>"
    zero = F.struct(none.alias("lines"), none.alias("keys"), none.alias("hits")).cast(held)

    def gather(acc: Column, x: Column) -> Column:
        def decide(k: Column) -> Column:
            hits = F.concat(acc["hits"], x["hits"])
            same = F.struct(acc["lines"].alias("lines"), acc["keys"].alias("keys"), hits.alias("hits"))
            again = F.struct(acc["lines"].alias("lines"), acc["keys"].alias("keys"), F.array_append(hits, F.lit("in_cue_duplicate")).alias("hits"))
            more = F.struct(F.array_append(acc["lines"], x["text"]).alias("lines"), F.array_append(acc["keys"], k).alias("keys"), hits.alias("hits"))
            return F.when(k == "", same).when(F.array_contains(acc["keys"], k), again).otherwise(more)

        return let(visible_key(x["text"]), decide)

    whole = F.aggregate(lines, zero, gather, lambda acc: state(F.array_join(acc["lines"], " "), acc["hits"]))
    for _ in range(4):
        whole = ruled(whole, "in_cue_duplicate", lambda t: F.regexp_replace(t, r"(?U)(.{4,24})\s+\1", "$1"))
    counts = lambda hits: F.map_from_entries(F.transform(F.array_distinct(hits), lambda n: F.struct(n, F.size(F.filter(hits, lambda y: y == n)))))
    return let(whole, lambda s: F.struct(squeezed(s["text"]).alias("text"), counts(s["hits"]).alias("hits")))


def speakable(c: Column) -> Column:
    for pattern, by in (("<[^>]+>", " "), (r"\[[^\]]{0,40}\]", " "), (r"\([^)]{0,40}\)", " "), (r"https?://\S+", " "), ("[“”]", '"'), ("[‘’]", "'"), ("[–—]", "-")):
        c = F.regexp_replace(c, pattern, by)
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N}\s.,!?;:'\"%\-]", " "))


def strip_source_residue(c: Column, separators: Sequence[str] = ("=>", "->", "|", "/", ":")) -> Column:
    """For text that mixes scripts: the last part without CJK at the first separator found, else the text without CJK."""
    cases = [F.when(c.contains(s), F.element_at(F.filter(F.transform(F.split(c, F.lit("\\Q" + s + "\\E")), lambda p: F.trim(p)), lambda p: (p != "") & ~has_cjk(p)), -1)) for s in separators]
    bare = collapse(F.regexp_replace(c, r"[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]+", " "))
    latin = bare.rlike(r"\p{IsLatin}")
    return F.when(~has_cjk(c), c).otherwise(F.coalesce(*cases, F.when(latin, bare), c))


def salvage_json(c: Column) -> Column:
    """The JSON text in a reply: without fences, else the widest braces, else the widest brackets; null if none parses."""
    bare = F.trim(F.regexp_replace(c, r"```(?:json)?", ""))
    valid = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x)
    return F.coalesce(valid(bare), valid(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)), valid(F.regexp_extract(bare, r"(?s)(\[.*\])", 1)))


def first_url(c: Column) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(c, r"(https?://\S+)", 1), F.lit("")), r"[，。),\]]+$", "")


def normalize_url(c: Column) -> Column:
    """The first url of a text, else the text, without blanks around it and marks after it."""
    c = F.trim(c)
    return F.regexp_replace(F.coalesce(first_url(c), c), r"[，。),\]]+$", "")


# Where urls name an item, a collection, a user and a channel.
ITEM_PATTERNS = (r"/video/(\d+)", r"/note/(\d+)", r"aweme_id=(\d+)", r"modal_id=(\d+)", r"video_id=(\d+)")
COLLECTION_PATTERNS = (r"/collection/(\d+)", r"mix_id=(\d+)")
USER_KEYS, CHANNEL, CHANNEL_ID = ("sec_user_id", "sec_uid"), r"^https?://space\.bilibili\.com/\d+/?(?:\?.*)?$", r"space\.bilibili\.com/(\d+)"


def item_id(url: Column, patterns: Sequence[str] = ITEM_PATTERNS) -> Column:
    """The number by the first pattern that the url has, null if it has none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns])


def collection_id(url: Column) -> Column:
    return item_id(url, COLLECTION_PATTERNS)


def user_id(url: Column) -> Column:
    """Of a query's keys the first that is there, else the path's, decoded."""
    query = [F.try_url_decode(F.nullif(F.regexp_extract(url, rf"\?(?:[^#]*&)?{k}=([^&#]+)", 1), F.lit(""))) for k in USER_KEYS]
    path = F.regexp_extract(url, r"^[^?#]*/user/([^/?#]+)", 1)
    return F.coalesce(*query, F.try_url_decode(F.replace(F.nullif(path, F.lit("")), F.lit("+"), F.lit("%2B"))))


def channel_url(url: Column) -> Column:
    """A channel's page as that of its videos."""
    url = F.trim(url)
    return F.when(url.rlike(CHANNEL), F.concat(F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), "/+$", ""), F.lit("/video"))).otherwise(url)


def page_url(url: Column, ident: Column) -> Column:
    """The page of a video whose id begins with BV and whose url doesn't lead there."""
    elsewhere = ident.startswith("BV") & ~F.coalesce(url, F.lit("")).contains("bilibili.com")
    return F.when(elsewhere, F.concat(F.lit("https://www.bilibili.com/video/"), ident)).otherwise(F.coalesce(url, F.lit("")))


def safe_title(c: Column, n: int = 100) -> Column:
    return F.trim(F.substring(collapse(F.regexp_replace(c, r"[\\/*?:\"<>|\x00-\x1F]", " ")), 1, n))


def natural_key(c: Column, width: int = 12) -> Column:
    """Digit runs padded to a width, so that text order is the natural order; longer runs follow all others, by their length."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    padded = lambda p: F.when(F.length(digits(p)) <= width, F.lpad(digits(p), width, "0")).otherwise(F.concat(F.lit(":"), F.lpad(F.length(digits(p)).cast("string"), 4, "0"), digits(p)))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), padded(p)).otherwise(F.lower(p))), "")


def unit_count(c: Column) -> Column:
    """Words; where there are fewer than three, at least half the characters."""
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    return F.when(words >= 3, words).otherwise(F.greatest(words, F.floor(F.length(F.regexp_replace(c, r"\s", "")) / 2).cast("int")))


def expected_duration(c: Column, target: Column | None = None) -> tuple[Column, Column]:
    """(shortest, longest) in seconds that speaking the text should take."""
    chars, words = F.length(F.trim(c)), word_count(c)
    low = F.greatest(F.lit(0.45), chars / 28, words / 5.8)
    high = F.greatest(low + 0.8, chars / 5.5, words / 1.4)
    if target is not None:
        low, high = F.least(low, F.greatest(F.lit(0.35), target * 1.25)), F.greatest(high, target * 3.2, F.lit(1.2))
    return low, high


def duration_verdict(seconds: Column, low: Column, high: Column) -> Column:
    return F.when(seconds <= 0.05, "empty").when(seconds < low * 0.85, "too_short").when(seconds > high * 1.65, "too_long").otherwise("ok")


def pause_after(c: Column) -> Column:
    """Milliseconds of rest after the final mark."""
    return F.when(c.rlike(r"[.!?…]['\")\]]*$"), 380).when(c.rlike(r"[,;:]['\")\]]*$"), 200).otherwise(140)


def tail_pad(c: Column, overrides: Mapping[str, int], default: int = 0) -> Column:
    """Milliseconds added after a text whose last word is one of ``overrides``."""
    last = F.lower(F.regexp_extract(c, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))
    pads = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return F.coalesce(pads[last], F.lit(default))


def classify_failure(status: Column, message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(401, 403) | m.rlike("unauthor|expired token|login"), "auth_dead")
        .when((status == 429) | m.rlike("rate limit|too many"), "rate_limit")
        .when(m.rlike("captcha|blocked|verify"), "blocked")
        .when(status >= 500, "server")
        .when(m.rlike("timeout|timed out|econn|network"), "network")
        .when(status >= 400, "bad_response")
    )


def fingerprint(*parts: Column, algorithm: str = "sha256", length: int | None = None) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    out = F.sha2(joined, 256) if algorithm == "sha256" else F.sha1(joined.cast("binary"))
    return F.substring(out, 1, length) if length else out


def extra_fillers(expected: Column, actual: Column, fillers: Sequence[str]) -> Column:
    """Filler words in the actual text that the expected one lacks."""
    tokens = lambda c: F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_except(F.array_intersect(F.array(*[F.lit(f) for f in fillers]), tokens(actual)), tokens(expected))


def bad_text(c: Column) -> Column:
    return (F.length(c) < 12) | c.rlike(r"https?://|www\.|@") | (F.regexp_count(c, F.lit("[?!]")) > 2) | c.rlike("[A-Z]{4,}")


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first rule that holds, null if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules])


# Filler words, expressions at a text's start, tokens and marks that a training text must not have.
FILLERS = {"sentence": "ừm|ưm|ờ|ừ|ờm|um|uhm|uh|hm|hmm|ơ|ơm", "clean": "ừm|ưm|ờ|ừ|ừm+|ờm|um|uhm|uh|hm|hmm|à|ơ|ơm"}
EXPRESSIONS = {"sentence": r"á|oa|ha\s+ha|hahaha|hà\s+hà|ôi|ơ|úi|trời", "clean": r"á|oa|ha\s+ha|hahaha|hà\s+hà|ôi|ơ"}
BAD_TOKEN, ODD_MARKS = r"https?://|www\.|@|#|[A-Za-z]{4,}", r"[?!]{2,}|\.{4,}|[,;:]{3,}"


def reject_reason(c: Column, seconds: Column | None = None, profile: str = "sentence", chars: tuple[int, int] = (25, 180), span: tuple[float, float] = (1.0, 12.0), bad_token: str = BAD_TOKEN) -> Column:
    """The first rule that a text of a training set breaks, by the ladder of the profile ``sentence`` or ``clean``."""
    n = F.length(c)
    count = lambda marks: F.regexp_count(c, F.lit(marks))
    share = count("[0-9]") / F.greatest(F.lit(1), n)
    filler = ("filler", c.rlike(rf"(?iu)(^|\s)({FILLERS[profile]})(\s|,|\.|!|\?|$)"))
    leading = ("leading_expression", c.rlike(rf"(?iu)^\s*({EXPRESSIONS[profile]})([^\p{{L}}\p{{N}}_]|$)"))
    bad, tail = ("bad_token", c.rlike(bad_token)), ("no_tail_punct", ~c.rlike("[.!?…]$"))
    if profile == "clean":
        return first_reason(
            ("too_short", n < chars[0]), ("too_long", n > chars[1]), filler, leading, bad, ("odd_punct", c.rlike(ODD_MARKS)),
            ("too_many_digits", share > 0.18), ("too_many_clauses", count("[,.?!]") > 6), tail,
        )
    timed = [("too_short_duration", seconds < span[0]), ("too_long_duration", seconds > span[1])] if seconds is not None else []
    return first_reason(
        *timed, ("too_short_text", n < chars[0]), ("too_long_text", n > chars[1]), tail, filler, leading, bad,
        ("too_many_sentences", count("[.?!]") > 2), ("too_many_commas", count(",") > 3), ("too_many_digits", share > 0.15),
    )


def candidate_profiles(c: Column, rules: Sequence[tuple[Sequence[str], Sequence[str]]], long_words: int, long: Sequence[str], otherwise: Sequence[str]) -> Column:
    """Names of the profiles to try, in order and each once: by the last word (``rules`` of words and names), else by the number of words between blanks."""
    last = F.lower(F.regexp_extract(c, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))
    names = lambda x: F.array(*[F.lit(n) for n in dict.fromkeys(x)])
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    out = F.when(words >= long_words, names(long)).otherwise(names(otherwise))
    for words, given in reversed(rules):
        out = F.when(last.isin(*words), names(given)).otherwise(out)
    return out


def attempt_params(temperature: Column, top_k: Column, attempt: Column) -> tuple[Column, Column]:
    return (
        F.least(F.greatest(temperature + attempt * 0.04, F.lit(0.25)), F.lit(0.72)),
        F.least(F.greatest(top_k + attempt * 3, F.lit(8)), F.lit(45)),
    )


def resolve_alias(df: DataFrame, aliases: DataFrame, key: str, default: Column) -> DataFrame:
    """Left join on ``aliases(key, value)`` with a fallback; ``value`` is added."""
    return df.join(aliases.select(key, "value"), key, "left").withColumn("value", F.coalesce("value", default))


# Other names of voices, their genders, and signs of a gender and of a language.
VOICE_ALIASES, VOICE_DEFAULT = {"vi_female_huong": "BV074_streaming", "BV074_streaming_dsp": "BV074_streaming"}, "BV074_streaming"
VOICE_GENDERS = {"BV074_streaming": "female", "BV421_vivn_streaming": "female", "BV560_streaming": "male", "BV075_streaming": "male"}
VOICE_MALE = r"(?i)(?:male|nam|BV560|BV075)"
VOICE_LANGUAGE = r"(?i)(?:^|\W)(?:vi|vi-vn|vietnam|vietnamese|tiếng việt)(?:\W|$)"
CATALOGUE_MALE, CATALOGUE_FEMALE = r"(?i)male|nam", r"(?i)female|nữ|nu"


def voice_code(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in VOICE_ALIASES.items() for x in pair])
    bare = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(known, bare), F.nullif(bare, F.lit("")), F.lit(VOICE_DEFAULT))


def voice_gender(c: Column) -> Column:
    """By what is known of the voice, in any case of letters; else male where its code says so."""
    known = F.create_map(*[F.lit(x) for k, v in VOICE_GENDERS.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(known, F.lower(voice_code(c))), F.when(voice_code(c).rlike(VOICE_MALE), "male").otherwise("female"))


def pick_speakers(requests: DataFrame, catalogue: DataFrame, order: str, voice: str = "voice", language: str = VOICE_LANGUAGE, male: str = CATALOGUE_MALE, female: str = CATALOGUE_FEMALE) -> DataFrame:
    """``speaker`` for each request: of a catalogue (id, about, order) the first row of the language whose text fits the voice's gender, else the first of the language."""
    fitting = catalogue.where(F.col("about").rlike(language)).agg(
        *[F.coalesce(F.min_by("id", F.when(F.col("about").rlike(p), F.col(order))), F.min_by("id", order)).alias(g) for g, p in (("male", male), ("female", female))]
    )
    return requests.join(F.broadcast(fitting), how="left").withColumn("speaker", F.when(voice_gender(F.col(voice)) == "male", F.col("male")).otherwise(F.col("female"))).drop("male", "female")
