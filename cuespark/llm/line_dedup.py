"""Fuzzy line dedup by MinHash, with one line kept per group of near-equal lines.

Native: DataFrame functions only. A line is compared in its folded form (trimmed, lower case,
runs of blanks as one space). Its signature holds the ``SKETCH`` smallest hashes of its character
shingles; every pair of them is a band, so two lines meet if two of their smallest hashes agree
(of signatures as similar as 0.8 in 99 of 100 cases, of 0.65 in 94). In each band a line is held first against
the band's first line and its predecessor in the order of the next smallest hash, which joins most
groups at two comparisons a line. A band of more than three lines whose members then still lie in
several components is reopened, bands with the same members once: all its pairs across components are
compared in tiles of bounded size, so every two lines that meet in a band are decided. Pairs are
verified by the exact Jaccard similarity of their distinct character 5-shingles, and verified pairs are
joined by distributed components. Before, the shingles' counts bound it, and in tiles a sketch of
parities; of the pairs that a tile names each line's nearest come first, the others only if they still
cross components.

The shingles of a signature are, in long lines, the first ``ANCHORED`` characters from each word
on, and in short lines those at every character; lengths near the border take both, so that
near-equal lines always share a scheme. A signature's hashes have 32 bits, a band's key has two.

Equal lines are one row from the first aggregation on, whatever their number. The first line of
a group, by (doc_id, line number), stays. Lines whose folded form is shorter than ``min_chars``
are no evidence of copying and always stay.

Defined cases: a null text has no lines and stays null; a null doc_id takes no part and stays
as it is; rows that repeat both id and text are one document and keep the same lines; an empty
text stays; an empty table gives an empty result; other columns are carried along. A document
none of whose lines is left has an empty text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.llm.common import connected_components, discard, free_name, small, stored

SIMILARITY = 0.8
MIN_CHARS = 24  # at least SHINGLE
SKETCH = 5
SHORT_CHARS, LONG_CHARS = 150, 120  # lines up to the first use every character, from the second on word starts
SHINGLE, ANCHORED = 9, 12
VERIFIED = 5
TILE = 128  # lines a chunk of a reopened band
WORDS = 8  # of 64 bits in a line's sketch of its shingles


def folded_line(line: Column) -> Column:
    """``line`` must be a column, as it is named twice."""
    blank = line.contains("  ") | line.contains("\t") | line.contains("\r")
    return F.trim(F.when(blank, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line))


def _smallest(hashes: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH + 1)


def _runs(t: Column, n: int) -> Column:
    """All runs of ``n`` characters; one pass over the text, which must have ``n`` at least."""
    return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _grams(t: Column, n: int) -> Column:
    return F.transform(_runs(t, n), lambda x: F.xxhash64(x))


def _every(t: Column) -> Column:
    return F.transform(_runs(t, SHINGLE), lambda x: F.hash(x))


def _anchored(t: Column, words: Column) -> Column:
    """Shingles at the starts of ``words``; a line with few words uses every character."""
    shingle = lambda w, i: F.substring(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)), 1, ANCHORED)
    return F.when(F.size(words) * 20 >= F.char_length(t), F.transform(words, lambda w, i: F.hash(shingle(w, i)))).otherwise(_every(t))


def _bands(sketch: Column, scheme: int) -> Column:
    """Keys of all pairs among the smallest hashes, each with the next smallest hash for its order."""
    pairs = list(combinations(range(SKETCH), 2))
    rank = F.coalesce(F.get(sketch, F.lit(SKETCH)), F.lit(0)).cast("long")
    keys = [
        F.when(F.size(sketch) > b, F.struct(F.xxhash64(F.lit(scheme), F.get(sketch, F.lit(a)), F.get(sketch, F.lit(b))).alias("key"), rank.alias("rank")))
        for a, b in pairs
    ]
    single = F.when(F.size(sketch) == 1, F.struct(F.xxhash64(F.lit(scheme), F.get(sketch, F.lit(0))).alias("key"), rank.alias("rank")))
    return F.array_compact(F.array(*keys, single))


def raw_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, raw): mark is the hash of the text."""
    return docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw")
    )


def folded(lines: DataFrame, min_chars: int) -> DataFrame:
    """``raw`` replaced by ``line``, its folded form, where that is long enough."""
    kept = [c for c in lines.columns if c != "raw"]
    lower = lines.where(F.char_length("raw") >= min_chars).select(*kept, F.lower("raw").alias("low"))
    return lower.select(*kept, folded_line(F.col("low")).alias("line")).where(F.char_length("line") >= min_chars)


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """(a, b) node pairs that meet in a band of ``keys(node, key, rank)``: each node with the first and its predecessor."""
    inside = Window.partitionBy("key").orderBy("rank", "node")
    first = F.first("node").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = keys.select("node", first.alias("x"), F.lag("node", 1).over(inside).alias("y"))
    pairs = met.select("node", F.explode(F.array("x", "y")).alias("o")).where("o <> node")
    return pairs.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct()


def _bitmap(grams: Column) -> Column:
    """``WORDS`` words of parities of hashed shingles; a bit that differs between two sets is a shingle that differs, also where a long line fills the words."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x, 8), F.lit(64)).cast("int"))
    word = lambda g, k: F.aggregate(F.filter(g, lambda x: F.pmod(x, F.lit(WORDS)) == k), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))
    # a lambda's argument is evaluated once, so the shingles are cut once and not once a word
    return F.transform(F.array(F.array_distinct(grams)), lambda g: F.array(*[word(g, k) for k in range(WORDS)]))[0]


def crossing_pairs(inside: DataFrame, bits: DataFrame, similarity: float, tile: int | None = None) -> DataFrame:
    """(a, b) of different components in a band of ``inside(key, node, comp)`` whose ``bits(node, m, bits)`` allow the similarity."""
    return measured_pairs(inside, bits, similarity, tile).select("a", "b")


def measured_pairs(inside: DataFrame, bits: DataFrame, similarity: float, tile: int | None = None) -> DataFrame:
    """The same as (a, b, differ), with the number of bits that differ.

    A component of more than ``tile`` lines has chunks of its own, the others share chunks; tiles
    are pairs of chunks of a band, without those inside one component.
    """
    tile = tile or TILE
    marks = [F.bit_xor(F.xxhash64("node")).alias("mx"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("my")]
    whole = inside.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("w"), *marks)
    rest = F.sum(F.when(F.col("w") <= tile, F.col("w")).otherwise(0))
    crowd = whole.groupBy("key").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("comps"), rest.alias("rest"), F.bit_xor("mx").alias("mx"), F.bit_xor("my").alias("my"))
    # lines that share three hashes share three bands: those with the same members name the same pairs
    crowd = crowd.where("all > 3 and comps > 1").groupBy("all", "rest", "mx", "my").agg(F.min("key").alias("key")).select("key", "rest")
    sizes = whole.drop("mx", "my").join(crowd, "key").withColumn("own", F.when(F.col("w") > tile, F.col("comp")))
    members = inside.join(sizes, ["key", "comp"]).join(bits, "node")
    part = lambda of, n: F.pmod(F.xxhash64(of), F.ceil(n / tile))
    chunk = F.when(F.col("own").isNotNull(), part("node", F.col("w"))).otherwise(part("comp", F.greatest("rest", F.lit(1))))
    chunk = F.xxhash64("own", chunk).alias("chunk")
    packs = members.groupBy("key", "own", chunk).agg(F.collect_list(F.struct("node", "comp", "m", "bits")).alias("some"))
    packs = stored(packs, "packs")
    one = lambda x: packs.select("key", F.col("chunk").alias("c" + x), F.col("some").alias(x))
    names = packs.select("key", "chunk", "own")
    tiles = names.select("key", F.col("chunk").alias("cx"), F.col("own").alias("ox")).join(names.select("key", F.col("chunk").alias("cy"), F.col("own").alias("oy")), "key")
    tiles = tiles.where("cx <= cy and not (ox is not null and oy is not null and ox = oy)").select("key", "cx", "cy")
    share = (1 - similarity) / (1 + similarity) + 1e-9

    def differ(x: Column, y: Column) -> Column:
        return sum((F.bit_count(x["bits"][k].bitwiseXOR(y["bits"][k])) for k in range(1, WORDS)), F.bit_count(x["bits"][0].bitwiseXOR(y["bits"][0])))

    def allowed(x: Column, y: Column) -> Column:
        total = x["m"] + y["m"]
        apart = (x["comp"] != y["comp"]) & ((F.col("cx") != F.col("cy")) | (x["node"] < y["node"]))
        return apart & (F.abs(x["m"] - y["m"]) <= share * total) & (differ(x, y) <= share * total)

    ends = lambda x, y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"), differ(x, y).alias("differ"))
    found = F.flatten(F.transform("x", lambda x: F.transform(F.filter("y", lambda y: allowed(x, y)), lambda y: ends(x, y))))
    return tiles.join(one("x"), ["key", "cx"]).join(one("y"), ["key", "cy"]).select(F.inline(found)).distinct()


def verified_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose ``texts(node, line, m)`` are similar enough, m being the distinct shingles."""
    left, right = texts.select(F.col("node").alias("a"), F.col("line").alias("ta"), F.col("m").alias("ma")), texts.select(F.col("node").alias("b"), F.col("line").alias("tb"), F.col("m").alias("mb"))
    # a lambda's argument is evaluated once, so each pair is intersected once
    both = F.size(F.array_intersect(_grams(F.col("ta"), VERIFIED), _grams(F.col("tb"), VERIFIED)))
    alike = F.transform(F.array(both), lambda n: n >= similarity * (F.col("ma") + F.col("mb") - n))[0]
    near = F.least("ma", "mb") >= similarity * F.greatest("ma", "mb")
    return pairs.join(left, "a").join(right, "b").where(near & alike).select("a", "b")


def line_groups(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, nodes, groups): places are (doc_id, mark, line_no, node) of all lines that count,
    nodes (node, spot, copies) the different lines with their first place, groups (node, component)."""
    n = F.char_length("line")
    words = F.when(n >= LONG_CHARS, F.split("line", " "))
    lines = folded(raw_lines(docs), min_chars).select("*", F.xxhash64("line").alias("node"), n.alias("n"), words.alias("words"))
    short = F.when(n <= SHORT_CHARS, _smallest(_every(F.col("line"))))
    long = F.when(n >= LONG_CHARS, _smallest(_anchored(F.col("line"), F.col("words"))))
    seen = stored(lines.select("doc_id", "mark", "line_no", "node", short.alias("s0"), long.alias("s1")), "lines")
    places = seen.select("doc_id", "mark", "line_no", "node")
    # copies of a line have equal sketches: the aggregation leaves one row for each
    spot = F.struct("doc_id", "mark", "line_no")
    nodes = stored(seen.groupBy("node").agg(F.min(F.struct(spot.alias("spot"), "s0", "s1")).alias("f"), F.count(F.lit(1)).alias("copies")).select("node", "f.*", "copies"), "nodes")
    none = F.array().cast("array<struct<key:long,rank:long>>")
    bands = F.concat(F.coalesce(F.when(F.col("s0").isNotNull(), _bands(F.col("s0"), 0)), none), F.coalesce(F.when(F.col("s1").isNotNull(), _bands(F.col("s1"), 1)), none))
    pairs = stored(candidate_pairs(nodes.select("node", F.inline(bands))), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ends = stored(ends.join(nodes.select("node", "spot.*"), "node"), "ends")
    found = folded(raw_lines(docs).join(small(ends), ["doc_id", "mark", "line_no"]), min_chars).select("node", "line").dropDuplicates(["node"])
    texts = stored(found.withColumn("m", F.size(F.array_distinct(_grams(F.col("line"), VERIFIED)))), "texts")
    verified = stored(verified_pairs(pairs, texts, similarity), "verified")
    links = lambda v: connected_components(v.select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = links(verified)
    # every member of a band of two or more is in ends; bands still in several components are reopened
    comps = ends.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    inside = stored(nodes.join(small(stored(comps, "comps")), "node").select("node", "comp", F.inline(bands)).select("key", "node", "comp"), "inside")
    crowd = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("n > 3 and lo <> hi")
    inside = stored(inside.join(crowd.select("key"), "key", "left_semi"), "inside")
    crowded = stored(texts.join(inside.select("node").distinct(), "node", "left_semi").select("node", "m", _bitmap(_grams(F.col("line"), VERIFIED)).alias("bits")), "bits")
    more = stored(measured_pairs(inside, crowded, similarity).join(pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        # a line's nearest first: most of the others then lie inside one component
        nearest = lambda x, y: more.groupBy(x).agg(F.min(F.struct("differ", y))[y].alias(y)).select("a", "b")
        near = stored(nearest("a", "b").unionByName(nearest("b", "a")).distinct(), "near")
        known = stored(verified.unionByName(verified_pairs(near, texts, similarity)), "known")
        groups = links(known)
        of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias("comp_" + x))
        crossing = F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")
        rest = more.join(near, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where(crossing).select("a", "b")
        rest = stored(rest, "rest")
        if not rest.isEmpty():
            groups = links(known.unionByName(verified_pairs(rest, texts, similarity)))
        discard(near, known, rest)
    discard(pairs, ends, texts, verified, inside, more)
    return places, nodes.select("node", "spot", "copies"), groups


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the later lines of each group taken out of ``text``, and ``n_lines``, ``n_removed``."""
    total, gone = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    places, nodes, groups = line_groups(docs, similarity, min_chars)
    spot = F.struct("doc_id", "mark", "line_no")
    first_of = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = first_of.groupBy("component").agg(F.min("spot").alias("kept"), F.sum("copies").alias("n")).where("n > 1")
    # only lines that have a copy are looked at again
    heads = stored(first_of.select("node", "component").join(kept.drop("n"), "component").select("node", "kept"), "heads")
    id_, mark, drop = (free_name(docs, x) for x in ("id", "mark", "drop"))
    removed = places.join(heads, "node").where(spot != F.col("kept")).groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias(drop))
    removed = removed.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), drop)
    joined = docs.join(removed, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(mark)), "left")
    pieces = F.split("text", "\n")
    # a lambda's argument is evaluated once; the difference and the look-ups are linear in the lines, however many go
    stay = lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(drop)), lambda i: F.get(p, i))
    left = F.transform(F.array(pieces), lambda p: F.array_join(stay(p), "\n"))[0]
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(left)
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(
        *columns,
        F.coalesce(F.size(pieces), F.lit(0)).cast("long").alias(total),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(gone),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
