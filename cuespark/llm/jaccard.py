"""Exact Jaccard self-join of documents on word n-grams, as components.

A document is the set of its distinct word shingles, each a 64-bit hash. The hash space is cut
into k parts; two sets that link differ in fewer elements than there are parts, so they agree on
at least one part (pigeonhole), and its fingerprint is a key that both hold. k depends on the
size band; a set that may link with the band below also holds that band's keys. Sets for which
too many parts are empty hold their prefix elements as keys as well, so no link is lost.

Keys only say which sets meet, and at scale most meet by chance. So each set leaves the first pass with
a sketch, one or two bits an element that hold the parity of the elements hashed to them: every bit
that differs is a differing element, so sketches bound each overlap from above. First each set is held
against one that it met, and the links found are joined to components. Then the other firsts of its
keys follow, where they are in another component, and what is left are keys whose members are in
several components, those with the same members once; these are the tiles, cut by size band and chunk
where they are large, and held by sketches, for pairs of different components only. Only sets of pairs
that pass the bound are read again and intersected exactly, as sorted arrays. A group of near copies
thus costs a few intersections a member, and no tile emits pairs of sets that are joined already.

Equal sets are joined by their digest and never compared. A key that several rows of a slice of
``BLOCK_BYTES`` of text hold leaves the slice once, so a key held by a third of all rows reaches
the shuffle once a slice. Keys move in packed blocks, a bucket of the key space at a time.

Defined cases: null or wordless text is the empty set, linked with nothing; a null doc_id is
returned with a null component; repeated ids are one node; with fewer than ``width`` words the
whole sequence is one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import (
    connected_components,
    discard,
    distinct_per_row,
    lower_ascii,
    mix64,
    pieces,
    shuffle_width,
    small,
    stored,
    utf8_parts,
    word_shingles,
)

SLICE_BYTES, BLOCK_BYTES = 1 << 20, 6 << 20  # text handled at once; text whose keys leave together
BUCKETS = 4  # of keys, a shuffle partition
FAN = 128  # sets held against one copy of another
BAND_GROWTH = 1.5
SPARE_PARTS = 3
SKETCH_BITS = 64  # at least; a power of two, 1 to 2 bits an element
TILE_ROWS = 4096


class Threshold:
    """Jaccard >= num / 100, in integers."""

    def __init__(self, num: int):
        if not 67 <= num <= 100:
            raise ValueError(f"the threshold must be a whole number from 67 to 100 (sizes of linked sets lie in neighbouring bands only there), not {num}")
        self.num = num
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * BAND_GROWTH)))
        self.bounds = np.array(bounds)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def parts(self, band: np.ndarray) -> np.ndarray:
        top = self.bounds[band + 1] - 1
        most = (top + top * 100 // self.num) * (100 - self.num) // (100 + self.num)
        return most + SPARE_PARTS

    def smallest_partner(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.num // 100)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - self.smallest_partner(n) + 1

    def links(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.num * (a + b - both)

    def least_overlap(self, total: np.ndarray) -> np.ndarray:
        """The smallest overlap with which sizes of this sum link."""
        return -(-total * self.num // (100 + self.num))


def _keys(rows: np.ndarray, hashes: np.ndarray, n: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all sets in a slice; rows and hashes are sorted and distinct."""
    out_r, out_k = [], []
    band = t.band(np.maximum(n, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    starved = np.zeros(len(n), bool)
    for lower in (0, 1):
        scheme = band - lower
        use = (n > 0) & (scheme >= 0)
        if lower:
            use &= t.smallest_partner(n) < t.bounds[band]
        if not use.any():
            continue
        k = np.where(use, t.parts(np.maximum(scheme, 0)), 0)
        on = use[rows]
        r, h = rows[on], hashes[on]
        part = ((h >> np.uint64(32)) * k[r].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        mixed = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), at)
        tag = (scheme[r[at]].astype(np.uint64) << np.uint64(40)) + part[at]
        out_r.append(r[at])
        out_k.append(mix64(mixed + mix64(tag + np.uint64(1))))
        filled = np.bincount(r[at], minlength=len(n))
        starved |= use & (k - filled >= SPARE_PARTS)
    for r in np.flatnonzero(starved):
        head = hashes[first[r] : first[r] + int(t.prefix(n[r]))]
        out_r.append(np.full(len(head), r))
        out_k.append(mix64(head + np.uint64(0x2545F4914F6CDD1D)))
    if not out_r:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_r), np.concatenate(out_k)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, rows, hashes, sizes) slice by slice."""
    data, offsets = utf8_parts(column)
    for i, j in pieces(offsets, SLICE_BYTES):
        part = lower_ascii(data[offsets[i] : offsets[j]])
        rows, hashes = distinct_per_row(*word_shingles(part, offsets[i : j + 1] - offsets[i], width))
        yield i, j, rows, hashes, np.bincount(rows, minlength=j - i)


def _blocks(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The same for ``BLOCK_BYTES`` of text, whose shingles are still cut slice by slice: they take 50 times the memory of the sets."""
    _, offsets = utf8_parts(column)
    for i, j in pieces(offsets, BLOCK_BYTES):
        parts = [(rows + a, hashes, n) for a, _, rows, hashes, n in _sets(column.slice(i, j - i), width)]
        yield i, j, *(np.concatenate(x) for x in zip(*parts, strict=True))


def sketches(rows: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each in bytes): a bit is the parity of the elements hashed to it, so a differing bit is a differing element."""
    size = sketch_bits(n)
    base = np.cumsum(size) - size
    at = base[rows] + (hashes & (size[rows] - 1).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=int(size.sum())) & 1).astype(np.uint8)), size // 8


def sketch_bits(n: np.ndarray) -> np.ndarray:
    return SKETCH_BITS << np.ceil(np.log2(np.maximum(n, SKETCH_BITS) / SKETCH_BITS)).astype(np.int64)


def _digest(rows: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    np.add.at(a, rows, mix64(hashes))
    np.add.at(b, rows, mix64(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)))
    return mix64(a + n.astype(np.uint64)), mix64(b ^ n.astype(np.uint64))


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64, copy=False).view(np.int64))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as planes of bytes: the high bytes of ids and of sorted keys shrink to nothing in a shuffle."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(block, np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]


#: Columns of each kind of block: a document's size and digest; a key and its holder; a meeting inside a slice.
SIZE, KEY, MEETING = 0, 1, 2
FIELDS = {SIZE: 4, KEY: 2, MEETING: 3}


def set_blocks(docs: DataFrame, width: int, threshold: int, buckets: int) -> DataFrame:
    """(bucket, kind, block, bits): what a slice of documents has for each bucket of keys, as one packed block; bits are the sketches of its sizes."""

    def sliced(ids: np.ndarray, i: int, rows: np.ndarray, hashes: np.ndarray, n: np.ndarray, t: Threshold) -> Iterator[tuple[int, int, bytes, bytes | None]]:
        a, b = _digest(rows, hashes, n)
        seen: dict[tuple[int, int], int] = {}
        same = np.array([seen.setdefault((int(a[r]), int(b[r])), r) if n[r] else r for r in range(len(n))], np.int64)
        fresh = same == np.arange(len(n))
        on = fresh[rows]
        r, k = _keys(rows[on], hashes[on], np.where(fresh, n, 0), t)
        whole = np.flatnonzero(fresh & (n > 0))
        r, k = np.concatenate([r, whole]).astype(np.int64), np.concatenate([k, a[whole] ^ b[whole]])
        order = np.lexsort((ids[r], k))
        r, k = r[order], k[order]
        new = np.ones(len(r), bool)
        new[1:] = k[1:] != k[:-1]
        lead = r[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))] if len(r) else r
        copies = np.flatnonzero(~fresh)
        u, v = np.concatenate([ids[r[~new]], ids[copies]]), np.concatenate([ids[lead[~new]], ids[same[copies]]])
        any_bucket = int(mix64(np.array([i], np.int64).view(np.uint64))[0] % np.uint64(buckets))
        yield any_bucket, SIZE, packed(ids, n.astype(np.int64), a, b), sketches(rows, hashes, n)[0].tobytes()
        if len(u):
            yield any_bucket, MEETING, packed(np.concatenate([k[~new], np.zeros(len(copies), np.uint64)]), u, v), None
        # keys are sorted, so each bucket is a range of them
        k, held = k[new], ids[r[new]]
        bucket = ((k >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        for x, y in zip(at, [*at[1:], len(k)], strict=False):
            yield int(bucket[x]), KEY, packed(k[x:y], held[x:y]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Threshold(threshold)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, rows, hashes, n in _blocks(batch.column(1), width):
                out = list(sliced(ids[i:j], int(ids[i]), rows, hashes, n, t))
                where, kind, block, bits = zip(*out, strict=True)
                columns = [pa.array(where, pa.int32()), pa.array(kind, pa.int8()), pa.array(block, pa.binary()), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "block", "bits"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text"))
    return texts.mapInArrow(run, "bucket int, kind tinyint, block binary, bits binary")


def meetings(blocks: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds, one bucket at a time: SIZE (doc, n, h1, h2, bits) and MEETING (key, doc, lead), lead the key's least holder.

    A key that one document holds leaves no row. Tasks hold the keys of one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "doc", "lead", "n", "h1", "h2"]

        def rows(kind: int, bits: pa.Array | None = None, **columns: np.ndarray) -> pa.RecordBatch:
            m = len(columns["doc"])
            fixed = [pa.array(np.full(m, kind, np.int8))] + [_i64(columns.get(c, np.zeros(m, np.uint64))) for c in names[1:]]
            return pa.RecordBatch.from_arrays([*fixed, pa.nulls(m, pa.binary()) if bits is None else bits], [*names, "bits"])

        for table in runs(batches, "bucket"):
            kinds = table.column("kind").to_numpy()
            blocks = table.column("block")
            parts: dict[int, list] = {SIZE: [], KEY: [], MEETING: []}
            for at, kind in enumerate(kinds):
                parts[int(kind)].append(unpacked(blocks[at].as_buffer(), FIELDS[int(kind)]))
            joined = {kind: [np.concatenate(c) for c in zip(*got, strict=True)] for kind, got in parts.items() if got}
            if SIZE in joined:
                doc, n, a, b = joined[SIZE]
                ends = np.cumsum(np.concatenate([[0], sketch_bits(n.view(np.int64)) // 8]))
                all_bits = pa.py_buffer(b"".join(x for x in table.column("bits").to_pylist() if x is not None))
                bits = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), all_bits]).cast(pa.binary())
                yield rows(SIZE, bits, doc=doc, n=n, h1=a, h2=b)
            if MEETING in joined:
                key, doc, lead = joined[MEETING]
                yield rows(MEETING, key=key, doc=doc, lead=lead)
            if KEY in joined:
                key, doc = joined[KEY]
                order = np.lexsort((doc.view(np.int64), key))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                lead = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
                met = lead != doc
                yield rows(MEETING, key=key[met], doc=doc[met], lead=lead[met])

    schema = "kind tinyint, key long, doc long, lead long, n long, h1 long, h2 long, bits binary"
    return blocks.repartition(width, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def folded_bits(x: np.ndarray, words: int) -> np.ndarray:
    """The sketch that the same elements have in ``words`` 64-bit words."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def differing(x: np.ndarray, y: np.ndarray) -> int:
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded_bits(x, words) ^ folded_bits(y, words)).sum(dtype=np.int64))


def set_arrays(docs: DataFrame, width: int) -> DataFrame:
    """(extra columns, n, elements) with the sorted set as bytes."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i, j, rows, hashes, n in _sets(batch.column(at), width):
                ends = np.cumsum(n)
                sets = [hashes[e - m : e] for e, m in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in kept]
                    + [pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())],
                    [*kept, "n", "elements"],
                )

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{fields}, n long, elements binary")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows that share ``key``, from a partition in which they stand together."""
    open_: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for i, j in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if open_ and k[i] != last:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(i, j - i))
            last = k[i]
    if open_:
        yield pa.Table.from_batches(open_)


def _tile_pairs(table: pa.Table, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components in a tile whose sketches allow a link."""
    rep, n, comp, side = (table.column(c).to_numpy() for c in ("rep", "n", "comp", "side"))
    order = np.argsort(n, kind="stable")
    rep, n, comp, side = rep[order], n[order], comp[order], side[order]
    raw = table.column("bits").to_pylist()
    bits = [np.frombuffer(raw[k], np.uint64) for k in order]
    words = np.array([len(x) for x in bits])  # grows with n, so equal lengths stand together
    spans = [(np.searchsorted(words, w), np.searchsorted(words, w, "right")) for w in np.unique(words)]
    tables = [np.stack(bits[a:b]) for a, b in spans]
    low = np.searchsorted(n, t.smallest_partner(n), "left")
    u, v = [], []
    for i in range(1, len(rep)):
        for (a, b), rows in zip(spans, tables, strict=True):
            j = np.arange(max(a, low[i]), min(b, i))
            j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] == 2))]
            if len(j):
                differ = np.bitwise_count(rows[j - a] ^ folded_bits(bits[i], rows.shape[1])).sum(1, dtype=np.int64)
                total = n[j] + n[i]
                j = j[(total - differ) // 2 >= t.least_overlap(total)]
                u.append(np.full(len(j), rep[i]))
                v.append(rep[j])
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64),) * 2


def tile_pairs(tiles: DataFrame, threshold: int) -> DataFrame:
    """(a, b) with a < b from rows (tile, rep, n, comp, side, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Threshold(threshold)
        for table in runs(batches, "tile"):
            u, v = _tile_pairs(table, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

    dealt = tiles.repartition(shuffle_width(tiles.sparkSession), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def held_against(pairs: DataFrame, sets: DataFrame, column: str, judge) -> DataFrame:
    """The (a, b) of ``pairs`` that ``judge(x, n_x, y, n_y)`` keeps, x and y being the ends' ``column`` as 64-bit words.

    Each b moves once a pair; each a moves once for ``FAN`` of its partners and stands before them
    in its partition, so a task holds one a and the batch that passes by, whatever a's partners.
    """
    width = shuffle_width(pairs.sparkSession)
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fans"))
    firsts = sets.join(small(stored(fans, "fans")), F.col("rep") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.lit(None).cast("long").alias("b"), "n", F.col(column).alias("x"))
    partners = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("fan"), "b")
    seconds = sets.join(small(stored(partners, "partners")), F.col("rep") == F.col("b")).select("a", "fan", "b", "n", F.col(column).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n, x = None, 0, None
        for batch in batches:
            keep = []
            for k, (one, other, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                words = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64)
                if other is None:
                    a, n, x = one, size, words.copy()
                elif one == a and judge(x, n, words, size):
                    keep.append(k)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2)], ["a", "b"])

    dealt = firsts.unionByName(seconds).repartition(width, "a", "fan").sortWithinPartitions("a", "fan", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def exact_links(pairs: DataFrame, sketched: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The (a, b) that link: sketches first, then the sorted sets of those whose bound allows it, which ``docs(rep, text)`` gives."""
    t = Threshold(threshold)

    def bounded(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
        near = 100 * min(n, m) >= threshold * max(n, m)
        return near and (n + m - differing(x, y)) // 2 >= int(t.least_overlap(np.int64(n + m)))

    def linked(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
        return t.links(len(np.intersect1d(x, y, assume_unique=True)), n, m)

    passed = stored(held_against(pairs, sketched, "bits", bounded), "bounded")
    wanted = stored(passed.select(F.col("a").alias("rep")).unionByName(passed.select(F.col("b").alias("rep"))).distinct(), "wanted")
    sets = stored(set_arrays(docs.join(small(wanted), "rep"), width), "sets")
    links = stored(held_against(passed, sets, "elements", linked), "exact")
    discard(passed, wanted, sets)
    return links


def jaccard_components(docs: DataFrame, width: int = 4, threshold: int = 85, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    width_ = shuffle_width(docs.sparkSession)
    held = stored(meetings(set_blocks(docs, width, threshold, BUCKETS * width_), width_), "held")
    sizes = held.where(f"kind = {SIZE}").select("doc", "n", "h1", "h2", "bits")
    meets = held.where(f"kind = {MEETING}").select("key", "doc", "lead")
    # one document stands for each set; only documents that met another take part
    met = stored(meets.select("doc", "lead").distinct(), "met")
    nodes = met.select("doc").unionByName(met.select(F.col("lead").alias("doc"))).distinct()
    sets = stored(sizes.drop("bits").where("n > 0").join(nodes, "doc"), "nodes")
    reps = sets.groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"))
    rep_of = stored(sets.join(reps, ["n", "h1", "h2"]).groupBy("doc").agg(F.min("rep").alias("rep")), "reps")
    end = lambda c, to: rep_of.select(F.col("doc").alias(c), F.col("rep").alias(to))
    by_rep = met.join(end("doc", "x"), "doc").join(end("lead", "y"), "lead").where("x <> y")
    pair = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    by_rep = stored(by_rep.select("x", "y").distinct(), "star")
    star = stored(pair(by_rep), "star")
    # one meeting a set comes first; the others are looked at only if they still cross components
    first_star = stored(pair(by_rep.groupBy("x").agg(F.min("y").alias("y"))), "star")
    wanted = stored(star.select(F.col("a").alias("rep")).unionByName(star.select(F.col("b").alias("rep"))).distinct(), "wanted")
    discard(sets, by_rep)
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text")
    sketched = stored(sizes.select(F.col("doc").alias("rep"), "n", "bits").join(small(wanted), "rep").distinct(), "sketches")
    links = exact_links(first_star, sketched, text, width, threshold)
    joined = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # keys whose members are still in several components
    comp_of = rep_of.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc", "rep", F.coalesce("component", "rep").alias("comp"))
    comp_of = stored(comp_of, "comps")
    first = comp_of.select(F.col("doc").alias("lead"), F.col("comp").alias("lead_comp"))
    apart = met.join(comp_of, "doc").join(first, "lead").where("comp <> lead_comp").select("doc", "lead")
    open_keys = meets.join(apart, ["doc", "lead"], "left_semi").select("key").where("key <> 0").distinct()
    inside = meets.join(open_keys, "key", "left_semi")
    inside = inside.select("key", "doc").unionByName(inside.select("key", F.col("lead").alias("doc"))).join(comp_of, "doc").select("key", "rep", "comp").distinct()
    inside = stored(inside, "inside")
    members = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")]
    crowd = inside.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *members).where("m > 2 and lo <> hi")
    # near copies share hundreds of keys: those with the same members name the same pairs
    crowd = crowd.groupBy("m", "x", "y").agg(F.min("key").alias("key"))
    open_ = inside.join(crowd.select("key", F.ceil(F.col("m") / tile_rows).cast("int").alias("chunks")), "key").join(sketched, "rep")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / threshold)).cast("long")
    cells = open_.withColumn("band", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(band, band + 1))))
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
    tiles = cells.select("rep", "n", "comp", "bits", side.alias("side"), F.xxhash64("key", "band", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"))
    more = tile_pairs(tiles, threshold).join(star, ["a", "b"], "left_anti")
    of = lambda x: comp_of.where("doc = rep").select(F.col("rep").alias(x), F.col("comp").alias("comp_" + x))
    rest = star.join(first_star, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b").select("a", "b")
    more = stored(more.unionByName(rest), "pairs")
    if not more.isEmpty():
        links = links.unionByName(exact_links(more, sketched, text, width, threshold))
        joined = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(sketched, inside, met, more, first_star, star, wanted)
    place = rep_of.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc", F.coalesce("component", "rep").alias("root"))
    known = sizes.join(place, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
    unnamed = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text")
    counts = set_arrays(unnamed, width).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(counts)
