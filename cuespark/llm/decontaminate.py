"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words (letters and digits, case folded). A window of
an item's size is a leak if the item is within ``slack`` of its words in edit distance of some
run of words there, or if it has ``SHORT_ITEM`` words at least, no more than ``CHAR_WORDS`` of them
edited, and its letters, words parted by one blank, are within ``CHAR_SLACK`` of their number of
those of the window (light character noise spoils many words at once).

The CGK random walk writes a window as a string of symbols in which few edits become few differing
places. A window is laid at every word of every document, and the walk of its first ``STEPS``
symbols is sampled ``SAMPLES`` times at ``PLACES`` places, in each of ``WALKS`` walks. An item is
embedded from each of its words on, so that a leak has as many trials as the item has words; a
sample that would leave the item is not used. A window and an item that agree in a sample have a
hit; those with ``LEAST_HITS`` within the item's edits (one in items of fewer than ``FEW_TRIALS``
words, which also have samples of fewer places) meet, and what meets is verified exactly by the edit distance with free ends. Items of fewer than
``GRAM_ITEM`` words, too few for many trials, meet by a word q-gram that their edits must leave
whole, those of fewer than ``SHORT_ITEM`` words by that alone.

Every row is handled on its own, so there is no shuffle; the items go to the tasks in blocks
of bounded size, one pass over the documents for each block. Defined cases: null or wordless
texts and items match nothing; repeated items each report; rows keep their order and columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespark.llm.common import combine, free_name, mix64, pieces, prefix_hash, span_hash, utf8_parts

SLACK, CHAR_SLACK, CHAR_WORDS = 0.2, 0.1, 0.7
WALKS, SAMPLES, PLACES, LEAST_HITS = 2, 6, 7, 3
STEPS = (14, 20, 28)  # of a walk; the samples take these in turn
FEW_TRIALS = 24  # words; shorter items have samples of their own, and one hit is enough
SAMPLES_SHORT, PLACES_SHORT, STEPS_SHORT = 4, 5, 10
SHORT_ITEM, GRAM_ITEM = 8, 12  # words; items between them meet both ways
WINDOWS, PAIRS, PAIR_WORDS = 1 << 15, 256, 1 << 17  # embedded and verified at a time, and words of the items of those
BLOCK_BYTES = 2 << 20
SLICE_BYTES = 2 << 20
LEAKS = "array<struct<item_id:long,start:long,words:long,distance:long>>"


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of every word: runs of ASCII letters and digits and of other letters' bytes."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    solid = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    two = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] < 0xC0))  # Latin-1 marks and spaces
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else two[:0]  # dashes and quotes
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            solid[at + k] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, span_hash(prefix_hash(data), start, end), start, end


def gram_length(w: int, k: int) -> int:
    """The longest q with w - q + 1 - q * k >= 1."""
    return max(1, min(w, w // (k + 1)))


def spaced(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The words with an end mark 0 after those of each row; the word k of row r stands at k + r."""
    n = int(row[-1]) + 1 if len(row) else 0
    out = np.zeros(len(h) + n, np.uint64)
    out[np.arange(len(h)) + row] = h
    return out


def coins(words: np.ndarray, walk: int) -> np.ndarray:
    """The coins of each word, a bit for each of at most 32 steps; an end mark's are 0, so a walk stays there."""
    out = (mix64(words ^ mix64(np.array([walk + 1], np.uint64))) >> np.uint64(32)).astype(np.uint32)
    out[words == 0] = 0
    return out


def cgk(words: np.ndarray, tossed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of symbols for each step of the walk with ``coins`` tossed, for the windows that start ``at``."""
    out = np.empty((max(STEPS), len(at)), np.uint64)
    at = at.copy()
    for j in range(max(STEPS)):
        np.take(words, at, out=out[j])
        at += (np.take(tossed, at) >> np.uint32(j)) & np.uint32(1)
    return out


def _samples() -> list[list[tuple[np.ndarray, int]]]:
    """(places, longest item) of each sample of each walk."""
    rng = np.random.default_rng(2024)
    draw = lambda steps, places: np.sort(rng.choice(steps, places, replace=False))
    every = lambda: [(draw(STEPS[k % len(STEPS)], PLACES), 1 << 30) for k in range(SAMPLES)]
    return [[*every(), *((draw(STEPS_SHORT, PLACES_SHORT), FEW_TRIALS - 1) for _ in range(SAMPLES_SHORT))] for _ in range(WALKS)]


PLANS = _samples()


def edit_distance(items: np.ndarray, size: np.ndarray, texts: np.ndarray, extent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end) of each item against the nearest run of its text, both padded row-wise."""
    n, v = len(items), texts.shape[1]
    column = np.arange(v + 1, dtype=np.int32)
    row = np.zeros((n, v + 1), np.int32)
    far = np.int32(1 << 30)
    best, end = np.full(n, far), np.zeros(n, np.int64)
    outside = column[None, :] > extent[:, None]
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        np.add(row[:, :-1], texts != items[:, i : i + 1], out=new[:, 1:])
        np.minimum(new[:, 1:], row[:, 1:] + 1, out=new[:, 1:])
        new[:, 0] = row[:, 0] + 1
        new -= column
        row = np.minimum.accumulate(new, 1)
        row += column
        done = np.flatnonzero(size == i + 1)
        if len(done):
            score = np.where(outside[done], far, row[done])
            end[done] = score.argmin(1)
            best[done] = score.min(1)
    return best.astype(np.int64), end


def letters_apart(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The edit distance of each first text from the nearest run of the second, in letters."""
    code = lambda x: np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    both = [(code(a), code(b)) for a, b in pairs]
    size, extent = np.array([len(a) for a, _ in both]), np.array([len(b) for _, b in both])
    left, right = np.zeros((len(both), size.max()), np.uint32), np.zeros((len(both), extent.max()), np.uint32)
    for k, (a, b) in enumerate(both):
        left[k, : len(a)], right[k, : len(b)] = a, b
    return edit_distance(left, size, right, extent)[0]


@dataclass
class Items:
    """A block of benchmark items, ready for look-up; ``spelt`` are their words parted by blanks. Items stand one after another, so a long one takes no more than its own words."""

    ids: np.ndarray
    words: list[np.ndarray]
    spelt: list[bytes] | None = None

    def __post_init__(self):
        self.size = np.array([len(w) for w in self.words])
        self.edits = np.array([math.floor(SLACK * len(w) + 1e-9) for w in self.words])
        self.grams = self._short_grams()
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.first = np.cumsum(self.size) - self.size
        self.sampled = self._sampled()

    def _short_grams(self) -> dict[int, tuple]:
        grams: dict[int, list] = {}
        for i in np.flatnonzero(self.size < GRAM_ITEM):
            q = gram_length(int(self.size[i]), int(self.edits[i]))
            grams.setdefault(q, []).extend((int(g), i, o) for o, g in enumerate(combine(self.words[i], q)))
        return {q: _look_up(*(np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.uint64, np.int32, np.int32), strict=True))) for q, found in grams.items()}

    def _sampled(self) -> list[list[tuple]]:
        """For each walk and sample, the keys of all items from each of their words on."""
        on = np.flatnonzero(self.size >= SHORT_ITEM)
        if not len(on):
            return []
        row = np.repeat(np.arange(len(on)), self.size[on])
        words = spaced(row, np.concatenate([self.words[i] for i in on]))
        at = np.arange(len(row)) + row
        offset = np.arange(len(row)) - np.repeat(np.cumsum(self.size[on]) - self.size[on], self.size[on])
        out = []
        for walk in range(WALKS):
            symbols = cgk(words, coins(words, walk), at)
            usable = [(symbols[places] != 0).all(0) & (self.size[on[row]] <= most) for places, most in PLANS[walk]]
            out.append([_look_up(_key(symbols, p)[u], on[row[u]].astype(np.int32), offset[u].astype(np.int32)) for (p, _), u in zip(PLANS[walk], usable, strict=True)])
        return out

    def windows(self, row: np.ndarray, h: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, start) of the windows that meet an item; start counts words of the row."""
        found = []

        def add(p: np.ndarray, i: np.ndarray, o: np.ndarray, hits: int):
            if len(p):
                r = row[p]
                found.append(np.stack([r, i, np.clip(p - first[r] - o, 0, np.maximum(0, count[r] - self.size[i])), np.full(len(r), hits)]))

        for q, known in self.grams.items():
            g = combine(h, q)
            at = np.flatnonzero(row[: len(g)] == row[q - 1 :]) if len(g) else np.zeros(0, np.int64)
            add(*_matches(known, g[at], at), LEAST_HITS)
        if self.sampled:
            words = spaced(row, h)
            for walk in range(WALKS):
                tossed = coins(words, walk)
                for a in range(0, len(h), WINDOWS):
                    p = np.arange(a, min(a + WINDOWS, len(h)))
                    symbols = cgk(words, tossed, p + row[p])
                    for (places, _), known in zip(PLANS[walk], self.sampled[walk], strict=True):
                        add(*_matches(known, _key(symbols, places), p), 1)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        r, i, s, hits = np.concatenate(found, 1)
        # the hits of a leak begin within its edits of each other
        spread, pair = int(count.max()) + 2 * int(self.edits.max()) + 1, r * len(self.ids) + i
        key, back = np.unique(pair * spread + s, return_inverse=True)
        total = np.concatenate([[0], np.cumsum(np.bincount(back, hits))])
        pair, s = key // spread, key % spread
        i = pair % len(self.ids)
        around = total[np.searchsorted(key, key + self.edits[i], "right")] - total[np.searchsorted(key, pair * spread + np.maximum(0, s - self.edits[i]), "left")]
        on = around >= np.where(self.size[i] < FEW_TRIALS, 1, LEAST_HITS)
        return pair[on] // len(self.ids), i[on], s[on]

    def leaks(self, row: np.ndarray, h: np.ndarray, n_rows: int, spell: Callable[[int, int], bytes] | None = None) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, start, words, distance): the nearest window of each row and item; ``spell`` gives the letters of words."""
        count = np.bincount(row, minlength=n_rows)
        first = np.cumsum(count) - count
        r, i, s = self.windows(row, h, first, count)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        order = np.argsort(self.size[i], kind="stable")  # pairs of one length together
        a = 0
        while a < len(r):
            n = PAIRS
            while n > 1 and n * self.size[i[order[min(a + n, len(r)) - 1]]] > PAIR_WORDS:
                n //= 2
            rr, ii, ss = (x[order[a : a + n]] for x in (r, i, s))
            a += n
            begin = np.maximum(0, ss - self.edits[ii])
            size = np.minimum(ss + self.size[ii] + self.edits[ii], count[rr]) - begin
            lane = np.arange(size.max())[None, :]
            around = np.where(lane < size[:, None], h[np.minimum((first[rr] + begin)[:, None] + lane, len(h) - 1)], np.uint64(0))
            wide = np.arange(self.size[ii].max())[None, :]
            items = np.where(wide < self.size[ii][:, None], self.flat[np.minimum(self.first[ii][:, None] + wide, len(self.flat) - 1)], np.uint64(0))
            distance, end = edit_distance(items, self.size[ii], around, size)
            near = distance <= self.edits[ii]
            doubtful = np.flatnonzero(~near & (self.size[ii] >= SHORT_ITEM) & (distance <= CHAR_WORDS * self.size[ii])) if spell and self.spelt else []
            if len(doubtful):
                text = lambda k: spell(int(first[rr[k]] + begin[k]), int(first[rr[k]] + begin[k] + size[k]))
                for c in range(0, len(doubtful), 64):
                    some = doubtful[c : c + 64]
                    apart = letters_apart([(self.spelt[ii[k]], text(k)) for k in some])
                    near[some] = apart <= [CHAR_SLACK * len(self.spelt[ii[k]].decode("utf-8", "replace")) for k in some]
            for k in np.flatnonzero(near):
                stop = int(begin[k] + end[k])
                x = (int(distance[k]), max(int(begin[k]), stop - int(self.size[ii[k]])), stop)
                pair = (int(rr[k]), int(ii[k]))
                best[pair] = min(best.get(pair, x), x)
        return [(a, int(self.ids[b]), s, e - s, d) for (a, b), (d, s, e) in sorted(best.items())]


def _key(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    key = symbols[places[0]].copy()
    for p in places[1:]:
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += symbols[p]
    key *= np.uint64(0x9E3779B97F4A7C15)
    return key


def _look_up(key: np.ndarray, item: np.ndarray, offset: np.ndarray) -> tuple:
    """Sorted keys with their items and offsets, and a table of the keys' first bits, sized by their number."""
    order = np.argsort(key, kind="stable")
    bits = min(26, max(12, (32 * len(key)).bit_length()))
    seen = np.zeros(1 << bits, bool)
    seen[key >> np.uint64(64 - bits)] = True
    return key[order], item[order], offset[order], seen, bits


def _matches(known: tuple, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, item, offset) of each of ``key`` that is known, its position taken from ``at``."""
    keys, item, offset, seen, bits = known
    hit = np.flatnonzero(seen[key >> np.uint64(64 - bits)])
    lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
    times = hi - lo
    which = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(at[hit], times), item[which].astype(np.int64), offset[which].astype(np.int64)


def _spelt(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(start, end, strict=True))


def _block(rows: list) -> Items:
    data, offsets = utf8_parts(pa.array([r["t"] for r in rows], pa.string()))
    row, h, start, end = words_of(data, offsets)
    each = [np.flatnonzero(row == k) for k in range(len(rows))]
    on = [k for k, at in enumerate(each) if len(at)]
    return Items(np.array([rows[k]["item_id"] for k in on], np.int64), [h[each[k]] for k in on], [_spelt(data, start[each[k]], end[each[k]]) for k in on])


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` and, last, ``leaks`` (with a leading underscore if taken): one struct per benchmark item found in the row's whole text."""
    out, folded_text = free_name(docs, "leaks"), free_name(docs, "t")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), folded(F.col("text")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    result = docs.withColumn(out, F.expr(f"cast(array() as {LEAKS})")).withColumn(folded_text, folded(F.col("text")))
    for b in range(blocks):
        # a block holds BLOCK_BYTES of items on average, whatever the size of the benchmark
        rows = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).orderBy("item_id", "t").collect()
        result = _one_block(result, _block(rows), out, folded_text)
    return result.drop(folded_text)


def _one_block(docs: DataFrame, items: Items, out: str, text: str) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, to = names.index(text), names.index(out)
            data, offsets = utf8_parts(batch.column(at))
            for i, j in pieces(offsets, SLICE_BYTES):
                part = batch.slice(i, j - i)
                mine = data[offsets[i] : offsets[j]]
                row, h, start, end = words_of(mine, offsets[i : j + 1] - offsets[i])
                spell = lambda a, b: _spelt(mine, start[a:b], end[a:b])  # noqa: B023, E731
                found: list[list] = [x or [] for x in part.column(to).to_pylist()]
                for r, item, s, w, d in items.leaks(row, h, j - i, spell) if len(row) and len(items.words) else []:
                    found[r].append({"item_id": item, "start": s, "words": w, "distance": d})
                columns = [pa.array(found, part.column(to).type) if k == to else part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, item) found, with the words that match best and their distance."""
    marked = with_leaks(docs.select("doc_id", "text"), benchmark)
    return marked.select("doc_id", F.inline("leaks")).withColumnRenamed("start", "start_word")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, as they are."""
    marked = with_leaks(docs, benchmark)
    found = marked.columns[-1]
    return marked.where(F.size(F.col(f"`{found}`")) == 0).drop(found)
