"""Sequence packing along a space-filling curve.

Each document's hashed token counts are projected to three dimensions by random signs, and the
cell of that point gives a Hilbert key. Documents are range-sorted by the key, so neighbours on
the curve hold similar tokens, and their ids are laid end to end and cut every ``length`` ids:
all sequences are full but the last one. Only (row, key, count) takes part in the sort; the
ids move once, to meet their place.

Defined cases: a null or empty text has only the end id; repeated rows and ids are separate
documents (a row number of our own is the key); ties on the curve go by that number; a text of
any length is cut over as many sequences as it needs; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.llm.common import mix64, shuffle_width, stored

END_ID = 1
LENGTH = 2048
DIMS, BITS = 3, 12
TEXTS_AT_ONCE = 256
CACHED_WORDS = 700_000  # some 150 MB

_BEFORE_WORD = re.compile(r"(?= \S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words(dict):
    """Ids of words as bytes, all after ``lead``; an unknown word is encoded when it is first asked for."""

    def __init__(self, tokenizer: WordTokenizer, lead: str):
        super().__init__()
        self.tokenizer, self.lead, self.sign = tokenizer, lead, tokenizer.lead * len(lead)

    def __missing__(self, word: str) -> bytes:
        t = self.tokenizer
        base = word.rstrip(t.MARKS)
        if not base.isalpha():
            if word.split() != [word]:
                raise KeyError(word)
            ids = t.plain([self.lead + word])[0]
        elif len(base) < len(word):
            ids = self[base] + t.tail(word[len(base) :])
        else:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(t.signs)
            ids = array(t.code, [x.id for x in t.model.tokenize(self.sign + shown)]).tobytes()
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts as little-endian bytes, with the ids of words remembered.

    The vocabulary's pattern starts a new piece at a space before a visible character, and keeps
    a line feed between visible characters apart, so a text may be cut there and its words
    encoded one by one. An unknown word of letters, with marks after it, is two pieces and goes
    straight to the merges, its letters once for all marks; other unknown words are encoded as
    texts. A text with any other white space is cut before its words only and not remembered, and
    a text that spells one of the vocabulary's added tokens is encoded as a whole.
    """

    MARKS = ".,!?;:#$%&*|()\"'"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.inner.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.feed = self.plain(["\n"])[0]
        self.tails: dict[str, bytes] = {"": b""}
        self.model = self.inner.model
        # byte-level vocabularies write bytes that have no visible Latin-1 sign from U+0100 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.signs = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}
        self.lead = chr(self.signs[32])
        self.first, self.later = Words(self, ""), Words(self, " ")  # at the start of a line, after a space

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            if len(self.tails) > CACHED_WORDS:
                self.tails.clear()
            ids = self.tails[marks] = self.plain([marks])[0]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.later) > CACHED_WORDS:
            self.first.clear()
            self.later.clear()
        if any(s in t for s in self.special for t in texts):
            whole = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
            done = dict(zip(whole, self.plain([texts[k] for k in whole]), strict=True))
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in done]))
            return [done[k] if k in done else next(rest) for k in range(len(texts))]
        first, later, none = self.first.__getitem__, self.later.__getitem__, b""
        out: list[bytes] = []
        for text in texts:
            try:
                lines = []
                for line in text.split("\n"):
                    head, *words = line.split(" ")
                    lines.append(first(head) + none.join(map(later, words)))
                out.append(self.feed.join(lines))
            except KeyError:
                out.append(none.join(self.plain(_BEFORE_WORD.split(text))))
        return out


_LOADED: dict[str, WordTokenizer] = {}


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of integer points (rows of ``cells``), by Skilling's transpose."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            turned = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
            x[0] = turned
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros(len(cells), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


_SIGNS: dict[int, np.ndarray] = {}


def curve_key(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Hilbert keys of documents given as id arrays (each has one id at least)."""
    if vocabulary not in _SIGNS:
        each = np.arange(vocabulary, dtype=np.uint64)
        u = [mix64(each * np.uint64(DIMS) + np.uint64(d) + np.uint64(99)) / 2.0**64 for d in range(DIMS)]
        _SIGNS[vocabulary] = np.where(np.stack(u, 1) < 0.5, -1, 1).astype(np.float32)
    flat = np.concatenate(ids)
    n = np.array([len(x) for x in ids])
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    sums = np.add.reduceat(_SIGNS[vocabulary][flat], at, axis=0)
    z = sums / n[:, None] * 4.0  # the mean sign of a text's tokens is mostly within a quarter
    cells = np.clip((0.5 + 0.5 * np.tanh(z)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, row, curve, n, ids): ids as little-endian bytes, the end id last."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, WordTokenizer(tokenizer))
        end = np.array([END_ID], t.dtype).tobytes()
        vocabulary = max(t.inner.get_vocab_size(), END_ID + 1)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, TEXTS_AT_ONCE)
                raw = [x + end for x in t.encode([x or "" for x in part.column(1).to_pylist()])]
                ids = [np.frombuffer(x, t.dtype) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(curve_key(ids, vocabulary)), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "curve", "n", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, curve long, n long, ids binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def layout(counts: DataFrame) -> DataFrame:
    """(row, place) from (row, curve, n): where each document's ids begin on the curve."""
    spark = counts.sparkSession
    dealt = counts.repartitionByRange(shuffle_width(spark), "curve", "row").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "curve")
    # one row a partition; the sums give each partition its first place
    sums = dealt.groupBy("part").agg(F.sum("n").alias("all"))
    base = sums.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("curve", "row").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, "part").select("row", (F.col("base") + F.col("before")).alias("place"))


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ``ids`` (little-endian 32 bit)."""
    ids = stored(tokenized(docs, tokenizer), "ids")
    placed = ids.drop("curve").join(layout(ids.select("row", "curve", "n")), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(i, TEXTS_AT_ONCE)
                n, place, raw = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
                which, start, size, out = [], [], [], []
                for k in range(batch.num_rows):
                    width = len(raw[k]) // n[k]
                    one = np.frombuffer(raw[k], f"<u{width}").astype("<u4")
                    edges = [0, *range(length - int(place[k]) % length, int(n[k]), length), int(n[k])]
                    for a, b in zip(edges, edges[1:], strict=False):
                        which.append(k), start.append(a), size.append(b - a), out.append(one[a:b].tobytes())
                w, s = np.array(which, np.int64), np.array(start, np.int64)
                at = place[w] + s
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(w)), pa.array(s), pa.array(size, pa.int64()), pa.array(n[w])]
                    + [pa.array(at // length), pa.array(at % length), pa.array(out, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.select("doc_id", "n", "place", "ids").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of each sequence in their order; at most ``length`` pieces each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def piece_digest(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
