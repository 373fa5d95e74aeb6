"""How text filters interact: what each removes, alone and after the others, in every order of them.

Words are counted in a sparse document-term matrix. Batches of documents become CSR shards with a
dictionary of their own (row starts, word places, counts); all shards' words get one global
dictionary, in buckets by the words' hashes but told apart by their bytes, and each shard's words are encoded by it. A row's sum is the document's words and its
stored entries are its distinct words: these decide the filters A and B. The flags of the other
filters are found in the same pass over the bytes, but for E, the repeats, which meets texts by
their SHA-256 in sums over the table.

A shard holds SHARD_BYTES of text (a longer text stands alone) and its own words, once each, are
all that is shuffled of it besides the shard, so a word that stands everywhere meets the
dictionary once a shard. Buckets grow in number with the words. Rows are summed to counts by text, part and label before repeats are told.

Defined cases: a null text is empty and fails A alone, or E too after a smaller id without text; a
null part is the empty string; a row without id is no repeat and has no labels; repeated ids with
equal texts are no repeats of each other, and an id counts as good or toxic if any of its label
rows says so; an empty table gives no rows. Columns other than doc_id, text and lang take no part.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.llm.common import pieces, prefix_hash, span_hash, stored, utf8_parts, word_spans

LETTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, b"#$%&*|"
SHARD_BYTES = 6 << 20
#: Words of shards, each shard's once, that meet in one bucket of the global dictionary.
BUCKET_WORDS = 1 << 19

#: Arrays are stored as bytes of the smallest unsigned integers that hold them; wide and wide_n are their sizes.
SHARDS = "shard long, doc_id array<long>, part array<string>, flags binary, digest array<binary>, starts binary, entries binary, wide int, counts binary, wide_n int, n_words long, words array<binary>"
MATRIX = "shard long, doc_id array<long>, part array<string>, flags binary, digest array<binary>, starts binary, columns binary, counts binary, wide_n int"
IDS = "shard long, bucket int, ids binary, wide int, words array<binary>"


def _small(x: np.ndarray) -> tuple[bytes, int]:
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return x.astype(kind).tobytes(), kind.itemsize


def _wide(raw: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{wide}").astype(np.int64)


def _listed(flat: pa.Array) -> pa.Array:
    """A list column with one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def byte_flags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """C and D of each text, from counts of its bytes."""
    sums = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[offsets])
    capitals, points = sums((data >= 65) & (data <= 90)), sums((data & 0xC0) != 0x80)
    marked = sums(np.isin(data, np.frombuffer(MARKS, np.uint8))) > 0
    return (np.where(100 * capitals > CAPITAL_PERCENT * points, C, 0) | np.where(marked, D, 0)).astype(np.uint8)


def word_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = utf8_parts(words)
    return span_hash(prefix_hash(data), offsets[:-1], offsets[1:])


def csr(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row starts, word places, counts, words) of the documents' words; the dictionary is in the order of the words' hashes."""
    start, end, row = word_spans(data, offsets)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    ends = np.concatenate([[0], np.cumsum(end - start)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])]).dictionary_encode()
    order = np.argsort(word_hashes(coded.dictionary), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    size = max(1, len(order))
    pairs, counts = np.unique(row * size + place[coded.indices.to_numpy()], return_counts=True)
    return np.searchsorted(pairs, np.arange(len(offsets)) * size), pairs % size, counts, coded.dictionary.take(pa.array(order))


def local_shards(docs: DataFrame) -> DataFrame:
    """CSR shards of ``docs(doc_id, text, part)``, each with a dictionary of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, part = batch.column(0), batch.column(2)
            data, offsets = utf8_parts(batch.column(1))
            for i, j in pieces(offsets, SHARD_BYTES):
                own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, entries, counts, words = csr(own, off)
                digests = [hashlib.sha256(own[a:b]).digest() for a, b in itertools.pairwise(off)]
                (entries, wide), (counts, wide_n) = _small(entries), _small(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]), _listed(ids[i:j]), _listed(part[i:j]), pa.array([byte_flags(own, off).tobytes()]), _listed(pa.array(digests, pa.binary())), pa.array([starts.astype(np.int64).tobytes()]),
                        pa.array([entries]), pa.array([wide], pa.int32()), pa.array([counts]), pa.array([wide_n], pa.int32()), pa.array([len(words)]), _listed(words.cast(pa.binary())),
                    ],
                    names=[x.split()[0] for x in SHARDS.split(", ")],
                )
                number += 1
                pa.default_memory_pool().release_unused()  # else a worker keeps what its largest shard took

    return docs.select("doc_id", "text", "part").mapInArrow(run, SHARDS)


def numbered_words(local: DataFrame) -> DataFrame:
    """(shard, bucket, ids) for the words of each shard, and rows without a shard that hold a bucket's words.

    Words go to buckets by ranges of their hashes, so a shard's ids stand in the order of its words;
    there are as many buckets as the words of all shards ask for. A word is the k-th of bucket b: its id is k * buckets + b.
    """
    buckets = max(1, math.ceil((local.agg(F.sum("n_words")).first()[0] or 0) / BUCKET_WORDS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(1)[k].values
                bucket = ((word_hashes(words) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], pa.array([b], pa.int32()), _listed(words[edges[b] : edges[b + 1]])], names=["shard", "bucket", "words"])

    def number(table: pa.Table) -> pa.Table:
        bucket, lists = table.column("bucket")[0].as_py(), table.column("words").combine_chunks()
        coded = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        ids, size = coded.indices.to_numpy().astype(np.int64) * buckets + bucket, lists.value_lengths().to_numpy()
        cells = [_small(x) for x in np.split(ids, np.cumsum(size)[:-1])]
        out = {"shard": table.column("shard").to_pylist() + [None], "bucket": [bucket] * (len(cells) + 1), "ids": [x for x, _ in cells] + [None], "wide": [w for _, w in cells] + [None]}
        kinds = {"shard": pa.int64(), "bucket": pa.int32(), "ids": pa.binary(), "wide": pa.int32()}
        held = pa.concat_arrays([pa.nulls(len(cells), pa.list_(pa.binary())), _listed(coded.dictionary.cast(pa.binary()))])
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()} | {"words": held})

    dealt = local.select("shard", "words").mapInArrow(cut, "shard long, bucket int, words array<binary>")
    return stored(dealt.groupBy("bucket").applyInArrow(number, IDS), "word-ids").withColumn("buckets", F.lit(buckets))


def document_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix, dictionary): CSR shards whose columns are global word ids, and (word, id)."""
    local = stored(local_shards(docs), "shards")
    numbers = numbered_words(local)
    dictionary = numbers.where("shard is null").select("bucket", "buckets", F.posexplode("words").alias("k", "word")).select("word", (F.col("k").cast("long") * F.col("buckets") + F.col("bucket")).alias("id"))
    ids = numbers.where("shard is not null").select(F.col("shard").alias("of"), "bucket", "ids", F.col("wide").alias("wide_ids"))

    def encode(shard: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("bucket")
        places = np.concatenate([np.zeros(0, np.int64), *[_wide(x.as_py(), w.as_py()) for x, w in zip(own.column("ids"), own.column("wide_ids"), strict=True)]])
        columns = [places[_wide(raw.as_py(), wide.as_py())].tobytes() for raw, wide in zip(shard.column("entries"), shard.column("wide"), strict=True)]
        kept = {c: shard.column(c) for c in ("shard", "doc_id", "part", "flags", "digest", "starts")}
        return pa.table(kept | {"columns": pa.array(columns, pa.binary()), "counts": shard.column("counts"), "wide_n": shard.column("wide_n")})

    return local.drop("words", "n_words").groupBy("shard").cogroup(ids.groupBy("of")).applyInArrow(encode, MATRIX), dictionary


def word_counts(matrix: DataFrame) -> DataFrame:
    """(doc_id, part, digest, flags): row sums and stored entries decide A and B, beside the flags found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, k=k, batch=batch: batch.column(c)[k].as_py()
                starts = np.frombuffer(get("starts"), np.int64)
                sums = np.diff(np.concatenate([[0], np.cumsum(_wide(get("counts"), get("wide_n")))])[starts])
                distinct = np.diff(starts)
                flags = np.frombuffer(get("flags"), np.uint8) | np.where(sums < LEAST_WORDS, A, 0) | np.where(100 * distinct < DISTINCT_PERCENT * sums, B, 0)
                lists = [batch.column(c)[k].values for c in ("doc_id", "part", "digest")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(flags.astype(np.int32))], names=["doc_id", "part", "digest", "flags"])

    return matrix.mapInArrow(run, "doc_id long, part string, digest binary, flags int")


def flag_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, flags, good, toxic, n) with E set for the repeats of a smaller id's text."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    told = flags.join(marks, "doc_id", "left").select("doc_id", "digest", "part", "flags", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    kind = ["digest", "part", "flags", "good", "toxic"]
    rows = told.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    unnamed = F.when(F.col("doc_id").isNull(), F.col("n"))
    groups = rows.groupBy(*kind).agg(F.min(named).alias("low"), F.sum("n").alias("n"), F.coalesce(F.sum(unnamed), F.lit(0)).alias("unnamed"))
    least = F.min("low.doc_id").over(Window.partitionBy("digest"))
    first = F.when(F.col("low.doc_id") == least, F.col("low.n")).otherwise(0) + F.col("unnamed")
    parts = groups.withColumn("first", first).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("flags", F.col("first").alias("n")), F.struct(F.col("flags").bitwiseOR(E).alias("flags"), (F.col("n") - F.col("first")).alias("n")))).alias("x")
    )
    return parts.groupBy("part", "x.flags", "good", "toxic").agg(F.sum("x.n").alias("n")).where("n > 0")


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step; bit k of ``flags`` is the k-th letter's failure."""
    steps = []
    for order in itertools.permutations(range(len(letters))):
        seen = 0
        for step, k in enumerate(order):
            steps.append((("".join(letters[x] for x in order)), step + 1, letters[k], 1 << k, seen))
            seen |= 1 << k
    # (a row for each order and step, a few hundred) meets the counts, at most 4 * 2 ** letters rows a part
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(x).alias("letter"), F.lit(b).alias("bit"), F.lit(p).alias("seen")) for o, s, x, b, p in steps])
    each = counts.withColumn("s", F.explode(listed)).select("part", "flags", "good", "toxic", "n", "s.*")
    fails, before = F.col("flags").bitwiseAND(F.col("bit")) != 0, F.col("flags").bitwiseAND(F.col("seen")) != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    out = each.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"),
        total(F.col("flags") == F.col("bit")).alias("unique_fails"), total(fails & ~before & F.col("good")).alias("good_lost"), total(fails & ~before & F.col("toxic")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters' report over whole texts, by language."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    matrix, _ = document_terms(named)
    counts = stored(flag_counts(word_counts(matrix), labels), "counts")
    return interactions(counts)
