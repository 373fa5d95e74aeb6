"""Exact substring dedup: bytes covered by a string of ``length`` bytes that starts elsewhere too.

A suffix matters by its first ``length`` bytes, its head: two suffixes with equal heads are
neighbours in the suffix array. The array is built blockwise. Suffixes are dealt to buckets and
one bucket at a time is sorted, in bounded memory; equal neighbours are repeats. Within and
across buckets, heads are ordered by fingerprints, not by byte values: only equality is asked
for, and buckets then have even sizes whatever the texts hold.

Most suffixes are never sorted. The offsets that lie in a difference cover modulo ``v`` are
sampled: for any two suffixes there is a shift below v that takes both to sampled offsets.

1. Ranks of the sample's short strings (length - v + 1 bytes): a suffix whose next v offsets
   hold no sampled string that occurs twice has no equal, and is left out.
2. Ranks of the sample's long strings (length + v bytes), where the short ones repeat: a long
   string that occurs twice decides all suffixes from its start to v bytes on. Long ties, as in
   copies of whole documents, are settled here, and one copy, the leader, speaks for all.
3. Short strings that occur near a suffix still undecided are marked wherever they occur.
4. The undecided suffixes, at the ends of shared passages, are sorted bucket by bucket together
   with the leaders' decided suffixes near marked strings, which they may equal.

Documents are stored once as batches of bounded size, bucketed by batch. A batch sends the
distinct names of its strings to the buckets and gets one bit a name back, so text never moves
again, positions never move at all, and a string held by a third of all rows is sent once a
batch. Names have 40 bits for steps 1 and 3, where a chance equality only costs work, and 64 bits
besides the bucket, from another hash, for steps 2 and 4; buckets have a fixed size, so chance
equalities stay under one in ten million buckets.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; an occurrence
in the same document counts; repeated rows and ids are separate documents; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import mix64, scratch_path, span_hash, stored, utf8_parts
from cuespark.llm.common import prefix_hash as _prefix_hash

LENGTH = 200
MODULUS = 91
# A perfect difference set modulo 91, so each residue is a difference of two members.
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
BATCH_BYTES = 3 << 20
BUCKET_BYTES = 12 << 20
SHORT, LONG, MARK, HEAD, LEADER = range(5)  # kinds of names and answers
WIDTH = {SHORT: 5, LONG: 8, MARK: 5, HEAD: 8}  # bytes of a name


class _Batch:
    """The texts of one batch in a fixed order, end to end."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        raw = [x or b"" for x in table.column("raw").to_pylist()]
        order = sorted(range(len(raw)), key=lambda k: (ids[k] is not None, ids[k] or 0, raw[k]))
        self.ids = [ids[k] for k in order]
        self.data, self.offsets = utf8_parts(pa.array([raw[k] for k in order], pa.large_binary()))
        n = len(self.data)
        self.ends = np.repeat(self.offsets[1:], np.diff(self.offsets))
        self.inside = np.arange(n) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        self.prefix = _prefix_hash(self.data)
        self.other = _prefix_hash(self.data ^ np.uint8(0x5A)) if n else self.prefix

    def sample(self, length: int) -> np.ndarray:
        chosen = np.zeros(MODULUS, bool)
        chosen[list(COVER)] = True
        return np.flatnonzero(chosen[self.inside % MODULUS] & (np.arange(len(self.data)) + (length - MODULUS + 1) <= self.ends))

    def names(self, at: np.ndarray, length: int, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, name) of the strings of ``length`` bytes that start at ``at``."""
        h = span_hash(self.prefix, at, at + length)
        if kind in (SHORT, MARK):
            return ((h >> np.uint64(44)) * np.uint64(buckets)) >> np.uint64(20), h & np.uint64((1 << 40) - 1)
        g = mix64(span_hash(self.other, at, at + length) ^ np.uint64(0x94D049BB133111EB))
        return ((g >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24), h


def _send(bucket: np.ndarray, name: np.ndarray):
    """Distinct (bucket, name) in order and each input's place among them."""
    order = np.lexsort((name, bucket))
    b, n = bucket[order], name[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    place = np.empty(len(b), np.int64)
    place[order] = np.cumsum(new) - 1
    return b[new].astype(np.int64), n[new], place


_SENT = "batch long, bucket long, names binary, flags binary"


def _runs(bucket: np.ndarray) -> list[tuple[int, int]]:
    if not len(bucket):
        return []
    cuts = [int(x) for x in np.flatnonzero(np.diff(bucket)) + 1]
    return list(zip([0, *cuts], [*cuts, len(bucket)], strict=True))


def _rows(batch: int, bucket: np.ndarray, name: np.ndarray, flags: np.ndarray, width: int) -> pa.Table:
    parts = _runs(bucket)
    raw = np.ascontiguousarray(name.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return pa.table(
        {
            "batch": pa.array([batch] * len(parts), pa.int64()),
            "bucket": pa.array([int(bucket[a]) for a, _ in parts], pa.int64()),
            "names": pa.array([raw[a:b].tobytes() for a, b in parts], pa.binary()),
            "flags": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in parts], pa.binary()),
        }
    )


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n)).astype(bool)


def _sort_bucket(kind: int):
    """Sorts one bucket and answers each batch with a bit for each of its names.

    Does the name occur twice (the flag says so within a batch), is this its leader, or, for
    marks, is the flag set anywhere?
    """
    width = WIDTH[kind]

    def run(table: pa.Table) -> pa.Table:
        raw, flags = table.column("names").to_pylist(), table.column("flags").to_pylist()
        sizes = np.array([len(x) // width for x in raw])
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        wide[:, :width] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
        names = wide.view("<u8").ravel()
        del wide, raw
        order = np.argsort(names, kind="stable")
        names = names[order]
        first = np.ones(len(names), bool)
        first[1:] = names[1:] != names[:-1]
        heads = np.flatnonzero(first)
        flag = np.concatenate([_unpacked(f, n) for f, n in zip(flags, sizes, strict=True)])[order]
        yes = np.logical_or.reduceat(flag, heads)
        if kind != MARK:
            yes |= np.diff(np.append(heads, len(names))) > 1
        answer = np.zeros(len(names), bool)
        answer[order] = np.repeat(yes, np.diff(np.append(heads, len(names))))
        answers = {kind: answer}
        if kind == LONG:
            answers[LEADER] = np.zeros(len(names), bool)
            answers[LEADER][order[heads[yes]]] = True
        ends = np.cumsum(sizes)
        out: dict[str, list] = {"batch": [], "bucket": [], "kind": [], "bits": []}
        batches, bucket = table.column("batch").to_pylist(), table.column("bucket")[0].as_py()
        for which, bits in answers.items():
            for k, (e, n) in enumerate(zip(ends, sizes, strict=True)):
                if bits[e - n : e].any():
                    for c, x in zip(out, (batches[k], bucket, which, np.packbits(bits[e - n : e]).tobytes()), strict=True):
                        out[c].append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return run


class _Plan:
    """What a batch knows after the answers so far. ``buckets`` are the numbers of buckets by kind."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, length: int, buckets: dict[int, int]):
        self.batch = _Batch(table)
        self.length, self.buckets = length, buckets
        self.bits: dict[tuple[int, int], bytes] = {}
        if answers is not None and answers.num_rows:
            for k, b, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits")), strict=True):
                self.bits[k, b] = x

    def _answered(self, kind: int, sent: tuple) -> np.ndarray:
        """The bit of each distinct name."""
        bucket, yes = sent[0], np.zeros(len(sent[0]), bool)
        for a, b in _runs(bucket):
            bits = self.bits.get((kind, int(bucket[a])))
            if bits is not None:
                yes[a:b] = _unpacked(bits, b - a)
        return yes

    def _sent(self, kind: int, at: np.ndarray, size: int) -> tuple:
        return _send(*self.batch.names(at, size, kind, self.buckets[kind]))

    def _near(self, at: np.ndarray) -> np.ndarray:
        """Which suffixes have one of these sampled offsets in their next v."""
        low = at - np.minimum(self.batch.inside[at], MODULUS - 1)
        return _covered(len(self.batch.data), low, at + 1)

    def short(self):
        """Offsets, size of their strings and a flag for each; the same for the steps below."""
        at, size = self.batch.sample(self.length), self.length - MODULUS + 1
        return at, size, None

    def long(self):
        at, size, _ = self.short()
        sent = self._sent(SHORT, at, size)
        self.tied = at[self._answered(SHORT, sent)[sent[2]]]
        return self.tied[self.tied + self.length + MODULUS <= self.batch.ends[self.tied]], self.length + MODULUS, None

    def mark(self):
        at, size, _ = self.long()
        n = len(self.batch.data)
        sent = self._sent(LONG, at, size)
        settled = at[self._answered(LONG, sent)[sent[2]]]
        lead = self._answered(LEADER, sent)
        first = np.full(len(lead), -1)
        first[sent[2][::-1]] = np.arange(len(at))[::-1]
        leaders = at[first[lead]]
        self.settled = _covered(n, settled, settled + MODULUS + 1)
        self.leading = _covered(n, leaders, leaders + MODULUS + 1)
        whole = np.arange(n) + self.length <= self.batch.ends
        self.open = self._near(self.tied) & ~self.settled & whole
        count = np.concatenate([[0], np.cumsum(self.open)])
        low = self.tied - np.minimum(self.batch.inside[self.tied], MODULUS - 1)
        return self.tied, self.length - MODULUS + 1, count[self.tied + 1] > count[low]

    def heads(self):
        at, size, _ = self.mark()
        sent = self._sent(MARK, at, size)
        marked = at[self._answered(MARK, sent)[sent[2]]]
        return np.flatnonzero(self.open | (self.leading & self._near(marked))), self.length, None

    def removed(self) -> np.ndarray:
        """Bytes to remove."""
        at, size, _ = self.heads()
        sent = self._sent(HEAD, at, size)
        at = at[self._answered(HEAD, sent)[sent[2]]]
        starts = np.concatenate([np.flatnonzero(self.settled), at])
        return _covered(len(self.batch.data), starts, starts + self.length)


def _covered(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places lie in a range [low, high)."""
    depth = np.bincount(low, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(high, n), minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


def _batches(docs: DataFrame, total: int) -> DataFrame:
    """The texts as a table of batches, bucketed by batch, so that no later step moves them."""
    spark = docs.sparkSession
    count = max(1, math.ceil(total / BATCH_BYTES))
    files = max(1, math.ceil(count / 6))
    # the source partition salts the hash: repeated rows spread
    batch = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(count))
    dealt = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"), batch.alias("batch"))
    name = "batches_" + uuid.uuid4().hex
    (
        dealt.repartition(files, "batch").write.bucketBy(files, "batch").option("compression", "zstd")
        .option("path", scratch_path(spark, "batches")).saveAsTable(name)
    )
    return spark.table(name)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs(doc_id, text)``."""
    if length < 2 * MODULUS:
        raise ValueError(f"length must be {2 * MODULUS} or more")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    table = _batches(docs, total)
    need = math.ceil(total * len(COVER) / MODULUS * WIDTH[SHORT] / BUCKET_BYTES)
    buckets = {kind: max(1, need) for kind in WIDTH}
    answers: DataFrame | None = None

    def asked(kind: int, step: str) -> DataFrame:
        def ask(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
            plan = _Plan(left, right, length, buckets)
            at, size, flag = getattr(plan, step)()
            bucket, name, place = plan._sent(kind, at, size)
            times = np.bincount(place, flag, len(name)) > 0 if flag is not None else np.bincount(place, minlength=len(name)) > 1
            return _rows(left.column("batch")[0].as_py(), bucket, name, times, WIDTH[kind])

        sent = _with_answers(table, answers, ask, _SENT)
        got = sent.groupBy("bucket").applyInArrow(_sort_bucket(kind), "batch long, bucket long, kind int, bits binary")
        return stored(got, "answers")

    for kind, step in ((SHORT, "short"), (LONG, "long"), (MARK, "mark"), (HEAD, "heads")):
        got = asked(kind, step)
        answers = got if answers is None else answers.unionByName(got)

    def finish(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        plan = _Plan(left, right, length, buckets)
        gone = plan.removed()
        batch = plan.batch
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for k, (a, b) in enumerate(zip(batch.offsets, batch.offsets[1:], strict=False)):
            cut = gone[a:b]
            kept = batch.data[a:b][~cut].tobytes()
            out["doc_id"].append(batch.ids[k])
            out["n_bytes"].append(int(b - a))
            out["n_removed"].append(int(cut.sum()))
            out["n_spans"].append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_text else None)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    done = _with_answers(table, answers, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_text else done.drop("kept")


def _with_answers(table: DataFrame, answers: DataFrame | None, f, schema: str) -> DataFrame:
    if answers is None:
        return table.groupBy("batch").applyInArrow(lambda t: f(t), schema)
    both = lambda left, right: f(left, right) if left.num_rows else pa.schema(_empty(schema)).empty_table()
    return table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(both, schema)


def _empty(schema: str) -> list:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
