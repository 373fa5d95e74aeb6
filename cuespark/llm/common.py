"""Pieces the operators share: scratch tables, components, vectorised hashing.

Nothing here collects rows to the driver; the driver only sees counts.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only where none is set and the master is local (tests)."""
    named = spark.sparkContext.getConf().get(SCRATCH_KEY, None) or spark.conf.get(SCRATCH_KEY, None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{SCRATCH_KEY} must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cuespark-")
        spark.conf.set(SCRATCH_KEY, named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{re.sub(r'[^A-Za-z0-9_-]', '_', name)}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a cut in the lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that no later step reads, and let go of finished stages' shuffle files.

    Shuffle files stay until the driver's garbage collector has seen that no plan names them, so a
    collection is asked for here: at scale these files are the largest part of the disk.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


#: Of a table that may be broadcast, with the hash table's share of each row.
SMALL_BYTES = 64 << 20


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df``, a stored table of numbers, to be broadcast if it is counted to take at most ``most`` bytes; else joins shuffle it."""
    return F.broadcast(df) if df.count() * (32 + 24 * len(df.columns)) <= most else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have (names compare without case, as in Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- connected components -------------------------------------------------------------


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reached.

    Alternating large-star and small-star steps: each round is two key-wise minima and two
    equi-joins, so a node with very many links only meets partial minima before the shuffle.
    Rounds grow with the logarithm of the longest path. Null ends and self links are dropped.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = stored(e, "links")
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        last, e = e, stored(small, "links")
        discard(last)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    r = e.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u") % 1000003).alias("s"),
    ).first()
    return r["n"], r["x"], r["s"]


# --- text as bytes --------------------------------------------------------------------

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n; kept for the life of the Python worker."""
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_B, _B_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[k] = np.cumprod(a, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of (byte + 1) * B**k for k in [i, j)."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever it stands."""
    _, down = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes other than space and 9 to 13; runs stop at row ends."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive hashes (order counts)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix64(out)


def word_shingles(data: np.ndarray, offsets: np.ndarray, width: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's shingles of ``width`` words, repeats included.

    With fewer words the whole sequence is one shingle if ``whole``.
    """
    start, end, row = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = span_hash(prefix_hash(data), start, end)
    full = combine(h, width)
    keep = row[: len(full)] == row[width - 1 :] if len(full) else np.zeros(0, bool)
    rows, out = row[: len(full)][keep], full[keep]
    if whole:
        count = np.bincount(row, minlength=len(offsets) - 1)
        head = np.concatenate([[0], np.cumsum(count)])
        extra_r, extra_h = [], []
        for w in range(1, width):
            few = np.flatnonzero(count == w)
            if len(few):
                at = head[few]
                acc = np.full(len(few), np.uint64(w), np.uint64)
                for k in range(w):
                    acc = acc * np.uint64(0xA0761D6478BD642F) + h[at + k]
                extra_r.append(few)
                extra_h.append(mix64(acc))
        if extra_r:
            rows = np.concatenate([rows, *extra_r])
            out = np.concatenate([out, *extra_h])
    return rows, out


def distinct_per_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (row, hash), each pair once."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
    return rows, hashes
