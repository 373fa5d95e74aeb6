"""Embedding near-dedup by randomly rotated binary codes with correction factors.

Unit vectors are rotated at random; a code keeps the signs. With the stored factor (the inner
product of a vector with its own code) a code and a rotated query give an unbiased estimate of
their cosine and a confidence bound. Only pairs whose bound reaches the threshold are computed
exactly, in double precision, and only exact cosines decide links.

Vectors meet in tables: each table takes some sign bits of rotated vectors as a bucket, and the
number of bits and tables follows from the number of rows of a label, so that buckets keep their
size as data grow and a pair at the threshold meets with the target recall. A pair counts in the
first table in which it meets. Large buckets are cut into tiles of pairs of chunks.

Equal vectors are one row with a multiplicity before anything is compared. Tiles emit sums and
one link per joined vector, never their pairs.

Defined cases: null labels, null, empty or zero vectors and ones with null or non-finite
components link with nothing; vectors of different lengths are never compared; a null vec_id is
returned alone with a null component; repeated ids are one node; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import connected_components, shuffle_width, stored
from cuespark.llm.jaccard import runs

THRESHOLD = 0.93
RECALL = 0.99
SIGMAS = 3.5
BUCKET_ROWS = 400
TILE_ROWS = 2048

_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, which: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (dim, which) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([dim, which, 17]).standard_normal((dim, dim)))
        _ROTATIONS[dim, which] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, which]


def plan_tables(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET_ROWS, and the recall for a pair at the threshold."""
    bits = min(30, max(4, math.ceil(math.log2(max(2, rows / BUCKET_ROWS)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucket_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One key per row and table, from consecutive sign bits over as many rotations as that takes."""
    dim = x.shape[1]
    signs = np.concatenate([(x @ rotation(dim, 1 + r)) > 0 for r in range(math.ceil(bits * tables / dim))], 1)
    weights = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([signs[:, t * bits : (t + 1) * bits] @ weights for t in range(tables)], 1)


def with_keys(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    names = reps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("embedding")
            sizes = batch.column(at).value_lengths().to_numpy()
            order = np.argsort(sizes, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
                rows = batch.take(pa.array(part))
                keys = bucket_keys(_units(_matrix(rows.column(at))), bits, tables)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, listed], [*names, "keys"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(run, f"{fields}, keys array<long>")


def _pairs(x: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile whose exact cosine reaches the threshold."""
    dim = x.shape[1]
    turned = (x @ rotation(dim, 0)).astype(np.float32)
    code = np.where(turned > 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dim))
    factor = np.maximum((code * turned).sum(1), 1e-6)
    spread = SIGMAS * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    within = bool((side == 2).all())
    left = np.arange(len(x)) if within else np.flatnonzero(side == 0)
    right = np.arange(len(x)) if within else np.flatnonzero(side == 1)
    out = []
    for a in range(0, len(left), 256):
        some = left[a : a + 256]
        estimate = (turned[some] @ code[right].T) / factor[right] + spread[right]
        i, j = np.nonzero(estimate >= threshold)
        u, v = some[i], right[j]
        if within:
            u, v = u[u < v], v[u < v]
        for b in range(0, len(u), 65536):
            p, q = u[b : b + 65536], v[b : b + 65536]
            ok = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            out.append(np.stack([p[ok], q[ok]]))
    return tuple(np.concatenate(out, 1)) if out else (np.zeros(0, np.int64),) * 2


def tile_counts(tiles: DataFrame, threshold: float) -> DataFrame:
    """(rep, add, root): what a tile adds to a vector's links, and a vector that it is joined with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "tile"):
            rep, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
            x = _units(_matrix(table.column("embedding").combine_chunks()))
            keys = _matrix(table.column("keys").combine_chunks()).astype(np.int64)
            t = int(table.column("table")[0].as_py())
            u, v = _pairs(x, side, threshold)
            fresh = ~(keys[u, :t] == keys[v, :t]).any(1) if t else np.ones(len(u), bool)
            u, v = u[fresh], v[fresh]
            add = np.bincount(u, copies[v], len(rep)) + np.bincount(v, copies[u], len(rep))
            root = np.arange(len(rep))
            while True:  # the smallest index reached, by minima over links and jumps
                new = root.copy()
                np.minimum.at(new, u, root[v])
                np.minimum.at(new, v, root[u])
                new = np.minimum(new, new[new])
                if (new == root).all():
                    break
                root = new
            on = add > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(add[on].astype(np.int64)), pa.array(rep[root[on]])], ["rep", "add", "root"])

    dealt = tiles.repartition(shuffle_width(tiles.sparkSession), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "rep long, add long, root long")


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label)``."""
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    valid = vectors.where("vec_id is not null and label is not null and size(embedding) > 0").where(~bad).where(some)
    reps = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = stored(reps, "vectors")
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(most, threshold, recall)
    keyed = stored(with_keys(reps.select("rep", "copies", "label", "embedding"), bits, tables), "codes")
    held = keyed.select("*", F.posexplode("keys").alias("table", "key")).withColumn("bucket", F.xxhash64("label", F.size("embedding"), "table", "key"))
    crowd = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("rep", "table"), F.col("chunks")).cast("int")
    cells = held.join(crowd, "bucket").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
    tiles = cells.select(
        "rep", "copies", "embedding", "keys", "table", side.alias("side"),
        F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"),
    )
    found = stored(tile_counts(tiles, threshold), "found")
    root = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).toDF("rep", "root")
    sums = found.groupBy("rep").agg(F.sum("add").alias("add"))
    place = reps.join(sums, "rep", "left").join(root, "rep", "left")
    place = place.select("label", "embedding", (F.coalesce("add", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    named = valid.join(place, ["label", "embedding"]).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("root").alias("root"))
    return vectors.select("vec_id").join(named, "vec_id", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"),
    )
