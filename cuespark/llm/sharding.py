"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters whole records into memory-sized buckets by a seeded hash; pass 2 applies a
Fisher-Yates shuffle to each bucket and writes it. A record's place in the concatenation of
the buckets then gives its shard (place modulo shards) and its slot, so the shards' counts
differ by one at most and the slots of each have no gap.

Defined cases: a null text has no bytes; an empty table gives an empty result; repeated rows
are separate records. The source partition salts the hash, so even a row that is repeated in
a third of all rows spreads over the buckets. The order is the same for the same files, seed
and split size. Input columns named like ours are kept; ours then get a leading underscore.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespark.llm.common import free_name, stored

BUCKET_BYTES = 24 << 20


def external_shuffle(
    docs: DataFrame, shards: int = 8, seed: int = 42, text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; every column and row is kept."""
    spark = docs.sparkSession
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    mark_, bucket_, place_, n_, base_ = (free_name(docs, x) for x in ("mark", "bucket", "place", "n", "base"))
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    taken = docs.select("*", mark.alias(mark_))
    taken = taken.withColumn(bucket_, F.pmod(F.xxhash64(F.lit(seed), mark_, F.spark_partition_id()), F.lit(buckets)))
    schema = T.StructType(taken.schema.fields + [T.StructField(place_, T.LongType())])

    def fisher_yates(table: pa.Table) -> pa.Table:
        marks = table.column(mark_).to_numpy()
        bucket = table.column(bucket_)[0].as_py()
        order = np.argsort(marks, kind="stable")
        # Generator.permutation is the Fisher-Yates shuffle
        order = order[np.random.default_rng([seed, bucket]).permutation(len(order))]
        return table.take(pa.array(order)).append_column(place_, pa.array(np.arange(len(order), dtype=np.int64)))

    # as many partitions as buckets, so a task holds few of them at any size
    written = stored(taken.repartition(buckets, bucket_).groupBy(bucket_).applyInArrow(fisher_yates, schema), "buckets")
    # one row a bucket: as many as the input has bucket_bytes
    counts = written.groupBy(bucket_).agg(F.count(F.lit(1)).alias(n_))
    before = Window.orderBy(bucket_).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(bucket_, F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(base_))
    at = F.col(base_) + F.col(place_)
    return written.join(base, bucket_).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.pmod(at, F.lit(shards)).cast("int").alias(shard), F.floor(at / shards).cast("long").alias(slot)
    )


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder a shard, each file in slot order."""
    shuffled.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Where each document went, with its size and checksum."""
    out = external_shuffle(docs, shards)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
