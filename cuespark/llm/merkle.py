"""A Merkle manifest of a table: a binary hash tree over the rows of each part, and one over the parts' roots.

Nodes are labelled with the nested interval ``[lo, hi)`` of the leaf ranks that they cover. The
ancestors of a leaf are the nodes whose interval holds its rank, one on each level; the node
beside it is what its parent's interval has left when its own is taken away.

A tree is grown in tiers of LEVELS levels. A bucket of a tier is the 2 ** LEVELS consecutive nodes
below one node of the tier above, so a task holds one bucket and its nodes at any size of the
table; there are as many tiers as the logarithm of the rows to the base 2 ** LEVELS. Proofs go
down again: the containment join meets members with the nodes of their tier's bucket, level by
level, and a member's path is handed to its own bucket below. Ranks come from one range
partitioning and a table with a row for each of its partitions and parts.

Defined cases: a null field is ``-``; a null part is a part of its own and comes first; rows of
equal key follow by their digests, and rows that are equal in all fields are leaves of their own;
a null key comes first in its part and is never tampered with; a part of one row has its leaf
for root; where nothing stands beside a path the proof is the hash of nothing; an empty table
gives no rows. Columns that are not fields of a leaf take no part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.llm.common import small, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10
#: Levels of the tree over the parts' roots follow those of the parts.
TOP = 64
#: What a bucket is told besides its path.
SUBROOT, ROOT = -2, -1

NODES = "part string, bucket long, level int, lo long, hi long, leaves long, size long, digest binary"
PATHS = "part string, bucket long, level int, side int, digest binary, name string, total long"


def _hash(*parts: bytes) -> bytes:
    """Of the digests' hexadecimal text, one after another."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def framed(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(c) for c in fields.values()]), 256))


def part_key(value: Column) -> Column:
    """Never null, in the order of the values with null first."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.lit("="), text))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``, from 0 in each ``part``, and ``leaves``, the rows of the part.

    Rows are put in order once; a table of the rows of each part in each range gives the ranks.
    """
    by = [F.col("part").asc(), *[F.col(c).asc_nulls_first() for c in order]]
    placed = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("range", F.shiftright("at", 33))
    runs = placed.groupBy("part", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    part, before = Window.partitionBy("part"), Window.partitionBy("part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    starts = stored(runs.select("part", "range", shift.alias("shift"), F.sum("n").over(part).alias("leaves")), f"{name}-starts")
    ranks = placed.join(small(starts), ["part", "range"])
    return ranks.select(*df.columns, (F.col("at") + F.col("shift")).alias("rank"), "leaves")


def _levels(size: int, most: int) -> int:
    """Levels of a tier over a part that has ``size`` nodes below it."""
    return most if size > 1 << most else math.ceil(math.log2(size)) if size > 1 else 0


def grown(members: DataFrame, tier: int, levels: int = LEVELS) -> DataFrame:
    """The nodes above ``members(part, rank, leaves, size, digest)``, the nodes at the foot of a tier."""

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        part, leaves, size, first = (table.column(c)[0].as_py() for c in ("part", "leaves", "size", "rank"))
        row, at, out = table.column("digest").to_pylist(), first, []
        for level in range(1, _levels(size, levels) + 1):
            row, at = [_hash(*row[k : k + 2]) for k in range(0, len(row), 2)], at >> 1
            wide = tier * levels + level
            out += [(wide, (at + k) << wide, min((at + k + 1) << wide, leaves), d) for k, d in enumerate(row)]
        n = len(out)
        level, lo, hi, digest = zip(*out, strict=True) if out else ((),) * 4
        return pa.table(
            {
                "part": pa.array([part] * n, pa.string()), "bucket": pa.array([first >> levels] * n, pa.int64()), "level": pa.array(level, pa.int32()),
                "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()), "leaves": pa.array([leaves] * n, pa.int64()),
                "size": pa.array([size] * n, pa.int64()), "digest": pa.array(digest, pa.binary()),
            }
        )

    foot = members.select("part", "rank", "leaves", "size", "digest", F.shiftright("rank", levels).alias("bucket"))
    return foot.groupBy("part", "bucket").applyInArrow(grow, NODES)


def tree(members: DataFrame, name: str, levels: int = LEVELS) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The tiers, each with its members and their nodes, and the (part, leaves, digest) of the roots."""
    members = members.withColumn("size", F.col("leaves"))
    most = members.agg(F.max("leaves")).first()[0] or 0
    tiers, roots = [], members.where("leaves = 1").select("part", "leaves", "digest")
    while True:
        tier = len(tiers)
        nodes = stored(grown(members, tier, levels), f"{name}-nodes")
        tiers.append((members, nodes))
        roots = roots.unionByName(nodes.where("lo = 0 and hi = leaves").select("part", "leaves", "digest"))
        if most <= 1 << levels:
            return tiers, roots
        most = math.ceil(most / (1 << levels))
        wide = (tier + 1) * levels
        above = nodes.where((F.col("size") > 1 << levels) & (F.col("level") == wide))
        members = above.select("part", F.shiftright("lo", wide).alias("rank"), "leaves", F.ceil(F.col("size") / (1 << levels)).alias("size"), "digest")


def _beside(table: pa.Table, right: pa.Table, wide: int) -> tuple[list[list[tuple[int, int, bytes | None]]], dict[int, tuple[int, bytes | None]]]:
    """For each member of a bucket its (level, side, digest beside it) inside it, and what the bucket was told.

    The members stand on level ``wide``. side is -1 where the neighbour stands to the left, 1 to the right and 0 where there is none.
    """
    rank, leaves = table.column("rank").to_numpy(), table.column("leaves")[0].as_py()
    lo, hi = rank << wide, np.minimum((rank + 1) << wide, leaves)
    own_lo, own_hi, below, low = lo, hi, table.column("digest").to_pylist(), lo
    paths: list[list[tuple[int, int, bytes | None]]] = [[] for _ in rank]
    level, r_lo, r_hi, side, digest = (right.column(c).to_pylist() for c in ("level", "lo", "hi", "side", "digest"))
    told = {n: (side[k], digest[k]) for k, n in enumerate(level) if side[k] is not None}
    for n in sorted({n for k, n in enumerate(level) if side[k] is None}):
        rows = sorted((r_lo[k], r_hi[k], digest[k]) for k in range(len(level)) if level[k] == n and side[k] is None)
        p_lo, p_hi = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
        above = np.searchsorted(p_lo, own_lo, "right") - 1  # the node whose interval holds it
        up_lo, up_hi = p_lo[above], p_hi[above]
        left = up_lo < own_lo
        none = ~left & (up_hi == own_hi)
        beside = np.searchsorted(low, np.where(left, up_lo, own_hi))
        for k, path in enumerate(paths):
            path.append((n, 0, None) if none[k] else (n, -1 if left[k] else 1, below[beside[k]]))
        own_lo, own_hi, below, low = up_lo, up_hi, [x[2] for x in rows], p_lo
    return paths, told


def _meet(members: DataFrame, nodes: DataFrame, told: DataFrame, levels: int) -> tuple:
    """Members and, for the same bucket, its nodes and what it was told, as the two sides of a join."""
    left = members.withColumn("bucket", F.shiftright("rank", levels))
    right = nodes.selectExpr("part", "bucket", "level", "lo", "hi", "null as side", "digest")
    right = right.unionByName(told.selectExpr("part", "bucket", "level", "null as lo", "null as hi", "side", "digest"))
    return left.groupBy("part", "bucket").cogroup(right.selectExpr("part", "bucket", "level", "lo", "hi", "cast(side as int) side", "digest").groupBy("part", "bucket"))


def handed_down(members: DataFrame, nodes: DataFrame, told: DataFrame, tier: int, levels: int = LEVELS) -> DataFrame:
    """What the members of a tier tell their own buckets below: their paths to the root."""
    names = "name" in members.columns

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            left = left.sort_by("rank")
            paths, above = _beside(left, right, tier * levels)
            above = [(n, *x) for n, x in above.items()]
            part, rank = left.column("part").to_pylist(), left.column("rank").to_pylist()
            name, total = (left.column(c).to_pylist() if names else [None] * len(rank) for c in ("name", "total"))
            out = [(part[k], rank[k], n, side, d, name[k], total[k]) for k, path in enumerate(paths) for n, side, d in path + above]
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "bucket", "level", "side", "digest", "name", "total"])

    return _meet(members, nodes, told, levels).applyInArrow(down, PATHS)


def proofs(members: DataFrame, nodes: DataFrame, told: DataFrame, key: str, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded root) of every leaf, folded from its ``tampered`` digest."""

    def prove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            left = left.sort_by("rank")
            paths, above = _beside(left, right, 0)
            (_, subroot), (_, root) = above.pop(SUBROOT), above.pop(ROOT)
            above = [(n, *above[n]) for n in sorted(above)]
            for path, leaf, now in zip(paths, left.column("digest").to_pylist(), left.column("tampered").to_pylist(), strict=True):
                path = path + above
                for _, side, d in path:
                    now = _hash(d, now) if side < 0 else _hash(now, d) if side else _hash(now)
                out.append((leaf, subroot, root, _hash(*[d for _, side, d in path if side]), now))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table([left.column(key), *[pa.array(c, pa.binary()) for c in columns]], names=[key, "leaf", "subroot", "root", "proof", "folded"])

    kind = members.schema[key].dataType.simpleString()
    return _meet(members, nodes, told, levels).applyInArrow(prove, f"`{key}` {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary")


def _ends_at(leaves: Column, tier: int, levels: int) -> Column:
    """Whether ``tier`` is the last one of a part with so many leaves."""
    unit = 1 << (levels * tier)
    return (F.ceil(leaves / unit) <= 1 << levels) & (F.lit(tier == 0) | (F.ceil(leaves / (unit >> levels or 1)) > 1 << levels))


def manifest(leaves: DataFrame, key: str, name: str = "merkle", levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """(proofs of all leaves, node tables) of ``leaves(part, key, digest, tampered)``.

    The node tables, the parts' by tier and then those over the parts' roots, are the manifest itself.
    """
    members = ranked(stored(leaves, f"{name}-leaves"), [key, "digest"], f"{name}-ranked")
    tiers, roots = tree(members, name, levels)
    tops = ranked(roots.select(F.lit("").alias("part"), F.col("part").alias("name"), F.col("leaves").alias("total"), "digest"), ["name"], f"{name}-parts")
    over, root = tree(tops, f"{name}-top", levels)
    # the path of each part's root, from the top down
    told = root.selectExpr("part", "0L as bucket", f"{ROOT} as level", "0 as side", "digest", "cast(null as string) as name", "cast(null as long) as total")
    for k in range(len(over) - 1, -1, -1):
        told = stored(handed_down(*over[k], told, k, levels), f"{name}-told")
    own = roots.selectExpr("part", "0L as bucket", f"{SUBROOT} as level", "0 as side", "digest", "leaves as total")
    shift = F.when(F.col("level") > 0, F.col("level") + TOP).otherwise(F.col("level"))
    tops = told.select(F.col("name").alias("part"), F.lit(0).cast("long").alias("bucket"), shift.alias("level"), "side", "digest", "total").unionByName(own)
    told = None
    for k in range(len(tiers) - 1, -1, -1):
        last = tops.where(_ends_at(F.col("total"), k, levels)).drop("total")
        told = last if told is None else last.unionByName(told.select("part", "bucket", "level", "side", "digest"))
        if k:
            told = stored(handed_down(*tiers[k], told, k, levels), f"{name}-told")
    return proofs(*tiers[0], told, key, levels), [n for _, n in [*tiers, *over]]


def document_leaves(docs: DataFrame) -> DataFrame:
    """Each document's part (its language) and digest, and the digest after tampering with a seventh of them."""
    fields = {c: F.col(c) for c in FIELDS}
    struck = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    more = leaf_digest(fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    digest = leaf_digest(fields)
    return docs.select(part_key(F.col("lang")).alias("part"), "doc_id", digest.alias("digest"), F.when(struck, more).otherwise(digest).alias("tampered"))


def document_proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every document's leaf, roots and proof as hexadecimal text, and whether its folded root is the true one."""
    out, _ = manifest(document_leaves(docs.select(*FIELDS)), "doc_id", levels=levels)
    text = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
