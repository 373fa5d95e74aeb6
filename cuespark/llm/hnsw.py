"""Approximate nearest neighbours by inner product: one navigable small-world graph a shard.

Rows are dealt to shards by a hash of their vector. Each shard's graph is built in one task and
stored as flat arrays: vectors, SLOTS neighbour places a node on the ground layer and
SLOTS / 2 on each upper one. Queries, in blocks, meet every shard's arrays; the shards' answers,
exact inner products in double precision, are merged by query.

Inner products become angles by one more component that gives all vectors of a shard the same
norm, so the graph is one of a metric. Nodes enter in batches that search the graph together
(lock-step beams) and also meet the others of their batch; neighbours are chosen for diversity.
A shard's beam is the smallest power of two times TOP with which PROBES of its own vectors find RECALL of
their true neighbours in it, so the recall is kept where vectors are hard to tell apart.

Equal vectors are one node. Of their ids it holds the k + 1 smallest, all that can be among k
answers: the ids are of one score, ties go to the smaller one and a query leaves out itself.

Shards grow in number with the square root of the bytes until they hold SHARD_BYTES each, so a
task's memory is bounded at any number of rows and any length of vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without id; vectors of different lengths never meet; repeated rows count once;
an id that stands on several vectors is one item, with the best score of any of them, and is
never its own neighbour; fewer than k candidates are all returned; an empty table gives no rows.
Columns other than id and vector take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.llm.common import stored

TOP = 20
SLOTS = 32
BUILD_BEAM = 96
RECALL = 0.98
PROBES = 128
BATCH = 256
AT_ONCE = 8
#: Of a shard's vectors as 4-byte components at most, and in the shards of a table of that size.
SHARD_BYTES = 32 << 20
FIRST_BYTES = 1 << 20
BLOCK_QUERIES = 65_536
#: Nodes whose arrays are one row of the index.
CHUNK = 8192

INDEX = "dim int, shard int, chunk int, beam int, vectors binary, ids array<array<long>>, ground binary, places binary, layers binary, upper binary"


class Graph:
    """Flat neighbour arrays; ``upper[l]`` holds rows only for nodes of layer l + 1 and above, found by ``place``."""

    def __init__(self, x: np.ndarray, layer: np.ndarray) -> None:
        self.x, self.layer = x, layer
        self.ground = np.full((len(x), SLOTS), -1, np.int32)
        self.order = [np.flatnonzero(layer > n) for n in range(int(layer.max(initial=0)))]
        self.upper = [np.full((len(rows), SLOTS // 2), -1, np.int32) for rows in self.order]
        self.entry = int(np.argmax(layer)) if len(x) else -1

    def links(self, n: int, nodes: np.ndarray) -> np.ndarray:
        return self.ground[nodes] if n == 0 else self.upper[n - 1][np.searchsorted(self.order[n - 1], nodes)]

    def relink(self, n: int, nodes: np.ndarray, rows: np.ndarray) -> None:
        if n == 0:
            self.ground[nodes] = rows
        else:
            self.upper[n - 1][np.searchsorted(self.order[n - 1], nodes)] = rows


def beams(g: Graph, q: np.ndarray, n: int, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``width`` best nodes of layer n that each query's beam reaches from ``start``; -1 fills up."""
    some = len(q)
    row = np.arange(some)[:, None]
    seen = np.zeros((some, len(g.x) + 1), bool)
    seen[:, -1] = True
    seen[row, start] = True
    ids = np.full((some, width), -1, np.int64)
    best = np.full((some, width), -np.inf, np.float32)
    done = np.ones((some, width), bool)
    first = np.einsum("bd,bsd->bs", q, g.x[start])
    first[start < 0] = -np.inf
    k = start.shape[1]
    ids[:, :k], best[:, :k], done[:, :k] = start, first, start < 0
    while True:
        open_ = np.where(done, -np.inf, best)
        live = np.flatnonzero(open_.max(1) > -np.inf)
        if not len(live):
            return ids, best
        take = min(AT_ONCE, width)
        pick = np.argpartition(-open_[live], take - 1, axis=1)[:, :take]
        at = live[:, None]
        fresh = ~done[at, pick]
        done[at, pick] = True
        near = g.links(n, np.where(fresh, ids[at, pick], g.entry).ravel()).reshape(len(live), -1, g.links(n, np.array([g.entry])).shape[1])
        near = np.where(fresh[:, :, None], near, -1).reshape(len(live), -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[at, near], -1, near)
        seen[at, near] = True
        most = int((near >= 0).sum(1).max(initial=0))
        if not most:
            continue
        near = -np.sort(-near, 1)[:, :most]
        score = np.einsum("bd,bmd->bm", q[live], g.x[near])
        score[near < 0] = -np.inf
        ids_, best_ = np.concatenate([ids[live], near], 1), np.concatenate([best[live], score], 1)
        done_ = np.concatenate([done[live], near < 0], 1)
        keep = np.argpartition(-best_, width - 1, axis=1)[:, :width]
        pos = np.arange(len(live))[:, None]
        ids[live], best[live], done[live] = ids_[pos, keep], best_[pos, keep], done_[pos, keep]


def _diverse(g: Graph, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours a row: the nearest first, then those nearer to the node than to any chosen; free slots go to the nearest left."""
    order = np.argsort(-score, axis=1, kind="stable")[:, : 3 * most]
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    v = g.x[ids]
    among = v @ v.transpose(0, 2, 1)
    rows, width = ids.shape
    chosen = np.zeros((rows, width), bool)
    closest = np.full((rows, width), -np.inf, np.float32)
    for c in range(width):
        take = (ids[:, c] >= 0) & (score[:, c] > closest[:, c]) & (chosen.sum(1) < most)
        chosen[:, c] = take
        closest = np.where(take[:, None], np.maximum(closest, among[:, :, c]), closest)
    rank = np.where(ids < 0, 2 * width, np.where(chosen, 0, width)) + np.arange(width)
    pick = np.argsort(rank, axis=1)[:, :most]
    out = np.full((rows, most), -1, np.int32)
    out[:, : pick.shape[1]] = np.take_along_axis(ids, pick, 1)
    return out


def _link_back(g: Graph, n: int, source: np.ndarray, near: np.ndarray) -> None:
    """Adds each source to its neighbours' own lists, which keep their diverse best."""
    to, new = near.ravel(), np.repeat(source, near.shape[1])
    to, new = to[to >= 0], new[to >= 0]
    if not len(to):
        return
    order = np.lexsort((-np.einsum("ij,ij->i", g.x[to], g.x[new]), to))
    to, new = to[order], new[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    few = place < 2 * near.shape[1]  # of a batch's links to one node the nearest
    added = np.full((len(nodes), int(place[few].max()) + 1), -1, np.int64)
    added[np.repeat(np.arange(len(nodes)), count)[few], place[few]] = new[few]
    for a in range(0, len(nodes), 4 * BATCH):
        part = nodes[a : a + 4 * BATCH]
        both = np.concatenate([g.links(n, part), added[a : a + 4 * BATCH]], 1)
        score = np.einsum("bd,bmd->bm", g.x[part], g.x[both])
        score[both < 0] = -np.inf
        g.relink(n, part, _diverse(g, both, score, near.shape[1]))


def build(x: np.ndarray, seed: int = 17) -> Graph:
    """The graph over rows of one norm; layers are drawn with the seed."""
    rng = np.random.default_rng([seed, len(x)])
    layer = np.minimum((-np.log1p(-rng.random(len(x))) / math.log(SLOTS // 2)).astype(int), 12)
    g = Graph(x, layer)
    if not len(x):
        return g
    order = np.concatenate([[g.entry], np.setdiff1d(rng.permutation(len(x)), [g.entry], assume_unique=True)])
    at = 1
    while at < len(x):
        new = order[at : at + min(BATCH, at)]
        at += len(new)
        q = x[new]
        start = np.full((len(new), 1), g.entry, np.int64)
        mates = q @ q.T
        np.fill_diagonal(mates, -np.inf)
        for n in range(len(g.upper), -1, -1):
            here = layer[new] >= n
            width = BUILD_BEAM if here.any() else 1
            ids, score = beams(g, q, n, start, width)
            start = np.take_along_axis(ids, np.argmax(score, 1)[:, None], 1)
            if not here.any():
                continue
            own = np.flatnonzero(here)
            peers = mates[np.ix_(own, own)]
            more = np.argsort(-peers, axis=1)[:, :SLOTS]
            all_ids = np.concatenate([ids[own], np.where(np.isfinite(np.take_along_axis(peers, more, 1)), new[own][more], -1)], 1)
            all_score = np.concatenate([score[own], np.take_along_axis(peers, more, 1)], 1)
            near = _diverse(g, all_ids, all_score, SLOTS if n == 0 else SLOTS // 2)
            g.relink(n, new[own], near)
            _link_back(g, n, new[own], near)
    return g


def search(g: Graph, q: np.ndarray, width: int) -> np.ndarray:
    """Places of the ``width`` nearest nodes found for each query, -1 where fewer are reached."""
    start = np.full((len(q), 1), g.entry, np.int64)
    for n in range(len(g.upper), 0, -1):
        ids, score = beams(g, q, n, start, 4)
        start = np.take_along_axis(ids, np.argmax(score, 1)[:, None], 1)
    return beams(g, q, 0, start, width)[0]


def lifted(x: np.ndarray) -> np.ndarray:
    """One more component, by which all rows have the largest one's norm."""
    square = (x.astype(np.float64) ** 2).sum(1)
    scale = 1 / math.sqrt(square.max()) if len(x) and square.max() > 0 and np.isfinite(square.max()) else 1.0
    return np.concatenate([x * scale, np.sqrt(np.maximum(0, 1 - square * scale**2))[:, None]], 1).astype(np.float32)


def planned_beam(g: Graph, k: int) -> int:
    """The smallest beam with which a sample of the nodes finds RECALL of its true neighbours; beyond the nodes it is all of them."""
    probes = np.random.default_rng(5).permutation(len(g.x))[:PROBES]
    score = g.x[probes] @ g.x.T
    score[np.arange(len(probes)), probes] = -np.inf  # to find itself is no feat
    true = np.argpartition(-score, min(k, len(g.x)) - 1, axis=1)[:, :k]
    width = 2 * k
    while width < len(g.x):
        ids = search(g, g.x[probes], width)
        if np.mean([np.isin(t, i).mean() for t, i in zip(true, ids, strict=True)]) >= RECALL:
            return width
        width *= 2
    return len(g.x)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def items(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector as doubles) of rows that take part, once each."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("vector")).distinct()


def index(points: DataFrame, k: int = TOP) -> DataFrame:
    """The shards' flat arrays of ``points(id, vector)``, a row for each CHUNK nodes."""
    lowest = Window.partitionBy("vector").orderBy("id")
    nodes = points.withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = stored(nodes.withColumn("dim", F.size("vector")), "nodes")
    held = nodes.groupBy("dim").agg((F.count(F.lit(1)) * F.col("dim") * 4).alias("bytes"))
    # a row for each length of vector
    shards = F.greatest(F.ceil(F.sqrt(F.col("bytes") / FIRST_BYTES)), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("int")
    held = held.select("dim", shards.alias("shards"))
    dealt = nodes.join(held, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    # shards are few bytes and much work, so they are dealt by their number
    parts = 2 * (held.agg(F.sum("shards")).first()[0] or 1)

    def grow(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        order = np.argsort(ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()], kind="stable")  # the same graph whatever the rows' order
        table = table.take(pa.array(order))
        raw = _matrix(table.column("vector"))
        g = build(lifted(raw))
        beam, dim = planned_beam(g, k), raw.shape[1]
        ids, out = table.column("ids").combine_chunks(), []
        for c, a in enumerate(range(0, len(raw), CHUNK)):
            places = [(n, p) for n, rows in enumerate(g.order) for p in np.flatnonzero((rows >= a) & (rows < a + CHUNK))]
            out.append(
                {
                    "dim": dim, "shard": table.column("shard")[0].as_py(), "chunk": c, "beam": beam, "vectors": raw[a : a + CHUNK].tobytes(), "ids": ids[a : a + CHUNK].to_pylist(), "ground": g.ground[a : a + CHUNK].tobytes(),
                    "places": np.array([g.order[n][p] for n, p in places], np.int32).tobytes(), "layers": np.array([n for n, _ in places], np.int32).tobytes(),
                    "upper": b"".join(g.upper[n][p].tobytes() for n, p in places),
                }
            )
        kinds = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int32()), ("beam", pa.int32()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), *[(c, pa.binary()) for c in ("ground", "places", "layers", "upper")]])
        return pa.Table.from_pylist(out, kinds)

    return dealt.select("dim", "shard", "ids", "vector").repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInArrow(grow, INDEX)


def opened(table: pa.Table) -> tuple[Graph, np.ndarray, list[list[int]], int]:
    """(graph, original vectors, ids, beam) from an index's rows of one shard."""
    table = table.sort_by("chunk")
    flat = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    dim = table.column("dim")[0].as_py()
    raw = flat("vectors", np.float64).reshape(-1, dim)
    places, layers, upper = flat("places", np.int32), flat("layers", np.int32), flat("upper", np.int32).reshape(-1, SLOTS // 2)
    layer = np.zeros(len(raw), int)
    np.maximum.at(layer, places, layers + 1)
    g = Graph(lifted(raw), layer)
    g.ground = flat("ground", np.int32).reshape(-1, SLOTS)
    for n in range(len(g.upper)):
        mine = np.flatnonzero(layers == n)
        g.upper[n] = upper[mine[np.argsort(places[mine])]]
    ids = [x for chunk in table.column("ids").to_pylist() for x in chunk]
    return g, raw, ids, table.column("beam")[0].as_py()


def answers(shards: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest found over all shards, nearest first."""
    shards = stored(shards, "index")
    queries = stored(queries.select(F.col("id").alias("query_id"), "vector", F.size("vector").alias("dim")), "queries")
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    heads = shards.where("chunk = 0").select("dim", "shard")
    parts = 2 * blocks * max(1, heads.count())
    # every block of queries meets every shard of its length
    asked = queries.join(heads, "dim").select(F.col("dim").alias("d"), F.col("shard").alias("s"), block.alias("b"), "query_id", "vector")
    there = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("int"))

    def find(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and asked.num_rows:
            g, raw, ids, beam = opened(index)
            size = np.array([len(x) for x in ids])
            flat, first = np.concatenate([np.array(x) for x in ids]), np.concatenate([[0], np.cumsum(size)])
            query, q = asked.column("query_id").to_numpy(), _matrix(asked.column("vector"))
            unit = (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)
            unit = np.concatenate([unit, np.zeros((len(q), 1), np.float32)], 1)
            step = max(1, min(BATCH, (64 << 20) // (len(raw) + 1)))
            for a in range(0, len(q), step):
                found = search(g, unit[a : a + step], beam)
                row, at = np.nonzero(found >= 0)
                node = found[row, at]
                # summed from left to right, as a plain loop over the components does
                score = np.concatenate([np.cumsum(q[a + row[b : b + 65536]] * raw[node[b : b + 65536]], axis=1)[:, -1] for b in range(0, len(row), 65536)] or [np.zeros(0)])
                who, n = np.repeat(np.arange(len(row)), size[node]), size[node]
                id_ = flat[np.repeat(first[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(who))]
                row, score = row[who], score[who]
                other = id_ != query[a + row]
                row, score, id_ = row[other], score[other], id_[other]
                order = np.lexsort((id_, -score, row))
                row, score, id_ = row[order], score[order], id_[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < k
                out.append((query[a + row[keep]], id_[keep], score[keep]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "score"), map(pa.array, columns), strict=True)))

    left, right = there.repartition(parts, "dim", "shard", "block").groupBy("dim", "shard", "block"), asked.repartition(parts, "d", "s", "b").groupBy("d", "s", "b")
    found = left.cogroup(right).applyInArrow(find, "query_id long, id long, score double")
    best = found.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, is_query: str, key: str = "vec_id", vector: str = "embedding", k: int = TOP) -> DataFrame:
    """The k nearest of each row that meets ``is_query``, an expression over the key, among all other rows."""
    points = stored(items(vectors, key, vector), "points")
    queries = points.withColumnRenamed("id", key).where(is_query).withColumnRenamed(key, "id")
    return answers(index(points, k), queries, k)


def neighbour_rows(vectors: DataFrame) -> DataFrame:
    out = nearest(vectors.select("vec_id", "embedding"), "vec_id % 20 = 0")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
