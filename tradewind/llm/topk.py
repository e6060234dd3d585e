"""Exact top-k inner products by dual-tree search over cover trees.

The top level of both trees is one set of centres, chosen from the data; below it, tasks grow a levelled cover tree over the
vectors of a cell and one over a group of queries and search both together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Points that a node without children holds at most, unless they are all equal (of queries: fewer, as a group's worst k-th score
#: decides for all of it), and children of a node at most.
LEAF, QUERY_LEAF, CHILDREN = 64, 16, 16
#: Above it, sums of products are no longer exact in double precision.
EXACT = float(1 << 53)
#: A score is shuffled as two integers, its bits above and below this one.
LOW = 62


def angles(a: np.ndarray, b: np.ndarray, norm_a, norm_b) -> np.ndarray:
    """Angles between vectors (rows); zero vectors are at a right angle to all."""
    cosine = (a * b).sum(-1) / np.maximum(norm_a * norm_b, 1e-300)
    return np.arccos(np.clip(cosine, -1, 1))


def top_product(dot, near: tuple, far: tuple) -> np.ndarray:
    """The largest inner product of points of two nodes, given that of their centres.

    Each node is (norm of the centre, radius, largest angle to the centre, least norm, largest norm). It is bounded twice, by the
    radii and by the angles; the lesser counts. What isn't finite bounds nothing.
    """
    with np.errstate(all="ignore"):
        by_radius = dot + near[0] * far[1] + far[0] * near[1] + near[1] * far[1]
        apart = np.arccos(np.clip(dot / np.maximum(near[0] * far[0], 1e-300), -1, 1))
        cosine = np.cos(np.minimum(np.pi, np.maximum(0, apart - near[2] - far[2])) - 1e-7)
        by_angle = np.where(cosine >= 0, near[4] * far[4], near[3] * far[3]) * cosine
        top = np.minimum(by_radius, by_angle)
        return top + 1e-9 * (np.abs(by_radius) + near[4] * far[4] + 1)


class CoverTree:
    """Levelled nodes with a centre, a covering radius and either children or points.

    The centres of the children are a net of the node's points, each the farthest from those before it, until all points are
    within half the node's radius of one; every point belongs to the nearest. Where that takes more than CHILDREN, as it does among
    points that are all about equally far apart, the node is halved instead: the nearest of few centres would part it unevenly.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((x * x).sum(1))
        self.centre: list[int] = []
        self.children: list[np.ndarray] = []
        self.points: list[np.ndarray] = []
        self.level: list[int] = []
        radius, angle, least, most = [], [], [], []
        todo = [(np.arange(len(x)), 0, 0, -1)] if len(x) else []
        below: list[list[int]] = []
        while todo:
            own, centre, level, parent = todo.pop()
            node = len(self.centre)
            if parent >= 0:
                below[parent].append(node)
            with np.errstate(all="ignore"):
                d = np.sqrt(((x[own] - x[centre]) ** 2).sum(1))
                angle.append(float(angles(x[own], x[centre], self.norm[own], self.norm[centre]).max()))
            self.centre.append(centre)
            self.points.append(own)
            self.level.append(level)
            below.append([])
            radius.append(float(d.max()))
            least.append(float(self.norm[own].min()))
            most.append(float(self.norm[own].max()))
            if len(own) > leaf and 0 < radius[node] < np.inf:
                net, nearest, dist = [centre], np.zeros(len(own), np.int64), d
                while dist.max() > radius[node] / 2 and len(net) < CHILDREN:
                    far = int(own[dist.argmax()])
                    new = np.sqrt(((x[own] - x[far]) ** 2).sum(1))
                    nearest[new < dist] = len(net)
                    dist = np.minimum(dist, new)
                    net.append(far)
                if dist.max() > radius[node] / 2:
                    nearest, net = self._halves(own, net)
                todo += [(own[nearest == k], c, level + 1, node) for k, c in enumerate(net)]
        self.children = [np.array(c, np.int64) for c in below]
        self.shape = tuple(np.array(v) for v in (self.norm[self.centre], radius, angle, least, most))

    def _halves(self, own: np.ndarray, net: list[int]) -> tuple[np.ndarray, list[int]]:
        """(half of each point, centres): cut at the median along the line between the first two centres of a net."""
        along = self.x[own] @ (self.x[net[1]] - self.x[net[0]])
        half = np.zeros(len(own), np.int64)
        half[np.argsort(along, kind="stable")[len(own) // 2 :]] = 1
        centres = []
        for k in (0, 1):
            part = own[half == k]
            centres.append(int(part[((self.x[part] - self.x[part].mean(0)) ** 2).sum(1).argmin()]))
        return half, centres

    def of(self, nodes) -> tuple:
        return tuple(v[nodes] for v in self.shape)


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray, whole=None, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query row, data row, score) of the best k (at most) of each query; ``floor`` has scores that the k-th best has anyhow.

    A pair of nodes is pruned if the largest inner product that their radii and angles allow is below the worst k-th score in the
    query node. ``whole`` gives (queries, data) as Python integers, for scores that doubles can't hold. ``stats`` is told the
    pairs of points that were scored, and the pairs of nodes that were met and pruned.
    """
    qt, dt = CoverTree(queries, QUERY_LEAF), CoverTree(data)
    worst = floor.astype(np.float64).copy()
    best: list[list[tuple[int, int, int]]] = [[] for _ in range(len(queries))]
    with np.errstate(all="ignore"):
        exact = bool(len(data) and np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1] < EXACT)
    ints = None if exact or not len(data) else whole() if whole else ([list(map(int, v)) for v in queries], [list(map(int, v)) for v in data])
    met = pruned = scored = 0

    def bounds(a, b) -> np.ndarray:
        with np.errstate(all="ignore"):
            dot = (queries[np.array(qt.centre)[a]] * data[np.array(dt.centre)[b]]).sum(-1)
        return top_product(dot, qt.of(a), dt.of(b))

    stack = [(float(bounds(0, 0)), 0, 0)] if len(queries) and len(data) else []
    while stack:
        top, a, b = stack.pop()
        met += 1
        own = qt.points[a]
        if top < worst[own].min():
            pruned += 1
            continue
        below_q, below_d = qt.children[a], dt.children[b]
        if len(below_q) or len(below_d):
            split_q = len(below_q) and (not len(below_d) or qt.shape[1][a] >= dt.shape[1][b])
            pairs = (below_q, np.full(len(below_q), b)) if split_q else (np.full(len(below_d), a), below_d)
            stack += sorted(zip(bounds(*pairs).tolist(), pairs[0].tolist(), pairs[1].tolist(), strict=True))  # the best is taken first
            continue
        there = dt.points[b]
        scored += len(own) * len(there)
        if exact:
            scores = queries[own] @ data[there].T
        else:
            scores = np.array([[sum(x * y for x, y in zip(ints[0][i], ints[1][j], strict=True)) for j in there] for i in own], object)
        mine = data_ids[there]
        good = (scores >= worst[own][:, None]) & (mine[None, :] != query_ids[own][:, None])
        for i in np.flatnonzero(good.any(1)).tolist():
            q, row, at = int(own[i]), scores[i], np.flatnonzero(good[i])
            if exact and len(at) > 4 * k:  # the first leaf of a query: all of it is good so far
                at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
            best[q] = sorted(best[q] + [(-int(row[j]), int(mine[j]), int(there[j])) for j in at.tolist()])[:k]
            if len(best[q]) == k:
                worst[q] = max(worst[q], _below(-best[q][-1][0]))
    if stats is not None:
        for name, n in (("met", met), ("pruned", pruned), ("scored", scored)):
            stats[name] = stats.get(name, 0) + n
    rows = [(q, j, -s) for q, x in enumerate(best) for s, _, j in x]
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return np.array(cols[0], np.int64), np.array(cols[1], np.int64), list(cols[2])


def _below(score: int) -> float:
    """The score as a double that isn't larger."""
    try:
        value = float(score)
    except OverflowError:
        return -np.inf
    return value if abs(value) < EXACT else float(np.nextafter(value, -np.inf))


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, cell_rows: int = 1 << 14, query_rows: int = 1 << 14, max_nodes: int = 1024) -> DataFrame:
    """query_id, rank, the key and score of the k best of each query, by inner product of floor(scale * x), ties to smaller keys.

    Queries are the rows whose key is divisible by ``every``, candidates all rows but those with the query's key. The top level of
    the trees is at most max_nodes centres (the vectors with the smallest hashes), each vector going to the nearest; the vectors
    of a node are dealt into cells of at most about cell_rows, its queries into groups of at most about query_rows. First each
    query meets its own node; the k-th scores found there then prune (query group, node) pairs, and what remains is searched in
    tasks, which never hold more than one cell and query_rows queries.

    Vectors that are null or hold a null or non-finite component take no part, nor do null keys; shorter vectors, empty ones too,
    count as padded with zeros. Rows that repeat a key are candidates of others each. An empty table gives an empty result. A
    score beyond 64 bits is given as the nearest long; its rank is right up to 125 bits.
    """
    spark = vectors.sparkSession
    keep = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    parsed = materialize(keep.mapInArrow(_parsed, "id long, v binary, dim int"))
    n, dim = parsed.agg(F.count("*"), F.max("dim")).first()
    names = ["query_id long", "rank int", f"`{key}` long", "score long"]
    if not n:
        return spark.createDataFrame([], ", ".join(names))
    partitions = shuffle_partitions(spark)
    cell_rows = min(cell_rows, max(1024, n // (2 * partitions)))
    # Bounded by max_nodes; the centres and figures of the top level are all that the driver sees.
    count = min(max_nodes, max(1, n // cell_rows))
    centres = _floor(np.stack([_row(r.v, dim) for r in parsed.orderBy(F.xxhash64("id", "v"), "id").limit(count).collect()]), scale)
    sizes = np.sqrt((centres * centres).sum(1))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = _floor(_rows(b.column(1), dim), scale)
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(1))
                d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
                node = np.where(np.isfinite(norm), np.nan_to_num(d, nan=np.inf).argmin(1), 0)
                away = np.sqrt(((x - centres[node]) ** 2).sum(1))
                angle = angles(x, centres[node], norm, sizes[node])
            figures = [pa.array(np.where(np.isfinite(norm), v, np.inf)) for v in (away, angle, norm)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int32()), *figures], names=["id", "v", "node", "away", "angle", "norm"])

    placed = materialize(parsed.select("id", "v").mapInArrow(place, "id long, v binary, node int, away double, angle double, norm double"))
    asks = F.col("id") % every == 0
    figures = placed.groupBy("node").agg(F.max("away"), F.max("angle"), F.min("norm"), F.max("norm"), F.count("*"), F.count_if(asks)).collect()
    nodes = {r[0]: tuple(r)[1:] for r in figures}
    per_node = lambda i, most: F.element_at(F.create_map(*[F.lit(x) for m, v in nodes.items() for x in (m, max(1, -(-v[i] // most)))]), F.col("node"))
    # The number of its cells and groups comes with each row: no node, hot or not, is in one task.
    data = placed.select("id", "v", "node", F.pmod(F.xxhash64("id", "v"), per_node(4, cell_rows)).cast("int").alias("cell"))
    asked = placed.filter(asks).select("id", "v", "node", F.pmod(F.xxhash64("id", "v"), per_node(5, query_rows)).cast("int").alias("part"), F.lit(float("-inf")).alias("floor"))
    found = "query_id long, id long, high long, low long"

    def search(own: pa.Table, told: pa.Table) -> pa.Table:
        a = b = np.empty(0, np.int64)
        s: list[int] = []
        if own.num_rows and told.num_rows:
            raw, qraw = _rows(own["v"], dim), _rows(told["q_v"], dim)
            ids, qids = own["id"].to_numpy(), told["q_id"].to_numpy()
            whole = lambda: (_integers(qraw, scale), _integers(raw, scale))
            a, b, s = dual_search(_floor(qraw, scale), qids, _floor(raw, scale), ids, k, told["q_floor"].to_numpy(), whole)
            a, b = qids[a], ids[b]
        most = (1 << 63) - 1
        high = [max(-most, min(most, x >> LOW)) for x in s]
        return pa.table({"query_id": a, "id": b, "high": pa.array(high, pa.int64()), "low": pa.array([x & ((1 << LOW) - 1) for x in s], pa.int64())})

    def searched(told: DataFrame) -> DataFrame:
        """told: id, v, floor, the node to search and the search group, of at most about query_rows queries."""
        cells = told.select("node", "group").distinct()
        spread = told.withColumn("cell", F.explode(F.sequence(F.lit(0), (per_node(4, cell_rows) - 1).cast("int"))))
        spread = spread.select(*[F.col(c).alias(f"q_{c}") for c in spread.columns])
        copies = data.join(cells, "node")  # a cell is searched by each group that may hold something better
        return copies.groupBy("node", "cell", "group").cogroup(spread.groupBy("q_node", "q_cell", "q_group")).applyInArrow(search, found)

    best = [F.desc("high"), F.desc("low"), "id"]
    near = materialize(searched(asked.withColumn("group", F.col("part"))))
    score = F.col("high").cast("double") * float(1 << LOW) + F.col("low").cast("double")
    kth = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("n") == k)
    # Less a little, where a double can't hold the score.
    kth = kth.select("query_id", F.when(F.abs(score) < EXACT, score).otherwise(score - F.abs(score) * 1e-15).alias("known"))
    known = asked.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", "node", "part", F.coalesce("known", "floor").alias("floor"))
    known = materialize(known)

    def pairs(t: pa.Table) -> pa.Table:
        own = t["node"][0].as_py()
        x = _floor(_rows(t["v"], dim), scale)
        rest = np.array([m for m in nodes if m != own], np.int64)
        c = centres[own]
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(1))
            group = (sizes[own], np.sqrt(((x - c) ** 2).sum(1)).max(), angles(x, c, norm, sizes[own]).max(), norm.min(), norm.max())
            figures = np.array([nodes[m] for m in rest.tolist()], np.float64).reshape(len(rest), 6)
            far = (sizes[rest], figures[:, 0], figures[:, 1], figures[:, 2], figures[:, 3])
            left = rest[~(top_product(centres[rest] @ c, group, far) < t["floor"].to_numpy().min())]
        return pa.table({"node": pa.array(np.full(len(left), own), pa.int32()), "part": pa.array([t["part"][0].as_py()] * len(left), pa.int32()), "to": pa.array(left, pa.int32())})

    left = materialize(known.groupBy("node", "part").applyInArrow(pairs, "node int, part int, to int"))
    # Queries of all nodes that visit a node share its search groups.
    groups = max(1, -(-sum(v[5] for v in nodes.values()) // query_rows))
    visits = known.join(left, ["node", "part"]).select("id", "v", "floor", F.col("to").alias("node"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"))
    every_found = near.unionByName(searched(visits)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    whole = F.when(F.col("high").between(-2, 1), F.shiftleft("high", LOW).bitwiseOR(F.col("low"))).when(F.col("high") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))
    return every_found.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), whole.alias("score"))


def _floor(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def _integers(x: np.ndarray, scale: int) -> list[list[int]]:
    """floor(scale * x) as Python integers, also where the product is beyond a double."""
    return [[int(y) if np.isfinite(y) else int(v) * scale for v, y in zip(row.tolist(), _floor(row, scale).tolist(), strict=True)] for row in x]


def _row(cell: bytes, dim: int) -> np.ndarray:
    out = np.zeros(max(1, dim))
    x = np.frombuffer(cell, np.float64)
    out[: len(x)] = x
    return out


def _rows(cells, dim: int) -> np.ndarray:
    return np.stack([_row(v.as_py(), dim) for v in cells]) if len(cells) else np.zeros((0, max(1, dim)))


def _parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors that take part, as bytes of their doubles."""
    for b in it:
        rows = []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if all(x is not None for x in v) and np.isfinite(x := np.array(v, np.float64)).all():
                rows.append((i, x.tobytes(), len(x)))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32())], names=["id", "v", "dim"])
