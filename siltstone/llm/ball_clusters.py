"""Centroid clustering by ball-tree filtering.

Vectors become blocks of integers, each with a metric tree of its own: a node is a ball with
its radius, count and integer sum. A round goes down each tree with the centroids that can
still be nearest to some vector of the ball: with z the centroid nearest to the ball's
middle, at distance d, one at distance e is out if e - radius > d + radius. A ball with one
centroid left is assigned whole, by its count and sum; a leaf with several compares exactly.

Blocks are a table in the shared folder, written once; a round reads it and shuffles one
row for each task and centroid. The driver holds the centroids, K of them.

Edge cases: vectors with other than DIMS components, or with a null or non-finite one, are
left out. Repeated rows count each. Rows without vec_id are assigned, but never start a
centroid; rows of one vec_id start in the order of their vectors. With fewer than K vectors
each is a centroid; without any there are no rows. Components of over 2^19 are an error, as
squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, lean
from .vectors import finite, products, rows_of, whole

K, ROUNDS, SCALE, DIMS, SEED = 40, 5, 256, 64, "2"
#: Integers up to this give squared distances that fit a long.
LIMIT = 1 << 27
#: Vectors in a block, and at most in a leaf.
BLOCK_ROWS, LEAF_ROWS = 8192, 64
BLOCK = "ids array<bigint>, vectors binary, start binary, end binary, right binary, radius binary, sums binary"
RESULT = "vec_id bigint, cluster int, distance bigint"


# --------------------------------------------------------------------- trees

def build_tree(x: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order of the rows, nodes in preorder): rows start to end of a node, its right child
    (0: a leaf; the left one is next to it), radius about the mean, and sum. A node is
    halved along the line between two of its farthest rows."""
    order = np.arange(len(x))
    start, end, right, radius, sums = [], [], [], [], []

    def grow(lo: int, hi: int) -> None:
        me, rows = len(start), order[lo:hi]
        part = x[rows]
        total = part.sum(0)
        away = part - total / (hi - lo)
        far = np.einsum("ij,ij->i", away, away)
        start.append(lo), end.append(hi), right.append(0), sums.append(total)
        radius.append(float(np.sqrt(far.max())) * (1 + 1e-9))
        if hi - lo <= leaf or far.max() == 0:
            return
        a = part[far.argmax()]
        from_a = part - a
        b = part[np.einsum("ij,ij->i", from_a, from_a).argmax()]
        mid = (hi - lo) // 2
        order[lo:hi] = rows[np.argpartition(part.astype(np.float64) @ (b - a).astype(np.float64), mid)]
        grow(lo, lo + mid)
        right[me] = len(start)
        grow(lo + mid, hi)

    grow(0, len(x))
    return order, {"start": np.array(start, np.int32), "end": np.array(end, np.int32), "right": np.array(right, np.int32), "radius": np.array(radius), "sums": np.array(sums, np.int64)}


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row by exact squared distance; ties: the smaller number."""
    return (np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2 * products(x, centroids)).argmin(1)


def filtered(x: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(balls [(node, centroid)] that one centroid owns, numbers of the other rows, their
    nearest centroids), from the root down, a level at a time."""
    z = centroids.astype(np.float64)
    z2 = np.einsum("ij,ij->i", z, z)
    count = (tree["end"] - tree["start"])[:, None]
    middle = tree["sums"] / count
    front, alive = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    owned: list[tuple[int, int]] = []
    rows, found = [], []
    while len(front):
        p, r = middle[front], tree["radius"][front][:, None]
        p2 = np.einsum("ij,ij->i", p, p)[:, None]
        square, slack = p2 - 2 * p @ z.T + z2, 1e-9 * (p2 + z2 + 1)  # slack: what rounding can be
        upper, lower = np.sqrt(np.maximum(square, 0) + slack), np.sqrt(np.maximum(square - slack, 0))
        reach = np.where(alive, upper, np.inf).min(1, keepdims=True) + r
        alive = alive & (lower - r <= reach)
        whole_ball = alive.sum(1) == 1
        owned += zip(front[whole_ball].tolist(), alive[whole_ball].argmax(1).tolist(), strict=True)
        leaf = ~whole_ball & (tree["right"][front] == 0)
        for node, some in zip(front[leaf].tolist(), alive[leaf], strict=True):
            at = np.arange(tree["start"][node], tree["end"][node])
            left = np.flatnonzero(some)
            rows.append(at)
            found.append(left[nearest(x[at], centroids[left])])
        inner = ~whole_ball & ~leaf
        front, alive = np.concatenate([front[inner] + 1, tree["right"][front[inner]]]), np.concatenate([alive[inner], alive[inner]])
    none = np.zeros(0, np.int64)
    return owned, np.concatenate([none, *rows]), np.concatenate([none, *found])


# -------------------------------------------------------------------- blocks

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]
    ids: list[pa.Array] = []
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        order, tree = build_tree(x := np.concatenate(held))
        x = x[order]
        keys = pa.concat_arrays(ids).take(pa.array(order))
        small = np.abs(x).max() < 1 << 15
        columns = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([x.astype(np.int16 if small else np.int32).tobytes()])]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([tree[c].tobytes()]) for c in names[2:]]], names)

    for batch in batches:
        rows, x = rows_of(batch.column(1), DIMS, SCALE, LIMIT)
        key = batch.column(0).take(pa.array(rows))
        while len(x):
            room = BLOCK_ROWS - sum(map(len, held))
            ids.append(key[:room]), held.append(x[:room])
            key, x = key[room:], x[room:]
            if sum(map(len, held)) == BLOCK_ROWS:
                yield flush()
                ids, held = [], []
    if held:
        yield flush()


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    kinds = {"start": np.int32, "end": np.int32, "right": np.int32, "radius": np.float64, "sums": np.int64}
    for k in range(batch.num_rows):
        ids, raw = batch.column("ids")[k].values, batch.column("vectors")[k].as_py()
        x = np.frombuffer(raw, np.int16 if len(raw) == 2 * DIMS * len(ids) else np.int32).reshape(len(ids), DIMS).astype(np.int64)
        tree = {c: np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in kinds.items()}
        tree["sums"] = tree["sums"].reshape(-1, DIMS)
        yield ids, x, tree


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row (cluster, n, sums) for each centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, x, tree in _unpacked(batch):
                owned, rows, found = filtered(x, tree, centroids)
                for node, c in owned:
                    n[c] += tree["end"][node] - tree["start"][node]
                    total[c] += tree["sums"][node]
                order = np.argsort(found, kind="stable")
                kinds, first = np.unique(found[order], return_index=True)
                if len(kinds):
                    total[kinds] += np.add.reduceat(x[rows[order]], first)
                    n[kinds] += np.diff(np.append(first, len(found)))
        at = np.flatnonzero(n)
        if len(at):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * DIMS, pa.int32()), pa.array(total[at].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), lists], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, tree in _unpacked(batch):
                owned, rows, found = filtered(x, tree, centroids)
                cluster = np.zeros(len(x), np.int32)
                cluster[rows] = found
                for node, c in owned:
                    cluster[tree["start"][node] : tree["end"][node]] = c
                away = x - centroids[cluster]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(np.einsum("ij,ij->i", away, away))], ["vec_id", "cluster", "distance"])

    return run


# ------------------------------------------------------------------- operator

def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`."""
    good = vectors.filter((F.size("embedding") == DIMS) & finite("embedding") & F.col("vec_id").isNotNull())
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = good.select(drawn.alias("h"), F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v"), "embedding").orderBy("h", "v").limit(k).collect()
    return whole(np.array([r["embedding"] for r in rows], np.float64).reshape(-1, DIMS), SCALE, LIMIT)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) for vectors (vec_id, embedding), the centroids): `rounds`
    of Lloyd's iteration in whole numbers, and a last assignment."""
    spark = vectors.sparkSession
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = first_centroids(held, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT), centroids
    with Tables(spark) as tables:
        blocks = tables.table(held.mapInArrow(lean(_blocks), BLOCK))
        for _ in range(rounds):
            parts = blocks.mapInArrow(lean(_sums(centroids)), "cluster int, n bigint, sums array<bigint>")
            totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMS)]).alias("sums")).collect()
            for r in totals:  # at most k rows
                centroids[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
        return tables.keep(blocks.mapInArrow(lean(_assigned(centroids)), RESULT)), centroids


def cluster_documents(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    assigned, centroids = cluster(vectors, k, rounds, seed)
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
