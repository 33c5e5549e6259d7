"""Exact top-k search by inner product: tiled products, selection per tile, merging by a tree.

Candidates become blocks of at most BLOCK_ROWS vectors, queries tiles of at most TILE_ROWS,
both as integers. A grid deals them out: a block goes to one row of the grid and all its
columns, a tile to one column and all its rows, so that an equality join brings each pair
together once; neither side is broadcast or held whole by a task. A pair is one product of
matrices, and only each query's k best of it leave the task, one packed row for a pair.
Lists of a tile are then merged FAN_IN at a time, level by level, first over the blocks of an
input partition, then over partitions, so that no task gets all lists of a query.

Edge cases: vectors that are null, without vec_id, or hold a null or non-finite component
take no part. Vectors of different lengths are not compared. A query's own candidates are
those with its vec_id. Repeated rows are candidates each, but one query; different vectors of
one vec_id are queries each. Ties go to the smaller vec_id. Scores that do not fit a long are
an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, lean, shuffle_parts
from .vectors import components, finite, products, whole

TOP, SCALE = 10, 1024
BLOCK_ROWS, TILE_ROWS = 4096, 512
#: Lists merged in one group of a level.
FAN_IN = 64
#: Pairs of a block and a tile for each cell of the grid, on average.
CELL_PAIRS = 16
#: Components that a packing task holds before it closes blocks that are not full.
HELD = 1 << 22
LIMIT = (1 << 31) - 1
#: Stands for no candidate; no score is so low.
NONE = -(2**63 - 1)
PACKED = "dims int, part int, no int, ids binary, vectors binary"
LISTS = "tile bigint, part int, no int, qids binary, ids binary, scores binary"
RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def _packer(scale: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of at most `size` vectors of one length, with rising ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal no
            some = held.pop(dims)
            ids, x = (np.concatenate([s[k] for s in some]) for k in (0, 1))
            order = np.argsort(ids, kind="stable")
            columns = [pa.array([dims], pa.int32()), pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([x[order].astype(np.int32).tobytes()])]
            no += 1
            return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in PACKED.split(", ")])

        for batch in batches:
            values, start, end = components(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            length = end - start
            for dims in np.unique(length[length >= 0]).tolist():
                rows = np.flatnonzero(length == dims)
                while len(rows):
                    room = size - sum(len(s[0]) for s in held.get(dims, []))
                    at = rows[:room]
                    held.setdefault(dims, []).append((ids[at].astype(np.int64), whole(values[start[at][:, None] + np.arange(dims)], scale, LIMIT)))
                    rows = rows[room:]
                    if room <= len(at):
                        yield flush(dims)
            while sum(s[1].size + len(s[0]) for some in held.values() for s in some) > HELD:
                yield flush(max(held, key=lambda d: sum(len(s[0]) * (d + 1) for s in held[d])))
        for dims in list(held):
            yield flush(dims)

    return run


def select(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of each query's k best among candidates with rising ids, best first;
    its own id is none of them. Always k columns; NONE where there are fewer."""
    scores = np.where(ids[None, :] == qids[:, None], NONE, scores)
    n = scores.shape[1]
    if n > k:
        bound = np.abs(np.where(scores == NONE, 0, scores)).max(initial=0)
        if bound < 2**62 // n:  # one number for score and place, so that no two are equal
            keys = np.where(scores == NONE, NONE, scores * n - np.arange(n))
            at = np.argpartition(-keys, k - 1, axis=1)[:, :k]
            at = np.take_along_axis(at, np.argsort(-np.take_along_axis(keys, at, 1), axis=1, kind="stable"), 1)
        else:
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    else:
        at = np.argsort(-scores, axis=1, kind="stable")
    best, who = np.take_along_axis(scores, at, 1), ids[at]
    if n < k:
        best = np.pad(best, ((0, 0), (0, k - n)), constant_values=NONE)
        who = np.pad(who, ((0, 0), (0, k - n)))
    return who, best


def _scored(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                x, q = (np.frombuffer(r[c], np.int32).astype(np.int64).reshape(n, r["dims"]) for c, n in (("vectors", len(ids)), ("queries", len(qids))))
                who, best = select(qids, ids, products(q, x), k)
                yield pa.RecordBatch.from_arrays([pa.array([r["tile"]], pa.int64()), pa.array([r["part"]], pa.int32()), pa.array([r["no"]], pa.int32()), *[pa.array([v]) for v in (r["qids"], who.tobytes(), best.tobytes())]], [c.split(" ")[0] for c in LISTS.split(", ")])

    return run


def _merger(k: int) -> Callable[[pa.Table], pa.Table]:
    def merge(group: pa.Table) -> pa.Table:
        if group.num_rows == 1:
            return group
        qids = group.column("qids")[0].as_py()
        ids, scores = (np.concatenate([np.frombuffer(v, np.int64).reshape(-1, k) for v in group.column(c).to_pylist()], 0).reshape(group.num_rows, -1, k) for c in ("ids", "scores"))
        ids, scores = (v.transpose(1, 0, 2).reshape(v.shape[1], -1) for v in (ids, scores))
        at = np.lexsort((ids, -scores), axis=-1)[:, :k]
        best = [np.take_along_axis(v, at, 1).tobytes() for v in (ids, scores)]
        return pa.table({"tile": group.column("tile")[:1], "part": group.column("part")[:1], "no": group.column("no")[:1], "qids": pa.array([qids]), "ids": pa.array([best[0]]), "scores": pa.array([best[1]])})

    return merge


def _unpacked(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qids, ids, scores = (np.frombuffer(r[c], np.int64) for c in ("qids", "ids", "scores"))
                held = scores != NONE
                rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(qids))
                yield pa.RecordBatch.from_arrays([pa.array(v[held]) for v in (np.repeat(qids, k), rank, ids, scores)], ["query_id", "rank", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each of queries (vec_id, embedding) the k
    of vectors (vec_id, embedding) with the highest inner products of floor(scale * x)."""
    spark = vectors.sparkSession
    plain = lambda df: df.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    with Tables(spark) as tables:
        blocks = tables.table(plain(vectors).mapInArrow(lean(_packer(scale, BLOCK_ROWS)), PACKED))
        asked = tables.table(plain(queries).filter(finite("embedding")).dropDuplicates(["vec_id", "embedding"]))
        few = max(1, math.ceil(asked.count() / TILE_ROWS))
        packed = asked.repartition(few, "vec_id").mapInArrow(lean(_packer(scale, TILE_ROWS)), PACKED)
        tiles = tables.table(packed.select("dims", (F.shiftleft(F.col("part").cast("long"), 32) + F.col("no")).alias("tile"), F.col("ids").alias("qids"), F.col("vectors").alias("queries")))
        size = blocks.agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("part"), F.max("no").alias("no")).first()
        n_tiles = tiles.count()
        if not size["n"] or not n_tiles:
            return spark.createDataFrame([], RESULT)
        cells = max(1, math.ceil(size["n"] * n_tiles / CELL_PAIRS))
        columns = min(max(round(math.sqrt(cells * n_tiles / size["n"])), 1), n_tiles)
        rows = min(max(math.ceil(cells / columns), 1), size["n"])
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = blocks.withColumn("row", F.pmod(F.xxhash64("part", "no"), F.lit(rows)).cast("int")).withColumn("column", all_of(columns))
        right = tiles.withColumn("column", F.pmod(F.xxhash64("tile"), F.lit(columns)).cast("int")).withColumn("row", all_of(rows))
        parts = shuffle_parts(spark, cells, 1)
        joined = left.repartition(parts, "dims", "row", "column").join(right.repartition(parts, "dims", "row", "column"), ["dims", "row", "column"])
        lists = tables.table(joined.select("dims", "tile", "part", "no", "qids", "queries", "ids", "vectors").mapInArrow(lean(_scored(k)), LISTS))
        for level in ("no", "part"):
            width = size[level]
            while width > 0:
                width //= FAN_IN
                lists = lists.withColumn(level, F.floor(F.col(level) / FAN_IN).cast("int")).groupBy("tile", "part", "no").applyInArrow(_merger(k), LISTS)
        return tables.keep(lists.mapInArrow(lean(_unpacked(k)), RESULT))


def search_every(vectors: DataFrame, step: int = 100, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """search() of the rows whose vec_id is divisible by `step` in all rows."""
    return search(vectors, vectors.filter(F.col("vec_id") % step == 0), k, scale)
