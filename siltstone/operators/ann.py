"""An approximate vector index: cells of a coarse k-means as partitions of a stored table,
some of them probed for each query, exact scores for what they hold.

Below `path`: cells (cell, centroid), fitted on a bounded sample of unit vectors; vectors, in
blocks, partitioned by cell and batch, so that a search reads the folders of probed cells
only; batches, one row for each that is complete; and about, which holds the number of probes
at which recall reached the wanted value when the index was built or tuned.

Every row is indexed: only the cells' centres are fitted on a sample. With all cells probed a
search is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table_exists
from . import vector

#: Vectors that cells are fitted on, for each cell, and cells at most: centres are held by
#: the driver and every task, whatever the input.
SAMPLE_PER_CELL, MAX_CELLS, ROUNDS = 64, 4096, 8
#: Scores of rows and centres that a task holds at once.
SCORES = 1 << 20
#: Queries that recall is measured on, and the share of the exact hits that probes must find.
TUNE_QUERIES, RECALL = 200, 0.95


def fit_cells(vectors: DataFrame, cells: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of length 1 by Lloyd's rounds over at most SAMPLE_PER_CELL * cells distinct
    rows, drawn by a hash of the id."""
    held = vectors.filter("embedding is not null").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "seq").limit(SAMPLE_PER_CELL * cells).select("embedding")
    rows = np.array([r[0] for r in held.collect()], np.float64)
    if not len(rows):
        raise ValueError("an index needs vectors to fit its cells on")
    x = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        label = np.concatenate([(x[lo : lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(x), 4096)])
        for c in np.unique(label):
            total = x[label == c].sum(0)
            if (size := np.linalg.norm(total)) > 0:
                centres[c] = total / size
    return centres


def assign(rows: DataFrame, centres: np.ndarray, n: int = 1) -> DataFrame:
    """rows (..., embedding) with the cell (n = 1), or the n nearest as an array, by inner
    product; ties go to the smaller number."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(names.index("embedding"))
            near = np.zeros((batch.num_rows, n), np.int32)
            step = max(1, SCORES // len(centres))  # rows at a time, whatever the batch and the cells
            for lo in range(0, batch.num_rows, step):
                part = lists.slice(lo, step)
                score = np.round(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1) @ centres.T, 12)
                near[lo : lo + len(part)] = score.argmax(1)[:, None] if n == 1 else np.argsort(-score, axis=1, kind="stable")[:, :n]
            cell = pa.array(near[:, 0] if n == 1 else list(near), pa.int32() if n == 1 else pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], [*names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + (", cell int" if n == 1 else ", cell array<int>")
    return rows.filter("embedding is not null").mapInArrow(run, schema)


@dataclass
class CellIndex:
    spark: SparkSession
    path: str

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # at most MAX_CELLS
        return np.array([r["centroid"] for r in rows], np.float64)

    def about(self) -> Row:
        return self.spark.read.parquet(f"{self.path}/about").first()

    @property
    def probes(self) -> int:
        return self.about()["probes"]

    def _vectors(self) -> DataFrame:
        return self.spark.read.schema(self.about()["form"]).parquet(f"{self.path}/vectors")

    def blocks(self) -> DataFrame:
        """Blocks of complete batches: what a lost run has left is not seen."""
        batches = [r["batch"] for r in self.spark.read.parquet(f"{self.path}/batches").collect()]
        return self._vectors().filter(F.col("batch").isin(batches))

    def ids(self) -> DataFrame:
        return self.blocks().select(F.explode("vids").alias("id"))

    def add(self, vectors: DataFrame, batch: str) -> int:
        """Adds those of vectors (id, seq, embedding) whose id the index lacks and returns how
        many. A batch that is written again replaces itself."""
        batch = f"b_{batch}"  # never read as a number
        new = vectors.filter("embedding is not null").dropDuplicates(["id"])
        if table_exists(self.spark, f"{self.path}/batches"):
            held = self.blocks().filter(F.col("batch") != batch).select(F.explode("vids").alias("id"))
            new = new.join(held, "id", "left_anti")
        placed = assign(new.select("id", "seq", "embedding"), self.centres())
        dealt = placed.hint("rebalance", "cell").sortWithinPartitions("cell", "seq")  # large cells are split
        blocks = vector.packed(dealt, ("id", "seq"), "v", by="cell").withColumn("batch", F.lit(batch))
        blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "cell").parquet(f"{self.path}/vectors")
        n = self._vectors().filter(F.col("batch") == batch).agg(F.sum(F.size("vids"))).first()[0] or 0
        self.spark.createDataFrame([(n, batch)], "n long, batch string").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/batches")
        return n

    def search(self, queries: DataFrame, top_k: int = 10, probes: int | None = None) -> DataFrame:
        """(qid, id, score, rank from 0) for queries (qid, embedding): exact cosines of the
        vectors in each query's `probes` nearest cells. A probed cell's queries are tiles that
        its blocks are joined to; only folders of probed cells are read."""
        centres = self.centres()
        probes = min(probes or self.probes, len(centres))
        near = assign(queries.select("qid", "embedding"), _unit(centres), probes) if probes > 1 else assign(queries.select("qid", "embedding"), _unit(centres)).withColumn("cell", F.array("cell"))
        asked = near.select("qid", F.col("qid").alias("_seq"), "embedding", F.explode("cell").alias("cell"))
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most MAX_CELLS
        tiles = vector.packed(asked.hint("rebalance", "cell").sortWithinPartitions("cell"), ("qid", "_seq"), "q", by="cell").select("cell", "qids", "qm")
        held = self.blocks().filter(F.col("cell").isin(wanted))
        kinds = held.schema
        types = (queries.schema["qid"].dataType, kinds["vids"].dataType.elementType, kinds["vseqs"].dataType.elementType)
        return vector.ranked(vector.scored_pairs(held.join(tiles, "cell"), types, top_k), top_k)

    def rows(self) -> DataFrame:
        """(id, seq, embedding) of all vectors."""
        kinds = self.blocks().schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):  # views: a block's values are not copied
                    ids, seqs = batch.column(0)[k].values, batch.column(1)[k].values
                    flat = np.frombuffer(batch.column(2)[k].as_buffer())
                    edges = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (len(flat) // len(ids)))
                    yield pa.RecordBatch.from_arrays([ids, seqs, pa.ListArray.from_arrays(edges, pa.array(flat))], ["id", "seq", "embedding"])

        key, place = (kinds[c].dataType.elementType.simpleString() for c in ("vids", "vseqs"))
        return self.blocks().select("vids", "vseqs", "vm").mapInArrow(run, f"id {key}, seq {place}, embedding array<double>")

    def exact(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(qid, wanted, least): how many hits an exact search finds, and the last one's score."""
        return vector.search(self.rows(), queries, top_k).groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"), F.min(F.round("score", 9)).alias("least"))

    def recall(self, queries: DataFrame, top_k: int = 10, probes: int | None = None, exact: DataFrame | None = None) -> DataFrame:
        """(qid, found, wanted): how many of each query's exact top_k a search finds; a hit as
        good as the last exact one counts."""
        exact = self.exact(queries, top_k) if exact is None else exact
        mine = self.search(queries, top_k, probes).join(exact.select("qid", "least"), "qid").filter(F.round("score", 9) >= F.col("least"))
        return exact.join(mine.groupBy("qid").agg(F.count(F.lit(1)).alias("found")), "qid", "left").select("qid", F.coalesce("found", F.lit(0)).alias("found"), "wanted")

    def tune(self, queries: DataFrame, recall: float = RECALL, top_k: int = 10) -> int:
        """The least number of probes, doubled until at most TUNE_QUERIES of queries (qid,
        embedding) have the mean recall; it becomes the index's own."""
        some = queries.filter("embedding is not null").orderBy(F.xxhash64("qid")).limit(TUNE_QUERIES)
        cells = len(self.centres())
        probes, exact = max(1, cells // 16), self.exact(some, top_k).persist()  # a row for each query
        while probes < cells:
            r = self.recall(some, top_k, probes, exact).agg(F.sum("found").alias("f"), F.sum("wanted").alias("w")).first()
            if not r["w"] or r["f"] >= recall * r["w"]:
                break
            probes = min(2 * probes, cells)
        exact.unpersist()
        self._about(probes, self.about()["form"])
        return probes

    def _about(self, probes: int, form: str) -> None:
        self.spark.createDataFrame([(probes, form)], "probes int, form string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float | None = RECALL, batch: str = "first", seed: int = 7) -> CellIndex:
    """An index of vectors (id, seq, embedding) at a path that is free: about the square root
    of their number of cells, MAX_CELLS at most. recall: probes are tuned to it by vectors of
    the index; None: half of the cells are probed."""
    spark = vectors.sparkSession
    if cells is None:
        cells = math.isqrt(vectors.count())
    centres = fit_cells(vectors, min(max(cells, 1), MAX_CELLS), seed)
    spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(centres)], "cell int, centroid array<double>").write.parquet(f"{path}/cells")
    index = CellIndex(spark, path)
    kinds = dict(vectors.dtypes)
    index._about(max(1, len(centres) // 2), f"vids array<{kinds['id']}>, vseqs array<{kinds['seq']}>, vm binary, batch string, cell int")
    index.add(vectors, batch)
    if recall is not None:
        index.tune(index.rows().select(F.col("id").alias("qid"), "embedding"), recall)
    return index
