"""A graph store: what nodes and edges are added to, searched in, persisted to and loaded from."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.membership import likely
from . import readers, scratch, sinks

BACKEND = "SILTSTONE_GRAPH_BACKEND"


class GraphStore(ABC):
    """The contract. Nodes and edges are frames in the form of operators.graph."""

    @abstractmethod
    def add_nodes(self, rows: DataFrame) -> None: ...

    @abstractmethod
    def add_edges(self, rows: DataFrame) -> None: ...

    @abstractmethod
    def query(self, statement: str) -> DataFrame: ...

    @abstractmethod
    def text_search(self, queries: DataFrame, top_k: int = 10) -> DataFrame: ...

    @abstractmethod
    def stats(self) -> DataFrame: ...

    @abstractmethod
    def persist(self, path: str) -> None: ...

    @abstractmethod
    def load(self, path: str) -> None: ...


class FrameStore(GraphStore):
    """Over two frames; persisted as Parquet. Nodes of one id are merged, edges without
    both ends left out, when the store is read."""

    def __init__(self, spark: SparkSession):
        self.nodes = spark.createDataFrame([], f"id string, label string, props {graph.PROPS}, seq long")
        self.edges = spark.createDataFrame([], f"from_id string, from_label string, rel string, to_id string, to_label string, props {graph.PROPS}, seq long")

    def add_nodes(self, rows: DataFrame) -> None:
        self.nodes = self.nodes.unionByName(rows.select(*graph.NODE))

    def add_edges(self, rows: DataFrame) -> None:
        self.edges = self.edges.unionByName(rows.select(*graph.EDGE))

    @property
    def graph(self) -> graph.Graph:
        nodes = graph.upsert_nodes(self.nodes)
        return graph.Graph(nodes, graph.checked_edges(self.edges, nodes))

    def query(self, statement: str) -> DataFrame:
        return self.graph.by_label(statement)

    def text_search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        return self.graph.text_search(queries, top_k)

    def stats(self) -> DataFrame:
        g = self.graph
        return graph.stats(g.nodes, g.edges)

    def persist(self, path: str) -> None:
        g = self.graph
        sinks.write_graph(g.nodes, g.edges, path)

    def load(self, path: str) -> None:
        self.nodes, self.edges = readers.graph_tables(self.nodes.sparkSession, path)


class BucketStore:
    """A graph on disk that grows by batches: nodes in folders by a hash of the id, edges by
    a hash of from_id. A batch reads the buckets that it touches and replaces those whose
    content it changes; others keep their files. A batch that is added again changes nothing,
    and one that was broken off is completed by adding it again."""

    BUCKETS = 64
    #: Of more rows no bucket is looked for; all are read.
    MANY = 100 * BUCKETS

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def _bucket(cls, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(cls.BUCKETS)).cast("int")

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        form = f"id string, label string, props {graph.PROPS}, seq long" if table == "nodes" else f"from_id string, from_label string, rel string, to_id string, to_label string, props {graph.PROPS}, seq long"
        if not readers.table_exists(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], f"{form}, bucket int")
        rows = self.spark.read.schema(f"{form}, bucket int").parquet(f"{self.path}/{table}")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    @property
    def graph(self) -> graph.Graph:
        return graph.Graph(self._read("nodes").select(*graph.NODE), self._read("edges").select(*graph.EDGE))

    def add(self, nodes: DataFrame, edges: DataFrame) -> dict[str, int]:
        """Merges nodes by id, and adds edges of which both ends are there then, each once;
        returns how many buckets of nodes and edges have changed."""
        new = nodes.select(*graph.NODE).withColumn("bucket", self._bucket("id"))
        old = self._read("nodes", self._touched(nodes, "id"))
        merged = graph.upsert_nodes(old.select(*graph.NODE).unionByName(new.select(*graph.NODE))).withColumn("bucket", self._bucket("id"))
        changed = {"nodes": self._replace("nodes", old, merged)}
        held = self._read("nodes", self._touched(edges, "from_id", "to_id"))
        checked = edges.select(*graph.EDGE)
        for side in ("from_id", "to_id"):  # edges without ends are not shuffled
            checked = likely(checked, held.select(F.col("id").alias(side)), [side])
        key = ("from_id", "rel", "to_id", "seq")
        checked = graph.checked_edges(checked, held).dropDuplicates(list(key)).withColumn("bucket", self._bucket("from_id"))
        aside = scratch.folder(self.spark, "checked")
        checked.write.parquet(aside)
        checked = self.spark.read.schema(checked.schema).parquet(aside)
        old = self._read("edges", self._buckets(checked))
        more = checked.join(old.select(*key), list(key), "left_anti")
        changed["edges"] = self._replace("edges", old, old.unionByName(more.select(*old.columns)))
        scratch.remove(self.spark, aside)
        return changed

    def _touched(self, rows: DataFrame, *keys: str) -> list[int] | None:
        """The buckets of the rows' keys; None, for all, of so many rows that none is left out."""
        if rows.limit(self.MANY + 1).count() > self.MANY:
            return None
        return self._buckets(rows.select(F.explode(F.array(*[self._bucket(k) for k in keys])).alias("bucket")))

    @staticmethod
    def _buckets(rows: DataFrame) -> list[int]:
        return [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS

    def _replace(self, table: str, old: DataFrame, new: DataFrame) -> int:
        """Replaces the folders of buckets whose rows differ. The new rows are written aside
        first: what is replaced is what they are made from."""
        aside = scratch.folder(self.spark, table)
        new.write.parquet(aside)
        made = self.spark.read.schema(new.schema).parquet(aside)
        row = F.xxhash64(*[F.map_entries(c) if c == "props" else F.col(c) for c in old.columns])
        sums = lambda df, name: df.groupBy("bucket").agg(F.struct(F.count(F.lit(1)), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)"))).alias(name))
        both = sums(made.withColumn("h", row), "b").join(sums(old.withColumn("h", row), "a"), "bucket", "left")
        changed = [r["bucket"] for r in both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect()]  # at most BUCKETS
        if changed:
            out = made.filter(F.col("bucket").isin(changed)).hint("rebalance", "bucket")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{table}")
        scratch.remove(self.spark, aside)
        return len(changed)


class JsonStore(FrameStore):
    """Loads from one JSON object of nodes and edges, as other tools write it."""

    def load(self, path: str) -> None:
        self.nodes, self.edges = readers.graph_json(self.nodes.sparkSession, path)


BACKENDS: dict[str, Callable[[SparkSession], GraphStore]] = {"frames": FrameStore, "json": JsonStore}


def graph_store(spark: SparkSession, backend: str | None = None) -> GraphStore:
    """A store of the given backend, else the environment's, else over frames; others can be
    added to BACKENDS."""
    name = backend or os.environ.get(BACKEND, "frames")
    if name not in BACKENDS:
        raise ValueError(f"unknown graph backend: {name}; there are {sorted(BACKENDS)}")
    return BACKENDS[name](spark)
