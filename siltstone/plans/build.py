"""The offline build: documents to chunks to extractions to a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..operators import chunking, extraction, graph, graph_build, vector
from ..operators.membership import among, likely
from ..sources import readers, scratch, sinks, stores


def chunk(spark: SparkSession, root: str, out: str) -> DataFrame:
    docs = readers.markdown_documents(spark, root)
    return sinks.write_chunks(chunking.enrich(chunking.chunk_documents(docs), docs), out)


def extract(spark: SparkSession, chunks: str, out: str, model, run: str) -> None:
    done = spark.read.parquet(out) if readers.table_exists(spark, out) else None
    sinks.append_records(extraction.extract(spark.read.parquet(chunks), model, done), out, run)


#: What extractions add comes after all metadata.
LATER = 1 << 61


def records(meta: DataFrame | None, ext: DataFrame | None, phase: str = "all", compat: bool = False, importer: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw (nodes, edges) of the phase: metadata, extraction, or all; importer: those of the
    second generation."""
    parts = []
    if phase in ("metadata", "all") and meta is not None:
        parts.append(graph_build.from_metadata(meta, compat, importer))
    if phase in ("extraction", "all") and ext is not None:
        made = graph_build.importer_records(ext) if importer else graph_build.from_extractions(ext)
        parts.append(tuple(x.withColumn("seq", F.col("seq") + F.lit(LATER)) for x in made))
    if not parts:
        raise ValueError(f"nothing to build in phase {phase}")
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges


def build_graph(meta: DataFrame | None, ext: DataFrame | None, out: str, phase: str = "all", parallel_edges: bool = True, importer: bool = False) -> DataFrame:
    """Upserts nodes, checks edges, stores both and returns the stored graph's counts."""
    nodes, edges = records(meta, ext, phase, importer=importer)
    nodes = graph.upsert_nodes(nodes)
    edges = graph.checked_edges(edges if parallel_edges else graph.distinct_edges(edges), nodes)
    sinks.write_graph(nodes, edges, out)
    return graph.stats(*readers.graph_tables(nodes.sparkSession, out))


def add_extractions(old: graph.Graph, ext: DataFrame, out: str) -> DataFrame:
    """A stored graph with the nodes and edges of more extractions, stored at `out`; returns
    the counts before and after."""
    nodes, edges = (x.withColumn("seq", F.col("seq") + F.lit(LATER)) for x in graph_build.from_extractions(ext))
    nodes = graph.upsert_nodes(old.nodes.select(*graph.NODE).unionByName(nodes))
    edges = old.edges.select(*graph.EDGE).unionByName(graph.checked_edges(edges, nodes))
    sinks.write_graph(nodes, edges, out)
    return graph.delta(graph.stats(old.nodes, old.edges), graph.stats(*readers.graph_tables(nodes.sparkSession, out)))


def import_extractions(store: stores.BucketStore, ext: DataFrame) -> DataFrame:
    """Adds the nodes and edges of more extractions to a store on disk, in place; returns the
    counts after, and what came. Only buckets that change are written."""
    before = graph.stats(*_frames(store)).collect()  # a row for each label and relationship
    store.add(*[x.withColumn("seq", F.col("seq") + F.lit(LATER)) for x in graph_build.from_extractions(ext)])
    return graph.delta(store.spark.createDataFrame(before, "kind string, name string, n long"), graph.stats(*_frames(store)))


def _frames(store: stores.BucketStore) -> tuple[DataFrame, DataFrame]:
    return store.graph.nodes, store.graph.edges


def rebuild(spark: SparkSession, root: str, out: str, extractions: str | None = None) -> DataFrame:
    """All steps from files to a stored graph, and its counts."""
    ext = readers.extractions_jsonl(spark, extractions) if extractions and readers.table_exists(spark, extractions) else None
    return build_graph(readers.metadata_files(spark, root), ext, out)


def statements(meta: DataFrame | None, ext: DataFrame | None, out: str, phase: str = "all", importer: bool = True) -> DataFrame:
    """Writes the MERGE statements of the phase (nodes before edges) and returns how many."""
    nodes, edges = records(meta, ext, phase, importer=importer)
    nodes, edges = graph.keep_first(nodes, ["label", "id"]), graph.keep_first(edges, ["from_id", "rel", "to_id"])
    sinks.write_statements(graph_build.cypher_nodes(nodes, graph.NODE_KEYS), f"{out}/nodes")
    sinks.write_statements(graph_build.cypher_edges(edges, graph.NODE_KEYS), f"{out}/edges")
    spark = nodes.sparkSession
    return spark.read.text([f"{out}/nodes", f"{out}/edges"]).agg(F.count(F.lit(1)).alias("statements"))


def index_chunks(spark: SparkSession, chunks: str, out: str, encoder: vector.Encoder, cache: str | None = None) -> DataFrame:
    """Embeds the chunks that the index at `out` lacks and appends them, each id once; returns
    how many the index holds. Each distinct text that the cache lacks is encoded once and
    stored in the cache, from which the index then takes all; a run that was broken off finds
    there what it has paid for. Without a cache of the caller's it is a scratch folder. What is
    new is found from ids and keys; a new text is shuffled to be encoded, and to its vector."""
    rows = chunking.vector_rows(spark.read.parquet(chunks)).withColumn("k", cache_key(F.col("document")))
    keys = rows.filter("k is not null").groupBy("id").agg(F.min("k").alias("k"))  # no text, no vector
    if readers.table_exists(spark, out):
        keys = vector.not_indexed(keys, spark.read.parquet(out))
    aside = scratch.folder(spark, "new")
    keys.write.parquet(aside)
    new = spark.read.schema(keys.schema).parquet(aside)
    held = cache if cache is not None else scratch.folder(spark, "embeddings")
    known = readers.embedding_cache(spark, held) if readers.table_exists(spark, held) else spark.createDataFrame([], "k string, v array<float>")
    one = F.struct("id", "k").alias("one")  # equal with a null id, too
    first = new.join(known.select("k"), "k", "left_anti").groupBy("k").agg(F.min("id").alias("id")).select(one)
    texts = among(rows.select(one, "k", F.col("document").alias("text")), first, ["one"]).dropDuplicates(["one"])
    sinks.append_cache(vector.encode(texts, encoder), held)
    made = new.join(readers.embedding_cache(spark, held), "k").select(one, F.col("v").alias("embedding"))
    rows = rows.select(one, *[c for c in rows.columns if c != "k"])
    rows = likely(rows, made, ["one"]) if readers.table_exists(spark, out) else rows
    rows.join(made, "one").dropDuplicates(["one"]).drop("one").write.mode("append").parquet(out)
    for path in (aside, *([held] if cache is None else [])):
        scratch.remove(spark, path)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("vectors"))
