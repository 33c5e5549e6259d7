"""Readers: document trees, sidecar metadata, JSON lines, graphs, caches, evaluation sets."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import EXTRACTION

META = (
    "full_name string, target_file string, standard_id string, standard_type string, validity_status boolean, effective_date string, region_type string, "
    "region_name string, summary string, issuing_authority array<string>, supersedes array<struct<name:string,supersedes_time:string>>"
)
CHUNK = f"chunk_id string, doc_id string, doc_type string, span_start bigint, span_end bigint, text string, structure_path array<string>, article_no string, themes array<string>, doc_metadata struct<{META.replace(' ', ':').replace(',:', ', ')}>, source_path string"
RECORD = f"doc_id string, doc_path string, doc_meta struct<{META.replace(' ', ':').replace(',:', ', ')}>, raw_text_preview string, error string, article_no string, text_preview string, extraction {EXTRACTION}"
EVAL = "id string, type string, difficulty string, question string, expected_answer_keywords array<string>, expected_evidence array<string>"
DATA_ROOT = "SILTSTONE_DATA_ROOT"
log = logging.getLogger(__name__)


def data_root(given: str | None = None, candidates: tuple[str, ...] = ("data", "../data")) -> str:
    """The argument, else the environment's, else the first default that exists."""
    return given or os.environ.get(DATA_ROOT) or next((c for c in candidates if os.path.isdir(c)), candidates[0])


def _folder(path: str = "path") -> F.Column:
    return F.regexp_replace(F.col(path), r"/[^/]*$", "")


def metadata_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, seq and the fields of compliance_assessment) of all metadata.json
    files; those that are malformed or without the assessment are left out. seq follows the
    order of paths."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").load(root)
    rows = raw.select("path", _folder().alias("folder"), F.from_json(F.decode("content", "UTF-8"), f"compliance_assessment struct<{META.replace(' ', ':').replace(',:', ', ')}>").alias("m"))
    held = rows.filter("m.compliance_assessment is not null").select("path", "folder", "m.compliance_assessment.*")
    # numbers rise with the partition, and sorted partitions rise with the path
    return held.orderBy("path").withColumn("seq", F.monotonically_increasing_id()).select("path", "folder", "seq", *held.columns[2:])


def markdown_documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text, source_path, doc_metadata) of all .md files below root; doc_id is the
    folder's name. Bytes that are not UTF-8 are replaced; metadata of the same folder is
    joined, null if there is none."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).load(root)
    text = F.expr("make_valid_utf8(cast(content as string))")
    docs = raw.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("doc_id"), text.alias("text"), F.col("path").alias("source_path"), _folder().alias("folder"))
    meta = metadata_files(spark, root)
    meta = meta.select("folder", F.struct(*[c for c in meta.columns if c not in ("path", "folder", "seq")]).alias("doc_metadata"))
    return docs.join(meta, "folder", "left").drop("folder")


def chunks_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Chunks with seq, their order in the file; limit: the first ones."""
    rows = spark.read.schema(CHUNK).json(path).withColumn("seq", F.monotonically_increasing_id())
    return rows.orderBy("seq").limit(limit) if limit is not None else rows


def extractions_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Extraction records with seq; strict: a malformed line is an error, else left out."""
    reader = spark.read.schema(RECORD).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(path).withColumn("seq", F.monotonically_increasing_id())


def graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph from one JSON object {nodes: {id: {label, props}}, edges: [...]}."""
    g = spark.read.schema("nodes map<string,struct<label:string,props:map<string,string>>>, edges array<struct<from_id:string,from_label:string,rel:string,to_id:string,to_label:string,props:map<string,string>>>").option("multiLine", True).json(path)
    nodes = g.select(F.posexplode(F.map_entries("nodes")).alias("seq", "n")).select(F.col("n.key").alias("id"), "n.value.label", "n.value.props", F.col("seq").cast("long").alias("seq"))
    edges = g.select(F.posexplode("edges").alias("seq", "e")).select("e.*", F.col("seq").cast("long").alias("seq"))
    return nodes, edges


def table_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_graph(spark: SparkSession, full: str, metadata: str, rebuild) -> tuple[DataFrame, DataFrame]:
    """The full graph, else the metadata graph, else what rebuild() makes, then stored."""
    from .sinks import write_graph

    for path in (full, metadata):
        if table_exists(spark, path):
            return graph_tables(spark, path)
    write_graph(*rebuild(), metadata)
    return graph_tables(spark, metadata)


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """(k, v): the last entry of each key; malformed lines are left out."""
    rows = spark.read.schema("k string, v array<float>").option("mode", "DROPMALFORMED").json(path).withColumn("seq", F.monotonically_increasing_id())
    return rows.groupBy("k").agg(F.max_by("v", "seq").alias("v"))


def ontology_text(spark: SparkSession, path: str, limit: int = 3000) -> str | None:
    """The first `limit` characters of a schema file, for prompts; None if there is none."""
    if not table_exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).select(F.left("value", F.lit(limit)).alias("v")).first()["v"]


def external_rows(run: Callable[..., list[dict] | None], statement: str | None, **params) -> list[dict]:
    """The rows that an external store's `run` gives for a statement. No statement, or a
    store that is down, gives none; the failure is logged."""
    if not statement:
        return []
    try:
        return [dict(r) for r in run(statement, **params) or ()]
    except Exception:
        log.warning("the external store gave no rows for %r", statement, exc_info=True)
        return []


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL).option("multiLine", True).json(path)
