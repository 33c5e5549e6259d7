"""The ontology as constraint tables: which labels and relationships a graph may have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import NODE_KEYS

ANY = "ANY"
_LEGAL = ["Law", "Regulation", "Standard"]
# The labels at both ends of each relationship.
ENDS = {
    "ISSUED_BY": ([*_LEGAL, "Interpretation", "Notice"], ["Organization"]),
    "APPLIES_TO_REGION": (_LEGAL, ["Region"]),
    "APPLIES_TO_INDUSTRY": (["Standard", "Regulation", "Article"], ["Industry"]),
    "EFFECTIVE_ON": (_LEGAL, []),
    "SUPERSEDES": (_LEGAL, _LEGAL),
    "AMENDS": (_LEGAL, _LEGAL),
    "REFERENCES": ([*_LEGAL, "Article"], ["Law", "Regulation", "Article"]),
    "CONTAINS_ARTICLE": (_LEGAL, ["Article"]),
    "ARTICLE_REGULATES": (["Article"], ["Pollutant", "PollutionSource", "Industry", "Enterprise"]),
    "ARTICLE_DEFINES_PENALTY": (["Article"], ["Penalty"]),
    "ARTICLE_DEFINES_VIOLATION": (["Article"], ["Violation"]),
    "SOURCE_EMITS_POLLUTANT": (["PollutionSource", "Industry"], ["Pollutant"]),
    "INDUSTRY_USES_TECH": (["Industry"], ["TreatmentTech"]),
    "TECH_TREATS_POLLUTANT": (["TreatmentTech"], ["Pollutant"]),
    "STANDARD_LIMITS_POLLUTANT": (["Standard", "Article"], ["Pollutant"]),
    "CASE_VIOLATES_ARTICLE": (["Case"], ["Article"]),
    "CASE_INVOLVES_VIOLATION": (["Case"], ["Violation"]),
    "CASE_AT_REGION": (["Case"], ["Region"]),
    "CASE_AT_ENTERPRISE": (["Case"], ["Enterprise"]),
    "CASE_TRIGGERS_PENALTY": (["Case"], ["Penalty"]),
    "SIMILAR_TO": (["Case"], ["Case"]),
    "INTERPRETS": (["Interpretation"], ["Law", "Regulation", "Article"]),
    "MENTIONED_IN_CHUNK": (["Law", "Regulation", "Article", "Pollutant", "Industry", "Case"], ["Chunk"]),
    "RELATED_TO": ([ANY], [ANY]),
}


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NODE_KEYS.items()), "label string, key string")


def endpoints(spark: SparkSession) -> DataFrame:
    """(rel, from_label, to_label): every allowed pair of ends; a relationship without a
    target has a null to_label."""
    rows = [(r, a, b) for r, (start, end) in ENDS.items() for a in start for b in end or [None]]
    return spark.createDataFrame(rows, "rel string, from_label string, to_label string")


def unknown_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.join(F.broadcast(labels(nodes.sparkSession)), "label", "left_anti")


def unknown_edges(edges: DataFrame) -> DataFrame:
    """Edges of which the ontology has no such relationship between such labels."""
    allowed = F.broadcast(endpoints(edges.sparkSession).select(F.col("rel").alias("_r"), F.col("from_label").alias("_a"), F.col("to_label").alias("_b")))
    end = lambda have, may: (F.col(may) == ANY) | (F.col(have) == F.col(may))
    return edges.join(allowed, (F.col("rel") == F.col("_r")) & end("from_label", "_a") & end("to_label", "_b"), "left_anti")
