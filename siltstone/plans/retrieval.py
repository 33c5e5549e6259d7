"""Hybrid retrieval in both generations: weighted fusion, and intent-routed fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bm25, fusion, intent, templates, vector
from ..operators.graph import Graph
from ..operators.ranking import top
from ..sources import scratch


@dataclass
class Corpus:
    """What is searched: chunks (id, text, doc_id, doc_type, seq) with their index, and
    optionally a graph and vectors (id, seq, embedding)."""

    chunks: DataFrame
    index: bm25.Bm25Index
    graph: Graph | None = None
    vectors: DataFrame | None = None


def _payload(**values) -> F.Column:
    keys = ("id", "label", "text", "doc_id", "full_name")
    return F.struct(*[values.get(k, F.lit(None)).cast("string").alias(k) for k in keys])


def weighted(corpus: Corpus, questions: DataFrame, top_k: int = 5, case_words: list[str] | None = None, sop_words: list[str] | None = None) -> DataFrame:
    """(qid, key, rrf, payload, sources, rank) for questions (qid, text[, embedding]):
    vector, graph and BM25 lists of 2 top_k each, weighted by the question's class. A
    source that is missing is passed over; a key's payload is its last list's."""
    w = dict(zip(("vector", "graph", "bm25"), fusion.query_weights(F.col("text"), case_words, sop_words), strict=True))
    weights = questions.select("qid", *[v.alias(f"w_{k}") for k, v in w.items()])
    about = corpus.chunks.select("id", F.col("text").alias("t"), F.col("doc_id").alias("d"), "doc_type")
    lists = []
    if corpus.vectors is not None:
        hits = vector.search(corpus.vectors, questions, 2 * top_k).join(about, "id")
        lists.append(fusion.as_list(hits.join(weights, "qid"), 0, "vector", _payload(id=F.col("id"), label=F.col("doc_type"), text=F.col("t"), doc_id=F.col("d")), F.col("w_vector")))
    if corpus.graph is not None:
        hits = corpus.graph.text_search(questions, 2 * top_k).join(corpus.graph.nodes.select("id", "props"), "id")
        text = F.coalesce(*[F.nullif(F.col("props")[k], F.lit("")) for k in ("full_name", "name_zh", "summary")])
        rows = fusion.as_list(hits.join(weights, "qid"), 1, "graph", _payload(id=F.col("id"), label=F.col("label"), text=text, full_name=F.col("props")["full_name"]), F.col("w_graph"))
        lists.append(rows.withColumn("key", F.concat(F.lit("graph_"), "key")))
    hits = bm25.search(corpus.index, questions, 2 * top_k, later_first=False).join(about, "id")
    lists.append(fusion.as_list(hits.join(weights, "qid"), 2, "bm25", _payload(id=F.col("id"), label=F.lit("Article"), text=F.col("t"), doc_id=F.col("d")), F.col("w_bm25")))
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return fusion.fuse(rows, top_k, last_payload=True)


def routed(corpus: Corpus, questions: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, key, rrf, payload, sources, rank) for questions (qid, text[, embedding]), each by
    its two best intents: nodes of their templates, else substring hits, with vectors if the
    questions have embeddings, and BM25; unweighted fusion. Only templates whose rows are
    nodes give any: those of a pollutant's articles and of an article's content. Questions and
    nodes of templates are stored, as all lists read them."""
    questions = scratch.stored(questions, "questions")
    about = corpus.chunks.select("id", F.col("text").alias("t"), F.col("doc_id").alias("d"))
    lists = []
    if corpus.vectors is not None and "embedding" in questions.columns:
        hits = vector.search(corpus.vectors, questions.filter("embedding is not null"), top_k).join(about, "id")
        lists.append(fusion.as_list(hits, 0, "vector", _payload(id=F.col("id"), text=F.col("t"), doc_id=F.col("d"))))
    if corpus.graph is not None:
        nodes = scratch.stored(template_nodes(corpus.graph, questions), "nodes")
        rest = questions.join(nodes.select("qid").distinct(), "qid", "left_anti")
        text = F.col("props")["content"]
        found = nodes.select("qid", "id", "label", "props", "rank", F.lit("graph").alias("source"))
        found = found.unionByName(corpus.graph.substrings(rest, limit=top_k).select("qid", "id", "label", "props", "rank", F.lit("graph_text").alias("source")))
        lists.append(fusion.as_list(found, 1, F.col("source"), _payload(id=F.col("id"), label=F.col("label"), text=text, full_name=F.col("props")["full_name"])))
    hits = bm25.search(corpus.index, questions, top_k).join(about, "id")
    lists.append(fusion.as_list(hits, 2, "bm25", _payload(id=F.col("id"), text=F.col("t"), doc_id=F.col("d"))))
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return fusion.fuse(rows, top_k)


def template_nodes(g: Graph, questions: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, id, label, props, rank from 0): the nodes that the templates of a question's two
    best intents give, in the order of the intents, each once."""
    asked = intent.route(questions).filter("rank < 2").join(questions.select("qid", "text"), "qid")
    asked = asked.select("qid", "intent", F.col("rank").alias("place"), intent.intent_params(F.col("text"), F.col("intent")).alias("p")).filter("p is not null")
    by = lambda name, *keys: asked.filter(F.col("intent") == name).select("qid", "place", *[F.col("p")[k].alias(k) for k in keys])
    first = templates.articles_about_pollutants(g, by("list_articles_about_pollutant", "pollutant").drop("place"), limit)
    second = templates.article_contents(g, by("lookup_article_content", "article_no", "doc_keyword").drop("place"))
    places = asked.select("qid", "intent", "place")
    both = first.withColumn("intent", F.lit("list_articles_about_pollutant")).unionByName(second.withColumn("intent", F.lit("lookup_article_content")))
    once = both.join(places, ["qid", "intent"]).groupBy("qid", "id").agg(F.min_by(F.struct("label", "props"), F.struct("place", "rank")).alias("n"), F.min(F.struct("place", "rank")).alias("o"))
    order = Window.partitionBy("qid").orderBy("o.place", "o.rank", "id")
    return top(once, order, 2 * limit).select("qid", "id", "n.label", "n.props", "rank")
