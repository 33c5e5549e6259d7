"""Templates over tables of questions: by joins as well as in the plan."""

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from siltstone import queries_domain
from siltstone.operators import bm25, graph, ranking, templates
from siltstone.plans import retrieval
from siltstone.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", [f"tpl_batch_{k}" for k in (1, 2, 3, 4)])
def test_batches_by_joins(spark, sf, name, monkeypatch):
    monkeypatch.setattr(ranking, "DIRECT", 0)
    same(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])


def test_every_template_is_in_a_batch():
    assert set(queries_domain._BATCHES) | {"domain_routing", "entity_resolution"} == set(templates.BATCH)


def test_many_questions_share_nodes_and_the_empty_text_is_everywhere(spark, sf, monkeypatch):
    g = queries_domain.law_graph(spark, sf)
    asked = spark.range(200).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, "").otherwise("BUILDING").alias("pattern"))
    got = templates.fraud_cases.batch(g, asked).groupBy("qid").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(got) == 200 and all(r["n"] == 10 for r in got)
    one = {r["title"] for r in templates.fraud_cases(g, "").collect()}
    assert one == {r["title"] for r in templates.fraud_cases.batch(g, asked).filter("qid = 0").collect()}


def test_routed_search_has_nodes_of_templates_and_vectors(spark, sf):
    got = {s for r in QUERIES["routed_search"](spark, sf).collect() for s in r["sources"].split(",")}
    assert got == {"graph", "graph_text", "vector", "bm25"}


def test_routed_search_shuffles_no_properties_of_nodes_that_it_does_not_show(spark, monkeypatch):
    import random
    import time

    def shuffled():
        time.sleep(1)  # figures of tasks come in late
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    rng = random.Random(5)
    wide = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=10_000))
    nodes = [("p", "Pollutant", {"name_zh": "SO2"}, 0)] + [(f"a{k}", "Article", {"content": wide()}, k) for k in range(1, 301)]
    edges = [(f"a{k}", "Article", "ARTICLE_REGULATES", "p", "Pollutant", {}, k) for k in range(1, 301)]
    node, edge = "id string, label string, props map<string,string>, seq long", "from_id string, from_label string, rel string, to_id string, to_label string, props map<string,string>, seq long"
    g = graph.Graph(spark.createDataFrame(nodes, node), spark.createDataFrame(edges, edge))
    chunks = spark.createDataFrame([("c", "so2", "d", "Window", 1)], "id string, text string, doc_id string, doc_type string, seq long")
    corpus = retrieval.Corpus(chunks, bm25.build_index(chunks.select("id", "text", "seq")), g)
    asked = spark.createDataFrame([(1, "SO2")], "qid long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = shuffled()
        got = {(r["key"], r["rank"]) for r in retrieval.routed(corpus, asked, 30).collect()}
        used = shuffled() - began
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert {k for k, _ in got} == {"c"} | {f"a{k}" for k in range(1, 21)}
    assert used < 200 * 10_000  # those of 20 articles some times, not those of 300
    want = sorted(map(str, retrieval.template_nodes(g, asked).collect()))
    monkeypatch.setattr(graph, "NAMED_NODES", 0)
    assert sorted(map(str, retrieval.template_nodes(g, asked).collect())) == want and len(want) == 20
