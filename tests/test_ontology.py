from siltstone.operators import graph, ontology


def test_constraint_tables(spark):
    assert list(ontology.ENDS) == graph.RELATIONSHIPS and ontology.labels(spark).count() == 17
    rows = [("a", "Law", "ISSUED_BY", "b", "Organization"), ("a", "Case", "ISSUED_BY", "b", "Organization"), ("a", "X", "RELATED_TO", "b", "Y"), ("a", "Case", "NOPE", "b", "Case")]
    edges = spark.createDataFrame(rows, "from_id string, from_label string, rel string, to_id string, to_label string")
    assert sorted(r["rel"] for r in ontology.unknown_edges(edges).collect()) == ["ISSUED_BY", "NOPE"]
    assert ontology.unknown_nodes(spark.createDataFrame([("Law",), ("Document",)], "label string")).count() == 1
