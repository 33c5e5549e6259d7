"""k-hop over stored frontiers, and the graph store that grows by batches."""

import pathlib

import pytest
from pyspark.sql import functions as F

from siltstone import queries
from siltstone.operators import graph
from siltstone.operators.graph import Graph
from siltstone.plans import build
from siltstone.sources import readers, stores

NODE = "id string, label string, props map<string,string>, seq long"
EDGE = "from_id string, from_label string, rel string, to_id string, to_label string, props map<string,string>, seq long"


def edge(a, b, seq=1, **props):
    return (a, "L", "R", b, "L", props, seq)


@pytest.fixture(scope="module")
def chain(spark):
    """n0 -> n1 -> ... -> n9, with a short cut and a way back."""
    edges = [edge(f"n{k}", f"n{k + 1}") for k in range(9)] + [edge("n0", "n3"), edge("n5", "n0"), edge("n0", "n3", 2)]
    return Graph(spark.createDataFrame([(f"n{k}", "L", {}, k) for k in range(12)], NODE), spark.createDataFrame(edges, EDGE))


def test_khop_finds_the_shortest_way_and_stops(spark, chain, tmp_path):
    name = chain.hops(str(tmp_path / "hops"))
    want = {"n0": 0, "n1": 1, "n3": 1, "n2": 2, "n4": 2, "n5": 3, "n6": 4, "n7": 5, "n8": 6, "n9": 7}
    plans = set()
    for depth in (0, 2, 7, 50):
        got = chain.khop(spark.createDataFrame([("n0",), ("n0",)], "id string"), depth, name)
        assert {r["id"]: r["depth"] for r in got.collect()} == {k: d for k, d in want.items() if d <= depth} and got.count() == sum(d <= depth for d in want.values())
        plans.add(got._jdf.queryExecution().executedPlan().toString().count("Scan"))
    assert plans == {1}
    assert chain.khop(spark.createDataFrame([("n11",)], "id string"), 3, name).count() == 1
    step = spark.createDataFrame([("n0",)], "id string").join(spark.table(name), "id")
    assert step._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # edges stay where they are


def files(path):
    return {str(p.relative_to(path)) for p in pathlib.Path(path).rglob("*.parquet")}


def test_batches_touch_their_buckets_only_and_can_be_repeated(spark, tmp_path):
    store = stores.BucketStore(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([(f"n{k}", "A", {"x": str(k)}, k) for k in range(300)], NODE)
    edges = spark.createDataFrame([edge(f"n{k}", f"n{k + 1}", k, w=str(k)) for k in range(299)] + [edge("n1", "n2", 1, w="1"), edge("n1", "nowhere", 7)], EDGE)
    assert set(store.add(nodes, edges).values()) == {63}  # one bucket of 64 has no node
    assert store.graph.nodes.count() == 300 and store.graph.edges.count() == 299
    before = files(store.path)
    assert store.add(nodes, edges) == {"nodes": 0, "edges": 0} and files(store.path) == before
    new, more = spark.createDataFrame([("n7", "B", {"y": "new", "x": "last"}, 1000), ("m", "B", {}, 1001)], NODE), spark.createDataFrame([edge("m", "n7", 1002), edge("n1", "nowhere", 7)], EDGE)
    changed = store.add(new, more)
    assert 1 <= changed["nodes"] <= 2 and changed["edges"] == 1
    kept = files(store.path)
    assert len(before - kept) <= 3 and len(before & kept) >= len(before) - 3
    n7 = store.graph.nodes.filter("id = 'n7'").first()
    assert (n7["label"], n7["props"], n7["seq"]) == ("A", {"x": "last", "y": "new"}, 7)
    assert store.add(new, more) == {"nodes": 0, "edges": 0} and files(store.path) == kept
    whole = graph.upsert_nodes(nodes.unionByName(new))
    assert sorted(map(str, store.graph.nodes.collect())) == sorted(map(str, whole.collect()))


def test_a_broken_batch_is_completed_by_adding_it_again(spark, tmp_path, monkeypatch):
    store = stores.BucketStore(spark, str(tmp_path / "g"))
    nodes, edges = spark.createDataFrame([("a", "A", {}, 1), ("b", "A", {}, 2)], NODE), spark.createDataFrame([edge("a", "b", 3)], EDGE)
    real = stores.graph.checked_edges
    monkeypatch.setattr(stores.graph, "checked_edges", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.add(nodes, edges)
    monkeypatch.setattr(stores.graph, "checked_edges", real)
    assert store.add(nodes, edges) == {"nodes": 0, "edges": 1} and store.graph.edges.count() == 1


def test_extractions_are_imported_in_place(spark, tmp_path):
    store = stores.BucketStore(spark, str(tmp_path / "g"))
    ext = '{"doc_id": "d", "extraction": {"doc_summary": "s", "articles": [], "entities": {"Pollutant": [{"name": "SO2"}], "Industry": [{"name": "钢铁"}]}, "relationships": [{"from_type": "Industry", "from_name": "钢铁", "rel": "SOURCE_EMITS_POLLUTANT", "to_type": "Pollutant", "to_name": "SO2", "props": {}}]}}'
    (tmp_path / "e.jsonl").write_text(ext)
    rows = readers.extractions_jsonl(spark, str(tmp_path / "e.jsonl"))
    first = {(r["kind"], r["name"]): (r["n"], r["added"]) for r in build.import_extractions(store, rows).collect()}
    again = {(r["kind"], r["name"]): (r["n"], r["added"]) for r in build.import_extractions(store, rows).collect()}
    assert first["node", None][0] == first["node", None][1] >= 2 and first["edge", None] == (1, 1)
    assert again == {k: (n, 0) for k, (n, _) in first.items()}


def test_store_does_not_shuffle_edges_without_ends(spark, tmp_path):
    """Where no table is small enough to be sent to every task."""
    import time

    def shuffled():
        time.sleep(1)  # figures of tasks come in late
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    nodes = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("A").alias("label"), graph.no_props().alias("props"), F.col("id").alias("seq"))
    far = F.concat_ws("", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{k}"))) for k in range(8)])
    end = lambda to: F.when(F.col("id") < 50, to.cast("string")).otherwise(far)
    edges = spark.range(20_000).select(end(F.col("id")).alias("from_id"), F.lit("A").alias("from_label"), F.lit("R").alias("rel"), end(F.col("id") + 50).alias("to_id"), F.lit("A").alias("to_label"), graph.no_props().alias("props"), F.col("id").alias("seq"))
    store, threshold = stores.BucketStore(spark, str(tmp_path / "store")), "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        began = shuffled()
        store.add(nodes, edges)
        used = shuffled() - began
        assert store.graph.nodes.count() == 100 and store.graph.edges.count() == 50
        assert set(store.add(nodes, edges).values()) == {0}
    finally:
        spark.conf.set(threshold, old)
    assert used < 1_000_000  # of edges of 10 MB


def test_store_of_the_batches_holds_parts_and_line_items(spark, sf):
    """The whole trade graph, not only its small tables."""
    rows = queries.graph_store_batches(spark, sf).groupBy("kind", "rel").count().collect()
    got = {(r["kind"], r["rel"]): r["count"] for r in rows}
    read = lambda t: queries.table(spark, sf, t)
    assert got["node", "Part"] == read("part").count() and got["node", "Supplier"] == read("supplier").count()
    assert got["edge", "SUPPLIES"] == read("lineitem").select("l_suppkey", "l_partkey").distinct().count()
