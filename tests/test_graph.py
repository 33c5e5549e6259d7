import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import importer_node_id, node_id, standard_id
from siltstone.operators import graph, graph_build, templates
from siltstone.operators.extraction import EXTRACTION
from siltstone.operators.graph import Graph
from siltstone.plans import build, skills

META = "seq long, full_name string, target_file string, standard_id string, standard_type string, validity_status boolean, effective_date string, region_type string, region_name string, summary string, issuing_authority array<string>, supersedes array<struct<name:string,supersedes_time:string>>"


@pytest.fixture(scope="module")
def meta(spark):
    rows = [
        (1, "GB 3095-2012 空气质量标准", None, "GB 3095-2012", "国标", True, "2016", "全国", "全国", "s", ["生态环境部", " ", "某省厅"], [("GB 3095-1996", "2016")]),
        (2, "大气污染防治法", None, "", "", True, "2018", "", "", "x" * 600, ["全国人大"], None),
        (3, " 某市环保条例 ", None, None, None, None, None, "地方", "某市", None, None, [("", "")]),
        (4, "HJ 1-2020", None, "", "", False, "", "", "", "", [], []),
        (5, "会议纪要", None, "", "", True, "", "", "", "", ["x"], None),
        (6, None, "固废管理办法", None, None, True, None, None, None, None, ["生态环境部"], None),
        (7, "", "", None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, META)


def test_ids(spark):
    df = spark.createDataFrame([("氨 氮/x", "")], "a string, b string")
    got = df.select(node_id("P", F.col("a"), F.col("b")), standard_id(F.lit("GB 3095-2012")), standard_id(F.lit("GB 3095-2012"), compat=True), importer_node_id("P", F.lit("a:"))).first()
    assert got[0] == "P_氨_氮_x_" + hashlib.md5("P::氨 氮/x".encode()).hexdigest()[:8]
    assert got[1] == "std_GB_3095_2012" and got[2] == "std_" + "_" * 12
    assert got[3] == "P_a__" + hashlib.md5(b"P::a").hexdigest()[:8]


def test_metadata_graph(meta):
    nodes, edges = graph_build.from_metadata(meta)
    nodes = graph.upsert_nodes(nodes)
    labels = {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()}
    assert labels == {"Standard": 2, "Law": 2, "Regulation": 1, "Organization": 3, "Region": 2, "Document": 1}
    props = {r["props"].get("full_name") or r["props"].get("name_zh"): r["props"] for r in nodes.collect()}
    assert props["大气污染防治法"]["summary"] == "x" * 500 and props["大气污染防治法"]["validity_status"] == "现行" and props["某市环保条例"]["validity_status"] == "未知"
    assert props["某省厅"]["level"] == "地方" and props["生态环境部"]["level"] == "国家"
    rels = {r["rel"]: r["count"] for r in graph.checked_edges(edges, nodes).groupBy("rel").count().collect()}
    assert rels == {"ISSUED_BY": 4, "APPLIES_TO_REGION": 2, "SUPERSEDES": 1}
    nodes, edges = graph_build.from_metadata(meta, importer=True)
    assert nodes.filter("label = 'Document'").count() == 0 and edges.filter("rel = 'SUPERSEDES'").count() == 1


def test_upsert_and_edges(spark):
    rows = [("a", "L1", {"x": "1", "y": "1"}, 1), ("a", "L2", {"x": "2"}, 2), ("b", "L1", {}, 5)]
    nodes = graph.upsert_nodes(spark.createDataFrame(rows, "id string, label string, props map<string,string>, seq long"))
    got = {r["id"]: r for r in nodes.collect()}
    assert got["a"]["label"] == "L1" and got["a"]["props"] == {"x": "2", "y": "1"} and got["b"]["props"] == {}
    e = spark.createDataFrame([("a", "L1", "R", "b", "L1", {}, 3), ("a", "L1", "R", "b", "L1", {}, 6), ("a", "L1", "R", "z", "L1", {}, 7)], "from_id string, from_label string, rel string, to_id string, to_label string, props map<string,string>, seq long")
    assert graph.checked_edges(e, nodes).count() == 2 and graph.checked_edges(e, nodes, in_order=True).count() == 1
    assert graph.distinct_edges(e).count() == 2


@pytest.fixture(scope="module")
def records(spark):
    rel = lambda ft, fi, fn, r, tt, tn: (ft, fi, fn, r, tt, tn, {})
    ext = ("s", [("第一条", "内容", ["t"], ["企业"], "罚款")], {"Pollutant": [{"name": "SO2", "category": "大气"}, {"name": ""}], "Case": [{"title": "案例甲", "case_type": "超标"}], "Industry": [{"name": "钢铁"}], "Unknown": [{"name": "x"}], "Penalty": [{"name": "罚款"}], "Violation": [{"name": "伪造数据"}], "PollutionSource": [{"name": "锅炉"}]}, [
        rel("Article", "第一条", None, "ARTICLE_REGULATES", "Pollutant", "SO2"), rel("PollutionSource", None, "锅炉", "SOURCE_EMITS_POLLUTANT", "Pollutant", "SO2"), rel("Industry", None, "钢铁", "SOURCE_EMITS_POLLUTANT", "Pollutant", "SO2"),
        rel("Case", None, "案例甲", "CASE_TRIGGERS_PENALTY", "Penalty", "罚款"), rel("Case", None, "案例甲", "CASE_VIOLATES_ARTICLE", "Article", "d1_第一条"), rel("Case", None, "案例甲", "CASE_INVOLVES_VIOLATION", "Violation", "伪造数据"),
        rel("Article", None, None, "R", "Pollutant", "SO2"), rel("Law", None, "无", "R", "Pollutant", ""), rel("Industry", None, "钢铁", "R", "Region", "不存在"), rel("Standard", "d1", None, "R", "Pollutant", "SO2")])
    schema = f"seq long, doc_id string, error string, article_no string, text_preview string, doc_meta struct<full_name:string,standard_id:string,region_type:string>, extraction {EXTRACTION}"
    return spark.createDataFrame([(1, "d1", None, "第一条", "p", ("大气法", "", ""), ext), (2, "d2", "API call failed", None, None, None, None), (3, "", None, None, None, None, ext)], schema)


def test_extraction_graph_and_templates(records):
    nodes, edges = graph_build.from_extractions(records)
    nodes = graph.upsert_nodes(nodes)
    edges = graph.checked_edges(edges, nodes)
    g = Graph(nodes, edges)
    assert {r["label"] for r in nodes.select("label").collect()} == {"Article", "Document", "Pollutant", "Case", "Industry", "Penalty", "Violation", "PollutionSource"}
    assert edges.count() == 7
    rows = templates.rule_pollutant_articles(g, "SO2").collect()
    assert [(r["pollutant"], r["articles"], r["standards"]) for r in rows] == [("SO2", ["第一条"], [])]
    assert [tuple(r) for r in templates.rule_cases(g, "超标").collect()] == [(None, "超标", ["第一条"], ["罚款"])]
    assert {r["source"] for r in templates.tracing_sources(g, "SO2").collect()} == {"锅炉", "钢铁"}
    assert [r["industry"] for r in templates.tracing_industries(g, "SO2").collect()] == ["钢铁"]
    assert [r["violation"] for r in templates.fraud_violations(g).collect()] == ["伪造数据"]
    assert templates.rule_article(g, "第一条").first()["parent_doc"] == "d1"
    assert templates.rule_penalty(g, "罚").first()["penalty"] == "罚款" and templates.rule_violation(g, "伪造").first()["violation"] == "伪造数据"
    assert templates.industry_compliance(g, "钢铁").first()["regulations"] == [] and templates.compliance_articles(g, "钢铁").count() == 0
    assert templates.articles_about_pollutant(g, "SO2").count() == 1 and templates.domain_routing(g, ["钢铁"]).count() == 1
    assert templates.pollutants_by_standard(g, "GB1").count() == 0 and templates.rule_standard_pollutants(g, "GB1").count() == 0
    assert [tuple(r) for r in templates.tracing_cases(g, "超").collect()] == [(None, "超标", None)]
    assert [tuple(r) for r in templates.compliance_standards(g, "钢铁").collect()] == [(None, None)] and templates.compliance_cases(g, "案").count() == 0 and templates.fraud_cases(g, "案").count() == 0
    assert [tuple(r) for r in templates.rule_industry_standards(g, "钢铁").collect()] == [("钢铁", [])] and [tuple(r) for r in templates.entity_resolution(g, ["SO2"]).collect()] == [("SO2", [])]
    assert [r["articles"] for r in templates.similar_cases(g, "超标", "x").collect()] == [["第一条"]]
    assert [r["a"]["id"] for r in templates.article_content(g, "第一条", "d1").collect()] == [nodes.filter("label = 'Article' and props['parent_doc'] = 'd1'").first()["id"]]
    assert skills.call("nope")["error"] and skills.call("tracing", g, pollutant="SO2")["skill"] == "tracing"
    hint = skills.call("nl2sql", g, "钢铁行业 SO2 与 NOx", ["钢铁"])["sql_hint"]
    assert hint["pollutants"] == ["NOx", "SO2"] and hint["schema_suggestion"]["likely_tables"] == ["dwd_钢铁_wide"]
    assert skills.call("compliance", g)["error"]


def test_importer_records_and_statements(records):
    nodes, edges = graph_build.importer_records(records)
    art = nodes.filter("label = 'Article'").first()
    assert art["props"]["content_hash"] == hashlib.md5("内容".encode()).hexdigest() and art["props"]["penalty"] == "罚款"
    assert edges.filter("rel = 'CONTAINS_ARTICLE'").first()["from_label"] == "Law"
    lines = [r["statement"] for r in graph_build.cypher_nodes(nodes, graph.NODE_KEYS).collect()]
    assert any(x.startswith("MERGE (n:Pollutant {poll_id: 'Pollutant_SO2_") for x in lines)
    assert all(r["statement"].startswith("MATCH (a:") for r in graph_build.cypher_edges(edges, graph.NODE_KEYS).collect())
    assert len(graph_build.constraints(graph.NODE_KEYS)) == 21 and len(graph.RELATIONSHIPS) == 24


def test_build_and_reload(spark, meta, records, tmp_path):
    stats = {(r["kind"], r["name"]): r["n"] for r in build.build_graph(meta, records.drop("doc_meta"), str(tmp_path / "g")).collect()}
    assert stats["node", None] == sum(v for (k, n), v in stats.items() if k == "node" and n) and stats["edge", "ISSUED_BY"] == 4


def test_files_to_stored_graph(spark, tmp_path, capsys):
    """From metadata.json files to the stored graph, by the command line too; the order of
    paths decides whose properties stand."""
    import json

    import siltstone.__main__ as cli

    for k, (name, region) in enumerate([("大气法", "甲地"), ("大气法", "乙地"), ("GB 1-2020 标准", "甲地")]):
        folder = tmp_path / "in" / f"d{k}"
        folder.mkdir(parents=True)
        meta = {"full_name": name, "region_name": region, "issuing_authority": ["生态环境部"], "supersedes": [{"name": "旧", "supersedes_time": "2001"}], "validity_status": True}
        (folder / "metadata.json").write_text(json.dumps({"compliance_assessment": meta}))
    stats = {(r["kind"], r["name"]): r["n"] for r in build.rebuild(spark, str(tmp_path / "in"), str(tmp_path / "g")).collect()}
    assert stats["node", "Law"] == 1 and stats["node", "Region"] == 2 and stats["edge", "ISSUED_BY"] == 3 and stats["edge", "SUPERSEDES"] == 3
    law = spark.read.parquet(str(tmp_path / "g" / "nodes")).filter("label = 'Law'").first()
    assert law["props"]["region"] == "乙地"
    cli.main(["graph", "--root", str(tmp_path / "in"), "--phase", "metadata", "--out", str(tmp_path / "g2")])
    cli.main(["stats", "--graph", str(tmp_path / "g2")])
    cli.main(["import", "--root", str(tmp_path / "in"), "--out", str(tmp_path / "st")])
    cli.main(["skill", "--graph", str(tmp_path / "g2"), "--name", "compliance", "--params", '{"industry": "钢铁"}'])
    assert '"skill": "compliance"' in capsys.readouterr().out
    lines = [r["value"] for r in spark.read.text([str(tmp_path / "st" / "nodes"), str(tmp_path / "st" / "edges")]).collect()]
    assert sum("SET r += {effective_date: '2001'}" in x for x in lines) == 2 and sum(x.startswith("MERGE (n:Law") for x in lines) == 1
    ext = spark.createDataFrame([(1, "d1", None, "第一条", "p", (None, [], {"Pollutant": [{"name": "SO2"}]}, []))], f"seq long, doc_id string, error string, article_no string, text_preview string, extraction {EXTRACTION}")
    delta = {(r["kind"], r["name"]): (r["n"], r["added"]) for r in build.add_extractions(Graph(*build.readers.graph_tables(spark, str(tmp_path / "g"))), ext, str(tmp_path / "g3")).collect()}
    assert delta["node", "Pollutant"] == (1, 1) and delta["node", "Law"] == (1, 0) and delta["edge", None] == (stats["edge", None] + 1, 1)
    with pytest.raises(ValueError, match="nothing to build"):
        build.records(None, None)


def test_statements_are_quoted(spark):
    e = spark.createDataFrame([("a\\", "Law", "R", "b'", "Law", {"k": "v'\\", "n": None}, 1)], "from_id string, from_label string, rel string, to_id string, to_label string, props map<string,string>, seq long")
    text = graph_build.cypher_edges(e, graph.NODE_KEYS).first()["statement"]
    assert text == "MATCH (a:Law {law_id: 'a\\\\'}), (b:Law {law_id: 'b\\''}) MERGE (a)-[r:R]->(b) SET r += {k: 'v\\'\\\\'};"


def test_search_walks_and_samples(spark):
    nodes = spark.createDataFrame([("a", "N", {"name_zh": "河北"}, 1), ("b", "N", {"full_name": "河北省标准"}, 2), ("c", "M", {"title": "别的"}, 3), ("d", "M", {"name": "河北"}, 4)], "id string, label string, props map<string,string>, seq long")
    edges = spark.createDataFrame([("a", "N", "R", "b", "N", {}, 1), ("a", "N", "R", "b", "N", {}, 2), ("b", "N", "R", "c", "M", {}, 3), ("c", "M", "R", "a", "N", {}, 4)], "from_id string, from_label string, rel string, to_id string, to_label string, props map<string,string>, seq long")
    g = Graph(nodes, edges)
    hits = g.text_search(spark.createDataFrame([(1, "河北省的 标准")], "qid long, text string")).collect()
    kws, q = ["河北省的", "标准", *"河北省的标准"], "河北省的 标准"
    score = lambda v: sum(len(k) / len(v) * (1 + 0.1 * len(k)) if k in v else 0.5 * len(v) / len(q) if v in q and len(v) >= 2 else 0 for k in kws)
    want = {"a": score("河北"), "b": score("河北省标准"), "c": score("别的")}
    assert {r["id"]: pytest.approx(r["score"]) for r in hits} == want and [r["id"] for r in hits] == sorted(want, key=lambda k: -want[k])
    assert {r["id"]: r["depth"] for r in g.khop(g.centre("河北"), 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert g.induced(nodes.filter("label = 'N'")).count() == 2 and g.sample(8).count() == 2
    assert g.one_hop("N", "R", limit=1).count() == 1 and g.one_hop("N", "R", "M").count() == 1


def test_stores_and_pages(spark, tmp_path, monkeypatch):
    from siltstone.plans import render
    from siltstone.sources import stores

    nodes = spark.createDataFrame([("a", "N", {"name_zh": "甲<b>"}, 1), ("a", "M", {"x": "1"}, 2), ("b", "N", {}, 3), ("z", "N", {}, 4)], "id string, label string, props map<string,string>, seq long")
    edges = spark.createDataFrame([("a", "N", "R", "b", "N", {}, 1), ("a", "N", "R", "nowhere", "N", {}, 2)], "from_id string, from_label string, rel string, to_id string, to_label string, props map<string,string>, seq long")
    store = stores.graph_store(spark)
    store.add_nodes(nodes)
    store.add_edges(edges)
    store.persist(str(tmp_path / "g"))
    again = stores.graph_store(spark, "frames")
    again.load(str(tmp_path / "g"))
    assert {(r["kind"], r["name"]): r["n"] for r in again.stats().collect()} == {("node", None): 3, ("node", "N"): 3, ("edge", None): 1, ("edge", "R"): 1}
    assert [r["who"] for r in again.query("MATCH (n:N) RETURN n.name_zh AS who").collect()] == ["甲<b>", None, None] and again.query("MATCH (x:N)").count() == 0
    assert again.text_search(spark.createDataFrame([(1, "甲")], "qid long, text string")).count() == 1
    monkeypatch.setenv(stores.BACKEND, "json")
    assert isinstance(stores.graph_store(spark), stores.JsonStore)
    with pytest.raises(ValueError, match="unknown graph backend"):
        stores.graph_store(spark, "other")
    assert render.overview(again.graph, str(tmp_path / "all")) == {"nodes": 3, "edges": 1}
    assert render.neighbourhood(again.graph, "甲", str(tmp_path / "one")) == {"nodes": 2, "edges": 1} and render.neighbourhood(again.graph, "无", str(tmp_path / "no"))["nodes"] == 0
    text = spark.read.text(str(tmp_path / "one"), wholetext=True).first()[0]
    assert "甲&lt;b&gt;" in text and text.count("<circle") == 2 and "<title>R</title>" in text
