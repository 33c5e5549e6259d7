"""Intents, extraction, retrieval pieces, answers, evaluation, sources and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import json_block
from siltstone.operators import answer, bm25, evaluate, extraction, fusion, intent, postings, vector
from siltstone.plans import build, retrieval, skills
from siltstone.sources import readers, sinks
from siltstone.streaming.ingest import chunk_stream


def test_intents_and_templates(spark):
    asked = [(1, "GB 3095-2012 标准限值"), (2, "参考类似案例 so2"), (3, "今天"), (4, "第三条怎么罚"), (5, "钢铁合规要求")]
    q = spark.createDataFrame(asked, "qid long, text string")
    got = {}
    for r in intent.route(q).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["intent"])
    assert got[1] == ["list_pollutants_by_standard"] and got[2] == ["find_similar_cases", "list_articles_about_pollutant"] and got[3] == [intent.FALLBACK] and got[4] == ["lookup_article_content", "lookup_penalty_for_violation"] and got[5] == ["industry_compliance"]
    p = {r["qid"]: r["p"] for r in q.select("qid", intent.params(F.col("text")).alias("p")).collect()}
    assert p[1]["std_id"] == "GB3095-2012" and p[1]["keyword"] is None and p[3]["keyword"] == "今天" and p[2]["pollutant"] == "so2" and p[4]["article_no"] == "第三条"
    t = {r["qid"]: (r["method"], r["template"]) for r in intent.text_to_query(q, lambda x: "```cypher\nMATCH (n)\n```").collect()}
    assert t[1] == ("template", "standard_pollutants") and t[2] == ("template", "pollutant_articles") and t[3] == ("model", "MATCH (n)") and t[4] == ("template", "article")
    assert intent.text_to_query(q).filter("qid = 3").first()["method"] == "fallback"
    m = q.select(intent.intent_params(F.col("text"), F.lit("lookup_article_content")).alias("m")).collect()
    assert m[3]["m"]["article_no"] == "第三条" and m[0]["m"] is None


def test_json_blocks_and_errors(spark):
    good = '{"entities": {"Region": [{"name": "x"}]}, "relationships": [], "articles": []}'
    cases = [(f"so\n```json\n{good}\n```\nend", None), (f"```\n{good}\n```", None), (good, None), (f"well {good} ok", None), ("", "API call failed"), (None, "API call failed"), ("nothing", "No JSON block found"), ("{broken", "JSON decode error"), ('{"entities": []}', "Schema validation failed"), ('{"entities": {}, "relationships": {}}', "Schema validation failed")]
    rows = extraction.checked(spark.createDataFrame(list(enumerate(cases)), "k int, c struct<answer:string,want:string>").select("k", "c.*")).collect()
    assert all(r["error"] == r["want"] for r in rows) and all(r["extraction"]["entities"]["Region"][0]["name"] == "x" for r in rows if r["want"] is None)
    assert extraction.counters(extraction.checked(spark.createDataFrame([(good,), ("",)], "answer string"))).first().asDict() == {"total": 2, "ok": 1, "failed": 1, "articles": 0, "entities": 1, "relations": 0}
    assert spark.createDataFrame([(" x ",)], "r string").select(json_block(F.col("r"))).first()[0] is None


def test_extraction_resumes_and_retries(spark):
    chunks = spark.createDataFrame([("c1", "d", "t" * 13000, (None, None, None, None, None, None, None, None, None, ["部"], None), "p"), ("c2", "d", "u", None, "p")], readers.CHUNK.split(", doc_type")[0] + f", text string, doc_metadata struct<{readers.META.replace(' ', ':').replace(',:', ', ')}>, source_path string")
    done = spark.createDataFrame([("c2",)], "chunk_id string")
    out = extraction.extract(chunks, lambda p: json.dumps({"entities": {}, "relationships": [], "doc_summary": str(len(p))}), done).collect()
    assert [r["chunk_id"] for r in out] == ["c1"] and len(out[0]["raw_text_preview"]) == 200 and out[0]["error"] is None and int(out[0]["extraction"]["doc_summary"]) > 12000
    waits, calls = [], []

    def model(_):
        calls.append(1)
        raise RuntimeError("429 busy" if len(calls) == 1 else "other")

    assert extraction.with_retries(model, 3, pause=waits.append)("x") is None and waits == [30.0, 5.0]


def test_cosine_cache_and_index(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 8)).astype(np.float32)
    rows = spark.createDataFrame([(k, k, x.tolist()) for k, x in enumerate(v)], "id long, seq long, embedding array<float>")
    hits = vector.search(rows, rows.filter("id < 3").select(F.col("id").alias("qid"), "embedding"), 5).collect()
    d = v.astype(float)
    cos = d @ d.T / np.outer(np.linalg.norm(d, axis=1), np.linalg.norm(d, axis=1))
    for q in range(3):
        assert [r["id"] for r in sorted((r for r in hits if r["qid"] == q), key=lambda r: r["rank"])] == np.argsort(-cos[q], kind="stable")[:5].tolist()
    calls = spark.sparkContext.accumulator(0)
    base = vector.hash_encoder(4)

    def encode(texts):
        calls.add(len(texts))
        return base(texts)

    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    cache = spark.createDataFrame([], "k string, v array<float>, seq long")
    new = vector.encode_missing(texts, cache, encode).collect()
    assert len(new) == calls.value == 2
    out = vector.with_embeddings(texts, spark.createDataFrame(new)).collect()
    assert len(out) == 3 and all(r["embedding"] for r in out)
    assert vector.not_indexed(texts.withColumn("seq", F.col("id")), texts.filter("id = 1"), 1).first()["id"] == 2


def test_bm25_grows_with_frequency_and_breaks_ties_by_place(spark):
    docs = spark.createDataFrame([(1, "x y", 1), (2, "x x", 2), (3, "z z", 3), (4, "x y", 4), (5, None, 5)], "id long, text string, seq long")
    q = spark.createDataFrame([(1, "X"), (2, "nothing")], "qid long, text string")
    index = bm25.build_index(docs)
    assert [r["id"] for r in bm25.search(index, q).orderBy("rank").collect()] == [2, 4, 1]
    assert [r["id"] for r in bm25.search(index, q, later_first=False, top_k=2).orderBy("rank").collect()] == [2, 1]


def test_fusion_payloads(spark):
    lists = spark.createDataFrame([(1, 0, "vector", 0, "a", "p0", 1.0), (1, 0, "vector", 1, "b", "q0", 1.0), (1, 2, "bm25", 0, "b", "q2", 2.0)], "qid long, list_no int, source string, rank long, key string, payload string, weight double")
    first = fusion.fuse(lists).orderBy("rank").collect()
    assert [(r["key"], r["payload"], r["sources"]) for r in first] == [("b", "q0", ["vector", "bm25"]), ("a", "p0", ["vector"])] and first[0]["rrf"] == pytest.approx(1 / 62 + 2 / 61)
    assert fusion.fuse(lists, 1, last_payload=True).first()["payload"] == "q2"


def test_answers_and_retrieval(spark):
    chunks = spark.createDataFrame([("c1", "罚款 超标 规定", "d1", "Article", 1), ("c2", "other text", "d2", "Window", 2)], "id string, text string, doc_id string, doc_type string, seq long")
    nodes = spark.createDataFrame([("n1", "Violation", {"name_zh": "超标", "full_name": ""}, 1)], "id string, label string, props map<string,string>, seq long")
    edges = spark.createDataFrame([], "from_id string, from_label string, rel string, to_id string, to_label string, props map<string,string>, seq long")
    corpus = retrieval.Corpus(chunks, bm25.build_index(chunks.select("id", "text", "seq")), retrieval.Graph(nodes, edges))
    q = spark.createDataFrame([(1, "超标罚款")], "qid long, text string")
    out = skills.call("qa", corpus, q, lambda p: f"answer of {len(p)}")
    assert out["answers"].first()["answer"].startswith("answer of") and {r["key"] for r in retrieval.weighted(corpus, q).collect()} == {"c1", "graph_n1"}
    assert {r["label"] for r in out["evidence"].collect()} == {"Article", "Violation"}
    assert {(r["qid"], r["key"]) for r in retrieval.routed(corpus, spark.createDataFrame([(1, "超标"), (2, "other")], "qid long, text string")).collect()} == {(1, "n1"), (1, "c1"), (2, "c2")}
    hits = spark.createDataFrame([(1, 1, "graph", None, "k", None, {"full_name": "法"}), (1, 2, "bm25", "t" * 600, "k2", "d9", {}), (1, 3, "bm25", "", "k3", "", {"content": "zz"})], "qid long, rank int, source string, text string, key string, doc_id string, props map<string,string>")
    assert answer.citations(hits).first()["citations"] == ["《法》", "d9", "k3"]
    text = answer.with_evidence(spark.createDataFrame([(1,), (2,)], "qid long"), hits).orderBy("qid").collect()
    assert text[0]["evidence"].startswith('[图谱节点 1] {"full_name":"法"}\n\n[bm25 片段 2] ' + "t" * 500 + "\n\n[bm25 片段 3] zz") and text[1]["evidence"] == answer.NO_EVIDENCE


def test_routed_templates_in_batch(spark):
    node = lambda i, label, seq, **p: (i, label, p, seq)
    nodes = spark.createDataFrame([node("p1", "Pollutant", 1, name_zh="SO2"), node("a1", "Article", 2, article_no="第三条", content="甲", parent_doc="某法"), node("a2", "Article", 3, article_no="第三条", content="乙", parent_doc="第三条"), node("s1", "Standard", 4, full_name="SO2 限值"), node("x", "Law", 5, full_name="完全无关")], "id string, label string, props map<string,string>, seq long")
    edge = lambda a, la, rel, b, lb: (a, la, rel, b, lb, {}, 1)
    edges = spark.createDataFrame([edge("s1", "Standard", "STANDARD_LIMITS_POLLUTANT", "p1", "Pollutant"), edge("a1", "Article", "ARTICLE_REGULATES", "p1", "Pollutant"), edge("a1", "Article", "STANDARD_LIMITS_POLLUTANT", "p1", "Pollutant")], "from_id string, from_label string, rel string, to_id string, to_label string, props map<string,string>, seq long")
    g = retrieval.Graph(nodes, edges)
    asked = spark.createDataFrame([(1, "SO2"), (2, "第三条"), (3, "完全无关"), (4, "没有")], "qid long, text string")
    assert [(r["qid"], r["id"], r["rank"]) for r in retrieval.template_nodes(g, asked).orderBy("qid", "rank").collect()] == [(1, "a1", 0), (1, "s1", 1), (2, "a2", 0)]
    chunks = spark.createDataFrame([("c", "没有", "d", "Window", 1)], "id string, text string, doc_id string, doc_type string, seq long")
    corpus = retrieval.Corpus(chunks, bm25.build_index(chunks.select("id", "text", "seq")), g)
    got = [(r["qid"], r["key"], r["sources"]) for r in retrieval.routed(corpus, asked).orderBy("qid", "rank").collect()]
    assert got == [(1, "a1", ["graph"]), (1, "s1", ["graph"]), (2, "a2", ["graph"]), (3, "x", ["graph_text"]), (4, "c", ["bm25"])]
    out = skills.call("cited", corpus, asked, lambda p: None if "没有" in p else "ok")
    told = {r["qid"]: r for r in out["answers"].collect()}
    assert told[1]["answer"] == "ok" and told[3]["citations"] == ["《完全无关》"] and told[4]["answer"] == answer.NO_ANSWER and told[4]["citations"] == ["d"]
    names = skills.call("compliance_answers", g, asked).orderBy("qid").collect()
    assert names[0]["applicable_standards"] == ["SO2 限值"] and names[3]["applicable_standards"] == []
    assert skills.call("tracing_answers", g, asked).filter("qid = 1").first()["pollutants"] == ["SO2"]
    assert skills.call("fraud_answers", corpus, asked, lambda p: "x")["intent"] == "fraud"


def test_models_that_fail(spark):
    prompts = spark.createDataFrame([(1, "good"), (2, "bad")], "qid long, prompt string")

    def model(p):
        if p == "bad":
            raise RuntimeError("broken")
        return "yes"

    assert {r["qid"]: r["answer"] for r in answer.answers(prompts, model, pause=lambda _: None).collect()} == {1: "yes", 2: None}
    waits, calls = [], []

    def busy(texts):
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("code 1305")
        return np.ones((len(texts), 2))

    assert vector.retrying(busy, pause=waits.append)(["a"]).shape == (1, 2) and waits == [60.0, 120.0, 180.0]
    with pytest.raises(RuntimeError, match="broken"):
        vector.retrying(lambda t: model("bad"), pause=waits.append)(["a"])
    with pytest.raises(RuntimeError, match="3 tries"):
        vector.retrying(lambda t: 1 / 0 if not t else (_ for _ in ()).throw(RuntimeError("429")), 3, pause=waits.append)(["a"])


def test_prompts_hold_the_schema(spark):
    text = extraction.schema_prompt()
    assert all(x in text for x in ("Pollutant", "CASE_VIOLATES_ARTICLE", "penalty_text", "from_name")) and "EFFECTIVE_ON" not in text
    q = spark.createDataFrame([(1, "今天"), (2, "明天")], "qid long, text string")
    asked = intent.text_to_query(q, lambda p: '```json\n{"cypher": "MATCH (n:Law) RETURN n", "params": {"a": "b"}}\n```' if "schema here" in p and "今天" in p else "{broken", "schema here")
    got = {r["qid"]: (r["method"], r["template"], r["params"]) for r in asked.collect()}
    assert got == {1: ("model", "MATCH (n:Law) RETURN n", {"a": "b"}), 2: ("fallback", intent.MATCH_ALL, None)}


def test_blocks_of_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(70, 5)), 1)
    v[7] = 0
    rows = [(f"v{k}", 100 - k, None if k == 3 else x.tolist()) for k, x in enumerate(v)] + [("twin", 500, v[0].tolist())]
    df = spark.createDataFrame(rows, "id string, seq long, embedding array<double>").repartition(3)
    unit = lambda x: np.asarray(x) / (np.linalg.norm(x) or 1)
    asked = spark.createDataFrame([(k, v[k].tolist()) for k in range(9)], "qid long, embedding array<double>")
    got = {(r["qid"], r["rank"]): r["id"] for r in vector.search(df, asked, 4).collect()}
    for q in range(9):
        order = sorted((r for r in rows if r[2] is not None), key=lambda r: (-round(float(unit(r[2]) @ unit(v[q])), 9), r[1]))[:4]
        assert [got[q, k] for k in range(4)] == [r[0] for r in order]
    assert vector.search(df, asked.limit(0)).count() == 0 and vector.search(df.limit(0), asked).count() == 0


def test_limits_reach_the_plan_before_the_shuffle(spark):
    """Searches keep the first rows of each question in every task."""
    rows = spark.range(100).select(F.col("id"), F.col("id").alias("seq"), F.concat(F.lit("word "), "id").alias("text"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    q = spark.createDataFrame([(1, "word 7", [1.0, 0.0])], "qid long, text string, embedding array<double>")
    g = retrieval.Graph(rows.select(F.col("id").cast("string").alias("id"), F.lit("L").alias("label"), F.create_map(F.lit("name_zh"), "text").alias("props"), "seq"), None)
    for df in (vector.search(rows, q), bm25.search(bm25.build_index(rows), q), g.text_search(q), g.substrings(q)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x y", 1), (2, "x x", 2)], "id long, text string, seq long")
    q = spark.createDataFrame([(1, "x")], "qid long, text string")
    for okapi in (False, True):
        index = bm25.build_index(docs, okapi=okapi)
        again = postings.StoredIndex(spark, str(tmp_path / str(okapi)), okapi)
        again.add(docs, "all")
        assert bm25.search(again, q).collect() == bm25.search(index, q).collect()
        assert again.terms.orderBy("term").collect() == index.terms.orderBy("term").collect()


def test_repeated_writes(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "d", "Window", "t1"), ("c2", "d", "Window", "t1"), ("c3", "d", "Article", "t2")], "chunk_id string, doc_id string, doc_type string, text string")
    for part in (chunks, chunks.limit(0)):
        sinks.write_chunk_array(part.repartition(2), str(tmp_path / "array"))
        held = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "array"), wholetext=True).collect()))
        assert len(held) == part.count() and {x["chunk_id"] for x in held} == {r["chunk_id"] for r in part.collect()}
    full = chunks.withColumns({"article_no": F.lit(""), "structure_path": F.array(F.lit("N/A")), "themes": F.array(F.lit("x"))})
    full.write.parquet(str(tmp_path / "chunks"))
    calls, base = spark.sparkContext.accumulator(0), vector.hash_encoder(4)

    def encode(texts):
        calls.add(len(texts))
        return base(texts)

    for _ in range(2):
        n = build.index_chunks(spark, str(tmp_path / "chunks"), str(tmp_path / "index"), encode, str(tmp_path / "cache")).first()["vectors"]
        assert n == 3 and calls.value == 2  # distinct texts
    assert build.index_chunks(spark, str(tmp_path / "chunks"), str(tmp_path / "index2"), encode).first()["vectors"] == 3 and calls.value == 4
    assert spark.read.parquet(str(tmp_path / "index")).select("id").distinct().count() == 3
    assert readers.embedding_cache(spark, str(tmp_path / "cache")).count() == 2
    sinks.append_cache(readers.embedding_cache(spark, str(tmp_path / "cache")).withColumn("v", F.array(F.lit(9.0).cast("float"))), str(tmp_path / "cache"))
    assert [r["v"] for r in sinks.compact_cache(spark, str(tmp_path / "cache"), str(tmp_path / "compact")).collect()] == [[9.0], [9.0]]
    assert spark.read.json(str(tmp_path / "compact")).count() == 2
    scored = evaluate.item_scores(spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "b", 0.0, 0.5)], "id long, type string, recall double, answer_score double"))
    summary = sinks.write_report(scored, str(tmp_path / "report"))
    assert summary["total"] == 2 and summary["kpi"] is False and set(summary["by_type"]) == {"a", "b"}
    assert json.loads("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "report" / "summary.json")).collect())) == summary
    (tmp_path / "onto.yaml").write_text("x" * 5000)
    assert readers.ontology_text(spark, str(tmp_path / "onto.yaml")) == "x" * 3000 and readers.ontology_text(spark, str(tmp_path / "no")) is None
    assert readers.external_rows(lambda s, **p: [{"s": s, **p}], "Q", a=1) == [{"s": "Q", "a": 1}] and readers.external_rows(lambda s: 1 / 0, "Q") == [] and readers.external_rows(None, None) == []


def test_readers_of_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"chunk_id": f"c{k}", "doc_id": "d", "text": "t"}) for k in range(5)))
    assert [r["chunk_id"] for r in readers.chunks_jsonl(spark, str(tmp_path / "c.jsonl"), 2).collect()] == ["c0", "c1"] and readers.chunks_jsonl(spark, str(tmp_path / "c.jsonl")).count() == 5
    (tmp_path / "e.json").write_text(json.dumps([{"id": "1", "type": "t", "question": "q", "expected_evidence": ["Law"]}]))
    assert readers.evaluation_items(spark, str(tmp_path / "e.json")).first()["expected_evidence"] == ["Law"]
    monkeypatch.setenv(readers.DATA_ROOT, "from env")
    assert readers.data_root() == "from env" and readers.data_root("x") == "x"
    monkeypatch.delenv(readers.DATA_ROOT)
    assert readers.data_root(candidates=("nowhere", str(tmp_path))) == str(tmp_path)
    sinks.write_statements(spark.createDataFrame([("MERGE (n);",)], "statement string"), str(tmp_path / "st"))
    assert spark.read.text(str(tmp_path / "st")).first()[0] == "MERGE (n);"
    from siltstone.operators.chunking import source_doc_type

    kinds = spark.createDataFrame([("a/案例/x", "GB 1"), ("a/b", "GB 1"), ("a/b", "")], "path string, std string").select(source_doc_type(F.col("path"), F.col("std")))
    assert [r[0] for r in kinds.collect()] == ["Case", "Standard", "LawOrRegulation"]
    hits = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, [])], "id long, sources array<string>")
    assert {r["id"]: r["sources"] for r in evaluate.item_sources(hits).collect()} == {1: ["a", "b"], 2: []}


def test_pairs_of_characters(spark):
    from siltstone.functions.text import search_tokens

    rows = spark.createDataFrame([("大气污染 PM10防治", 1), ("法", 2), ("", 3)], "text string, id long").withColumn("seq", F.col("id"))
    assert [r[0] for r in rows.select(search_tokens(F.col("text"))).collect()] == [["大气", "气污", "污染", "pm10", "防治"], ["法"], []]
    index = bm25.build_index(rows, search_tokens, okapi=True)
    q = spark.createDataFrame([(1, "污染")], "qid long, text string")
    assert {r["term"] for r in index.terms.collect()} == {"大气", "气污", "污染", "pm10", "防治", "法"} and bm25.search(index, q, tokenizer=search_tokens).count() == 1


def test_scores(spark, tmp_path):
    rows = [(1, "a", "The Answer", ["the", "zzz"], ["Law"], ["Law", "Case"]), (2, "a", "x", [], [], []), (3, "b", "x", ["x"], [], ["Law"])]
    df = spark.createDataFrame(rows, "id long, type string, answer string, keywords array<string>, labels array<string>, expected array<string>")
    scored = evaluate.item_scores(df.select("id", "type", evaluate.keyword_score(F.col("answer"), F.col("keywords")).alias("answer_score"), evaluate.evidence_score(F.col("labels"), F.col("expected")).alias("recall")))
    got = {r["id"]: (r["answer_score"], r["recall"], round(r["total"], 3), r["passed"]) for r in scored.collect()}
    assert got == {1: (0.5, 0.5, 0.5, False), 2: (1.0, 1.0, 1.0, True), 3: (1.0, 0.0, 0.4, False)}
    assert "KPI 0.85: not reached" in sinks.markdown_report(scored) and json.loads(sinks.recall_report(scored, scored.select("id"), "m", str(tmp_path / "r")))["total"] == 3
    assert spark.read.json(str(tmp_path / "r/details")).count() == 3
    assert [r["id"] for r in evaluate.failures(scored).orderBy("id").collect()] == [1, 3] and evaluate.reaches_kpi(evaluate.rollup(scored)).first()[0] is False


def test_document_tree_to_stored_chunks(spark, tmp_path):
    for name, text, meta in (("a", "第一条 " + "内容" * 20 + "\n第二条 " + "内容" * 20 + "\n第三条 " + "内容" * 20, {"compliance_assessment": {"full_name": "某法", "validity_status": True}}), ("b", "plain", None), ("c", "x", "broken")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "doc.md").write_bytes(text.encode() + (b"\xff" if name == "b" else b""))
        if meta:
            (tmp_path / "in" / name / "metadata.json").write_text(meta if isinstance(meta, str) else json.dumps(meta))
    counts = {r["doc_type"]: r["count"] for r in build.chunk(spark, str(tmp_path / "in"), str(tmp_path / "chunks")).collect()}
    assert counts == {"Article": 3, "Window": 2}
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert stored.filter("doc_id = 'a'").first()["doc_metadata"]["full_name"] == "某法" and stored.filter("doc_id = 'b'").first()["text"] == "plain�"
    assert readers.metadata_files(spark, str(tmp_path / "in")).count() == 1
    build.extract(spark, str(tmp_path / "chunks"), str(tmp_path / "ext"), lambda p: '{"entities": {}, "relationships": []}', "r1")
    build.extract(spark, str(tmp_path / "chunks"), str(tmp_path / "ext"), lambda p: "", "r2")
    assert spark.read.parquet(str(tmp_path / "ext")).groupBy("run").count().collect()[0]["count"] == 5
    (tmp_path / "g.json").write_text(json.dumps({"nodes": {"a": {"label": "L", "props": {"k": "v"}}}, "edges": [{"from_id": "a", "from_label": "L", "rel": "R", "to_id": "a", "to_label": "L", "props": {}}]}))
    nodes, edges = readers.graph_json(spark, str(tmp_path / "g.json"))
    back = readers.load_graph(spark, str(tmp_path / "full"), str(tmp_path / "meta"), lambda: (nodes, edges))
    assert back[0].count() == 1 and back[1].first()["rel"] == "R" and readers.load_graph(spark, str(tmp_path / "full"), str(tmp_path / "meta"), None)[0].count() == 1
    (tmp_path / "cache.jsonl").write_text('{"k": "a", "v": [1]}\nnot json\n{"k": "a", "v": [2]}\n')
    assert readers.embedding_cache(spark, str(tmp_path / "cache.jsonl")).first()["v"] == [2.0]
    (tmp_path / "ext.jsonl").write_text('{"doc_id": "d", "extraction": {"entities": {}}}\nnot json\n')
    assert readers.extractions_jsonl(spark, str(tmp_path / "ext.jsonl")).count() == 1
    with pytest.raises(Exception):
        readers.extractions_jsonl(spark, str(tmp_path / "ext.jsonl"), strict=True).collect()
    assert readers.data_root("x") == "x"
    done = sinks.import_batches(spark.createDataFrame([(f"s{k}",) for k in range(5)], "statement string").coalesce(1), lambda b: 1 / (0 if "s0" in b else 1), 2).first()
    assert (done["done"], done["failed"]) == (3, 2)


def test_stream_of_documents(spark, tmp_path):
    spark.createDataFrame([("d1", "one\n\ntwo"), ("d2", "three")], "doc_id string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        chunk_stream(spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_failing_store_is_logged(caplog):
    with caplog.at_level("WARNING"):
        assert readers.external_rows(lambda s: 1 / 0, "MATCH x") == []
    assert "MATCH x" in caplog.text and "ZeroDivisionError" in caplog.text


def test_index_shuffles_a_new_text_twice(spark, tmp_path):
    """Where no table is small enough to be sent to every task."""
    import random
    import time

    def shuffled():
        time.sleep(1)  # figures of tasks come in late
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    rng = random.Random(5)
    texts = [(f"c{k}", "d", "Window", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1500))) for k in range(3000)]
    texts += [("c0", "d", "Window", texts[0][3]), (None, "d", "Window", "no id"), ("same", "d", "Window", texts[1][3]), ("null", "d", "Window", None)]
    chunks = spark.createDataFrame(texts, "chunk_id string, doc_id string, doc_type string, text string").withColumns({"article_no": F.lit(""), "structure_path": F.array(F.lit("N/A")), "themes": F.array(F.lit("x"))})
    calls, base = spark.sparkContext.accumulator(0), vector.hash_encoder(4)

    def encode(texts):
        calls.add(len(texts))
        return base(texts)

    at, threshold = [str(tmp_path / x) for x in ("chunks", "index", "cache")], "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for part, n in ((chunks.filter("chunk_id < 'c2'"), 1112), (chunks, 3002)):
            part.write.mode("overwrite").parquet(at[0])
            began, before = shuffled(), calls.value
            held = build.index_chunks(spark, at[0], at[1], encode, at[2]).first()["vectors"]
            used = shuffled() - began
            assert held == n
            assert used < 3.5 * 1500 * (calls.value - before)
    finally:
        spark.conf.set(threshold, old)
    assert calls.value == 3001  # distinct texts
    rows = spark.read.parquet(at[1])
    assert {r["id"] for r in rows.collect()} == {c for c, *_, t in texts if t is not None}
    assert rows.filter("document is null or embedding is null").isEmpty()
