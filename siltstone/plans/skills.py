"""Skills: named answers to a question or a few parameters, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import answer, intent, templates
from ..operators.graph import Graph
from . import retrieval

Skill = Callable[..., dict]
# Fields and names of tables that a suggestion has.
FIXED_FIELDS = ["emission_value", "limit_value", "exceed_flag", "monitor_time"]


def suggest_schema(domains: list[str], pollutants: list[str]) -> dict:
    return {"likely_tables": [f"dwd_{d}_wide" for d in domains] or ["dwd_default_wide"], "likely_fields": pollutants + FIXED_FIELDS}


def qa(corpus: retrieval.Corpus, questions: DataFrame, model: Callable[[str], str | None], top_k: int = 5) -> dict:
    """Answers to a batch of questions, with the evidence they rest on."""
    hits = retrieval.weighted(corpus, questions, top_k).select("qid", "rank", "key", "rrf", "sources", "payload.*").withColumn("source", F.element_at("sources", 1)).withColumn("doc_type", F.col("label"))
    prompts = questions.join(answer.contexts(hits), "qid", "left").select("qid", answer.answer_prompt(F.col("text"), F.coalesce("context", F.lit(""))).alias("prompt"))
    counts = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("evidence_count"))
    return {"skill": "qa", "answers": answer.answers(prompts, model), "evidence": answer.evidence_rows(hits), "counts": counts}


def cited(corpus: retrieval.Corpus, questions: DataFrame, model: Callable[[str], str | None], top_k: int = 8) -> dict:
    """The first generation's answers: evidence of intent-routed retrieval, the model's answer
    to it (or a line that says why there is none), and up to five citations."""
    hits = retrieval.routed(corpus, questions, top_k).select("qid", "rank", "key", "sources", "payload.*")
    props = F.map_filter(F.create_map(F.lit("full_name"), "full_name", F.lit("content"), "text"), lambda _, v: v.isNotNull())
    hits = hits.select("qid", F.col("rank").cast("int").alias("rank"), "key", F.element_at("sources", 1).alias("source"), "text", "doc_id", props.alias("props"))
    held = answer.with_evidence(questions.select("qid", "text"), hits)
    prompts = held.select("qid", answer.answer_prompt(F.col("text"), F.col("evidence")).alias("prompt"))
    told = answer.answers(prompts, model).withColumn("answer", F.coalesce("answer", F.lit(answer.NO_ANSWER)))
    return {"skill": "cited", "answers": told.join(answer.citations(hits), "qid", "left"), "evidence": held.select("qid", "evidence")}


def nl2sql(g: Graph, question: str, domains: list[str] | None = None) -> dict:
    spark = g.nodes.sparkSession
    row = spark.createDataFrame([(0, question)], "qid long, text string")
    found = sorted(row.select(intent.mentions(F.col("text"))).first()[0])
    hits = g.text_search(row, 5).join(g.nodes.select("id", "props"), "id").orderBy("rank")
    rows = hits.select("label", F.col("props")["name_zh"].alias("name_zh"), F.col("props")["full_name"].alias("full_name"), F.left(F.coalesce(F.col("props")["summary"], F.lit("")), F.lit(120)).alias("summary"))
    return {
        "skill": "nl2sql", "query": question, "rows": rows, "domain_routing": templates.domain_routing(g, domains) if domains else None, "entity_resolution": templates.entity_resolution(g, found) if found else None,
        "sql_hint": {"data_domains": domains or [], "pollutants": found, "schema_suggestion": suggest_schema(domains or [], found)}, "sql": f"-- graph: nodes whose full_name contains '{question[:30]}', 5 rows",
    }


def tracing(g: Graph, pollutant: str = "PM2.5", region: str | None = None) -> dict:
    """What emits a pollutant, which industries it concerns, and cases. The region is echoed;
    it selects nothing."""
    return {"skill": "tracing", "pollutant": pollutant, "region": region, "pollution_sources": templates.tracing_sources(g, pollutant), "related_industries": templates.tracing_industries(g, pollutant), "similar_cases": templates.tracing_cases(g, pollutant)}


def compliance(g: Graph, industry: str, region: str | None = None) -> dict:
    """What an industry must follow, and cases. The region is echoed; it selects nothing."""
    return {"skill": "compliance", "industry": industry, "region": region, "applicable_standards": templates.compliance_standards(g, industry), "violation_cases": templates.compliance_cases(g, industry), "relevant_articles": templates.compliance_articles(g, industry)}


def fraud(g: Graph, pattern: str, industry: str | None = None) -> dict:
    """Cases like a pattern, and known kinds of fraud. The industry is echoed; it selects nothing."""
    return {"skill": "fraud", "pattern": pattern, "industry": industry, "similar_cases": templates.fraud_cases(g, pattern), "known_fraud_types": templates.fraud_violations(g)}


# The first generation: skills that take questions, in batch.

def _named(g: Graph, questions: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, rank, label, name_zh, full_name) of the graph's hits."""
    hits = g.text_search(questions, top_k).join(g.nodes.select("id", "props"), "id")
    return hits.select("qid", "rank", "label", F.col("props")["name_zh"].alias("name_zh"), F.col("props")["full_name"].alias("full_name"))


def _names(hits: DataFrame, label: str, column: str, upto: int | None = None) -> Column:
    """The names of one label among a question's hits, in their order."""
    held = F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("rank", F.col(column).alias("v")))))
    held = F.slice(held, 1, upto) if upto else held
    return F.transform(held, lambda x: x["v"])


def tracing_answers(g: Graph, questions: DataFrame) -> DataFrame:
    """(qid, question, pollutants, sources) among the ten hits of each question."""
    hits = _named(g, questions)
    found = hits.groupBy("qid").agg(_names(hits, "Pollutant", "name_zh").alias("pollutants"), _names(hits, "PollutionSource", "name_zh").alias("sources"))
    return _answered(questions, found, "pollutants", "sources")


def compliance_answers(g: Graph, questions: DataFrame) -> DataFrame:
    """(qid, question, applicable_standards): the first five standards among the ten hits."""
    hits = _named(g, questions)
    return _answered(questions, hits.groupBy("qid").agg(_names(hits, "Standard", "full_name", 5).alias("applicable_standards")), "applicable_standards")


def _answered(questions: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return questions.select("qid", F.col("text").alias("question")).join(found, "qid", "left").select("qid", "question", *[F.coalesce(c, none).alias(c) for c in columns])


def fraud_answers(corpus: retrieval.Corpus, questions: DataFrame, model: Callable[[str], str | None]) -> dict:
    """Answers on what is retrieved for each question."""
    return {**qa(corpus, questions, model, 5), "skill": "fraud", "intent": "fraud"}


REGISTRY: dict[str, Skill] = {"qa": qa, "cited": cited, "nl2sql": nl2sql, "tracing": tracing, "compliance": compliance, "fraud": fraud, "tracing_answers": tracing_answers, "compliance_answers": compliance_answers, "fraud_answers": fraud_answers}


def register(name: str) -> Callable[[Skill], Skill]:
    def add(f: Skill) -> Skill:
        REGISTRY[name] = f
        return f

    return add


def call(name: str, *args, **params) -> dict:
    """A skill by name; an unknown name or a failure gives a dict with `error`. What a skill
    gives is not evaluated here: failures of a model or of data come when its rows are read."""
    if name not in REGISTRY:
        return {"error": f"unknown skill: {name}; registered: {sorted(REGISTRY)}"}
    try:
        return REGISTRY[name](*args, **params)
    except Exception as e:
        return {"error": f"{type(e).__name__}: {e}"}
