"""Queries that run the named templates, skills and builders themselves. The trade tables
stand in for a legal graph: parts are standards, nations pollutants, regions industries,
orders articles, customers cases, suppliers violations and sources of pollution."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import ARTICLE, HEADING, NUMERALS
from .operators import answer, chunking, graph, graph_build, intent, templates
from .operators.graph import Graph
from .plans import retrieval, skills
from .sources import scratch
from .queries import ARTICLES, BM25_SQL, FOLD, GRAPH_SQL, LATIN_THEMES, LAW_DUCK, ORACLE_SQL, QUESTIONS, SEARCHES, _corpus, laws, query, table, values

# label, table, id, order, properties; the expressions are both Spark's and DuckDB's
_NODES = [
    ("Standard", "part", "concat('S', p_partkey)", "p_partkey", {"std_id": "concat('GB ', p_partkey)", "full_name": "p_name"}),
    ("Pollutant", "nation", "concat('P', n_nationkey)", "10000000000 + n_nationkey", {"name_zh": "CASE n_nationkey WHEN 8 THEN 'SO2' WHEN 9 THEN 'COD' ELSE n_name END"}),
    ("Industry", "region", "concat('I', r_regionkey)", "20000000000 + r_regionkey", {"name_zh": "r_name"}),
    ("Article", "orders", "concat('A', o_orderkey)", "30000000000 + o_orderkey", {"article_no": "concat('第', o_orderkey % 40, '条')", "content": "concat(o_orderstatus, ' ', o_orderpriority)", "themes": "o_orderstatus", "parent_doc": "concat('doc', o_custkey % 100, CASE WHEN o_custkey % 10 = 7 THEN ' 第7条' ELSE '' END)", "penalty": "o_orderpriority"}),
    ("Case", "customer", "concat('C', c_custkey)", "40000000000 + c_custkey", {"title": "c_name", "case_type": "c_mktsegment", "summary": "concat(c_mktsegment, ' in NATION_', c_nationkey, '.')", "violations": "concat('v', c_nationkey, '.')"}),
    ("Violation", "supplier", "concat('V', s_suppkey)", "50000000000 + s_suppkey", {"name_zh": "CASE WHEN s_suppkey % 10 = 3 THEN concat('伪造', s_name) ELSE s_name END"}),
    ("Penalty", "(SELECT DISTINCT o_orderpriority FROM orders)", "concat('X', o_orderpriority)", "60000000000 + cast(substr(o_orderpriority, 1, 1) AS bigint)", {"name_zh": "o_orderpriority", "type": "substr(o_orderpriority, 1, 1)"}),
    ("PollutionSource", "supplier", "concat('U', s_suppkey)", "70000000000 + s_suppkey", {"name_zh": "concat('src ', s_name)"}),
]
# start, relationship, end, table, both ids
_EDGES = [
    ("Standard", "STANDARD_LIMITS_POLLUTANT", "Pollutant", "part", "concat('S', p_partkey)", "concat('P', p_partkey % 25)"),
    ("Standard", "STANDARD_LIMITS_POLLUTANT", "Pollutant", "part", "concat('S', p_partkey)", "concat('P', p_size % 25)"),
    ("Article", "ARTICLE_REGULATES", "Pollutant", "(SELECT * FROM orders WHERE o_orderkey % 3 = 0)", "concat('A', o_orderkey)", "concat('P', o_orderkey % 25)"),
    ("Standard", "CONTAINS_ARTICLE", "Article", "orders", "concat('S', o_orderkey % 200)", "concat('A', o_orderkey)"),
    ("Standard", "APPLIES_TO_INDUSTRY", "Industry", "(SELECT * FROM part WHERE p_partkey % 2 = 0)", "concat('S', p_partkey)", "concat('I', p_partkey % 5)"),
    ("Industry", "APPLIES_TO_INDUSTRY", "Standard", "(SELECT * FROM part WHERE p_partkey % 2 = 1)", "concat('I', p_partkey % 5)", "concat('S', p_partkey)"),
    ("Case", "CASE_VIOLATES_ARTICLE", "Article", "orders", "concat('C', o_custkey)", "concat('A', o_orderkey)"),
    ("Case", "CASE_TRIGGERS_PENALTY", "Penalty", "(SELECT DISTINCT o_custkey, o_orderpriority FROM orders)", "concat('C', o_custkey)", "concat('X', o_orderpriority)"),
    ("Case", "CASE_INVOLVES_VIOLATION", "Violation", "customer", "concat('C', c_custkey)", "concat('V', c_custkey % 10)"),
    ("PollutionSource", "SOURCE_EMITS_POLLUTANT", "Pollutant", "supplier", "concat('U', s_suppkey)", "concat('P', s_nationkey)"),
    ("Industry", "SOURCE_EMITS_POLLUTANT", "Pollutant", "nation", "concat('I', n_regionkey)", "concat('P', n_nationkey)"),
    ("Article", "ARTICLE_DEFINES_PENALTY", "Penalty", "orders", "concat('A', o_orderkey)", "concat('X', o_orderpriority)"),
    ("Article", "ARTICLE_DEFINES_VIOLATION", "Violation", "orders", "concat('A', o_orderkey)", "concat('V', o_orderkey % 10)"),
]
_PROPS = sorted({k for *_, props in _NODES for k in props})
LAW_SQL = (
    "WITH n AS ("
    + " UNION ALL ".join(f"SELECT {id_} AS id, '{label}' AS label, ({seq})::BIGINT AS seq, " + ", ".join(f"({props[k]})::VARCHAR AS {k}" if k in props else f"NULL::VARCHAR AS {k}" for k in _PROPS) + f" FROM {t}" for label, t, id_, seq, props in _NODES)
    + "), e AS ("
    + " UNION ALL ".join(f"SELECT {a} AS f, '{rel}' AS rel, {b} AS t FROM {t}" for _, rel, _, t, a, b in _EDGES)
    + ") "
)


def law_graph(spark: SparkSession, sf: str) -> Graph:
    def rows(source: str) -> DataFrame:
        name = next(t for t in ("part", "nation", "region", "orders", "customer", "supplier") if t in source.split("FROM ")[-1])
        df = table(spark, sf, name)
        if "DISTINCT" in source:
            return df.select(*source.split("DISTINCT ")[1].split(" FROM")[0].split(", ")).distinct()
        return df.filter(source.split("WHERE ")[1].rstrip(")")) if "WHERE" in source else df

    nodes = [rows(t).select(F.expr(id_).alias("id"), F.lit(label).alias("label"), graph.props(**{k: F.expr(v) for k, v in props.items()}).alias("props"), F.expr(seq).cast("long").alias("seq")) for label, t, id_, seq, props in _NODES]
    edges = [rows(t).select(F.expr(a).alias("from_id"), F.lit(start).alias("from_label"), F.lit(rel).alias("rel"), F.expr(b).alias("to_id"), F.lit(end).alias("to_label"), graph.no_props().alias("props"), F.lit(k).cast("long").alias("seq")) for k, (start, rel, end, t, a, b) in enumerate(_EDGES)]
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges))


def _list(c: str, upto: int | None = None) -> str:
    cut = f"[1:{upto}]" if upto else ""
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)){cut}, ','), '')"


def _joined(df: DataFrame, *lists: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


def _hop(left: str, rels: str, right: str, way: str = "out", label: str | None = None, optional: bool = False) -> str:
    """A SQL join from the nodes `left` to the nodes `right` along relationships."""
    rel = ", ".join(f"'{r}'" for r in rels.split())
    one = {"out": [("f", "t")], "in": [("t", "f")], "both": [("f", "t"), ("t", "f")]}[way]
    ends = f" AND x.label IN ({', '.join(repr(v) for v in label.split())})" if label else ""
    hops = " UNION ALL ".join(f"SELECT e.{a} AS at, x.* FROM e JOIN n x ON x.id = e.{b}{ends} WHERE e.rel IN ({rel})" for a, b in one)
    return f" {'LEFT ' if optional else ''}JOIN ({hops}) {right} ON {right}.at = {left}.id"


_CASES = "FROM n c" + _hop("c", "CASE_VIOLATES_ARTICLE", "a", label="Article", optional=True) + _hop("c", "CASE_TRIGGERS_PENALTY", "x", label="Penalty", optional=True)


@query(LAW_SQL + f"SELECT s.full_name AS standard, {_list('x.name_zh')} AS pollutants FROM n s" + _hop("s", "STANDARD_LIMITS_POLLUTANT", "x", label="Pollutant", optional=True) + " WHERE s.label = 'Standard' AND replace(s.std_id, ' ', '') = 'GB17' GROUP BY s.full_name")
def tpl_pollutants_by_standard(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.pollutants_by_standard(law_graph(spark, sf), "GB17"), "pollutants")


@query(LAW_SQL + "SELECT a.id AS article, a.label AS label, p.id AS parent FROM n x" + _hop("x", "STANDARD_LIMITS_POLLUTANT ARTICLE_REGULATES", "a", "in", "Article Standard Law Regulation") + _hop("a", "CONTAINS_ARTICLE", "p", "in", optional=True) + " WHERE x.label = 'Pollutant' AND x.name_zh = 'NATION_3' ORDER BY a.seq, x.seq, p.seq NULLS FIRST LIMIT 20")
def tpl_articles_about_pollutant(spark: SparkSession, sf: str) -> DataFrame:
    return templates.articles_about_pollutant(law_graph(spark, sf), "NATION_3").select(F.col("a.id").alias("article"), F.col("a.label").alias("label"), F.col("parent.id").alias("parent"))


@query(LAW_SQL + f"SELECT c.id, c.title, {_list('a.article_no')} AS articles, {_list('x.name_zh')} AS penalties {_CASES} WHERE c.label = 'Case' AND (contains(c.case_type, 'BUILD') OR contains(c.violations, 'v3.')) GROUP BY c.id, c.seq, c.title ORDER BY c.seq LIMIT 10")
def tpl_similar_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.similar_cases(law_graph(spark, sf), "BUILD", "v3."), "articles", "penalties").select("id", "title", "articles", "penalties")


@query(LAW_SQL + "SELECT id, content FROM n WHERE label = 'Article' AND article_no = '第7条' AND contains(parent_doc, 'doc1') ORDER BY seq LIMIT 5")
def tpl_article_content(spark: SparkSession, sf: str) -> DataFrame:
    return templates.article_content(law_graph(spark, sf), "第7条", "doc1").select("a.id", F.col("a.props")["content"].alias("content"))


_REG = _hop("i", "APPLIES_TO_INDUSTRY", "reg", "both", "Standard Regulation", True)


@query(LAW_SQL + f"SELECT i.id, md5({_list('reg.full_name')}) AS regulations, {_list('a.article_no')} AS articles FROM n i{_REG}" + _hop("reg", "CONTAINS_ARTICLE", "a", label="Article", optional=True) + " WHERE i.label = 'Industry' AND i.name_zh = 'ASIA' GROUP BY i.id ORDER BY i.id LIMIT 20")
def tpl_industry_compliance(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.industry_compliance(law_graph(spark, sf), "ASIA"), "regulations", "articles").withColumn("regulations", F.md5("regulations"))


@query(LAW_SQL + f"SELECT s.full_name AS standard, {_list('x.name_zh')} AS pollutants FROM n s" + _hop("s", "STANDARD_LIMITS_POLLUTANT", "x", label="Pollutant", optional=True) + " WHERE s.label = 'Standard' AND (contains(replace(s.std_id, ' ', ''), 'GB17') OR contains(replace(s.full_name, ' ', ''), 'GB17')) GROUP BY s.full_name ORDER BY 1 LIMIT 20")
def tpl_rule_standard_pollutants(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.rule_standard_pollutants(law_graph(spark, sf), "GB 17"), "pollutants")


@query(LAW_SQL + f"SELECT x.name_zh AS pollutant, {_list('a.article_no', 10)} AS articles, {_list('a.full_name', 5)} AS standards FROM n x" + _hop("x", "ARTICLE_REGULATES STANDARD_LIMITS_POLLUTANT", "a", "in", "Article Standard", True) + " WHERE x.label = 'Pollutant' AND x.name_zh = 'NATION_4' GROUP BY x.name_zh")
def tpl_rule_pollutant_articles(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.rule_pollutant_articles(law_graph(spark, sf), "NATION_4"), "articles", "standards")


@query(LAW_SQL + f"SELECT i.name_zh AS industry, md5({_list('reg.full_name')}) AS standards FROM n i" + _hop("i", "APPLIES_TO_INDUSTRY", "reg", "in", "Standard Regulation", True) + " WHERE i.label = 'Industry' AND i.name_zh = 'EUROPE' GROUP BY i.name_zh")
def tpl_rule_industry_standards(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.rule_industry_standards(law_graph(spark, sf), "EUROPE"), "standards").withColumn("standards", F.md5("standards"))


@query(LAW_SQL + f"SELECT c.title AS case_title, c.case_type, {_list('a.article_no')} AS articles, {_list('x.name_zh')} AS penalties {_CASES} WHERE c.label = 'Case' AND (contains(c.title, '00012') OR contains(c.case_type, '00012')) GROUP BY c.id, c.seq, c.title, c.case_type ORDER BY c.seq LIMIT 10")
def tpl_rule_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.rule_cases(law_graph(spark, sf), "00012"), "articles", "penalties")


@query(LAW_SQL + "SELECT a.article_no, a.content, a.themes, p.full_name AS parent_doc FROM n a" + _hop("a", "CONTAINS_ARTICLE", "p", "in", optional=True) + " WHERE a.label = 'Article' AND a.article_no = '第9条' ORDER BY a.seq, p.seq LIMIT 5")
def tpl_rule_article(spark: SparkSession, sf: str) -> DataFrame:
    return templates.rule_article(law_graph(spark, sf), "第9条")


@query(LAW_SQL + f"SELECT x.name_zh AS penalty, x.type, {_list('a.article_no', 5)} AS related_articles FROM n x" + _hop("x", "ARTICLE_DEFINES_PENALTY", "a", "in", "Article", True) + " WHERE x.label = 'Penalty' AND (contains(x.name_zh, 'H') OR contains(x.type, 'H')) GROUP BY x.name_zh, x.type ORDER BY 1, 2 LIMIT 20")
def tpl_rule_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.rule_penalty(law_graph(spark, sf), "H"), "related_articles")


@query(LAW_SQL + f"SELECT v.name_zh AS violation, {_list('a.article_no', 5)} AS articles, {_list('c.title', 5)} AS cases FROM (SELECT * FROM n WHERE label = 'Violation' AND contains(name_zh, '00000')) v" + _hop("v", "ARTICLE_DEFINES_VIOLATION", "a", "in", "Article", True) + _hop("v", "CASE_INVOLVES_VIOLATION", "c", "in", "Case", True) + " GROUP BY v.name_zh ORDER BY 1 LIMIT 20")
def tpl_rule_violation(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.rule_violation(law_graph(spark, sf), "00000"), "articles", "cases")


@query(LAW_SQL + f"SELECT i.name_zh AS industry, md5({_list('reg.full_name')}) AS applicable_regulations FROM n i{_REG} WHERE i.label = 'Industry' AND i.name_zh IN ('ASIA', 'AFRICA') GROUP BY i.name_zh")
def tpl_domain_routing(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.domain_routing(law_graph(spark, sf), ["ASIA", "AFRICA"]), "applicable_regulations").withColumn("applicable_regulations", F.md5("applicable_regulations"))


@query(LAW_SQL + "SELECT x.name_zh AS pollutant, md5(coalesce(array_to_string(list_sort(list(s.std_id) FILTER (s.std_id IS NOT NULL)), ','), '')) AS standards FROM n x" + _hop("x", "STANDARD_LIMITS_POLLUTANT", "s", "in", "Standard", True) + " WHERE x.label = 'Pollutant' AND x.name_zh IN ('NATION_1', 'NATION_20') GROUP BY x.name_zh")
def tpl_entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.entity_resolution(law_graph(spark, sf), ["NATION_1", "NATION_20"]), "standards").withColumn("standards", F.md5("standards"))


@query(LAW_SQL + "SELECT s.name_zh AS source, s.label FROM n x" + _hop("x", "SOURCE_EMITS_POLLUTANT", "s", "in") + " WHERE x.label = 'Pollutant' AND x.name_zh = 'NATION_2'")
def tpl_tracing_sources(spark: SparkSession, sf: str) -> DataFrame:
    return templates.tracing_sources(law_graph(spark, sf), "NATION_2").select("source", F.col("labels")[0].alias("label"))


@query(LAW_SQL + f"SELECT i.name_zh AS industry, md5({_list('reg.std_id')}) AS standards FROM n x" + _hop("x", "SOURCE_EMITS_POLLUTANT", "i", "in", "Industry") + _hop("i", "APPLIES_TO_INDUSTRY", "reg", "both", "Standard", True) + " WHERE x.label = 'Pollutant' AND x.name_zh = 'NATION_2' GROUP BY i.name_zh")
def tpl_tracing_industries(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.tracing_industries(law_graph(spark, sf), "NATION_2"), "standards").withColumn("standards", F.md5("standards"))


@query(LAW_SQL + "SELECT title, case_type AS type, summary FROM n WHERE label = 'Case' AND (contains(case_type, 'NATION_2.') OR contains(summary, 'NATION_2.')) ORDER BY seq LIMIT 10")
def tpl_tracing_cases(spark: SparkSession, sf: str) -> DataFrame:
    return templates.tracing_cases(law_graph(spark, sf), "NATION_2.")


@query(LAW_SQL + f"SELECT reg.full_name AS name, reg.std_id FROM n i{_REG} WHERE i.label = 'Industry' AND i.name_zh = 'ASIA'")
def tpl_compliance_standards(spark: SparkSession, sf: str) -> DataFrame:
    return templates.compliance_standards(law_graph(spark, sf), "ASIA")


@query(LAW_SQL + "SELECT c.title AS case_title, v.name_zh AS violation, x.name_zh AS penalty FROM n c" + _hop("c", "CASE_INVOLVES_VIOLATION", "v", label="Violation") + _hop("c", "CASE_TRIGGERS_PENALTY", "x", label="Penalty", optional=True) + " WHERE c.label = 'Case' AND (contains(c.summary, 'NATION_5.') OR contains(c.title, 'NATION_5.')) ORDER BY c.seq, v.seq, x.seq NULLS FIRST LIMIT 15")
def tpl_compliance_cases(spark: SparkSession, sf: str) -> DataFrame:
    return templates.compliance_cases(law_graph(spark, sf), "NATION_5.")


@query(LAW_SQL + "SELECT a.article_no, a.themes, a.penalty FROM (SELECT DISTINCT reg.id FROM n i" + _hop("i", "APPLIES_TO_INDUSTRY", "reg", "both", "Standard Regulation") + " WHERE i.label = 'Industry' AND i.name_zh = 'AMERICA') r" + _hop("r", "CONTAINS_ARTICLE", "a", label="Article") + " ORDER BY a.seq LIMIT 30")
def tpl_compliance_articles(spark: SparkSession, sf: str) -> DataFrame:
    return templates.compliance_articles(law_graph(spark, sf), "AMERICA")


@query(LAW_SQL + f"SELECT c.title, c.summary, {_list('a.article_no')} AS articles, {_list('x.name_zh')} AS penalties {_CASES} WHERE c.label = 'Case' AND (contains(c.summary, 'MACHINERY in NATION_1') OR contains(c.title, 'MACHINERY in NATION_1')) GROUP BY c.id, c.seq, c.title, c.summary ORDER BY c.seq LIMIT 10")
def tpl_fraud_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(templates.fraud_cases(law_graph(spark, sf), "MACHINERY in NATION_1"), "articles", "penalties")


@query(LAW_SQL + "SELECT name_zh AS violation FROM n WHERE label = 'Violation' AND regexp_matches(name_zh, '伪造|篡改|虚假|造假')")
def tpl_fraud_violations(spark: SparkSession, sf: str) -> DataFrame:
    return templates.fraud_violations(law_graph(spark, sf))


def _lists_of(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: _joined(df, *names)


def _digest(name: str, df: DataFrame) -> DataFrame:
    return _joined(df, name).withColumn(name, F.md5(name))


# template: the query whose SQL asks it once, what that asks, what a batch asks, and its form
_BATCHES: dict[str, tuple[str, tuple, list[tuple], Callable[[DataFrame], DataFrame]]] = {
    "pollutants_by_standard": ("tpl_pollutants_by_standard", ("GB17",), [("GB17",), ("GB3",), ("none",)], _lists_of("pollutants")),
    "articles_about_pollutant": ("tpl_articles_about_pollutant", ("NATION_3",), [("NATION_3",), ("SO2",), ("none",)], lambda df: df.select("qid", F.col("a.id").alias("article"), F.col("a.label").alias("label"), F.col("parent.id").alias("parent"))),
    "similar_cases": ("tpl_similar_cases", ("BUILD", "v3."), [("BUILD", "v3."), ("AUTO", "v11."), ("none", "none")], lambda df: _joined(df, "articles", "penalties").select("qid", "id", "title", "articles", "penalties")),
    "article_content": ("tpl_article_content", ("第7条", "doc1"), [("第7条", "doc1"), ("第9条", "doc"), ("第7条", "none")], lambda df: df.select("qid", "a.id", F.col("a.props")["content"].alias("content"))),
    "industry_compliance": ("tpl_industry_compliance", ("ASIA",), [("ASIA",), ("EUROPE",), ("none",)], lambda df: _digest("regulations", _joined(df, "articles")).select("qid", "id", "regulations", "articles")),
    "rule_standard_pollutants": ("tpl_rule_standard_pollutants", ("GB17",), [("GB17",), ("GB4",), ("none",)], _lists_of("pollutants")),
    "rule_pollutant_articles": ("tpl_rule_pollutant_articles", ("NATION_4",), [("NATION_4",), ("COD",), ("none",)], _lists_of("articles", "standards")),
    "rule_industry_standards": ("tpl_rule_industry_standards", ("EUROPE",), [("EUROPE",), ("AFRICA",), ("none",)], lambda df: _digest("standards", df)),
    "rule_cases": ("tpl_rule_cases", ("00012",), [("00012",), ("0007",), ("none",)], _lists_of("articles", "penalties")),
    "rule_article": ("tpl_rule_article", ("第9条",), [("第9条",), ("第11条",), ("none",)], lambda df: df),
    "rule_penalty": ("tpl_rule_penalty", ("H",), [("H",), ("LOW",), ("none",)], _lists_of("related_articles")),
    "rule_violation": ("tpl_rule_violation", ("00000",), [("00000",), ("7",), ("none",)], _lists_of("articles", "cases")),
    "tracing_sources": ("tpl_tracing_sources", ("NATION_2",), [("NATION_2",), ("SO2",), ("none",)], lambda df: df.select("qid", "source", F.col("labels")[0].alias("label"))),
    "tracing_industries": ("tpl_tracing_industries", ("NATION_2",), [("NATION_2",), ("SO2",), ("none",)], lambda df: _digest("standards", df)),
    "tracing_cases": ("tpl_tracing_cases", ("NATION_2.",), [("NATION_2.",), ("NATION_7.",), ("none",)], lambda df: df),
    "compliance_standards": ("tpl_compliance_standards", ("ASIA",), [("ASIA",), ("AFRICA",), ("none",)], lambda df: df),
    "compliance_cases": ("tpl_compliance_cases", ("NATION_5.",), [("NATION_5.",), ("NATION_6.",), ("none",)], lambda df: df),
    "compliance_articles": ("tpl_compliance_articles", ("AMERICA",), [("AMERICA",), ("ASIA",), ("none",)], lambda df: df),
    "fraud_cases": ("tpl_fraud_cases", ("MACHINERY in NATION_1",), [("MACHINERY in NATION_1",), ("BUILDING in NATION_2",), ("none",)], _lists_of("articles", "penalties")),
}


def _batch_sql(names: list[str]) -> str:
    """The one-question SQL of each template for each question of its batch; a row as text."""
    parts = []
    for name in names:
        key, once, batch, _ = _BATCHES[name]
        for qid, given in enumerate(batch):
            body = ORACLE_SQL[key].removeprefix(LAW_SQL)
            for a, b in zip(once, given, strict=True):
                body = body.replace(f"'{a}'", f"'{b}'")
            parts.append(f"SELECT '{name}' AS template, {qid}::BIGINT AS qid, array_to_string(list_sort(list_transform(json_keys(to_json(r)), lambda k: k || '=' || coalesce(json_extract_string(to_json(r), '$.' || k), '~'))), '|') AS row_ FROM ({body}) r")
    return LAW_SQL + " UNION ALL ".join(parts)


def _asked_in_batch(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    g, out = law_graph(spark, sf), []
    for name in names:
        _, _, batch, form = _BATCHES[name]
        params = getattr(templates, name).params
        asked = spark.createDataFrame([(qid, *given) for qid, given in enumerate(batch)], "qid long, " + ", ".join(f"{k} string" for k in params))
        rows = form(templates.BATCH[name](g, asked)).drop("rank")
        text = F.array_join(F.array_sort(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("~"))) for c in rows.columns if c != "qid"])), "|")
        out.append(rows.select(F.lit(name).alias("template"), "qid", text.alias("row_")))
    return reduce(DataFrame.unionByName, out)


def _register_batches() -> None:
    names = list(_BATCHES)
    for k, part in enumerate((names[:5], names[5:10], names[10:14], names[14:]), 1):
        def run(spark: SparkSession, sf: str, part: list[str] = part) -> DataFrame:
            return _asked_in_batch(spark, sf, part)

        run.__name__, run.__doc__ = f"tpl_batch_{k}", f"Over tables of questions: {', '.join(part)}."
        query(_batch_sql(part))(run)


_register_batches()


@query(LAW_SQL + "SELECT id, full_name AS name FROM n WHERE label = 'Standard' ORDER BY seq LIMIT 20")
def graph_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return law_graph(spark, sf).by_label("MATCH (n:Standard {x: $y}) RETURN n.full_name AS name").select("id", "name")


@query(LAW_SQL + "SELECT n.id, n.label FROM n" + _hop("n", "CASE_INVOLVES_VIOLATION", "m", label="Violation") + " WHERE n.label = 'Case' AND n.case_type = 'BUILDING' ORDER BY n.seq, m.seq LIMIT 50")
def graph_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return law_graph(spark, sf).one_hop("Case", "CASE_INVOLVES_VIOLATION", "Violation", "case_type", "BUILDING").select("n.id", "n.label")


# --------------------------------------------------------- skills and answers

ASKED_NAMES = [(1, "NATION_1 NATION_2"), (2, "small ring"), (3, "src Supplier#000000003"), (4, "nothing")]
_KWS = f"SELECT qid, text, CASE WHEN len(list_filter(string_split(text, ' '), lambda x: length(x) >= 2)) > 0 THEN list_filter(string_split(text, ' '), lambda x: length(x) >= 2) ELSE [text] END AS kws FROM {values(ASKED_NAMES, 'qid, text')}"


def _score(field: str) -> str:
    return f"CASE WHEN length({field}) > 0 THEN nullif(list_sum(list_transform(kws, lambda k: CASE WHEN contains({field}, k) THEN length(k) / length({field})::DOUBLE * (1 + 0.1::DOUBLE * length(k)) WHEN contains(text, {field}) AND length({field}) >= 2 THEN 0.5::DOUBLE * length({field}) / length(text) ELSE 0 END)), 0) END"


_FOUND = f", q AS ({_KWS}), s AS (SELECT qid, id, label, seq, name_zh, full_name, coalesce({_score('name_zh')}, {_score('full_name')}, {_score('summary')}, {_score('title')}) AS score FROM n, q), h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, seq, id) AS r FROM s WHERE score > 0 QUALIFY r <= 10) "


@query(
    LAW_SQL + _FOUND + """SELECT q.qid::BIGINT AS qid, coalesce((SELECT array_to_string(list(name_zh ORDER BY r), ',') FROM h WHERE h.qid = q.qid AND label = 'Pollutant'), '') AS pollutants,
coalesce((SELECT array_to_string(list(name_zh ORDER BY r), ',') FROM h WHERE h.qid = q.qid AND label = 'PollutionSource'), '') AS sources,
coalesce((SELECT array_to_string(list(full_name ORDER BY r)[1:5], ',') FROM h WHERE h.qid = q.qid AND label = 'Standard'), '') AS applicable_standards FROM q"""
)
def skill_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The first generation's tracing and compliance skills, for a batch of questions."""
    g, asked = law_graph(spark, sf), spark.createDataFrame(ASKED_NAMES, "qid long, text string")
    both = skills.tracing_answers(g, asked).join(skills.compliance_answers(g, asked).drop("question"), "qid")
    return _joined(both, "pollutants", "sources", "applicable_standards").drop("question")


@query(LAW_SQL + "SELECT 'source' AS part, s.name_zh AS name FROM n x" + _hop("x", "SOURCE_EMITS_POLLUTANT", "s", "in") + " WHERE x.label = 'Pollutant' AND x.name_zh = 'NATION_7' UNION ALL SELECT DISTINCT 'industry', i.name_zh FROM n x" + _hop("x", "SOURCE_EMITS_POLLUTANT", "i", "in", "Industry") + " WHERE x.label = 'Pollutant' AND x.name_zh = 'NATION_7'")
def skill_tracing(spark: SparkSession, sf: str) -> DataFrame:
    out = skills.call("tracing", law_graph(spark, sf), pollutant="NATION_7", region="anywhere")
    return out["pollution_sources"].select(F.lit("source").alias("part"), F.col("source").alias("name")).unionByName(out["related_industries"].select(F.lit("industry").alias("part"), F.col("industry").alias("name")))


@query("SELECT qid, array_to_string(list(c ORDER BY rank), '|') AS citations FROM (SELECT doc_id % 50 AS qid, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank, CASE WHEN doc_id % 3 = 0 THEN '《' || lang || '》' ELSE coalesce(nullif(source, ''), doc_id::VARCHAR) END AS c FROM documents) WHERE rank <= 5 AND c IS NOT NULL GROUP BY qid")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.col("doc_id")
    rank = F.row_number().over(graph.Window.partitionBy(ids % 50).orderBy("doc_id"))
    hits = table(spark, sf, "documents").select((ids % 50).alias("qid"), rank.alias("rank"), F.when(ids % 3 == 0, "graph").otherwise("bm25").alias("source"), graph.props(full_name=F.col("lang")).alias("props"), F.col("source").alias("doc_id"), ids.cast("string").alias("key"))
    return answer.citations(hits).select("qid", F.array_join("citations", "|").alias("citations"))


# ----------------------------------------------------------- building the graph

META = [
    (1, "GB 3095-2012 空气质量标准", "GB 3095-2012", "全国", "全国", "生态环境部|某省厅", "GB 3095-1996"),
    (2, "大气污染防治法", "", "", "", "全国人大", ""), (3, " 某市环保条例 ", "", "地方", "某市", "", ""), (4, "HJ 1-2020", "", "", "", "", ""),
    (5, "会议纪要", "", "", "", "x", ""), (6, "固废管理办法", "", "", "", "生态环境部", "旧办法"), (7, "大气污染防治法", "", "", "某市", "某省厅| ", ""),
]
# and one for each supplier: name, standard_id, region_type, region, authorities, what it supersedes
_META = [
    "1000 + s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN concat('GB ', s_suppkey, ' x') WHEN 1 THEN concat(s_name, '条例') WHEN 2 THEN concat(' ', s_name, '法') ELSE s_name END", "CASE WHEN s_suppkey % 8 = 4 THEN concat('GB ', s_suppkey) ELSE '' END",
    "CASE WHEN s_suppkey % 3 = 0 THEN '地方' ELSE '全国' END", "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('region ', s_nationkey) END", "CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE concat('org ', s_nationkey, '|office ', s_suppkey % 7) END", "CASE WHEN s_suppkey % 9 = 1 THEN concat('old ', s_suppkey % 11) ELSE '' END",
]
_NAME = "regexp_replace({0}, '[^\\w一-龥]', '_', 'g')"
_ID = f"{{0}} || '_' || substr({_NAME.format('{1}')}, 1, 30) || '_' || substr(md5({{0}} || '::' || {{1}}), 1, 8)"


@query(
    f"""WITH r AS (SELECT seq, trim(name) AS name, std, region_type, region, orgs, old FROM (SELECT * FROM {values(META, 'seq, name, std, region_type, region, orgs, old')} UNION ALL SELECT {', '.join(_META)} FROM supplier)),
c AS (SELECT *, CASE WHEN std <> '' OR starts_with(name, 'GB ') OR starts_with(name, 'HJ ') OR starts_with(name, 'DB ') THEN 'Standard' WHEN contains(name, '条例') OR ends_with(name, '法') OR contains(name, '办法') THEN CASE WHEN region_type = '地方' THEN 'Regulation' ELSE 'Law' END END AS label FROM r),
m AS (SELECT *, CASE WHEN label = 'Standard' THEN 'std_' || substr({_NAME.format("CASE WHEN std <> '' THEN std ELSE name END")}, 1, 50) ELSE {_ID.format('label', 'name')} END AS own FROM c WHERE label IS NOT NULL),
o AS (SELECT seq, own, trim(unnest(string_split(orgs, '|'))) AS o FROM m)
SELECT DISTINCT 'node' AS kind, label AS name, own AS a, '' AS b FROM m
UNION SELECT 'node', 'Organization', {_ID.format("'Organization'", 'o')}, '' FROM o WHERE o <> ''
UNION SELECT 'node', 'Region', {_ID.format("'Region'", 'region')}, '' FROM m WHERE region <> ''
UNION SELECT 'node', 'Document', {_ID.format("'Document'", 'old')}, '' FROM m WHERE old <> ''
UNION ALL SELECT 'edge', 'ISSUED_BY', own, {_ID.format("'Organization'", 'o')} FROM o WHERE o <> ''
UNION ALL SELECT 'edge', 'APPLIES_TO_REGION', own, {_ID.format("'Region'", 'region')} FROM m WHERE region <> ''
UNION ALL SELECT 'edge', 'SUPERSEDES', own, {_ID.format("'Document'", 'old')} FROM m WHERE old <> ''"""
)
def graph_from_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(s, n, None, d, None, True, None, t, r, None, o.split("|") if o else None, [(x, None)] if x else None) for s, n, d, t, r, o, x in META]
    meta = spark.createDataFrame(rows, "seq long, full_name string, target_file string, standard_id string, standard_type string, validity_status boolean, effective_date string, region_type string, region_name string, summary string, issuing_authority array<string>, supersedes array<struct<name:string,supersedes_time:string>>")
    full = F.nullif(F.lit(""), F.lit(""))
    made = table(spark, sf, "supplier").select(*[F.expr(e).alias(c) for e, c in zip(_META, ("seq", "name", "std", "kind", "region", "orgs", "old"), strict=True)])
    some = made.select(
        F.col("seq").cast("long").alias("seq"), F.col("name").alias("full_name"), full.alias("target_file"), F.col("std").alias("standard_id"), full.alias("standard_type"), F.lit(True).alias("validity_status"), full.alias("effective_date"),
        F.col("kind").alias("region_type"), F.col("region").alias("region_name"), full.alias("summary"), F.when(F.col("orgs") != "", F.split("orgs", r"\|")).alias("issuing_authority"),
        F.when(F.col("old") != "", F.array(F.struct(F.col("old").alias("name"), full.alias("supersedes_time")))).alias("supersedes"),
    )
    path = scratch.folder(spark, "metadata")
    meta.unionByName(some).write.parquet(path)
    nodes, edges = graph_build.from_metadata(spark.read.schema(meta.schema).parquet(path))
    nodes = graph.upsert_nodes(nodes)
    edges = graph.checked_edges(edges, nodes)
    return nodes.select(F.lit("node").alias("kind"), F.col("label").alias("name"), F.col("id").alias("a"), F.lit("").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("rel").alias("name"), F.col("from_id").alias("a"), F.col("to_id").alias("b")))


_TOP = r"(?m)^[^\n]*第[一二三四五六七八九十]+条[^\n]{0,3}$"
TYPED = [("某市环保条例", "", "x"), ("某法", "", "x"), ("GB 1-1", "", "x"), ("", "HJ 2 说明", "x"), ("", "", "总则 第三条 。\n正文"), ("", "", "限值 10 mg/m³"), ("", "", "普通文字"), ("通知", "某法", "标准"), ("", "", "第三条 本条很长的文字在此继续下去")]


_TYPED = [
    "CASE doc_id % 7 WHEN 0 THEN concat(lang, '条例') WHEN 1 THEN concat(lang, '法') WHEN 2 THEN concat('GB ', doc_id) ELSE '' END",
    "CASE doc_id % 7 WHEN 3 THEN concat('HJ ', doc_id) ELSE '' END",
    "CASE doc_id % 7 WHEN 4 THEN concat(lang, ' 第三条', chr(10), text) WHEN 5 THEN concat('限值 ', text) ELSE coalesce(text, '') END",
]


@query(f"SELECT name, target, md5(text) AS text_md5, CASE WHEN contains(f, '条例') OR ends_with(f, '法') THEN 'LawOrRegulation' WHEN starts_with(f, 'GB ') OR starts_with(f, 'HJ ') OR starts_with(f, 'DB ') THEN 'Standard' WHEN regexp_matches(substr(text, 1, 3000), '{_TOP}') THEN 'LawOrRegulation' WHEN regexp_matches(substr(text, 1, 200), '标准|限值|mg/m³') THEN 'Standard' ELSE 'Other' END AS doc_type FROM (SELECT *, CASE WHEN name <> '' THEN name ELSE target END AS f FROM (SELECT * FROM {values(TYPED, 'name, target, text')} UNION ALL SELECT {', '.join(_TYPED)} FROM documents))")
def doc_type(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "documents").select(*[F.expr(e).alias(c) for e, c in zip(_TYPED, ("name", "target", "text"), strict=True)])
    rows = spark.createDataFrame(TYPED, "name string, target string, text string").unionByName(made)
    return rows.select("name", "target", F.md5("text").alias("text_md5"), chunking.detect_doc_type(F.col("text"), F.col("name"), F.col("target")).alias("doc_type"))


_CUT = f"string_split(regexp_replace(text, '(?m)(^\\s*{HEADING})', chr(1) || '\\1', 'g'), chr(1))"


@query(f"""WITH p AS (SELECT doc_id, unnest({_CUT}) AS piece, generate_subscripts({_CUT}, 1) AS i FROM (SELECT * FROM {values(ARTICLES, 'doc_id, text')} UNION ALL SELECT doc_id::VARCHAR, {LAW_DUCK} FROM documents)),
c AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
SELECT doc_id, s::BIGINT AS span_start, (s + length(piece))::BIGINT AS span_end, trim(regexp_extract(piece, '{HEADING}')) || ' ' || trim(regexp_extract(piece, '^\\s*{HEADING}[ ]*([^\n]{{0,40}})', 1)) AS path, md5(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM c WHERE i > 1 AND n > 2 AND length(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')) >= 500""")
def chunk_chapter(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.by_chapter(chunking.normalized(laws(spark, sf))).select("doc_id", "span_start", "span_end", F.col("structure_path")[0].alias("path"), F.md5("text").alias("text_md5"))


# -------------------------------------------------------- dispatch and retrieval

def _chunks_sql() -> str:
    window = FOLD.replace("FROM documents", f"FROM (SELECT doc_id::VARCHAR AS doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {values(ARTICLES[1:], 'doc_id, text')})").replace("WITH ps", "ps", 1).strip()
    cut = f"string_split(regexp_replace(text, '({ARTICLE})', chr(1) || '\\1', 'g'), chr(1))"
    return f"""WITH p AS (SELECT doc_id, unnest({cut}) AS piece, generate_subscripts({cut}, 1) AS i FROM {values(ARTICLES[:1], 'doc_id, text')}),
a AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS s FROM p),
{window}, both_ AS (SELECT doc_id, 'Window' AS doc_type, span_start, span_end::BIGINT AS span_end, NULL AS article_no FROM rows
UNION ALL SELECT doc_id, 'Article', s::BIGINT, (s + length(piece))::BIGINT, regexp_extract(piece, '^{ARTICLE}') FROM a WHERE i > 1 AND length(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')) >= 20)
SELECT 'chunk_' || substr(md5(doc_id || '::' || span_start || '::' || span_end), 1, 12) AS chunk_id, doc_id, doc_type, span_start, span_end, article_no FROM both_"""


@query(_chunks_sql())
def chunk_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Strategies by document: CJK articles, and windows for what has too few of them."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(spark.createDataFrame(ARTICLES, "doc_id string, text string"))
    return chunking.chunk_documents(docs, separator="\n", theme_table=LATIN_THEMES).select("chunk_id", "doc_id", "doc_type", "span_start", "span_end", "article_no")


_ASKED = [(k, f"{t} {s}") for (k, t), (_, s) in zip(QUESTIONS, SEARCHES, strict=True)]
_BM25 = BM25_SQL[: BM25_SQL.index("q AS (")].replace("WITH ", "", 1) + f"q AS (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {values(_ASKED, 'qid, text')}), qf AS (SELECT qid, term, count(*) AS qf FROM q GROUP BY ALL)"
_GRAPH_HITS = f"""gq AS (SELECT qid, text, CASE WHEN len(list_filter(string_split(text, ' '), lambda x: length(x) >= 2)) > 0 THEN list_filter(string_split(text, ' '), lambda x: length(x) >= 2) ELSE [text] END AS kws FROM {values(_ASKED, 'qid, text')}),
gs AS (SELECT qid, id, seq, list_sum(list_transform(kws, lambda k: CASE WHEN contains(name_zh, k) THEN length(k) / length(name_zh)::DOUBLE * (1 + 0.1::DOUBLE * length(k)) WHEN contains(text, name_zh) AND length(name_zh) >= 2 THEN 0.5::DOUBLE * length(name_zh) / length(text) ELSE 0 END)) AS score FROM nodes, gq)"""


@query(
    f"""{GRAPH_SQL.rstrip()}, {_BM25}, idfs AS (SELECT term, ln((n - df + 0.5e0) / (df + 0.5e0) + 1) AS idf FROM terms, c), {_GRAPH_HITS},
bs AS (SELECT qid, doc_id, sum(qf * idf * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM qf JOIN idfs USING (term) JOIN post USING (term) JOIN lens USING (doc_id), c GROUP BY ALL),
vs AS (SELECT a.qid, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM {values(_ASKED, 'qid, text').replace(') AS t', ') AS a')} JOIN embeddings e ON e.vec_id = a.qid, embeddings v),
l AS (
  SELECT qid, 0 AS list_no, 'vector' AS source, id::VARCHAR AS key, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM vs QUALIFY rank < 10
  UNION ALL SELECT qid, 1, 'graph', 'graph_' || id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, seq, id) - 1 AS rank FROM gs WHERE score > 0 QUALIFY rank < 10
  UNION ALL SELECT qid, 2, 'bm25', doc_id::VARCHAR, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM bs WHERE score > 0 QUALIFY rank < 10
), cls AS (SELECT qid, contains(lower(text), 'tion') AS has_case, contains(lower(text), 'que') AS has_sop FROM {values(_ASKED, 'qid, text')}),
f AS (SELECT qid, key, sum(CASE list_no WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN has_case THEN 2.0 ELSE 1.5 END ELSE CASE WHEN has_case THEN 1.0 WHEN has_sop THEN 1.8 ELSE 1.5 END END::DOUBLE / (60 + rank + 1)) AS rrf, min(row(list_no, rank)) AS first, array_to_string(list(source ORDER BY list_no), ',') AS sources
  FROM l JOIN cls USING (qid) WHERE list_no = 1 OR key IN (SELECT doc_id::VARCHAR FROM documents) GROUP BY ALL)
SELECT qid::BIGINT AS qid, key, round(rrf, 8) AS rrf, sources, row_number() OVER v AS rank FROM f WINDOW v AS (PARTITION BY qid ORDER BY round(rrf, 12) DESC, first) QUALIFY row_number() OVER v <= 5"""
)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vector, graph and BM25 lists in weighted fusion, five hits for each question."""
    corpus, questions = _corpus(spark, sf)
    hits = retrieval.weighted(corpus, questions, 5, ["tion"], ["que"])
    return hits.select("qid", "key", F.round("rrf", 8).alias("rrf"), F.array_join("sources", ",").alias("sources"), "rank")


ROUTED = [(1, "NATION_3 SO2 大气污染"), (2, "第7条"), (3, "small"), (4, "the of and"), (5, "COD 参考 que")]
_ROUTES = ", ".join("{'score': " + " + ".join("regexp_matches(text, '(?i)" + p + "')::INT" for p in ps) + ", 'intent': '" + name + "'}" for name, ps in intent.INTENTS.items())


@query(
    f"""{LAW_SQL.rstrip()}, {_BM25[: _BM25.index('q AS (')]}asked AS (SELECT * FROM {values(ROUTED, 'qid, text')}),
q AS (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fa5}}]')) AS term FROM asked), qf AS (SELECT qid, term, count(*) AS qf FROM q GROUP BY ALL),
idfs AS (SELECT term, ln((c.n - df + 0.5e0) / (df + 0.5e0) + 1) AS idf FROM terms, c),
bs AS (SELECT qid, doc_id, sum(qf * idf * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM qf JOIN idfs USING (term) JOIN post USING (term) JOIN lens USING (doc_id), c GROUP BY ALL),
routes AS (SELECT qid, unnest(list_filter([{_ROUTES}], lambda x: x.score > 0)) AS x, text FROM asked),
two AS (SELECT qid, text, x.intent AS intent, row_number() OVER (PARTITION BY qid ORDER BY x.score DESC, x.intent DESC) - 1 AS place FROM routes QUALIFY place < 2),
found AS (
  SELECT DISTINCT qid, place, a.id, a.seq, 20 AS most FROM two JOIN n x ON x.label = 'Pollutant' AND x.name_zh = nullif(regexp_extract(text, '{intent.INTENT_POLLUTANTS}', 1), ''){_hop("x", "STANDARD_LIMITS_POLLUTANT ARTICLE_REGULATES", "a", "in", "Article Standard Law Regulation")} WHERE intent = 'list_articles_about_pollutant'
  UNION ALL SELECT qid, place, a.id, a.seq, 5 FROM two JOIN n a ON a.label = 'Article' AND a.article_no = regexp_extract(text, '第[{NUMERALS}]+条') AND contains(a.parent_doc, text) WHERE intent = 'lookup_article_content'
), best AS (SELECT *, row_number() OVER (PARTITION BY qid, place ORDER BY seq, id) - 1 AS r FROM found QUALIFY r < most),
nodes AS (SELECT qid, id, min(row(place, r)) AS o FROM best GROUP BY ALL),
vs AS (SELECT asked.qid, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM asked JOIN embeddings e ON e.vec_id = qid, embeddings v),
l AS (
  SELECT qid, 0 AS list_no, 'vector' AS source, id::VARCHAR AS key, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM vs QUALIFY rank < 5
  UNION ALL SELECT qid, 1, 'graph', id, row_number() OVER (PARTITION BY qid ORDER BY o, id) - 1 AS rank FROM nodes QUALIFY rank < 40
  UNION ALL SELECT qid, 1, 'graph_text', id, row_number() OVER (PARTITION BY qid ORDER BY seq, id) - 1 AS rank FROM n, asked WHERE qid NOT IN (SELECT qid FROM nodes) AND (contains(name_zh, text) OR contains(full_name, text) OR (label = 'Article' AND contains(content, text))) QUALIFY rank < 5
  UNION ALL SELECT qid, 2, 'bm25', doc_id::VARCHAR, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id DESC) - 1 AS rank FROM bs WHERE score > 0 QUALIFY rank < 5
), f AS (SELECT qid, key, sum(1.0::DOUBLE / (60 + rank + 1)) AS rrf, min(row(list_no, rank)) AS first, array_to_string(list(source ORDER BY list_no), ',') AS sources FROM l WHERE list_no <> 0 OR key IN (SELECT doc_id::VARCHAR FROM documents) GROUP BY ALL)
SELECT qid::BIGINT AS qid, key, round(rrf, 8) AS rrf, sources, row_number() OVER v AS rank FROM f WINDOW v AS (PARTITION BY qid ORDER BY round(rrf, 12) DESC, first) QUALIFY row_number() OVER v <= 5"""
)
def routed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first generation's search for a batch of questions: nodes of the templates of a
    question's intents, substring hits where they give none, vectors and BM25."""
    corpus, _ = _corpus(spark, sf)
    corpus.graph = law_graph(spark, sf)
    asked = spark.createDataFrame(ROUTED, "qid long, text string")
    own = corpus.vectors.select(F.col("id").alias("qid"), "embedding").join(F.broadcast(asked.select("qid")), "qid", "left_semi")
    asked = asked.join(own, "qid", "left")
    return retrieval.routed(corpus, asked, 5).select("qid", "key", F.round("rrf", 8).alias("rrf"), F.array_join("sources", ",").alias("sources"), "rank")
