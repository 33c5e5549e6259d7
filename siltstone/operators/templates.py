"""The named graph queries, for batches of questions.

Each template is written once, over a table of parameters (qid, parameters): it gives the rows
of every question, with qid, and where the query has a limit the `rank` from 0 within a
question. `name.batch(g, asked)` takes such a table; `name(g, values)` asks one question.
Parameters meet properties in equality joins, or in substring joins by character pairs; a few
questions are put into the plan instead (see ranking.direct).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .graph import Graph
from .ranking import direct, top
from .substrings import containing


def p(node: str, key: str) -> Column:
    return F.col(f"{node}.props")[key]


def distinct(c: Column, upto: int | None = None) -> Column:
    out = F.array_sort(F.collect_set(c))
    return F.slice(out, 1, upto) if upto else out


def has(text: str, *keys: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col("props")[k].contains(text), F.lit(False)) for k in keys])


def without_blanks(c: Column) -> Column:
    """Standard ids are compared without their blanks."""
    return F.replace(c, F.lit(" "), F.lit(""))


def same(c: Column) -> Column:
    return c


BATCH: dict[str, Callable[..., DataFrame]] = {}


def template(*params: str, many: bool = False) -> Callable:
    """A template over its parameters; many: one question may give a list of values."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        BATCH[f.__name__] = f

        def one(g: Graph, *values, **options) -> DataFrame:
            given = [F.explode(F.array(*[F.lit(v) for v in values[0]])).alias(params[0])] if many else [F.lit(v).cast("string").alias(k) for k, v in zip(params, values, strict=True)]
            out = f(g, g.nodes.sparkSession.range(1).select(F.lit(0).cast("long").alias("qid"), *given), **options)
            return (out.orderBy("rank").drop("rank") if "rank" in out.columns else out).drop("qid")

        one.batch, one.params, one.__doc__ = f, params, f.__doc__
        return one

    return add


# -------------------------------------------------------------------- pieces

def equal(g: Graph, asked: DataFrame, labels: str | list[str], name: str, param: str, key: str, clean: Callable[[Column], Column] = same) -> DataFrame:
    """asked with a node whose property is the parameter, for each such node."""
    nodes = g.match(labels, name=name)
    if (batch := direct(asked)) is not None:
        return nodes.select(name, F.explode(batch).alias("_a")).select("_a.*", name).filter(clean(p(name, key)) == clean(F.col(param)))
    return asked.join(nodes, clean(p(name, key)) == clean(F.col(param)))


def wordy(g: Graph, asked: DataFrame, labels: str | list[str], name: str, pairs: list[tuple[str, str]], clean: Callable[[Column], Column] = same) -> DataFrame:
    """asked with a node in whose property the parameter occurs, by any of the pairs
    (parameter, property), for each such node once. The empty text occurs in every value."""
    nodes = g.match(labels, name=name)
    if (batch := direct(asked)) is not None:
        rows = nodes.select(name, F.explode(batch).alias("_a")).select("_a.*", name)
        return rows.filter(reduce(lambda a, b: a | b, [F.coalesce(F.contains(clean(p(name, k)), clean(F.col(q))), F.lit(False)) for q, k in pairs]))
    parts = []
    for param, key in pairs:
        texts = nodes.select(F.col(f"{name}.id").alias("_id"), F.col(f"{name}.label").alias("_label"), clean(p(name, key)).alias("text")).filter("text is not null")
        wanted = asked.select("qid", clean(F.col(param)).alias("word"))
        parts.append(wanted.join(containing(wanted, texts, "words"), "word").join(texts, "text").select("qid", "_id"))
        every = wanted.filter("word = ''").select("qid", F.explode(F.array(*[F.lit(v) for v in ([labels] if isinstance(labels, str) else labels)])).alias("_label"))
        parts.append(every.join(texts, "_label").select("qid", "_id"))
    found = reduce(DataFrame.unionByName, parts).distinct()
    return asked.join(found, "qid").join(nodes.withColumn("_id", F.col(f"{name}.id")), "_id").drop("_id")


def first(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows of each question, with rank."""
    return top(rows, Window.partitionBy("qid").orderBy(*order), limit)


def collected(g: Graph, rows: DataFrame, at: str, rel: str, label: str, key: str, name: str, direction: str = "out", upto: int | None = None) -> DataFrame:
    """(_at, name): the distinct values of a property over what the nodes `at` of rows are
    related to. Two such lists of one node are joined, not multiplied; questions that share a
    node share its lists."""
    hops = g.expand(rows.select(at).withColumn("_at", F.col(f"{at}.id")).dropDuplicates(["_at"]), at, [rel], "x", [label], direction)
    return hops.groupBy("_at").agg(distinct(p("x", key), upto).alias(name))


def with_lists(g: Graph, rows: DataFrame, at: str, lists: list[tuple], upto: int | None = None) -> DataFrame:
    """rows with a list (empty if there is none) for each (name, relationship, label, property,
    direction)."""
    for name, rel, label, key, direction in lists:
        found = collected(g, rows, at, rel, label, key, f"_{name}", direction, upto)
        rows = rows.join(found, F.col(f"{at}.id") == F.col("_at"), "left").withColumn(name, F.coalesce(f"_{name}", F.array().cast("array<string>"))).drop("_at", f"_{name}")
    return rows


def _cases(g: Graph, found: DataFrame, limit: int, upto: int | None = None) -> DataFrame:
    """The first cases of each question, then their lists: what is not shown is not followed."""
    rows = with_lists(g, first(found, limit, "c.seq", "c.id"), "c", [("articles", "CASE_VIOLATES_ARTICLE", "Article", "article_no", "out"), ("penalties", "CASE_TRIGGERS_PENALTY", "Penalty", "name_zh", "out")], upto)
    return rows.select("qid", "rank", F.col("c.id").alias("id"), F.col("c.seq").alias("seq"), *[p("c", k).alias(k) for k in ("title", "case_type", "summary")], "articles", "penalties")


# ----------------------------------------------------------------- templates

@template("std_id")
def pollutants_by_standard(g: Graph, asked: DataFrame) -> DataFrame:
    found = equal(g, asked, "Standard", "s", "std_id", "std_id", without_blanks)
    rows = g.expand(found, "s", ["STANDARD_LIMITS_POLLUTANT"], "x", ["Pollutant"], optional=True)
    return rows.groupBy("qid", p("s", "full_name").alias("standard")).agg(distinct(p("x", "name_zh")).alias("pollutants"))


_ABOUT = (["STANDARD_LIMITS_POLLUTANT", "ARTICLE_REGULATES"], "a", ["Article", "Standard", "Law", "Regulation"], "in")


@template("pollutant")
def articles_about_pollutant(g: Graph, asked: DataFrame, limit: int = 20) -> DataFrame:
    rows = g.expand(equal(g, asked, "Pollutant", "x", "pollutant", "name_zh"), "x", *_ABOUT)
    return first(g.expand(rows, "a", ["CONTAINS_ARTICLE"], "parent", direction="in", optional=True), limit, "a.seq", "x.seq", "parent.seq")


def articles_about_pollutants(g: Graph, asked: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, id, label, props, seq, rank from 0) for asked (qid, pollutant): the articles and
    documents of articles_about_pollutant(), each once. Ids are ranked, and only what is
    among the first is looked up."""
    rows = g.expand(equal(g, asked, "Pollutant", "x", "pollutant", "name_zh"), "x", *_ABOUT)
    once = rows.select("qid", F.col("a.id").alias("id"), F.col("a.seq").alias("seq")).groupBy("qid", "id").agg(F.min("seq").alias("seq"))
    found = scratch.stored(first(once, limit, "seq", "id"), "found")
    return g.with_nodes(found, _ABOUT[2]).select("qid", "id", "label", "props", "seq", "rank")


def article_contents(g: Graph, asked: DataFrame, limit: int = 5) -> DataFrame:
    """The same for asked (qid, article_no, doc_keyword): the articles of article_content()."""
    return article_content.batch(g, asked, limit).select("qid", "a.*", "rank")


@template("case_type", "violation")
def similar_cases(g: Graph, asked: DataFrame, limit: int = 10) -> DataFrame:
    return _cases(g, wordy(g, asked, "Case", "c", [("case_type", "case_type"), ("violation", "violations")]), limit)


@template("article_no", "doc_keyword")
def article_content(g: Graph, asked: DataFrame, limit: int = 5) -> DataFrame:
    found = equal(g, asked, "Article", "a", "article_no", "article_no").filter(F.contains(p("a", "parent_doc"), F.col("doc_keyword")))
    return first(found.select("qid", "a"), limit, "a.seq", "a.id")


@template("industry")
def industry_compliance(g: Graph, asked: DataFrame, limit: int = 20) -> DataFrame:
    rows = g.expand(equal(g, asked, "Industry", "i", "industry", "name_zh"), "i", ["APPLIES_TO_INDUSTRY"], "reg", ["Standard", "Regulation"], "both", True)
    rows = g.expand(rows, "reg", ["CONTAINS_ARTICLE"], "a", ["Article"], optional=True)
    return first(rows.groupBy("qid", F.col("i.id").alias("id")).agg(distinct(p("reg", "full_name")).alias("regulations"), distinct(p("a", "article_no")).alias("articles")), limit, "id")


@template("std_id")
def rule_standard_pollutants(g: Graph, asked: DataFrame, limit: int = 20) -> DataFrame:
    found = wordy(g, asked, "Standard", "s", [("std_id", "std_id"), ("std_id", "full_name")], without_blanks)
    rows = g.expand(found, "s", ["STANDARD_LIMITS_POLLUTANT"], "x", ["Pollutant"], optional=True)
    return first(rows.groupBy("qid", p("s", "full_name").alias("standard")).agg(distinct(p("x", "name_zh")).alias("pollutants")), limit, "standard")


@template("pollutant")
def rule_pollutant_articles(g: Graph, asked: DataFrame, limit: int = 20) -> DataFrame:
    rows = g.expand(equal(g, asked, "Pollutant", "x", "pollutant", "name_zh"), "x", ["ARTICLE_REGULATES", "STANDARD_LIMITS_POLLUTANT"], "a", ["Article", "Standard"], "in", True)
    return first(rows.groupBy("qid", p("x", "name_zh").alias("pollutant")).agg(distinct(p("a", "article_no"), 10).alias("articles"), distinct(p("a", "full_name"), 5).alias("standards")), limit, "pollutant")


@template("industry")
def rule_industry_standards(g: Graph, asked: DataFrame, limit: int = 20) -> DataFrame:
    rows = g.expand(equal(g, asked, "Industry", "i", "industry", "name_zh"), "i", ["APPLIES_TO_INDUSTRY"], "reg", ["Standard", "Regulation"], "in", True)
    return first(rows.groupBy("qid", p("i", "name_zh").alias("industry")).agg(distinct(p("reg", "full_name")).alias("standards")), limit, "industry")


@template("keyword")
def rule_cases(g: Graph, asked: DataFrame, limit: int = 10) -> DataFrame:
    """Penalties by CASE_TRIGGERS_PENALTY, the ontology's relationship; one of another name,
    which no builder makes, would find none."""
    return _cases(g, wordy(g, asked, "Case", "c", [("keyword", "title"), ("keyword", "case_type")]), limit).select("qid", "rank", F.col("title").alias("case_title"), "case_type", "articles", "penalties")


@template("article_no")
def rule_article(g: Graph, asked: DataFrame, limit: int = 5) -> DataFrame:
    rows = g.expand(equal(g, asked, "Article", "a", "article_no", "article_no"), "a", ["CONTAINS_ARTICLE"], "parent", direction="in", optional=True)
    parent = F.coalesce(p("parent", "name"), p("parent", "full_name"))
    return first(rows, limit, "a.seq", "parent.seq").select("qid", "rank", p("a", "article_no").alias("article_no"), p("a", "content").alias("content"), p("a", "themes").alias("themes"), parent.alias("parent_doc"))


@template("keyword")
def rule_penalty(g: Graph, asked: DataFrame, limit: int = 20) -> DataFrame:
    found = wordy(g, asked, "Penalty", "x", [("keyword", "name_zh"), ("keyword", "type")])
    rows = g.expand(found, "x", ["ARTICLE_DEFINES_PENALTY"], "a", ["Article"], "in", True)
    return first(rows.groupBy("qid", p("x", "name_zh").alias("penalty"), p("x", "type").alias("type")).agg(distinct(p("a", "article_no"), 5).alias("related_articles")), limit, "penalty", "type")


@template("keyword")
def rule_violation(g: Graph, asked: DataFrame, limit: int = 20) -> DataFrame:
    """Names are not keys: lists of nodes of one name are one list, cut when they are."""
    found = wordy(g, asked, "Violation", "v", [("keyword", "name_zh")])
    lists = {}
    for column, rel, label, key in (("articles", "ARTICLE_DEFINES_VIOLATION", "Article", "article_no"), ("cases", "CASE_INVOLVES_VIOLATION", "Case", "title")):
        lists[column] = g.expand(found, "v", [rel], "x", [label], "in", True).groupBy("qid", p("v", "name_zh").alias("violation")).agg(distinct(p("x", key), 5).alias(column))
    return first(lists["articles"].join(lists["cases"], ["qid", "violation"]), limit, "violation")


@template("domain", many=True)
def domain_routing(g: Graph, asked: DataFrame) -> DataFrame:
    rows = g.expand(equal(g, asked, "Industry", "i", "domain", "name_zh"), "i", ["APPLIES_TO_INDUSTRY"], "reg", ["Standard", "Regulation"], "both", True)
    return rows.groupBy("qid", p("i", "name_zh").alias("industry")).agg(distinct(p("reg", "full_name")).alias("applicable_regulations"))


@template("pollutant", many=True)
def entity_resolution(g: Graph, asked: DataFrame) -> DataFrame:
    rows = g.expand(equal(g, asked, "Pollutant", "x", "pollutant", "name_zh"), "x", ["STANDARD_LIMITS_POLLUTANT"], "s", ["Standard"], "in", True)
    return rows.groupBy("qid", p("x", "name_zh").alias("pollutant")).agg(F.array_sort(F.collect_list(p("s", "std_id"))).alias("standards"))  # repeats stay


@template("pollutant")
def tracing_sources(g: Graph, asked: DataFrame) -> DataFrame:
    rows = g.expand(equal(g, asked, "Pollutant", "x", "pollutant", "name_zh"), "x", ["SOURCE_EMITS_POLLUTANT"], "src", direction="in")
    return rows.select("qid", p("src", "name_zh").alias("source"), F.array("src.label").alias("labels"))


@template("pollutant")
def tracing_industries(g: Graph, asked: DataFrame) -> DataFrame:
    rows = g.expand(equal(g, asked, "Pollutant", "x", "pollutant", "name_zh"), "x", ["SOURCE_EMITS_POLLUTANT"], "i", ["Industry"], "in")
    rows = g.expand(rows, "i", ["APPLIES_TO_INDUSTRY"], "reg", ["Standard"], "both", True)
    return rows.groupBy("qid", p("i", "name_zh").alias("industry")).agg(distinct(p("reg", "std_id")).alias("standards"))


@template("pollutant")
def tracing_cases(g: Graph, asked: DataFrame, limit: int = 10) -> DataFrame:
    rows = first(wordy(g, asked, "Case", "c", [("pollutant", "case_type"), ("pollutant", "summary")]), limit, "c.seq")
    return rows.select("qid", "rank", p("c", "title").alias("title"), p("c", "case_type").alias("type"), p("c", "summary").alias("summary"))


@template("industry")
def compliance_standards(g: Graph, asked: DataFrame) -> DataFrame:
    rows = g.expand(equal(g, asked, "Industry", "i", "industry", "name_zh"), "i", ["APPLIES_TO_INDUSTRY"], "reg", ["Standard", "Regulation"], "both", True)
    return rows.select("qid", p("reg", "full_name").alias("name"), p("reg", "std_id").alias("std_id"))


@template("industry")
def compliance_cases(g: Graph, asked: DataFrame, limit: int = 15) -> DataFrame:
    rows = g.expand(wordy(g, asked, "Case", "c", [("industry", "summary"), ("industry", "title")]), "c", ["CASE_INVOLVES_VIOLATION"], "v", ["Violation"])
    rows = first(g.expand(rows, "c", ["CASE_TRIGGERS_PENALTY"], "x", ["Penalty"], optional=True), limit, "c.seq", "v.seq", "x.seq")
    return rows.select("qid", "rank", p("c", "title").alias("case_title"), p("v", "name_zh").alias("violation"), p("x", "name_zh").alias("penalty"))


@template("industry")
def compliance_articles(g: Graph, asked: DataFrame, limit: int = 30) -> DataFrame:
    """Articles of standards and regulations for which a path to the industry exists."""
    regs = g.expand(equal(g, asked, "Industry", "i", "industry", "name_zh"), "i", ["APPLIES_TO_INDUSTRY"], "reg", ["Standard", "Regulation"], "both").withColumn("rid", F.col("reg.id")).dropDuplicates(["qid", "rid"]).select("qid", "reg")
    rows = first(g.expand(regs, "reg", ["CONTAINS_ARTICLE"], "a", ["Article"]), limit, "a.seq")
    return rows.select("qid", "rank", p("a", "article_no").alias("article_no"), p("a", "themes").alias("themes"), p("a", "penalty").alias("penalty"))


@template("pattern")
def fraud_cases(g: Graph, asked: DataFrame, limit: int = 10) -> DataFrame:
    return _cases(g, wordy(g, asked, "Case", "c", [("pattern", "summary"), ("pattern", "title")]), limit).select("qid", "rank", "title", "summary", "articles", "penalties")


def fraud_violations(g: Graph) -> DataFrame:
    """Takes no parameter."""
    where = reduce(lambda a, b: a | b, [has(w, "name_zh") for w in ("伪造", "篡改", "虚假", "造假")])
    return g.match("Violation", where, "v").orderBy("v.seq").select(p("v", "name_zh").alias("violation"))
