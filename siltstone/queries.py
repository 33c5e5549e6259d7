"""The library's queries by name, and the SQL that DuckDB answers them with. Each runs
over whole tables; only top-k reports have limits."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import segment
from .functions.text import ARTICLE, HEADING, NUMERALS, cache_key, json_block, node_id, normalize_space
from .operators import ann, answer, bm25, chunking, evaluate, extraction, fusion, graph, intent, postings, vector
from .operators.graph import Graph
from .operators.templates import distinct
from .plans import build, retrieval
from .sources import readers, scratch, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# What stands in for the CJK tables on Latin test data.
LATIN_THEMES = {"general": ["and", "that"], "movement": ["tion", "ing"], "romance": ["que", "los"], "german": ["und", "der"], "listing": [" | "]}
LATIN_INTENTS = {"ask_number": ["[0-9]+", "une?"], "ask_list": ["the", "of"], "ask_place": ["que", "est", "dans"], "ask_rule": ["der", "und"]}
QUESTIONS = [(1, "the nation of onthe"), (2, "que la reux dans"), (3, "und die nicht"), (4, "ciones de los")]
SEARCHES = [(1, "STEEL"), (2, "Part 17"), (3, "small copper box"), (4, "BRAZIL")]
ARTICLES = [
    ("d1", "序言文字。\n第一章 总则\n第一条 为了保护和改善环境，防治污染和其他公害，制定本法。\n第二条 本法所称环境，是指影响人类生存和发展的各种因素的总体。\n第二章 监督\n第三条 超标排放的，处罚款，并责令改正，情节严重的停产整治。\n第四条第一款 依照第三条的规定，排污许可证由主管部门核发管理。"),
    ("d2", "第一条 短。\n第二条 监测数据应当真实有效，不得伪造或者篡改监测数据记录。"),
]
# Laws made of the documents: chapters and articles around their texts, on one line each.
_LINE = "regexp_replace(left(coalesce(text, ''), {}), '[^A-Za-z]+', ' '{})"
_LAW = "concat('序言。', chr(10), '第一章 总则 ', lang, chr(10), '第', doc_id + 1, '条 ', {a}, chr(10), '第', doc_id + 2, '条第一款 依照第3条的规定，', {a}, chr(10), '第二章 ', coalesce(source, ''), chr(10), '第七条 ', {b})"
LAW_SPARK, LAW_DUCK = (_LAW.format(a=_LINE.format(150, end), b=_LINE.format(1200, end)) for end in ("", ", 'g'"))
LAW_DUCK = f"regexp_replace({LAW_DUCK}, ' +', ' ', 'g')"
ASKED = [(1, "GB 3095-2012 标准的排放限值是多少"), (2, "PM2.5 超标怎么处罚"), (3, "钢铁行业合规要求"), (4, "类似案例参考"), (5, "第三十条怎么规定"), (6, "今天天气"), (7, "违法排污罚款流程如何"), (8, "大气污染防治 SO2 和 COD")]
NAMES = [("Pollutant", "二氧化硫"), ("Pollutant", "VOC"), ("Pollutant", " 未知　物 "), ("Industry", "炼钢"), ("Region", "省级"), ("Penalty", "罚金"), ("Other", "二氧化硫"), ("Violation", "数据失真")]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(quoted(v) for v in r) + ')' for r in rows)}) AS t({names})"


def md5_text(c: str = "text") -> Column:
    return F.md5(F.col(c)).alias(f"{c}_md5")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("seq"), "lang")


# ------------------------------------------------------------------------ text

NORM = r"regexp_replace(regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g')"


@query(f"SELECT doc_id, md5({NORM}) AS text_md5, length({NORM})::BIGINT AS n FROM documents")
def norm_text(spark: SparkSession, sf: str) -> DataFrame:
    text = normalize_space(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n"))


FOLD = f"""
WITH ps AS (
  SELECT doc_id::VARCHAR AS doc_id, list_filter(list_transform(string_split({NORM}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents
), folded AS (
  SELECT doc_id, list_reduce(ps, lambda acc, p:
    CASE WHEN acc.n + length(p) > 800 AND len(acc.cur) > 0 THEN
      {{'out': list_append(acc.out, {{'s': acc.s, 't': array_to_string(acc.cur, chr(10) || chr(10))}}),
       'cur': list_append(acc.cur[list_min(list_filter(range(1, len(acc.cur) + 2), lambda i: coalesce(list_sum(list_transform(acc.cur[i:], lambda y: length(y))), 0) <= 150)):], p),
       'n': (coalesce(list_sum(list_transform(acc.cur[list_min(list_filter(range(1, len(acc.cur) + 2), lambda i: coalesce(list_sum(list_transform(acc.cur[i:], lambda y: length(y))), 0) <= 150)):], lambda y: length(y))), 0) + length(p))::BIGINT,
       's': (acc.s + length(array_to_string(acc.cur, chr(10) || chr(10))) - coalesce(list_sum(list_transform(acc.cur[list_min(list_filter(range(1, len(acc.cur) + 2), lambda i: coalesce(list_sum(list_transform(acc.cur[i:], lambda y: length(y))), 0) <= 150)):], lambda y: length(y))), 0))::BIGINT}}
    ELSE {{'out': acc.out, 'cur': list_append(acc.cur, p), 'n': (acc.n + length(p))::BIGINT, 's': acc.s}} END,
    {{'out': []::STRUCT(s BIGINT, t VARCHAR)[], 'cur': []::VARCHAR[], 'n': 0::BIGINT, 's': 0::BIGINT}}) AS f FROM ps
), chunks AS (
  SELECT doc_id, unnest(CASE WHEN len(f.cur) > 0 THEN list_append(f.out, {{'s': f.s, 't': array_to_string(f.cur, chr(10) || chr(10))}}) ELSE f.out END) AS c FROM folded
), rows AS (SELECT doc_id, c.s AS span_start, c.s + length(c.t) AS span_end, c.t AS text FROM chunks)
"""


def laws(spark: SparkSession, sf: str) -> DataFrame:
    """Two texts as laws are written, and one made of each document."""
    made = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.expr(LAW_SPARK).alias("text"))
    return spark.createDataFrame(ARTICLES, "doc_id string, text string").unionByName(made)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.by_window(chunking.normalized(table(spark, sf, "documents")), separator="\n", theme_table=LATIN_THEMES)


@query(FOLD + "SELECT doc_id, 'chunk_' || substr(md5(doc_id || '::' || span_start || '::' || span_end), 1, 12) AS chunk_id, span_start, span_end::BIGINT AS span_end, md5(text) AS text_md5 FROM rows")
def chunk_window(spark: SparkSession, sf: str) -> DataFrame:
    return windows(spark, sf).select("doc_id", "chunk_id", "span_start", "span_end", md5_text())


@query(
    f"""
WITH d AS (SELECT * FROM {values(ARTICLES, 'doc_id, text')} UNION ALL SELECT doc_id::VARCHAR, {LAW_DUCK} FROM documents),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '({ARTICLE})', chr(1) || '\\1', 'g'), chr(1))) AS piece, generate_subscripts(string_split(regexp_replace(text, '({ARTICLE})', chr(1) || '\\1', 'g'), chr(1)), 1) AS i FROM d),
a AS (SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS start FROM p),
hp AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(?m)(^\\s*{HEADING})', chr(1) || '\\1', 'g'), chr(1))) AS piece, generate_subscripts(string_split(regexp_replace(text, '(?m)(^\\s*{HEADING})', chr(1) || '\\1', 'g'), chr(1)), 1) AS i FROM d),
h AS (SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS start, trim(regexp_extract(piece, '({HEADING})', 1)) AS chapter FROM hp)
SELECT a.doc_id, a.start::BIGINT AS span_start, (a.start + length(a.piece))::BIGINT AS span_end, regexp_extract(a.piece, '^{ARTICLE}') AS article_no,
  coalesce((SELECT max_by(h.chapter, h.start) FROM h WHERE h.doc_id = a.doc_id AND h.i > 1 AND h.start <= a.start), '') AS chapter, md5(regexp_replace(a.piece, '^\\s+|\\s+$', '', 'g')) AS text_md5
FROM a WHERE i > 1 AND length(regexp_replace(a.piece, '^\\s+|\\s+$', '', 'g')) >= 20
"""
)
def chunk_article_cjk(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.by_article(chunking.normalized(laws(spark, sf))).select("doc_id", "span_start", "span_end", "article_no", F.col("structure_path")[0].alias("chapter"), md5_text())


@query(
    """
WITH p AS (SELECT page_id, unnest(string_split(regexp_replace(html, '(<(?:h[1-6]|p)>)', chr(1) || '\\1', 'g'), chr(1))) AS piece, generate_subscripts(string_split(regexp_replace(html, '(<(?:h[1-6]|p)>)', chr(1) || '\\1', 'g'), chr(1)), 1) AS i FROM pages)
SELECT page_id::VARCHAR AS doc_id, i::BIGINT - 1 AS i, (sum(length(piece)) OVER (PARTITION BY page_id ORDER BY i) - length(piece))::BIGINT AS start, length(piece)::BIGINT AS n FROM p
"""
)
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("html").alias("text"))
    return chunking.sections(pages, "(<(?:h[1-6]|p)>)").select("doc_id", F.col("i").cast("long").alias("i"), F.col("start").cast("long").alias("start"), F.length("piece").cast("long").alias("n"))


THEME_SQL = ", ".join("CASE WHEN " + " OR ".join(f"contains(text, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in LATIN_THEMES.items())


@query(f"SELECT doc_id, array_to_string(list_filter([{THEME_SQL}], lambda x: x IS NOT NULL), ',') AS themes FROM documents")
def themes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(chunking.themes(F.col("text"), LATIN_THEMES), ",").alias("themes"))


@query(f"SELECT etype, name, CASE name WHEN '未知' THEN name ELSE coalesce((SELECT n FROM (VALUES ('Pollutant', '二氧化硫', 'SO2'), ('Pollutant', 'VOC', 'VOCs'), ('Industry', '炼钢', '钢铁'), ('Region', '省级', '省'), ('Penalty', '罚金', '罚款'), ('Violation', '数据失真', '数据造假')) AS d(e, a, n) WHERE d.e = t.etype AND d.a = t.name), replace(trim(name), '　', '')) END AS norm FROM (SELECT * FROM {values(NAMES, 'etype, name')} UNION ALL SELECT 'Industry', p_name FROM part) t")
def normalize_entities(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.lit("Industry").alias("etype"), F.col("p_name").alias("name"))
    return extraction.normalize_entities(spark.createDataFrame(NAMES, "etype string, name string").unionByName(names))


@query("SELECT event_id, props AS block, json_valid(props) AS valid FROM events")
def json_blocks(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("text\n```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("so: "), "props")).otherwise(F.col("props"))
    block = json_block(raw)
    return table(spark, sf, "events").select("event_id", block.alias("block"), F.try_parse_json(block).isNotNull().alias("valid"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


def text_size(prompt: str) -> str:
    """A model that tells how long the text of its prompt is, or, for every ninth length, no JSON."""
    n = len(prompt.split("正文：\n", 1)[1])
    return json.dumps({"entities": {}, "relationships": [], "articles": [], "doc_summary": str(n)}) if n % 9 else "none"


_ASKED_SIZE = f"CASE WHEN length(coalesce(text, '')) > {extraction.LIMIT} THEN {extraction.LIMIT + len(extraction.MORE)} ELSE length(coalesce(text, '')) END"


@query(f"SELECT doc_id::VARCHAR AS doc_id, CASE WHEN n % 9 <> 0 THEN n::VARCHAR END AS summary, md5(substr(coalesce(text, ''), 1, 200)) AS preview_md5, n % 9 = 0 AS failed FROM (SELECT *, {_ASKED_SIZE} AS n FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def extract_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the documents that the labelled ones, done before, are not among."""
    docs = documents(spark, sf).select(F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("string").alias("doc_id"), "text", F.from_json(F.lit(None).cast("string"), readers.META).alias("doc_metadata"), F.lit("p").alias("source_path"))
    done = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    rows = extraction.extract(docs, text_size, done)
    return rows.select("doc_id", F.col("extraction.doc_summary").alias("summary"), F.md5("raw_text_preview").alias("preview_md5"), F.col("error").isNotNull().alias("failed"))


# ----------------------------------------------------------------------- graph

def _id_sql(label: str, key: str) -> str:
    return f"'{label}_' || substr(regexp_replace({key}::VARCHAR, '[^\\w]', '_', 'g'), 1, 30) || '_' || substr(md5('{label}::' || {key}), 1, 8)"


_SOURCES = [("Region", "region", "r_regionkey", "r_name", 0), ("Nation", "nation", "n_nationkey", "n_name", 10**3), ("Supplier", "supplier", "s_suppkey", "s_name", 10**6), ("Customer", "customer", "c_custkey", "c_name", 10**9), ("Part", "part", "p_partkey", "p_name", 10**12)]
_LINKS = [("Nation", "nation", "n_nationkey", "IN_REGION", "Region", "n_regionkey", 0), ("Supplier", "supplier", "s_suppkey", "IN_NATION", "Nation", "s_nationkey", 10**6), ("Customer", "customer", "c_custkey", "IN_NATION", "Nation", "c_nationkey", 10**9), ("Supplier", "lineitem", "l_suppkey", "SUPPLIES", "Part", "l_partkey", 10**12)]
NODES_SQL = " UNION ALL ".join(f"SELECT {_id_sql(label, key)} AS id, '{label}' AS label, {name} AS name_zh, ({key} + {base})::BIGINT AS seq FROM {t}" for label, t, key, name, base in _SOURCES)
EDGES_SQL = " UNION ALL ".join(f"SELECT {_id_sql(a, ka)} AS from_id, '{a}' AS from_label, '{rel}' AS rel, {_id_sql(b, kb)} AS to_id, '{b}' AS to_label FROM {t}" for a, t, ka, rel, b, kb, _ in _LINKS)
GRAPH_SQL = f"WITH nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL}) "


def trade_graph(spark: SparkSession, sf: str) -> Graph:
    """The trade tables as a property graph; each line item is an edge of its own."""
    nodes, edges = [], []
    for label, t, key, name, base in _SOURCES:
        nodes.append(table(spark, sf, t).select(node_id(label, F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), graph.props(name_zh=F.col(name)).alias("props"), (F.col(key) + base).cast("long").alias("seq")))
    for a, t, ka, rel, b, kb, base in _LINKS:
        edges.append(table(spark, sf, t).select(node_id(a, F.col(ka).cast("string")).alias("from_id"), F.lit(a).alias("from_label"), F.lit(rel).alias("rel"), node_id(b, F.col(kb).cast("string")).alias("to_id"), F.lit(b).alias("to_label"), graph.no_props().alias("props"), (F.col(ka) + base).cast("long").alias("seq")))
    n, e = nodes[0], edges[0]
    for other in nodes[1:]:
        n = n.unionByName(other)
    for other in edges[1:]:
        e = e.unionByName(other)
    return Graph(n, e)


@query(GRAPH_SQL + "SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return trade_graph(spark, sf).nodes.select("id", "label", F.col("props")["name_zh"].alias("name_zh"), "seq")


@query(GRAPH_SQL + "SELECT * FROM edges")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return trade_graph(spark, sf).edges.drop("props", "seq")


@query("SELECT user_id::VARCHAR AS id, arg_min(event_type, row(ts, event_id)) AS label, arg_max(event_type, row(ts, event_id)) AS last_type, arg_max(props, row(ts, event_id)) AS last_props FROM events GROUP BY user_id")
def graph_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("label"), graph.props(type=F.col("event_type"), raw=F.col("props")).alias("props"), F.struct("ts", "event_id").alias("seq"))
    return graph.upsert_nodes(rows).select("id", "label", F.col("props")["type"].alias("last_type"), F.col("props")["raw"].alias("last_props"))


@query("WITH keep AS (SELECT p_partkey FROM part WHERE p_size > 10) SELECT count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM keep)")
def graph_ref_check(spark: SparkSession, sf: str) -> DataFrame:
    """Edges to parts that the graph holds; small parts are not in it."""
    g = trade_graph(spark, sf)
    small = table(spark, sf, "part").filter("p_size <= 10").select(node_id("Part", F.col("p_partkey").cast("string")).alias("id"))
    nodes = g.nodes.join(small, "id", "left_anti")
    return graph.checked_edges(g.edges.filter("rel = 'SUPPLIES'"), nodes).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("from_id").alias("suppliers"))


@query("SELECT l_partkey, l_suppkey, l_orderkey AS first_order, l_linenumber::BIGINT AS first_line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1")
def graph_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return graph.keep_first(rows, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", F.col("seq.l_orderkey").alias("first_order"), F.col("seq.l_linenumber").cast("long").alias("first_line"))


@query(GRAPH_SQL + "SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ROLLUP(label) UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY ROLLUP(rel)")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    return graph.stats(g.nodes, g.edges)


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_match(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    rows = g.expand(g.match("Customer", name="n"), "n", ["IN_NATION"], "m", ["Nation"])
    return rows.select(F.col("n.props")["name_zh"].alias("customer"), F.col("m.props")["name_zh"].alias("nation"))


@query(
    GRAPH_SQL
    + f"""
, q AS (SELECT qid, text, CASE WHEN len(list_filter(string_split(text, ' '), lambda x: length(x) >= 2)) > 0 THEN list_filter(string_split(text, ' '), lambda x: length(x) >= 2) ELSE [text] END AS kws FROM {values(SEARCHES, 'qid, text')}),
s AS (SELECT qid, id, label, seq, list_sum(list_transform(kws, lambda k: CASE WHEN contains(name_zh, k) THEN length(k) / length(name_zh)::DOUBLE * (1 + 0.1::DOUBLE * length(k)) WHEN contains(text, name_zh) AND length(name_zh) >= 2 THEN 0.5::DOUBLE * length(name_zh) / length(text) ELSE 0 END)) AS score FROM nodes, q)
SELECT qid::BIGINT AS qid, id, label, round(score, 6) AS score, row_number() OVER w - 1 AS rank FROM s WHERE score > 0 WINDOW w AS (PARTITION BY qid ORDER BY round(score, 9) DESC, seq, id) QUALIFY row_number() OVER w <= 10
"""
)
def graph_text_search(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.createDataFrame(SEARCHES, "qid long, text string")
    return trade_graph(spark, sf).text_search(q, 10).withColumn("score", F.round("score", 6))


@query(GRAPH_SQL + "SELECT id, label, name_zh FROM nodes WHERE contains(name_zh, 'an') ORDER BY seq, id LIMIT 10")
def graph_substring(spark: SparkSession, sf: str) -> DataFrame:
    return trade_graph(spark, sf).substring("an").select("id", "label", F.col("props")["name_zh"].alias("name_zh"))


@query(
    GRAPH_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """
, walk(id, depth) AS (SELECT id, 0 FROM nodes WHERE label = 'Customer' UNION SELECT e.to_id, depth + 1 FROM walk JOIN (SELECT DISTINCT from_id, to_id FROM edges) e ON e.from_id = walk.id WHERE depth < 2)
SELECT id, min(depth)::BIGINT AS depth FROM walk GROUP BY id
"""
)
def graph_khop(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    return g.khop(g.nodes.filter("label = 'Customer'"), 2).select("id", F.col("depth").cast("long").alias("depth"))


@query(ORACLE_SQL["graph_khop"].replace("depth < 2", "depth < 6").replace("label = 'Customer'", "label IN ('Customer', 'Supplier')"))
def graph_khop_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Six steps; parts are the last to be found, and nothing follows them."""
    g = trade_graph(spark, sf)
    return g.khop(g.nodes.filter(F.col("label").isin("Customer", "Supplier")), 6).select("id", F.col("depth").cast("long").alias("depth"))


@query(
    GRAPH_SQL.rstrip() + """, e AS (SELECT from_id, rel, to_id, count(DISTINCT seq) AS n FROM (SELECT *, 0 AS seq FROM edges) GROUP BY ALL)
SELECT 'node' AS kind, id AS a, label AS rel, name_zh AS b, seq AS n FROM nodes UNION ALL SELECT 'edge', from_id, rel, to_id, n FROM e"""
)
def graph_store_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A store on disk, filled by three overlapping batches; the last is the whole graph."""
    g, store = trade_graph(spark, sf), stores.BucketStore(spark, scratch.folder(spark, "graph"))
    for part in ("label in ('Region', 'Nation')", "label <> 'Customer'", "true"):
        store.add(g.nodes.filter(part), g.edges)
    now = store.graph
    edges = now.edges.groupBy("from_id", "rel", "to_id").agg(F.count(F.lit(1)).alias("n"))
    rows = now.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("rel"), F.col("props")["name_zh"].alias("b"), F.col("seq").alias("n"))
    return rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("from_id").alias("a"), "rel", F.col("to_id").alias("b"), "n"))


@query("SELECT rel, count(*) AS n FROM (" + GRAPH_SQL + "SELECT e.* FROM edges e WHERE e.from_label IN ('Nation', 'Region', 'Supplier') AND e.to_label IN ('Nation', 'Region', 'Supplier')) GROUP BY rel")
def graph_induced(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    return g.induced(g.nodes.filter(F.col("label").isin("Nation", "Region", "Supplier"))).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(GRAPH_SQL + ", s AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY label ORDER BY seq, id) <= 25) SELECT id, label FROM s ORDER BY seq, id LIMIT 200")
def graph_sample(spark: SparkSession, sf: str) -> DataFrame:
    return trade_graph(spark, sf).sample(200).select("id", "label")


# Shapes of the templates, on the trade graph.

@query("SELECT r_name AS region, coalesce(string_agg(DISTINCT n_name, ',' ORDER BY n_name), '') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY r_name")
def tpl_optional_collect(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    some = Graph(g.nodes, g.edges.join(g.match("Region", F.col("props")["name_zh"] == "ASIA", "r").select(F.col("r.id").alias("to_id")), "to_id", "left_anti"))
    rows = some.expand(some.match("Region", name="r"), "r", ["IN_REGION"], "x", ["Nation"], "in", True)
    return rows.groupBy(F.col("r.props")["name_zh"].alias("region")).agg(F.array_join(distinct(F.col("x.props")["name_zh"]), ",").alias("nations"))


@query("SELECT n_name AS nation, m.label, m.name FROM nation JOIN (SELECT 'Customer' AS label, c_name AS name, c_nationkey AS k FROM customer UNION ALL SELECT 'Supplier', s_name, s_nationkey FROM supplier) m ON m.k = n_nationkey WHERE n_name LIKE '%A%'")
def tpl_label_disjunction(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    rows = g.expand(g.match("Nation", F.col("props")["name_zh"].contains("A"), "n"), "n", ["IN_NATION", "SUPPLIES"], "m", ["Customer", "Supplier"], "in")
    return rows.select(F.col("n.props")["name_zh"].alias("nation"), "m.label", F.col("m.props")["name_zh"].alias("name"))


@query("SELECT s_name AS supplier, count(DISTINCT l_partkey) AS parts, string_agg(DISTINCT n_name, ',') AS nations FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey WHERE contains(s_name, '7') OR contains(s_name, '9') GROUP BY s_name")
def tpl_contains_or(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    name = F.col("props")["name_zh"]
    rows = g.expand(g.match("Supplier", name.contains("7") | name.contains("9"), "s"), "s", ["SUPPLIES"], "p", ["Part"], optional=True)
    rows = g.expand(rows.select("s", F.col("s.id").alias("sid"), F.col("p.id").alias("part")).dropDuplicates(["sid", "part"]), "s", ["IN_NATION"], "n", ["Nation"], optional=True)
    return rows.groupBy(F.col("s.props")["name_zh"].alias("supplier")).agg(F.countDistinct("part").alias("parts"), F.array_join(distinct(F.col("n.props")["name_zh"]), ",").alias("nations"))


@query("SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1 AS n FROM nation")
def tpl_undirected(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    rows = g.expand(g.match("Nation", name="n"), "n", ["IN_NATION", "IN_REGION"], "m", direction="both")
    return rows.groupBy(F.col("n.props")["name_zh"].alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name AS part, p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey = p_partkey AND n_nationkey = 2)")
def tpl_path_exists(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    rows = g.expand(g.match("Nation", F.col("id") == node_id("Nation", F.lit("2")), "n"), "n", ["IN_NATION"], "s", ["Supplier"], "in")
    ids = g.expand(rows, "s", ["SUPPLIES"], "p", ["Part"]).select(F.col("p.id").alias("id")).distinct()
    return table(spark, sf, "part").withColumn("id", node_id("Part", F.col("p_partkey").cast("string"))).join(ids, "id", "left_semi").select(F.col("p_name").alias("part"), "p_partkey")


@query("SELECT n_name AS nation, count(*) FILTER (c_custkey IS NOT NULL) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (1, 5, 7) GROUP BY n_name")
def tpl_in_list(spark: SparkSession, sf: str) -> DataFrame:
    """IN list, then a collect that keeps repeats."""
    g = trade_graph(spark, sf)
    ids = [node_id("Nation", F.lit(str(k))) for k in (1, 5, 7)]
    rows = g.expand(g.match("Nation", F.col("id").isin(*ids), "n"), "n", ["IN_NATION"], "c", ["Customer"], "in", True)
    return rows.groupBy(F.col("n.props")["name_zh"].alias("nation")).agg(F.size(F.collect_list("c.id")).cast("long").alias("customers"))


@query("SELECT n_name AS nation, array_to_string(list_sort(list(DISTINCT s_name))[1:3], ',') AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def tpl_slice(spark: SparkSession, sf: str) -> DataFrame:
    g = trade_graph(spark, sf)
    rows = g.expand(g.match("Nation", name="n"), "n", ["IN_NATION"], "s", ["Supplier"], "in")
    return rows.groupBy(F.col("n.props")["name_zh"].alias("nation")).agg(F.array_join(distinct(F.col("s.props")["name_zh"], 3), ",").alias("suppliers"))


# ------------------------------------------------------------------- questions

ASKED_SQL = f"SELECT qid, text FROM {values(ASKED, 'qid, text')} UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as they come in Chinese, and every turn of the conversations."""
    turns = table(spark, sf, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return spark.createDataFrame(ASKED, "qid long, text string").unionByName(turns)


INTENT_SQL = ", ".join(f"{{'score': {' + '.join(f'''regexp_matches(text, '(?i){p}')::INT''' for p in ps)}, 'intent': '{name}'}}" for name, ps in LATIN_INTENTS.items())


@query(
    f"""
WITH r AS (SELECT conv_id * 1000 + turn AS qid, list_filter([{INTENT_SQL}], lambda x: x.score > 0) AS l FROM conversations),
s AS (SELECT qid, unnest(CASE WHEN len(l) > 0 THEN l ELSE [{{'score': 0, 'intent': 'semantic_fallback'}}] END) AS x FROM r)
SELECT qid, x.intent AS intent, x.score::BIGINT AS score, row_number() OVER (PARTITION BY qid ORDER BY x.score DESC, x.intent DESC) - 1 AS rank FROM s
"""
)
def intent_route(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return intent.route(asked, LATIN_INTENTS)


@query(
    f"""SELECT qid::BIGINT AS qid, nullif(replace(regexp_extract(text, '(?i)((?:GB|HJ|DB)\\s*[\\d\\-—]+)', 1), ' ', ''), '') AS std_id, nullif(regexp_extract(text, '(?i)(SO2|NOx|PM2\\.5|PM10|VOCs|COD|氨氮|NH3-N|危险废物|危废|总磷|总氮)', 1), '') AS pollutant,
nullif(regexp_extract(text, '(罚款|拘留|停产|吊销|查封|责令)', 1), '') AS penalty_keyword, nullif(regexp_extract(text, '(第[{NUMERALS}]+条)', 1), '') AS article_no FROM ({ASKED_SQL})"""
)
def param_extract(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("qid", intent.params(F.col("text")).alias("p")).select("qid", "p.std_id", "p.pollutant", "p.penalty_keyword", "p.article_no")


@query(
    f"""SELECT qid::BIGINT AS qid, CASE WHEN regexp_matches(text, '(?i)(GB|HJ|DB)\\s*[\\d\\-—]+') THEN 'standard_pollutants' WHEN regexp_matches(text, '(?i)(SO2|NOx|PM2\\.5|PM10|VOCs|COD|NH3-N|危废|危险废物)') THEN 'pollutant_articles'
WHEN regexp_matches(text, '(钢铁|化工|印染|造纸|火电|水泥|制药|石化|焦化|有色|电镀|电池|畜禽)') THEN 'industry_standards' WHEN regexp_matches(text, '(案件|案例|参考|类似)') THEN 'cases' WHEN regexp_matches(text, '第[{NUMERALS}]+条') THEN 'article'
WHEN regexp_matches(text, '(罚款|拘留|停产|吊销|查封|责令)') THEN 'penalty' END AS template FROM ({ASKED_SQL})"""
)
def template_match(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("qid", intent.match_template(F.col("text")).alias("template"))


@query("SELECT conv_id, turn, 1.0::DOUBLE AS vector_w, CASE WHEN c THEN 2.0 ELSE 1.5 END::DOUBLE AS graph_w, CASE WHEN c THEN 1.0 WHEN s THEN 1.8 ELSE 1.5 END::DOUBLE AS bm25_w FROM (SELECT conv_id, turn, contains(lower(text), 'tion') AS c, contains(lower(text), 'que') AS s FROM conversations)")
def query_weights(spark: SparkSession, sf: str) -> DataFrame:
    v, g, b = fusion.query_weights(F.col("text"), ["tion"], ["que"])
    return table(spark, sf, "conversations").select("conv_id", "turn", v.alias("vector_w"), g.alias("graph_w"), b.alias("bm25_w"))


# ------------------------------------------------------------------- retrieval

TOKENS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[\\x{4e00}-\\x{9fa5}]')"
BM25_SQL = f"""
WITH w AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
lens AS (SELECT doc_id, len({TOKENS_SQL})::BIGINT AS dl FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL),
c AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM lens),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {values(QUESTIONS, 'qid, text')}),
qf AS (SELECT qid, term, count(*) AS qf FROM q GROUP BY ALL)
"""
SCORE_SQL = """, s AS (SELECT qid, doc_id, sum(qf * idf * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM qf JOIN idfs USING (term) JOIN post USING (term) JOIN lens USING (doc_id), c GROUP BY ALL)
SELECT qid::BIGINT AS qid, doc_id AS id, round(score, 6) AS score, row_number() OVER v - 1 AS rank FROM s WHERE score > 0 WINDOW v AS (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id {way}) QUALIFY row_number() OVER v <= 10
"""


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid long, text string")


@query(BM25_SQL + "SELECT term, df, round(ln((n - df + 0.5e0) / (df + 0.5e0) + 1), 6) AS idf FROM terms, c")
def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.build_index(documents(spark, sf)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(BM25_SQL + ", idfs AS (SELECT term, ln((n - df + 0.5e0) / (df + 0.5e0) + 1) AS idf FROM terms, c)" + SCORE_SQL.format(way="DESC"))
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(bm25.build_index(documents(spark, sf)), _questions(spark)).withColumn("score", F.round("score", 6))


@query(BM25_SQL + ", raw AS (SELECT term, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM terms, c), idfs AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) FROM raw) * 0.25e0 ELSE idf END AS idf FROM raw)" + SCORE_SQL.format(way="ASC"))
def bm25_okapi(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(bm25.build_index(documents(spark, sf), okapi=True), _questions(spark), later_first=False).withColumn("score", F.round("score", 6))


def _stored(spark: SparkSession, sf: str, okapi: bool = False) -> postings.StoredIndex:
    """Stored postings of all documents, in two batches."""
    docs, index = documents(spark, sf), postings.StoredIndex(spark, scratch.folder(spark, "postings"), okapi)
    index.add(docs.filter("id % 3 > 0"), "first")
    index.add(docs, "second")
    return index


@query(ORACLE_SQL["bm25_search"])
def bm25_stored(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(_stored(spark, sf), _questions(spark)).withColumn("score", F.round("score", 6))


@query(ORACLE_SQL["bm25_okapi"])
def bm25_stored_okapi(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(_stored(spark, sf, True), _questions(spark), later_first=False).withColumn("score", F.round("score", 6))


# A small dictionary, and sentences that the documents' ids and sources put together from pieces.
WORDS = {"大气": 8, "大气污染": 5, "污染": 9, "污染物": 4, "物": 3, "排放": 7, "排放标准": 3, "标准": 6, "防治": 4, "防治法": 2, "污染防治": 2, "气污": 1, "排": 2, "放标": 1}
PIECES = ["大气污染", "物排放", "标准", "防治法", "气污", "放标准", "GB3095 ", "排水"]
_PIECE = "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(PIECES)) + " END"
SENTENCE = "concat(" + ", ".join(_PIECE.format(f"({e}) % {len(PIECES)}") for e in ("doc_id", "doc_id % 1000000 * 7 + 3", "n_chars", "length(coalesce(source, '')) + doc_id")) + ")"
_FREQ = sum(WORDS.values())


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, lower({SENTENCE}) AS t FROM documents), w AS (SELECT word, ln(f) - ln({_FREQ}) AS s FROM {values(list(WORDS.items()), 'word, f')}),
runs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fa5}}]+')) AS run, generate_subscripts(regexp_extract_all(t, '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fa5}}]+'), 1) AS no FROM d),
texts AS (SELECT DISTINCT run FROM runs), chars AS (SELECT DISTINCT unnest(string_split(run, '')) AS word FROM texts),
steps AS (SELECT word, s FROM w UNION ALL SELECT word, -ln({_FREQ}) FROM chars WHERE word NOT IN (SELECT word FROM w)), ways AS ( -- every way to cut a run into words and single characters
  SELECT run, 0 AS pos, 0.0::DOUBLE AS score, []::VARCHAR[] AS path FROM texts WHERE run >= '一'
  UNION ALL SELECT run, pos + length(word), score + s, list_append(path, word) FROM ways JOIN steps ON starts_with(substr(run, pos + 1), word)
), best AS (SELECT run, path FROM ways WHERE pos = length(run) QUALIFY row_number() OVER (PARTITION BY run ORDER BY round(score, 9) DESC, list_transform(path, lambda x: length(x)) DESC) = 1
UNION ALL SELECT run, [run] FROM texts WHERE run < '一'),
inner_ AS (SELECT run, list_transform(path, lambda x: list_append(list_filter(list_concat(CASE WHEN length(x) > 2 AND x >= '一' THEN list_transform(range(1, length(x)), lambda k: substr(x, k, 2)) ELSE [] END, CASE WHEN length(x) > 3 AND x >= '一' THEN list_transform(range(1, length(x) - 1), lambda k: substr(x, k, 3)) ELSE [] END), lambda y: list_contains({list(WORDS)}, y)), x)) AS l FROM best)
SELECT doc_id, array_to_string(flatten(list(flatten(l) ORDER BY no)), '|') AS words FROM runs JOIN inner_ USING (run) GROUP BY doc_id"""
)
def segment_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search-mode words of sentences made from all documents' ids, lengths and sources."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(segment.tokenizer(WORDS)(F.expr(SENTENCE)), "|").alias("words"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), "embedding")


VECTOR_SQL = "SELECT q.vec_id AS qid, v.vec_id AS id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q"


@query(f"WITH s AS ({VECTOR_SQL}) SELECT qid, id, round(score, 6) AS score, row_number() OVER w - 1 AS rank FROM s WINDOW w AS (PARTITION BY qid ORDER BY round(score, 9) DESC, id) QUALIFY row_number() OVER w <= 10")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    v = _vectors(spark, sf)
    return vector.search(v, v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding"), 10).withColumn("score", F.round("score", 6))


def _cells(spark: SparkSession, sf: str) -> ann.CellIndex:
    """A stored index of all vectors, written in two batches."""
    v = _vectors(spark, sf)
    index = ann.build(v.filter("id % 3 > 0"), scratch.folder(spark, "cells"), recall=None)
    index.add(v, "second")
    return index


@query(ORACLE_SQL["vector_search"])
def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """The stored index with all its cells probed: the rows of vector_search."""
    index = _cells(spark, sf)
    asked = _vectors(spark, sf).filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    return index.search(asked, 10, len(index.centres())).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether tuned probes find nine tenths of the exact hits of queries they were not tuned on."""
    index = _cells(spark, sf)
    index.tune(_vectors(spark, sf).filter("id % 50 > 0").select(F.col("id").alias("qid"), "embedding"))
    asked = _vectors(spark, sf).filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    return index.recall(asked).agg(F.count(F.lit(1)).alias("queries"), (F.sum("found") >= 0.9 * F.sum("wanted")).alias("reached"))


RANKED_SQL = """
WITH a AS (SELECT lang AS q, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents ),
b AS (SELECT lang AS q, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank FROM documents ),
l AS (SELECT q, 0 AS list_no, rank, key, {wa}::DOUBLE AS w FROM a UNION ALL SELECT q, 1, rank, key, {wb}::DOUBLE FROM b),
f AS (SELECT q AS qid, key::VARCHAR AS key, sum(w / (60 + rank + 1)) AS rrf, {pick}(list_no, row(list_no, rank))::VARCHAR AS payload, min(row(list_no, rank)) AS first FROM l GROUP BY ALL)
SELECT qid, key, round(rrf, 8) AS rrf, payload, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, first) AS rank FROM f
"""


def _ranked(spark: SparkSession, sf: str, wa: float, wb: float) -> DataFrame:
    docs = table(spark, sf, "documents")
    rank = lambda *order: (F.row_number().over(bm25.Window.partitionBy("lang").orderBy(*order)) - 1).alias("rank")
    out = None
    for no, (w, order) in enumerate(((wa, (F.desc("n_chars"), "doc_id")), (wb, ("doc_id",)))):
        hits = docs.select(F.col("lang").alias("qid"), F.col("doc_id").alias("id"), rank(*order))
        one = fusion.as_list(hits, no, f"list{no}", F.lit(str(no)), F.lit(w))
        out = one if out is None else out.unionByName(one)
    return out


@query(RANKED_SQL.format(wa=1.0, wb=1.0, pick="arg_min"))
def rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_ranked(spark, sf, 1.0, 1.0)).select("qid", "key", F.round("rrf", 8).alias("rrf"), "payload", "rank")


@query(RANKED_SQL.format(wa=2.0, wb=1.5, pick="arg_max"))
def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_ranked(spark, sf, 2.0, 1.5), last_payload=True).select("qid", "key", F.round("rrf", 8).alias("rrf"), "payload", "rank")


def _corpus(spark: SparkSession, sf: str) -> tuple[retrieval.Corpus, DataFrame]:
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("Window").alias("doc_type"), F.col("doc_id").alias("seq"))
    v = _vectors(spark, sf)
    questions = spark.createDataFrame([(k, f"{t} {s}") for (k, t), (_, s) in zip(QUESTIONS, SEARCHES, strict=True)], "qid long, text string").join(v.select(F.col("id").alias("qid"), "embedding"), "qid")
    return retrieval.Corpus(chunks, bm25.build_index(chunks.select("id", "text", "seq")), trade_graph(spark, sf), v), questions


@query("SELECT doc_id, 'emb_' || substr(md5(text), 1, 16) AS k, doc_id IN (SELECT doc_id FROM labels) OR text IN (SELECT text FROM documents JOIN labels USING (doc_id)) AS hit FROM documents")
def embed_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache keys, and whether the cache (the labelled documents) has them."""
    docs = table(spark, sf, "documents").select("doc_id", cache_key(F.col("text")).alias("k"))
    held = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("k").distinct().withColumn("hit", F.lit(True))
    return docs.join(held, "k", "left").select("doc_id", "k", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(FOLD + "SELECT 'chunk_' || substr(md5(doc_id || '::' || span_start || '::' || span_end), 1, 12) AS id, md5(substr(text, 1, 1500)) AS document_md5, doc_id, 'Window' AS doc_type, '' AS article_no, 'N/A' AS path, array_to_string(list_filter([" + THEME_SQL + "], lambda x: x IS NOT NULL), ',') AS themes FROM rows")
def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.vector_rows(windows(spark, sf)).select("id", F.md5("document").alias("document_md5"), "doc_id", "doc_type", "article_no", "path", "themes")


def word_counts(texts: list[str]) -> np.ndarray:
    """An encoder whose values SQL can give: characters, blanks and lines."""
    return np.array([[len(t), t.count(" "), t.count("\n")] for t in texts], np.float32).reshape(-1, 3)


@query(FOLD + "SELECT 'chunk_' || substr(md5(doc_id || '::' || span_start || '::' || span_end), 1, 12) AS id, doc_id, length(d)::BIGINT AS chars, (length(d) - length(replace(d, ' ', '')))::BIGINT AS blanks, (length(d) - length(replace(d, chr(10), '')))::BIGINT AS lines FROM (SELECT *, substr(text, 1, 1500) AS d FROM rows)")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """The vector index of all chunks, built in two runs over one cache."""
    path = scratch.folder(spark, "index")
    chunks = windows(spark, sf)
    for part in (chunks.filter("span_start = 0"), chunks):
        part.write.mode("overwrite").parquet(f"{path}/chunks")
        build.index_chunks(spark, f"{path}/chunks", f"{path}/vectors", word_counts, f"{path}/cache")
    counts = [F.col("embedding")[k].cast("long").alias(c) for k, c in enumerate(("chars", "blanks", "lines"))]
    return spark.read.parquet(f"{path}/vectors").select("id", "doc_id", *counts)


@query("SELECT doc_id, md5('[' || (doc_id % 5 + 1) || '] 来源: bm25,graph 类型: ' || lang || ' 评分: ' || printf('%.4f', 1.0::DOUBLE / (60 + doc_id % 5 + 1)) || chr(10) || substr(text, 1, 600)) AS block_md5 FROM documents")
def evidence_format(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id") % 5 + 1
    block = answer.context_block(n, F.array(F.lit("bm25"), F.lit("graph")), F.col("lang"), F.lit(1.0) / (n + 60), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(block).alias("block_md5"))


# ------------------------------------------------------------------ evaluation

SCORES_SQL = """
WITH i AS (SELECT doc_id AS id, lang AS type, string_split(lower(text), ' ') AS w, text FROM documents),
s AS (SELECT id, type, len(list_filter(['the', 'que', 'und', 'los'], lambda k: contains(lower(text), k))) / 4 AS answer_score,
  len(list_filter(['a', 'de', 'die'], lambda e: list_contains(w, e))) / 3 AS recall FROM i),
t AS (SELECT *, recall * 0.6e0 + answer_score * 0.4e0 AS total FROM s)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("type"),
        evaluate.keyword_score(F.col("text"), F.array(*[F.lit(w) for w in ("The", "que", "und", "los")])).alias("answer_score"),
        evaluate.evidence_score(F.split(F.lower("text"), " "), F.array(*[F.lit(w) for w in ("a", "de", "die")])).alias("recall"),
    )
    return evaluate.item_scores(items)


@query(SCORES_SQL + "SELECT id, round(answer_score, 6) AS answer_score, round(recall, 6) AS recall, round(total, 6) AS total, total >= 0.6 AS passed FROM t")
def eval_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("id", *[F.round(c, 6).alias(c) for c in ("answer_score", "recall", "total")], "passed")


@query(SCORES_SQL + "SELECT type, count(*) AS n, round(avg((recall >= 0.5)::INT), 6) AS recall_pass_rate, round(avg((answer_score >= 0.5)::INT), 6) AS answer_pass_rate, round(avg(recall), 6) AS avg_recall, round(avg(total), 6) AS avg_total FROM t GROUP BY ROLLUP(type)")
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rollup(_scored(spark, sf)).select("type", "n", *[F.round(c, 6).alias(c) for c in ("recall_pass_rate", "answer_pass_rate", "avg_recall", "avg_total")])


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
