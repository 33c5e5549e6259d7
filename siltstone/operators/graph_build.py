"""Nodes and edges from document metadata and from extractions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_contains, first_filled, importer_node_id, node_id, standard_id, strip
from .graph import EDGE, NODE, no_props, props

# Words of national authorities, labels that extractions may have.
NATIONAL = ["中华人民共和国", "生态环境部", "国家", "全国"]
ENTITY_LABELS = ["Pollutant", "PollutionSource", "Industry", "TreatmentTech", "Region", "Organization", "Case", "Violation", "Penalty", "Article", "Law", "Regulation", "Standard"]
IMPORTER_LABELS = ["Pollutant", "PollutionSource", "Industry", "TreatmentTech", "Region", "Organization", "Case", "Violation", "Penalty"]
PREFIXES = ("GB ", "HJ ", "DB ")


def classify(full_name: Column, std_id: Column, region_type: Column) -> Column:
    """Standard, Law or Regulation by id and name; null: neither."""
    prefixed = reduce(lambda a, b: a | b, [full_name.startswith(p) for p in PREFIXES])
    legal = full_name.contains("条例") | full_name.endswith("法") | full_name.contains("办法")
    return F.when((F.length(std_id) > 0) | prefixed, "Standard").when(legal & (region_type == "地方"), "Regulation").when(legal, "Law")


def _union(frames: list[DataFrame], names: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*names) for f in frames])


def _node(label: Column | str, id_: Column, values: Column, place: int) -> list[Column]:
    return [id_.alias("id"), (F.lit(label) if isinstance(label, str) else label).alias("label"), values.alias("props"), (F.col("seq") * 100 + place).alias("seq")]


def _edge(from_label: Column | str, from_id: Column, rel: Column | str, to_label: Column | str, to_id: Column, place: int, values: Column | None = None) -> list[Column]:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return [from_id.alias("from_id"), text(from_label).alias("from_label"), text(rel).alias("rel"), to_id.alias("to_id"), text(to_label).alias("to_label"), (values if values is not None else no_props()).alias("props"), (F.col("seq") * 100 + place).alias("seq")]


def from_metadata(meta: DataFrame, compat: bool = False, importer: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of metadata rows (seq and the fields of compliance_assessment).
    importer: the second generation's records: standard types by prefix, summaries
    whole, superseded documents without a node of their own."""
    nil = lambda c: F.coalesce(F.col(c), F.lit(""))
    make = importer_node_id if importer else node_id
    name = strip(first_filled(nil("full_name"), nil("target_file")))
    m = meta.select("seq", F.coalesce(name, F.lit("")).alias("name"), strip(nil("standard_id")).alias("std"), nil("region_type").alias("region_type"), strip(nil("region_name")).alias("region"), nil("standard_type").alias("std_type"), nil("effective_date").alias("date"), nil("summary").alias("summary"), "validity_status", "issuing_authority", "supersedes")
    m = m.withColumn("label", classify(F.col("name"), F.col("std"), F.col("region_type"))).filter((F.col("name") != "") & F.col("label").isNotNull())
    is_std = F.col("label") == "Standard"
    own = F.when(is_std, standard_id(F.coalesce(F.nullif("std", F.lit("")), "name"), compat)).otherwise(make(F.col("label"), F.col("name")))
    m = m.withColumn("own", own).withColumn("valid", F.when(F.col("validity_status"), "现行").otherwise("未知"))
    by_prefix = F.when(F.col("std").startswith("GB"), "GB").when(F.col("std").startswith("HJ"), "HJ").when(F.col("std").startswith("DB"), "DB").otherwise(F.col("std_type"))
    local = F.when(F.col("region_type") == "地方", "地方").otherwise("国家")
    std_props = props(std_id=F.col("std"), full_name=F.col("name"), std_type=by_prefix if importer else F.col("std_type"), validity_status=F.col("valid"), effective_date=F.col("date"))
    law_props = props(full_name=F.col("name"), level=local, region=F.col("region"), effective_date=F.col("date"), validity_status=F.col("valid"), summary=F.col("summary") if importer else F.left("summary", F.lit(500)))
    docs = m.select(*_node(F.col("label"), F.col("own"), F.when(is_std, std_props).otherwise(law_props), 0))
    orgs = m.select("seq", "label", "own", F.explode("issuing_authority").alias("o")).withColumn("o", strip(F.coalesce("o", F.lit("")))).filter("o != ''")
    org_id = make("Organization", F.col("o"))
    org_nodes = orgs.select(*_node("Organization", org_id, props(name_zh=F.col("o"), level=F.when(any_contains(F.col("o"), NATIONAL), "国家").otherwise("地方")), 1))
    regions = m.filter("region != ''")
    region_id = make("Region", F.col("region"))
    region_nodes = regions.select(*_node("Region", region_id, props(name_zh=F.col("region"), level=F.col("region_type")), 3))
    old = m.select("seq", "label", "own", F.explode("supersedes").alias("s")).select("seq", "label", "own", strip(F.coalesce("s.name", F.lit(""))).alias("s"), F.col("s.supersedes_time").alias("t")).filter("s != ''")
    old_id = make("Document", F.col("s"))
    nodes = [docs, org_nodes, region_nodes] + ([] if importer else [old.select(*_node("Document", old_id, props(name=F.col("s")), 5))])
    edges = [
        orgs.select(*_edge(F.col("label"), F.col("own"), "ISSUED_BY", "Organization", org_id, 2)),
        regions.select(*_edge(F.col("label"), F.col("own"), "APPLIES_TO_REGION", "Region", region_id, 4)),
        old.select(*_edge(F.col("label"), F.col("own"), "SUPERSEDES", "Document", old_id, 6, props(effective_date=F.col("t")))),
    ]
    return _union(nodes, NODE), _union(edges, EDGE)


def _usable(ext: DataFrame) -> DataFrame:
    return ext.filter(F.coalesce("error", F.lit("")) == "").filter(F.coalesce("doc_id", F.lit("")) != "")


def _entities(ext: DataFrame, labels: list[str]) -> DataFrame:
    """(seq, label, name, e): entities with a name, of the given labels."""
    per = ext.select("seq", F.explode("extraction.entities").alias("label", "list")).filter(F.col("label").isin(labels))
    one = per.select("seq", "label", F.explode("list").alias("e"))
    return one.withColumn("name", first_filled(F.try_element_at("e", F.lit("name")), F.try_element_at("e", F.lit("title")))).filter("name is not null")


def _relations(ext: DataFrame, make) -> DataFrame:
    """Edges of the extracted relationships: articles by number, all else by name."""
    r = ext.select("seq", "doc_id", F.explode("extraction.relationships").alias("r")).select("seq", "doc_id", "r.*")
    nil = lambda c: F.coalesce(F.col(c), F.lit(""))
    from_id = F.when((nil("from_type") == "Article") & (nil("from_id") != ""), make("Article", F.concat_ws("_", "doc_id", "from_id"))).when((nil("from_type") != "") & (nil("from_type") != "Article") & (nil("from_name") != ""), make(F.col("from_type"), F.col("from_name")))
    ok = r.filter((nil("rel") != "") & (nil("to_type") != "") & (nil("to_name") != "")).withColumn("fid", from_id).filter("fid is not null")
    return ok.select(*_edge(F.col("from_type"), F.col("fid"), F.col("rel"), F.col("to_type"), make(F.col("to_type"), F.col("to_name")), 90, F.coalesce("props", no_props())))


def from_extractions(ext: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extraction records (seq, doc_id, error, article_no,
    text_preview, extraction), each record's article hanging on its document."""
    ext = _usable(ext)
    art = ext.filter(F.coalesce("article_no", F.lit("")) != "")
    article, doc = node_id("Article", F.concat_ws("_", "doc_id", "article_no")), node_id("Document", F.col("doc_id"))
    ents = _entities(ext, ENTITY_LABELS)
    more = F.transform_values(F.map_filter("e", lambda k, v: ~k.isin("name", "title") & v.isNotNull() & (v != "")), lambda _, v: F.left(v, F.lit(200)))
    nodes = [
        art.select(*_node("Article", article, props(article_no=F.col("article_no"), parent_doc=F.left("doc_id", F.lit(200)), text_preview=F.left("text_preview", F.lit(500))), 0)),
        art.select(*_node("Document", doc, props(name=F.left("doc_id", F.lit(200))), 1)),
        ents.select(*_node(F.col("label"), node_id(F.col("label"), F.col("name")), F.map_concat(F.create_map(F.lit("name_zh"), F.left("name", F.lit(100))), F.map_filter(more, lambda k, _: k != "name_zh")), 2)),
    ]
    edges = [art.select(*_edge("Document", doc, "CONTAINS_ARTICLE", "Article", article, 3)), _relations(ext, node_id)]
    return _union(nodes, NODE), _union(edges, EDGE)


def importer_records(ext: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second generation: articles from the extraction itself, under the law,
    regulation or standard that doc_meta names; else under the document."""
    ext = _usable(ext)
    a = ext.select("seq", "doc_id", "doc_meta", F.explode("extraction.articles").alias("a")).withColumn("no", strip(F.coalesce("a.article_no", F.lit("")))).filter("no != ''")
    article = importer_node_id("Article", F.concat_ws("_", "doc_id", "no"))
    content = F.coalesce("a.content", F.lit(""))
    values = props(article_no=F.col("no"), content=F.left(content, F.lit(5000)), content_hash=F.md5(content), themes=F.array_join("a.themes", ","), obligations=F.array_join("a.obligations", ","), penalty=F.left("a.penalty_text", F.lit(1000)), parent_doc=F.col("doc_id"))
    name, std, region = (F.coalesce(F.col(f"doc_meta.{c}"), F.lit("")) for c in ("full_name", "standard_id", "region_type"))
    label = F.when(std != "", "Standard").when(name != "", F.coalesce(classify(name, std, region), F.lit("Standard"))).otherwise("Document")
    parent = F.when(std != "", standard_id(std)).when(name != "", importer_node_id(label, name)).otherwise(importer_node_id("Document", F.col("doc_id")))
    ents = _entities(ext, IMPORTER_LABELS)
    nodes = [
        a.select(*_node("Article", article, values, 0)),
        a.filter(label == "Document").select(*_node("Document", parent, props(name=F.left("doc_id", F.lit(200))), 1)),
        ents.select(*_node(F.col("label"), importer_node_id(F.col("label"), F.col("name")), F.map_concat(F.create_map(F.lit("name_zh"), F.col("name")), F.map_filter("e", lambda k, v: ~k.isin("name", "title", "name_zh") & v.isNotNull() & (v != ""))), 2)),
    ]
    edges = [a.select(*_edge(label, parent, "CONTAINS_ARTICLE", "Article", article, 3)), _relations(ext, importer_node_id)]
    return _union(nodes, NODE), _union(edges, EDGE)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _values(column: str) -> Column:
    """A map as the inside of a statement's braces, null and empty values left out."""
    held = F.filter(F.array_sort(F.map_entries(column)), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(held, lambda e: F.concat(e["key"], F.lit(": "), _quoted(e["value"]))), ", ")


def cypher_nodes(nodes: DataFrame, keys: dict[str, str]) -> DataFrame:
    """MERGE statements of nodes, null and empty properties left out."""
    key = F.coalesce(F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])[F.col("label")], F.lit("id"))
    return nodes.select(F.concat(F.lit("MERGE (n:"), F.col("label"), F.lit(" {"), key, F.lit(": "), _quoted(F.col("id")), F.lit("}) SET n += {"), _values("props"), F.lit("};")).alias("statement"))


def cypher_edges(edges: DataFrame, keys: dict[str, str]) -> DataFrame:
    """MERGE statements of edges, with their properties if they have some."""
    table = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    key = lambda label: F.coalesce(table[F.col(label)], F.lit("id"))
    end = lambda v, label, id_: F.concat(F.lit(f"({v}:"), F.col(label), F.lit(" {"), key(label), F.lit(": "), _quoted(F.col(id_)), F.lit("})"))
    values = F.coalesce(_values("props"), F.lit(""))
    set_ = F.when(values != "", F.concat(F.lit(" SET r += {"), values, F.lit("}"))).otherwise("")
    return edges.select(F.concat(F.lit("MATCH "), end("a", "from_label", "from_id"), F.lit(", "), end("b", "to_label", "to_id"), F.lit(" MERGE (a)-[r:"), F.col("rel"), F.lit("]->(b)"), set_, F.lit(";")).alias("statement"))


def constraints(keys: dict[str, str]) -> list[str]:
    unique = [f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{label}) REQUIRE n.{key} IS UNIQUE" for label, key in keys.items()]
    return unique + [f"CREATE INDEX IF NOT EXISTS FOR (n:{label}) ON (n.{field})" for label, field in (("Pollutant", "name_zh"), ("Industry", "name_zh"), ("Region", "name_zh"), ("Article", "parent_doc"))]
