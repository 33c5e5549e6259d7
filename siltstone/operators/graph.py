"""The property graph: nodes (id, label, props, seq) and edges (from_id, from_label, rel,
to_id, to_label, props, seq). seq is the order of ingestion."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .ranking import direct, small, top
from .substrings import containing

NODE = ["id", "label", "props", "seq"]
EDGE = ["from_id", "from_label", "rel", "to_id", "to_label", "props", "seq"]
PROPS = "map<string,string>"
#: Up to so many nodes are looked up by their ids in the plan; more are joined.
NAMED_NODES = 1000

# The ontology's labels, relationships (from, to) and identifying fields.
NODE_KEYS = {
    "Law": "law_id", "Regulation": "reg_id", "Standard": "std_id", "Article": "article_id", "Pollutant": "poll_id", "PollutionSource": "src_id", "Industry": "ind_id", "TreatmentTech": "tech_id", "Region": "region_id",
    "Organization": "org_id", "Case": "case_id", "Violation": "vio_id", "Penalty": "pen_id", "Enterprise": "ent_id", "Interpretation": "interp_id", "Notice": "notice_id", "Chunk": "chunk_id",
}
RELATIONSHIPS = [
    "ISSUED_BY", "APPLIES_TO_REGION", "APPLIES_TO_INDUSTRY", "EFFECTIVE_ON", "SUPERSEDES", "AMENDS", "REFERENCES", "CONTAINS_ARTICLE", "ARTICLE_REGULATES", "ARTICLE_DEFINES_PENALTY", "ARTICLE_DEFINES_VIOLATION",
    "SOURCE_EMITS_POLLUTANT", "INDUSTRY_USES_TECH", "TECH_TREATS_POLLUTANT", "STANDARD_LIMITS_POLLUTANT", "CASE_VIOLATES_ARTICLE", "CASE_INVOLVES_VIOLATION", "CASE_AT_REGION", "CASE_AT_ENTERPRISE", "CASE_TRIGGERS_PENALTY",
    "SIMILAR_TO", "INTERPRETS", "MENTIONED_IN_CHUNK", "RELATED_TO",
]
SEARCH_FIELDS = ("name_zh", "full_name", "summary", "title")


def props(**columns: Column | str) -> Column:
    """A map of the given values that are neither null nor empty."""
    pairs = [x for k, v in columns.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != "")).cast(PROPS)


def no_props() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One node for each id: the first label stands, later properties overwrite by key.
    A merge by key, with partial aggregation, so that a hot id is never one list."""
    heads = rows.groupBy("id").agg(F.min_by("label", "seq").alias("label"), F.min("seq").alias("seq"))
    entries = rows.select("id", "seq", F.explode("props").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    merged = entries.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return heads.join(merged, "id", "left").select("id", "label", F.coalesce("props", no_props()).alias("props"), "seq")


def checked_edges(edges: DataFrame, nodes: DataFrame, in_order: bool = False) -> DataFrame:
    """Edges of which both ends exist; in_order: existed before the edge came. Parallel
    edges all stay."""
    ends = nodes.select("id", F.col("seq").alias("_s"))
    for side in ("from_id", "to_id"):
        end = ends.select(F.col("id").alias(side), "_s")
        edges = edges.join(end, side).filter(F.col("_s") < F.col("seq")).drop("_s") if in_order else edges.join(end.drop("_s"), side, "left_semi")
    return edges.select(*EDGE)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, rel, to), properties of the last."""
    last = edges.groupBy("from_id", "rel", "to_id").agg(F.max_by(F.struct("from_label", "to_label", "props"), "seq").alias("e"), F.min("seq").alias("seq"))
    return last.select("from_id", "e.from_label", "rel", "to_id", "e.to_label", "e.props", "seq")


def keep_first(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The earliest row of each key."""
    order = Window.partitionBy(*keys).orderBy(seq)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): totals and counts by label and relationship; null name: total."""
    count = lambda df, c, kind: df.rollup(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
    return count(nodes, "label", "node").unionByName(count(edges, "rel", "edge"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, n, added) of two stats(): the counts after, and what came since before."""
    old = before.select("kind", F.col("name").alias("_name"), F.col("n").alias("_n")).withColumnRenamed("kind", "_kind")
    joined = after.join(old, (F.col("kind") == F.col("_kind")) & F.col("name").eqNullSafe(F.col("_name")), "left")
    return joined.select("kind", "name", "n", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("added"))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """Violations of uniqueness: (label, id, n)."""
    return nodes.groupBy("label", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # -------------------------------------------------------- pattern pieces

    def match(self, labels: str | list[str], where: Column | None = None, name: str = "n") -> DataFrame:
        """Nodes of the labels as one struct column `name`; where refers to id and props."""
        labels = [labels] if isinstance(labels, str) else labels
        found = self.nodes.filter(F.col("label").isin(labels))
        found = found.filter(where) if where is not None else found
        return found.select(F.struct(*NODE).alias(name))

    def expand(self, rows: DataFrame, at: str, rels: list[str], name: str, labels: list[str] | None = None, direction: str = "out", optional: bool = False) -> DataFrame:
        """Follow relationships from the node column `at` to a new one, `name`; optional
        keeps rows without any (a left join)."""
        e = self.edges.filter(F.col("rel").isin(rels)).select("from_id", "to_id", "rel")
        ways = {"out": [("from_id", "to_id")], "in": [("to_id", "from_id")], "both": [("from_id", "to_id"), ("to_id", "from_id")]}[direction]
        hops = reduce(DataFrame.unionByName, [e.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col("rel").alias(f"{name}_rel")) for a, b in ways])
        ends = self.nodes.filter(F.col("label").isin(labels)) if labels else self.nodes
        ends = ends.select(F.col("id").alias("_b"), F.struct(*NODE).alias(name))
        if not optional:  # the rows' own edges first, then their ends
            return rows.join(hops, F.col(f"{at}.id") == F.col("_a")).join(ends, "_b").drop("_a", "_b")
        starts = rows.select(F.col(f"{at}.id").alias("_a")).distinct()
        hops = hops.join(starts, "_a", "left_semi").join(ends, "_b").drop("_b")
        return rows.join(hops, F.col(f"{at}.id") == F.col("_a"), "left").drop("_a")

    def with_nodes(self, found: DataFrame, labels: list[str] | None = None) -> DataFrame:
        """found (id, seq, ...), few rows that are stored, with label and props of their nodes.
        Up to NAMED_NODES ids are put into the plan: properties of other nodes are not made."""
        nodes = self.nodes.filter(F.col("label").isin(labels)) if labels else self.nodes
        ids = [r["id"] for r in found.select("id").distinct().limit(NAMED_NODES + 1).collect()]
        nodes = nodes.filter(F.col("id").isin(ids)) if len(ids) <= NAMED_NODES else nodes
        return small(found).join(nodes.select("id", "label", "props", F.col("seq").alias("_seq")), "id").filter(F.col("seq").eqNullSafe(F.col("_seq"))).drop("_seq")

    # --------------------------------------------------------- whole queries

    def one_hop(self, from_label: str, rel: str, to_label: str | None = None, field: str | None = None, value: str | None = None, limit: int = 50) -> DataFrame:
        """(n, rel, m): outgoing edges of a label, by an optional property of the start."""
        where = F.col("props")[field] == value if field else None
        out = self.expand(self.match(from_label, where), "n", [rel], "m", [to_label] if to_label else None)
        return out.orderBy("n.seq", "m.seq", "n.id", "m.id").limit(limit)

    def _fields(self, fields: tuple[str, ...], article_field: str | None = None) -> DataFrame:
        """(id, label, seq, place, value): the filled fields of each node, in order; the last
        one, article_field, of articles only."""
        held = [F.struct(F.lit(k).alias("place"), F.col("props")[f].alias("value")) for k, f in enumerate(fields)]
        if article_field is not None:
            held.append(F.struct(F.lit(len(fields)).alias("place"), F.when(F.col("label") == "Article", F.col("props")[article_field]).alias("value")))
        rows = self.nodes.select("id", "label", "seq", F.explode(F.array(*held)).alias("f"))
        return rows.select("id", "label", "seq", "f.place", "f.value").filter(F.length("value") > 0)

    def text_search(self, queries: DataFrame, top_k: int = 10, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
        """(qid, id, label, score, rank from 0) for queries (qid, text). Keywords are the
        words of two characters or more (else the whole text), and every CJK character.
        The first field in which any keyword occurs, or that occurs in the query, scores.
        Questions of any number meet the values of fields in substring joins, by character
        pairs; a few are put into the plan instead, for one pass over the nodes."""
        words = F.filter(F.split("text", r"[\s,，。；;、]+"), lambda x: F.length(x) >= 2)
        words = F.when(F.size(words) > 0, words).otherwise(F.array("text"))
        single = F.filter(F.split("text", ""), lambda x: x.rlike("^[一-鿿]$"))
        asked = queries.select("qid", F.col("text").alias("q"), F.concat(words, single).alias("kws"))
        order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "seq", "id")

        def value_score(v: Column) -> Column:
            size, whole = F.length(v).cast("double"), F.greatest(F.length("q"), F.lit(1)).cast("double")
            part = lambda kw: F.when(v.contains(kw), F.length(kw) / size * (1 + 0.1 * F.length(kw))).when(F.col("q").contains(v) & (size >= 2), 0.5 * size / whole).otherwise(0.0)
            score = F.aggregate("kws", F.lit(0.0), lambda s, kw: s + part(kw))
            return F.when((F.length(v) > 0) & (score > 0), score)

        if (batch := direct(asked)) is not None:
            rows = self.nodes.select("id", "label", "seq", "props", F.explode(batch).alias("a")).select("id", "label", "seq", "props", "a.*")
            first = rows.select("qid", "id", "label", "seq", F.coalesce(*[value_score(F.col("props")[f]) for f in fields]).alias("score")).filter("score > 0")
            return top(first, order, top_k).select("qid", "id", "label", "score", "rank")
        named = self._fields(fields)
        values = named.select("value").distinct()
        by_word = containing(asked.select(F.explode("kws").alias("word")), values.withColumnRenamed("value", "text"), "words").withColumnRenamed("text", "value")
        by_word = asked.select("qid", F.explode(F.array_distinct("kws")).alias("word")).join(by_word, "word").select("qid", "value")
        inside = containing(values.filter(F.length("value") >= 2).withColumnRenamed("value", "word"), asked.select(F.col("q").alias("text")), "texts")
        by_text = asked.select("qid", F.col("q").alias("text")).join(inside, "text").select("qid", F.col("word").alias("value"))
        pairs = by_word.unionByName(by_text).distinct().join(asked, "qid")

        scored = pairs.select("qid", "value", value_score(F.col("value")).alias("score")).filter("score > 0")
        first = scored.join(named, "value").groupBy("qid", "id", "label", "seq").agg(F.min_by("score", "place").alias("score"))
        return top(first, order, top_k).select("qid", "id", "label", "score", "rank")

    def substrings(self, queries: DataFrame, fields: tuple[str, ...] = ("name_zh", "full_name"), article_field: str = "content", limit: int = 10) -> DataFrame:
        """(qid, id, label, props, seq, rank from 0): substring() for queries (qid, text). The
        empty text is in every name: it finds the first nodes that have one."""
        order = Window.partitionBy("qid").orderBy("seq", "id")
        if (batch := direct(queries.select("qid", F.col("text").alias("q")))) is not None:
            rows = self.nodes.select(*NODE, F.explode(batch).alias("a")).select(*NODE, "a.*")
            has = [F.coalesce(F.contains(F.col("props")[f], F.col("q")), F.lit(False)) for f in (*fields, article_field)]
            hit = reduce(lambda a, b: a | b, [*has[:-1], (F.col("label") == "Article") & has[-1]])
            return top(rows.filter(hit), order, limit).select("qid", "id", "label", "props", "seq", "rank")
        named = self._fields(fields, article_field)
        texts = queries.select("qid", F.col("text").alias("word"))
        hits = texts.join(containing(texts, named.select(F.col("value").alias("text")), "words"), "word").select("qid", F.col("text").alias("value"))
        found = top(hits.join(named, "value").select("qid", "id", "seq").distinct(), order, limit)
        any_name = reduce(lambda a, b: a | b, [F.col("props")[f].isNotNull() for f in fields]) | ((F.col("label") == "Article") & F.col("props")[article_field].isNotNull())
        first = self.nodes.filter(any_name).select("id", "seq").orderBy("seq", "id").limit(limit).withColumn("rank", (F.row_number().over(Window.orderBy("seq", "id")) - 1).cast("long"))
        blank = queries.filter("text = ''").select("qid", F.explode(F.sequence(F.lit(0), F.lit(limit - 1)).cast("array<bigint>")).alias("rank"))
        both = found.unionByName(blank.join(first, "rank").select("qid", "id", "seq", "rank"))
        return both.join(self.nodes, ["id", "seq"]).select("qid", "id", "label", "props", "seq", "rank")

    def by_label(self, statement: str, limit: int = 20) -> DataFrame:
        """Nodes of the label that a statement `(n:Label ...) RETURN n.x AS y` names, with its
        aliases; none if it names no label as n. Conditions are not read."""
        label = re.search(r"\(n:(\w+)", statement)
        aliases = [F.col("props")[a].alias(b) for a, b in re.findall(r"n\.(\w+)\s+AS\s+(\w+)", statement)]
        return self.nodes.filter(F.col("label") == (label[1] if label else "")).orderBy("seq", "id").limit(limit).select("id", "label", "props", *aliases)

    def substring(self, text: str, fields: tuple[str, ...] = ("name_zh", "full_name"), article_field: str = "content", limit: int = 10) -> DataFrame:
        """Nodes with the text in a name, or articles with it in their content."""
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.col("props")[f].contains(text), F.lit(False)) for f in fields])
        hit |= (F.col("label") == "Article") & F.coalesce(F.col("props")[article_field].contains(text), F.lit(False))
        return self.nodes.filter(hit).orderBy("seq", "id").limit(limit)

    def centre(self, keyword: str, fields: tuple[str, ...] = SEARCH_FIELDS) -> DataFrame:
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.col("props")[f].contains(keyword), F.lit(False)) for f in fields])
        return self.nodes.filter(hit).orderBy("seq", "id").limit(1)

    def hops(self, path: str) -> str:
        """The name of a table (id, to_id) of the distinct edges, stored at path in buckets
        of from_id: what follows edges shuffles its starts only."""
        spark, name = self.edges.sparkSession, f"hops_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ends = self.edges.select(F.col("from_id").alias("id"), "to_id").distinct().repartition(buckets, "id")
        ends.write.bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
        return name

    def khop(self, start: DataFrame, depth: int = 2, hops: str | None = None) -> DataFrame:
        """(id, depth) within `depth` outgoing steps of start (id). Each step follows the new
        nodes only, which are a stored table, so that the plan of a step does not grow with
        the steps before; it ends where a step finds none. hops: a table of hops(), for more
        searches than one."""
        spark = start.sparkSession
        base = scratch.folder(spark, "khop")
        name = hops or self.hops(f"{base}/hops")
        kind = f"id {start.schema['id'].dataType.simpleString()}, depth int"
        read = lambda: spark.read.schema(kind).option("basePath", f"{base}/seen")
        start.select("id").distinct().write.parquet(f"{base}/seen/depth=0")
        for d in range(1, depth + 1):
            front, seen = read().parquet(f"{base}/seen/depth={d - 1}"), read().parquet(f"{base}/seen")
            step = front.select("id").join(spark.table(name), "id").select(F.col("to_id").alias("id")).distinct()
            step.join(seen.select("id"), "id", "left_anti").write.parquet(f"{base}/seen/depth={d}")
            if not read().parquet(f"{base}/seen/depth={d}").head(1):
                break
        if hops is None:
            spark.sql(f"DROP TABLE {name}")
            scratch.remove(spark, f"{base}/hops")
        return read().parquet(f"{base}/seen")

    def induced(self, ids: DataFrame) -> DataFrame:
        """Edges with both ends among ids."""
        one = ids.select("id").distinct()
        return self.edges.join(one.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(one.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*EDGE)

    def sample(self, max_nodes: int = 200, groups: int = 8) -> DataFrame:
        """The first max_nodes // groups nodes of each label, max_nodes at most."""
        order = Window.partitionBy("label").orderBy("seq", "id")
        first = self.nodes.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_nodes // groups).drop("_n")
        return first.orderBy("seq", "id").limit(max_nodes)

