"""Chunkers: by article, by chapter, by window of paragraphs, and the dispatch between
them. Spans are code points of the normalised text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARTICLE_MARK, HEADING_MARK, MARK, any_contains, chunk_id, first_filled, normalize_space, strip

# Themes of an article and the words that show them.
THEMES = {
    "超标排放": ["超标", "超过排放标准", "超过限值"],
    "危险废物": ["危险废物", "危废", "HW"],
    "排污许可": ["排污许可证", "排污许可", "无证排污"],
    "监测数据": ["监测数据", "在线监测", "自动监测", "虚假数据", "伪造"],
    "处罚": ["罚款", "拘留", "停产", "吊销", "责令改正"],
    "刑事责任": ["刑事责任", "刑事处罚", "构成犯罪"],
    "环评": ["环境影响评价", "环评", "未批先建"],
    "应急预案": ["突发环境事件", "应急预案"],
}
PARAGRAPH = r"(?U)\n\s*\n"
#: Chunks that leave a task in one batch, or those of one document.
OUT_ROWS = 1000
#: Between the paragraphs of a chunk.
GAP = "\n\n"


def themes(c: Column, table: dict[str, list[str]] | None = None) -> Column:
    """The themes of which a word occurs, in the table's order."""
    table = THEMES if table is None else table
    return F.filter(F.array(*[F.when(any_contains(c, words), F.lit(name)) for name, words in table.items()]), lambda x: x.isNotNull())


# The words and patterns of the next two rules.

def detect_doc_type(text: Column, full_name: Column, target_file: Column) -> Column:
    """From the name in the metadata, else an article line near the top, else words of
    standards at the top."""
    name = first_filled(full_name, target_file)
    return (
        F.when(name.contains("条例") | name.endswith("法"), "LawOrRegulation")
        .when(name.startswith("GB ") | name.startswith("HJ ") | name.startswith("DB "), "Standard")
        .when(F.left(text, F.lit(3000)).rlike(r"(?m)^[^\n]*第[一二三四五六七八九十]+条[^\n]{0,3}$"), "LawOrRegulation")
        .when(any_contains(F.left(text, F.lit(200)), ["标准", "限值", "mg/m³"]), "Standard")
        .otherwise("Other")
    )


def source_doc_type(path: Column, standard_id: Column) -> Column:
    return F.when(path.contains("案例"), "Case").when(F.length(standard_id) > 0, "Standard").otherwise("LawOrRegulation")


def normalized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), normalize_space(F.coalesce("text", F.lit(""))).alias("text"))


def sections(docs: DataFrame, mark: str) -> DataFrame:
    """(doc_id, i, start, piece): the text cut before each match of `mark`, whose group 1
    is the match; piece 0 is what comes before the first."""
    cut = F.split(F.regexp_replace("text", mark, MARK + "$1"), MARK)
    pieces = docs.select("doc_id", F.posexplode(cut).alias("i", "piece"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))


def _finish(rows: DataFrame, kind: str, table: dict[str, list[str]] | None) -> DataFrame:
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("start"), F.col("end")).alias("chunk_id"), "doc_id", F.lit(kind).alias("doc_type"),
        F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "text",
        "structure_path", "article_no", themes(F.col("text"), table).alias("themes"),
    )


def by_article(docs: DataFrame, mark: str = ARTICLE_MARK, heading: str = HEADING_MARK, min_len: int = 20, theme_table: dict[str, list[str]] | None = None) -> DataFrame:
    """A chunk from each article mark to the next; its chapter is the latest heading at or
    before it (a backward as-of join, by one ordered window)."""
    parts = sections(docs, mark).filter("i > 0")
    heads = sections(docs, heading).filter("i > 0").select("doc_id", "start", strip(F.regexp_extract("piece", heading.replace("^", r"\A"), 1)).alias("chapter"))
    events = parts.select("doc_id", "start", F.lit(1).alias("kind"), "piece", F.lit(None).cast("string").alias("chapter")).unionByName(heads.select("doc_id", "start", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("piece"), "chapter"))
    upto = Window.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = events.withColumn("chapter", F.coalesce(F.last("chapter", ignorenulls=True).over(upto), F.lit(""))).filter("kind = 1")
    number = F.regexp_extract("piece", mark, 1)
    rows = placed.select("doc_id", "start", (F.col("start") + F.length("piece")).alias("end"), strip(F.col("piece")).alias("text"), F.array("chapter", number).alias("structure_path"), number.alias("article_no"))
    return _finish(rows.filter(F.length("text") >= min_len), "Article", theme_table)


def by_chapter(docs: DataFrame, heading: str = HEADING_MARK, min_len: int = 500, theme_table: dict[str, list[str]] | None = None) -> DataFrame:
    """A chunk from each heading to the next, in texts with two headings at least."""
    parts = sections(docs, heading).filter("i > 0").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    head = heading.replace("^", r"\A")
    title = F.regexp_extract("piece", head + r"[\s　]*([^\n]{0,40})", 2)
    path = F.concat(strip(F.regexp_extract("piece", head, 1)), F.lit(" "), strip(title))
    rows = parts.filter("n >= 2").select("doc_id", "start", (F.col("start") + F.length("piece")).alias("end"), strip(F.col("piece")).alias("text"), F.array(path).alias("structure_path"), F.lit(None).cast("string").alias("article_no"))
    return _finish(rows.filter(F.length("text") >= min_len), "Chapter", theme_table)


def packed_windows(paragraphs: Iterable[str], window: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, text): paragraphs packed up to `window` characters; the next chunk begins with
    the longest run of whole last paragraphs within `overlap`. Each paragraph enters and
    leaves the carried run once."""
    run, size, at = deque(), 0, 0
    for p in paragraphs:
        if run and size + len(p) > window:
            yield at, (text := GAP.join(run))
            while size > overlap:
                size -= len(run.popleft())
            at += len(text) - size
        run.append(p)
        size += len(p)
    if run:
        yield at, GAP.join(run)


def by_window(docs: DataFrame, window: int = 800, overlap: int = 150, separator: str = PARAGRAPH, theme_table: dict[str, list[str]] | None = None) -> DataFrame:
    paragraphs = F.filter(F.transform(F.split("text", separator), strip), lambda x: x != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.string(), "start": pa.int64(), "text": pa.string()}
        for batch in batches:
            out: list[tuple[str, int, str]] = []
            for doc, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += [(doc, *c) for c in packed_windows(held.as_py(), window, overlap)]
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    rows = docs.select("doc_id", paragraphs.alias("p")).mapInArrow(run, "doc_id string, start bigint, text string")
    rows = rows.select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"), "text", F.array(F.lit("N/A")).alias("structure_path"), F.lit(None).cast("string").alias("article_no"))
    return _finish(rows, "Window", theme_table)


def chunk_documents(docs: DataFrame, window: int = 800, overlap: int = 150, separator: str = PARAGRAPH, mark: str = ARTICLE_MARK, heading: str = HEADING_MARK, theme_table: dict[str, list[str]] | None = None) -> DataFrame:
    """Articles if a text gives three chunks of them; else chapters if it is over 5000
    characters and gives two; else windows."""
    docs = normalized(docs)
    articles = by_article(docs, mark, heading, theme_table=theme_table)
    has_articles = articles.groupBy("doc_id").count().filter("count >= 3").select("doc_id")
    chapters = by_chapter(docs.filter(F.length("text") > 5000), heading, theme_table=theme_table).join(has_articles, "doc_id", "left_anti")
    has_chapters = chapters.groupBy("doc_id").count().filter("count >= 2").select("doc_id")
    rest = docs.join(has_articles, "doc_id", "left_anti").join(has_chapters, "doc_id", "left_anti")
    return articles.join(has_articles, "doc_id", "left_semi").unionByName(chapters.join(has_chapters, "doc_id", "left_semi")).unionByName(by_window(rest, window, overlap, separator, theme_table))


def enrich(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with doc_metadata and source_path of their documents."""
    return chunks.join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "doc_metadata", "source_path"), "doc_id", "left")


def vector_rows(chunks: DataFrame) -> DataFrame:
    """What a vector index stores of a chunk."""
    path = F.left(F.array_join("structure_path", " > "), F.lit(300))
    return chunks.select(
        F.col("chunk_id").alias("id"), F.left("text", F.lit(1500)).alias("document"), F.left("doc_id", F.lit(200)).alias("doc_id"), F.coalesce("doc_type", F.lit("")).alias("doc_type"),
        F.coalesce("article_no", F.lit("")).alias("article_no"), path.alias("path"), F.array_join("themes", ",").alias("themes"),
    )
