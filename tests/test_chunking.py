import random
import re
import time

from pyspark.sql import functions as F

from siltstone.operators import chunking


def fold(text, window=800, overlap=150):
    """The window rule, paragraph by paragraph."""
    out, held, at = [], [], 0
    for p in [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]:
        if held and sum(map(len, held)) + len(p) > window:
            out.append((at, "\n\n".join(held)))
            rest = list(held)
            while sum(map(len, rest)) > overlap:
                rest = rest[1:]
            at += len(out[-1][1]) - sum(map(len, rest))
            held = rest
        held.append(p)
    return out + ([(at, "\n\n".join(held))] if held else [])


def test_windows_follow_the_rule(spark):
    rng = random.Random(1)
    texts = ["\n\n".join("字" * rng.choice([5, 40, 120, 151, 149, 300, 900]) + str(k) for k in range(rng.randint(0, 12))) for _ in range(40)] + ["", "  \n \n ", "a\n　\nb"]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string")
    got = {}
    for r in chunking.by_window(docs).orderBy("span_start").collect():
        got.setdefault(r["doc_id"], []).append((r["span_start"], r["text"]))
        assert r["span_end"] - r["span_start"] == len(r["text"]) and r["structure_path"] == ["N/A"]
    assert {str(k): sorted(fold(t)) for k, t in enumerate(texts) if fold(t)} == {k: sorted(v) for k, v in got.items()}


def test_long_texts_take_linear_time():
    text = ["p" * 9] * 1_000_000
    began = time.perf_counter()
    n = sum(1 for _ in chunking.packed_windows(text, 800, 150))
    assert n > 10_000 and time.perf_counter() - began < 10


def law(chapters, articles, size):
    parts = ["前言。"]
    n = 0
    for c in range(chapters):
        parts.append(f"第{'一二三四五六七八九'[c]}章 标题{c}")
        for _ in range(articles):
            n += 1
            parts.append(f"第{n}条 " + "内容" * size)
    return "\n".join(parts)


def test_articles_have_the_latest_chapter_and_true_spans(spark):
    text = law(2, 2, 15).replace("\n", "\r\n") + "\r\n依照第9条第一款的规定处理，短"
    rows = chunking.chunk_documents(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("span_start").collect()
    clean = text.replace("\r\n", "\n")
    assert [r["article_no"] for r in rows] == ["第1条", "第2条", "第3条", "第4条"]  # the last, short one is dropped
    assert [r["structure_path"][0] for r in rows] == ["第一章", "第一章", "第二章", "第二章"]
    for r in rows:
        assert clean[r["span_start"] : r["span_end"]].strip() == r["text"] and r["doc_type"] == "Article"


def test_dispatch(spark):
    docs = [("articles", law(1, 3, 20)), ("chapters", law(2, 1, 1500)), ("short", law(2, 1, 300)), ("plain", "一段文字。\n\n又一段。")]
    rows = chunking.chunk_documents(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["doc_type"] for r in rows} == {"articles": "Article", "chapters": "Chapter", "short": "Window", "plain": "Window"}
    assert sorted(r["structure_path"][0] for r in rows if r["doc_type"] == "Chapter") == ["第一章 标题0", "第二章 标题1"]


def test_themes_and_types(spark):
    row = spark.createDataFrame([("违法超标，责令改正并处罚款", "某某条例", "")], "t string, n string, f string")
    assert row.select(chunking.themes(F.col("t"))).first()[0] == ["超标排放", "处罚"]
    kinds = [("x", "大气法", None, "LawOrRegulation"), ("x", None, "GB 1-2", "Standard"), ("前\n总则 第三条\n", "", "", "LawOrRegulation"), ("本标准规定", "", "", "Standard"), ("x", None, None, "Other")]
    df = spark.createDataFrame(kinds, "t string, n string, f string, want string").withColumn("got", chunking.detect_doc_type(F.col("t"), F.col("n"), F.col("f")))
    assert all(r["got"] == r["want"] for r in df.collect())
