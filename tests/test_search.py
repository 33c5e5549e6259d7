"""Substring joins against all pairs, and stored postings: batches, pruned reads."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import bm25, graph, postings, ranking
from siltstone.operators.graph import Graph
from siltstone.operators.substrings import containing


@pytest.mark.parametrize("few", [None, "words", "texts"])
def test_substring_join_against_all_pairs(spark, few):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("ab气x\n😀") for _ in range(n))
    texts = {some(rng.randint(0, 9)) for _ in range(60)} | {"aaaaaaa", "", None}
    words = {some(rng.randint(0, 4)) for _ in range(60)} | {"aa", "zz", "az", "", None, "气"}
    got = containing(spark.createDataFrame([(w,) for w in [*words, *words]], "word string"), spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string"), few).collect()
    assert sorted(map(tuple, got)) == sorted((w, t) for w in words for t in texts if w and t and w in t)


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        props = {f: rng.choice(["大气污染", "大气", "small box", "box", "SO2", "", "x", "small copper box of SO2"]) for f in (*graph.SEARCH_FIELDS, "content") if rng.random() < 0.6}
        rows.append((f"n{k}", rng.choice(["Article", "Case"]), props, k // 3))
    return Graph(spark.createDataFrame(rows, "id string, label string, props map<string,string>, seq long"), None)


ASKED = [(1, "small box"), (2, "大气污染防治"), (3, "SO2，box"), (4, ""), (5, "x"), (6, "nothing"), (7, None), (8, "of"), (9, "small copper box of SO2 and more")]


@pytest.mark.parametrize("what", ["text_search", "substrings"])
def test_questions_by_join_and_in_the_plan_give_the_same(spark, names, what, monkeypatch, capsys):
    q = spark.createDataFrame(ASKED, "qid long, text string")
    few = sorted(map(str, getattr(names, what)(q).collect()))
    monkeypatch.setattr(ranking, "DIRECT", 0)
    df = getattr(names, what)(q)
    assert sorted(map(str, df.collect())) == few and len(few) > 20
    df.explain()
    assert "NestedLoop" not in (plan := capsys.readouterr().out) and "Cartesian" not in plan


def test_thousands_of_questions(spark, names):
    q = spark.range(3000).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, "small box").otherwise(F.concat(F.lit("大气污染 "), F.col("id").cast("string"))).alias("text"))
    got = names.text_search(q, 3)
    assert got.count() == 9000 and got.filter("qid % 2 = 0").drop("qid").distinct().count() == 3


DOCS = [(1, "x y", 1), (2, "x x", 2), (3, "z z", 3), (4, "x y", 4), (5, None, 5), (6, "", 6)]


def test_postings_by_batches_equal_one_index(spark, tmp_path):
    docs, q = spark.createDataFrame(DOCS, "id long, text string, seq long"), spark.createDataFrame([(1, "X x"), (2, "none"), (3, "z y"), (4, None)], "qid long, text string")
    for okapi in (False, True):
        index = postings.StoredIndex(spark, str(tmp_path / str(okapi)), okapi)
        for batch, part in (("1", docs.filter("id < 3")), ("two", docs), ("1", docs.filter("id < 3")), ("two", docs)):  # again, and overlapping
            index.add(part, batch)
        whole = bm25.build_index(docs, okapi=okapi)
        assert sorted(bm25.search(index, q).collect()) == sorted(bm25.search(whole, q).collect())
        assert index.terms.orderBy("term").collect() == whole.terms.orderBy("term").collect() and index.corpus.collect() == whole.corpus.collect()
        assert sorted(index.postings.collect()) == sorted(whole.postings.collect())
        lost = index._read("postings").withColumn("batch", F.lit("b_lost"))
        lost.write.mode("append").partitionBy("batch", "bucket").parquet(f"{index.path}/postings")
        assert sorted(bm25.search(index, q).collect()) == sorted(bm25.search(whole, q).collect())


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    docs, q = spark.createDataFrame(DOCS, "id long, text string, seq long"), spark.createDataFrame([(1, "x y z a b c")], "qid long, text string")
    index = postings.StoredIndex(spark, str(tmp_path / "i"))
    index.add(docs, "1")
    want = bm25.search(index, q).collect()
    monkeypatch.setattr(postings, "NAMED_TERMS", 2)
    assert bm25.search(index, q).collect() == want


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path, capsys):
    docs = spark.range(200).select("id", F.concat(F.lit("w"), "id").alias("text"), F.col("id").alias("seq"))
    index = postings.StoredIndex(spark, str(tmp_path / "i"))
    index.add(docs, "1")
    index.postings_of(spark.createDataFrame([("w7",)], "term string")).explain("formatted")
    plan = capsys.readouterr().out
    assert "bucket" in plan.split("PartitionFilters: [", 1)[1].split("\n")[0] and "EqualTo(term,w7)" in plan or "In(term, [w7])" in plan


def test_terms_are_counted_within_a_row(spark):
    """Without any aggregate: what a task holds does not grow with its rows."""
    docs = [(1, 10, ["b", "a", "b"]), (2, 20, []), (3, 30, ["x"] * 5), (4, 40, ["", "z", ""])]
    got = postings.term_counts(spark.createDataFrame(docs, "id long, seq long, w array<string>"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    assert sorted(map(tuple, got.collect())) == [("", 4, 40, 3, 2), ("a", 1, 10, 3, 1), ("b", 1, 10, 3, 2), ("x", 3, 30, 5, 5), ("z", 4, 40, 3, 1)]


def test_stored_index_takes_the_least_seq_of_an_id(spark, tmp_path):
    index = postings.StoredIndex(spark, str(tmp_path / "index"))
    form = "id long, text string, seq long"
    index.add(spark.createDataFrame([(1, f"w{k} same", 99 - k) for k in range(60)] + [(1, "w59 same", 40), (None, "null id", 1), (2, None, 2), (3, "", 3)], form), "a")
    index.add(spark.createDataFrame([(1, "late", 0), (4, "new new", 4)], form), "b")
    assert sorted((r["term"], r["id"] or 0, r["seq"], r["dl"], r["tf"]) for r in index.postings.collect()) == [("id", 0, 1, 2, 1), ("new", 4, 4, 2, 2), ("null", 0, 1, 2, 1), ("same", 1, 40, 2, 1), ("w59", 1, 40, 2, 1)]
    assert sorted((r["id"] or 0, r["seq"], r["dl"]) for r in index.docs().collect()) == [(0, 1, 2), (1, 40, 2), (2, 2, 0), (3, 3, 0), (4, 4, 2)]


def test_stored_index_shuffles_new_texts_once(spark, tmp_path):
    import random
    import time

    def shuffled():
        time.sleep(1)  # figures of tasks come in late
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    rng = random.Random(3)
    docs = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)), k) for k in range(150)]
    rows = spark.createDataFrame(docs, "id long, text string, seq long")
    began = shuffled()
    postings.StoredIndex(spark, str(tmp_path / "once")).add(rows, "a")
    # a term is a whole text here: postings once, terms twice
    assert shuffled() - began < 3.5 * sum(len(t) for _, t, _ in docs)


def test_stored_index_shuffles_no_texts_that_it_holds(spark, tmp_path):
    """Where no table is small enough to be sent to every task."""
    import random
    import time

    def shuffled():
        time.sleep(1)  # figures of tasks come in late
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    rng = random.Random(4)
    docs = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)), k) for k in range(200)]
    rows = spark.createDataFrame(docs, "id long, text string, seq long")
    index = postings.StoredIndex(spark, str(tmp_path / "held"))
    index.add(rows.filter("id >= 20"), "a")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = shuffled()
        index.add(rows, "b")
        used = shuffled() - began
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert index.docs().count() == 200 and index.postings.count() == 200
    assert used < 5 * 20 * 20_000 + 400_000  # the new texts, their postings, twice their terms


def test_a_search_cuts_texts_into_words_once(spark, monkeypatch):
    """Not once for each of lengths, postings and counts; many terms give the same by joins."""
    cuts = spark.sparkContext.accumulator(0)

    def cut(text):
        cuts.add(text.startswith("doc"))
        return text.split()

    docs = spark.createDataFrame([(k, f"doc w{k % 7} w{k % 3} w{k % 3}", k) for k in range(50)] + [(50, "", 50)], "id long, text string, seq long")
    q = spark.createDataFrame([(1, "w1 w1 w5"), (2, "none"), (3, "w2")], "qid long, text string")
    tokenizer = F.udf(cut, "array<string>")
    index = bm25.build_index(docs, tokenizer)
    got = sorted(bm25.search(index, q, tokenizer=tokenizer).collect())
    assert cuts.value == 50 and len(got) == 20
    monkeypatch.setattr(bm25, "NAMED_TERMS", 0)
    assert sorted(bm25.search(index, q, tokenizer=tokenizer).collect()) == got
