"""The segmenter against every way to cut a text."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions.segment import Segmenter, tokenizer
from siltstone.operators import bm25


def ways(text, words):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if k == 1 or text[:k] in words:
            yield from ([text[:k], *rest] for rest in ways(text[k:], words))


def test_best_path_of_all():
    rng = random.Random(6)
    for _ in range(200):
        words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 4))): rng.choice([1, 2, 3, 10]) for _ in range(12)}
        total = math.log(sum(words.values()))
        text = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 9)))
        score = lambda path: round(sum(math.log(words.get(w, 1)) - total for w in path), 9)
        want = max(ways(text, words), key=lambda path: (score(path), [len(w) for w in path]))
        got = Segmenter(words).path(text)
        assert score(got) == pytest.approx(score(want)) and "".join(got) == text


def test_search_mode_and_other_text():
    s = Segmenter({"污染": 5, "防治": 4, "污染防治": 9, "污染防": 1, "": 3, "x": 0})
    assert s.tokens("《污染防治》PM2.5，Ab 水") == ["污染", "防治", "污染防", "污染防治", "pm2", "5", "ab", "水"]
    assert s.tokens("污染防治", search=False) == ["污染防治"] and s.tokens(None) == [] and s.tokens(" ，") == []
    assert Segmenter({}).tokens("大气") == ["大", "气"]


def test_long_runs_take_linear_time():
    assert len(Segmenter({"污染": 2, "染污": 1}).tokens("污染" * 100_000)) == 100_000


def test_as_a_tokenizer(spark):
    docs = spark.createDataFrame([(1, "大气污染防治法", 1), (2, "水污染", 2), (3, None, 3)], "id long, text string, seq long")
    cut = tokenizer({"大气": 3, "污染": 5, "防治": 2, "大气污染": 2})
    q = spark.createDataFrame([(1, "大气污染")], "qid long, text string")
    assert [r["id"] for r in bm25.search(bm25.build_index(docs, cut), q, tokenizer=cut).orderBy("rank").collect()] == [1, 2]
    assert docs.select(F.size(cut(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] > 0
