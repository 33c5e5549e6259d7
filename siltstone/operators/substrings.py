"""Substring joins: which texts contain which words, without comparing all with all.

A word that occurs in a text has all its character pairs in common with it. Each word is
looked up by the one of its pairs that the fewest texts have, and what is found that way is
checked. A word with a pair that no text has is looked up nowhere; one of a single character
is its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import is_small as _is_small
from .ranking import small

#: Group 1 of each match, at every place: two neighbouring characters.
PAIR = r"(?s)(?=(..))"
CHAR = r"(?s)(.)"


def grams(c: Column) -> Column:
    """The distinct characters and pairs of neighbouring characters."""
    every = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    return F.array_distinct(F.concat(every(CHAR), every(PAIR)))


def keys(c: Column) -> Column:
    """What a text must have in common with a word: its pairs, or its only character."""
    return F.when(F.length(c) < 2, F.array(c)).otherwise(F.array_distinct(F.regexp_extract_all(c, F.lit(PAIR), F.lit(1))))


def containing(words: DataFrame, texts: DataFrame, few: str | None = None) -> DataFrame:
    """Distinct (word, text) with the word in the text, for words (word) and texts (text).
    Nulls and the empty word give none. few: "words" or "texts" if they are a batch of
    questions, which goes to all tasks if its size allows."""
    held = words.select("word").filter(F.length("word") > 0).distinct().withColumn("k", keys(F.col("word")))
    asked = held.select("word", F.size("k").alias("n"), F.explode("k").alias("gram"))
    index = texts.select("text").filter(F.length("text") > 0).distinct().select("text", F.explode(grams(F.col("text"))).alias("gram"))
    if few != "texts":
        wanted = asked.select("gram").distinct()
        index = index.join(small(wanted) if few else wanted, "gram", "left_semi")
    df = index.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    found = asked.join(small(df) if few == "texts" else df, "gram").groupBy("word", "n").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "gram")).alias("least"))
    rarest = found.filter("found = n").select("word", F.col("least.gram").alias("gram"))
    if few == "texts":
        pairs = rarest.join(small(index), "gram")
    else:  # each word has one row: as few as there are words
        pairs = index.join(F.broadcast(rarest) if few and _is_small(held.select("word")) else rarest, "gram")
    return pairs.filter(F.contains("text", F.col("word"))).select("word", "text")
