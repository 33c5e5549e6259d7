"""Inverted index and BM25 ranking for batches of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import scratch
from .ranking import small, top

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Up to so many terms are named in the plan, for one pass over the texts; more are joined.
NAMED_TERMS = 1000


@dataclass
class Bm25Index:
    """words (id, seq, w: the tokens of each document) and one row of corpus counts (n,
    avgdl). Postings and terms follow from the words; a search makes them for its own terms
    only. postings.StoredIndex keeps them."""

    words: DataFrame
    corpus: DataFrame
    okapi: bool = False

    @property
    def postings(self) -> DataFrame:
        """(term, id, seq, dl, tf)."""
        return self.postings_of(None)

    def postings_of(self, wanted: DataFrame | None) -> DataFrame:
        """Postings of the wanted terms (term): others go before anything is shuffled."""
        rows = self.words.select("id", "seq", F.size("w").cast("long").alias("dl"), F.explode_outer("w").alias("term")).filter("term is not null")
        if wanted is not None:
            rows = rows.join(small(wanted.select("term").distinct()), "term", "left_semi")
        return rows.groupBy("term", "id", "seq", "dl").agg(F.count(F.lit(1)).alias("tf"))

    def counts(self) -> DataFrame:
        """(term, df) of all terms."""
        return self.words.select(F.explode_outer(F.array_distinct("w")).alias("term")).filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def counts_of(self, postings: DataFrame, wanted: DataFrame) -> DataFrame:
        """(term, df) of the wanted terms, whose postings are given."""
        return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def searched(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings, counts, corpus) for a search of the wanted terms. Texts are cut into
        words once: each document's length and what it has of the terms are stored."""
        terms = [r["term"] for r in wanted.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
        if len(terms) > NAMED_TERMS:
            postings = self.postings_of(wanted)
            return postings, self.counts_of(postings, wanted), self.corpus
        held = self.words.select("id", "seq", F.size("w").cast("long").alias("dl"), F.filter("w", lambda x: x.isin(terms)).alias("w"))
        held = scratch.stored(held, "terms")
        postings = held.select("id", "seq", "dl", F.explode("w").alias("term")).groupBy("term", "id", "seq", "dl").agg(F.count(F.lit(1)).alias("tf"))
        return postings, self.counts_of(postings, wanted), _counted(held, F.col("dl"))

    def idf(self, counts: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """(term, df, idf) of counts (term, df). okapi: negative ones are raised to EPSILON
        times the mean over all terms, the only thing that needs them all."""
        corpus = self.corpus if corpus is None else corpus
        n, df = F.col("n").cast("double"), F.col("df").cast("double")
        held = lambda rows: rows.crossJoin(F.broadcast(corpus))  # noqa: E731 one row
        if not self.okapi:
            return held(counts).select("term", "df", F.ln((n - df + 0.5) / (df + 0.5) + 1).alias("idf"))
        raw = lambda rows: held(rows).select("term", "df", (F.ln(n - df + 0.5) - F.ln(df + 0.5)).alias("idf"))
        mean = raw(self.counts()).agg(F.avg("idf").alias("mean"))
        return raw(counts).crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("idf") < 0, F.col("mean") * EPSILON).otherwise(F.col("idf")).alias("idf"))

    @property
    def terms(self) -> DataFrame:
        return self.idf(self.counts())


def _counted(rows: DataFrame, dl: Column) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), (F.sum(dl) / F.greatest(n, F.lit(1))).alias("avgdl"))


def _index(words: DataFrame, okapi: bool) -> Bm25Index:
    return Bm25Index(words, _counted(words, F.size("w").cast("long")), okapi)


def build_index(docs: DataFrame, tokenizer: Callable[[Column], Column] = tokens, okapi: bool = False) -> Bm25Index:
    """Index of docs (id, text, seq). seq is the order of ingestion. okapi: the classic
    idf, negative ones raised to EPSILON times the mean."""
    return _index(docs.select("id", "seq", tokenizer(F.coalesce("text", F.lit(""))).alias("w")), okapi)


def search(index: Bm25Index, queries: DataFrame, top_k: int = 10, later_first: bool = True, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(qid, id, score, rank from 0) of queries (qid, text): the top_k of each, without
    scores of 0. Only postings of the queries' terms are grouped and shuffled. Ties go to
    the later document, or the earlier."""
    wanted = queries.select("qid", F.explode(tokenizer(F.coalesce("text", F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))
    postings, counts, corpus = index.searched(wanted)
    idf = index.idf(counts, corpus)
    hits = postings.join(wanted.join(idf, "term"), "term").crossJoin(F.broadcast(corpus))
    tf = F.col("tf").cast("double")
    part = F.col("qf") * F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("qid", "id", "seq").agg(F.sum(part).alias("score")).filter("score > 0")
    # equal scores must not differ by the order of summing
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("seq").desc() if later_first else F.col("seq").asc())
    return top(scored, order, top_k).select("qid", "id", "score", "rank")
