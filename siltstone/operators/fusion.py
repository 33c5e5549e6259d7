"""Reciprocal-rank fusion of ranked lists, for batches of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
# Words of case questions and of questions on procedure.
CASE_WORDS = ["案例", "处罚", "违法", "查处", "典型", "追究", "罚款", "拘留", "犯罪"]
SOP_WORDS = ["流程", "程序", "步骤", "如何", "怎么办", "怎么申请", "怎么办理", "怎么走"]


def query_weights(text: Column, case_words: list[str] | None = None, sop_words: list[str] | None = None) -> tuple[Column, Column, Column]:
    """Weights of the vector, graph and BM25 lists by the class of the question."""
    has = lambda words: reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words])
    case, sop = has(case_words or CASE_WORDS), has(sop_words or SOP_WORDS)
    return F.lit(1.0), F.when(case, 2.0).otherwise(1.5), F.when(case, 1.0).when(sop, 1.8).otherwise(1.5)


def fuse(lists: DataFrame, top_k: int | None = None, k: int = K, last_payload: bool = False) -> DataFrame:
    """(qid, key, rrf, payload, sources, rank) of lists (qid, list_no, source, rank from
    0, key, payload, weight): the sum of weight / (k + rank + 1). The payload is that of
    the first list that has the key (or the last); ties stand as the lists came."""
    pick = F.max_by if last_payload else F.min_by
    place = F.struct("list_no", "rank")
    fused = lists.groupBy("qid", "key").agg(
        F.sum(F.col("weight") / (F.lit(k) + F.col("rank") + 1)).alias("rrf"), pick("payload", place).alias("payload"), F.min(place).alias("first"),
        F.array_sort(F.collect_set(F.struct("list_no", "source"))).alias("s"),
    )
    order = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), "first.list_no", "first.rank")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked.filter(F.col("rank") <= top_k) if top_k is not None else ranked
    return ranked.select("qid", "key", "rrf", "payload", F.transform("s", lambda x: x["source"]).alias("sources"), "rank")


def as_list(hits: DataFrame, list_no: int, source: str | Column, payload: Column, weight: Column | None = None) -> DataFrame:
    """Ranked hits (qid, id, rank) as one of the lists that fuse() takes."""
    return hits.select("qid", F.lit(list_no).alias("list_no"), F.lit(source).alias("source"), "rank", F.col("id").cast("string").alias("key"), payload.alias("payload"), (weight if weight is not None else F.lit(1.0)).alias("weight"))
