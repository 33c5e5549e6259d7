"""Scores of answers and evidence, and their roll-up by type and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KPI = 0.85


def keyword_score(answer: Column, keywords: Column) -> Column:
    """Share of keywords that occur, whatever their case; 1 without keywords."""
    hit = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, 1.0).otherwise(hit / F.size(keywords))


def evidence_score(labels: Column, expected: Column) -> Column:
    """Share of expected labels among those found; 1 if none is expected, else 0 if none is found."""
    hit = F.size(F.filter(expected, lambda e: F.array_contains(labels, e)))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 1.0).when(F.coalesce(F.size(labels), F.lit(0)) <= 0, 0.0).otherwise(hit / F.size(expected))


def item_scores(items: DataFrame) -> DataFrame:
    """items (id, type, recall, answer_score) with total and the three pass flags."""
    total = F.col("recall") * 0.6 + F.col("answer_score") * 0.4
    return items.withColumn("total", total).withColumns({"recall_pass": F.col("recall") >= 0.5, "answer_pass": F.col("answer_score") >= 0.5, "passed": total >= 0.6})


def rollup(scored: DataFrame) -> DataFrame:
    """(type, n, recall_pass_rate, answer_pass_rate, avg_recall, avg_total); null type: all."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return scored.rollup("type").agg(F.count(F.lit(1)).alias("n"), rate("recall_pass").alias("recall_pass_rate"), rate("answer_pass").alias("answer_pass_rate"), F.avg("recall").alias("avg_recall"), F.avg("total").alias("avg_total"))


def failures(scored: DataFrame) -> DataFrame:
    return scored.filter(~F.col("passed"))


def reaches_kpi(summary: DataFrame) -> DataFrame:
    return summary.filter("type is null").select((F.col("avg_total") >= KPI).alias("reached"))


def item_sources(hits: DataFrame) -> DataFrame:
    """(id, sources): distinct sources over an item's hits."""
    return hits.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def report_markdown(summary: list, failed: list) -> str:
    """The report's text from collected rows of rollup() and failures()."""
    lines = ["# Evaluation", "", "| type | n | recall pass | answer pass | mean recall | mean total |", "|-|-|-|-|-|-|"]
    for r in sorted(summary, key=lambda r: (r["type"] is not None, r["type"] or "")):
        lines.append(f"| {r['type'] or 'all'} | {r['n']} | {r['recall_pass_rate']:.3f} | {r['answer_pass_rate']:.3f} | {r['avg_recall']:.3f} | {r['avg_total']:.3f} |")
    whole = next((r for r in summary if r["type"] is None), None)
    if whole:
        lines += ["", f"KPI {KPI}: {'reached' if whole['avg_total'] >= KPI else 'not reached'}"]
    return "\n".join([*lines, "", "## Not passed", *[f"- {r['id']}: {r['total']:.3f}" for r in failed], ""])
