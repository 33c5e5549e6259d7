"""Writers: chunks, extraction records, graphs, caches, statements and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import KPI, failures, report_markdown, rollup
from . import readers


def write_chunks(chunks: DataFrame, path: str, form: str = "parquet") -> DataFrame:
    """Writes chunks (parquet or json lines) and returns counts by type of what is stored."""
    chunks.write.mode("overwrite").format(form).save(path)
    return chunks.sparkSession.read.schema(chunks.schema).format(form).load(path).groupBy("doc_type").count()


def append_records(records: DataFrame, path: str, run: str) -> None:
    records.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label and edges by relationship, so that a query reads its labels only."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def write_chunk_array(chunks: DataFrame, path: str) -> None:
    """All chunks as one JSON array, in one file. One task writes it, a row at a time;
    write_chunks(form="json") is the form for many chunks."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        yield pa.RecordBatch.from_arrays([pa.array(["["])], ["value"])
        for batch in batches:
            held = [v for v in batch.column(0).to_pylist() if v is not None]
            out = [("" if first and k == 0 else ",") + v for k, v in enumerate(held)]
            first = first and not out
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    rows = chunks.select(F.to_json(F.struct(*chunks.columns)).alias("value"))
    one = chunks.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # a task, if there are no chunks
    rows.unionByName(one).coalesce(1).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def append_cache(new: DataFrame, path: str) -> None:
    new.write.mode("append").json(path)


def compact_cache(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The cache with one entry, the last, for each key, written to `out`."""
    readers.embedding_cache(spark, path).write.mode("overwrite").json(out)
    return readers.embedding_cache(spark, out)


def write_statements(statements: DataFrame, path: str) -> None:
    statements.select("statement").write.mode("overwrite").text(path)


def import_batches(statements: DataFrame, run_batch, batch: int = 200) -> DataFrame:
    """(done, failed) for each partition: run_batch(list of statements) for every batch; a
    batch that raises is counted and passed over."""

    def run(frames):
        import pandas as pd

        done = failed = 0
        for f in frames:
            lines = f["statement"].tolist()
            for lo in range(0, len(lines), batch):
                part = lines[lo : lo + batch]
                try:
                    run_batch(part)
                    done += len(part)
                except Exception:
                    failed += len(part)
        yield pd.DataFrame({"done": [done], "failed": [failed]})

    return statements.select("statement").mapInPandas(run, "done long, failed long")


def recall_report(scored: DataFrame, details: DataFrame, mode: str, path: str) -> str:
    """Stores a recall run, and returns the JSON text of its totals, in all and by type: that
    text below summary.json, and the details of all questions as JSON lines below details."""
    details.write.mode("overwrite").json(f"{path}/details")
    rows = [r.asDict() for r in rollup(scored).collect()]  # a row for each type
    whole = next((r for r in rows if r["type"] is None), {})
    by_type = {r["type"]: {k: r[k] for k in ("n", "recall_pass_rate", "avg_recall")} for r in rows if r["type"] is not None}
    text = json.dumps({"mode": mode, "total": whole.get("n", 0), "recall_pass_rate": whole.get("recall_pass_rate"), "avg_recall": whole.get("avg_recall"), "by_type": by_type}, ensure_ascii=False)
    scored.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary.json")
    return text


def write_report(scored: DataFrame, path: str, mode: str = "baseline") -> dict:
    """Stores a run: summary.json and report.md (as text files of one part), and the scored
    items as JSON lines below items. Returns the summary."""
    spark = scored.sparkSession
    scored.write.mode("overwrite").json(f"{path}/items")
    kept = spark.read.schema(scored.schema).json(f"{path}/items")
    rows = [r.asDict() for r in rollup(kept).collect()]
    whole = next((r for r in rows if r["type"] is None), {"n": 0})
    summary = {"mode": mode, "total": whole["n"], **{k: v for k, v in whole.items() if k not in ("type", "n")}, "kpi": bool((whole.get("avg_total") or 0) >= KPI), "by_type": {r["type"]: {k: v for k, v in r.items() if k != "type"} for r in rows if r["type"] is not None}}
    for name, text in (("summary.json", json.dumps(summary, ensure_ascii=False, indent=2)), ("report.md", markdown_report(kept))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    return summary


def markdown_report(scored: DataFrame) -> str:
    return report_markdown(rollup(scored).collect(), failures(scored).select("id", "total").collect())
