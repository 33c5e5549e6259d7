"""Extraction of chunks as they arrive: each chunk is asked once, also over runs that break off.

A micro-batch is asked in parts. The answers of a part are stored before the next one is
asked, in a folder of the batch and part, and a batch that runs again after a failure, which
the checkpoint sees to, takes the answers of complete parts from there. Only the part that was
being asked when a run broke off is asked again. Records follow from the answers, in a folder
of the batch that a repeated run replaces. Chunks that other batches have records of are left
out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extraction
from ..sources.readers import table_exists

#: Parts of a batch.
PARTS = 16


def extract_batch(batch: DataFrame, number: int, path: str, model: Callable[[str], str], parts: int = PARTS, tries: int = 3) -> None:
    """Stores answers and records of a batch of chunks (see extraction.extract)."""
    spark = batch.sparkSession
    own = f"batch={number}"
    chunks = batch.dropDuplicates(["chunk_id"])
    if table_exists(spark, f"{path}/records"):
        held = spark.read.parquet(f"{path}/records")
        chunks = chunks.join(held.filter(F.col("batch") != number).select("chunk_id"), "chunk_id", "left_anti")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks/{own}")
    chunks = spark.read.schema(chunks.schema).parquet(f"{path}/chunks/{own}")
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(parts))
    for k in range(parts):
        at = f"{path}/answers/{own}/part={k}"
        if not table_exists(spark, f"{at}/_SUCCESS"):
            extraction.asked(chunks.filter(part == k), model, tries).write.mode("overwrite").parquet(at)
    answers = spark.read.schema("chunk_id string, answer string").parquet(*[f"{path}/answers/{own}/part={k}" for k in range(parts)])
    extraction.records(chunks, answers).write.mode("overwrite").parquet(f"{path}/records/{own}")


def extract_stream(chunks: DataFrame, path: str, checkpoint: str, model: Callable[[str], str], parts: int = PARTS, tries: int = 3) -> StreamingQuery:
    """Starts a query over a streaming DataFrame of chunks; it ends when the source has given
    all it has. Records are in `path`/records."""
    run = lambda batch, number: extract_batch(batch, number, path, model, parts, tries)
    return chunks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
