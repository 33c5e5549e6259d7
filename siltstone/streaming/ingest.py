"""An extension: chunking of documents as they arrive, by micro-batches that skip the
chunks already stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking
from ..sources.readers import table_exists


def store_new_chunks(batch: DataFrame, path: str, **options) -> None:
    chunks = chunking.chunk_documents(batch, **options).dropDuplicates(["chunk_id"])
    if table_exists(batch.sparkSession, path):
        chunks = chunks.join(batch.sparkSession.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti")
    chunks.write.mode("append").parquet(path)


def chunk_stream(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a query over a streaming DataFrame (doc_id, text); it ends when the source
    has given all it has."""
    return docs.writeStream.foreachBatch(lambda batch, _: store_new_chunks(batch, path, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
