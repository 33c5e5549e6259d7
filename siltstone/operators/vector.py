"""Exact cosine search, embedding cache and incremental indexing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from ..functions.text import cache_key
from .ranking import top

Encoder = Callable[[list[str]], np.ndarray]
BATCH = 64
#: Vectors in a block.
BLOCK = 1024
#: Queries of up to so many bytes are sent to every task.
BROADCAST_BYTES = 32 << 20


def hash_encoder(dim: int = 64) -> Encoder:
    """A stand-in without a model: unit vectors from hashed words."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dim] += 1.0 if h & 0x10000 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def unit(v: Column) -> Column:
    """The vector scaled to length 1."""
    return F.transform(v, lambda x: x / norm(v))


def _names(prefix: str, key: DataType, place: DataType) -> StructType:
    return StructType([StructField(f"{prefix}ids", ArrayType(key)), StructField(f"{prefix}seqs", ArrayType(place))]).add(f"{prefix}m", "binary")


def packed(rows: DataFrame, names: tuple[str, str], prefix: str, size: int = BLOCK, by: str | None = None) -> DataFrame:
    """rows (id, seq, embedding) as blocks of at most `size`: lists of ids and seqs, and the
    vectors, as doubles, in one binary value. Rows without a vector are left out. by: a
    column that rows are sorted by; a block has one value of it."""
    key, place = names
    schema = _names(prefix, rows.schema[key].dataType, rows.schema[place].dataType)
    if by is not None:
        schema = StructType([rows.schema[by], *schema.fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [0, batch.num_rows]
            if by is not None and batch.num_rows:
                values = batch.column(3).to_numpy()
                edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
            for from_, to in zip(edges, edges[1:], strict=False):
                for lo in range(from_, to, size):
                    part = batch.slice(lo, min(size, to - lo))
                    m = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in (0, 1)]
                    own = [part.column(3)[:1]] if by is not None else []
                    yield pa.RecordBatch.from_arrays([*own, *lists, pa.array([m.tobytes()], pa.binary())], [f.name for f in schema])

    held = rows.select(F.col(key), F.col(place), F.col("embedding"), *([by] if by is not None else [])).filter(F.col("embedding").isNotNull())
    return held.mapInArrow(pack, schema)


def _unit_rows(raw: bytes, n: int) -> np.ndarray:
    """n vectors of length 1; a zero vector stays zero, and is like nothing."""
    m = np.frombuffer(raw).reshape(n, -1)
    return m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) > 0, size, 1.0)


def scored_pairs(pairs: DataFrame, types: tuple[DataType, DataType, DataType], top_k: int) -> DataFrame:
    """(qid, id, seq, score) of pairs of blocks (vids, vseqs, vm, qids, qm): a pair is one
    product of matrices, and only the top_k of each query in it leave the task."""
    schema = StructType([StructField(n, t) for n, t in zip(("qid", "id", "seq"), types, strict=True)]).add("score", DoubleType())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, seqs, qids = (batch.column(c)[k].values for c in ("vids", "vseqs", "qids"))
                v, q = (_unit_rows(batch.column(c)[k].as_py(), n) for c, n in (("vm", len(ids)), ("qm", len(qids))))
                s = q @ v.T
                place = np.argsort(np.argsort(seqs.to_numpy(zero_copy_only=False), kind="stable"))
                order = np.lexsort((np.broadcast_to(place, s.shape), -np.round(s, 9)), axis=-1)[:, :top_k]
                n = order.shape[1]
                flat = pa.array(order.reshape(-1))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.repeat(np.arange(len(qids)), n))), ids.take(flat), seqs.take(flat), pa.array(np.take_along_axis(s, order, 1).reshape(-1))], ["qid", "id", "seq", "score"])

    return pairs.select("vids", "vseqs", "vm", "qids", "qm").mapInArrow(score, schema)


def ranked(scored: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "seq")
    return top(scored, order, top_k).select("qid", "id", "score", "rank")


def search(vectors: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, id, score, rank from 0): vectors (id, seq, embedding) by cosine to queries
    (qid, embedding). Blocks of vectors meet tiles of queries. Queries of up to
    BROADCAST_BYTES go to all tasks; more are dealt out: a block goes to one row of a grid,
    a tile to all of them, so that an equality join brings each pair together once."""
    left = packed(vectors, ("id", "seq"), "v")
    held = queries.select("qid", F.col("qid").alias("_seq"), "embedding")
    right = packed(held, ("qid", "_seq"), "q").select("qids", "qm")
    size = held.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0  # bytes of the tiles
    if size <= BROADCAST_BYTES:
        pairs = left.crossJoin(F.broadcast(right))
    else:
        rows = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = left.withColumn("row", F.pmod(F.xxhash64("vids"), F.lit(rows)).cast("int")).join(right.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))), "row")
    types = (queries.schema["qid"].dataType, vectors.schema["id"].dataType, vectors.schema["seq"].dataType)
    return ranked(scored_pairs(pairs, types, top_k), top_k)


def retrying(encoder: Encoder, tries: int = 10, busy: tuple[str, ...] = ("429", "1302", "1305", "1113"), pause: Callable[[float], None] = time.sleep) -> Encoder:
    """An encoder that waits 60, 120, ... up to 300 seconds when the model is busy; other
    errors, and too many of these, are raised."""

    def encode(texts: list[str]) -> np.ndarray:
        for n in range(tries):
            try:
                return encoder(texts)
            except Exception as e:
                if not any(b in str(e) for b in busy):
                    raise
                pause(min(60.0 * (n + 1), 300.0))
        raise RuntimeError(f"no embedding after {tries} tries")

    return encode


def encode_missing(texts: DataFrame, cache: DataFrame, encoder: Encoder) -> DataFrame:
    """(k, v) of the distinct texts (text, ...) whose key the cache (k, ...) lacks, each
    encoded once. What reads it more than once asks the encoder again: store it first. A busy
    model is asked again, see retrying()."""
    missing = texts.select(cache_key(F.col("text")).alias("k"), "text").join(cache.select("k"), "k", "left_anti").dropDuplicates(["k"])
    return encode(missing, encoder)


def encode(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """(k, v) of texts (k, text), each row encoded. A busy model is asked again."""
    encoder = retrying(encoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), BATCH):
                part = frame.iloc[lo : lo + BATCH]
                yield pd.DataFrame({"k": part["k"].to_numpy(), "v": [x.tolist() for x in encoder(part["text"].tolist())]})

    return texts.select("k", "text").mapInPandas(run, "k string, v array<float>")


def with_embeddings(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts (text, ...) with k and embedding from the cache (k, v)."""
    return texts.withColumn("k", cache_key(F.col("text"))).join(cache.select("k", "v"), "k").withColumnRenamed("v", "embedding")


def not_indexed(rows: DataFrame, index: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose id the index lacks; `limit` is exact, in the order of seq."""
    rest = rows.join(index.select("id"), "id", "left_anti")
    return rest.orderBy("seq").limit(limit) if limit is not None else rest
