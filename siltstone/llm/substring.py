"""Substring deduplication by content-defined chunks.

A gear hash rolls over the last 16 bytes: h = (h << 1) + gear[byte], kept to 16 bits. A
byte with MASK_BITS zero bits at the top of h is a candidate cut; it cuts if the last cut
and the document's start are at least MIN_CHUNK bytes away. Chunks over MAX_CHUNK are cut
at the smallest hash, the first of equals, of those that leave MIN_CHUNK bytes on either
side. An insertion may shift the cuts behind it up to the next MIN_CHUNK bytes without a
candidate, or, in a stretch without candidates, until both forms meet in one smallest hash.

Chunks are compared by 128-bit digest. A chunk is a repeat if it stands in a document of
smaller doc_id, or earlier in the same document. Every run of adjacent repeated chunks is
reported with its length: short ones may be common phrases, or whole short documents; a
caller who wants long runs only filters by n_bytes, or gives min_run. Each batch of
documents resolves its own repeats first and sends one occurrence of a digest on; a task
remembers what it found often (Known), so a line that a third of all documents have is a
few entries for each task. Digests are then compared bucket by bucket.

Edge cases: null and empty texts have no chunks; a null doc_id sorts before all others.
A document is a doc_id with a text (text_key stands for it): different texts of one id, or
without an id, are different documents, neither earlier than the other; repeated rows
(same id, same text) are one, and their ranges are reported once. An empty table gives an
empty result; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Known, bucket_count, bucket_rows, doc_groups, in_buckets, lean, mix64, text_buffer, text_or_empty, text_volume

WINDOW = 16
MASK_BITS = 5
MIN_CHUNK, MAX_CHUNK = 16, 256
#: Every run is reported.
MIN_RUN = 1
#: Sorts before every id; stands for a null one.
NULL_ID = -(2**63)


@cache
def gear() -> np.ndarray:
    return np.random.default_rng(771).integers(0, 1 << 16, 256, dtype=np.uint32)


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sums of shifted codes of 1, 2, 4, 8, then 16 bytes."""
    h = gear()[buf]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    return h & np.uint32(0xFFFF)


def chunk_edges(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks, and n+1 offsets of documents into them."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    h = gear_hashes(buf)
    cut = np.flatnonzero(h >> np.uint32(WINDOW - MASK_BITS) == 0) + 1  # a chunk may start here
    begin = offs[:-1][np.diff(offs) > 0]
    cut = cut[(cut - begin[np.searchsorted(begin, cut, side="right") - 1] >= WINDOW) & (cut < n)]
    far, last = [], -MIN_CHUNK
    for at in cut.tolist():
        if at - last >= MIN_CHUNK:
            far.append(at)
            last = at
    starts = np.union1d(begin, np.array(far, np.int64))
    ends = np.append(starts[1:], n)
    long, forced = ends - starts > MAX_CHUNK, []
    for at, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        while end - at > MAX_CHUNK:
            first = at + MIN_CHUNK
            at = first + int(h[first - 1 : min(at + MAX_CHUNK, end - MIN_CHUNK)].argmin())
            forced.append(at)
    starts = np.union1d(starts, np.array(forced, np.int64))
    return starts, np.searchsorted(starts, offs)


def _digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    view, digest = memoryview(buf.tobytes()), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


def doc_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy()


def text_key() -> Column:
    """64 bits that tell the texts of one doc_id apart."""
    return F.xxhash64(text_or_empty())


def originals(d1: np.ndarray, d2: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by digest, document, text key and start; whether each entry, in that order,
    is an original: of its digest's smallest document id, and first in its own text; and
    whether it begins a digest."""
    order = np.lexsort((start, key, doc, d2, d1))
    a, b, d, k, s = d1[order], d2[order], doc[order], key[order], start[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    text = new.copy()
    text[1:] |= (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    if not len(a):
        return order, new, new
    head, own = (np.flatnonzero(x)[np.cumsum(x) - 1] for x in (new, text))
    return order, (d == d[head]) & (s == s[own]), new


_BLOBS = "bucket int, d1 binary, d2 binary, doc binary, key binary, start binary, size binary"
_ENTRY = ("doc", "key", "start", "size")
_KINDS = {"d1": np.uint64, "d2": np.uint64, "doc": np.int64, "key": np.int64, "start": np.int64, "size": np.int32}
Chunks = dict[str, np.ndarray]


def _batch(rows: list[tuple[int, list[bytes | None]]]) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in _BLOBS.split(", ")]
    columns = [pa.array([r[1][k] for r in rows], pa.binary()) for k in range(len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *columns], names)


def _by_doc(c: Chunks, rows: np.ndarray, buckets: int) -> list[tuple[int, list[bytes | None]]]:
    """Repeats, by bucket of their document; they travel without a digest."""
    spread = mix64(c["doc"][rows].view(np.uint64) ^ c["key"][rows].view(np.uint64))
    return [(b, [None, None, *x[1:]]) for b, x in bucket_rows(spread, buckets, *(c[n][rows] for n in _ENTRY))]


def _chunk_blobs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    known = Known(2)  # by d1: d2 and the smallest document id so far
    for batch in batches:
        ids, keys = doc_ids(batch.column(0)), batch.column(1).to_numpy()
        buf, offs = text_buffer(batch.column(2))
        parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in _KINDS.items()}
        for lo, hi in doc_groups(offs):
            own, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            starts, coffs = chunk_edges(own, at)
            ends = np.append(starts[1:], len(own))[: len(starts)]
            doc = np.repeat(np.arange(hi - lo), np.diff(coffs))
            digest = _digests(own, starts, ends)
            new = {"d1": digest[:, 0], "d2": digest[:, 1], "doc": ids[lo:hi][doc], "key": keys[lo:hi][doc], "start": starts - at[doc], "size": (ends - starts).astype(np.int32)}
            for k, v in new.items():
                parts[k].append(v)
        c = {k: np.concatenate(v) for k, v in parts.items()}
        order, first, new = originals(c["d1"], c["d2"], c["doc"], c["key"], c["start"])
        head = order[new]
        have, (d2, least) = known.find(c["d1"][head])
        have &= d2.view(np.uint64) == c["d2"][head]
        # later than a document that an earlier batch had: a repeat, whatever else there is
        old = have & (c["doc"][head] > least)
        group = np.cumsum(new) - 1
        first &= ~old[group] if len(group) else True
        often = np.bincount(group, minlength=len(head)) > 1
        learn = (often & ~have) | (have & ~old)
        _, one = np.unique(c["d1"][head][learn], return_index=True)
        one = head[learn][one]
        known.add(c["d1"][one], c["d2"][one].view(np.int64), c["doc"][one])
        keep = order[first]
        same = np.zeros(len(keep), bool)  # repeated rows: one stands for both
        if len(keep) > 1:
            same[1:] = np.logical_and.reduce([c[n][keep][1:] == c[n][keep][:-1] for n in ("d1", "d2", "doc", "key", "start")])
        keep = keep[~same]
        rows = [(b, list(x)) for b, x in bucket_rows(c["d1"][keep], buckets, *(c[n][keep] for n in ("d2", *_ENTRY)))]
        yield _batch(rows + _by_doc(c, order[~first], buckets))


def _gather(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Chunks:
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, _KINDS[k])] for k in names}
    for batch in batches:
        for k in names if batch.num_rows else ():
            parts[k].append(text_buffer(batch.column(k))[0].view(_KINDS[k]).copy())
    return {k: np.concatenate(v) for k, v in parts.items()}


def _repeats(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """All but the originals, by document; repeats found before pass through."""
    held = []
    for batch in batches:
        new = batch.column("d1").is_valid()
        yield batch.filter(pa.compute.invert(new))
        held.append(batch.filter(new))
    c = _gather(iter(held), tuple(_KINDS))
    order, first, _ = originals(c["d1"], c["d2"], c["doc"], c["key"], c["start"])
    yield _batch(_by_doc(c, order[~first], buckets))


def _runs(batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    c = _gather(batches, _ENTRY)
    order = np.lexsort((c["start"], c["key"], c["doc"]))
    doc, key, start, end = c["doc"][order], c["key"][order], c["start"][order], c["start"][order] + c["size"][order]
    if not len(doc):
        return
    new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > end[:-1]))
    head, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    doc, key, start, length = doc[head], key[head], start[head], end[tail] - start[head]
    ok = length >= min_run
    yield pa.RecordBatch.from_arrays([pa.array(doc[ok], mask=doc[ok] == NULL_ID), pa.array(key[ok]), pa.array(start[ok]), pa.array(length[ok])], ["doc_id", "text_key", "start", "n_bytes"])


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, text_key, start, n_bytes): byte ranges of documents that repeat chunks which
    stand earlier (in a smaller doc_id, or earlier in the same document), of min_run bytes
    or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.encode("text", "UTF-8").alias("t"))
    volume = 1.5 * text_volume(docs)
    buckets = bucket_count(docs.sparkSession, volume)
    blobs = rows.mapInArrow(lean(lambda it: _chunk_blobs(it, buckets)), _BLOBS)
    again = in_buckets(blobs, volume, lambda it: _repeats(it, buckets), _BLOBS)
    return in_buckets(again, volume, lambda it: _runs(it, min_run), "doc_id long, text_key long, start long, n_bytes long")


def remove_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs (doc_id, text) without the byte ranges (doc_id, text_key, start, n_bytes); a
    range ends at whole characters. Adds kept_text."""
    spans = ranges.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "n_bytes"))).alias("spans"))  # of one document
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key() == F.col("_key")), "left").drop("_id", "_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, kept = (text or "").encode(), 0, []
                for s in spans or ():
                    kept.append(raw[at : s["start"]])
                    at = s["start"] + s["n_bytes"]
                out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore") if text is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, pa.string())], ["doc_id", "text", "kept_text"])

    return joined.mapInArrow(lean(cut), "doc_id long, text string, kept_text string")
