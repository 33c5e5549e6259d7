"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words that keeps five of them and ignores the
others; MASKS holds the plain one and two with a gap, which together hit every stretch
of 13 words with at most two words replaced. Items of under FULL_FROM words have, besides,
seeds by LIGHT_MASKS, which keep four words: together all masks hit every overlap that the
rule below allows, for items of any length (tests enumerate this). An item of fewer than
five words is one seed, of all its words. Seeds of benchmark items and of documents are
joined by hash. Each hit gives an alignment (document, item, offset); the words of both
along it are compared, and the pair counts as an overlap if some window of min(item length,
VERIFY_WORDS) words has at least SIMILARITY of them equal: for under five words, all.

A bit table of fixed size (BLOOM_BITS, whatever the benchmark's size) lets documents skip
seeds that no item has; what passes is joined exactly. Words are [^\\x20\\x09-\\x0D]+ with
A-Z lower-cased.

Edge cases: items of two to four words match where they stand whole; an item of one word
matches documents of that one word only, as any other text may use it; null or empty texts,
of items too, match nothing; equal items are each reported; repeated rows are each reported;
either table empty gives an empty result; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, doc_groups, lean, mix64, text_buffer, words
from .ngram_join import BROADCAST_KEYS, text_keys

MASKS = ("11111", "111011", "110111")
#: For short items; documents have these seeds only if some item has.
LIGHT_MASKS = ("1111", "10111", "11011", "11101")
#: For items of as many words.
WHOLE_MASKS = ("1", "11", "111")
FULL_FROM = 12
_ALL = MASKS + LIGHT_MASKS + WHOLE_MASKS
VERIFY_WORDS = 13
SIMILARITY = 0.8
BLOOM_BITS = 1 << 24


def seeds(hashes: np.ndarray, woffs: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed hash, position in its document, document) for all masks; that of a single
    word stands for whole texts only."""
    doc = np.repeat(np.arange(len(woffs) - 1), np.diff(woffs))
    place = np.arange(len(hashes)) - woffs[doc]
    out = []
    for mask in masks:
        number = _ALL.index(mask)
        n = max(0, len(hashes) - len(mask) + 1)
        value = np.full(n, 1000 + number, np.uint64)
        for j, c in enumerate(mask):
            if c == "1":
                value = value * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + n]
        size = (woffs[doc + 1] - woffs[doc])[:n]
        inside = (place[:n] + len(mask) <= size) & ((len(mask) > 1) | (size == 1))
        out.append((mix64(value[inside]), place[:n][inside], doc[:n][inside]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(BLOOM_BITS - 1)
    return (h & bits).astype(np.int64), ((h >> np.uint64(32)) & bits).astype(np.int64)


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values))


_ROW = "id long, k1 long, k2 int, words array<long>, h array<long>, p array<int>"


def _item_seeds(hashes: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds by MASKS, and by the others those of short items."""
    found = [seeds(hashes, woffs)]
    for masks, least, most in ((LIGHT_MASKS, 5, FULL_FROM - 1), *(((m,), len(m), len(m)) for m in (*WHOLE_MASKS, LIGHT_MASKS[0]))):
        h, p, doc = seeds(hashes, woffs, masks)
        size = np.diff(woffs)[doc]
        use = (size >= least) & (size <= most)
        found.append((h[use], p[use], doc[use]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def masks_for(sizes: list[int]) -> tuple[str, ...]:
    """The masks that documents must have seeds by, for items of these numbers of words."""
    light = LIGHT_MASKS if any(5 <= n < FULL_FROM for n in sizes) else LIGHT_MASKS[:1] if 4 in sizes else ()
    return (*MASKS, *light, *(m for m in WHOLE_MASKS if len(m) in sizes))


def _scan(batches: Iterator[pa.RecordBatch], table: np.ndarray | None, masks: tuple[str, ...] = MASKS) -> Iterator[pa.RecordBatch]:
    """Words and seeds of each item; with a bit table, of each document those by `masks`
    that pass it, and only the documents that have some."""
    for batch in batches:
        buf, offs = text_buffer(batch.column(3))
        for lo, hi in doc_groups(offs):
            _, _, hashes, woffs = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            h, p, doc = _item_seeds(hashes, woffs) if table is None else seeds(hashes, woffs, masks)
            if table is not None:
                a, b = _probes(h)
                ok = table[a] & table[b]
                h, p, doc = h[ok], p[ok], doc[ok]
            order = np.lexsort((p, doc))
            h, p, doc = h[order], p[order], doc[order]
            rows = np.unique(doc)
            at = np.searchsorted(doc, np.append(rows, hi - lo))
            size = np.diff(woffs)[rows]
            pick = np.repeat(woffs[rows] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            keys = batch.slice(lo, hi - lo).take(pa.array(rows))
            columns = [*keys.columns[:3], _lists(hashes[pick].view(np.int64), np.append(0, np.cumsum(size))), _lists(h.view(np.int64), at), _lists(p.astype(np.int32), at)]
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in _ROW.split(", ")])


def _bit_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BLOOM_BITS, bool)
    for batch in batches:
        for probe in _probes(batch.column(0).to_numpy().view(np.uint64)):
            bits[probe] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def best_window(equal: np.ndarray, width: int) -> int:
    """The most equal words in any `width` consecutive ones."""
    if len(equal) < width:
        return 0
    run = np.concatenate([[0], np.cumsum(equal)])
    return int((run[width:] - run[:-width]).max())


def best_windows(equal: np.ndarray, size: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each of the stretches of `size` that `equal` is made of, the most equal words in
    any `width` consecutive ones; 0 for shorter stretches."""
    run = np.append(0, np.cumsum(equal))
    many = np.maximum(size - width + 1, 0)
    who = np.repeat(np.arange(len(size)), many)
    first = np.append(0, np.cumsum(many))
    at = (np.append(0, np.cumsum(size))[:-1] - first[:-1])[who] + np.arange(len(who))
    out = np.zeros(len(size), np.int64)
    if len(who):
        out[many > 0] = np.maximum.reduceat(run[at + width[who]] - run[at], first[:-1][many > 0])
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        equal = a.flatten().to_numpy() == b.flatten().to_numpy()
        size = pa.compute.list_value_length(a).to_numpy().astype(np.int64)
        width = np.minimum(batch.column("n_item").to_numpy().astype(np.int64), VERIFY_WORDS)
        ok = best_windows(equal, size, width) >= SIMILARITY * width
        run = np.append(0, np.cumsum(equal))
        ends = np.append(0, np.cumsum(size))
        out = batch.drop_columns(["a", "b"]).append_column("matched", pa.array((run[ends[1:]] - run[ends[:-1]]).astype(np.int32)))
        yield out.filter(pa.array(ok))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, item_id, start_word, n_item, matched): one row for each document
    and item that overlap, at the alignment with the most equal words; k1, k2 stand for
    the text."""
    with Tables(docs.sparkSession) as tables:
        return _overlaps(docs, benchmark, tables)


def _overlaps(docs: DataFrame, benchmark: DataFrame, tables: Tables) -> DataFrame:
    spark = docs.sparkSession
    form = lambda df, key: df.select(F.col(key).cast("long").alias("id"), *text_keys(), F.encode("text", "UTF-8").alias("t"))
    items = tables.table(form(benchmark, "item_id").mapInArrow(lean(lambda it: _scan(it, None)), _ROW))
    item_seeds = items.select("id", "k1", "k2", F.explode(F.arrays_zip("h", "p")).alias("s")).select(F.col("id").alias("item_id"), F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.col("s.h").alias("h"), F.col("s.p").alias("ip")).distinct()
    bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in item_seeds.select("h").coalesce(4).mapInArrow(lean(_bit_table), "bits binary").collect():
        bits |= np.frombuffer(r["bits"], np.uint8)
    table = spark.sparkContext.broadcast(bits)
    masks = masks_for([r["n"] for r in items.select(F.size("words").alias("n")).filter(F.col("n") < FULL_FROM).distinct().collect()])
    held = tables.table(form(docs, "doc_id").mapInArrow(lean(lambda it: _scan(it, np.unpackbits(table.value).astype(bool), masks)), _ROW))
    texts = held.groupBy("k1", "k2").agg(F.first("words").alias("words"), F.first("h").alias("h"), F.first("p").alias("p"))
    hits = texts.select("k1", "k2", F.explode(F.arrays_zip("h", "p")).alias("s")).select("k1", "k2", F.col("s.h").alias("h"), F.col("s.p").alias("p"))
    lines = hits.join(item_seeds, "h").select("k1", "k2", "item_id", "i1", "i2", (F.col("p") - F.col("ip")).alias("line")).distinct()
    item_words = items.select(F.col("id").alias("_id"), F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.col("words").alias("item")).dropDuplicates(["_id", "i1", "i2"])
    both = lines.join(item_words, (lines["i1"] == item_words["i1"]) & (lines["i2"] == item_words["i2"]) & lines["item_id"].eqNullSafe(item_words["_id"])).drop("i1", "i2", "_id")
    both = both.join(texts.select("k1", "k2", "words"), ["k1", "k2"])
    start, skip = F.greatest("line", F.lit(0)), F.greatest(-F.col("line"), F.lit(0))
    size = F.least(F.size("item") - skip, F.size("words") - start)
    pairs = both.select("k1", "k2", "item_id", start.cast("int").alias("start_word"), F.size("item").alias("n_item"), F.slice("words", start + 1, size).alias("a"), F.slice("item", skip + 1, size).alias("b"))
    found = pairs.mapInArrow(lean(_verify), "k1 long, k2 int, item_id long, start_word int, n_item int, matched int")
    best = found.groupBy("k1", "k2", "item_id").agg(F.max(F.struct(F.col("matched"), (-F.col("start_word")).alias("s"), F.col("n_item"))).alias("b"))
    rows = held.select(F.col("id").alias("doc_id"), "k1", "k2").join(best, ["k1", "k2"])
    return tables.keep(rows.select("doc_id", "k1", "k2", "item_id", (-F.col("b.s")).alias("start_word"), F.col("b.n_item").alias("n_item"), F.col("b.matched").alias("matched")))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, with their own columns."""
    found = Tables(docs.sparkSession).keep(overlaps(docs, benchmark).select("k1", "k2").distinct())
    text = F.coalesce(docs["text"], F.lit(""))
    held = F.broadcast(found) if found.count() <= BROADCAST_KEYS else found
    return docs.join(held, (F.xxhash64(text) == found["k1"]) & (F.hash(text) == found["k2"]), "left_anti")
