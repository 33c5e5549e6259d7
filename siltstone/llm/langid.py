"""Language identification by prediction by partial matching.

For each language a context tree of byte strings up to MAX_ORDER long holds how often
each byte followed. The statistics are frozen after training. A byte costs
-log2 P(byte | longest seen context); a byte that the context has not seen pays the
context's escape probability (distinct / (total + distinct)) and is coded in the next
shorter context, down to 1/256 for any byte. The language with the shortest exact code
for the whole text wins.

As statistics are frozen, the cost of a byte depends on its context node alone. The
trees of all languages are merged in one trie of all contexts that were seen twice. Only
bytes that some language has seen in a context have a row of costs there, one for each
language; any other byte has the row of the next shorter context that has seen it, and
pays the escapes on the way, which are summed beforehand. So scoring is a walk of
MAX_ORDER table look-ups and two rows for a byte, some 100 kB of text at a time.

The classifier is fitted on a bounded sample: whole distinct texts, at most TRAIN_BYTES for
each language, those of the lowest hashes. Texts longer than that are not trained on, but
all are scored. Nothing else bounds the trie: what it holds follows from the sample. The
model is broadcast, so one of over MODEL_BYTES (hundreds of languages) is refused with
an error that says so; a smaller train_bytes mends that.

Edge cases: a null text or one without a letter is `und` with score 0; with no training
rows every text is `und`; an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import KERNEL_BYTES, Tables, doc_groups, lean, text_buffer

MAX_ORDER = 3
TRAIN_BYTES = 600_000
MODEL_BYTES = 512 << 20
UNDETERMINED = "und"


@dataclass
class PpmModel:
    langs: list[str]
    classes: np.ndarray  # byte -> symbol class; 0: never seen
    first: list[int]  # first node of each depth
    child: np.ndarray  # node * n_classes + class -> deeper node or the node itself
    row: np.ndarray  # node * n_classes + class -> row of cost
    depth: np.ndarray  # of each row's context
    cost: np.ndarray  # (row, language) -> bits
    escape: np.ndarray  # (node * (order + 1) + depth, language) -> bits of the escapes down to that depth

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.child, self.row, self.depth, self.cost, self.escape))

    @property
    def n_classes(self) -> int:
        return int(self.classes.max()) + 1 if len(self.classes) else 1

    def bits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code lengths (document, language) of whole documents."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        order = len(self.first) - 1
        n = self.n_classes
        for lo in range(0, int(offs[-1]), KERNEL_BYTES):
            hi = min(lo + KERNEL_BYTES, int(offs[-1]))
            back = max(0, lo - order)
            cls = self.classes[buf[back:hi]].astype(np.int32)
            d0, d1 = int(np.searchsorted(offs, lo, side="right")) - 1, int(np.searchsorted(offs, hi, side="left"))
            starts = offs[d0:d1]
            node = np.zeros(hi - lo, np.int32)
            for d in range(1, order + 1):
                prev = np.zeros(hi - lo, np.int32)
                have = min(d, lo - back)
                prev[d - have :] = cls[lo - back - have : hi - back - d]
                for j in range(d):  # no context from before the document
                    at = starts + j - lo
                    prev[at[(at >= 0) & (at < hi - lo)]] = 0
                down = self.child[node * n + prev]
                node = down if d == 1 else np.where(node >= self.first[d - 1], down, node)
            row = self.row[node * n + cls[lo - back :]]
            bits = np.take(self.cost, row, axis=0)
            bits += np.take(self.escape, node * (order + 1) + self.depth[row], axis=0)
            edges = np.clip(starts - lo, 0, hi - lo)
            full = np.diff(np.append(edges, hi - lo)) > 0
            if full.any():
                out[d0:d1][full] += np.add.reduceat(bits, edges[full], axis=0, dtype=np.float64)
        return out


def _grams(buf: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """Every k bytes inside a document, as one number."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for j in range(k):
        code = (code << np.uint64(8)) | buf[j : j + n].astype(np.uint64)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))
    return code[left[:n] >= k]


def fit_ppm(texts: dict[str, list[bytes]], max_order: int = MAX_ORDER) -> PpmModel:
    """Frozen statistics of the given texts; languages in alphabetical order."""
    langs = sorted(texts)
    bufs = {lang: (np.frombuffer(b"".join(texts[lang]), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts[lang]])]).astype(np.int64)) for lang in langs}
    seen = np.zeros(256, bool)
    for buf, _ in bufs.values():
        seen[buf] = True
    classes = np.where(seen, np.cumsum(seen), 0).astype(np.uint16)
    n = int(classes.max()) + 1 if len(langs) else 1
    counts = {(lang, d): np.unique(_grams(*bufs[lang], d + 1), return_counts=True) for lang in langs for d in range(max_order + 1)}
    none = np.zeros(0, np.uint64)
    # contexts of each depth that were seen twice; a suffix was seen at least as often
    levels = [np.zeros(1, np.uint64)]
    for d in range(1, max_order + 1):
        ctx, at = np.unique(np.concatenate([none, *(counts[lang, d][0] >> np.uint64(8) for lang in langs)]), return_inverse=True)
        much = np.bincount(at, np.concatenate([none, *(counts[lang, d][1] for lang in langs)]), len(ctx))
        levels.append(ctx[much >= 2])
    first = [0, *np.cumsum([len(x) for x in levels])[:-1].tolist()]
    total = first[-1] + len(levels[-1])
    child, row = np.repeat(np.arange(total, dtype=np.int32), n), np.zeros((total, n), np.int32)
    escape = np.zeros((total, max_order + 1, len(langs)), np.float32)
    cost, depth = [np.zeros((1, len(langs)), np.float32)], [np.zeros(1, np.int8)]
    rows = 1
    for d, level in enumerate(levels):
        ids = first[d] + np.arange(len(level))
        # what each language has seen here: its own counts and escapes
        grams = np.unique(np.concatenate([none, *(counts[lang, d][0] for lang in langs)]))
        grams = grams[np.isin(grams >> np.uint64(8), level)]
        node = np.searchsorted(level, grams >> np.uint64(8))
        sym = classes[(grams & np.uint64(255)).astype(np.int64)]
        own = np.full((len(level), len(langs)), 0.0, np.float32)
        coded = np.full((len(grams), len(langs)), np.nan, np.float32)
        for k, lang in enumerate(langs):
            code, much = counts[lang, d]
            at = np.searchsorted(grams, code)
            ok = grams[np.minimum(at, len(grams) - 1)] == code if len(grams) else np.zeros(len(code), bool)
            at, much = at[ok], much[ok].astype(np.float64)
            sums, kinds = np.bincount(node[at], much, len(level)), np.bincount(node[at], minlength=len(level))
            has = kinds > 0
            own[has, k] = -np.log2(kinds[has] / (sums[has] + kinds[has]))
            coded[at, k] = -np.log2(much / (sums[node[at]] + kinds[node[at]]))
        if d == 0:
            cost[0][0] = 8.0 + (own[0] if len(own) else 0.0)  # a byte that no language has seen
            below = np.broadcast_to(np.float32(8.0), coded.shape)
        else:
            parent = first[d - 1] + np.searchsorted(levels[d - 1], level & np.uint64(256 ** (d - 1) - 1))
            oldest = classes[(level >> np.uint64(8 * (d - 1))).astype(np.int64)].astype(np.int64)
            child[parent * n + oldest] = ids
            row[ids] = row[parent]
            escape[ids] = escape[parent]
            escape[ids, :d] += own[:, None, :]
            have = np.concatenate(cost)
            from_ = row[parent[node], sym]
            shorter = np.concatenate(depth)[from_].astype(np.int64)
            below = have[from_] + escape[parent[node], shorter]
        cost.append(np.where(np.isnan(coded), own[node] + below, coded).astype(np.float32))
        depth.append(np.full(len(grams), d, np.int8))
        row[ids[node], sym] = rows + np.arange(len(grams))
        rows += len(grams)
    return PpmModel(langs, classes, first, child, row.reshape(-1), np.concatenate(depth), np.concatenate(cost), escape.reshape(total * (max_order + 1), len(langs)))


def training_texts(rows: DataFrame, train_bytes: int = TRAIN_BYTES) -> dict[str, list[bytes]]:
    """Whole texts of rows (text, lang), at most about train_bytes for each language,
    in the order of a hash of the text. Copies count once."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    size = F.octet_length("text")
    rows = rows.filter(size.between(1, train_bytes))
    u = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # copies are one; the full hash and the size stand for a text
    with Tables(rows.sparkSession) as tables:
        texts = tables.table(rows.select("lang", F.xxhash64("text").alias("h"), size.alias("b"), u.alias("u")).distinct())
        whole = {r["lang"]: r["b"] for r in texts.groupBy("lang").agg(F.sum("b").alias("b")).collect()}
        if not whole:
            return {}
        share = {lang: min(1.0, 2.0 * train_bytes / b) for lang, b in whole.items()}
        below = lambda: F.create_map(*[x for lang, p in share.items() for x in (F.lit(lang), F.lit(p))])[F.col("lang")]
        while True:  # few long texts may leave a draw short
            drawn = {r["lang"]: r["b"] for r in texts.filter(F.col("u") < below()).groupBy("lang").agg(F.sum("b").alias("b")).collect()}
            short = [lang for lang, b in whole.items() if share[lang] < 1.0 and drawn.get(lang, 0) < train_bytes]
            if not short:
                break
            share |= {lang: min(1.0, 2 * share[lang]) for lang in short}
    sample = rows.filter(u < below()).select("lang", F.encode("text", "UTF-8").alias("t"), u.alias("u")).distinct()
    out: dict[str, list[bytes]] = {}
    room: dict[str, int] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["u"], r["t"])):
        if len(r["t"]) <= room.setdefault(r["lang"], train_bytes):
            room[r["lang"]] -= len(r["t"])
            out.setdefault(r["lang"], []).append(bytes(r["t"]))
    return out


def has_letter(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: PpmModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: tuple[str, ...] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """The `keep` columns of docs with lang_pred, score (0 to 1: the language's share of
    the probability that all languages give the text) and bits_per_byte, under the
    names `out`."""
    spark = docs.sparkSession
    if model.nbytes > MODEL_BYTES:
        raise ValueError(f"the model of {len(model.langs)} languages has {model.nbytes >> 20} MB, more than MODEL_BYTES: fit it with a smaller train_bytes")
    held = spark.sparkContext.broadcast(model)
    inner = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, inner, strict=True)], has_letter(F.col(text)).alias("_ok"), *([] if text in keep else [F.col(text).alias("_t")]))
    at = keep.index(text) if text in keep else len(inner) + 1
    schema = StructType([StructField(a, docs.schema[c].dataType) for c, a in zip(keep, inner, strict=True)]).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            buf, offs = text_buffer(batch.column(at))
            bits = np.zeros((batch.num_rows, max(1, len(m.langs))))
            for lo, hi in doc_groups(offs) if m.langs else ():
                bits[lo:hi] = m.bits(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            best = bits.argmin(1)
            least = bits[np.arange(len(bits)), best]
            sure = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
            none = ~batch.column(len(inner)).to_numpy(zero_copy_only=False) | (not m.langs)
            names = pa.array([*(m.langs or [""]), UNDETERMINED]).take(pa.array(np.where(none, max(1, len(m.langs)), best)))
            rate = least / np.maximum(np.diff(offs), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(inner)], names, pa.array(np.where(none, 0.0, np.round(sure, 9))), pa.array(np.where(none, 0.0, np.round(rate, 6)))], [*inner, "lang_pred", "score", "bits_per_byte"])

    told = rows.mapInArrow(lean(score), schema)
    return told.select(*[F.col(a).alias(c) for c, a in zip((*keep, *out), (*inner, "lang_pred", "score", "bits_per_byte"), strict=True)])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def predict_documents(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document."""
    model = fit_ppm(training_texts(docs.filter(~held_out(F.col("doc_id"))), train_bytes))
    out = identify(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
