"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking scales the cells' weights to
the target shares of one margin after the other until all three hold. A document is kept
with probability min(1, scale * weight / tokens of its cell); scale is such that the
expected tokens are keep_share of all. The draw is a hash of the document, so that runs
agree.

Topics are clusters of hashed terms, where the table has no column `topic`: a text's words
are counted in TERMS hash bins, the roots of the counts are brought to length 1, and the
nearest of TOPICS centres is the topic. Centres are fitted by k-means on all distinct texts:
their counts are stored once, and each step is a pass over them, of which every task gives
its sums. Sums are of whole numbers, so that partitions do not change them.

Targets: a share for each value of a margin. Margins without one aim at those of a flatter
mix, in which a cell's tokens are weighted by the shares of its source, language and topic
to the power FLATTEN - 1, which lifts what is rare. That mix exists, so its margins can
be reached together. Raking begins at the cells' shares of the tokens as they are; without any
given target it comes to that mix, which stands in where SWEEPS are too few. Shares are
brought to sum 1. A share above 0 for a value that has no tokens is an error, as no weights
give it any; so are targets that raking does not reach within SWEEPS sweeps (TOLERANCE).
With strict=False both are warnings: the shares of missing values go to the others, and the
last weights are used. Values that a given target does not name get no tokens.

Cells up to LOCAL_CELLS are raked on the driver, more of them as DataFrames, by the same
steps with the same result.

Edge cases: null source, lang or topic is the value `unknown`; null texts and texts without
a word have no tokens and, unless the table says otherwise, the topic `none`; a cell without
tokens has probability 0; an empty table gives an empty result; repeated rows are drawn
alike; extra columns stay out, clashing names included.
"""

from __future__ import annotations

import operator
import pickle
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Tables, binary_column, doc_groups, fresh, lean, text_buffer, text_or_empty, words

MARGINS = ("source", "lang", "topic")
FLATTEN = 0.7
KEEP_SHARE = 0.5
SWEEPS, CLOSE, TOLERANCE = 500, 1e-10, 1e-6
LOCAL_CELLS = 100_000
TOPICS, TERMS, ROUNDS = 8, 256, 25
#: Vectors of length 1 are summed as whole multiples of 1 / UNITS.
UNITS = 1 << 30
NO_TOPIC = "none"
Targets = dict[str, dict[str, float]]
#: over(step, merge): step(keys, vectors) of all blocks of texts, merged.
Over = Callable[[Callable, Callable], object]


# ----------------------------------------------------------------------- topics

@dataclass
class Topics:
    centres: np.ndarray  # (topic, term), of length 1

    def of(self, counts: np.ndarray) -> np.ndarray:
        """The topic of each row of term counts; -1 without terms."""
        if not len(self.centres):
            return np.full(len(counts), -1)
        near = np.round(np.sqrt(counts) @ self.centres.T, 9)  # its length does not matter
        return np.where(counts.sum(1) > 0, near.argmax(1), -1)


def term_counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(text, hash bin): how many words of the text fall into the bin."""
    _, _, hashes, woffs = words(buf, offs)
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(woffs))
    return np.bincount(doc * TERMS + (hashes % np.uint64(TERMS)).astype(np.int64), minlength=n * TERMS).reshape(n, TERMS)


def _vectors(counts: np.ndarray) -> np.ndarray:
    """The roots of the counts, brought to length 1."""
    return np.sqrt(counts / counts.sum(1, keepdims=True))


def _sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(topic, term): sums of the vectors next to each centre, in UNITS; the last column: how many."""
    near = np.round(x @ centres.T, 9).argmax(1)
    out = np.zeros((len(centres), TERMS + 1), np.int64)
    for lo in range(0, len(x), 1 << 16):  # below 2**53, where floats are exact
        own = near[lo : lo + (1 << 16), None] == np.arange(len(centres))
        out[:, :-1] += (own.T.astype(np.float64) @ np.rint(x[lo : lo + (1 << 16)] * UNITS)).astype(np.int64)
        out[:, -1] += own.sum(0)
    return out


def _least(keys: np.ndarray, x: np.ndarray, score: np.ndarray) -> tuple[float, int, bytes]:
    """(score, key, vector) of the least score, then key."""
    k = np.lexsort((keys, score))[0]
    return float(score[k]), int(keys[k]), x[k].tobytes()


def _fit(over: Over, topics: int) -> Topics:
    """k-means on the unit sphere, begun at the text next to the mean and then, each time,
    at the text farthest from all centres; a topic's number is its rank by size."""
    total = over(lambda _, x: _sums(x, np.zeros((1, TERMS))), operator.add)
    if total is None:
        return Topics(np.zeros((0, TERMS)))
    texts, mean = int(total[0, -1]), total[0, :-1] / (UNITS * total[0, -1])
    first = over(lambda keys, x: _least(keys, x, -np.round(x @ mean, 9)), min)
    c = np.frombuffer(first[2])[None, :]
    while len(c) < min(topics, texts):
        far = over(lambda keys, x, c=c: _least(keys, x, np.round((x @ c.T).max(1), 9)), min)
        c = np.concatenate([c, np.frombuffer(far[2])[None, :]])
    for left in range(ROUNDS, -1, -1):
        held = over(lambda _, x, c=c: _sums(x, c), operator.add)
        sums = held[:, :-1].astype(np.float64)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        now = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
        if not left or np.array_equal(now, c):
            break
        c = now
    return Topics(c[np.argsort(-held[:, -1], kind="stable")])


def fit_topics(counts: np.ndarray, topics: int = TOPICS) -> Topics:
    """Topics fitted on term counts at hand."""
    x = counts[counts.sum(1) > 0]
    return _fit(lambda step, _: step(np.arange(len(x)), _vectors(x)) if len(x) else None, topics)


def text_topics(docs: DataFrame, topics: int = TOPICS) -> Topics:
    """Topics fitted on all distinct texts of docs (text)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            for lo, hi in doc_groups(offs):
                own = term_counts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]).astype(np.int32)
                has = np.flatnonzero(own.sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo).take(pa.array(has)), binary_column(own[has].view(np.uint8).reshape(-1), np.arange(len(has) + 1) * 4 * TERMS)], ["h", "counts"])

    with Tables(docs.sparkSession) as tables:
        rows = docs.filter(F.octet_length("text") > 0).select(F.encode("text", "UTF-8").alias("t"), F.xxhash64("text").alias("h"))
        stored = tables.table(rows.mapInArrow(lean(counts), "h long, counts binary").distinct())

        def over(step: Callable, merge: Callable) -> object:
            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found = None
                for batch in batches:
                    if batch.num_rows:
                        own = step(batch.column(0).to_numpy(), _vectors(text_buffer(batch.column(1))[0].view(np.int32).reshape(-1, TERMS)))
                        found = own if found is None else merge(found, own)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

            parts = [pickle.loads(r["part"]) for r in stored.mapInArrow(lean(part), "part binary").collect()]
            return reduce(merge, parts) if parts else None

        return _fit(over, topics)


#: Its name when it read a sample.
sampled_topics = text_topics


def with_cells(docs: DataFrame, topics: Topics, keep: tuple[str, ...], out: tuple[str, str, str, str]) -> DataFrame:
    """The `keep` columns of docs with source, lang, topic and the number of words, under
    the names `out`."""
    label = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    held = docs.sparkSession.sparkContext.broadcast(topics)
    inner = [f"_k{i}" for i in range(len(keep))]
    own = "topic" in docs.columns
    given = label(F.col("topic")) if own else F.lit("")
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, inner, strict=True)], label(F.col("source")).alias("_s"), label(F.col("lang")).alias("_l"), given.alias("_p"), F.encode("text", "UTF-8").alias("_t"))
    schema = StructType([StructField(a, docs.schema[c].dataType) for c, a in zip(keep, inner, strict=True)]).add("_s", "string").add("_l", "string").add("_p", "string").add("_n", "long")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*(f"topic{k}" for k in range(len(held.value.centres))), NO_TOPIC])
        for batch in batches:
            buf, offs = text_buffer(batch.column(len(inner) + 3))
            topic, much = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in doc_groups(offs):
                counts = term_counts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                topic.append(held.value.of(counts))
                much.append(counts.sum(1))
            number = np.concatenate(topic)
            topic = batch.column(len(inner) + 2) if own else names.take(pa.array(np.where(number < 0, len(names) - 1, number)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(inner) + 2], topic, pa.array(np.concatenate(much))], [*inner, "_s", "_l", "_p", "_n"])

    told = rows.mapInArrow(lean(cells), schema)
    return told.select(*[F.col(a).alias(c) for c, a in zip((*keep, *out), (*inner, "_s", "_l", "_p", "_n"), strict=True)])


# ----------------------------------------------------------------------- raking

def _gap(message: str, strict: bool) -> None:
    if strict:
        raise ValueError(message)
    warnings.warn(message, stacklevel=3)


def goals(have: dict[str, float], given: dict[str, float], margin: str, strict: bool) -> dict[str, float]:
    """Target shares of all values (have: tokens by value), summing to 1."""
    missing = sorted(k for k, v in given.items() if v > 0 and not have.get(k, 0) > 0)
    if missing:
        _gap(f"no tokens of {margin} {', '.join(missing[:20])}: this target cannot be reached", strict)
    raw = {k: float(given.get(k, 0.0)) if v > 0 else 0.0 for k, v in have.items()}
    total = sum(raw.values())
    return {k: v / total if total > 0 else 0.0 for k, v in raw.items()}


def flatter(tokens: np.ndarray, codes: list[np.ndarray], flatten: float) -> np.ndarray:
    """Weights of the flatter mix, summing to 1."""
    weight = tokens / max(tokens.sum(), 1e-300)
    out = weight.copy()
    for code in codes:
        share = np.bincount(code, weight)
        out *= np.power(share, flatten - 1.0, out=np.zeros_like(share), where=share > 0)[code]
    return out / max(out.sum(), 1e-300)


def rake(weight: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Weights of cells whose margins are the targets, and the largest gap to one."""
    worst = 0.0
    for _ in range(SWEEPS):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, weight, len(target))
            worst = max(worst, float(np.abs(have - target).max(initial=0.0)))
            weight = weight * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
        if worst < CLOSE:
            break
    return weight, worst


def probabilities(tokens: np.ndarray, weight: np.ndarray, keep_share: float) -> np.ndarray:
    """min(1, scale * weight / tokens), with expected tokens of keep_share of all: cells that
    reach 1 are set apart and the scale is found anew for the others, until none is added."""
    ratio = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    goal, whole, scale = keep_share * tokens.sum(), -1, 0.0
    full = np.zeros(len(tokens), bool)
    while full.sum() != whole:
        whole, left = full.sum(), weight[~full].sum()
        if left <= 0:
            break
        scale = (goal - tokens[full].sum()) / left
        full |= scale * ratio >= 1
    return np.where(full, 1.0, scale * ratio)


def _local(cells: DataFrame, targets: Targets, flatten: float, keep_share: float, strict: bool) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: [r[m] for m in MARGINS])
    if not rows:
        return cells.select(*MARGINS, F.lit(0.0).alias("p"))
    tokens = np.array([float(r["tokens"]) for r in rows])
    values, codes = zip(*(np.unique([r[m] for r in rows], return_inverse=True) for m in MARGINS), strict=True)
    flat = flatter(tokens, codes, flatten)
    aims = []
    for m, names, code in zip(MARGINS, values, codes, strict=True):
        if targets.get(m):
            goal = goals(dict(zip(names.tolist(), np.bincount(code, tokens, len(names)), strict=True)), targets[m], m, strict)
            aims.append(np.array([goal[v] for v in names.tolist()]))
        else:
            aims.append(np.bincount(code, flat, len(names)))
    weight, worst = rake(tokens / max(tokens.sum(), 1e-300), list(codes), aims)
    if worst > TOLERANCE and not any(targets.values()):
        weight = flat
    elif worst > TOLERANCE and tokens.sum():
        _gap(f"the targets contradict each other: a share is still {worst:.2g} off after {SWEEPS} sweeps", strict)
    p = probabilities(tokens, weight, keep_share)
    table = [(*(r[m] for m in MARGINS), float(x)) for r, x in zip(rows, p, strict=True)]
    return F.broadcast(cells.sparkSession.createDataFrame(table, "source string, lang string, topic string, p double"))


def _spread(cells: DataFrame, targets: Targets, flatten: float, keep_share: float, strict: bool, tables: Tables) -> DataFrame:
    """The same over a DataFrame of cells: a step is a sum and a join by margin."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0.0) or 1.0
    now = tables.table(cells.withColumn("w", F.col("tokens") / F.lit(total)))
    flat = now
    for m in MARGINS:
        share = cells.groupBy(m).agg((F.sum("tokens") / F.lit(total)).alias("share"))
        flat = flat.join(share.select(m, F.when(F.col("share") > 0, F.pow("share", F.lit(flatten - 1.0))).otherwise(0.0).alias("f")), m).withColumn("w", F.col("w") * F.col("f")).drop("f")
    flat = tables.table(flat)
    every = float(flat.agg(F.sum("w")).first()[0] or 0.0) or 1.0
    flat = tables.table(flat.withColumn("w", F.col("w") / F.lit(every)))
    aims = []
    for m in MARGINS:
        if targets.get(m):
            have = {r[m]: float(r["t"]) for r in cells.filter(F.col(m).isin(list(targets[m]))).groupBy(m).agg(F.sum("tokens").alias("t")).collect()}
            goal = goals(have, targets[m], m, strict)
            aim = now.select(m).distinct().join(cells.sparkSession.createDataFrame(list(goal.items()) or [("", 0.0)], f"{m} string, goal double"), m, "left").fillna(0.0, ["goal"])
        else:
            aim = flat.groupBy(m).agg(F.sum("w").alias("goal"))
        aims.append(tables.table(aim))
    worst = 0.0
    for _ in range(SWEEPS):
        worst = 0.0
        for m, aim in zip(MARGINS, aims, strict=True):
            have = tables.table(now.groupBy(m).agg(F.sum("w").alias("have")).join(aim, m))
            worst = max(worst, float(have.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0] or 0.0))
            factor = have.select(m, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("f"))
            before, now = now, tables.table(now.join(factor, m).withColumn("w", F.col("w") * F.col("f")).drop("f"))
            tables.drop(before)
            tables.drop(have)
        if worst < CLOSE:
            break
    if worst > TOLERANCE and not any(targets.values()):
        now = flat
    elif worst > TOLERANCE:
        _gap(f"the targets contradict each other: a share is still {worst:.2g} off after {SWEEPS} sweeps", strict)
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    scale, whole, full = 0.0, -1, F.lit(False)
    while True:
        r = now.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("w")))).first()
        if r[0] == whole or not (r[2] or 0.0) > 0:
            break
        whole, scale = r[0], (keep_share * total - float(r[1] or 0.0)) / r[2]
        full = F.lit(scale) * ratio >= 1  # the scale only grows
    return tables.keep(now.select(*MARGINS, F.when(full, 1.0).otherwise(F.lit(scale) * ratio).alias("p")))


# ----------------------------------------------------------------- the operator

def _draw() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fitted(docs: DataFrame, targets: Targets | None, flatten: float, keep_share: float, local_cells: int, strict: bool, tables: Tables) -> tuple[Topics, DataFrame, DataFrame]:
    """(topics, rows (doc_id, u, source, lang, topic, tokens), probabilities by cell)."""
    own = ["topic"] if "topic" in docs.columns else []
    topics = Topics(np.zeros((0, TERMS))) if own else text_topics(docs)
    rows = tables.keep(with_cells(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", *own, _draw().alias("u")), topics, ("doc_id", "u"), (*MARGINS, "tokens")))
    cells = tables.keep(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    if cells.count() <= local_cells:
        return topics, rows, _local(cells, targets or {}, flatten, keep_share, strict)
    return topics, rows, _spread(cells, targets or {}, flatten, keep_share, strict, tables)


def mix(docs: DataFrame, targets: Targets | None = None, flatten: float = FLATTEN, keep_share: float = KEEP_SHARE, local_cells: int = LOCAL_CELLS, strict: bool = True) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p and kept of every document, and u, the draw."""
    with Tables(docs.sparkSession) as tables:
        _, rows, p = _fitted(docs, targets, flatten, keep_share, local_cells, strict, tables)
        return rows.join(p, list(MARGINS), "left").select("doc_id", *MARGINS, "tokens", F.col("p"), "u", (F.col("u") < F.col("p")).alias("kept"))


def mixed_documents(docs: DataFrame, targets: Targets | None = None, flatten: float = FLATTEN, keep_share: float = KEEP_SHARE, local_cells: int = LOCAL_CELLS, strict: bool = True) -> DataFrame:
    """The documents that mix() keeps, with their own columns. Texts are read again, not
    shuffled: a document's cell follows from its row."""
    with Tables(docs.sparkSession) as tables:
        topics, _, p = _fitted(docs, targets, flatten, keep_share, local_cells, strict, tables)
    names = fresh(docs.columns, *MARGINS, "tokens")
    u, q = fresh([*docs.columns, *names], "u", "p")
    held = p.select(*[F.col(m).alias(f"_{n}") for m, n in zip(MARGINS, names[:3], strict=True)], F.col("p").alias(q))
    rows = with_cells(docs.withColumn(u, _draw()), topics, (*docs.columns, u), tuple(names))
    same = [F.col(n) == F.col(f"_{n}") for n in names[:3]]
    return rows.join(held, same[0] & same[1] & same[2]).filter(F.col(u) < F.col(q)).select(*docs.columns)
