"""Exact Jaccard join of documents on distinct five-word shingles.

Two sets of which the intersection is at least 80 % of the union share, in any common
order, k of their first floor(n / 5) + k tokens. Both filters rest on that:

1. Extended prefixes. In hash order, each text's first floor(n / 5) + ceil(n / 16)
   tokens are dealt by hash. A text goes on only if enough of them occur in another
   text too, which removes all texts of mainly own words without a count of all tokens.
2. Token combinations. The texts that are left are counted exactly. In the order rarest
   first, with the prefix extended by one (k = 2), rare tokens are indexed singly and
   frequent ones in pairs. Long texts would have too many pairs: from SINGLES_FROM
   shingles on, frequent tokens are indexed singly as well, and texts up to
   1.25 * SINGLES_FROM have pairs, so that any two that can link meet in either index.

The index gives candidate pairs: sets that share an entry and whose sizes allow a link.
Only connected groups are asked for, so pairs inside one that is known already are no
candidates. First each set is compared with one leader, the first of all that share an
entry with it: one pair a set. Groups of copies, of whatever size, mostly come together so.
This is done again with other leaders as long as each round halves the sets that share
an entry with another group. What is left is compared in blocks: sets with one leader are
a family and lie together, in blocks of at most BLOCK sets, and each pair of blocks that has
a candidate pair in some entry is compared once, by one product of token incidence
matrices. So work follows the entries, not the connected groups of candidates, and no
pairs are listed but those of single sets. Equal texts and equal sets are one throughout:
classes are of representatives, and rows take their class by membership. 64 bits stand for
a word, a shingle and a set.

Edge cases: a null text or one without words has no shingles and links with nothing; one
of fewer than five words has its sequence as the only shingle; repeated rows each get
the same class; a null doc_id counts as no id (a class takes its smallest other id);
an empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Known, Tables, bucket_count, bucket_rows, components, distinct_sorted, doc_groups, fresh, in_buckets, lean, mix64, shingles, shuffle_parts, text_buffer, text_or_empty, text_volume, words

WORDS = 5
#: A token in more sets than this is frequent.
FREQUENT = 64
SINGLES_FROM = 80
#: Sets of a family that are compared in one block.
BLOCK = 512
#: Keys up to this number are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000
BLOCK_BYTES = 16 << 20


def text_keys() -> list[Column]:
    """96 bits that stand for a text."""
    text = text_or_empty()
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def _sets(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Document ranges with their distinct shingles in hash order, and offsets."""
    for lo, hi in doc_groups(offs):
        _, _, hashes, woffs = words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        yield lo, hi, *distinct_sorted(*shingles(hashes, woffs, WORDS))


def _runs(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, key) in order, and the number of keys of each one's token."""
    order = np.lexsort((keys, tokens))
    t, k = tokens[order], keys[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    t, k = t[new], k[new]
    edge = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(t)))
    return t, k, np.repeat(size, size)


_DEALT = "bucket int, doc_id long, k1 long, k2 int, n int, shared int, tokens binary, keys binary"


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and its extended prefix by bucket. A token that several
    texts of the batch have counts at once, and goes on without their keys; one that the
    task has found so before counts at once and stays."""
    known = Known(0)
    for batch in batches:
        ids, k1 = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
        buf, offs = text_buffer(batch.column(3))
        n = np.zeros(len(k1), np.int64)
        tokens, keys = [], []
        for lo, hi, values, at in _sets(buf, offs):
            size = n[lo:hi] = np.diff(at)
            reach = size // 5 + (size + 15) // 16
            doc = np.repeat(np.arange(hi - lo), size)
            use = np.arange(len(values)) - at[doc] < reach[doc]
            tokens.append(values[use])
            keys.append(k1[lo:hi][doc[use]])
        t, k, much = _runs(np.concatenate([np.zeros(0, np.uint64), *tokens]), np.concatenate([np.zeros(0, np.int64), *keys]))
        before = known.find(t)[0]
        own, count = np.unique(k[(much > 1) | before], return_counts=True)
        at = np.minimum(np.searchsorted(own, k1), max(len(own) - 1, 0))
        shared = np.where(own[at] == k1, count[at], 0) if len(own) else np.zeros(len(k1), np.int64)
        # a text's rows say the same; documents are spread, whatever their texts
        spread = (mix64(ids.view(np.uint64) ^ k1.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        none = pa.nulls(len(k1), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(spread), batch.column(0), batch.column(1), batch.column(2), pa.array(n.astype(np.int32)), pa.array(shared.astype(np.int32)), none, none], _names(_DEALT))
        first = np.append(True, t[1:] != t[:-1]) if len(t) else np.zeros(0, bool)
        known.add(t[first & (much > 1) & ~before])
        first &= ~before
        # prefixes hold small hashes: mixed again, they spread over the buckets
        rows = list(bucket_rows(mix64(t[first]), buckets, t[first], np.where(much > 1, 0, k)[first]))
        if rows:
            b, blobs = zip(*rows, strict=True)
            null = [pa.nulls(len(b), x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *null, pa.array([x[1] for x in blobs], pa.binary()), pa.array([x[2] for x in blobs], pa.binary())], _names(_DEALT))


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows as they come, then (k1, shared) of the buckets' tokens."""
    tokens, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in batches:
        blob = batch.column(6).is_valid()
        yield batch.filter(pa.compute.invert(blob)).select(_names(_DEALT)[1:6])
        held = batch.filter(blob)
        tokens.append(text_buffer(held.column(6))[0].view(np.uint64).copy())
        keys.append(text_buffer(held.column(7))[0].view(np.int64).copy())
    _, k, much = _runs(np.concatenate(tokens), np.concatenate(keys))
    own, count = np.unique(k[(much > 1) & (k != 0)], return_counts=True)
    null = lambda t: pa.nulls(len(own), t)
    yield pa.RecordBatch.from_arrays([null(pa.int64()), pa.array(own), null(pa.int32()), null(pa.int32()), pa.array(count.astype(np.int32))], _names(_DEALT)[1:6])


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(2))
        for lo, hi, values, at in _sets(buf, offs):
            names = np.array([xxhash.xxh3_64_intdigest(values[at[i] : at[i + 1]].tobytes()) for i in range(hi - lo)], np.uint64).view(np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(names), pa.array(np.diff(at).astype(np.int32)), tokens], ["k1", "k2", "s", "n", "tokens"])


def index_entries(sets: DataFrame) -> DataFrame:
    """(s, n, sig) of sets (s, n, tokens): single rare tokens and pairs of frequent ones, of
    the prefix extended by one token, rarest first."""
    token = sets.select("s", "n", F.explode("tokens").alias("t"))
    often = token.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    shared = token.join(often, "t").groupBy("s", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("shared"))  # a set's own tokens
    own = F.col("n") - F.size("shared")
    reach = F.floor(F.col("n") / 5).cast("int") + F.lit(2) - own
    prefix = shared.filter(reach > 0).select("s", "n", F.slice("shared", F.lit(1), reach).alias("p"))
    rare = F.transform(F.filter("p", lambda x: x["df"] <= FREQUENT), lambda x: F.xxhash64(x["t"]))
    often_p = prefix.withColumn("rare", rare).withColumn("often", F.transform(F.filter("p", lambda x: x["df"] > FREQUENT), lambda x: x["t"]))
    pairs = F.flatten(F.transform("often", lambda x: F.transform(F.filter("often", lambda y: y > x), lambda y: F.xxhash64(x, y))))
    singles = F.transform("often", lambda x: F.xxhash64(x, F.lit("single")))
    none = F.array().cast("array<bigint>")
    sigs = F.concat("rare", F.when(F.col("n") * 4 <= SINGLES_FROM * 5, pairs).otherwise(none), F.when(F.col("n") >= SINGLES_FROM * 4 // 5, singles).otherwise(none))
    return often_p.select("s", "n", F.explode(sigs).alias("sig"))


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) over a symmetric matrix of links."""
    free, out = np.ones(len(links), bool), []
    for root in range(len(links)):
        if not free[root]:
            continue
        free[root] = False
        ahead = [root]
        while ahead:
            new = np.flatnonzero(links[ahead].any(0) & free)
            free[new] = False
            out += [(int(x), root) for x in new]
            ahead = new.tolist()
    return out


def _common(parts: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by incidence matrices a few columns wide."""
    m = len(parts)
    values = np.concatenate(parts)
    who = np.repeat(np.arange(m), [len(x) for x in parts])
    _, column, much = np.unique(values, return_inverse=True, return_counts=True)
    use = much[column] > 1
    who, column = who[use], np.unique(column[use], return_inverse=True)[1]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    width = max(256, min(4096, (8 << 20) // (4 * m)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[who[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each pair of blocks (x, y) of the partition, which comes sorted by them."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        names, own = rows["s"].to_numpy(), rows["block"].to_numpy()
        column = rows["tokens"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        at, flat = column.offsets.to_numpy(), column.values.to_numpy()
        parts = [flat[at[k] : at[k + 1]] for k in range(len(names))]
        size = np.array([len(x) for x in parts], np.float32)
        both = _common(parts)
        ok = 100 * both >= 80 * (size[:, None] + size - both)
        if rows["x"][0].as_py() != rows["y"][0].as_py():
            ok &= own[:, None] != own  # pairs inside a block are that block's
        np.fill_diagonal(ok, False)
        found = _forest(ok)
        if not found:
            return None
        a, b = np.array(found).T
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], ["a", "b"])

    def ready(table: pa.Table, whole: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
        key = np.stack([table[c].to_numpy() for c in ("x", "y")])
        edge = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        ends = np.append(edge[1:], table.num_rows)
        if not whole:
            edge, ends = edge[:-1], ends[:-1]
        out = [x for lo, hi in zip(edge, ends, strict=True) if hi - lo > 1 and (x := links(table.slice(lo, hi - lo).combine_chunks())) is not None]
        return out, table.slice(ends[-1]) if len(ends) else table

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            done, rest = ready(pa.Table.from_batches(held), False)
            yield from done
            held = rest.to_batches()
    if held:
        yield from ready(pa.Table.from_batches(held), True)[0]


def may_link(n: str, m: str) -> Column:
    """Whether two sets of these sizes can have an intersection of 80 % of the union."""
    return F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * 80


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of which the sets link."""
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("s").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    return both.filter(common * 100 >= (F.size("ta") + F.size("tb") - common) * 80).select("a", "b")


def open_entries(entries: DataFrame, groups: DataFrame | None, tables: Tables) -> DataFrame:
    """The entries (s, n, sig) of sets that are of different groups, with c, the group. What
    entries are joined to is a table each time: joins of two plain shuffles are what Spark
    can split where one key is hot."""
    if groups is None:
        grouped = entries.withColumn("c", F.col("s"))
    else:
        grouped = entries.join(groups.withColumnRenamed("node", "s"), "s", "left").select("s", "n", "sig", F.coalesce("label", "s").alias("c"))
    mixed = grouped.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter(F.col("low") != F.col("high"))
    return grouped.join(tables.table(mixed.select("sig")), "sig", "left_semi")


def homes(entries: DataFrame, number: int, tables: Tables) -> DataFrame:
    """(s, n, c, home, home_n, home_c): of all sets that share an entry with s, itself
    included, the first by a hash that changes with `number`. Sets of one family, which
    share most entries, mostly have one home."""
    first = F.min(F.struct(F.xxhash64("s", F.lit(number)).alias("h"), F.col("s").alias("s"), F.col("n").alias("n"), F.col("c").alias("c"))).alias("lead")
    leads = tables.table(entries.groupBy("sig").agg(first))
    found = entries.join(leads, "sig").groupBy("s").agg(F.min("lead").alias("lead"), F.first("n").alias("n"), F.first("c").alias("c"))
    return found.select("s", "n", "c", F.col("lead.s").alias("home"), F.col("lead.n").alias("home_n"), F.col("lead.c").alias("home_c"))


def block_pairs(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """(x, y) with x <= y: the pairs of blocks (s, block) that hold, one each or both, two
    sets of different groups that share an entry and whose sizes allow a link."""
    held = entries.join(blocks.select("s", "block"), "s").groupBy("sig", "block")
    held = held.agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    other = held.select("sig", *[F.col(c).alias(f"{c}2") for c in held.columns if c != "sig"])
    differ = (F.col("low") != F.col("high2")) | (F.col("high") != F.col("low2"))
    sizes = (F.col("most").cast("long") * 100 >= F.col("least2").cast("long") * 80) & (F.col("most2").cast("long") * 100 >= F.col("least").cast("long") * 80)
    across = held.join(other, "sig").filter((F.col("block") < F.col("block2")) & differ & sizes).select(F.col("block").alias("x"), F.col("block2").alias("y"))
    inside = held.filter((F.col("k") > 1) & (F.col("low") != F.col("high"))).select(F.col("block").alias("x"), F.col("block").alias("y"))
    return across.unionByName(inside).distinct()


def block_links(entries: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """Links (a, b) that connect all open sets which link. The sets of a home are dealt into
    blocks of at most about BLOCK sets and BLOCK_BYTES; each pair of blocks that has a
    candidate pair is compared once, by one product of incidence matrices."""
    spark = sets.sparkSession
    at = tables.table(homes(entries, 0, tables).select("s", "n", "home"))
    many = at.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.col("n").cast("long") * 8) / BLOCK_BYTES)).alias("nb"))
    blocks = tables.table(at.join(tables.table(many), "home").select("s", "n", F.xxhash64("home", F.pmod(F.xxhash64("s"), F.col("nb"))).alias("block")))
    pairs = tables.table(block_pairs(entries, blocks))
    size = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n").cast("double") * 8).alias("b"), F.first("s").alias("only"))
    x, y = (size.select(*[F.col(c).alias(f"{k}{c}") for c in size.columns]) for k in "xy")
    sized = tables.table(pairs.join(x, F.col("x") == F.col("xblock")).join(y, F.col("y") == F.col("yblock")))
    lone = (F.col("xm") == 1) & (F.col("ym") == 1)
    singles = verified(sized.filter(lone).select(F.col("xonly").alias("a"), F.col("yonly").alias("b")), sets)
    rest = sized.filter(~lone).select("x", "y", "xb", "yb")
    volume = rest.agg(F.sum(F.col("xb") + F.col("yb"))).first()[0] or 0.0
    sides = rest.select("x", "y", F.col("x").alias("block")).unionByName(rest.filter("x != y").select("x", "y", F.col("y").alias("block")))
    dealt = sides.join(blocks.select("block", "s"), "block").join(sets.select("s", "tokens"), "s").select("x", "y", "block", "s", "tokens")
    parts = shuffle_parts(spark, volume, BLOCK_BYTES)
    found = dealt.repartition(parts, "x", "y").sortWithinPartitions("x", "y").mapInArrow(lean(_verify), "a long, b long")
    return found.unionByName(singles)


def jaccard_links(sets: DataFrame, tables: Tables) -> DataFrame:
    """(node, label): the connected groups of the sets (s, n, tokens) that link."""
    entries = tables.table(index_entries(sets))
    links, groups, before, number = None, None, float("inf"), 0
    while True:
        left = tables.table(open_entries(entries, groups, tables))
        open_ = left.select("s").distinct().count()
        rest = open_ > before / 2
        if not open_ and groups is not None:
            return groups
        if rest:
            found = block_links(left, sets, tables)
        else:
            number += 1
            led = homes(left, number, tables).filter((F.col("c") != F.col("home_c")) & may_link("n", "home_n"))
            found = verified(led.select(F.least("s", "home").alias("a"), F.greatest("s", "home").alias("b")).distinct(), sets)
        links = tables.table(found if links is None else links.unionByName(found))
        groups = components(links)
        if rest:
            return groups
        before = open_


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and k1, k2, which stand for
    its text."""
    with Tables(docs.sparkSession) as tables:
        volume = 0.6 * text_volume(docs)
        buckets = bucket_count(docs.sparkSession, volume)
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), text_or_empty().alias("text"))
        dealt = keyed.select("doc_id", "k1", "k2", F.encode("text", "UTF-8").alias("t")).mapInArrow(lean(lambda it: _deal(it, buckets)), _DEALT)
        counted = tables.table(in_buckets(dealt, volume, _count_shared, "doc_id long, k1 long, k2 int, n int, shared int"))

        texts = counted.filter(F.col("n").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
        shared = counted.groupBy("k1").agg(F.sum("shared").alias("shared"), F.max("n").alias("n"))
        need = F.floor((F.floor((F.col("n") * 8 + 9) / 10) + 15) / 16)
        alive = tables.table(shared.filter((F.col("n") > 0) & (F.col("shared") >= need)).select("k1"))
        few = alive.count() <= BROADCAST_KEYS
        left = keyed.join(F.broadcast(alive) if few else alive, "k1", "left_semi")
        reps = texts.join(alive, "k1", "left_semi").select("k1", "k2", F.col("rep").alias("doc_id"))
        # one row of each text: that of its smallest id
        once = left.join(F.broadcast(reps) if few else reps, (left["k1"] == reps["k1"]) & (left["k2"] == reps["k2"]) & left["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi")
        named = tables.table(once.select("k1", "k2", F.encode("text", "UTF-8").alias("t")).mapInArrow(lean(_to_sets), "k1 long, k2 int, s long, n int, tokens array<bigint>"))
        sets = tables.table(named.groupBy("s", "n").agg(F.first("tokens").alias("tokens")))
        groups = jaccard_links(sets, tables)

        # classes of texts: by link, else by equal sets, else each text alone
        of = named.select("k1", "k2", "s").distinct().join(groups.select(F.col("node").alias("s"), "label"), "s", "left").select("k1", "k2", F.coalesce("label", "s").alias("c"))
        of = tables.table(texts.join(of, ["k1", "k2"]).select("k1", "k2", "rep", "c"))
        least = tables.table(of.groupBy("c").agg(F.min("rep").alias("component_id")))  # a class may hold very many texts
        linked = of.join(least, "c").select("k1", "k2", F.col("component_id").alias("found"))
        classes = tables.table(texts.join(linked, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("found", "rep").alias("class")))  # copies of one text may be very many rows
        rows = counted.filter(F.col("n").isNotNull()).select("doc_id", "k1", "k2", "n")
        return tables.keep(rows.join(classes, ["k1", "k2"]).select("doc_id", "k1", "k2", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class")).alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest id, with its own columns. Rows
    without an id go if their class has one, and else stay once for each text."""
    found = near_duplicates(docs)
    tables = Tables(docs.sparkSession)
    gone = found.filter(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "k1", "k2").distinct()
    again = found.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1).select("doc_id", "k1", "k2")

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = tables.keep(keys)
        held = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        return rows.join(held, rows["doc_id"].cast("long").eqNullSafe(keys["doc_id"]) & (k1 == keys["k1"]) & (k2 == keys["k2"]), how)

    k1, k2 = (F.xxhash64(F.coalesce(docs["text"], F.lit(""))), F.hash(F.coalesce(docs["text"], F.lit(""))))
    kept = matched(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    a, b = fresh(docs.columns, "k1", "k2")
    twice = matched(kept, again, "left_semi").withColumns({a: k1, b: k2}).dropDuplicates(["doc_id", a, b]).drop(a, b)
    return matched(kept, again, "left_anti").unionByName(twice)
