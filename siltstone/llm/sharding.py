"""Sharding by a k-d tree, with DataFrame functions only.

Rows become points in a few metadata dimensions: source, language, log of the size, share
of bytes beyond ASCII. Rows of equal texts are one point (the smallest source and language
of them count), so that they stay together unless a cut falls among them. A node that
stands for several shards is split along its widest dimension at the weighted quantile
that leaves each side its share of the bytes; nodes of one depth are split in the same
passes. Names become numbers by their share of bytes: a value stands at the middle of
its stretch when all values are laid side by side in alphabetical order.

The quantile is found by histogram refinement: every pass counts the node's bytes
in BINS equal bins of the current interval, keeps the bin in which the quantile
falls, and goes on inside it, first along the dimension and then, among equal
values, along content hash, doc_id and the row's place in the table of points, which only
break ties. A pass shuffles partial sums
only, and the driver sees one bin of each node; no node is ever sorted or brought together.
The table of points is written once: a row's node follows from the cuts found so far, which
are few and joined to it.

Edge cases: a null text has no bytes and size 1; a null doc_id sorts before all
others; null sources and languages are a value of their own, before all others; a table
without these columns has one value for all; identical rows are divided like others, by
their places; an empty table gives an empty result with the same columns; columns of the input other than
those asked for are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, shuffle_parts, text_or_empty, utf8_crc32

BINS = 1 << 15
#: Rows that one slot bucket holds on average.
BUCKET_ROWS = 50_000
#: Tables up to this number of rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
_TIES = ("_crc", "_hi_id", "_lo_id", "_hi_at", "_lo_at")


def text_dims() -> dict[str, Column]:
    """Dimensions that follow from the text: log of the size, and share of bytes beyond
    ASCII (scripts and languages)."""
    text = text_or_empty()
    size = F.octet_length(text) + F.lit(1)
    return {"log_size": F.log2(size.cast("double")), "beyond_ascii": (F.octet_length(text) - F.char_length(text)) / size}


def name_positions(rows: DataFrame, name: str, weight: str = "size") -> DataFrame:
    """(name, position): the middle of a value's stretch in 0 to 1, by weight, in
    alphabetical order, null first. Running sums go bucket by bucket of the first two
    characters, so that very many values (sources may be host names) are no one task's."""
    value, part = F.col(name), F.coalesce(F.substring(F.col(name), 1, 2), F.lit(""))
    sums = rows.groupBy(name).agg(F.sum(weight).cast("double").alias("_w")).withColumn("_part", part)
    parts = sums.groupBy("_part").agg(F.sum("_w").alias("_sum"))  # as many as pairs of characters
    all_ = Window.partitionBy(F.lit(0))
    parts = parts.select("_part", (F.sum("_sum").over(all_.orderBy("_part")) - F.col("_sum")).alias("_from"), F.sum("_sum").over(all_).alias("_all"))
    upto = F.sum("_w").over(Window.partitionBy("_part").orderBy(value.asc_nulls_first()))
    placed = sums.withColumn("_upto", upto).join(F.broadcast(parts), "_part")
    return placed.select(name, ((F.col("_from") + F.col("_upto") - F.col("_w") / 2) / F.col("_all")).alias("position"))


@dataclass
class _Node:
    """A node of the tree and the state of the search for its cut."""

    first: int
    shards: int
    wide: int = 0
    fixed: list[float] = field(default_factory=list)  # values of the keys found so far
    lo: float = 0.0  # interval of the current key
    hi: float = 0.0
    before: int = 0  # weight before the interval
    goal: float = 0.0
    right: bool = False  # whether the row at the quantile goes right
    empty: bool = False

    @property
    def done(self) -> bool:
        return self.empty or len(self.fixed) == KEYS


#: The keys of the order along a dimension: its value, then _TIES.
KEYS = 1 + len(_TIES)


def _state(spark: SparkSession, nodes: list[_Node]) -> DataFrame:
    """One row for each node, of which there are at most as many as shards."""
    d = lambda x: "cast(null as double)" if x is None else f"{x!r}D"
    rows = [
        f"({n.first}, {n.first + n.shards // 2}, {n.wide}, {len(n.fixed)}, array({', '.join(d(x) for x in [*n.fixed, *[0.0] * KEYS][:KEYS])}), {d(n.lo)}, {d(n.hi)}, {n.before}L, {d(n.goal)}, {str(n.right).lower()})"
        for n in nodes
    ]
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(_node, _next, _wide, _nfix, _fixed, _lo, _hi, _before, _goal, _right)"))


def _pick(number: str, columns: list[Column]) -> Column:
    """The column of that number; plain columns leave no arrays behind for each row."""
    out = F.lit(None).cast("double")
    for k, c in enumerate(columns):
        out = F.when(F.col(number) == k, c).otherwise(out)
    return out


def _keys(table: DataFrame) -> list[Column]:
    """The keys of the order along a node's dimension."""
    dims = [F.col(c) for c in table.columns if c.startswith("_dim")]
    return [_pick("_wide", dims), *[F.col(c) for c in _TIES]]


def kd_shards(points: DataFrame, dims: list[str], shards: int = 16, weight: str = "size") -> DataFrame:
    """points (doc_id, weight, text_crc32 and the dims; a table that is read often) with
    `shard` added. All of `shards` leaves get near equal sums of weight. Of the groups of
    rows that are equal in all dims and in text_crc32 each cut divides at most one. A column
    `_at`, a number for each row, lets it divide rows that are equal in all else."""
    at = F.col("_at") if "_at" in points.columns else F.lit(0).cast("long")
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    table = points.select(
        *points.columns,
        *[F.coalesce(F.col(d).cast("double"), F.lit(0.0)).alias(f"_dim{k}") for k, d in enumerate(dims)],
        F.col("text_crc32").cast("double").alias("_crc"),
        F.shiftright(key, 32).cast("double").alias("_hi_id"),
        key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double").alias("_lo_id"),
        F.shiftright(at, 32).cast("double").alias("_hi_at"),
        at.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double").alias("_lo_at"),
        F.lit(0).alias("_node"),
    )
    nodes, whole = [_Node(0, shards)], None
    while any(n.shards > 1 for n in nodes):
        open_ = [n for n in nodes if n.shards > 1]
        whole = _extents(table, open_, len(dims), whole, weight)
        while pending := [n for n in open_ if not n.done]:
            _refine(table, pending, weight)
        if cut := [n for n in open_ if not n.empty]:
            table = _split(table, cut)
        nodes = [x for n in nodes for x in ([n] if n.shards == 1 else [_Node(n.first, n.shards // 2), _Node(n.first + n.shards // 2, n.shards - n.shards // 2)])]
    return table.withColumnRenamed("_node", "shard").drop(*[f"_dim{k}" for k in range(len(dims))], *_TIES)


def _split(table: DataFrame, nodes: list[_Node]) -> DataFrame:
    """The rows after their node's cut, in the order of the keys, move to its right child."""
    state = _state(table.sparkSession, nodes).select("_node", "_next", "_wide", "_fixed", "_right")
    keys = _keys(table)
    after = F.col("_right")
    for k in reversed(range(KEYS)):
        after = (keys[k] > F.get("_fixed", F.lit(k))) | ((keys[k] == F.get("_fixed", F.lit(k))) & after)
    moved = table.join(state, "_node", "left")
    return moved.select(*[c for c in table.columns if c != "_node"], F.when(after, F.col("_next")).otherwise(F.col("_node")).alias("_node"))


def _extents(table: DataFrame, nodes: list[_Node], dims: int, whole: list[float] | None, weight: str) -> list[float]:
    """Begins the search of each node along the dimension in which it is widest,
    against the width of all rows; returns the latter."""
    aggs = [f(f"_dim{i}").alias(f"{k}{i}") for i in range(dims) for f, k in ((F.min, "l"), (F.max, "h"))]
    found = {r["_node"]: r for r in table.groupBy("_node").agg(F.sum(weight).alias("_w"), *aggs).collect()}
    if whole is None:
        whole = [(found[0][f"h{i}"] - found[0][f"l{i}"]) or 1.0 for i in range(dims)] if found else [1.0] * dims
    for n in nodes:
        r = found.get(n.first)
        if r is None:
            n.empty = True
            continue
        n.wide = max(range(dims), key=lambda i: (r[f"h{i}"] - r[f"l{i}"]) / whole[i])
        n.lo, n.hi = r[f"l{n.wide}"], r[f"h{n.wide}"]
        n.goal = float(r["_w"]) * (n.shards // 2) / n.shards
    return whole


def _refine(table: DataFrame, nodes: list[_Node], weight: str) -> None:
    """One pass for all nodes: each narrows its interval to one bin. A bin of one value
    fixes that key, and every later key that has one value there; the next key goes on
    in the extent that the pass has found. What the nodes ask for comes as a broadcast row
    each, not as constants, so that all passes run the same code."""
    state = _state(table.sparkSession, nodes)
    keys, at = _keys(table), F.col("_nfix")
    fixed = F.lit(True)
    for k in range(KEYS - 1):
        fixed &= (F.lit(k) >= at) | (keys[k] == F.get("_fixed", F.lit(k)))
    rows = table.join(state, "_node").filter(fixed).select("_node", "_lo", "_hi", "_before", "_goal", _pick("_nfix", keys).alias("_v"), F.col(weight).alias("_w"), *_TIES).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    bin_ = F.least(F.floor((F.col("_v") - F.col("_lo")) / width * BINS), F.lit(BINS - 1))
    extents = [f(c).alias(f"{c}{x}") for c in ("_v", *_TIES) for f, x in ((F.min, "l"), (F.max, "h"))]
    bins = rows.groupBy("_node", bin_.alias("_b")).agg(F.sum("_w").alias("_w"), F.first("_before").alias("_before"), F.first("_goal").alias("_goal"), *extents)
    run = F.sum("_w").over(Window.partitionBy("_node").orderBy("_b"))  # BINS rows a node at most
    upto = bins.withColumn("_upto", run + F.col("_before"))
    found = {r["_node"]: r for r in upto.filter((F.col("_upto") >= F.col("_goal")) & (F.col("_upto") - F.col("_w") < F.col("_goal"))).collect()}
    for n in nodes:
        r = found[n.first]
        n.before, n.lo, n.hi = int(r["_upto"] - r["_w"]), r["_vl"], r["_vh"]
        while n.lo == n.hi and not n.done:
            n.fixed.append(n.lo)
            if not n.done:
                key = _TIES[len(n.fixed) - 1]
                n.lo, n.hi = r[f"{key}l"], r[f"{key}h"]
        if n.done:  # the row at the quantile goes to the side that it unbalances less
            n.right = r["_upto"] - n.goal > n.goal - n.before


def with_slots(rows: DataFrame) -> DataFrame:
    """rows (doc_id, shard, text_crc32) with `slot`, gapless from 0 in each shard. Slots
    are dealt by hash bucket (CRC-32 of id and text checksum): a small table of bucket
    counts gives each bucket its offset, and rows are numbered inside their bucket."""
    spark = rows.sparkSession
    total = rows.count()
    buckets = max(1, -(-total // (16 * BUCKET_ROWS))) * 4
    rows = rows.withColumn("_bucket", (utf8_crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))) % F.lit(buckets)).cast("int"))
    parts = shuffle_parts(spark, total, BUCKET_ROWS)
    rows = rows.repartition(parts, "shard", "_bucket")
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("shard", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "_bucket"]).withColumn("slot", (F.col("_from") + F.col("_at")).cast("long")).drop("_bucket", "_from", "_at")


def _with_metadata(rows: DataFrame, names: list[str], tables: Tables) -> DataFrame:
    """rows with dim_<name> for columns `names`. Texts whose copies differ in them take the
    smallest value of all, so that equal texts are one point."""
    held = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    differ = F.lit(False)
    for n in names:
        differ |= ~F.col(f"_l{n}").eqNullSafe(F.col(f"_h{n}"))
    aggs = [f(F.struct(n))[n].alias(f"_{k}{n}") for n in names for f, k in ((F.min, "l"), (F.max, "h"))]
    mixed = tables.table(rows.groupBy("_text").agg(*aggs).filter(differ).select("_text", F.lit(True).alias("_mixed"), *[f"_l{n}" for n in names]))
    rows = rows.join(held(mixed), "_text", "left")
    rows = rows.select(*[c for c in rows.columns if c not in names and c[:2] != "_l" and c != "_mixed"], *[F.when(F.col("_mixed"), F.col(f"_l{n}")).otherwise(F.col(n)).alias(n) for n in names])
    for n in names:
        at = tables.table(name_positions(rows, n).withColumnRenamed(n, "_value"))
        rows = rows.join(held(at), F.col(n).eqNullSafe(F.col("_value")), "left").drop("_value").withColumnRenamed("position", f"dim_{n}")
    return rows.drop(*names)


def shard_documents(docs: DataFrame, shards: int = 16, dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document. Dimensions are those
    given, or text_dims() with the positions of source and lang."""
    names = [n for n in ("source", "lang") if n in docs.columns] if dims is None else []
    dims = text_dims() if dims is None else dims
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        utf8_crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        *[v.alias(f"dim_{k}") for k, v in dims.items()],
        *[F.col(n).cast("string").alias(n) for n in names],
    )
    with Tables(docs.sparkSession) as tables:
        rows = tables.table(rows)
        points = tables.table((_with_metadata(rows, names, tables) if names else rows).drop("_text").withColumn("_at", F.monotonically_increasing_id()))
        placed = kd_shards(points, [f"dim_{k}" for k in [*names, *dims]], shards)
        return with_slots(tables.keep(placed.select("doc_id", "size", "text_crc32", "shard")))
