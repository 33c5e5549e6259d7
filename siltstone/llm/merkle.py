"""Merkle manifest of a dataset: a digest for each row, trees by language, one root, and for
each row the proof that it belongs.

A node is the SHA-256 of its children's digests, written in hexadecimal; a level is made from
every RUN consecutive nodes of the one below. Leaves stand in order of doc_id in aligned
blocks of BLOCK positions. A block is walked by itself, in postorder: a subtree returns its
digest, and while the recursion unwinds, the digest of each sibling is appended to the leaves
below. The blocks' roots are the leaves of another such walk, distributed like the first,
until a language has one node; languages form a tree of their own. Proofs come back the same
way down: what a block's root got is passed on to all its leaves.

Positions come from a range partitioning by (tree, order), counted by partition, so that a
language that holds most rows is spread over all tasks. Blocks are packed rows of some 100
bytes a leaf; texts are read once, by Spark's own functions.

Edge cases: null fields are written `-`. Rows without lang form the first tree; rows without
doc_id come first in theirs and are never tampered with. Rows of one doc_id stand in order of
their digests; repeated rows are leaves each. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_BYTES, Tables, lean, shuffle_parts

#: Nodes of a level that make one of the next.
RUN = 2
#: Levels within a block; positions in one.
HEIGHT = 12
BLOCK = RUN**HEIGHT
#: Bytes that a leaf takes in a shuffle.
LEAF_BYTES = 160
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 7
RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# -------------------------------------------------------------------- leaves

def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(docs: DataFrame, **instead: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(instead.get(c, docs[c])) for c in FIELDS]), 256))


def tree_key(lang: Column) -> Column:
    """Trees by name: null first, then by bytes."""
    return F.when(lang.isNull(), "-").otherwise(F.concat(F.lit("="), lang))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered: the digest with n_chars + 1, where doc_id is drawn)."""
    drawn = F.crc32(docs["doc_id"].cast("string").cast("binary")) % TAMPER == 0
    more = docs["n_chars"].cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    return docs.select(tree_key(docs["lang"]).alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), leaf_digest(docs).alias("digest"), F.when(drawn & docs["n_chars"].isNotNull(), leaf_digest(docs, n_chars=more)).alias("tampered"))


# ----------------------------------------------------------------- positions

def placed(tables: Tables, nodes: DataFrame, order: list[str], count: int) -> DataFrame:
    """nodes with pos, the place in their tree by `order`, and total, the tree's size. Equal
    rows stand as they come in the table `nodes`."""
    spark = nodes.sparkSession
    parts = shuffle_parts(spark, count * LEAF_BYTES, PART_BYTES)
    ranged = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, "tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie")
    held = tables.table(ranged.drop("_tie").withColumn("_id", F.monotonically_increasing_id()))  # from here on the numbers stand
    part = F.shiftright("_id", 33).alias("_part")
    firsts = held.groupBy("tree", part).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each partition and tree
    by_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = firsts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by_tree).alias("total"))
    return held.withColumn("_part", part).join(starts, ["tree", "_part"]).withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


# --------------------------------------------------------------------- blocks

def pack(nodes: DataFrame, payload: list[str], count: int) -> DataFrame:
    """Nodes (tree, pos, total, digest and the payload) as one row for each block: (tree,
    block, total, digests, lists of the payload), in order of pos."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = "tree string, block bigint, total bigint, digests binary" + "".join(f", {c} array<{kinds[c]}>" for c in payload)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            n = rows.num_rows
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column(c).combine_chunks()) for c in payload]
            digests = b"".join(rows.column("digest").to_pylist())
            return pa.RecordBatch.from_arrays([rows.column(c)[:1].combine_chunks() for c in ("tree", "block", "total")] + [pa.array([digests], pa.binary()), *lists], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, block = batch.column("tree"), batch.column("block").to_numpy()
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(tree[1:], tree[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
            new[0] = not held or held[-1].column("tree")[-1].as_py() != tree[0].as_py() or held[-1].column("block")[-1].as_py() != block[0]
            at = 0
            for edge in [*np.flatnonzero(new).tolist(), batch.num_rows]:
                if edge > at:
                    held.append(batch.slice(at, edge - at))
                    at = edge
                if edge < batch.num_rows and held:
                    yield flush()
                    held = []
        if held:
            yield flush()

    parts = shuffle_parts(nodes.sparkSession, count * LEAF_BYTES, PART_BYTES)
    dealt = nodes.withColumn("block", F.shiftright("pos", HEIGHT)).repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.select("tree", "block", "total", "digest", *payload).mapInArrow(lean(run), schema)


def walk(leaf: list[bytes], height: int) -> tuple[bytes, list[list[bytes | None]]]:
    """(digest of the root, for each leaf its sibling on every level, None if it has none):
    a postorder recursion over a block whose digests are in hexadecimal."""
    n = len(leaf)
    siblings: list[list[bytes | None]] = [[] for _ in leaf]

    def visit(level: int, lo: int) -> bytes:
        if level == 0:
            return leaf[lo]
        half = 1 << (level - 1)
        mid, hi = lo + half, min(lo + 2 * half, n)
        left = visit(level - 1, lo)
        if mid >= n:
            for k in range(lo, hi):
                siblings[k].append(None)
            return _hash(left)
        right = visit(level - 1, mid)
        for k in range(lo, mid):
            siblings[k].append(right)
        for k in range(mid, hi):
            siblings[k].append(left)
        return _hash(left + right)

    return visit(height, 0), siblings


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height_of(total: int) -> int:
    """Levels of a block: all, if its tree has other blocks."""
    return HEIGHT if total > BLOCK else (total - 1).bit_length()


def _digests(raw: bytes) -> list[bytes]:
    text = hexlify(raw)
    return [text[k : k + 64] for k in range(0, len(text), 64)]


#: A path is 33 bytes for each level: which side the sibling is on, and its digest.
_NO, _LEFT, _RIGHT = b"\0", b"\1", b"\2"


def _steps(pos: int, siblings: list[bytes | None]) -> list[tuple[bytes, bytes]]:
    """(side, sibling) by level for a leaf at pos."""
    return [(_NO, b"") if s is None else (_LEFT if pos >> level & 1 else _RIGHT, s) for level, s in enumerate(siblings)]


def _path(steps: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(side + (unhexlify(s) if s else bytes(32)) for side, s in steps)


def _read(path: bytes) -> list[tuple[bytes, bytes]]:
    return [(path[k : k + 1], b"" if path[k : k + 1] == _NO else hexlify(path[k + 1 : k + 33])) for k in range(0, len(path), 33)]


def folded(digest: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for side, s in steps:
        digest = _hash(s + digest if side == _LEFT else digest + s)
    return digest


# ---------------------------------------------------------------- up and down

def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = batch.column("total").to_numpy()
        roots = [unhexlify(walk(_digests(raw), height_of(t))[0]) for raw, t in zip(batch.column("digests").to_pylist(), total.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array((total + BLOCK - 1) // BLOCK), pa.array(roots, pa.binary())], ["tree", "pos", "total", "digest"])


def ascend(tables: Tables, nodes: DataFrame, payload: list[str], count: int) -> tuple[list[DataFrame], DataFrame]:
    """(packed blocks by level, (tree, digest) of the trees' roots) of placed nodes."""
    packed = [tables.keep(pack(nodes, payload, count))]
    while True:
        roots = tables.table(packed[-1].mapInArrow(lean(_roots), "tree string, pos bigint, total bigint, digest binary"))
        top = roots.agg(F.max("total").alias("m"), F.count(F.lit(1)).alias("n")).first()
        if (top["m"] or 0) <= 1:
            return packed, roots.select("tree", "digest")
        packed.append(tables.table(pack(roots, [], top["n"])))


def _with_paths(packed: DataFrame, paths: DataFrame) -> DataFrame:
    return packed.join(paths, ["tree", "block"])


def _members(names: Callable[[dict], list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(name, subroot, path) of a block's members: the path in the block, then the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, siblings = walk(_digests(r["digests"]), height_of(r["total"]))
                paths = [_path(_steps(k, s)) + r["path"] for k, s in enumerate(siblings)]
                n = len(paths)
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n), pa.array(names(r)), pa.array([r["subroot"]] * n, pa.binary()), pa.array(paths, pa.binary())], ["tree", "member", "subroot", "path"])

    return run


def descend(tables: Tables, packed: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, block, subroot, path) of the lowest blocks, from tops (tree, subroot, path)."""
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(packed[1:]):
        below = _members(lambda r: list(range(r["block"] * BLOCK, r["block"] * BLOCK + len(r["digests"]) // 32)))
        paths = tables.table(_with_paths(level, paths).mapInArrow(lean(below), "tree string, member bigint, subroot binary, path binary").withColumnRenamed("member", "block"))
    return paths


def _proofs(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    want = root.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("digests", "total", "subroot", "path", "tampered")}
                held = _digests(row["digests"])
                _, siblings = walk(held, height_of(row["total"]))
                above = _read(row["path"])
                proof, back = [], []
                for pos, (digest, own, other) in enumerate(zip(held, siblings, row["tampered"], strict=True)):
                    steps = _steps(pos, own) + above
                    proof.append(hashlib.sha256(b"".join(s for _, s in steps)).hexdigest())
                    back.append(folded(digest if other is None else hexlify(other), steps))
                n = len(held)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[k].values, pa.array([d.decode() for d in held]), pa.array([row["subroot"].hex()] * n), pa.array([root] * n), pa.array(proof), pa.array([d.decode() for d in back]), pa.array([d == want for d in back])],
                    [c.split(" ")[0] for c in RESULT.split(", ")],
                )

    return run


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs
    (doc_id, source, lang, n_chars, text)."""
    spark = docs.sparkSession
    with Tables(spark) as tables:
        rows = tables.table(leaves(docs))
        count = rows.count()
        if not count:
            return spark.createDataFrame([], RESULT)
        forest, subroots = ascend(tables, placed(tables, rows, ["doc_id", "digest"], count), ["doc_id", "tampered"], count)
        names = tables.table(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"))
        n_names = names.count()
        crown, root = ascend(tables, placed(tables, names, ["name"], n_names), ["name"], n_names)
        root = root.first()["digest"]  # one row
        lowest = descend(tables, crown, spark.createDataFrame([("", bytes(root), b"")], "tree string, subroot binary, path binary"))
        tops = tables.table(_with_paths(crown[0], lowest).mapInArrow(lean(_members(lambda r: r["name"])), "tree string, member string, subroot binary, path binary").select(F.col("member").alias("tree"), "path"))
        paths = tables.keep(descend(tables, forest, subroots.withColumnRenamed("digest", "subroot").join(tops, "tree")))
        return _with_paths(forest[0], paths).mapInArrow(lean(_proofs(root.hex())), RESULT)
