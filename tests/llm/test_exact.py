"""Clustering, top-k search and the Merkle manifest against brute force, with nulls,
non-finite and odd vectors, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from siltstone.llm import ball_clusters, merkle, topk_search
from siltstone.llm.common import ship

VECTORS = "vec_id long, embedding array<float>, label int, distance string, score int, cluster string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2, "y") for i, v in rows], VECTORS).repartition(parts)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def scaled(v, by):
    return [math.floor(by * float(np.float32(x))) for x in v]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 64))
    rows = [(k, (middles[k % 6] + 0.02 * rng.normal(size=64)).tolist()) for k in range(500)]  # tight groups: balls with one owner
    rows += [(500 + k, rng.normal(size=64).tolist()) for k in range(200)]
    rows += [(700 + k, middles[0].tolist()) for k in range(300)]  # one vector, often
    rows += [rows[3], rows[3], rows[510]]  # repeated rows
    rows += [(None, rows[5][1]), (None, rows[600][1]), (2000, None), (2001, []), (2002, [1.0]), (2003, [float("nan")] * 64), (2004, [float("inf")] + [0.0] * 63), (2005, [None] + [0.0] * 63), (2006, [0.0] * 65), (2100, rows[7][1]), (2100, rows[8][1])]
    return rows


# --------------------------------------------------------------- clustering

def lloyd(rows, k, rounds):
    kept = [(i, scaled(v, 256)) for i, v in rows if good(v) and len(v) == 64]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    z = np.array([v for _, v in first], np.int64).reshape(-1, 64)
    x = np.array([v for _, v in kept], np.int64).reshape(-1, 64)
    for last in [False] * rounds + [True]:
        d = ((x[:, None, :] - z[None]) ** 2).sum(2)
        c = d.argmin(1)
        if not last:
            for j in set(c.tolist()):
                total = x[c == j].sum(0)
                z[j] = [int(t) // int((c == j).sum()) for t in total]
    d = d[np.arange(len(x)), c]
    return sorted(((i, int(j), int(e), int(d[c == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, z[j].tolist())).encode()).hexdigest()) for (i, _), j, e in zip(kept, c, d, strict=True)), key=repr)


def test_clusters_against_every_distance(spark, vectors):
    got = ball_clusters.cluster_documents(table(spark, vectors))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(vectors, 40, 5)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(None, [0.5] * 64)], [(k, [0.25] * 64) for k in range(60)], [(1, [-0.001] * 64), (1, [-0.001] * 64)]])
def test_clusters_of_few(spark, rows):
    want = lloyd(rows, 40, 5) if any(i is not None and good(v) for i, v in rows) else []
    assert sorted(map(tuple, ball_clusters.cluster_documents(table(spark, rows, 2)).collect()), key=repr) == want


def test_components_beyond_the_limit_are_an_error(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        ball_clusters.cluster_documents(table(spark, [(1, [1e30] * 64)])).collect()
    with pytest.raises(Exception, match="do not fit a long"):
        topk_search.search_every(table(spark, [(100, [1e30] * 64)])).collect()


def test_trees_and_filtering():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-300, 300, (900, 64)), np.repeat(rng.integers(-300, 300, (1, 64)), 400, 0), rng.integers(-2, 2, (700, 64)) + 5000])
    order, tree = ball_clusters.build_tree(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    y = x[order]
    for s, e, right, radius, total in zip(tree["start"], tree["end"], tree["right"], tree["radius"], tree["sums"], strict=True):
        away = y[s:e] - total / (e - s)
        assert (y[s:e].sum(0) == total).all() and np.sqrt((away**2).sum(1)).max() <= radius + 1e-6
        assert right or e - s <= ball_clusters.LEAF_ROWS or radius == 0
    for z in (np.array([[0] * 64, [5000] * 64, [400] * 64]), np.concatenate([y[:7], y[:3]]), rng.integers(-300, 300, (40, 64))):
        owned, rows, found = ball_clusters.filtered(y, tree, z)
        label = np.full(len(y), -1)
        for node, c in owned:
            label[tree["start"][node] : tree["end"][node]] = c
        label[rows] = found
        assert (label == ((y[:, None, :] - z[None]) ** 2).sum(2).argmin(1)).all()  # ties: the smaller number
    owned, _, _ = ball_clusters.filtered(y, tree, np.array([[0] * 64, [5000] * 64]))
    assert max(tree["end"][n] - tree["start"][n] for n, _ in owned) > 300  # whole balls


# ------------------------------------------------------------------- search

def best(rows, step, k=10):
    kept = [(i, scaled(v, 1024)) for i, v in rows if i is not None and good(v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in kept if i % step == 0}:
        hits = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in kept if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits[:k])]
    return sorted(out)


def test_top_k_against_all_products(spark, vectors):
    got = topk_search.search_every(table(spark, vectors, 5))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best(vectors, 100)


def test_top_k_over_many_blocks_and_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), np.round(v, 1).tolist()) for k, v in zip(rng.permutation(9500), rng.normal(size=(9500, 3)), strict=True)]  # many ties
    rows += [(k, [float(k % 7), 1.0]) for k in range(20000, 20400)]
    assert sorted(map(tuple, topk_search.search_every(table(spark, rows, 1), 10).collect())) == best(rows, 10)


@pytest.mark.parametrize("rows", [[], [(100, None)], [(1, [1.0])], [(100, [1.0])], [(100, [1.0]), (100, [1.0]), (7, [2.0]), (7, [2.0])], [(0, []), (1, [])], [(-100, [1.0, -1.0]), (5, [-1.0, 1.0])]])
def test_top_k_of_few(spark, rows):
    assert sorted(map(tuple, topk_search.search_every(table(spark, rows, 2)).collect())) == best(rows, 100)


def test_selection_with_scores_of_any_size():
    rng = np.random.default_rng(9)
    for top in (3, 1 << 20, 1 << 61):
        ids, scores, qids = np.arange(50), rng.integers(-top, top, (6, 50)), np.array([0, 3, 9, 70, 80, 49])
        who, what = topk_search.select(qids, ids, scores, 10)
        for q, w, s, all_ in zip(qids, who, what, scores, strict=True):
            want = sorted((-int(v), int(i)) for i, v in zip(ids, all_, strict=True) if i != q)[:10]
            assert [(-int(a), int(b)) for a, b in zip(s, w, strict=True)] == want


def test_products_are_exact():
    from siltstone.llm.vectors import products

    a, b = np.array([[2**29 + 1, 3]]), np.array([[2**29 + 3, 5]])
    assert products(a, b)[0, 0] == (2**29 + 1) * (2**29 + 3) + 15
    with pytest.raises(OverflowError):
        products(np.full((1, 64), 2**30), np.full((1, 64), 2**30))


# ----------------------------------------------------------------- manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, pos long, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def chain(digests):
    """(root, for each leaf [(sibling on the left?, sibling or None)])."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, pos in enumerate(at):
            other = level[pos ^ 1] if pos ^ 1 < len(level) else None
            paths[k].append((pos % 2 == 1, other))
        at, level = [pos // 2 for pos in at], [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], paths


def manifest(rows):
    if not rows:
        return []
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h(*(text(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    subs, paths = {}, {}
    for lang in langs:
        trees[lang].sort(key=lambda t: t[:3])
        subs[lang], paths[lang] = chain([t[2] for t in trees[lang]])
    root, above = chain([subs[v] for v in langs])
    out = []
    for k, lang in enumerate(langs):
        for (_, _, digest, r), path in zip(trees[lang], paths[lang], strict=True):
            drawn = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            back = leaf(r, 1) if drawn else digest
            for left, other in path + above[k]:
                back = h(back) if other is None else h(other, back) if left else h(back, other)
            out.append((r[0], digest, subs[lang], root, h(*[s for _, s in path + above[k] if s]), back, back == root))
    return sorted(out, key=repr)


def check_manifest(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "clash", 1, 2, "x") for r in rows], DOCS).repartition(parts)
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == manifest(rows)


def test_manifest_of_every_kind_of_row(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["", "ab", "日本語", None, "x" * 3000]), rng.choice(["en", "fr", "é", "", None, "-"]), rng.choice(["s", None, "1:"]), rng.choice([0, 7, -1, None, 2**63 - 1])) for k in rng.sample(range(-50, 900), 300)]
    rows += [(None, "a", "en", None, 1), (None, "b", "en", None, 1), (None, "b", "en", None, 1), (5000, None, None, None, None), (7, "long " * 100_000, "alone", "s", 5)]
    rows += [(9000, "same", "en", "s", 4)] * 30 + [(9000, "other", "en", "s", 4)]
    check_manifest(spark, rows)


def test_manifest_over_several_blocks(spark):
    """A tree of more leaves than a block, whose last block is not full, and whole ones."""
    rows = [(k, str(k), "big", "s", k) for k in range(merkle.BLOCK * 2 + 1)] + [(k, str(k), "whole", "s", k) for k in range(merkle.BLOCK)] + [(k, "", f"l{k % 5}", None, 0) for k in range(40)]
    check_manifest(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(1, "a", None, "s", 1)], [(1, "a", "en", "s", 1), (2, "b", "fr", "s", 1)], [(k, "a", "en", "s", None) for k in range(5)]])
def test_manifest_of_few(spark, rows):
    check_manifest(spark, rows)


def test_a_walk_pads_a_block_to_its_height():
    leaf = [h(str(k)).encode() for k in range(3)]
    root, siblings = merkle.walk(leaf, 4)
    pair, lone = h(leaf[0].decode(), leaf[1].decode()), h(leaf[2].decode())
    assert root.decode() == h(h(h(pair, lone))) and [len(s) for s in siblings] == [4, 4, 4] and siblings[2][1] == pair.encode()
    for k in range(3):
        assert merkle.folded(leaf[k], merkle._steps(k, siblings[k])) == root
        assert merkle._read(merkle._path(merkle._steps(k, siblings[k]))) == merkle._steps(k, siblings[k])
