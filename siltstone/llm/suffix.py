"""Removal of repeated 100-byte strings, by merging Burrows-Wheeler transforms.

Which 100-byte windows can be repeated at all is narrowed down first, without loss: the
smallest hash among a window's 69 grams of 32 bytes is its anchor, and equal windows
have equal anchors at equal places. Only texts' windows whose anchor occurs twice go on,
as short strings (contexts) around the anchor, dealt by the anchor's hash; equal contexts
are one, standing at its earliest place. A window that equals the one a short period
before it, as all but the first few windows of a periodic stretch do, is a repeat at once
and in no context.

Contexts that share an anchor but differ are then compared as follows. They are split
into shards; each shard gets a suffix array of its own and from it a Burrows-Wheeler
transform. The transforms are merged by refining their interleave: in each round the
symbols before the suffixes, in the order so far, are dealt into buckets stably, after
which suffixes are in order by one symbol more. Two neighbours are told apart in the
round that first separates them, which is their common prefix; after 100 rounds the
blocks left are the intervals of suffixes with 100 equal bytes. No suffix is sorted anew.

An anchor with contexts of over HOT_BYTES (a phrase in very many surroundings) is split by
a second, finer one: windows whose anchor stands at nearly the same place, CELL of them,
have all but CELL - 1 bytes in common, and the hash of these is the finer anchor. Its
contexts are dealt anew and merged in the same way.

In each interval all windows but those of the smallest doc_id, and of these the first one
in its text, are repeats, and their bytes go. Equal texts are compared once: a copy with a
larger doc_id has only repeated windows.

Edge cases: null texts are empty; texts under 100 bytes lose nothing; a null doc_id
sorts before all others. A document is a doc_id with a text: different texts of one id, or
without an id, are different documents, neither earlier than the other, and lose only
what a smaller id has or what they repeat themselves; repeated rows (same id, same text)
lose the same. An empty table gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, Rolling, Tables, binary_column, bucket_count, bucket_of, bucket_rows, doc_groups, in_buckets, lean, mix64, span_hashes, text_buffer, text_or_empty
from .ngram_join import _runs as distinct_runs
from .ngram_join import text_keys
from .substring import NULL_ID, doc_ids

LENGTH = 100
GRAM = 32
SHARDS = 4
#: Bytes of contexts merged at once, of one anchor or of several.
MERGE_BYTES = 1 << 20
#: Bytes of contexts of one anchor from which on a finer anchor splits them.
HOT_BYTES = 4 << 20
#: Places of the anchor in its window that one finer anchor covers.
CELL = 3
_SEGMENT = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _after_period(own: np.ndarray, at: np.ndarray, anchor: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows (starts `at`, in rising order) equal the window a period before them,
    in the same document. Only windows whose anchor equals the one before are looked at,
    with the distance of the two as period; in a periodic stretch these are all but some."""
    out = np.zeros(len(at), bool)
    run = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    near = np.flatnonzero((anchor[run][1:] == anchor[run][:-1]) & (doc[run][1:] == doc[run][:-1])) + 1
    if not len(near):
        return out
    period = place[run[near]] - place[run[near - 1]]
    first = np.append(True, (np.diff(near) != 1) | (np.diff(period) != 0))  # stretches of one period
    a, b = run[near[first]], np.append(run, len(at))[near[np.append(first[1:], True)] + 1]
    p, size = period[first], b - a + LENGTH - 1
    ends = np.cumsum(size)
    for lo, hi in doc_groups(np.append(0, ends), _SEGMENT):
        n = size[lo:hi]
        who = np.repeat(np.arange(lo, hi), n)
        step = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        i = at[a[who]] + step
        differ = np.append(0, np.cumsum(own[i] != own[np.maximum(i - p[who], 0)]))
        window = step <= n[who - lo] - LENGTH
        k = np.flatnonzero(window)
        mine = a[who[k]] + step[k]
        begin = np.searchsorted(doc, doc[mine])  # the document's first window here
        out[mine] = (differ[k + LENGTH] == differ[k]) & (at[mine] - p[who[k]] >= at[begin])
    return out


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor hash, document, first window's start, last
    window's start, anchor's place - first start, whether the windows repeat those a period
    before); starts count from the buffer's begin."""
    parts = []
    for lo in range(0, max(0, len(buf) - LENGTH + 1), _SEGMENT):
        own = buf[lo : lo + _SEGMENT + LENGTH - 1]
        h = mix64(Rolling(own).grams(GRAM))
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_min(key, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
        start = lo + np.arange(len(place))
        doc = np.searchsorted(offs, start, side="right") - 1
        ok = start + LENGTH <= offs[doc + 1]
        start, doc, place = start[ok], doc[ok], place[ok]
        if not len(start):
            continue
        again = _after_period(own, start - lo, h[place], place, doc)
        first = np.append(True, (doc[1:] != doc[:-1]) | (again[1:] != again[:-1]) | ((place[1:] != place[:-1]) & ~again[1:]))
        head = np.flatnonzero(first)
        tail = np.append(head[1:], len(start)) - 1
        # minimal hashes are small ones: mixed again, they spread over the buckets
        parts.append((mix64(h[place[head]] + np.uint64(GRAM)), doc[head], start[head], start[tail], lo + place[head] - start[head], again[head]))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ------------------------------------------------- merging of BWTs in one task

_PACK = 7


def suffix_array(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Suffixes of the strings in order, each with an end mark below any byte; equal ones
    stand by string. Places count end marks (string j's is at offs[j+1] + j)."""
    m = len(offs) - 1
    n = len(data) + m
    ends = offs[1:] + np.arange(m)
    body = np.ones(n, bool)
    body[ends] = False
    text = np.zeros(n + _PACK, np.int64)
    text[:n][body] = data.astype(np.int64) + 1
    left = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n)  # symbols before the end mark
    key = np.zeros(n, np.int64)
    for j in range(_PACK):
        key = (key << 9) | np.where(left >= j, text[j : n + j], 0)
    step, longest = _PACK, int(left.max()) + 1
    while step < longest:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, np.diff(key[order]) != 0))
        low = np.full(n, -1, np.int64)
        low[:-step] = rank[step:]
        low[left < step] = -1  # the string has ended
        key = rank * (n + 1) + low + 1
        step *= 2
    return np.argsort(key, kind="stable")


def transform(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, BWT, step) of a shard. BWT symbols are byte + 1, or 0 before a
    string's begin (UTF-8 has no byte 255); step is the row of the suffix that is longer
    by that symbol."""
    m = len(offs) - 1
    order = suffix_array(data, offs)
    n = len(order)
    body = np.ones(n, bool)
    body[offs[1:] + np.arange(m)] = False
    symbols = np.zeros(n, np.uint8)
    symbols[body] = data + 1
    before = np.append(np.uint8(0), symbols[:-1])
    before[offs[:-1] + np.arange(m)] = 0
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    return order, before[order], row[np.maximum(order - 1, 0)]


def merge_intervals(bwts: list[np.ndarray], steps: list[np.ndarray], rounds: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the concatenated shards that share their first `rounds` symbols with
    another row, in merged order, and the number of each one's interval.

    The interleave begins shard by shard, all in one block. A round deals the rows, in
    their order so far, by the symbol before them, stably, and moves each to the suffix
    that is longer by it: the order then holds for one symbol more, and a block ends
    where symbols or earlier blocks differ. A row alone in its block has its place, as
    has all that it is stepped to: it takes no part in later rounds. Two rounds are done
    at once, by pairs of symbols, the second of them first."""
    base = np.append(0, np.cumsum([len(b) for b in bwts]))
    bwt = np.concatenate(bwts)
    step = np.concatenate([s + np.int32(o) for s, o in zip(steps, base, strict=False)])
    pair, step = (bwt[step].astype(np.uint16) << np.uint16(8)) | bwt, step[step]
    row, block = np.arange(base[-1], dtype=np.int32), np.zeros(base[-1], np.int32)
    for _ in range(rounds // 2):
        symbol = pair[row]
        inside = (symbol > 255) & ((symbol & np.uint16(255)) > 0)  # an end mark is like no other
        if not inside.all():
            row, block, symbol = row[inside], block[inside], symbol[inside]
        order = np.argsort(symbol, kind="stable")
        symbol, block, row = symbol[order], block[order], step[row[order]]
        edge = np.ones(len(row) + 1, bool)
        edge[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        several = ~(edge[:-1] & edge[1:])
        row, block = row[several], np.cumsum(edge[:-1], dtype=np.int32)[several]
        if not len(row):
            break
    return row, block


def equal_windows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each place of the strings, the number of the interval of its LENGTH bytes; -1
    where these stand nowhere else, or the string ends before."""
    m = len(offs) - 1
    out = np.full(len(data), -1, np.int64)
    if m == 0:
        return out
    cuts = np.unique(np.searchsorted(offs, np.linspace(0, offs[-1], SHARDS + 1)[1:-1]).clip(1, m))
    bounds = [0, *[int(c) for c in cuts if c < m], m]
    bwts, steps, places = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        o = offs[a : b + 1] - offs[a]
        order, bwt, step = transform(data[offs[a] : offs[b]], o)
        place = np.full(len(order), -1, np.int64)
        body = np.ones(len(order), bool)
        body[o[1:] + np.arange(b - a)] = False
        place[body] = offs[a] + np.arange(offs[b] - offs[a])
        bwts.append(bwt)
        steps.append(step)
        places.append(place[order])
    row, block = merge_intervals(bwts, steps)
    at = np.concatenate(places)[row]
    out[at[at >= 0]] = block[at >= 0]
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(data))
    out[left < LENGTH] = -1
    return out


def later(group: list[np.ndarray], doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of strings by group (equal ones), document, text key and start; whether
    each, in that order, stands earlier too: under a smaller document id, or before in its
    own text; and whether it begins a group."""
    order = np.lexsort((start, key, doc, *group[::-1]))
    d, k, s = doc[order], key[order], start[order]
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    new = np.append(True, np.logical_or.reduce([g[order][1:] != g[order][:-1] for g in group]))
    text = new | np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))
    head, own = (np.flatnonzero(x)[np.cumsum(x) - 1] for x in (new, text))
    return order, (d != d[head]) | (s != s[own]), new


def repeated_windows(data: np.ndarray, offs: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the window at each place of the contexts stands earlier too; string j
    begins at start[j] of the text key[j] of document doc[j]."""
    number = equal_windows(data, offs)
    who = np.repeat(np.arange(len(doc)), np.diff(offs))
    at = np.flatnonzero(number >= 0)
    order, again, _ = later([number[at]], doc[who[at]], key[who[at]], start[who[at]] + at - offs[who[at]])
    out = np.zeros(len(data), bool)
    out[at[order]] = again
    return out


# ------------------------------------------------------------ steps on batches

def _pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors (h, text key) by bucket of h; those that a batch has twice go straight to
    their text's bucket, and once, without key, to the anchor's; so do those that the task
    has found twice before."""
    known = Known(0)
    for batch in batches:
        k1, at = np.unique(batch.column(0).to_numpy(), return_index=True)
        buf, offs = text_buffer(batch.column(1).take(pa.array(at)))
        hashes, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi in doc_groups(offs):
            h, doc, *_, again = anchors(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            # a periodic text has its anchor twice
            hashes += [h, h[again]]
            keys += [k1[lo:hi][doc], k1[lo:hi][doc[again]]]
        h, k = np.concatenate(hashes), np.concatenate(keys)
        order = np.argsort(h, kind="stable")
        h, k = h[order], k[order]
        first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(first), len(h)))
        before = known.find(h[first])[0]
        known.add(h[first][(size > 1) & ~before])
        twice = np.repeat((size > 1) | before, size)
        new = first & ~np.repeat(before, size)
        yield _pair_rows(h[new], np.where(twice, 0, k)[new], buckets, False)
        yield _pair_rows(h[twice], k[twice], buckets, True)


def _pair_rows(h: np.ndarray, k: np.ndarray, buckets: int, found: bool) -> pa.RecordBatch:
    by = mix64(k.view(np.uint64).copy()) if found else h
    rows = [(b, x[1:] if found else [x[0], x[1]]) for b, x in (bucket_rows(by, buckets, h, k) if found else bucket_rows(by, buckets, k))]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([found] * len(rows), pa.bool_()), pa.array([x[0] for _, x in rows], pa.binary()), pa.array([x[1] for _, x in rows], pa.binary())], ["bucket", "found", "h", "k"])


_PAIR = "bucket int, found boolean, h binary, k binary"


def _both(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(batch.column("h"))[0].view(np.uint64).copy(), text_buffer(batch.column("k"))[0].view(np.int64).copy()


def _find_pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for batch in batches:
        found = batch.column("found")
        yield batch.filter(found)
        parts.append(_both(batch.filter(pa.compute.invert(found))))
    h, k, much = distinct_runs(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
    use = (much > 1) & (k != 0)
    yield _pair_rows(h[use], k[use], buckets, True)


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, hashes) of each text."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)), *(_both(b) for b in batches if b.num_rows)]
    h, k = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    order = np.lexsort((h, k))
    h, k = h[order], k[order]
    new = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])) if len(h) else np.zeros(0, bool)
    h, k = h[new], k[new]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    for lo in range(0, len(head), 4096):
        some = head[lo : lo + 4096]
        end = head[lo + 4096] if lo + 4096 < len(head) else len(k)
        offs = np.append(some, end) - some[0]
        yield pa.RecordBatch.from_arrays([pa.array(k[some]), binary_column(h[some[0] : end].view(np.uint8), offs * 8)], ["k1", "hashes"])


_CONTEXT = "bucket int, h binary, doc binary, key binary, start binary, rel binary, size binary, data binary"
_CONTEXT_NAMES = [x.split(" ")[0] for x in _CONTEXT.split(", ")]
_KINDS = {"h": np.uint64, "doc": np.int64, "key": np.int64, "start": np.int64, "rel": np.int16, "size": np.int32, "data": np.uint8}
Contexts = dict[str, np.ndarray]


def _take_spans(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other; indices of some MB at once."""
    total = np.append(0, np.cumsum(size))
    out, i = np.empty(total[-1], np.uint8), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _SEGMENT, side="right")) - 1)
        out[total[i] : total[j]] = data[np.repeat(at[i:j] - total[i:j], size[i:j]) + np.arange(total[i], total[j])]
        i = j
    return out


def _earliest(c: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """Of equal contexts, those that stand earliest (one for each text of the smallest
    document id, repeated rows once) and which are later. 128 bits stand for a context."""
    offs = np.append(0, np.cumsum(c["size"]))
    digest = [span_hashes(c["data"], offs[:-1], offs[1:], seed) + c["rel"].astype(np.uint64) for seed in (1, 2)]
    order, again, new = later([c["h"], *digest], c["doc"], c["key"], c["start"])
    keep = order[~again]
    twin = np.zeros(len(keep), bool)
    if len(keep) > 1:
        new = new[~again]
        twin[1:] = ~new[1:] & np.logical_and.reduce([c[n][keep][1:] == c[n][keep][:-1] for n in ("doc", "key", "start")])
    return keep[~twin], order[again]


def _pick(c: Contexts, rows: np.ndarray) -> Contexts:
    offs = np.append(0, np.cumsum(c["size"]))
    return {k: v[rows] for k, v in c.items() if k != "data"} | {"data": _take_spans(c["data"], offs[:-1][rows], c["size"][rows].astype(np.int64))}


def _context_rows(c: Contexts, buckets: int) -> list[list]:
    """Contexts by bucket of the anchor."""
    if not len(c["h"]):
        return []
    bucket = bucket_of(c["h"], buckets)
    c = _pick(c, order := np.argsort(bucket, kind="stable"))
    bucket = bucket[order]
    edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    offs = np.append(0, np.cumsum(c["size"]))
    return [[int(bucket[a]), *[c[n][a:b].tobytes() for n in _CONTEXT_NAMES[1:-1]], c["data"][offs[a] : offs[b]].tobytes()] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _range_rows(doc: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, buckets: int) -> list[list]:
    """Ranges of repeated windows (first start, number of starts), by document; they
    travel in the doc, key, start and size columns, without h."""
    spread = mix64(doc.view(np.uint64) ^ key.view(np.uint64))
    return [[b, None, x[1], x[2], x[3], None, x[4], None] for b, x in bucket_rows(spread, buckets, doc, key, start, count.astype(np.int32))]


def _whole(c: Contexts, rows: np.ndarray, buckets: int) -> list[list]:
    """All windows of some contexts, as ranges."""
    return _range_rows(c["doc"][rows], c["key"][rows], c["start"][rows], c["size"][rows] - LENGTH + 1, buckets)


def _blob_batches(rows: list[list]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, len(_CONTEXT_NAMES))]], _CONTEXT_NAMES)


def _contexts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the texts' anchors that occur twice, equal ones of the batch once."""
    for batch in batches:
        ids, keys = doc_ids(batch.column(0)), batch.column(1).to_numpy()
        buf, offs = text_buffer(batch.column(2))
        known, koffs = text_buffer(batch.column(3))
        known, koffs = known.view(np.uint64), koffs // 8
        for lo, hi in doc_groups(offs, 1 << 20):
            own, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            h, doc, start, last, rel, again = anchors(own, at)
            yield from _blob_batches(_range_rows(ids[lo:hi][doc[again]], keys[lo:hi][doc[again]], (start - at[doc])[again], (last - start + 1)[again], buckets))
            pair = np.stack([h, doc.astype(np.uint64)], 1)
            have = np.stack([known[koffs[lo] : koffs[hi]], np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(koffs[lo : hi + 1]))], 1)
            use = np.isin(mix64(pair[:, 0] + mix64(pair[:, 1] + np.uint64(1))), mix64(have[:, 0] + mix64(have[:, 1] + np.uint64(1)))) & ~again
            h, doc, start, last, rel = h[use], doc[use], start[use], last[use], rel[use]
            size = last - start + LENGTH
            c = {"h": h, "doc": ids[lo:hi][doc], "key": keys[lo:hi][doc], "start": start - at[doc], "rel": rel.astype(np.int16), "size": size.astype(np.int32), "data": _take_spans(own, start, size)}
            keep, repeats = _earliest(c)
            yield from _blob_batches(_context_rows(_pick(c, keep), buckets) + _whole(c, repeats, buckets))


def finer(c: Contexts) -> Contexts:
    """The same windows under finer anchors: a context's windows by cells of CELL places
    of the anchor. All windows of a cell have the bytes in common that the finer anchor
    hashes, at one place, so that equal windows have equal finer anchors."""
    offs = np.append(0, np.cumsum(c["size"]))
    rel, count = c["rel"].astype(np.int64), c["size"].astype(np.int64) - LENGTH + 1
    # window w of a context has its anchor at place rel - w: cells count from the last window's
    low, high = (rel - count + 1) // CELL, rel // CELL
    cells = high - low + 1
    who = np.repeat(np.arange(len(rel)), cells)
    cell = high[who] - (np.arange(len(who)) - np.repeat(np.append(0, np.cumsum(cells)[:-1]), cells))
    first = np.maximum(rel[who] - cell * CELL - (CELL - 1), 0)
    last = np.minimum(rel[who] - cell * CELL, count[who] - 1)
    core = rel[who] - cell * CELL  # where the bytes that all windows of the cell have begin
    begin = offs[who] + core
    h = mix64(c["h"][who] + mix64(span_hashes(c["data"], begin, begin + LENGTH - CELL + 1, 3) + cell.astype(np.uint64)))
    size = last - first + LENGTH
    return {"h": h, "doc": c["doc"][who], "key": c["key"][who], "start": c["start"][who] + first, "rel": (rel[who] - first).astype(np.int16), "size": size.astype(np.int32), "data": _take_spans(c["data"], offs[who] + first, size)}


def _read(batch: pa.RecordBatch) -> Contexts:
    return {k: text_buffer(batch.column(k))[0].view(t) for k, t in _KINDS.items()}


def _concat(parts: list[Contexts]) -> Contexts:
    return {k: np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in _KINDS.items()}


def _merge(batches: Iterator[pa.RecordBatch], buckets: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of some buckets' anchors. Contexts of hot anchors go on
    under finer ones, unless this is the last round. What comes in is thinned whenever it
    has grown by HOT_BYTES, so that equal contexts and hot anchors are never held."""
    parts: list[Contexts] = []
    hot, held = np.zeros(0, np.uint64), 0

    def thin() -> Iterator[pa.RecordBatch]:
        nonlocal parts, hot, held
        c = _concat(parts)
        keep, repeats = _earliest(c)
        yield from _blob_batches(_whole(c, repeats, buckets))
        c = _pick(c, keep)  # in the order of the anchor
        if not last:
            anchor, number = np.unique(c["h"], return_inverse=True)
            heavy = np.bincount(number, c["size"], len(anchor)) > HOT_BYTES
            hot = np.union1d(hot, anchor[heavy])
            split = np.isin(c["h"], hot)
            if split.any():
                rows = np.flatnonzero(split)
                for at in range(0, len(rows), 4096):
                    f = finer(_pick(c, rows[at : at + 4096]))
                    keep, repeats = _earliest(f)
                    yield from _blob_batches(_context_rows(_pick(f, keep), buckets) + _whole(f, repeats, buckets))
                c = _pick(c, np.flatnonzero(~split))
        parts, held = [c], 0

    for batch in batches:
        own = batch.column("h").is_valid()
        if (ranges := batch.filter(pa.compute.invert(own))).num_rows:
            yield ranges
        new = batch.filter(own)
        for at in range(0, new.num_rows, 64):
            parts.append(_read(new.slice(at, 64)))
            held += len(parts[-1]["data"])
            if held > HOT_BYTES:
                yield from thin()
    yield from thin()
    c = parts.pop()
    edge = np.append(True, c["h"][1:] != c["h"][:-1]) if len(c["h"]) else np.zeros(0, bool)
    number = np.cumsum(edge) - 1
    if len(number):
        c = _pick(c, np.flatnonzero(np.bincount(number)[number] > 1))  # a lone context repeats only itself
    if not len(c["h"]):
        return
    head = np.flatnonzero(np.append(True, c["h"][1:] != c["h"][:-1]))
    offs = np.append(0, np.cumsum(c["size"]))
    lo = 0
    while lo < len(head):
        hi = max(lo + 1, int(np.searchsorted(offs[head], offs[head[lo]] + MERGE_BYTES, side="right")) - 1)
        hi = len(head) if offs[-1] - offs[head[lo]] <= MERGE_BYTES else hi
        a, b = head[lo], head[hi] if hi < len(head) else len(c["h"])
        again = repeated_windows(c["data"][offs[a] : offs[b]], offs[a : b + 1] - offs[a], c["doc"][a:b], c["key"][a:b], c["start"][a:b])
        at = np.flatnonzero(again)
        who = np.searchsorted(offs[a : b + 1] - offs[a], at, side="right") - 1
        first = np.append(True, (np.diff(at) != 1) | (np.diff(who) != 0)) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        count = np.diff(np.append(begin, len(at)))
        who, at = who[begin], at[begin]
        yield from _blob_batches(_range_rows(c["doc"][a:b][who], c["key"][a:b][who], c["start"][a:b][who] + at - (offs[a:b] - offs[a])[who], count, buckets))
        lo = hi


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k1, spans): the removed byte runs of each document, as pairs of 64-bit bounds."""
    names = ("doc", "key", "start", "size")
    parts: dict[str, list[np.ndarray]] = {n: [np.zeros(0, _KINDS[n])] for n in names}
    for batch in batches:
        for n in names if batch.num_rows else ():
            parts[n].append(text_buffer(batch.column(n))[0].view(_KINDS[n]).copy())
    doc, key, start, count = (np.concatenate(parts[n]) for n in names)
    if not len(doc):
        return
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    end = start + count[order] - 1 + LENGTH
    first = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    # the furthest end so far in the document, by offsets that keep documents apart
    number = np.cumsum(first) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * wide) - number * wide
    new = first | np.append(True, start[1:] > reach[:-1])
    head = np.flatnonzero(new)
    bounds = np.stack([start[head], reach[np.append(head[1:], len(doc)) - 1]], 1)
    top = np.flatnonzero(first[head])
    yield pa.RecordBatch.from_arrays([pa.array(doc[head][top]), pa.array(key[head][top]), binary_column(bounds.reshape(-1).view(np.uint8), np.append(top, len(head)) * 16)], ["id", "k1", "spans"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("t"), batch.column("spans"), strict=True):
            raw, bounds, at, digest = text.as_py(), np.frombuffer(spans.as_py(), np.int64).reshape(-1, 2).tolist(), 0, hashlib.sha256()
            for lo, hi in bounds:
                digest.update(raw[at:lo])
                at = hi
            digest.update(raw[at:])
            out.append((sum(hi - lo for lo, hi in bounds), len(bounds), digest.hexdigest()))
        n, m, sha = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string())], ["k1", "k2", "n_removed", "n_spans", "kept_sha256"])


# ---------------------------------------------------------------- the operator

def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), *text_keys(), F.encode(text_or_empty(), "UTF-8").alias("t"))


def removed_spans(docs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed documents, their texts' smallest ids, spans (id, k1, spans) of those)."""
    keyed = _documents(docs)
    narrow = tables.table(keyed.select("id", "k1", "k2", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha")))
    volume = int(narrow.agg(F.sum("n_bytes")).first()[0] or 0)
    buckets = bucket_count(docs.sparkSession, volume)
    pairs = keyed.filter(F.octet_length("t") >= LENGTH).select("k1", "t").mapInArrow(lean(lambda it: _pairs(it, buckets)), _PAIR)
    found = in_buckets(pairs, volume, lambda it: _find_pairs(it, buckets), _PAIR)
    texts = tables.table(in_buckets(found, volume, _by_text, "k1 long, hashes binary"))
    reps = tables.table(narrow.groupBy("k1", "k2").agg(F.min("id").alias("rep")))
    wanted = reps.join(texts, "k1").select("k1", "k2", F.col("rep").alias("id"), "hashes")
    held = keyed.join(wanted, ["k1", "k2", "id"]).select("id", "k1", "t", "hashes")
    dealt = held.mapInArrow(lean(lambda it: _contexts(it, buckets)), _CONTEXT)
    ranges = tables.table(in_buckets(dealt, volume, lambda it: _merge(it, buckets, False), _CONTEXT))
    if ranges.filter(F.col("h").isNotNull()).limit(1).count():
        ranges = in_buckets(ranges, volume, lambda it: _merge(it, buckets, True), _CONTEXT)
    spans = tables.table(in_buckets(ranges, volume, _spans, "id long, k1 long, spans binary"))
    return narrow, reps, spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    with Tables(docs.sparkSession) as tables:
        narrow, reps, spans = removed_spans(docs, tables)
        cut = reps.join(spans, (reps["rep"] == spans["id"]) & (reps["k1"] == spans["k1"])).select(reps["k1"], "k2", "id", "spans")
        changed = tables.table(_documents(docs).join(cut, ["k1", "k2", "id"]).select("k1", "k2", "t", "spans").mapInArrow(lean(_kept), "k1 long, k2 int, n_removed long, n_spans long, kept_sha256 string")).distinct()
        whole = tables.table(reps.join(changed, ["k1", "k2"], "left"))
        rows = narrow.join(whole, ["k1", "k2"])  # copies of one text may be very many rows: a join that Spark can split
        copy = (F.col("id") > F.col("rep")) & (F.col("n_bytes") >= LENGTH)
        return tables.keep(
            rows.select(
                F.when(F.col("id") == NULL_ID, F.lit(None)).otherwise(F.col("id")).alias("doc_id"),
                "n_bytes",
                F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            )
        )
