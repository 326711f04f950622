"""Removal of repeated byte strings by suffix arrays and longest previous factors.

A suffix array over all bytes would move many times the input. So the bytes that can matter are
found first, and suffix arrays are built over these alone. Every window of min_bytes bytes has
an anchor, its 20-byte string with the smallest hash, which equal windows have at the same
place. Windows can only be equal if their anchors are, so:

1. anchors meet by hash; those that two documents have are reported back to their documents;
2. each run of consecutive windows with one reported anchor becomes a segment, and segments meet
   by anchor; of these, runs of windows whose hashes several documents have are left. Equal
   runs are one entry, and a suffix array over all entries whose anchor has several gives the
   longest previous factor of every window's start, previous meaning in a document with a
   smaller id; factors of min_bytes or more are covered;
3. covered spans go back to their documents and are merged and cut out.

Work is combined before it moves: an anchor that many documents of a load share moves once, and
so does a segment that many of a slice share. What a load has for a bucket is one row, so rows
are loads times buckets. Both follow the input, but a load is many slices: rows stay large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._text import U64, chunks, mix
from skein.llm._work import Workspace, partitions

ANCHOR = 20
_SLICE = 2 << 20
#: Bytes of text, and of segments, whose rows for the buckets a task combines before they move.
_LOAD = 32 << 20
_SEGMENT_LOAD = 16 << 20
_compress = zstandard.ZstdCompressor(1).compress
_NULL_ID = -(2**63)


# ---- suffix arrays -------------------------------------------------------------------------


def _words64(data: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as a big-endian number, with zeros past the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n + 8, U64)
    for s in range(8):
        part = padded[s : s + (n + 8 - s) // 8 * 8].view(">u8")
        out[s : s + 8 * len(part) : 8] = part
    return out[:n]


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.zeros(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if len(keys) else 0
    return rank


def _prefix_ranks(data: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, 32, ... bytes, by prefix doubling up to one that
    has `longest` bytes. Past the end lies what is smaller than any byte."""
    n, length, ranks = len(data), 8, [_ranks(_words64(data))]
    while length < longest:
        keys = ranks[-1] << 32
        keys[: max(0, n - length)] += ranks[-1][length:] + 1
        ranks.append(_ranks(keys))
        length *= 2
    return ranks


def _common_prefixes(data: np.ndarray, ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, `most` at most: steps of halving
    lengths over what ranks say is equal, then the last bytes."""
    n, got = len(data), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if k == len(ranks) - 1 else 1):
            x, y = a + got, b + got
            same = (x < n) & (y < n)
            same[same] = ranks[k][x[same]] == ranks[k][y[same]]
            got += same * (8 << k)
    live = np.flatnonzero(got < most)
    for _ in range(8):
        x, y = a[live] + got[live], b[live] + got[live]
        inside = (x < n) & (y < n) & (got[live] < most[live])
        live, x, y = live[inside], x[inside], y[inside]
        live = live[data[x] == data[y]]
        got[live] += 1
    return np.minimum(got, most)


def longest_previous(data: np.ndarray, owners: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factors: for each of the suffixes at `starts`, which end with their
    segments at `ends`, the length of its longest common prefix with a suffix whose owner is
    smaller; 0 where that is under `least`. Segments are data in order, without gaps.

    A suffix array of the starts is sorted by prefix doubling, and the common prefixes of its
    neighbours are counted. For each entry the previous and the next one with a smaller owner
    are found by following pointers, with the least common prefix on the way: no other suffix
    of a smaller owner has more in common. All entries step at once; one stops where its
    common prefix falls under `least` or under what it has found on the other side."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    # an end is a byte that UTF-8 lacks in texts moved up by one, and smaller than all of them
    edges = np.unique(ends)
    apart = np.insert(data + np.uint8(1), edges, 0)
    starts, ends = starts + np.searchsorted(edges, starts, "right"), ends + np.searchsorted(edges, ends, "left")
    ranks = _prefix_ranks(apart, int((ends - starts).max()) + 1)
    order = np.argsort(ranks[-1][starts], kind="stable")
    at_, end_, owner = starts[order], ends[order], owners[order]
    common = np.zeros(n + 1, np.int64)  # of entries i - 1 and i
    common[1:n] = _common_prefixes(apart, ranks, at_[:-1], at_[1:], np.minimum((end_ - at_)[:-1], (end_ - at_)[1:]))
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        # entry i looks at at[i], with reach[i] bytes in common
        at = np.arange(n) + step
        reach = common[:n].copy() if step < 0 else common[1:].copy()
        live = np.flatnonzero(reach >= np.maximum(best + 1, least))
        jump, jump_reach = at.copy(), reach.copy()
        while len(live):
            seen = at[live]
            found = owner[seen] < owner[live]
            best[live[found]] = np.maximum(best[live[found]], reach[live[found]])
            live = live[~found]
            seen = at[live]
            reach[live] = np.minimum(reach[live], jump_reach[seen])
            at[live] = jump[seen]
            # what a neighbour has passed over is not smaller than it, so it can be skipped
            jump[live], jump_reach[live] = at[live], reach[live]
            live = live[reach[live] >= np.maximum(best[live] + 1, least)]
    out = np.zeros(n, np.int64)
    out[order] = best
    return out


# ---- anchors -------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of consecutive windows of one text with the same anchor: their first windows'
    starts, how many windows, and the anchors' hashes. A window's anchor is the leftmost
    smallest of its 20-byte strings. Works in blocks whose arrays stay in the cache."""
    n = len(data)
    begins, counts, places, found = [], [], [], []
    low_bits = U64((1 << 32) - 1)
    for s in range(0, n - length + 1, block):
        e = min(n - length + 1, s + block)  # windows s to e - 1
        part = data[s : e + length - 1]
        w = _words64(part)
        m = len(part) - ANCHOR + 1
        hashes = w[:m] * U64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> U64(29)
        hashes += w[8 : 8 + m] * U64(0xC2B2AE3D27D4EB4F)
        hashes ^= hashes >> U64(31)
        hashes += w[ANCHOR - 8 : ANCHOR - 8 + m] * U64(0x165667B19E3779F9)
        hashes = mix(hashes)
        low = hashes & ~low_bits
        low |= np.arange(m, dtype=U64)
        width, have = length - ANCHOR + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        place = (low & low_bits).astype(np.int64)
        good = np.ones(e - s, bool)
        for edge in offsets[np.searchsorted(offsets, s, "right") : np.searchsorted(offsets, e + length - 1, "left")] - s:
            good[max(0, edge - length + 1) : edge] = False  # windows across texts
        at = np.flatnonzero(good)
        if not len(at):
            continue
        place = place[at]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
        begins.append(at[first] + s)
        counts.append(np.diff(np.append(first, len(at))))
        places.append(place[first] + s)
        found.append(hashes[place[first]])
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    begin, count, place, hashed = (np.concatenate(x) for x in (begins, counts, places, found))
    # a run that a block's end cut in two
    whole = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + count[:-1])]))
    return begin[whole], np.add.reduceat(count, whole), hashed[whole]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: their lengths in bytes first."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return _compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))


def _unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    sizes = np.frombuffer(raw[: 8 * len(kinds)], np.int64)
    at = np.cumsum([8 * len(kinds), *sizes])
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(at, at[1:], kinds)]


def _planes(x: np.ndarray, low: int = 0) -> np.ndarray:
    """The bytes of 64-bit numbers from the `low`-th on: first all numbers' lowest, and so on."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, low:].T


def _from_planes(planes: np.ndarray, kind: type, low: int = 0) -> np.ndarray:
    full = np.zeros((len(planes) // (8 - low), 8), np.uint8)
    full[:, low:] = planes.reshape(8 - low, -1).T
    return full.view(kind).ravel()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Even ranges of the hashes' low halves, numbered; the high halves of anchors are small."""
    return (((hashes & U64((1 << 32) - 1)) * U64(buckets)) >> U64(32)).astype(np.int64)


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return np.array([_NULL_ID if i is None else i for i in rows.column("doc_id").to_pylist()], np.int64)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


_MOVED = [("bucket", pa.int64()), ("doc_id", pa.int64()), ("value", pa.binary())]
_MOVED_SQL = "bucket long, doc_id long, value binary"
_TOLD_SQL = "doc_id long, hash long"
_SPAN_SQL = "doc_id long, start long, length long"


# ---- the three steps -----------------------------------------------------------------------


def _offer(ids: np.ndarray, h: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Step 1 of a load, anchors h of the documents ids[owner]: to each bucket its anchors' hashes
    and documents, an anchor that several documents of the load have without one; and to these
    documents that they share it."""
    names, rank = np.unique(ids, return_inverse=True)
    order = np.argsort(h)
    h, owner = h[order], rank[owner[order]]
    same = h[1:] == h[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(h) else np.zeros(0, bool)
    one, one_owner = h[~several], owner[~several]
    # hashes that come more than once: by document, once each
    h, owner = h[several], owner[several]
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
    h, owner = h[new], owner[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    count = np.diff(np.append(first, len(h)))
    shared = np.repeat(count > 1, count)
    told = h[shared]
    for doc, part in _by_bucket(owner[shared]):
        yield int(names[doc]) % buckets, int(names[doc]), _pack(told[part])
    known = np.concatenate([np.ones(len(one), bool), count == 1])
    h, owner = np.concatenate([one, h[first]]), names[np.concatenate([one_owner, owner[first]])]
    order = np.argsort((h << U64(32)) | (h >> U64(32)))
    h, owner, known = h[order], np.where(known, owner, 0)[order], known[order]
    edges = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1)).tolist()
    for bucket in range(buckets):
        a, b = edges[bucket], edges[bucket + 1]
        if a < b:  # of the hash 48 bits
            yield bucket, None, _pack(_planes(h[a:b], 2), _planes(owner[a:b]), known[a:b])


def _offers(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1 of a task, load by load."""
    held, ids, hashes, owners = 0, [], [], []
    n = 0
    for rows, data, offsets in chunks(batches, "text", _SLICE):
        if held and held + len(data) > _LOAD:
            yield from _sent(_offer(np.concatenate(ids), np.concatenate(hashes), np.concatenate(owners), buckets))
            held, n, ids, hashes, owners = 0, 0, [], [], []
        begin, _, h = anchors(data, offsets, length)
        ids.append(_ids(rows))
        hashes.append(h)
        owners.append(np.searchsorted(offsets, begin, "right") - 1 + n)
        held, n = held + len(data), n + rows.num_rows
    if ids:
        yield from _sent(_offer(np.concatenate(ids), np.concatenate(hashes), np.concatenate(owners), buckets))


def _sent(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 1000)):
        yield _batch(some, _MOVED)


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Step 1 of a bucket: to each document its anchors that another one has, too."""
    values = table.column("value").to_pylist()
    docs = table.column("doc_id").to_pylist()
    told = [_unpack(v, "u8")[0] for d, v in zip(docs, values) if d is not None]
    whom = [np.full(len(h), d) for h, d in zip(told, (d for d in docs if d is not None))]
    found = [_unpack(v, "u1", "u1", "?") for d, v in zip(docs, values) if d is None]
    if found:
        h = np.concatenate([_from_planes(x, U64, 2) for x, _, _ in found])
        owner = np.concatenate([_from_planes(x, np.int64) for _, x, _ in found])
        known = np.concatenate([x for _, _, x in found])
        del found
        order = np.lexsort((owner, h))
        h, owner, known = h[order], owner[order], known[order]
        same = np.concatenate([[False], h[1:] == h[:-1]])
        # a group counts if any member lacks an id (it stands for several) or ids differ
        group = np.cumsum(~same) - 1
        many = np.zeros(int(group[-1]) + 1, bool)
        many[group[~known]] = True
        differs = same & np.concatenate([[False], owner[1:] != owner[:-1]])
        many[group[differs]] = True
        tell = many[group] & known
        told.append(h[tell])
        whom.append(owner[tell])
    told, whom = np.concatenate([np.zeros(0, U64), *told]), np.concatenate([np.zeros(0, np.int64), *whom])
    return pa.table({"doc_id": pa.array(whom, pa.int64()), "hash": pa.array((told >> U64(16)).astype(np.int64))})


def _segments(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[list[tuple], list[bytes], list[np.ndarray]]:
    """Step 2 of a slice: its segments, as their bytes and (windows, document, anchor, number of
    places, the places). Of equal segments only the smallest document's is one; the others'
    windows are covered, and the first value has (document, runs) to tell them."""
    ids = _ids(rows)
    begin, count, anchor = anchors(data, offsets, length)
    owner = np.searchsorted(offsets, begin, "right") - 1
    keep = np.zeros(len(begin), bool)
    edges = np.searchsorted(owner, np.arange(rows.num_rows + 1))
    short = (anchor >> U64(16)).astype(np.int64)  # reports have 48 bits
    shared = rows.column("shared")
    for k in range(rows.num_rows):
        a, b = edges[k], edges[k + 1]
        keep[a:b] = np.isin(short[a:b], shared[k].values.to_numpy())
    begin, count, anchor, owner = begin[keep], count[keep], anchor[keep], ids[owner[keep]]
    at = begin - np.repeat(offsets[:-1], np.diff(edges))[keep]
    raw, starts, ends, owners = data.tobytes(), begin.tolist(), (begin + count + length - 1).tolist(), owner.tolist()
    first: dict[bytes, int] = {}
    entry, covered, of, placed = [], [], [], []
    for i in np.argsort(owner, kind="stable").tolist():
        e = first.setdefault(raw[starts[i] : ends[i]], len(entry))
        if e == len(entry):
            entry.append(i)
        elif owners[entry[e]] < owners[i]:
            covered.append(i)
            continue
        of.append(e)  # a place of this entry, another one of the same document perhaps
        placed.append(i)
    entry, covered, of, placed = (np.array(x, np.int64) for x in (entry, covered, of, placed))
    names, place = np.unique(owner[covered], return_inverse=True)
    told = []
    for doc, part in _by_bucket(place):
        i = covered[part]
        runs = merged(np.column_stack([at[i], count[i] + length - 1]))
        told.append((int(names[doc]), np.column_stack([runs[:, 0], runs[:, 1] - runs[:, 0]])))
    places = at[placed[np.argsort(of, kind="stable")]]
    return told, list(first), [count[entry], owner[entry], anchor[entry], np.bincount(of, minlength=len(entry)), places]


def _segment_rows(pieces: list[bytes], parts: list[list[np.ndarray]], buckets: int) -> Iterator[tuple]:
    """Step 2 of a load: to each bucket its segments."""
    count, owner, anchor, n_places, places = (np.concatenate(x) for x in zip(*parts))
    bucket = _bucket(anchor, buckets)
    order = np.argsort(bucket, kind="stable")
    places = places[_spread((np.cumsum(n_places) - n_places)[order], n_places[order])].astype(np.uint32)
    count, owner, n_places = count[order].astype(np.uint32), owner[order], n_places[order].astype(np.uint32)
    bucket, anchor = bucket[order], (anchor[order] >> U64(32)).astype(np.uint32)
    place_at = np.concatenate([[0], np.cumsum(n_places, dtype=np.int64)])
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)]).tolist()
    order = order.tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        text = np.frombuffer(b"".join([pieces[j] for j in order[a:b]]), np.uint8)
        yield int(bucket[a]), None, _pack(text, count[a:b], _planes(owner[a:b]), anchor[a:b], n_places[a:b], places[place_at[a] : place_at[b]])


def _segment_loads(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 2 of a task, load by load."""
    held, pieces, parts = 0, [], []
    for rows, data, offsets in chunks(batches, "text", _SLICE):
        told, some, part = _segments(rows, data, offsets, length)
        yield from _sent((doc % buckets, doc, _pack(runs)) for doc, runs in told)
        pieces += some
        parts.append(part)
        held += int(part[0].sum()) + len(some) * (length - 1)
        if held >= _SEGMENT_LOAD:
            yield from _sent(_segment_rows(pieces, parts, buckets))
            held, pieces, parts = 0, [], []
    if parts:
        yield from _sent(_segment_rows(pieces, parts, buckets))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and its size, one after another."""
    begin = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begin, sizes)


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window of `length` (8 at least) bytes at each place that has one."""
    hashes, have = mix(_words64(data)[: max(0, len(data) - 7)]), 8
    while have < length:
        step = min(have, length - have)
        hashes = mix(hashes[: max(0, len(hashes) - step)] * U64(0x9E3779B97F4A7C15) + hashes[step:])
        have += step
    return hashes


def _repeated(text: np.ndarray, count: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of the segments can repeat: runs of windows whose hashes several documents have, as
    their segments, first windows and numbers of windows. Equal windows have equal hashes."""
    sizes = count + length - 1
    base, windows = np.cumsum(sizes) - sizes, np.cumsum(count)
    hashes = np.empty(int(count.sum()), U64)
    for a, b in _pieces(sizes, 1 << 16):  # arrays that stay in the cache
        here = _window_hashes(text[base[a] : base[b - 1] + sizes[b - 1]], length)
        hashes[windows[a] - count[a] : windows[b - 1]] = here[_spread(base[a:b] - base[a], count[a:b])]
    whose = np.repeat(np.arange(len(count), dtype=np.int32), count)
    # sorted by the hashes' upper bits, with the windows' numbers in the lower ones
    bits = U64(len(hashes).bit_length())
    hashes = (hashes >> bits << bits) | np.arange(len(hashes), dtype=U64)
    hashes.sort()
    order = (hashes & ((U64(1) << bits) - U64(1))).astype(np.int64)
    hashes >>= bits
    opens = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)])
    n = np.diff(np.append(opens, len(hashes)))
    order = order[np.repeat(n > 1, n)]  # others have nothing to equal
    n = n[n > 1]
    owners, opens = owner[whose[order]], np.cumsum(n) - n
    differ = np.minimum.reduceat(owners, opens) < np.maximum.reduceat(owners, opens) if len(n) else np.zeros(0, bool)
    at = np.sort(order[np.repeat(differ, n)])
    whose = whose[at]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (whose[1:] != whose[:-1])])[: len(at)])
    which = whose[first].astype(np.int64)
    return which, at[first] - (windows - count)[which], np.diff(np.append(first, len(at)))


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` in all, one at least in each."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + most, "right")))
        yield a, b
        a = b


def _entries(text: np.ndarray, sizes: np.ndarray, owner: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments, or runs of them, that a suffix array is built over, and those that are covered at
    once. Equal segments are one entry, the smallest document's; the other documents' are
    covered. An anchor with one entry left has no other window to equal."""
    raw, ends = text.tobytes(), np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    ends, first, entry, gone = ends.tolist(), {}, [], []
    owners = owner.tolist()
    for i in np.argsort(owner, kind="stable").tolist():
        k = first.setdefault(raw[starts[i] : ends[i]], i)
        (gone if owners[k] < owners[i] else entry).append(i)
    entry, gone = np.array(entry, np.int64), np.array(gone, np.int64)
    _, place, n = np.unique(anchor[entry], return_inverse=True, return_counts=True)
    return entry[n[place] > 1], gone


def _merged_by_owner(owner: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(owner, start, length) of the maximal runs of each owner's spans."""
    if not len(owner):
        return np.zeros((0, 3), np.int64)
    names, rank = np.unique(owner, return_inverse=True)
    shift = int((start + size).max()) + 2
    begin = rank * shift + start
    order = np.argsort(begin, kind="stable")
    begin, ends = begin[order], np.maximum.accumulate((begin + size)[order])
    opens = np.flatnonzero(np.concatenate([[True], begin[1:] > ends[:-1]]))
    ends = ends[np.append(opens[1:], len(begin)) - 1]
    begin, who = begin[opens], begin[opens] // shift
    return np.column_stack([names[who], begin - who * shift, ends - begin])


def _cover(length: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Step 2 of a bucket: the spans covered by windows with a longest previous factor of
        `length`."""
        values, docs = table.column("value").to_pylist(), table.column("doc_id").to_pylist()
        spans = [np.zeros((0, 3), np.int64)]
        for d, v in zip(docs, values):
            if d is not None:
                told = _unpack(v, "i8")[0].reshape(-1, 2)
                spans.append(np.column_stack([np.full(len(told), d), told]))
        found = [_unpack(v, "u1", "u4", "u1", "u4", "u4", "u4") for d, v in zip(docs, values) if d is None]
        if found:
            text, count, owner, anchor, n_places, places = zip(*found)
            del found, values
            owner = np.concatenate([_from_planes(x, np.int64) for x in owner])
            text, anchor = np.concatenate(text), np.concatenate(anchor)
            count, n_places, places = (np.concatenate(x).astype(np.int64) for x in (count, n_places, places))
            base_at = np.cumsum(n_places) - n_places
            which, skip, windows = _repeated(text, count, owner, length)
            sizes = windows + length - 1
            text = text[_spread((np.cumsum(count + length - 1) - count - length + 1)[which] + skip, sizes)]
            entry, gone = _entries(text, sizes, owner[which], anchor[which])

            def tell(run: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
                """A span within each of these runs, wherever their segments have a place."""
                of = which[run]
                n = n_places[of]
                spans.append(np.column_stack([np.repeat(owner[of], n), places[_spread(base_at[of], n)] + np.repeat(skip[run] + begin, n), np.repeat(size, n)]))

            tell(gone, np.zeros(len(gone), np.int64), sizes[gone])
            text = text[_spread((np.cumsum(sizes) - sizes)[entry], sizes[entry])]
            n, size = windows[entry], sizes[entry]
            base = np.cumsum(size) - size
            starts = _spread(base, n)
            factor = longest_previous(text, np.repeat(owner[which[entry]], n), starts, np.repeat(base + size, n), length)
            # a factor that long covers what it has in common with an earlier document
            hit = np.flatnonzero(factor >= length)
            if len(hit):
                run, within = np.repeat(np.arange(len(entry)), n)[hit], starts[hit] - np.repeat(base, n)[hit]
                run, within, covered = _merged_by_owner(run, within, factor[hit]).T
                tell(entry[run], within, covered)
        out = _merged_by_owner(*np.concatenate(spans).T)
        return pa.table(dict(zip(("doc_id", "start", "length"), map(pa.array, out.T))))

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs that (start, length) spans cover."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 0] + spans[:, 1])
    opens = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > ends[:-1]]))
    return np.stack([spans[opens, 0], ends[np.append(opens[1:], len(spans)) - 1]], 1)


def remove_repeats(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text) of every row.

    Each byte goes that is covered by a string of min_bytes (36 at least) UTF-8 bytes that also
    starts in a document with a smaller doc_id, judged on the texts as they came in. spans has
    the (start, length) in bytes of the maximal removed runs; text is what is left as binary, as
    a cut can fall inside a character.

    Null texts are empty; empty and short texts lose nothing. Rows that repeat a doc_id are one
    document in that they take nothing from each other. A null doc_id is smaller than any
    other. Other columns are not read. An empty table gives no rows.
    """
    if min_bytes < 36:
        raise ValueError("min_bytes must be 36 at least")
    spark = docs.sparkSession
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id")
    docs = docs.select(id_, F.col(text_col).cast("string").alias("text"))
    with Workspace(spark, "suffix-dedup") as w:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        # a bucket gets about a slice of text's anchors; many enough to deal evenly
        buckets = max(8 * partitions(spark), -(-size // _SLICE))

        def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _offers(batches, min_bytes, buckets)

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _segment_loads(batches, min_bytes, buckets)

        told = w.stage(docs.mapInArrow(offer, _MOVED_SQL).groupBy("bucket").applyInArrow(_answer, _TOLD_SQL))
        told = told.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list("hash").alias("shared"))
        asked = docs.join(told, docs["doc_id"] == told["__d"]).select("doc_id", "text", "shared")
        spans = w.stage(asked.mapInArrow(segments, _MOVED_SQL).groupBy("bucket").applyInArrow(_cover(min_bytes), _SPAN_SQL))
        spans = w.keep(spans.groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list(F.struct("start", "length")).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text", _SLICE):
            out = []
            told = rows.column("spans")
            for k, doc in enumerate(rows.column("doc_id").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                values = told[k].values
                gone = merged(np.column_stack([values.field("start").to_numpy(), values.field("length").to_numpy()]) if values else np.zeros((0, 2), np.int64))
                stay = np.ones(len(text), bool)
                for a, b in gone.tolist():
                    stay[a:b] = False
                left = text[stay].tobytes()
                runs = [{"start": a, "length": b - a} for a, b in gone.tolist()]
                out.append((None if doc == _NULL_ID else doc, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), runs, left))
            yield _batch(out, _RESULT)

    return docs.join(spans, docs["doc_id"] == spans["__d"], "left").select("doc_id", "text", "spans").mapInArrow(cut, _RESULT_SQL)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS), ("text", pa.binary())]
_RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, length: long>>, text binary"
