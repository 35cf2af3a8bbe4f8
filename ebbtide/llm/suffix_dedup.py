"""Suffix-array dedup: repeated byte strings by merging shard Burrows-Wheeler
transforms.

A byte is removed if it is covered by a string of ``length`` bytes that also
starts in a document with a smaller doc_id; strings are judged on the input and
never cross documents. The work is cut so that the load of a task does not follow
from how often one string occurs:

1. Texts are packed into block files (``write_blocks``), which later passes read
   without another shuffle.
2. Every window of ``length`` bytes has an anchor: the smallest hash of its
   ``length - width + 1`` substrings of ``width`` bytes. Equal windows have equal
   anchors, so a window whose anchor occurs in one document only cannot repeat.
   Each block sends its distinct anchors, as 5-byte values beside the bucket
   number, and gets back which of them occur in two documents. Colliding hashes
   only let a window through that repeats nothing.
3. Runs of consecutive windows with one surviving anchor are segments. A block
   sends each distinct segment once, with the smallest doc_id it has there, to
   the bucket of the anchor; equal windows meet in one bucket. An anchor whose
   segments, distinct in each block, hold ``bucket_bytes`` or more (a phrase that is
   too short to be a repeat but stands in many contexts) is hot: its windows go one
   by one to buckets of their own, by a hash of all their bytes.
   There are as many buckets as the surviving segments' bytes, which step 2 adds up,
   fill with ``bucket_bytes`` each on average, whatever share of the text survives; no anchor adds more than ``bucket_bytes``
   to it, and one window adds ``length`` bytes for each block that has it.
4. In a bucket the distinct segments are dealt into shards. Each shard gets a
   suffix array by prefix doubling and its Burrows-Wheeler transform. The shards
   are merged by refining their interleave: each pass orders it by a few more
   symbols, moving every element along the last-to-first mapping of its own shard,
   so the suffixes are not sorted again. Two neighbours that part in a pass have a
   common prefix that ends in it; an interval that is still together after
   ``length`` symbols is a repeated string. Elements whose interval has shrunk to
   one leave the refinement. Windows of hot anchors are whole strings already and
   need no transform. The smallest doc_id of each interval goes back to the blocks.
5. Each block marks, for every occurrence of a segment, the windows whose string
   has a smaller doc_id than the occurrence's, and cuts the covered bytes.

Edge cases: null texts count as empty; rows with a null doc_id come after all
others (and are not distinguished from each other: a string shared by such rows
only is kept in all of them, as no doc_id is smaller); rows that share a doc_id
are one document to the rule, so they do not remove each other's bytes; texts
shorter than ``length`` stay whole; a text of any size is one entry of its block
and its runs of equal windows are cut at ``MAX_SEGMENT``; an empty table gives an
empty result. ``suffix_dedup`` returns one row per input row; ``dedup_texts``
keeps all columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import give_up_kept, materialise, read_block, read_range, read_rows, spread, write_blocks, write_file

LENGTH = 50
WIDTH = 20
#: Longest segment in windows; a longer run is cut (each window stays in one).
MAX_SEGMENT = 4096
#: Text of a bucket and of a shard within it, in bytes.
BUCKET_BYTES = 2 << 20
SHARD_BYTES = 512 << 10
#: Windows whose anchors are made at once.
SLICE = 1 << 17
#: Anchors per bucket of step 2.
BUCKET_ANCHORS = 1 << 20
#: Symbols that one pass of the merge adds (at most 4).
STRIDE = 4
NO_ID = np.iinfo(np.int64).max
MIX = np.uint64(0x9E3779B97F4A7C15)
SENTINEL = 0xFF  # never part of UTF-8


# --- anchors ----------------------------------------------------------------
def window_anchors(raw: np.ndarray, length: int, width: int) -> np.ndarray:
    """The anchor of each window of ``length`` bytes of ``raw`` (uint8)."""
    n = raw.size - width + 1
    buf = raw.tobytes() + b"\0" * 8
    word = np.ndarray((raw.size,), np.uint64, buf, 0, (1,))  # 8 bytes from each position
    offs = list(range(0, width - 7, 8))
    if offs[-1] != width - 8:
        offs.append(width - 8)
    h = np.zeros(n, np.uint64)
    for o in offs:
        h ^= word[o:o + n]
        h *= MIX
        h ^= h >> np.uint64(32)
    span, have = length - width + 1, 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < span:
        h = np.minimum(h[:h.size - (span - have)], h[span - have:])
    return h


def _runs(block, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (text number, first window as a position
    in the block's bytes, windows, anchor). Anchors are made for ``SLICE`` windows at a
    time; only the runs grow with the block."""
    _, _, starts, data = block
    raw = np.frombuffer(data, np.uint8)
    cols: list[tuple] = []
    windows, last = 0, None
    for s in range(0, raw.size - length + 1, SLICE):
        anchor = window_anchors(raw[s:s + SLICE + length - 1], length, width)
        # the texts that the slice lies in
        lo, hi = np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, s + anchor.size)
        n = np.diff(np.clip(starts[lo:hi + 1], s, s + anchor.size))
        # windows that lie within one text
        pos = s + np.flatnonzero(np.arange(s + length, s + length + anchor.size) <= np.repeat(starts[lo + 1:hi + 1], n))
        if not pos.size:
            continue
        a, t = anchor[pos - s], np.repeat(np.arange(lo, hi), n)[pos - s]
        new = np.ones(pos.size, bool)
        new[0] = (a[0], t[0], pos[0] - 1) != last  # else the run of the slice before goes on
        new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        cols.append((t[first], pos[first], first + windows, a[first]))
        windows, last = windows + pos.size, (a[-1], t[-1], pos[-1])
    if not cols:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    t, pos, first, a = map(np.concatenate, zip(*cols))
    size = np.diff(np.append(first, windows))
    if size.max(initial=0) > MAX_SEGMENT:  # periodic text: cut at fixed steps
        parts = -(-size // MAX_SEGMENT)
        run = np.repeat(np.arange(first.size), parts)
        k = np.arange(run.size) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(size[run] - k * MAX_SEGMENT, MAX_SEGMENT)
        t, pos, a = t[run], pos[run] + k * MAX_SEGMENT, a[run]
    return t, pos, size, a


def _window_hashes(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ``at`` (ascending) by all their bytes, a slice at a time."""
    out = np.empty(at.size, np.uint64)
    steps = range(0, raw.size, SLICE)
    for s, i, j in zip(steps, np.searchsorted(at, steps), np.searchsorted(at, [s + SLICE for s in steps])):
        if i < j:
            out[i:j] = window_anchors(raw[s:s + SLICE + length - 1], length, length)[at[i:j] - s]
    return out


def _bucket_of(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _distinct_anchors(block, runs, n_buckets: int):
    """Distinct anchors of a block by (bucket, low 40 bits), with a flag for those
    in two documents of the block, and each run's place in that order."""
    known, ids, _, _ = block
    t, _, _, a = runs
    # documents, not rows: rows with one doc_id are one document
    doc = np.unique(np.where(known, ids, NO_ID - 1 - np.arange(ids.size)), return_inverse=True)[1]
    low = a & np.uint64((1 << 39) - 1)
    bucket = _bucket_of(a, n_buckets)
    key = (bucket.astype(np.uint64) << np.uint64(39)) | low
    order = np.argsort(key, kind="stable")
    ks, ds = key[order], doc[t[order]]
    new = np.ones(ks.size, bool)
    new[1:] = ks[1:] != ks[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    place = np.empty(ks.size, np.int64)
    place[order] = group
    twice = np.zeros(first.size, bool)
    if first.size:
        twice = np.maximum.reduceat(ds, first) > np.minimum.reduceat(ds, first)
    return ks[first], twice, place


def _segment_bytes(block, runs, place: np.ndarray, n: int, length: int, exact_from: int) -> np.ndarray:
    """The bytes of the segments of each of a block's ``n`` distinct anchors; those of
    ``exact_from`` bytes or more count equal segments once."""
    data = block[3]
    _, pos, size, _ = runs
    total = np.bincount(place, size + length - 1, n).astype(np.int64)
    big = total >= exact_from
    if big.any():
        own = np.flatnonzero(big[place])
        seen: dict[int, set[bytes]] = {}
        for g, p, k in zip(place[own].tolist(), pos[own].tolist(), size[own].tolist()):
            seen.setdefault(g, set()).add(data[p:p + k + length - 1])
        for g, segments in seen.items():
            total[g] = sum(map(len, segments))
    return total


def _to_code(size: np.ndarray) -> np.ndarray:
    """Sizes as one byte each, on a logarithmic scale, rounded up."""
    return np.minimum(np.ceil(8 * np.log2(size / 64 + 1)), 255).astype(np.uint8)


def _from_code(code: np.ndarray) -> np.ndarray:
    return np.ceil(64 * (2.0 ** (code / 8) - 1)).astype(np.int64)


def _anchor_rows(manifest: DataFrame, n_buckets: int, length: int, width: int, hot_bytes: int) -> DataFrame:
    """(bucket, block, data, weight): for each block and bucket its distinct anchors,
    five bytes each, the top bit set for those in two documents, and the bytes of
    their segments as codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_kept()
        for b in batches:
            for block_id, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                block = read_block(uri)
                runs = _runs(block, length, width)
                keys, twice, place = _distinct_anchors(block, runs, n_buckets)
                code = _to_code(_segment_bytes(block, runs, place, keys.size, length, max(1, hot_bytes >> 6)))
                value = (keys & np.uint64((1 << 39) - 1)) | (twice.astype(np.uint64) << np.uint64(39))
                five = value.view(np.uint8).reshape(-1, 8)[:, :5]
                bucket = (keys >> np.uint64(39)).astype(np.int64)
                ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
                some = np.flatnonzero(np.diff(ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some), pa.array(np.full(some.size, block_id)),
                     pa.array([five[ends[k]:ends[k + 1]].tobytes() for k in some.tolist()], pa.binary()),
                     pa.array([code[ends[k]:ends[k + 1]].tobytes() for k in some.tolist()], pa.binary())],
                    names=["bucket", "block", "data", "weight"])

    return manifest.select("block", "uri").mapInArrow(run, "bucket long, block long, data binary, weight binary")


def _repeated_anchors(rows: DataFrame, hot_bytes: int) -> DataFrame:
    """(block, bucket, bits, hot, heavy, light): which of the anchors sent occur in two
    documents, which of these are hot (null if none), and the bytes of the segments of
    the hot ones and of the others."""
    def run(t: pa.Table) -> pa.Table:
        data = t.column("data").to_pylist()
        sizes = np.array([len(d) // 5 for d in data])
        wide = np.zeros((sizes.sum(), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 5)
        value = wide.view(np.uint64).ravel()
        twice = (value >> np.uint64(39)).astype(bool)
        value &= np.uint64((1 << 39) - 1)
        s = np.sort(value)
        again = np.sort(np.concatenate([s[1:][s[1:] == s[:-1]], value[twice]]))
        hit = np.zeros(value.size, bool)
        if again.size:
            at = np.minimum(np.searchsorted(again, value), again.size - 1)
            hit = again[at] == value
        weight = _from_code(np.frombuffer(b"".join(t.column("weight").to_pylist()), np.uint8))
        weight[~hit] = 0
        hot = np.zeros(value.size, bool)
        if again.size:
            # an anchor's bytes over all blocks, added up at its first place in ``again``
            total = np.bincount(np.searchsorted(again, value[hit]), weight[hit], again.size)
            hot[hit] = total[np.searchsorted(again, value[hit])] >= hot_bytes
        parts = [slice(e - n, e) for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"),
                         "bits": pa.array([np.packbits(hit[p]).tobytes() for p in parts], pa.binary()),
                         "hot": pa.array([np.packbits(hot[p]).tobytes() if hot[p].any() else None for p in parts], pa.binary()),
                         "heavy": pa.array([int(weight[p][hot[p]].sum()) for p in parts], pa.int64()),
                         "light": pa.array([int(weight[p][~hot[p]].sum()) for p in parts], pa.int64())})

    return rows.groupBy("bucket").applyInArrow(run, "block long, bucket long, bits binary, hot binary, heavy long, light long")


# --- segments ----------------------------------------------------------------
def _surviving(block, bits: dict[int, bytes], hot: dict[int, bytes], n_buckets: int, length: int, width: int):
    """The runs of a block whose anchor occurs in two documents: (of anchors that are
    not hot, of hot ones)."""
    runs = _runs(block, length, width)
    keys, _, place = _distinct_anchors(block, runs, n_buckets)
    ends = np.searchsorted((keys >> np.uint64(39)).astype(np.int64), np.arange(n_buckets + 1))

    def flags(packed: dict[int, bytes]) -> np.ndarray:
        flag = np.zeros(keys.size, bool)
        for k, v in packed.items():
            n = ends[k + 1] - ends[k]
            flag[ends[k]:ends[k + 1]] = np.unpackbits(np.frombuffer(v, np.uint8), count=n).astype(bool)
        return flag[place] if keys.size else np.zeros(0, bool)

    repeated, heavy = flags(bits), flags(hot)
    return tuple(x[repeated & ~heavy] for x in runs), tuple(x[repeated & heavy] for x in runs)


def _segments(block, runs, n_parts: int, length: int):
    """For each part of the anchors: the distinct segments in order of appearance,
    the smallest doc_id of each, and for the runs their part and segment number."""
    known, ids, _, data = block
    t, pos, size, a = runs
    doc = np.where(known, ids, NO_ID)[t]
    part = ((a >> np.uint64(17)) % np.uint64(n_parts)).astype(np.int64)
    seen: list[dict[bytes, int]] = [{} for _ in range(n_parts)]
    least: list[list[int]] = [[] for _ in range(n_parts)]
    number = np.empty(pos.size, np.int64)
    over = length - 1
    for r, (p, s, n, d) in enumerate(zip(part.tolist(), pos.tolist(), size.tolist(), doc.tolist())):
        own = seen[p]
        seg = data[s:s + n + over]
        k = own.get(seg)
        if k is None:
            k = own[seg] = len(own)
            least[p].append(d)
        elif d < least[p][k]:
            least[p][k] = d
        number[r] = k
    return seen, least, part, number


def _dealt_windows(block, runs, n_parts: int, length: int):
    """The windows of hot runs, dealt one by one into ``n_parts`` by a hash of their
    bytes: (text number, position, part, segment number) of each window in order of
    the parts, and (position, smallest doc_id, part) of each distinct window. Windows
    whose hashes collide may be listed twice; the part's task merges them."""
    known, ids, _, data = block
    t, pos, size, _ = runs
    if not t.size:
        none = np.zeros(0, np.int64)
        return (none,) * 4, (none,) * 3
    at, text = np.repeat(pos, size) + _ramp(size), np.repeat(t, size)
    raw = np.frombuffer(data, np.uint8)
    code = _window_hashes(raw, at, length)
    part = ((code >> np.uint64(17)) % np.uint64(n_parts)).astype(np.int64)
    doc = np.where(known, ids, NO_ID)[text]
    order = np.lexsort((doc, code, part))
    at, text, part, code, doc = at[order], text[order], part[order], code[order], doc[order]
    new = np.ones(at.size, bool)
    new[1:] = code[1:] != code[:-1]
    window = np.lib.stride_tricks.sliding_window_view(raw, length)
    like = np.flatnonzero(~new)
    for k in range(0, like.size, 1 << 16):
        own = like[k:k + (1 << 16)]
        new[own] = (window[at[own]] != window[at[own - 1]]).any(axis=1)
    first = np.flatnonzero(new)
    base = np.searchsorted(part[first], np.arange(n_parts))
    number = np.cumsum(new) - 1 - base[part]
    # a group begins with its smallest doc_id
    return (text, at, part, number), (at[first], doc[first], part[first])


def _bits_by_block(table: pa.Table, name: str) -> dict[int, bytes]:
    return {k: v for k, v in zip(table.column("bucket").to_pylist(), table.column(name).to_pylist()) if v is not None}


def _runs_uri(uri: str) -> str:
    return f"{uri}.runs"


def _write_runs(uri: str, t: np.ndarray, pos: np.ndarray, size: np.ndarray, part: np.ndarray, number: np.ndarray,
                windows: list[np.ndarray]) -> None:
    """Keep a block's surviving runs, with their segments' numbers and windows, for
    the last pass. The content depends on the block only, so a retry writes the same."""
    raw = b"".join([np.array([t.size, len(windows)], np.int64).tobytes(), t.astype(np.int64).tobytes(),
                    pos.astype(np.int64).tobytes(), size.astype(np.int64).tobytes(), part.astype(np.int64).tobytes(),
                    number.astype(np.int64).tobytes(), np.array([w.size for w in windows], np.int64).tobytes(), *windows])
    write_file(_runs_uri(uri), zstandard.ZstdCompressor(level=1).compress(raw))


def _read_runs(uri: str):
    """(t, pos, size, part, number) and the windows of each part's segments."""
    raw = zstandard.ZstdDecompressor().decompress(read_range(_runs_uri(uri)))
    n, parts = np.frombuffer(raw, np.int64, 2).tolist()
    cols = [np.frombuffer(raw, np.int64, n, 16 + 8 * n * k) for k in range(5)]
    at = 16 + 40 * n
    counts = np.frombuffer(raw, np.int64, parts, at)
    return cols, np.split(np.frombuffer(raw, np.int32, -1, at + 8 * parts), np.cumsum(counts)[:-1])


def _segment_rows(flagged: DataFrame, n_buckets: int, n_parts: int, n_hot: int, length: int, width: int) -> DataFrame:
    """(part, block, segments, sizes, docs) from (block, uri, bucket, bits, hot); the
    windows of hot anchors have the ``n_hot`` parts behind the others."""
    def run(t: pa.Table) -> pa.Table:
        uri = t.column("uri")[0].as_py()
        block = read_block(uri)
        runs, hot = _surviving(block, _bits_by_block(t, "bits"), _bits_by_block(t, "hot"), n_buckets, length, width)
        seen, least, part, number = _segments(block, runs, n_parts, length)
        (wt, wpos, wpart, wnumber), (at, doc, dealt) = _dealt_windows(block, hot, n_hot, length)
        ends = np.searchsorted(dealt, np.arange(n_hot + 1))
        windows = [np.array([len(x) - length + 1 for x in own], np.int32) for own in seen]
        windows += [np.ones(n, np.int32) for n in np.diff(ends).tolist()]
        _write_runs(uri, *(np.concatenate(c) for c in zip((*runs[:3], part, number),
                                                          (wt, wpos, np.ones(wt.size, np.int64), wpart + n_parts, wnumber))), windows)
        z = zstandard.ZstdCompressor(level=1)
        some = [p for p in range(n_parts) if seen[p]]
        segments = [z.compress(b"".join(seen[p])) for p in some]
        sizes = [np.array([len(s) for s in seen[p]], np.int32).tobytes() for p in some]
        docs = [np.array(least[p], np.int64).tobytes() for p in some]
        if at.size:
            window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(block[3], np.uint8), length)
            for p in np.unique(dealt).tolist():
                own = slice(ends[p], ends[p + 1])
                some.append(n_parts + p)
                segments.append(z.compress(window[at[own]].tobytes()))
                sizes.append(np.full(at[own].size, length, np.int32).tobytes())
                docs.append(doc[own].tobytes())
        return pa.table({
            "part": pa.array(some, pa.int64()),
            "block": pa.array([t.column("block")[0].as_py()] * len(some), pa.int64()),
            "segments": pa.array(segments, pa.binary()),
            "sizes": pa.array(sizes, pa.binary()),
            "docs": pa.array(docs, pa.binary()),
        })

    return flagged.groupBy("block").applyInArrow(run, "part long, block long, segments binary, sizes binary, docs binary")


# --- Burrows-Wheeler transforms and their merge ---------------------------------
def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (uint8, fewer than 2^20, taken cyclically) ordered by
    their first ``depth`` bytes or more, by prefix doubling."""
    n = text.size
    place = np.arange(n, dtype=np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = (key << np.uint64(8)) | np.roll(text, -k)
    have = 5
    while True:
        packed = np.sort((key << np.uint64(20)) | place)
        sa = (packed & np.uint64((1 << 20) - 1)).astype(np.int64)
        if have >= depth:
            return sa
        top = packed >> np.uint64(20)
        rank = np.empty(n, np.uint64)
        rank[sa] = np.cumsum(np.concatenate([[False], top[1:] != top[:-1]]), dtype=np.uint64)
        if rank[sa[-1]] == n - 1:
            return sa
        key = (rank << np.uint64(20)) | np.roll(rank, -have)
        have *= 2


def shard_bwt(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, transform, last-to-first mapping) of a shard's text."""
    sa = suffix_array(text, depth)
    n = text.size
    inverse = np.empty(n, np.int32)
    inverse[sa] = np.arange(n, dtype=np.int32)
    before = sa - 1
    before[before < 0] = n - 1
    return sa.astype(np.int32), text[before], inverse[before]


def _jump(bwt: np.ndarray, lf: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """For each element the ``steps`` symbols before it (the farthest in the highest
    byte) and where the last-to-first mapping leads in as many steps."""
    code, to = np.zeros(bwt.size, np.uint32), np.arange(bwt.size, dtype=np.int32)
    for k in range(steps):
        code |= bwt[to].astype(np.uint32) << np.uint32(8 * k)
        to = lf[to]
    return code, to


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms to ``depth`` symbols. Returns (place, interval): the
    elements, as positions in the shards' concatenated text, of the strings of
    ``depth`` symbols that occur twice, and the number of the interval of each.

    A pass prepends up to ``STRIDE`` symbols to the common prefixes."""
    offset = np.cumsum([0] + [s[0].size for s in shards])
    if offset[-1] >= 1 << 31:
        raise ValueError("a bucket must stay below 2^31 bytes")
    sa = np.concatenate([s[0] + np.int32(o) for s, o in zip(shards, offset)])
    bwt = np.concatenate([s[1] for s in shards])
    lf = np.concatenate([s[2] + np.int32(o) for s, o in zip(shards, offset)])
    # the interleave starts as one shard after the other; one interval for all
    at = np.arange(sa.size, dtype=np.int32)
    interval = np.zeros(sa.size, np.int32)
    todo = [STRIDE] * (depth // STRIDE) + [depth % STRIDE] * (depth % STRIDE > 0)
    for k, steps in enumerate(todo):
        if at.size < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        if not k or steps != todo[k - 1]:
            code = to = None  # one of them at a time
            code, to = _jump(bwt, lf, steps)
        # stable by the symbols: (symbols, place in the interleave) sorted as one number
        packed = code[at].astype(np.uint64)
        packed <<= np.uint64(32)
        packed |= np.arange(at.size, dtype=np.uint32)
        packed.sort()
        order = packed.astype(np.uint32).view(np.int32)  # the low half
        packed >>= np.uint64(32)
        symbols = packed.astype(np.uint32)
        del packed
        old = interval[order]
        # neighbours that part here have a common prefix that ends within this pass
        part = np.empty(at.size + 1, bool)
        part[0] = part[-1] = True
        part[1:-1] = (symbols[1:] != symbols[:-1]) | (old[1:] != old[:-1])
        keep = ~(part[1:] & part[:-1])
        at = to[at[order[keep]]]
        interval = np.cumsum(part[:-1][keep], dtype=np.int32)
    return sa[at], interval


def least_documents(segments: list[bytes], docs: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES):
    """For each segment and each of its windows the smallest doc_id of all windows
    with that string: (least, starts), flat over the segments' windows."""
    sizes = np.array([len(s) for s in segments], np.int64)
    windows = sizes - length + 1
    starts = np.concatenate([[0], np.cumsum(windows)])
    least = np.repeat(docs, windows)
    if (windows == 1).all():  # the segments are distinct, and so are their only windows
        return least, starts
    # deal whole segments into shards
    shard_of = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) // shard_bytes if len(segments) else np.zeros(0, np.int64)
    shards, place = [], []
    base = 0
    for k in np.unique(shard_of).tolist():
        own = np.flatnonzero(shard_of == k)
        text = np.frombuffer(bytes([SENTINEL]).join(segments[i] for i in own.tolist()) + bytes([SENTINEL]), np.uint8)
        shards.append(shard_bwt(text, length))
        # text position -> window number, -1 where no whole window starts
        where = np.full(text.size, -1, np.int32)
        begin = np.concatenate([[0], np.cumsum(sizes[own] + 1)[:-1]])
        at = np.repeat(begin, windows[own]) + _ramp(windows[own])
        where[at] = np.repeat(starts[own], windows[own]) + _ramp(windows[own])
        place.append(where)
        base += text.size
    if not shards:
        return least, starts
    pos, interval = merged_intervals(shards, length)
    window = np.concatenate(place)[pos]
    ok = window >= 0
    window, interval = window[ok], interval[ok]
    if window.size:
        order = np.argsort(interval, kind="stable")
        w, g = window[order], interval[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        small = np.minimum.reduceat(least[w], first)
        least[w] = np.repeat(small, np.diff(np.append(first, w.size)))
    return least, starts


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each of the sizes, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _least_rows(rows: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(block, part, least): for each block's segments of a part, in its order,
    the smallest doc_id of each window, as runs."""
    def run(t: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        number: dict[bytes, int] = {}
        least: list[int] = []
        own: list[list[int]] = []
        for seg, size, doc in zip(*(t.column(c).to_pylist() for c in ("segments", "sizes", "docs"))):
            data, at, nums = z.decompress(seg), 0, []
            for n, d in zip(np.frombuffer(size, np.int32).tolist(), np.frombuffer(doc, np.int64).tolist()):
                s = data[at:at + n]
                at += n
                k = number.get(s)
                if k is None:
                    k = number[s] = len(number)
                    least.append(d)
                elif d < least[k]:
                    least[k] = d
                nums.append(k)
            own.append(nums)
        small, starts = least_documents(list(number), np.array(least, np.int64), length, shard_bytes)
        out = []
        c = zstandard.ZstdCompressor(level=1)
        for nums in own:
            k = np.array(nums)
            n = starts[k + 1] - starts[k]
            flat = small[np.repeat(starts[k], n) + _ramp(n)]
            cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            out.append(c.compress(np.array([cut.size], np.int64).tobytes() + flat[cut].tobytes()
                                  + np.diff(np.append(cut, flat.size)).astype(np.int32).tobytes()))
        return pa.table({"block": t.column("block"), "part": t.column("part"), "least": pa.array(out, pa.binary())})

    return rows.groupBy("part").applyInArrow(run, "block long, part long, least binary")


# --- cutting ---------------------------------------------------------------------
def _unpack_least(v: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(v)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.repeat(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n))


def _cut_block(block, uri: str, least: dict[int, bytes], length: int) -> np.ndarray:
    """A mask of the block's bytes that go; ``least`` as ``_least_rows`` packs it."""
    known, ids, _, data = block
    (t, pos, size, part, number), windows = _read_runs(uri)
    doc = np.where(known, ids, NO_ID)[t]
    edge = np.zeros(len(data) + 1, np.int32)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(len(windows) + 1))
    for p, packed in least.items():
        v = _unpack_least(packed)
        own = order[bounds[p]:bounds[p + 1]]
        starts = np.concatenate([[0], np.cumsum(windows[p])])
        n = size[own]
        step = _ramp(n)
        hit = v[np.repeat(starts[number[own]], n) + step] < np.repeat(doc[own], n)
        at = (np.repeat(pos[own], n) + step)[hit]
        # windows start at different places, so plain index sums are enough
        edge[at] += 1
        edge[at + length] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
          "span_starts array<long>, span_ends array<long>")


def _cut_blocks(work: DataFrame, length: int, finish, schema) -> DataFrame:
    """``finish(uri, block, mask)`` for each block of (block, uri, part, least), with
    the mask of the bytes that go."""
    def run(t: pa.Table) -> pa.Table:
        uri = t.column("uri")[0].as_py()
        block = read_block(uri)
        least = {p: v for p, v in zip(t.column("part").to_pylist(), t.column("least").to_pylist())
                 if v is not None}
        return finish(uri, block, _cut_block(block, uri, least, length))

    return work.groupBy("block").applyInArrow(run, schema)


def _dealt_segments(manifest: DataFrame, length: int, width: int, bucket_bytes: int, bucket_anchors: int,
                    hot_bytes: int) -> tuple[DataFrame, int]:
    """The segments dealt to buckets (see ``_segment_rows``) and the number of tasks
    for the blocks; anchors of ``hot_bytes`` or more are dealt by their windows."""
    blocks, tasks, n_bytes = spread(manifest)
    per_byte = 2 / (length - width + 2)  # anchors of random text
    n_buckets = max(1, round(n_bytes * per_byte / bucket_anchors))
    flags = materialise(_repeated_anchors(_anchor_rows(blocks, n_buckets, length, width, hot_bytes), hot_bytes), "suffix-flags")
    heavy, light = flags.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("heavy", "light"))).first()
    # by what survives, be it a little of the text or all of it
    n_parts = max(1, math.ceil(light / bucket_bytes))
    # a hot segment's windows, for runs as long as they are where nothing is periodic
    span = length - width + 1
    n_hot = max(1, math.ceil(heavy * span * length / (span + length - 1) / bucket_bytes))
    # rows are few and the work behind them large, so tasks go by blocks, not by bytes
    flagged = manifest.select("block", "uri").join(flags.drop("heavy", "light"), "block", "left").repartition(tasks, "block")
    return _segment_rows(flagged, n_buckets, n_parts, n_hot, length, width), tasks


def _repeats(docs: DataFrame, length: int, width: int, bucket_bytes: int, shard_bytes: int, bucket_anchors: int,
             whole_rows: bool, finish, schema) -> DataFrame:
    if not 8 <= width <= length:
        raise ValueError("width must lie between 8 and length")
    if shard_bytes + MAX_SEGMENT + length >= 1 << 20:
        raise ValueError("shard_bytes must stay below 2^20 less a segment")
    manifest = write_blocks(docs, "suffix-blocks", whole_rows=whole_rows)
    rows, tasks = _dealt_segments(manifest, length, width, bucket_bytes, bucket_anchors, bucket_bytes)
    least = materialise(_least_rows(rows, length, shard_bytes), "suffix-least")
    work = manifest.select("block", "uri").join(least, "block", "left").repartition(tasks, "block")
    return _cut_blocks(work, length, finish, schema)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES,
                 shard_bytes: int = SHARD_BYTES, bucket_anchors: int = BUCKET_ANCHORS, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, null
    unless ``texts``), span_starts and span_ends (the removed runs) for each row."""
    def finish(uri: str, block, cut: np.ndarray) -> pa.Table:
        known, ids, starts, data = block
        raw = np.frombuffer(data, np.uint8)
        cols: dict[str, list] = {k.split()[0]: [] for k in RESULT.split(", ")}
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            own = cut[a:b]
            step = np.diff(own.astype(np.int8), prepend=0, append=0)
            begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            kept = raw[a:b][~own].tobytes() if begin.size else data[a:b]
            row = (int(ids[i]) if known[i] else None, b - a, b - a - len(kept), begin.size,
                   hashlib.sha256(kept).hexdigest(), kept if texts else None, begin.tolist(), end.tolist())
            for c, v in zip(cols.values(), row):
                c.append(v)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary(), "span_starts": pa.list_(pa.int64()),
                 "span_ends": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()})

    return _repeats(docs, length, width, bucket_bytes, shard_bytes, bucket_anchors, False, finish, RESULT)


def dedup_texts(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES,
                shard_bytes: int = SHARD_BYTES, bucket_anchors: int = BUCKET_ANCHORS) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; all rows and columns stay.
    Where a cut leaves part of a UTF-8 character, that part goes too. A null text
    becomes an empty one."""
    names = docs.columns

    def finish(uri: str, block, cut: np.ndarray) -> pa.Table:
        _, _, starts, data = block
        raw = np.frombuffer(data, np.uint8)
        text = [raw[a:b][~cut[a:b]].tobytes().decode("utf-8", "ignore")
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        rows = read_rows(uri)
        return pa.table([pa.array(text, pa.string()) if c == "text" else rows.column(c) for c in names], names=names)

    schema = docs.withColumn("text", F.col("text").cast("string")).schema
    return _repeats(docs, length, width, bucket_bytes, shard_bytes, bucket_anchors, True, finish, schema)
