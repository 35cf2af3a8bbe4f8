"""SimHash near-dedup with a byte-position inverted index and count filtering.

A text is lower-cased (A-Z), cut into words at ASCII white space, and every
``shingle`` consecutive words (repeats included; the whole sequence if shorter)
votes with the 64 bits of its XXH64. A fingerprint bit is 1 if it is set in over
half the votes.

Two fingerprints that differ in at most d bits share at least 8 - d of their
eight bytes, position by position: the guaranteed minimum. The inverted index has
a posting key for each choice of one position less with the bytes there, so pairs
that share a byte too few meet as well, and a pair that can link meets in every
choice of its shared positions. Within a posting the shared positional bytes of
each pair are tallied, pairs that do not reach the minimum are dropped, the others
are verified by bit distance, and of the verified links only a spanning forest
leaves the posting. A posting of more than ``SPLIT`` fingerprints is first split by
each further byte position, since a pair that reaches the minimum shares one more
byte. The index holds distinct fingerprints only, so however many copies a text
has they are one entry; a split posting holds at most 256^d of them (65,536 for two
bits) whatever the input.

Connected components of the links give each document the smallest doc_id that
it reaches.

Edge cases: null and empty texts, and texts of white space only, have
fingerprint zero, which links like any other; null doc_ids are kept, and a
component whose documents all lack an id has a null component_id; repeated rows
stay and get equal results; an empty table gives an empty result; other columns
are ignored by ``simhash_groups`` and kept by ``simhash_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import give_up_kept, materialise, partitions
from ebbtide.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Rows of the distance matrix handled at once in a posting.
TILE = 512
#: Fingerprints of a posting from which on it is split by a further byte.
SPLIT = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of UTF-8 bytes."""
    words = text.lower().split()  # bytes: only A-Z, and 20 09-0D, as the definition asks
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
    votes = np.zeros(64, np.uint64)
    for s in range(0, h.size, 65536):
        part = h[s:s + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return int(np.packbits(votes * np.uint64(2) > np.uint64(h.size), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp), fp a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_kept()
        for b in batches:
            fps = [fingerprint(t or b"", shingle, seed) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair of fingerprints shares."""
    differ = a[:, None] ^ b[None, :]
    return (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)


def posting_links(fps: np.ndarray, max_bits: int, split: int = SPLIT) -> list[tuple[int, int]]:
    """Links (places in ``fps``) that connect the near fingerprints of a posting."""
    if fps.size <= split:
        return _forest(fps, max_bits)
    links = []
    for p in range(8):
        byte = (fps >> np.uint64(8 * p)) & np.uint64(255)
        if (byte == byte[0]).all():
            continue  # a position of the key
        order = np.argsort(byte, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
            links += [(int(own[x]), int(own[y])) for x, y in _forest(fps[own], max_bits)]
    return links


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the verified links: pairs whose tally reaches the minimum and
    whose bits are near."""
    n, least = fps.size, 8 - max_bits
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for s in range(0, n, TILE):
        for t in range(s, n, TILE):
            a, b = fps[s:s + TILE], fps[t:t + TILE]
            i, j = np.nonzero(tally(a, b) >= least)
            if s == t:
                i, j = i[i < j], j[i < j]
            ok = np.bitwise_count(a[i] ^ b[j]) <= max_bits
            for x, y in zip((s + i[ok]).tolist(), (t + j[ok]).tolist()):
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[rx] = ry
                    links.append((x, y))
    return links


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints ``fps`` (column
    fp) that lie within ``max_bits`` of each other, by way of the inverted index."""
    if not 0 <= max_bits < 8:
        raise ValueError("max_bits must be 0 to 7")
    masks = [sum(0xFF << (8 * p) for p in keep) for keep in combinations(range(8), max(1, 7 - max_bits))]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    # few bytes become many index rows: spread them before, not by their size (by a hash of
    # their own, since rows grouped by fp already would stay in the few tasks that hold them)
    dealt = fps.repartition(partitions(fps.sparkSession), F.xxhash64("fp"))
    index = dealt.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "bytes"))
    postings = (index.groupBy("k", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
                .select("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(col.value_lengths().to_numpy())
            a, b = [], []
            start = 0
            for end in ends.tolist():
                own = np.sort(flat[start:end].view(np.uint64))
                start = end
                for x, y in posting_links(own, max_bits):
                    a.append(own[x])
                    b.append(own[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (a, b)],
                                             names=["a", "b"])

    return postings.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row."""
    rows = materialise(with_fingerprint(docs, shingle, seed), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(fps.select("fp"), max_bits))
    member = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = materialise(member, "simhash-member")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    cls = member.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(cls, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, **params) -> DataFrame:
    """One document of each component, with its own columns: that with the
    smallest doc_id. Rows that share a doc_id are one document and stay or go
    together; rows without a doc_id stay."""
    groups = simhash_groups(docs, **params)
    drop = groups.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_id"], "left_anti")
