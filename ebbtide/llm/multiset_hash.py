"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A paragraph (line) is hashed to a wide vector of lanes; a text's fingerprint is the sum
of its paragraphs' vectors, modulo 2^16 in the lanes for equality and modulo 2^32 in
those for likeness. Sums commute, so the order of
paragraphs does not matter, and a paragraph is inserted or deleted by adding or
subtracting its vector, without the rest of the text.

The first ``WIDE`` lanes of a paragraph are uniform (SHAKE-128 of its bytes) and
carry equality: two texts with different paragraphs agree in all of them with a
chance of 2^-1024. The other ``SKETCH`` lanes carry likeness: every ``GRAM`` bytes of
the paragraph add +1 or -1 to one lane, so that differences of fingerprints keep
their size, and 1 - |A - B|^2 / (|A|^2 + |B|^2), lane differences taken around zero
modulo 2^32 (a text of 2 GB cannot reach beyond), estimates the share of common content (1 for equal texts, about 0 for
texts with nothing in common).

Edge cases: null and empty texts are one empty paragraph; repeated paragraphs count
as often as they occur; texts of any length take one vector (lane sums wrap, as all
sums here); two texts without any sketched content are alike only if equal; null
doc_ids follow all others, ties are ordered by text, a single document is its own
next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise, partitions

WIDE = 64
SKETCH = 256
GRAM = 12
MIX = np.uint64(0x9E3779B97F4A7C15)


def paragraphs_vector(paragraphs: list[bytes]) -> np.ndarray:
    """The sum of the paragraphs' vectors, as unsigned 32-bit lanes; sums and differences of
    vectors are ``reduced`` before they are compared or written."""
    out = np.zeros(WIDE + SKETCH, np.uint32)
    wide = np.frombuffer(b"".join([hashlib.shake_128(p).digest(2 * WIDE) for p in paragraphs]), "<u2")
    out[:WIDE] = wide.reshape(-1, WIDE).sum(axis=0, dtype=np.uint16)
    # grams of each paragraph; a shorter one is padded with zero bytes
    some = [p if len(p) >= GRAM else p.ljust(GRAM, b"\0") for p in paragraphs if p]
    if some:
        data = b"\n".join(some) + b"\n" * 8
        n = len(data) - 8
        word = np.ndarray((n,), "<u8", data, 0, (1,))
        h = (word[:n - GRAM + 1] * MIX) ^ word[GRAM - 8:n - GRAM + 1 + GRAM - 8]
        sizes = np.array([len(p) for p in some])
        if sizes.size > 1:  # leave out what spans two paragraphs
            ends = np.cumsum(sizes + 1)[:-1] - 1  # places of the separators
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, np.maximum(ends - GRAM + 1, 0), 1)
            np.add.at(edge, ends + 1, -1)
            h = h[np.cumsum(edge)[:h.size] == 0]
        h = h * MIX
        h ^= h >> np.uint64(31)
        h *= MIX
        code = (h >> np.uint64(55)).astype(np.int64)  # 8 bits lane, 1 bit sign
        c = np.bincount(code, minlength=2 * SKETCH)
        out[WIDE:] = (c[0::2] - c[1::2]).astype(np.uint32)
    return out


def reduced(vector: np.ndarray) -> np.ndarray:
    """The equality lanes modulo 2^16."""
    out = vector.copy()
    out[:WIDE] &= np.uint32(0xFFFF)
    return out


def as_bytes(vector: np.ndarray) -> bytes:
    return vector[:WIDE].astype("<u2").tobytes() + vector[WIDE:].astype("<u4").tobytes()


def text_vector(text: str) -> np.ndarray:
    return paragraphs_vector(text.encode().split(b"\n"))


def replace_from(vector: np.ndarray, text: str, cut: int, tail: str) -> np.ndarray:
    """The vector of text[:cut] + tail from that of ``text``: the paragraphs from the
    cut on are deleted, the new ones inserted."""
    start = text.rfind("\n", 0, cut) + 1
    gone, new = text[start:], text[start:cut] + tail
    return reduced(vector - paragraphs_vector(gone.encode().split(b"\n")) + paragraphs_vector(new.encode().split(b"\n")))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if (a == b).all():
        return 1.0
    x, y = a[WIDE:], b[WIDE:]
    size = [float((v.view(np.int32).astype(np.float64) ** 2).sum()) for v in (x, y, x - y)]
    return max(0.0, min(1.0, 1 - size[2] / (size[0] + size[1]))) if size[0] + size[1] else 0.0


FINGERPRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, vector as bytes) of each row."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([as_bytes(text_vector(t)) for t in texts], pa.binary())], names=["doc_id", "n_chars", "vector"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_chars long, vector binary")


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, tail, doc_id, text), dealt and sorted so that in a bucket each row
    with tail 0 is followed by the next document in ascending doc_id order; the row
    with tail 1 that ends a bucket is the first of the following one.

    The texts are shuffled once. Buckets are doc_id ranges; only their bounds and
    first ids, a few for each shuffle partition, pass through the driver."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = 4 * partitions(spark)
    bounds = src.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.full(len(ids), cuts.size + 1)
        out[known] = np.searchsorted(cuts, ids[known].astype("int64").to_numpy())
        return pd.Series(out)

    d = src.withColumn("bucket", bucket_of("doc_id"))
    first = {r[0]: r[1] for r in d.groupBy("bucket").agg(F.min("doc_id")).collect()}
    order = sorted(first)
    if not order:
        return d.select("bucket", F.lit(0).alias("tail"), "doc_id", "text")
    ids = [first[b] for b in order if first[b] is not None]
    heads = (d.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull())
             .groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("h")))
    before = spark.createDataFrame([(b, order[k - 1]) for k, b in enumerate(order)], "bucket int, before int")
    tails = heads.join(before, "bucket").select(F.col("before").alias("bucket"), F.lit(1).alias("tail"), "h.doc_id", "h.text")
    tails = materialise(tails, "next-heads")
    return (d.select("bucket", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)
            .repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.asc_nulls_last("doc_id"), "text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last quarter
    of the code points replaced by the beginning of the next document), and how alike
    its fingerprint is to the edited one's and to the next document's."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in parts:
            rows = []
            for bucket, tail, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                vec = text_vector(text)
                if held and held[0] == bucket:
                    _, own_id, own, own_vec = held
                    k = len(own) // 4
                    cut, new = len(own) - k, text[:k]
                    edited = replace_from(own_vec, own, cut, new)
                    rows.append((own_id, len(own), hashlib.sha256((own[:cut] + new).encode()).hexdigest(),
                                 as_bytes(own_vec).hex(), as_bytes(edited).hex(),
                                 likeness(own_vec, edited), likeness(own_vec, vec)))
                held = (bucket, doc_id, text, vec) if not tail else None
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[c.split()[0] for c in FINGERPRINTS.split(", ")])

    return with_next(docs).mapInArrow(run, FINGERPRINTS)
