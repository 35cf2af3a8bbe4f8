"""Best-fit packing: vector best-fit of token pieces into fixed-size sequences.

Documents are tokenized, closed with id 0, and cut into pieces of at most
``capacity.tokens`` ids (only longer documents are cut). A piece takes from three
capacities of a sequence: tokens, number of documents, and attention cost (the
sum of squared piece lengths). Pieces are placed in order of falling length; of
the open sequences that have room under every constraint, the one is selected
that leaves the smallest weighted residual norm, or that has the largest weighted
dot product of residual and piece; if none has room a new sequence is opened.

Scale: pieces (not texts) are dealt by hash into groups that fill about
``group_sequences`` sequences, and each group is packed by one task; a group
ends with a handful of sequences that are not full, so the loss against one huge
group is below about one part in a thousand. The number of groups follows the
number of tokens.

Edge cases: null and empty texts are documents of the single id 0; null doc_ids,
repeated rows and ties are packed like any other (ties in hash order); a piece
that exceeds a capacity on its own gets a sequence of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise
from ebbtide.llm.tokens import batches, encoder

END = 0


class Capacity(NamedTuple):
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


#: All three residuals rank the open sequences: tokens, documents, attention cost.
WEIGHTS = (1.0, 0.5, 0.5)
GROUP_SEQUENCES = 4096


def token_pieces(docs: DataFrame, tokenizer: str, tokens: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids (little-
    endian unsigned 32-bit) of each piece."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, spaces=False), END.to_bytes(4, "little")
        for b in parts:
            doc_ids = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in batches(texts):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[lo:hi], enc.encode([t or b"" for t in texts[lo:hi]])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * tokens)):
                        own = ids[at:at + 4 * tokens]
                        rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=NAMES)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, PIECES)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity(), rule: str = "norm",
             weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for each piece length."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    n = lengths.size
    seq, offset = np.empty(n, np.int64), np.zeros(n, np.int64)
    cap = np.array(capacity, np.int64)
    scale, w = 1.0 / cap, np.array(weights, float)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min(initial=1))
    room = np.empty((1024, 3), np.int64)  # open sequences: what each capacity has left
    number = np.empty(1024, np.int64)
    m = made = 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1, size * size], np.int64)
        fits = np.flatnonzero((room[:m] >= need).all(axis=1))
        if fits.size:
            if rule == "norm":
                left = (room[fits] - need) * scale
                k = fits[np.argmin((left * left) @ w)]
            else:
                k = fits[np.argmax((room[fits] * scale) @ (w * need * scale))]
        else:
            if m == number.size:
                room, number = np.concatenate([room, room]), np.concatenate([number, number])
            k = m
            room[k], number[k] = cap, made
            m, made = m + 1, made + 1
        seq[i], offset[i] = number[k], cap[0] - room[k, 0]
        room[k] -= need
        if (room[k] < (least, 1, least * least)).any():  # nothing fits any more: close it
            m -= 1
            room[k], number[k] = room[m], number[m]
    return seq, offset


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), rule: str = "norm",
         weights: tuple[float, float, float] = WEIGHTS, group_sequences: int = GROUP_SEQUENCES,
         with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; ``ids`` is null unless asked for."""
    pieces = materialise(token_pieces(docs, tokenizer, capacity.tokens, with_ids), "packing-pieces")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / (capacity.tokens * group_sequences)))
    # the place in the written table tells equal rows (repeated, or without an id) apart, so
    # that they spread over all groups; a repeated task reads the same places
    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", place), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        seq, offset = best_fit(t.column("length").to_numpy(), capacity, rule, weights)
        return (t.append_column("sequence_id", pa.array(seq + (t.column("grp")[0].as_py() << 32)))
                .append_column("offset", pa.array(offset)).drop_columns(["grp"]))

    return dealt.groupBy("grp").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")
