"""Token-id output: bit-plane shuffled, compressed id files with a chunk index.

Documents in ascending doc_id order are tokenized, closed with id 0 and written as
one stream of 32-bit ids, cut into shard files. A file holds blocks of ``BLOCK_IDS``
ids. A block is transposed into planes, 4 byte planes or 32 bit planes, and each
plane is compressed with zstandard on its own (a plane of zeros takes no bytes).
Behind the blocks stand the chunk index (place, number of ids and plane sizes of
each block) and the document index (doc_id and number of ids), then a footer that
points to both. ``PlaneFile`` reads any range of ids with range reads of the blocks
that hold it.

File format, all numbers little-endian:
    magic "IDPLANES", u8 planes per block (4 or 32)
    block: its planes one after the other, each a zstandard frame or nothing
    chunk index: per block u64 offset, u32 ids, u32 x planes sizes   (zstandard)
    document index: per document u8 has an id, i64 doc_id, u64 ids   (zstandard)
    footer: u64 offset of the chunk index, u64 of the document index, u64 ids,
            u64 documents, magic

Scale: documents are range-partitioned by doc_id once and sorted within each
partition by Spark; a task writes one shard as a stream, holding one block. A
shard's first id follows from the totals of the shards before it.

Edge cases: null and empty texts are the single id 0; null doc_ids come last;
rows with equal doc_ids are ordered by text; an empty table writes no file and
reads as an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import filesystem, materialise, partitions, scratch
from ebbtide.llm.tokens import batches, encoder

MAGIC = b"IDPLANES"
BLOCK_IDS = 1 << 16
#: Text that is encoded together: the larger, the fewer words are looked up twice.
ENCODE_BYTES = 4 << 20
END = 0
FOOTER = struct.Struct("<QQQQ8s")
DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("ids", "<u8")])


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The byte (4) or bit (32) planes of 32-bit ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes | None], n: int) -> np.ndarray:
    """The ids of planes; None is a plane of zeros."""
    planes = len(parts)
    if planes == 4:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(parts):
            if p is not None:
                raw[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(parts):
            if p is not None:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").ravel()


class PlaneWriter:
    """Writes a file as a stream; ``close`` renames it to its place."""

    def __init__(self, uri: str, planes: int = 4, level: int = 1):
        if planes not in (4, 32):
            raise ValueError("planes must be 4 or 32")
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.tmp = f"{self.path.rsplit('/', 1)[0]}/_tmp-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.planes, self.z = planes, zstandard.ZstdCompressor(level=level)
        self.pos = self.total = 0
        self.rest: list[bytes] = []
        self.held = 0
        self.chunks: list[bytes] = []
        self.docs: list[tuple] = []
        self._put(MAGIC + bytes([planes]))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.pos += len(data)

    def _block(self, ids: np.ndarray) -> None:
        at, sizes = self.pos, []
        for p in to_planes(ids, self.planes):
            packed = self.z.compress(p) if any(p) else b""
            sizes.append(len(packed))
            self._put(packed)
        self.chunks.append(struct.pack(f"<QI{self.planes}I", at, ids.size, *sizes))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's ids as little-endian unsigned 32-bit integers."""
        self.docs.append((doc_id is not None, doc_id or 0, len(ids) // 4))
        self.total += len(ids) // 4
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK_IDS:
            data = np.frombuffer(b"".join(self.rest), "<u4")
            full = data.size // BLOCK_IDS * BLOCK_IDS
            for k in range(0, full, BLOCK_IDS):
                self._block(data[k:k + BLOCK_IDS])
            self.rest = [data[full:].tobytes()]
            self.held = len(self.rest[0])

    def close(self) -> None:
        if self.held:
            self._block(np.frombuffer(b"".join(self.rest), "<u4"))
        chunk_at = self.pos
        self._put(self.z.compress(b"".join(self.chunks)))
        doc_at = self.pos
        self._put(self.z.compress(np.array(self.docs, DOC).tobytes()))
        self._put(FOOTER.pack(chunk_at, doc_at, self.total, len(self.docs), MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.path)


class PlaneFile:
    """Reads a file by its indexes."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        end = self.f.size() - FOOTER.size
        chunk_at, doc_at, self.total, _, magic = FOOTER.unpack(self.f.read_at(FOOTER.size, end))
        head = self.f.read_at(9, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{uri} is not an id-plane file")
        self.planes = head[8]
        z = zstandard.ZstdDecompressor()
        kind = np.dtype([("at", "<u8"), ("ids", "<u4"), ("sizes", "<u4", (self.planes,))])
        self.chunks = np.frombuffer(z.decompress(self.f.read_at(doc_at - chunk_at, chunk_at)), kind)
        self.docs = np.frombuffer(z.decompress(self.f.read_at(end - doc_at, doc_at)), DOC)
        self.first = np.concatenate([[0], np.cumsum(self.chunks["ids"].astype(np.int64))])
        self.z = z

    def block(self, k: int) -> np.ndarray:
        c = self.chunks[k]
        data = self.f.read_at(int(c["sizes"].sum()), int(c["at"]))
        parts, at = [], 0
        for n in c["sizes"].tolist():
            parts.append(self.z.decompress(data[at:at + n]) if n else None)
            at += n
        return from_planes(parts, int(c["ids"]))

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on."""
        if not count:
            return np.zeros(0, "<u4")
        lo = int(np.searchsorted(self.first, start, "right")) - 1
        hi = int(np.searchsorted(self.first, start + count, "left"))
        ids = np.concatenate([self.block(k) for k in range(lo, hi)])
        return ids[start - self.first[lo]:][:count]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) one after the other, each block decoded once."""
        have, k = np.zeros(0, "<u4"), 0
        for known, doc_id, n in self.docs.tolist():
            if have.size < n:
                more = [have]
                size = have.size
                while size < n:
                    more.append(self.block(k))
                    size += more[-1].size
                    k += 1
                have = np.concatenate(more)
            yield (doc_id if known else None), have[:n]
            have = have[n:]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, planes: int = 4) -> DataFrame:
    """Write the shard files into ``folder`` (shared storage); returns shard, uri,
    n_docs and n_ids of each, in order of the shard number."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, end, shard = encoder(tokenizer, spaces=True), END.to_bytes(4, "little"), TaskContext.get().partitionId()
        uri, out = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.planes", None
        for b in parts:
            doc_ids = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in batches(texts, ENCODE_BYTES):
                for doc_id, ids in zip(doc_ids[lo:hi], enc.encode([t or b"" for t in texts[lo:hi]])):
                    out = out or PlaneWriter(uri, planes)
                    out.add(doc_id, ids + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "n_docs": [len(out.docs)], "n_ids": [out.total]})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_last("doc_id"), F.asc_nulls_first("text")]
    ranged = src.repartitionByRange(partitions(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    return materialise(ranged.mapInArrow(run, "shard long, uri string, n_docs long, n_ids long"), "planes-shards")


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each
    document, from the files."""
    before = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")  # one row a file
    placed = shards.select("uri", before.alias("first"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for uri, at in zip(*(c.to_pylist() for c in b.columns)):
                cols: tuple[list, ...] = ([], [], [], [])
                for doc_id, ids in PlaneFile(uri).documents():
                    for c, v in zip(cols, (doc_id, at, ids.size, zlib.crc32(ids.tobytes()))):
                        c.append(v)
                    at += ids.size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    return placed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, planes: int = 4) -> DataFrame:
    return read_ids(write_ids(docs, scratch(docs.sparkSession, "planes"), tokenizer, planes))
