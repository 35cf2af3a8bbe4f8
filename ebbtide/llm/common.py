"""Helpers shared by the operators: tables, scratch tables, shared files, blocks.

Intermediate results go to the folder named by ``spark.checkpoint.dir`` (shared
by all executors). Tables go there as Parquet through Spark; byte formats are
written by the tasks with ``pyarrow.fs`` (local, HDFS or object store, by the
scheme of the folder) under a temporary name and then renamed, so a retried task
never leaves a half file.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import scratch_dir

#: Text per block of ``write_blocks``: large enough to amortise a task, small
#: enough that the arrays built from it stay far below a Python worker's memory.
BLOCK_BYTES = 4 << 20


#: Tables that operators keep in a Python worker from task to task.
KEPT: list[dict] = []


def give_up_kept() -> None:
    """Spark's Python workers outlive a step. The tasks of a step that keeps no tables
    give up those of the steps before, which would count beside their own arrays."""
    for own in KEPT:
        own.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts the lineage, and a
    lost executor costs a read instead of the work before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(file system, path) of a folder or file on shared storage."""
    from pyarrow import fs
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, *parts: bytes) -> None:
    """Write a file under a temporary name, then rename it."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{os.path.dirname(path)}/_tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp, compression=None) as out:
        for p in parts:
            out.write(p)
    fs.move(tmp, path)


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(f.size() - start if length is None else length, start)


# ---------------------------------------------------------------------------
# Blocks: documents packed into compressed files that later passes read again
# without moving the texts through another shuffle.
# ---------------------------------------------------------------------------
MANIFEST = "block long, uri string, n_docs long, n_bytes long"


def pack_block(ids: list[int | None], texts: list[bytes], rows: list[pa.RecordBatch] | None = None) -> bytes:
    """ids (null allowed), texts and whole rows to one compressed byte string."""
    n = len(ids)
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    arr = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    z = zstandard.ZstdCompressor(level=1)
    first = z.compress(b"".join([struct.pack("<q", n), known.tobytes(), arr.tobytes(), lens.tobytes(), *texts]))
    sink = pa.BufferOutputStream()
    if rows:
        with pa.ipc.new_stream(sink, rows[0].schema) as w:
            for r in rows:
                w.write_batch(r)
    return struct.pack("<q", len(first)) + first + z.compress(sink.getvalue().to_pybytes())


def read_block(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(known, ids, starts, bytes) of a block; text i is bytes[starts[i]:starts[i + 1]]."""
    head = struct.unpack("<q", read_range(uri, 0, 8))[0]
    raw = zstandard.ZstdDecompressor().decompress(read_range(uri, 8, head))
    n = struct.unpack_from("<q", raw)[0]
    known = np.frombuffer(raw, np.uint8, n, 8).astype(bool)
    ids = np.frombuffer(raw, np.int64, n, 8 + n)
    lens = np.frombuffer(raw, np.int64, n, 8 + 9 * n)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    return known, ids, starts, raw[8 + 17 * n:]


def read_rows(uri: str) -> pa.Table:
    """The whole rows of a block written with ``whole_rows``."""
    head = struct.unpack("<q", read_range(uri, 0, 8))[0]
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(read_range(uri, 8 + head))).read_all()


def write_blocks(docs: DataFrame, name: str, block_bytes: int = BLOCK_BYTES, whole_rows: bool = False) -> DataFrame:
    """Pack (doc_id, text) into block files, reading the input once and without
    a shuffle; returns the written manifest. Null texts count as empty. With
    ``whole_rows`` the block also holds all other columns of its rows.

    A block is closed when it holds ``block_bytes`` of text, so one longer text
    is a block of its own."""
    spark = docs.sparkSession
    folder = scratch(spark, name)
    others = [c for c in docs.columns if c != "text"] if whole_rows else []

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        rows: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal ids, texts, rows, size, seq
            uri = f"{folder}/block-{part:06d}-{seq:06d}-{uuid.uuid4().hex}"
            write_file(uri, pack_block(ids, texts, rows))
            row = {"block": [(part << 24) | seq], "uri": [uri], "n_docs": [len(ids)], "n_bytes": [size]}
            ids, texts, rows, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            more = pa.RecordBatch.from_arrays(b.columns[2:], names=others) if others else None
            last = 0
            for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= block_bytes or k == b.num_rows - 1:
                    if more is not None:
                        rows.append(more.slice(last, k + 1 - last))
                    last = k + 1
                if size >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    src = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").cast("string").alias("_text"), *others)
    return materialise(src.mapInArrow(pack, MANIFEST), f"{name}-manifest")


def spread(manifest: DataFrame) -> tuple[DataFrame, int, int]:
    """The manifest dealt over enough tasks (about two blocks each, no fewer than
    the session's shuffle partitions), with its numbers of tasks and bytes."""
    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(partitions(manifest.sparkSession), n // 2)))
    return manifest.repartition(tasks), tasks, size
