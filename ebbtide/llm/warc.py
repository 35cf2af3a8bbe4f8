"""WARC archives with a two-level capture index.

``write_archive`` turns pages into WARC/1.1 records, each a gzip member of its own, in
archive files of a bounded size. Of pages with equal payloads of at least ``MIN_REVISIT``
bytes, the one with the smallest page_id is a response and the others are revisits of it
(identical-payload-digest profile); shorter payloads are always responses.

``build_index`` sorts the captures by reversed-host URL key and page_id over the whole
archive, writes them as compressed blocks of ``BLOCK_LINES`` lines, and keeps a sparse
directory with the first key of each block. ``lookup`` finds captures: a binary search
of the shards, one of the shard's directory, a range read of one block, a binary search
in it, then a range read of the record itself; revisits are resolved by a second lookup.

Scale: the pages are read once for their digests and once to be written (moved only if
the table of repeated digests is too large to be broadcast; Spark then splits hot
digests); the index is a range sort of small rows, with page_id behind the key, so a URL
or host with a third of all captures spreads over many shards. A task holds one record
and a few index blocks.

Edge cases: null html is an empty payload; null or odd URLs have the empty or a literal
key and no target header where null; control characters in URLs are percent-encoded in
headers; rows with a null page_id sort first and are revisits of the smallest page_id if
there is one; equal payloads whose rows all share the smallest page_id (repeated rows, or
none has an id) are all responses; repeated rows are all written, indexed and found; an
empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import filesystem, materialise, partitions, scratch

MIN_REVISIT = 100
FILE_BYTES = 256 << 20
BLOCK_LINES = 1024
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = -(1 << 63)


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query."""
    if not url:
        return ""
    scheme, sep, rest = url.strip().partition("://")
    if not sep:
        return url.strip()
    rest = rest.partition("#")[0]
    cut = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    default = {"http": "80", "https": "443"}.get(scheme.lower())
    port = f":{port}" if port and port != default else ""
    labels = ",".join(reversed(name.rstrip(".").split("."))) if not name.startswith("[") else name
    return f"{labels}{port}){path if path.startswith('/') else '/' + path}"


def _header_value(url: str) -> str:
    return "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: tuple[int, str | None] | None) -> bytes:
    """A WARC record as one gzip member; ``refers``: page_id and URL of the response
    that a revisit stands for."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers[0]}"]
        if refers[1]:
            head.append(f"WARC-Refers-To-Target-URI: {_header_value(refers[1])}")
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


CAPTURES = ("page_id long, key string, uri string, at long, size long, type string, digest string, "
            "refers_id long, refers_key string")


def write_archive(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archive files into ``folder``; returns one row for each capture."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    again = (p.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest")
             .agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
             .where("n > 1").select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("first_id"),
                                    F.col("first.url").alias("first_url")))
    again = materialise(again, "warc-repeated")
    j = p.join(again, p["digest"] == again["_digest"], "left").drop("_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            rows = []
            for page_id, url, html, digest, first, first_url in zip(*(c.to_pylist() for c in b.columns)):
                refers = (first, first_url) if first is not None and page_id != first else None
                data = record(page_id, url, html.encode(), digest, refers)
                if out is None:
                    uri = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    fs, path = filesystem(uri)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, at = fs.open_output_stream(path, compression=None), 0
                out.write(data)
                rows.append((page_id, url_key(url), uri, at, len(data), "revisit" if refers else "response", digest,
                             refers and refers[0], url_key(refers[1]) if refers else None))
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    out = None
            cols = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[c.split()[0] for c in CAPTURES.split(", ")])
        if out is not None:
            out.close()

    # the rows name the files of the attempts that ended well; others are never read
    return materialise(j.select("page_id", "url", "html", "digest", "first_id", "first_url").mapInArrow(run, CAPTURES), "warc-captures")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, int, str]]:
    """Write the index shards into ``folder``; returns (first key, first page_id, uri)
    of each shard, in order. A shard is its blocks, the directory (first key, first
    page_id, place and size of each block) and the place of the directory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        uri = f"{folder}/index-{uuid.uuid4().hex}.cdx"
        out, at, held, directory = None, 0, [], []

        def flush():
            nonlocal out, at, held
            if out is None:
                fs, path = filesystem(uri)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            data = z.compress(b"\n".join(held_line for _, _, held_line in held))
            out.write(data)
            directory.append(f"{held[0][0]}\t{held[0][1]}\t{at}\t{len(data)}")
            at, held = at + len(data), []

        for b in batches:
            for page_id, key, *rest in zip(*(c.to_pylist() for c in b.columns)):
                page = LEAST if page_id is None else page_id
                key = _plain(key)
                rest[-1] = None if rest[-1] is None else _plain(rest[-1])
                held.append((key, page, "\t".join([key, str(page), *("" if x is None else str(x) for x in rest)]).encode()))
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.write(z.compress("\n".join(directory).encode()) + struct.pack("<q", at))
            out.close()
            first = directory[0].split("\t")
            yield pa.RecordBatch.from_pydict({"key": [first[0]], "page_id": [int(first[1])], "uri": [uri]})

    # plain keys order as their lines do; null ids come first, as LEAST does
    order = [F.encode(F.translate("key", "\t\n\r", "   "), "UTF-8"), F.asc_nulls_first("page_id")]
    n = partitions(captures.sparkSession)
    shards = materialise(captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .mapInArrow(run, "key string, page_id long, uri string"), "warc-shards")
    return sorted(((r.key, r.page_id, r.uri) for r in shards.collect()), key=lambda s: (s[0].encode(), s[1]))


def _plain(key: str) -> str:
    """A key without the separators of an index line."""
    return key.translate({9: 32, 10: 32, 13: 32})


class _Latest(OrderedDict):
    """The values used last, up to a number."""

    def __init__(self, size: int):
        super().__init__()
        self.most = size

    def get_or(self, key, make):
        if key in self:
            self.move_to_end(key)
        else:
            self[key] = make()
            if len(self) > self.most:
                self.popitem(last=False)
        return self[key]


class CaptureIndex:
    """Finds captures and records, by range reads."""

    def __init__(self, shards: list[tuple[str, int, str]]):
        self.first = [(k.encode(), p) for k, p, _ in shards]
        self.uris = [u for _, _, u in shards]
        self.files, self.directories, self.blocks, self.digests = _Latest(64), _Latest(8), _Latest(16), _Latest(4096)

    def _read(self, uri: str, at: int, size: int) -> bytes:
        def opened():
            fs, path = filesystem(uri)
            return fs.open_input_file(path)
        return self.files.get_or(uri, opened).read_at(size, at)

    def _directory(self, uri: str):
        def load():
            fs, path = filesystem(uri)
            end = self.files.get_or(uri, lambda: fs.open_input_file(path)).size()
            at = struct.unpack("<q", self._read(uri, end - 8, 8))[0]
            lines = zstandard.ZstdDecompressor().decompress(self._read(uri, at, end - 8 - at)).decode().split("\n")
            rows = [x.split("\t") for x in lines]
            return [(r[0].encode(), int(r[1])) for r in rows], [(int(r[2]), int(r[3])) for r in rows]
        return self.directories.get_or(uri, load)

    def _block(self, uri: str, at: int, size: int):
        def load():
            rows = [x.split(b"\t") for x in zstandard.ZstdDecompressor().decompress(self._read(uri, at, size)).split(b"\n")]
            return [(r[0], int(r[1])) for r in rows], rows
        return self.blocks.get_or((uri, at), load)

    def find(self, key: str, page_id: int | None) -> Iterator[list[str]]:
        """The captures of a key and page_id: page_id, uri, at, size, type, digest,
        refers_id and refers_key of each."""
        want = (_plain(key).encode(), LEAST if page_id is None else page_id)
        # the last shard and block that start before the wanted key, and those that
        # start with it (equal rows may run over several)
        s = max(0, _before(self.first, want))
        while s < len(self.uris) and (self.first[s] <= want):
            firsts, places = self._directory(self.uris[s])
            k = max(0, _before(firsts, want))
            while k < len(firsts) and firsts[k] <= want:
                keys, rows = self._block(self.uris[s], *places[k])
                i = _before(keys, want) + 1
                while i < len(keys) and keys[i] == want:
                    yield [x.decode() for x in rows[i][1:]]
                    i += 1
                k += 1
            s += 1

    def record(self, uri: str, at: int, size: int) -> tuple[dict[str, str], bytes]:
        return parse(self._read(uri, at, size))

    def payload(self, key: str, page_id: int, digest: str) -> tuple[int, str]:
        """(bytes, SHA-256) of the response that a revisit refers to."""
        def load():
            for c in self.find(key, page_id):
                if c[4] == "response" and c[5] == digest:
                    body = self.record(c[1], int(c[2]), int(c[3]))[1]
                    return len(body), hashlib.sha256(body).hexdigest()
            raise LookupError(f"no response {page_id} for a revisit")
        return self.digests.get_or((key, page_id, digest), load)


def _before(keys: list, want) -> int:
    """The place of the last of the sorted keys below ``want``; -1 if there is none."""
    return bisect_left(keys, want) - 1


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def lookup(pages: DataFrame, shards: list[tuple[str, int, str]]) -> DataFrame:
    """The captures of each different (page_id, url) of ``pages``, read from the
    archives through the index."""
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).distinct()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([url_key(u) for u in b.column(1).to_pylist()], pa.string())], names=["page_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(shards)
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(6))
            for page_id, key in zip(*(c.to_pylist() for c in b.columns)):
                for _, uri, at, size, _, _, refers_id, refers_key in index.find(key, page_id):
                    fields, body = index.record(uri, int(at), int(size))
                    if fields["WARC-Type"] == "revisit":
                        target = int(fields["X-Refers-To-Page-Id"])
                        n, digest = index.payload(refers_key, int(refers_id), fields["WARC-Payload-Digest"].partition(":")[2])
                    else:
                        target, n, digest = None, len(body), hashlib.sha256(body).hexdigest()
                    own = fields.get("X-Page-Id")
                    row = (None if own is None else int(own), n, digest, fields["WARC-Type"], target, fields.get("WARC-Target-URI"))
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[c.split()[0] for c in FOUND.split(", ")])

    ranged = (wanted.mapInArrow(keys, "page_id long, key string").distinct()
              .repartitionByRange(partitions(pages.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id"))
    return ranged.mapInArrow(run, FOUND)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, index them, and read every one back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    captures = write_archive(pages, folder)
    return lookup(pages, build_index(captures, folder))
