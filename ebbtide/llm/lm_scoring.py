"""LM scoring with a weighted backoff automaton.

Training counts word n-grams up to ``order`` (texts lower-cased A-Z, cut at ASCII
white space, closed with an end token). With Dirichlet smoothing

    p(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | h)   = (c(h w) + MU p(w | h')) / (c(h) + MU)      h' : h without its first word

the model is an automaton: each seen history is a state, each seen n-gram an arc with
its log probability, and a failure arc leads from h to h' with weight MU / (c(h) + MU).
A text is scored by one left-to-right pass that carries the state, takes the arc of
the next word or follows failure arcs until there is one, and adds up the weights.

Scale: the automaton of a large corpus fits no task, so each block of documents
(``write_blocks``) gets the part that its texts can reach. A block sends its distinct
n-grams as hashes, with its training counts (map-side combine), to buckets; a bucket
adds up the counts and answers each block in the order of its question. An n-gram in a
third of all texts is one entry a block. Nothing but N and V reaches the driver. Words
are told apart by 64 bits of XXH64, longer n-grams by 48 bits beside the bucket number.

Edge cases: null and empty texts have the end token only; words of any length are one
token; rows with a null doc_id are not held out; repeated rows count and score each;
without training rows every count is 0 and the scores are finite (V = 0, one unseen
word has all the mass); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import materialise, read_block, spread, write_blocks

ORDER = 2
MU = 300.0
ADD = 0.1
#: Text bytes for each bucket of n-grams of one order.
BUCKET_BYTES = 6 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
START, END = 0, 1  # numbers of the two marks in a block's vocabulary
LOW = np.uint64((1 << 48) - 1)


def held_out(doc_id: int | None, of: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == 0


class BlockGrams:
    """The n-grams of a block: for each order the gram at every position, and for
    each distinct gram its training count, hash, history and shorter suffix."""

    def __init__(self, uri: str, order: int, of: int):
        known, ids, starts, data = read_block(uri)
        self.ids = [int(i) if k else None for k, i in zip(known.tolist(), ids.tolist())]
        self.held = [held_out(i, of) for i in self.ids]
        vocabulary: dict[bytes, int] = {b"\0<": START, b"\0>": END}  # never words: they would hold white space
        tokens: list[int] = []
        sizes = []
        low = data.lower()
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            words = low[a:b].split()
            for w in set(words).difference(vocabulary):
                vocabulary[w] = len(vocabulary)
            tokens.append(START)
            tokens.extend(map(vocabulary.__getitem__, words))
            tokens.append(END)
            sizes.append(len(words) + 2)
        self.sizes = np.array(sizes, np.int64)
        self.tokens = np.array(tokens, np.int64)
        first = np.concatenate([[0], np.cumsum(self.sizes)])
        place = np.arange(self.tokens.size) - np.repeat(first[:-1], self.sizes)  # in its text
        train = np.repeat(~np.array(self.held, bool), self.sizes).astype(np.int64)
        n = len(vocabulary)
        h = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, n)
        count = np.bincount(self.tokens, train, n).astype(np.int64)
        # by order: gram at each position (-1: none), counts, hashes, history, suffix, last word
        self.at = [self.tokens]
        self.counts, self.hashes = [count], [h]
        self.history: list[np.ndarray] = [np.zeros(n, np.int64)]
        self.suffix: list[np.ndarray] = [np.zeros(n, np.int64)]
        self.word: list[np.ndarray] = [np.arange(n)]
        for k in range(2, order + 1):
            pos = np.flatnonzero(place >= k - 1)
            key = self.at[-1][pos - 1] * n + self.tokens[pos]
            kinds, index, inverse = np.unique(key, return_index=True, return_inverse=True)
            at = np.full(self.tokens.size, -1)
            at[pos] = inverse
            hist, word = kinds // n, kinds % n
            hh = (self.hashes[-1][hist] * MIX) ^ (h[word] + np.uint64(k))
            hh *= MIX
            hh ^= hh >> np.uint64(31)
            self.history.append(hist)
            self.word.append(word)
            self.suffix.append(self.at[-1][pos[index]])
            self.counts.append(np.bincount(inverse, train[pos], kinds.size).astype(np.int64))
            self.hashes.append(hh)
            self.at.append(at)

    def asked(self, k: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Grams of order k + 1 in the order of a block's question, and the bounds of
        the buckets. The mark of a text's start is never asked for."""
        h = self.hashes[k]
        bucket = ((h >> np.uint64(48)) * np.uint64(n_buckets)) >> np.uint64(16) if n_buckets <= 1 << 16 else \
            (h >> np.uint64(16)) % np.uint64(n_buckets)
        key = h if k == 0 else h & LOW
        order = np.lexsort((key, bucket))
        if k == 0:
            order = order[order != START]
        return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Integers as compressed byte planes."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _integers(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def _width(k: int) -> int:
    return 8 if k == 0 else 6


def _questions(manifest: DataFrame, n_buckets: int, order: int, of: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, uri in zip(*(c.to_pylist() for c in b.columns)):
                g = BlockGrams(uri, order, of)
                for k in range(order):
                    asked, ends = g.asked(k, n_buckets)
                    key, count = g.hashes[k][asked], g.counts[k][asked]
                    some = np.flatnonzero(np.diff(ends)).tolist()
                    cut = [(ends[j], ends[j + 1]) for j in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int64()),
                         pa.array([block] * len(some), pa.int64()),
                         pa.array([_planes(key[a:z], _width(k)) for a, z in cut], pa.binary()),
                         pa.array([_planes(count[a:z], 4) for a, z in cut], pa.binary())],
                        names=["k", "bucket", "block", "keys", "counts"])

    return manifest.select("block", "uri").mapInArrow(run, "k int, bucket long, block long, keys binary, counts binary")


def _answers(rows: DataFrame) -> DataFrame:
    """(block, k, bucket, counts, n, v): the whole corpus's counts of what each block
    asked; the row with a null block has the bucket's sum and number of seen grams."""
    def run(t: pa.Table) -> pa.Table:
        k, bucket = t.column("k")[0].as_py(), t.column("bucket")[0].as_py()
        keys = [_integers(d, _width(k)) for d in t.column("keys").to_pylist()]
        own = np.concatenate([_integers(d, 4) for d in t.column("counts").to_pylist()])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        total = np.add.reduceat(own[order], np.flatnonzero(new))
        full = np.empty(key.size, np.uint64)
        full[order] = total[np.cumsum(new) - 1]
        ends = np.cumsum([x.size for x in keys]).tolist()
        out = [_planes(full[e - x.size:e], 8) for x, e in zip(keys, ends)]
        m = len(out) + 1
        return pa.table({
            "block": pa.array([*t.column("block").to_pylist(), None], pa.int64()), "k": pa.array([k] * m, pa.int32()),
            "bucket": pa.array([bucket] * m, pa.int64()), "counts": pa.array([*out, None], pa.binary()),
            "n": pa.array([0] * (m - 1) + [int(total.sum())], pa.int64()),
            "v": pa.array([0] * (m - 1) + [int((total > 0).sum())], pa.int64())})

    return rows.groupBy("k", "bucket").applyInArrow(run, "block long, k int, bucket long, counts binary, n long, v long")


class Automaton:
    """The part of the backoff automaton that a block's texts can reach. State 0 has
    no history; ``arcs`` maps (state, word) to (log probability, next state)."""

    def __init__(self, g: BlockGrams, counts: list[np.ndarray], n: int, v: int, mu: float):
        order, size = len(counts), counts[0].size
        p = (counts[0] + ADD) / (n + ADD * (v + 1))
        self.size, self.root = size, np.log10(p).tolist()
        # a state for each seen gram that can be a history
        self.fail, self.weight = [0], [0.0]
        state = [np.zeros(c.size, np.int64) for c in counts]
        for k in range(order - 1):
            seen = np.flatnonzero((counts[k] > 0) & (g.word[k] != END))
            state[k][seen] = np.arange(seen.size) + len(self.fail)
            self.fail += (state[k - 1][g.suffix[k][seen]] if k else np.zeros(seen.size, np.int64)).tolist()
            self.weight += np.log10(mu / (counts[k][seen] + mu)).tolist()
        self.next0 = state[0].tolist() if order > 1 else [0] * size
        self.start = int(state[0][START]) if order > 1 else 0
        self.arcs: dict[int, tuple[float, int]] = {}
        for k in range(1, order):
            hist = g.history[k]
            p = (counts[k] + mu * p[g.suffix[k]]) / (counts[k - 1][hist] + mu)
            seen = np.flatnonzero(counts[k] > 0)
            after = state[k][seen] if k < order - 1 else state[k - 1][g.suffix[k][seen]]
            key = state[k - 1][hist[seen]] * size + g.word[k][seen]
            self.arcs.update(zip(key.tolist(), zip(np.log10(p[seen]).tolist(), after.tolist())))

    def score(self, words: list[int]) -> float:
        """The log10 probability of a text's words and end token."""
        arc, size, root, next0, fail, weight = self.arcs.get, self.size, self.root, self.next0, self.fail, self.weight
        state, total = self.start, 0.0
        for w in words:
            a = arc(state * size + w)
            while a is None and state:
                total += weight[state]
                state = fail[state]
                a = arc(state * size + w) if state else None
            if a is None:
                total += root[w]
                state = next0[w]
            else:
                total += a[0]
                state = a[1]
        return total


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def lm_scores(docs: DataFrame, held_of: int = 10, order: int = ORDER, mu: float = MU,
              bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Score every row with a model of the rows whose doc_id's CRC-32 is not divisible
    by ``held_of``."""
    if order < 1 or mu <= 0:
        raise ValueError("order must be at least 1 and mu positive")
    manifest = write_blocks(docs, "lm-blocks")
    blocks, _, n_bytes = spread(manifest)
    n_buckets = max(1, round(n_bytes / bucket_bytes))
    answers = materialise(_answers(_questions(blocks, n_buckets, order, held_of)), "lm-counts")
    n, v = answers.where("block is null and k = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v")]).first()

    def run(t: pa.Table) -> pa.Table:
        g = BlockGrams(t.column("uri")[0].as_py(), order, held_of)
        got = {(k, b): d for k, b, d in zip(*(t.column(c).to_pylist() for c in ("k", "bucket", "counts")))}
        counts = []
        for k in range(order):
            asked, ends = g.asked(k, n_buckets)
            full = np.zeros(g.counts[k].size, np.int64)
            some = np.flatnonzero(np.diff(ends)).tolist()
            if some:
                full[asked] = np.concatenate([_integers(got[k, b], 8) for b in some]).astype(np.int64)
            counts.append(full)
        counts[0][START] = counts[0][END]  # as many texts start as end
        model = Automaton(g, counts, n, v, mu)
        root, known = np.array(model.root), counts[0] > 0
        cols: tuple[list, ...] = tuple([] for _ in range(7))
        at = 0
        for doc_id, held, size in zip(g.ids, g.held, g.sizes.tolist()):
            words = g.tokens[at + 1:at + size]
            at += size
            row = (doc_id, held, size - 1, int(known[words].sum()), n, math.fsum(root[words].tolist()),
                   model.score(words.tolist()))
            for c, x in zip(cols, row):
                c.append(x)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in SCORES.split(", ")])

    asked = manifest.select("block", "uri").join(answers.where("block is not null").select("block", "k", "bucket", "counts"), "block")
    return asked.groupBy("block").applyInArrow(run, SCORES)
