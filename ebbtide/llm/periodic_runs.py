"""Periodic runs of words: a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q (words q apart are the same), at
least 2q long, that no neighbouring word extends. For each text:

1. The suffix automaton of its words is built. The suffixes of the prefix that ends
   at word i are the path from that prefix's state up the suffix links to the root.
2. Words are then appended one by one. ``access`` of a link-cut tree over the links
   turns the path of word i into one preferred path, coloured i. The pieces it was
   made of still carry the place e where their strings ended last: a piece that holds
   the lengths in (lo, hi] says that those suffixes occurred before at e, and not
   between. If lo < i - e <= hi, the last i - e words repeat those before them: a
   square with period i - e ends at word i, and as the shorter period would have made
   a later e, the period is primitive. Every primitive square is found so, since the
   last occurrence of its first half is exactly one period back. A colour changes
   O(log n) times a word, amortized.
3. Squares with the same period that end at consecutive words are one run: it begins
   where the first of them begins and ends where the last one ends.

A word that occurs once in a stretch is in no run, so a text is first cut at such
words, again and again in what remains; the automaton only reads the pieces that are
left (all of a text that repeats throughout). This changes no result.

Texts are independent: one pass over the rows, no shuffle; a task holds one text and
its automaton, whose size is linear in the text's longest such piece.

Edge cases: null and empty texts have no word and no run; equal rows give equal rows;
a null doc_id stays null; texts of any length are taken whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
#: Rounds of cutting at words that occur once.
ROUNDS = 12
WORDS = r"[^\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths and the state of each prefix."""
    step: list[dict[int, int]] = [{}]
    link, size, at, last = [-1], [0], [], 0
    for w in words:
        new = len(size)
        size.append(size[last] + 1)
        step.append({})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = step[p][w]
            if size[q] == size[p] + 1:
                link.append(q)
            else:
                copy = new + 1
                link += [copy, link[q]]
                size.append(size[p] + 1)
                step.append(step[q].copy())
                link[q] = copy
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
        last = new
        at.append(new)
    return link, size, at


class LastEnds:
    """Link-cut tree over the suffix links. Its preferred paths are the parts of the
    tree whose strings ended last at the same place; each is a splay tree by depth
    (shallow to the left), whose root keeps that place as its colour."""

    def __init__(self, link: list[int]):
        n = len(link)
        self.up = link[:]  # parent in the splay tree, at its root the link of the path's top
        self.left, self.right = [-1] * n, [-1] * n
        self.colour = [-1] * n

    def splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        while p >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._rotate(p, g)
            elif inner:
                self._rotate(x, p)
                p = g
                self._rotate(x, p)
                p = up[x]
                continue
            self._rotate(x, p)
            p = up[x]

    def _rotate(self, x: int, p: int) -> None:
        """Lift x above its parent p."""
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c >= 0:
            up[c] = p
        if g >= 0 and left[g] == p:
            left[g] = x
        elif g >= 0 and right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]  # p was the root
        up[x], up[p] = g, x

    def access(self, state: int, place: int) -> Iterator[tuple[int, int, int]]:
        """Colour the path from the root to ``state`` with ``place``; gives the pieces it
        was made of, as (their colour before, deepest state, state above or -1)."""
        up, right, colour = self.up, self.right, self.colour
        below, x = -1, state
        while x >= 0:
            self.splay(x)
            if right[x] >= 0:
                colour[right[x]] = colour[x]
            right[x] = below
            yield colour[x], x, up[x]
            below, x = x, up[x]
        colour[below] = place


def runs_of(words: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``min_length`` words, by start, then period."""
    link, size, at = automaton(words)
    ends = LastEnds(link)
    first: dict[int, int] = {}  # by period: ends of the first and last square of the run so far
    last: dict[int, int] = {}
    out = []

    def close(q: int) -> None:
        length = last[q] - first[q] + 2 * q
        if length >= min_length:
            out.append((first[q] - 2 * q + 1, length, q))

    for i, state in enumerate(at):
        for e, deepest, above in ends.access(state, i):
            q = i - e
            if e >= 0 and q <= size[deepest] and (above < 0 or q > size[above]):
                if last.get(q, -2) != i - 1:
                    if q in last:
                        close(q)
                    first[q] = i
                last[q] = i
    for q in last:
        close(q)
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, np.ndarray]]:
    """(offset, words) of the parts that can hold runs: no word in them occurs once."""
    left, out = [(0, words, 0)], []
    while left:
        at, part, depth = left.pop()
        if part.size < min_length:
            continue
        _, place, count = np.unique(part, return_inverse=True, return_counts=True)
        alone = np.flatnonzero(count[place] == 1)
        if not alone.size or depth >= ROUNDS:
            out.append((at, place))
            continue
        for lo, hi in zip(np.r_[0, alone + 1], np.r_[alone, part.size]):
            if hi - lo >= min_length:
                left.append((at + int(lo), part[lo:hi], depth + 1))
    return out


def text_runs(words: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    code: dict[bytes, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    return sorted(((at + s, n, q) for at, part in stretches(ids, min_length) for s, n, q in runs_of(part.tolist(), min_length)),
                  key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that stand after the first period of a run, joined by spaces."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    gone = np.cumsum(gone)
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed text of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found, kept = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()  # at the six ASCII white-space characters
                runs = text_runs(words, min_length)
                n.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                kept.append(collapse(words, runs))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind),
                                              pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the loops of the contract: in one text of ten, by hash of the
    doc_id, the words from some place on repeat a first period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), g.alias("g"),
                    F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("words"))
    d = d.select("doc_id", "text", "g", "words", F.size("words").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    n, a, words = F.col("n"), F.col("a"), F.col("words")
    d = d.withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice(words, a + 1, F.least(F.col("p"), n - a))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / F.col("p")).cast("int"))), F.lit(1), n - a)
    looped = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return d.select("doc_id", F.when(a.isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    def key(r: Column) -> Column:
        return F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))

    best = F.array_min(F.transform("runs", key))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -best["less"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"),
        best["period"].alias("period"), F.floor(1000 * length / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
