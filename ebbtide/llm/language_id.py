"""Language ID: per-word scores, script candidates and a Viterbi path over words.

Training counts hashed byte n-grams (2 to 5 bytes, word ends marked) of each
language's words, and the scripts of its letters, over a bounded sample of labelled
documents: up to ``SAMPLE`` documents a language, chosen by a hash of doc_id (all of
them if there are fewer). The model is a table of languages x 65,536 log
probabilities (256 KB a language), small enough to send to every executor whatever
the size of the corpus.

Prediction takes every whole text. The script ranges of a word's letters leave only
the languages seen with that script as candidates; n-gram scores rank these; a
Viterbi pass with a penalty for each change of language labels the words, so that a
span of another language is labelled as such and a single odd word is not. The text's
language is that of most labelled words, its score their share.

Edge cases: null text and text without a letter are ``und`` with score 0 and no
spans; a text whose scripts no language was seen with gets the most frequent
language; without any labelled document every text is ``und``; ties go to the more
frequent language; repeated rows get equal results; empty tables give empty results;
words of any length are scored whole; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
BUCKETS = 1 << 16
SIZES = (2, 3, 4, 5)
SMOOTH = 0.5
#: Share of a language's letters that a script must have for it to be a candidate.
SCRIPT_SHARE = 0.02
#: Cost of a change of language, in units of a word's n-gram log likelihood.
PENALTY = 12.0
OUTSIDE = -40.0
CACHE = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Text handled at once by the path search.
BATCH = 16 << 20

#: First code point of script ranges (0: no script of its own).
SCRIPTS = ["none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "gurmukhi",
           "gujarati", "tamil", "telugu", "kannada", "malayalam", "sinhala", "thai", "lao", "tibetan", "myanmar",
           "georgian", "hangul", "ethiopic", "khmer", "kana", "han"]
RANGES = [(0x0000, 0), (0x0041, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6),
          (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0), (0x0B80, 11), (0x0C00, 12),
          (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16), (0x0E80, 17), (0x0F00, 18), (0x1000, 19),
          (0x10A0, 20), (0x1100, 21), (0x1200, 22), (0x13A0, 0), (0x1780, 23), (0x1800, 0), (0x1C80, 3), (0x1C90, 20),
          (0x1D00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E80, 25), (0x3040, 24),
          (0x3100, 25), (0x3130, 21), (0x3190, 25), (0xA4D0, 0), (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0),
          (0xAC00, 21), (0xD7B0, 0), (0xF900, 25), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
          (0xFE70, 6), (0xFF00, 1), (0xFF66, 24), (0xFFA0, 21), (0x10000, 0), (0x20000, 25), (0x32000, 0)]
STARTS = [a for a, _ in RANGES]
LETTER = regex.compile(r"\p{L}")  # Unicode category L: no digits, fractions or number signs


def word_script(word: bytes) -> int:
    """-1 without a letter, else the script of most letters."""
    if word.isascii():
        return 1 if any(c >= 65 and (c <= 90 or 97 <= c <= 122) for c in word) else -1
    found = Counter(RANGES[bisect_right(STARTS, ord(c)) - 1][1] for c in word.decode() if LETTER.match(c))
    return found.most_common(1)[0][0] if found else -1


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of each n-gram of the words; a word's are adjacent."""
    marked = [b"<" + w + b">" for w in words]
    data = b"".join(marked)
    sizes = np.array([len(m) for m in marked], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    load = np.ndarray((len(data),), "<u8", data + b"\0" * 8, 0, (1,))
    at = np.arange(len(data))
    buckets, owners = [], []
    for n in SIZES:
        ok = at + n <= ends
        h = (load[ok] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n)
        h *= MIX
        h ^= h >> np.uint64(29)
        h *= MIX
        buckets.append((h >> np.uint64(48)).astype(np.int64))
        owners.append(owner[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], owner[order]


def held_in(part: int, of: int, doc_id: str = "doc_id") -> Column:
    """Whether a doc_id's CRC-32 falls in one part of ``of``."""
    return F.crc32(F.col(doc_id).cast("string")) % of == part


class LanguageModel:
    """Languages (most frequent first), log probabilities and script candidates."""

    def __init__(self, languages: list[str], logp: np.ndarray, scripts: np.ndarray):
        self.languages, self.logp, self.scripts = languages, logp, scripts

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, has a letter); the score of a language that is no candidate is OUTSIDE."""
        script = np.array([word_script(w) for w in words])
        bucket, owner = ngrams([w.lower() for w in words])
        out = np.zeros((len(words), len(self.languages)), np.float32)
        first = np.searchsorted(owner, np.arange(len(words)))
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.logp[k][bucket], first)
        out -= out.max(axis=1, keepdims=True)
        can = self.scripts[:, np.maximum(script, 0)].T
        out[~can] = OUTSIDE
        out[(script < 0) | ~can.any(axis=1)] = 0
        return out, script >= 0


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from the rows of ``docs`` with a language."""
    rows = docs.where(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts, key=lambda k: (-counts[k], k))
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, len(SCRIPTS)), bool))
    share = F.lit(1.0)
    for k in languages:
        if counts[k] > sample:
            share = F.when(F.col("lang") == k, F.lit(sample / counts[k])).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    width = BUCKETS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words.setdefault(lang, Counter()).update((text or b"").split())
            for lang, found in words.items():
                own = total.setdefault(lang, np.zeros(width))
                some = [w for w in found if word_script(w) >= 0]
                if some:
                    n = np.array([found[w] for w in some], float)
                    bucket, owner = ngrams([w.lower() for w in some])
                    own[:BUCKETS] += np.bincount(bucket, n[owner], BUCKETS)
                    own[BUCKETS:] += np.bincount([word_script(w) for w in some], n * [len(w) for w in some], len(SCRIPTS))
        for lang, own in total.items():
            k = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * k.size, "bucket": k, "n": own[k]})

    counted = (rows.where(u < share).select("lang", "text").mapInArrow(count, "lang string, bucket long, n double")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    table = np.zeros((len(languages), width))
    place = {k: i for i, k in enumerate(languages)}
    who = np.array([place[k] for k in counted.column("lang").to_pylist()], np.int64)
    table[who, counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    logp = np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)
    return LanguageModel(languages, logp, scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1))


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of ``scores``; text i is rows starts[i]:starts[i + 1].
    All texts advance together, a word at a time."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begin = starts[:-1][order]
    longest = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # texts longer than t
    best = np.zeros((sizes.size, scores.shape[1]), np.float32)
    stay = np.zeros(scores.shape, bool)
    source = np.zeros(scores.shape[0], np.int8 if scores.shape[1] < 128 else np.int32)
    for t, a in enumerate(active.tolist()):
        at, v = begin[:a] + t, best[:a]
        if t:
            k = v.argmax(axis=1)
            switch = (v[np.arange(a), k] - penalty)[:, None]
            keep = v >= switch
            stay[at], source[at] = keep, k
            v = np.where(keep, v, switch)
        best[:a] = v + scores[at]
    label = np.zeros(scores.shape[0], source.dtype)
    now = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at, k = begin[:a] + t, now[:a]
        label[at] = k
        if t:
            now[:a] = np.where(stay[at, k], k, source[at])
    return label


SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:long,last:long>>"


def predict(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score and spans (language, first and last word) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.scripts))
    span = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ebbtide.llm.tokens import batches
        m = LanguageModel(*shared.value)
        names = m.languages
        number: dict[bytes, int] = {}
        scores = np.zeros((0, len(names)), np.float32)
        letters = np.zeros(0, bool)
        for b in parts:
            ids = b.column(0).to_pylist()
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in batches(texts, BATCH):
                cut = [(t or b"").split() for t in texts[lo:hi]]
                new = set().union(*cut)
                new.difference_update(number)
                if len(number) + len(new) > CACHE:
                    number.clear()
                    scores, letters, new = scores[:0], letters[:0], set().union(*cut)
                if new and names:
                    some = list(new)
                    parts_ = [m.word_scores(some[k:k + 65536]) for k in range(0, len(some), 65536)]
                    number.update(zip(some, range(len(number), len(number) + len(some))))
                    scores = np.concatenate([scores, *(p[0] for p in parts_)])
                    letters = np.concatenate([letters, *(p[1] for p in parts_)])
                sizes = np.array([len(c) if names else 0 for c in cut])
                starts = np.concatenate([[0], np.cumsum(sizes)])
                get = number.__getitem__
                word = np.fromiter((k for c in cut for k in map(get, c)), np.int64, starts[-1]) if names else np.zeros(0, np.int64)
                label = viterbi(scores[word], starts, penalty) if word.size else np.zeros(0, np.int8)
                real = letters[word]
                pred, score, spans = [], [], []
                for a, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    own = label[a:e]
                    n = np.bincount(own[real[a:e]], minlength=1)
                    total = int(n.sum())
                    pred.append(names[int(n.argmax())] if total else "und")
                    score.append(float(n.max() / total) if total else 0.0)
                    edge = np.flatnonzero(np.diff(own)) + 1 if total else np.zeros(0, int)
                    first = [0, *edge.tolist()] if total else []
                    last = [*(edge - 1).tolist(), e - a - 1] if total else []
                    spans.append([{"lang": names[own[f]], "first": f, "last": z} for f, z in zip(first, last)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array(pred), pa.array(score, pa.float64()),
                     pa.array(spans, pa.list_(span))], names=["doc_id", "lang_pred", "score", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame, held_out: Column, sample: int = SAMPLE, penalty: float = PENALTY) -> DataFrame:
    """Train on the rows that are not held out and label every row."""
    return predict(docs, train(docs.where(~F.coalesce(held_out, F.lit(False))), sample), penalty)
