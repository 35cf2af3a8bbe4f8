"""Whole results of language ID and quality rules against plain re-implementations."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from ebbtide.llm import language_id as LI
from ebbtide.llm import quality_rules as QR
from ebbtide.llm import queries as Q

MASK = (1 << 64) - 1
MIX = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------------------
# 2: every word scored on its own, every text's best path over all words
# ---------------------------------------------------------------------------
def grams(word):
    data = b"<" + word.lower() + b">"
    for n in LI.SIZES:
        for k in range(len(data) - n + 1):
            h = (int.from_bytes(data[k:k + n], "little") + n) * MIX & MASK
            h = (h ^ h >> 29) * MIX & MASK
            yield h >> 48


def script(word):
    found = Counter()
    for c in word.decode():
        if regex.match(r"\p{L}", c):
            found[max((a, s) for a, s in LI.RANGES if a <= ord(c))[1]] += 1
    return found.most_common(1)[0][0] if found else None


def best_path(scores):
    """Labels of the path with the largest sum of scores less the penalties."""
    n = len(scores[0])
    best, back = list(scores[0]), []
    for s in scores[1:]:
        top = max(range(n), key=lambda k: best[k])
        came = [k if best[k] >= best[top] - LI.PENALTY else top for k in range(n)]
        best = [(best[came[k]] - (0 if came[k] == k else LI.PENALTY)) + s[k] for k in range(n)]
        back.append(came)
    at = max(range(n), key=lambda k: best[k])
    out = [at]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


def test_language_id_of_every_document(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None]
    langs = [k for k, _ in sorted(Counter(r.lang for r in learn).items(), key=lambda x: (-x[1], x[0]))]
    count, letters = defaultdict(Counter), defaultdict(Counter)
    for r in learn:
        for w, n in Counter((r.text or "").encode().split()).items():
            s = script(w)
            if s is not None:
                letters[r.lang][s] += n * len(w)
                for g in grams(w):
                    count[r.lang][g] += n
    total = {k: sum(count[k].values()) + LI.SMOOTH * LI.BUCKETS for k in langs}
    candidates = {k: {s for s, n in letters[k].items() if n > LI.SCRIPT_SHARE * sum(letters[k].values())} for k in langs}
    known = {}

    def score(w):
        if w not in known:
            s = script(w)
            own = [k for k in langs if s in candidates[k]]
            if not own:
                known[w] = [0.0] * len(langs), s is not None
            else:
                x = [sum(math.log((count[k][g] + LI.SMOOTH) / total[k]) for g in grams(w)) for k in langs]
                known[w] = [v - max(x) if k in own else LI.OUTSIDE for k, v in zip(langs, x)], s is not None
        return known[w]

    got = {r.doc_id: r for r in LI.language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"), LI.held_in(1, 3)).collect()}
    q = {r.doc_id: r for r in Q.QUERIES["op2_language_id"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = [score(w) for w in (r.text or "").encode().split()]
        path = best_path([s for s, _ in words]) if words else []
        real = Counter(langs[k] for k, (_, letter) in zip(path, words) if letter)
        n = sum(real.values())
        want = min(real, key=lambda k: (-real[k], langs.index(k))) if n else "und"
        spans = [(langs[k], i) for i, k in enumerate(path) if n and (i == 0 or path[i - 1] != k)]
        assert got[r.doc_id].lang_pred == want and got[r.doc_id].score == pytest.approx(real[want] / n if n else 0.0), r.doc_id
        assert [(s.lang, s.first) for s in got[r.doc_id].spans] == spans, r.doc_id
        assert (q[r.doc_id].lang_pred, q[r.doc_id].held_out) == (want, zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


# ---------------------------------------------------------------------------
# 9: minimum covariance determinant with numpy
# ---------------------------------------------------------------------------
FLOORS = np.array(list(QR.FEATURES.values()))


def low(x, p):
    """The smallest value with at least a share p of all at or below it."""
    return np.sort(x)[max(math.ceil(p * len(x)), 1) - 1]


def estimate(x, floors=FLOORS):
    c = np.cov(x.T, bias=True) + np.diag(floors ** 2)
    return x.mean(axis=0), c


def distances(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def mcd(x):
    med = np.array([low(x[:, k], 0.5) for k in range(x.shape[1])])
    mad = np.array([low(np.abs(x[:, k] - med[k]), 0.5) for k in range(x.shape[1])])
    z = (x - med) / np.maximum(1.4826 * mad, FLOORS)
    _, shape = estimate(np.tanh(z))
    found = []
    for start, d in enumerate([(z ** 2).sum(axis=1), distances(z, 0.0, shape)]):
        m, c = estimate(x[d <= low(d, QR.SUPPORT)])
        for _ in range(QR.STEPS):
            d = distances(x, m, c)
            m, c = estimate(x[d <= low(d, QR.SUPPORT)])
        found.append((np.linalg.slogdet(c)[1], start, m, c))
    _, _, m, c = min(found, key=lambda f: (round(f[0], 9), f[1]))
    return m, c, max(1.0, low(distances(x, m, c), 0.5) / QR.CHI2_MEDIAN)


@pytest.mark.parametrize("min_group", [12, QR.MIN_GROUP])
def test_quality_verdicts(spark, sf_dir, min_group):
    rows = QR.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_group=min_group).collect()
    lines = {r.doc_id: [x for x in (r.text or "").split("\n") if x.encode().split()] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    vector = {}
    for r in rows:
        words, chars, n = max(r.n_words, 1), max(r.word_chars, 1), max(len(lines[r.doc_id]), 1)
        vector[r.doc_id] = [math.log1p(r.n_words), math.log(chars / words), math.log1p(100 * r.n_symbols / chars), r.n_dup_lines / n, r.n_repeat_words / words]
    fine = [r for r in rows if not r.base_failed]
    size = Counter((r.lang, r.source) for r in fine)
    pool = Counter()
    for (lang, _), n in size.items():
        pool[lang] += n if n < min_group else 0

    def group(r):
        if size[r.lang, r.source] >= min_group:
            return r.lang, r.source
        return (r.lang,) if pool[r.lang] >= min_group else ()

    members = defaultdict(list)
    for r in fine:
        members[group(r)].append(vector[r.doc_id])
    fits = {g: mcd(np.array(x)) for g, x in members.items() if len(x) >= min_group}
    checked = 0
    for r in rows:
        if r.base_failed:
            assert not r.kept
        elif (fit := fits.get(group(r))) is None:
            assert r.kept and r.distance is None
        else:
            m, c, scale = fit
            d = distances(np.array([vector[r.doc_id]]), m, c)[0] / scale
            assert r.distance == pytest.approx(d, rel=1e-6, abs=1e-6) and r.kept == (r.distance <= QR.CUTOFF), r.doc_id
            checked += 1
    assert checked > 50
