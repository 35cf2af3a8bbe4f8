"""The pipeline operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as E
from ebbtide.llm import language_id as LI
from ebbtide.llm import lm_scoring as LM
from ebbtide.llm import mixing as MX
from ebbtide.llm import multiset_hash as MH
from ebbtide.llm import packing as PK
from ebbtide.llm import plane_files as PF
from ebbtide.llm import quality_rules as QR
from ebbtide.llm import queries as Q
from ebbtide.llm import simhash as SH
from ebbtide.llm import suffix_dedup as SD
from ebbtide.llm import warc as W
from ebbtide.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
LONG = " ".join(WORDS[(k * k + k // 7) % 10] + str(k % 613) for k in range(6000))
#: Null and empty texts, white space only, a very long text, ties, repeated rows, a
#: null id, columns whose names clash with those the operators use inside.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, LONG, "en", "a"), (5, LONG, "fr", "b"),
    (6, "one two three", "en", "a"), (6, "one two three", "en", "a"), (7, "one two three", "en", "a"),
    (None, "one two three four", "en", None), (None, None, None, "b"), (8, "Ünïcode — ß 漢字 😀 text", "de", "b"),
    (9, "x" * 120, "en", "a"), (10, "y" + "x" * 120, "en", "a"), (11, "12 34 !!", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return d.withColumn("block", F.lit("mine")).withColumn("fp", F.lit(1.5)).withColumn("n_tokens", F.lit(-1)) \
            .withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- 1: mixing -------------------------------------------------------------------
def fill(budget, nodes):
    """Water filling of (name, weight, cap): shares as fractions."""
    share, left = {}, dict((n, (w, c)) for n, w, c in nodes if w > 0)
    while left:
        level = budget / sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if c <= level * w]
        if not full:
            return share | {n: level * w for n, (w, _) in left.items()}
        for n in full:
            share[n] = left.pop(n)[1]
            budget -= share[n]
    return share


def test_mixing_budgets_and_prefixes(spark, sf_dir, texts):
    rows = Q.QUERIES["op1_mixing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source").collect()
    n = {i: len(t.encode().split()) for i, t in texts.items()}
    supply = Counter()
    for d in docs:
        supply[Q.DOMAINS.get(d.source, "other"), d.lang, d.source] += n[d.doc_id]
    weight = lambda level, k: Q.MIX_WEIGHTS[level].get(k, 1.0)
    cap = lambda *p: sum(v * Q.MIX_EPOCHS for k, v in supply.items() if k[:len(p)] == p)
    kids = lambda *p: sorted({k[len(p)] for k in supply if k[:len(p)] == p})
    want, levels = {}, ("domain", "lang", "source")

    def down(path, budget):
        if len(path) == 3:
            want[path] = budget
            return
        for k, v in fill(budget, [(k, weight(levels[len(path)], k), cap(*path, k)) for k in kids(*path)]).items():
            down((*path, k), v)

    total = int(Q.MIX_BUDGET * sum(n.values()))
    down((), total)
    got, epochs = Counter(), {}
    for r in rows:
        got[r.domain, r.lang, r.source] += r.take_tokens
        epochs.setdefault((r.domain, r.lang, r.source, r.epoch), []).append(r)
    assert sum(got.values()) == total
    assert all(abs(got[k] - v) < 4 for k, v in want.items())
    members = {}
    for d in docs:
        members.setdefault((Q.DOMAINS.get(d.source, "other"), d.lang, d.source), []).append(d.doc_id)
    for (*leaf, epoch), rs in epochs.items():
        order = sorted((hashlib.md5(f"{i}|{epoch}|0".encode()).hexdigest(), i) for i in members[tuple(leaf)] if n[i])
        left, expect = sum(r.take_tokens for r in rs), {}
        for _, i in order:
            if left <= 0:
                break
            expect[i] = min(n[i], left)
            left -= n[i]
        assert {r.doc_id: r.take_tokens for r in rs} == expect


def test_mixing_shortage_goes_to_siblings_first(spark):
    rows = [(k, " ".join(["w"] * n), lang, s) for k, (lang, s, n) in enumerate(
        [("a", "s1", 10), ("a", "s2", 1000), ("b", "s3", 1000)])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    take = lambda **kw: {(r.lang, r.source): r.take_tokens for r in MX.mix(d, weights={}, domains={}, **kw).collect()}
    assert take(budget=400) == {("a", "s1"): 10, ("a", "s2"): 190, ("b", "s3"): 200}
    assert sum(take(budget=10**9).values()) == 2010
    assert MX.mix(d, budget=4020, weights={}, domains={}, max_epochs=2).groupBy().sum("take_tokens").first()[0] == 4020


def test_mixing_odd(odd, none):
    kw = dict(weights={}, domains={})
    rows = MX.mix(odd, budget=1.0, **kw).collect()
    assert sum(r.take_tokens for r in rows) == sum(len((t or "").encode().split()) for _, t, _, _ in ODD)
    whole = MX.mix_documents(odd, budget=1.0, **kw)
    assert whole.columns == odd.columns and whole.count() == 10  # rows without a token are not drawn
    assert MX.mix(none, budget=0.5, **kw).count() == 0


# --- 2: language ID ----------------------------------------------------------------
def test_language_id_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Q.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    starts = np.array([0, 5, 5, 6, 12])
    s = rng.normal(size=(12, 3)).astype(np.float32)
    got = LI.viterbi(s, starts, 1.0)
    from itertools import product
    for a, b in zip(starts[:-1], starts[1:]):
        cost = lambda p: sum(s[a + i, k] for i, k in enumerate(p)) - sum(x != y for x, y in zip(p, p[1:]))
        if b > a:
            assert cost(got[a:b].tolist()) == pytest.approx(max(map(cost, product(range(3), repeat=b - a))), abs=1e-5)


def test_language_id_spans_scripts_and_odd(spark, odd, none):
    train = [(k, t, lang) for k in range(30) for lang, t in (
        ("en", "the house of the old man is near the river and the wood"), ("ru", "старый дом стоит у реки рядом с лесом"))]
    t = spark.createDataFrame(train, "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(1, "the river and the wood старый дом стоит у реки the old man is near the house"),
                                 (2, "漢字"), (3, "123"), (4, None)], "doc_id long, text string")
    got = by_id(LI.predict(ask, LI.train(t)))
    assert [(s["lang"], s["first"], s["last"]) for s in got[1].spans] == [("en", 0, 4), ("ru", 5, 9), ("en", 10, 16)]
    assert got[1].lang_pred == "en" and got[2].lang_pred in ("en", "ru")
    assert (got[3].lang_pred, got[3].score, got[4].lang_pred) == ("und", 0.0, "und")
    rows = LI.language_id(odd, LI.held_in(1, 3)).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 11)} == {"und"}
    assert LI.language_id(none, LI.held_in(1, 3)).count() == 0
    assert {r.lang_pred for r in LI.predict(ask, LI.train(t.limit(0))).collect()} == {"und"}


# --- 3: packing --------------------------------------------------------------------
def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json"))
    want = {}
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at:at + 2048]
            want[i, k] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    rows = Q.QUERIES["op3_packing"](spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= math.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    n = np.random.default_rng(2).integers(1, 101, 500)
    cap = PK.Capacity(100, 5, 4000)
    seq, off = PK.best_fit(n, cap, rule, (1.0, 0.5, 0.5))
    for s in np.unique(seq):
        own = n[seq == s]
        o = off[seq == s]
        k = np.argsort(o)
        assert (o[k] == np.concatenate([[0], np.cumsum(own[k])[:-1]])).all() and own.sum() <= 100
        assert own.size <= 5 and ((own ** 2).sum() <= 4000 or own.size == 1)


def test_production_weights_rank_by_all_three_residuals():
    """Each piece goes to the open sequence with the smallest weighted norm; tokens alone would choose others."""
    assert min(PK.WEIGHTS) > 0
    n = np.random.default_rng(8).integers(1, 700, 600)
    cap = np.array(PK.Capacity())

    def worse_choices(seq):
        room, worse = {}, 0
        for i in np.argsort(-n, kind="stable").tolist():
            need = np.array([n[i], 1, n[i] ** 2])
            norms = {k: float((((r - need) / cap) ** 2) @ PK.WEIGHTS) for k, r in room.items() if (r >= need).all()}
            if seq[i] in room:
                worse += norms[seq[i]] > min(norms.values()) + 1e-12
            else:
                assert not norms
            room[seq[i]] = room.get(seq[i], cap) - need
        return worse

    seq, _ = PK.best_fit(n)
    scalar, _ = PK.best_fit(n, weights=(1.0, 0.0, 0.0))
    assert worse_choices(seq) == 0 and worse_choices(scalar) > 0
    assert seq.max() <= scalar.max()


def test_packing_odd(odd, none):
    rows = PK.pack(odd, Q.tokenizer("word_bpe_49k.json")).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert PK.pack(none, Q.tokenizer("word_bpe_49k.json")).count() == 0


# --- 4: LM scoring -------------------------------------------------------------------
@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, sf_dir, texts, order):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = by_id(LM.lm_scores(docs, order=order, bucket_bytes=100_000))
    toks = {i: t.encode().lower().split() + [1] for i, t in texts.items()}
    count = [Counter() for _ in range(order + 1)]
    for i, w in toks.items():
        if zlib.crc32(str(i).encode()) % 10:
            w = [0, *w]
            for k in range(1, order + 1):
                count[k].update(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    starts = count[1].pop((0,))
    n, v = sum(count[1].values()), len(count[1])
    seen = lambda w: count[1].get((w,), 0)

    def p(h, w):
        if not h:
            return (seen(w) + 0.1) / (n + 0.1 * (v + 1))
        c = starts if h == (0,) else count[len(h)].get(h, 0)
        return (count[len(h) + 1].get((*h, w), 0) + LM.MU * p(h[1:], w)) / (c + LM.MU) if c else p(h[1:], w)

    assert len(got) == len(toks)
    for i, w in toks.items():
        g, h = got[i], (0,)
        score = 0.0
        for x in w:
            score += math.log10(p(h[-(order - 1):] if order > 1 else (), x))
            h = (*h, x)
        assert g.score == pytest.approx(score, abs=1e-6)
        assert g.base_score == pytest.approx(sum(math.log10(p((), x)) for x in w), abs=1e-6)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(seen(x) > 0 for x in w), n)
        assert g.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_lm_odd(odd, none):
    rows = LM.lm_scores(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert LM.lm_scores(none).count() == 0
    assert all(r.train_tokens == 0 for r in LM.lm_scores(odd.where("doc_id is not null"), held_of=1).collect())


# --- 5: SimHash ------------------------------------------------------------------------
def simhash(text):
    w = text.lower().split()
    grams = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


def test_simhash(spark, sf_dir, texts):
    got = by_id(Q.QUERIES["op5_simhash"](spark, sf_dir))
    fps = {i: simhash(t.encode()) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def test_fingerprint_links_find_every_pair(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 40)] + [0, 2**64 - 1]
    fps = {}
    for b in base:  # chains and bundles at 0 to 3 bits
        for _ in range(8):
            fps[len(fps)] = b
            for bit in rng.integers(0, 64, rng.integers(0, 3)):
                b ^= 1 << int(bit)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(fps.values())]
    d = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node % (1 << 64): r.root for r in components(SH.fingerprint_links(d)).collect()}
    comp = brute_components(dict(enumerate(sorted(set(fps.values())))))
    vals = sorted(set(fps.values()))
    for i, a in enumerate(vals):
        for j in range(i):
            same = roots.get(a, a) == roots.get(vals[j], vals[j])
            assert same == (comp[i] == comp[j])


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(301)}) == 1 == len({got[1000 + k] for k in range(300)})
    assert got[0] != got[1000] and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd(odd, none):
    got = SH.simhash_groups(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    kept = SH.simhash_dedup(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 6, 8, 9, 10, 11] and ids.count(None) == 2
    assert SH.simhash_groups(none).count() == 0 and SH.simhash_dedup(none).count() == 0


# --- 6: WARC -----------------------------------------------------------------------------
def test_warc_matches_sql(spark, sf_dir):
    got = Q.QUERIES["op6_warc"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()['op6_warc']})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_warc_odd(spark):
    y = "y" * 200
    rows = [(1, "http://a.b/x", y), (2, "http://a.b/x", y), (2, "http://a.b/x", y), (1, "http://a.b/x", y), (None, "http://z", y),
            (None, None, None), (5, "odd\turl\n", "q"), (6, None, "q"), (7, "https://[::1]:80/a?b#c", ""),
            (9, "http://u@H.com:80", "z" * 100), (9, "http://u@H.com:80/", "z" * 100), (10, "http://long", "ß" * 3_000_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).repartition(3)
    got = W.archive_round_trip(d).collect()
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), digest(h), "revisit" if h == y and p != 1 else "response", 1 if h == y and p != 1 else None)
            for p, _, h in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert W.archive_round_trip(d.limit(0)).count() == 0


def test_url_keys():
    assert W.url_key("http://www.Example.com:80/a/b?c=d#e") == "com,example,www)/a/b?c=d"
    assert W.url_key("https://example.com") == "com,example)/" and W.url_key("https://e.com:8443/x") == "com,e:8443)/x"
    assert W.url_key(None) == "" and W.url_key("plain") == "plain"


def test_index_finds_over_blocks_and_shards(spark, tmp_path):
    rows = [(k % 50, f"http://h.com/{k % 7}", f"payload {k}") for k in range(400)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    shards = W.build_index(W.write_archive(d, f"{tmp_path}/w"), f"{tmp_path}/w", block_lines=8)
    index = W.CaptureIndex(shards)
    for p, u in {(p, u) for p, u, _ in rows}:
        found = sorted(index.record(c[1], int(c[2]), int(c[3]))[1].decode() for c in index.find(W.url_key(u), p))
        assert found == sorted(h for a, b, h in rows if (a, b) == (p, u))
    assert list(index.find("com,h)/none", 1)) == [] and list(index.find("", None)) == []


# --- 7: token planes -------------------------------------------------------------------------
def test_token_planes(spark, sf_dir, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.tokenizer("byte_bpe_50k.json"))
    got, at = by_id(Q.QUERIES["op7_token_planes"](spark, sf_dir)), 0
    for i in sorted(texts):
        ids = np.array(tok.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, ids.size, zlib.crc32(ids.tobytes()))
        at += ids.size


@pytest.mark.parametrize("planes", [4, 32])
def test_plane_file_round_trip(tmp_path, planes):
    rng = np.random.default_rng(4)
    docs = [(None if k == 3 else k, rng.integers(0, 2**32 if k % 2 else 50_000, n, dtype=np.uint32))
            for k, n in enumerate([1, 70_000, 0, 5, 200_000, 65_536])]
    w = PF.PlaneWriter(f"{tmp_path}/x.planes", planes)
    for i, ids in docs:
        w.add(i, ids.astype("<u4").tobytes())
    w.close()
    r = PF.PlaneFile(f"{tmp_path}/x.planes")
    assert all(a == b and (x == y).all() for (a, x), (b, y) in zip(docs, r.documents(), strict=True))
    flat = np.concatenate([x for _, x in docs])
    for a, n in ((0, 1), (65_530, 10), (1, flat.size - 1), (flat.size, 0), (131_072, 65_536)):
        assert (r.read(a, n) == flat[a:a + n]).all()


def test_pieces_are_independent():
    """Texts of odd white space and special tokens, cut and joined, against the library."""
    from ebbtide.llm.tokens import PieceEncoder
    texts = ["", " ", "a  b", " a", "a ", "a \n b", "it's  we'll\t 12  x", "x  y", "<|endoftext|> a<|endoftext|>",
             "É́ é ΑΣ ΑΣ.", "\x1c \x1f\x85 z", LONG[:500], "a\r\n\r\n  b\x0b \x0c c"]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc = PieceEncoder(Q.tokenizer(name), spaces, limit=10)
        for t in texts:
            assert np.frombuffer(enc.encode([t.encode()])[0], "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids, (name, t)


def test_added_tokens_in_a_text():
    """Against a tokenizer of its own, as the library reads it."""
    from tokenizers import Tokenizer

    from ebbtide.llm.tokens import PieceEncoder
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|startoftext|>b", "x  <|endoftext|>\n\n y ", " <|startoftext|>",
             "<|ENDOFTEXT|> <|endoftext| <<|endoftext|>>", "É<|endoftext|>\u0301 ΑΣ<|startoftext|>.", "it<|endoftext|>'s", "a <|endof text|>", LONG[:300] + "<|endoftext|>" + LONG[:300]]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        enc, tok = PieceEncoder(Q.tokenizer(name), spaces), Tokenizer.from_file(Q.tokenizer(name))
        for t in texts:
            assert np.frombuffer(enc.ids(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, (name, t)


def test_token_planes_odd(odd, none):
    rows = PF.round_trip(odd, Q.tokenizer("byte_bpe_50k.json")).collect()
    rows.sort(key=lambda r: r.start)
    assert len(rows) == len(ODD) and [r.doc_id for r in rows][-2:] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert PF.round_trip(none, Q.tokenizer("byte_bpe_50k.json")).count() == 0


def test_worker_gives_up_what_other_steps_kept():
    from ebbtide.llm import common, tokens
    first = tokens.encoder(Q.tokenizer("word_bpe_49k.json"), False)
    ids = first.ids(b"some words")
    common.give_up_kept()
    assert not tokens._ENCODERS
    again = tokens.encoder(Q.tokenizer("word_bpe_49k.json"), False)
    assert again is not first and again.ids(b"some words") == ids


# --- 8: suffix-array dedup ---------------------------------------------------------------------
def brute_dedup(rows, length=50):
    """(mask, kept) of (doc_id, bytes) rows; ids may repeat or be None."""
    key = lambda i: math.inf if i is None else i
    least = {}
    for i, b in rows:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            least[w] = min(least.get(w, math.inf), key(i))
    out = []
    for i, b in rows:
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p:p + length]] < key(i):
                mask[p:p + length] = b"\1" * length
        out.append((mask, bytes(x for x, m in zip(b, mask) if not m)))
    return out


def check_dedup(df, rows, **kw):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in SD.suffix_dedup(df, **kw).collect()), key=str)
    want = []
    for (i, b), (mask, kept) in zip(rows, brute_dedup(rows)):
        spans = sum(m and not (p and mask[p - 1]) for p, m in enumerate(mask))
        want.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest(), kept))
    assert got == sorted(want, key=str)


def test_suffix_dedup(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_dedup(docs, [(i, t.encode()) for i, t in texts.items()])
    # many small blocks, buckets and shards
    check_dedup(docs.repartition(5), [(i, t.encode()) for i, t in texts.items()], bucket_bytes=20_000, shard_bytes=3_000,
                bucket_anchors=500)


def test_suffix_dedup_odd(odd, none):
    check_dedup(odd, [(i, (t or "").encode()) for i, t, _, _ in ODD])
    assert SD.suffix_dedup(none).count() == 0 and SD.dedup_texts(none).count() == 0
    cut = SD.dedup_texts(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    assert {r.text for r in cut.collect() if r.doc_id in (5, 10)} == {"", "y"}


def test_suffix_dedup_phrase_in_many_contexts(spark):
    """A line of 25 bytes in distinct contexts: no bucket takes them all, the result is that of the rule."""
    rng = np.random.default_rng(11)
    text = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    line = "\nsame line of 25 letters.\n"
    rows = [(i, "".join(text(40) + line for _ in range(10))) for i in range(300)]
    rows += [(300 + i, rows[i][1][50:300] + text(30)) for i in range(20)]  # and passages of earlier documents
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = SD.write_blocks(docs, "phrase", block_bytes=20_000)
    largest = {}
    for hot in (20_000, 1 << 40):
        parts, _ = SD._dealt_segments(manifest, SD.LENGTH, SD.WIDTH, 20_000, 5_000, hot)
        load = Counter()
        for r in parts.select("part", "sizes").collect():
            load[r.part] += int(np.frombuffer(r.sizes, np.int32).sum())
        largest[hot] = max(load.values())
    assert largest[1 << 40] > 100_000 and largest[20_000] < 60_000, largest
    check_dedup(docs, [(i, t.encode()) for i, t in rows], bucket_bytes=20_000, bucket_anchors=5_000)


def test_anchor_runs_by_slices(monkeypatch):
    """Runs do not depend on where a block is cut into slices, and need no array of the whole block's windows."""
    rng = np.random.default_rng(3)
    lens = rng.choice([0, 1, 49, 50, 51, 300, 6000], 40)
    data = b"".join(bytes(rng.integers(97, 97 + rng.choice([1, 2, 26]), n).astype(np.uint8)) for n in lens)
    block = (None, None, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), data)
    whole = SD._runs(block, SD.LENGTH, SD.WIDTH)
    at = np.flatnonzero(rng.random(len(data) - SD.LENGTH + 1) < 0.5)
    hashes = SD._window_hashes(np.frombuffer(data, np.uint8), at, SD.LENGTH)
    for n in (1, 37, 1000):
        monkeypatch.setattr(SD, "SLICE", n)
        assert all((a == b).all() for a, b in zip(whole, SD._runs(block, SD.LENGTH, SD.WIDTH), strict=True))
        assert (SD._window_hashes(np.frombuffer(data, np.uint8), at, SD.LENGTH) == hashes).all()
    monkeypatch.undo()
    large = (None, None, np.array([0, 2 << 20], np.int64), rng.integers(97, 123, 2 << 20).astype(np.uint8).tobytes())
    assert peak_bytes(lambda: SD._runs(large, SD.LENGTH, SD.WIDTH)) < 16 * (2 << 20)


def peak_bytes(f) -> int:
    """What ``f`` holds at most, beside what there was before."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_merge_holds_little_for_each_byte():
    rng = np.random.default_rng(4)
    segments = [rng.integers(97, 123, 100).astype(np.uint8).tobytes() for _ in range(20_000)]
    segments += [a[50:] + b[:50] for a, b in zip(segments[:5_000], segments[5_000:])]
    peak = peak_bytes(lambda: SD.least_documents(segments, np.arange(len(segments)), SD.LENGTH))
    assert peak < 75 * sum(map(len, segments)), peak


def test_suffix_dedup_buckets_where_all_repeats(spark):
    """Where every document has a copy, buckets are no larger than where few have."""
    rng = np.random.default_rng(12)
    text = ["".join(map(chr, rng.integers(97, 123, 600))) for _ in range(600)]
    docs = spark.createDataFrame([(i, text[i % 600]) for i in range(1200)], "doc_id long, text string").repartition(4)
    manifest = SD.write_blocks(docs, "copies", block_bytes=60_000)
    parts, _ = SD._dealt_segments(manifest, SD.LENGTH, SD.WIDTH, 20_000, 5_000, 20_000)
    load = Counter()
    for r in parts.select("part", "sizes").collect():
        load[r.part] += int(np.frombuffer(r.sizes, np.int32).sum())
    assert max(load.values()) < 2 * 20_000 and sum(load.values()) > 40 * 20_000, load
    check_dedup(docs, [(i, text[i % 600].encode()) for i in range(1200)], bucket_bytes=20_000, bucket_anchors=5_000)


def test_merge_of_shards_equals_one_suffix_array():
    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 99, n).astype(np.uint8) for n in (700, 1, 300, 50)]
    parts = [np.append(p, SD.SENTINEL).astype(np.uint8) for p in parts]
    pos, interval = SD.merged_intervals([SD.shard_bwt(p, 12) for p in parts], 12)
    offset = np.cumsum([0] + [p.size for p in parts])
    groups = {}
    for p, g in zip(pos.tolist(), interval.tolist()):
        groups.setdefault(g, set()).add(p)
    want = {}
    for k, p in enumerate(parts):
        for i in range(p.size):
            want.setdefault(np.roll(p, -i)[:12].tobytes() if p.size >= 12 else np.tile(p, 12)[i:i + 12].tobytes(), set()).add(offset[k] + i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


# --- 9: quality rules -----------------------------------------------------------------------------
def base_statistics(t):
    import re
    ws = r"[\x20\x09-\x0D]+"
    words = [w for w in re.split(ws, t) if w]
    win = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    rep = set()
    for k in range(len(words) - 4):
        if win[tuple(words[k:k + 5])] > 1:
            rep |= set(range(k, k + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(rep)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_rules(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = by_id(Q.QUERIES["op9_quality_rules"](spark, d))
    for r in docs.collect():
        assert tuple(got[r.doc_id][c] for c in STATS) == base_statistics(r.text or "")
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality == 1}
    assert all(got[i].kept for i in good if not got[i].base_failed)
    assert not any(r.kept for r in got.values() if r.base_failed)
    assert any(not r.kept and not r.base_failed for r in got.values())


def test_quality_rejects_outliers_of_a_contaminated_group(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(3, 8)))
    clean = [(k, " ".join(word() for _ in range(rng.integers(40, 200))), "en", "s") for k in range(200)]
    bad = [(1000 + k, " ".join(word() + "***" for _ in range(80)), "en", "s") for k in range(40)]
    d = spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in QR.quality_filter(d).collect()}
    assert kept == set(range(200))


def test_quality_odd(odd, none):
    rules = QR.quality_rules(odd).collect()
    assert len(rules) == len(ODD)
    for r in rules:
        if r.doc_id in (1, 2, 3, 6, 7, 8, 11):
            assert r.base_failed and not r.kept
    out = QR.quality_filter(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {4, 5}
    assert QR.quality_rules(none).count() == 0 and QR.quality_filter(none).count() == 0


# --- 10: multiset fingerprints -----------------------------------------------------------------------
def test_multiset_fingerprints(spark, sf_dir, texts):
    got, ids = by_id(Q.QUERIES["op10_multiset_fingerprints"](spark, sf_dir)), sorted(texts)
    near = []
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, r, k = texts[i], got[i], len(texts[i]) // 4
        edited = t[:len(t) - k] + texts[j][:k]
        a, b, c = MH.text_vector(t), MH.text_vector(edited), MH.text_vector(texts[j])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (MH.as_bytes(a).hex(), MH.as_bytes(b).hex())
        assert (r.near_edited, r.near_next) == (MH.likeness(a, b), MH.likeness(a, c))
        near.append(r.near_edited > r.near_next)
    assert np.mean(near) > 0.95


def test_multiset_order_insertion_deletion():
    p = [b"one paragraph of text", b"another one, longer than the first", b"x", b"", b"x"]
    whole = MH.paragraphs_vector(p)
    assert (MH.paragraphs_vector(p[::-1]) == whole).all()
    assert (MH.reduced(MH.paragraphs_vector(p[:2]) + MH.paragraphs_vector(p[2:])) == whole).all()
    assert (MH.reduced(whole - MH.paragraphs_vector(p[2:3])) == MH.paragraphs_vector(p[:2] + p[3:])).all()
    assert not (MH.paragraphs_vector(p[:4]) == whole).all()


def test_multiset_odd(odd, none, spark):
    rows = MH.edited_fingerprints(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = [r.fingerprint for r in rows if r.doc_id in (6, 7)]
    assert len(same) == 3 and len(set(same)) == 1
    one = MH.edited_fingerprints(spark.createDataFrame([(1, "abcd efgh ijkl mnop")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert MH.edited_fingerprints(none).count() == 0 and MH.fingerprints(odd).count() == len(ODD)
