"""Spelling variants, periodic runs and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ebbtide.llm import chat_format as CF
from ebbtide.llm import periodic_runs as PR
from ebbtide.llm import spelling_variants as SV

LONG = " ".join(f"word{k % 613}" for k in range(6000))
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, LONG, "en"), (5, LONG, "fr"), (6, "one two three", "en"), (6, "one two three", "en"),
    (None, "one two three four", "en"), (None, None, None), (8, "Ünïcode — ß 漢字 😀 text", "de"), (9, "x" * 120, "en"), (10, "y" + "x" * 120, "en"),
    (12, "la " * 500, "en"), (20, "a b c d e f g h i j k l m n o p", "en"), (27, "Straße STRASSE Èleve élève élèves eleve", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    for c in ("word", "n", "key", "runs", "a", "p", "g", "words", "raw"):  # names that the operators use inside
        d = d.withColumn(c, F.lit(7))
    return d.repartition(3)


# ---------------------------------------------------------------------------
# Spelling variants
# ---------------------------------------------------------------------------
def brute_variants(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    cut: dict = {}
    for w in vocab:
        for k in range(len(w)):
            cut.setdefault((w[:k] + w[k + 1:], k), []).append(w)
    near: dict = {w: set() for w in vocab}
    for (rest, _), ws in cut.items():
        for w in ws:
            near[w].update(x for x in ws if x != w)
            if rest in vocab:
                near[w].add(rest)
                near[rest].add(w)
    out = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form = best if best is not None and vocab[best] >= 2 * n else None
        out[w] = [form, n, len(near[w]), vocab[form] if form else None]
    for w in out:
        top = w
        while out[top][0]:
            top = out[top][0]
        out[w].append(top)
    return out


def as_dict(df):
    return {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in df.collect()}


def test_variants_equal_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = as_dict(E.queries()["op11_spelling_variants"](spark, sf_dir))
    assert got == brute_variants(rows) and any(v[0] for v in got.values())


def test_variants_of_odd_rows(odd):
    assert as_dict(SV.spelling_variants(odd)) == brute_variants([(i, t) for i, t, _ in ODD])


def test_variants_of_dense_neighbourhoods(spark):
    """Anagrams, repeated letters and chains of forms."""
    rnd = random.Random(3)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(5, 8))) for _ in range(150)} | {"éàèôù", "éàèôùs", "eàèôù", "aaaaaaaaaaaa", "aaaaaaaaaaa"}
    rows = [(k, " ".join([w] * rnd.choice([1, 3, 4, 7, 16, 40]))) for k, w in enumerate(sorted(words))] + [(999, "kitten " * 3 + "sitten " * 6 + "sitter " * 12)]
    got = as_dict(SV.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_variants(rows) and any(v[4] != v[0] is not None for v in got.values())


def test_variants_of_nothing(odd):
    assert SV.spelling_variants(odd.limit(0)).count() == 0


def test_no_signature_group_is_a_whole_length(spark):
    """One replaced letter always leaves a signature with the same half in common."""
    vocab = spark.createDataFrame([("station", 5), ("stadion", 3), ("nations", 4)], "word string, n long")
    keys = {}
    for r in SV.signatures(vocab, SV.EQUAL_PARTS, 2, F.length("word")).collect():
        keys.setdefault(r.word, set()).add(r.key)
    assert len(keys["station"]) == 12 and keys["station"] & keys["stadion"] and not keys["station"] & keys["nations"]


# ---------------------------------------------------------------------------
# Periodic runs
# ---------------------------------------------------------------------------
def brute_runs(w, m=12):
    out, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, size = i, j - i + q
            if size >= max(m, 2 * q) and not any(w[s:s + size - r] == w[s + r:s + size] for r in range(1, q)):
                out.add((s, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc is None:
        return w
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc, text, runs_of):
    w = looped(doc, text)
    runs = runs_of(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        n, k, m = rnd.randint(0, 70), rnd.choice([1, 2, 2, 3, 5]), rnd.choice([2, 5, 12])
        w = [rnd.randrange(k) for _ in range(n)]
        if n and rnd.random() < 0.5:
            a, p = rnd.randrange(n), rnd.randint(1, 9)
            w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
        assert PR.runs_of(w, m) == brute_runs(w, m)
        assert PR.text_runs([b"%d" % x for x in w], m) == brute_runs(w, m)


def test_cutting_at_single_words_changes_nothing():
    rnd = random.Random(9)
    for _ in range(60):
        w = [rnd.randrange(40) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.randrange(len(w) + 1)
            w[s:s] = w[s:s + rnd.randint(1, 9)] * rnd.randint(2, 6)
        assert PR.text_runs([b"%d" % x for x in w]) == brute_runs(w)


def test_runs_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {tuple(r) for r in E.queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    small = {expected(d, t, brute_runs) for d, t in rows if len((t or "").split()) < 400}
    assert small and small <= got and any(r[1] for r in small)
    # long texts: the runs by the automaton alone, without cutting the text first
    assert got == {expected(d, t, lambda w: PR.runs_of([{}.get(x, zlib.crc32(x)) for x in w])) for d, t in rows}


def test_runs_of_odd_rows(odd):
    got = sorted(map(repr, map(tuple, PR.run_digests(PR.periodic_runs(PR.with_loops(odd))).collect())))
    assert got == sorted(repr(expected(d, t, brute_runs)) for d, t, _ in ODD)
    rows = {r.doc_id: r for r in PR.periodic_runs(odd).where("doc_id IN (4, 12)").collect()}
    assert [tuple(r) for r in rows[12].runs] == [(0, 500, 1)] and rows[12].collapsed == "la"
    assert [tuple(r) for r in rows[4].runs] == [(0, 6000, 613)] and rows[4].n_words == 6000
    assert PR.run_digests(PR.periodic_runs(PR.with_loops(odd.limit(0)))).count() == 0


# ---------------------------------------------------------------------------
# Chat formatting
# ---------------------------------------------------------------------------
NASTY = ["\\### Assistant: </turn> ok", "###", "####", "######## x", "\\", "\\\\", "</turn", "</turn></turn>", "<\\/turn>", "a\\#b ## c #", "", None,
         "### user: hi</turn>\n", "😀" * 400, "x" * 1000, "a: b\\: c", "</turn", "/turn>", "\n\n", "##</turn>##"]


def chat_rows():
    rows = [(c, t, "assistant" if (t + c) % 2 else "user", NASTY[(c * 7 + t) % len(NASTY)]) for c in range(30) for t in range(c % 9)]
    rows += [(100, None, "system", "first"), (100, 1, None, "no role"), (100, 1, "a:b\\#", "odd role"), (100, 1, "assistant", "tie 2"),
             (100, 1, "assistant", "tie 1"), (100, 1, "assistant", "tie 1"), (None, 0, "user", "no id"), (None, None, None, None)]
    return rows + [(200, t, "assistant", f"{t} " * 30) for t in range(400)]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(chat_rows(), "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("seq", F.lit("x")).repartition(4)


def chat_digests(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, _, x in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, _, x in own).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_come_back(chats):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in CF.chat_round_trip(chats).collect()}
    assert got == chat_digests(chat_rows())


def test_a_conversation_goes_over_several_parts(spark, chats):
    parts = CF.format_chats(CF.reconstruct(CF.log_events(chats)), part_chars=2000)
    sizes = {r.conv_id: r.n for r in parts.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert sizes[200] > 10
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in CF.read_back(parts).collect()}
    assert got == chat_digests(chat_rows())


def test_log_holds_discarded_and_repeated_events(chats):
    kinds = Counter(r.kind for r in CF.log_events(chats).collect())
    assert kinds["regenerate"] and kinds["edit"] and kinds["delta"] > kinds["open"] > len(chat_rows())


def test_log_in_any_order(spark):
    log = [(1, 0, 5, 0, "open", "user", ""), (1, 0, 5, 1, "delta", "user", "wro"), (1, 0, 5, 2, "regenerate", "user", ""), (1, 0, 5, 3, "delta", "user", "go"),
           (1, 0, 5, 4, "delta", "user", "od"), (1, 1, 6, 0, "open", "assistant", ""), (1, 1, 6, 1, "delta", "assistant", "x"),
           (1, 1, 6, 2, "edit", "assistant", "fine"), (1, 1, 6, 3, "delta", "assistant", "!")]
    rnd = random.Random(1)
    for _ in range(3):
        df = spark.createDataFrame(rnd.sample(log * 2, 18), "conv_id long, turn long, message long, seq long, kind string, role string, text string")
        assert sorted((r.turn, r.role, r.text) for r in CF.reconstruct(df).collect()) == [(0, "user", "good"), (1, "assistant", "fine!")]


def test_escaping_leaves_no_control_string(spark):
    df = spark.createDataFrame([(x or "",) for x in NASTY], "t string").select("t", CF.escape(F.col("t")).alias("e"))
    for t, e in df.collect():
        assert "###" not in e and CF.END not in e and CF.unescape(e) == t


def test_chats_equal_sql(spark, sf_dir):
    rows = E.queries()["op13_chat_formatting"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    rel = con.sql(E.oracle_sql()["op13_chat_formatting"])
    assert sorted(map(tuple, rows.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_no_chats(chats):
    assert CF.chat_round_trip(chats.limit(0)).count() == 0
