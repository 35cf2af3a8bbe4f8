"""Cases of the contracts that the tables hardly hold: letters, long repetitive texts,
the count filter, tokens of odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ebbtide.llm import language_id as LI
from ebbtide.llm import multiset_hash as MH
from ebbtide.llm import queries as Q
from ebbtide.llm import simhash as SH
from ebbtide.llm import tokens as TK


@pytest.mark.parametrize("text, letters", [("½", False), ("²", False), ("①", False), ("٣", False), ("_", False), ("7", False), ("-", False),
                                           ("a", True), ("ß", True), ("漢", True), ("ª", True), ("½x", True), ("א", True)])
def test_only_letters_are_letters(text, letters):
    assert (LI.word_script(text.encode()) >= 0) == letters


def test_texts_without_a_letter_are_undetermined(spark):
    rows = [(k, "the and of to in is that it was for", "en") for k in range(40)] + [(k, "der die und das ist nicht ein von zu mit", "de") for k in range(40, 80)]
    rows += [(100 + k, t, "en") for k, t in enumerate(["½", "² ①", "", None, "12 34", "½ the"])]
    got = {r.doc_id: r for r in LI.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") >= 100).collect()}
    assert [got[100 + k].lang_pred for k in range(6)] == ["und"] * 5 + ["en"]


# --- 10 -----------------------------------------------------------------------
@pytest.mark.parametrize("unit, n", [("a", 70_000), ("a", 100_000), ("a", 200_000), ("word ", 60_000), ("one line again\n", 20_000)])
def test_likeness_of_long_repetitive_texts(unit, n):
    text = unit * n
    k = len(text) // 4
    edited = text[:len(text) - k] + ("".join(chr(97 + (j * j + j // 7) % 26) for j in range(k)))
    a, b = MH.text_vector(text), MH.text_vector(edited)
    assert MH.likeness(a, a) == 1.0 and MH.likeness(a, b) > 0.85
    assert (MH.replace_from(a, text, len(text) - k, edited[len(text) - k:]) == b).all()


# --- 5 ------------------------------------------------------------------------
def test_the_count_filter_rejects_pairs_and_loses_none():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2 ** 63, dtype=np.uint64)
    own = np.unique(np.array([base ^ (np.uint64(int(rng.integers(0, 256))) << np.uint64(8 * int(p))) ^ (np.uint64(int(rng.integers(0, 256))) << np.uint64(8 * int(q)))
                              ^ (np.uint64(int(rng.integers(0, 4))) << np.uint64(16)) for p, q in rng.integers(0, 3, (300, 2))], np.uint64))
    shared = SH.tally(own, own)
    assert (shared >= 5).all() and (shared == 5).any() and (shared >= 6).any()  # a posting by five positions
    near = np.bitwise_count(own[:, None] ^ own[None, :]) <= 2
    assert not near[shared < 6].any()

    def parts(links):
        root = list(range(own.size))
        for x, y in links:
            a, b = root[x], root[y]
            root = [a if r == b else r for r in root]
        return {frozenset(np.flatnonzero(np.array(root) == r).tolist()) for r in root}

    want = parts(zip(*np.nonzero(near)))
    assert parts(SH.posting_links(own, 2)) == want == parts(SH.posting_links(own, 2, split=10))


def test_index_rows_are_made_by_many_tasks(spark):
    fps = spark.range(5000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).select("fp")
    plan = SH.fingerprint_links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64(fp" in plan


# --- 3, 7 -----------------------------------------------------------------------
@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_batches_encode_as_the_library(name, spaces):
    from tokenizers import Tokenizer
    path = Q.tokenizer(name)
    fresh, enc = Tokenizer.from_file(path), TK.PieceEncoder(path, spaces, limit=300)
    rnd = random.Random(4)
    alphabet = list("ab  '\n\t.,1é漢 ́\x1c\x85​😀s t'll½²")
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(6000)]
    texts += ["", " ", "x", "one <|endoftext|> two", "a\x1cb \x1cabc d\x1c e", "a b", " a", "a ", "it's we'll 'tis", "<|startoftext|><|endoftext|>"]
    got = enc.encode([t.encode() for t in texts])
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, np.uint32).tolist() == fresh.encode(t, add_special_tokens=False).ids, t


def test_equal_rows_without_an_id_spread_over_all_groups(spark):
    """A third of the rows are the same text without a doc_id."""
    from ebbtide.llm import packing as PK
    rows = [(None, "the same words again and again")] * 1000 + [(k, f"document {k} " * (k % 40 + 1)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = PK.pack(docs, Q.tokenizer("word_bpe_49k.json"), group_sequences=4).toPandas()
    groups = out.assign(g=out.sequence_id.to_numpy() >> 32)
    total = groups.groupby("g").length.sum()
    assert len(total) >= 8 and total.max() < 1.5 * total.mean() and (out.doc_id.isna()).sum() == 1000
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 2048 and (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all()


def test_registered_operators():
    assert [k for k in E.queries() if k.startswith("op")] == [
        "op1_mixing", "op2_language_id", "op3_packing", "op4_lm_scoring", "op5_simhash", "op6_warc", "op7_token_planes", "op8_suffix_dedup",
        "op9_quality_rules", "op10_multiset_fingerprints", "op11_spelling_variants", "op12_periodic_runs", "op13_chat_formatting"]
