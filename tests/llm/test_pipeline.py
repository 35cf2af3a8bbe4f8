"""The corpus pipeline, stage by stage, against the brute-force versions."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from ebbtide.llm.common import materialise, table
from ebbtide.llm.quality_rules import quality_rules
from tests.llm.test_operators_llm import brute_components, brute_dedup, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF, "documents")]
    for name, stage in P.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), "test-stage"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(steps):
    assert all(d.schema.simpleString() == steps[0].schema.simpleString() for d in steps[1:-1])


def test_quality(steps):
    kept = {r.doc_id for r in quality_rules(steps[0]).collect() if r.kept}
    assert set(rows(steps[1])) == kept and 0 < len(kept) < steps[0].count()


def test_near_duplicates(steps):
    comp = brute_components({i: simhash(r.text.encode()) for i, r in rows(steps[1]).items()})
    assert set(rows(steps[2])) == set(comp.values())


def test_repeated_passages(steps):
    before = [(i, r.text.encode()) for i, r in rows(steps[2]).items()]
    want = {i: kept.decode("utf-8", "ignore") for (i, _), (_, kept) in zip(before, brute_dedup(before))}
    got = rows(steps[3])
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_mixing(steps):
    before, after = rows(steps[3]), rows(steps[4])
    words = lambda d: sum(len(r.text.encode().split()) for r in d.values())
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)
    assert words(after) >= int(P.BUDGET * words(before))


def test_packing_and_run(spark, steps):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.tokenizer("word_bpe_49k.json"))
    want = {}
    for i, r in rows(steps[4]).items():
        ids = tok.encode(r.text, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k] = (len(ids[at:at + 2048]), zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes()))
    got = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in P.run(spark, SF).collect()}
    assert got == want == {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in steps[5].collect()}
