"""The streaming scorer gives the batch NBA results."""

import uuid

from ebbtide.operators.enrich import enrich
from ebbtide.operators.nba import nba_recommendations
from ebbtide.session import scratch_dir
from ebbtide.sources.fixtures import customers
from ebbtide.streaming.scoring import batch_clv_threshold, start_scoring


def test_stream_matches_batch(spark, sf_dir):
    cust = customers(spark, sf_dir)
    src = scratch_dir(spark, f"t-stream-src-{uuid.uuid4().hex}")
    out = scratch_dir(spark, f"t-stream-out-{uuid.uuid4().hex}")
    cust.write.parquet(src)
    thr = batch_clv_threshold(cust)
    q = start_scoring(spark, src, cust.schema, out, thr, name=f"t-{uuid.uuid4().hex}")
    q.awaitTermination(120)
    got = spark.read.parquet(out).select("customer_id", "recommendation")
    want = nba_recommendations(enrich(cust)).select("customer_id", "recommendation")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_refreshed_stream_matches_batch(spark, sf_dir):
    from ebbtide.streaming.scoring import start_scoring_refreshed
    cust = customers(spark, sf_dir)
    src = scratch_dir(spark, f"t-stream-src-{uuid.uuid4().hex}")
    ref = scratch_dir(spark, f"t-stream-ref-{uuid.uuid4().hex}")
    out = scratch_dir(spark, f"t-stream-out-{uuid.uuid4().hex}")
    cust.write.parquet(src)
    cust.write.parquet(ref)
    q = start_scoring_refreshed(spark, src, cust.schema, out, ref, name=f"t-{uuid.uuid4().hex}")
    q.awaitTermination(120)
    got = spark.read.parquet(out).select("customer_id", "recommendation")
    want = nba_recommendations(enrich(cust)).select("customer_id", "recommendation")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
