"""Stateless scoring of a customer feed with Structured Streaming.

Enrichment (C1-C10), the next-best-action rules (K1) and the risk label
(J3) are row-local column expressions, so the same builders run unchanged
on a ``readStream`` frame. The one global input, the CLV p75 threshold of
rule 1, comes from the batch customer table and is passed in as a value:
a stream cannot re-rank its whole history every micro-batch, and the
threshold moves slowly, so it is refreshed by re-starting the query (or
per micro-batch from the batch table in ``foreachBatch``).

No state is kept, so no watermark is needed; the checkpoint location lives
in the shared ``spark.checkpoint.dir`` so a restarted query (or a lost
executor) resumes from the last committed offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbtide.functions.scalars import risk_label
from ebbtide.operators.enrich import enrich
from ebbtide.operators.nba import clv_threshold, nba_recommendations
from ebbtide.session import ensure_checkpoint_dir


def batch_clv_threshold(customers: DataFrame) -> float:
    """The rule-1 CLV threshold of the batch table, as one number."""
    return customers.sparkSession.range(1).select(clv_threshold(enrich(customers)).alias("t")).first()["t"]


def score_feed(feed: DataFrame, clv_thr: float) -> DataFrame:
    """Enrich + NBA + risk label on a (streaming or batch) customer feed."""
    rec = nba_recommendations(enrich(feed), F.lit(float(clv_thr)))
    return rec.withColumn("risk_label", risk_label(F.col("churn_risk_score")))


def start_scoring(spark: SparkSession, source_dir: str, schema, sink_dir: str, clv_thr: float,
                  available_now: bool = True, name: str = "nba-scoring") -> StreamingQuery:
    """Read new Parquet files of customer rows from ``source_dir``, score
    them and append the results as Parquet to ``sink_dir``."""
    feed = spark.readStream.schema(schema).parquet(source_dir)
    w = (score_feed(feed, clv_thr).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{ensure_checkpoint_dir(spark)}/streams/{name}")
         .option("path", sink_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_scoring_refreshed(spark: SparkSession, source_dir: str, schema, sink_dir: str, customers_dir: str,
                            available_now: bool = True, name: str = "nba-scoring-refreshed") -> StreamingQuery:
    """As ``start_scoring``, but the CLV threshold is recomputed from the
    batch customer table (Parquet at ``customers_dir``) for every micro-batch
    inside ``foreachBatch`` and written to the batch's own folder, so a replayed
    batch is not stored twice."""
    def score_batch(batch: DataFrame, batch_id: int) -> None:
        cust = spark.read.parquet(customers_dir)
        thr = clv_threshold(enrich(cust))                      # scalar subquery, stays in the plan
        out = nba_recommendations(enrich(batch), thr).withColumn("risk_label", risk_label(F.col("churn_risk_score")))
        # a folder of its own for each batch: a replayed batch overwrites itself
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    feed = spark.readStream.schema(schema).parquet(source_dir)
    w = (feed.writeStream.foreachBatch(score_batch)
         .option("checkpointLocation", f"{ensure_checkpoint_dir(spark)}/streams/{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
