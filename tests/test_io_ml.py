"""Sources, sinks and the ML pipeline."""

import os

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import ml
from ebbtide.session import scratch_dir
from ebbtide.sources import io as IO
from ebbtide.sources.tables import append_chunks, detect_format, load_table


def test_csv_infer_and_normalize(spark):
    path = scratch_dir(spark, "t-csv-infer")
    df = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None)], "`Customer ID` string, `Support Tickets` int, x double")
    df.write.mode("overwrite").option("header", True).csv(path)
    back = load_table(spark, path, fmt="csv")
    assert back.columns == ["customer_id", "support_tickets", "x"]
    assert dict(back.dtypes)["support_tickets"] == "int"
    assert detect_format("a/b.TSV") == "csv" and detect_format("x.parquet") == "parquet"


def test_roundtrips(spark, customers):
    for fmt in ("csv", "json", "parquet"):
        back = IO.roundtrip(customers, fmt)
        assert back.count() == customers.count()
        assert back.exceptAll(customers.select(*back.columns)).count() == 0


def test_sniff(spark):
    docs = spark.createDataFrame([(1, "a,b,c\n1,2,3\n\n4,5"), (2, "x\ty\n1\t2"), (3, "just prose\nno table"),
                                  (4, "a|b\n1|2|3|4|5"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["separator"] for r in IO.sniff_delimiter(docs).collect()}
    assert got == {1: ",", 2: "\t", 3: None, 4: None, 5: None}


def test_append_chunks(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([(2,)], "id int")
    assert append_chunks([a, b]).count() == 2


def test_text_preview_whole_text_counts(spark):
    docs = spark.createDataFrame([(1, "w " * 5000)], "doc_id long, text string")
    row = IO.text_preview(docs).first()
    assert row["text_chars"] == 10000 and row["text_words"] == 5000 and row["truncated"]
    assert len(row["preview"]) == 8000


def test_classification_metrics_and_auc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.4, 1), (0.3, 0), (0.3, 0)],
                               "s double, y int")
    m = ml.classification_metrics(df, "s", "y").first()
    # AUC: pairs (pos, neg) = 3*3 = 9; pos 0.9, 0.8 beat all 3 negatives; 0.4 beats two 0.3s
    assert m["roc_auc"] == round(8 / 9, 4)
    assert m["accuracy"] == round(4 / 6, 4) and m["precision"] == round(2 / 3, 4)


def test_model_learns_planted_signal_and_roundtrips(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        x = rnd.random()
        y = 1 if x + rnd.gauss(0, 0.15) > 0.6 else 0
        rows.append((i, x, rnd.random(), "A" if i % 2 else "B", y))
    df = spark.createDataFrame(rows, "customer_id long, signal double, noise double, plan_type string, churned int")
    tm = ml.TrainedModels(df, include_gbt=False)
    best = tm.metrics.orderBy(F.desc("roc_auc")).first()
    assert best["roc_auc"] > 0.8
    imp = tm.importances().first()
    assert imp["feature"] == "signal"
    path = tm.save(scratch_dir(spark, "t-model"))
    loaded = ml.load_model(path)
    scored = ml.score_customers(loaded, df, tm.importances())
    assert scored.count() == 600
    assert spark.read.json(os.path.join(path, "_metrics")).count() == 2
