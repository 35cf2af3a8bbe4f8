"""Histogram trees, delimited texts, chunk append and versioned artefacts."""

import json
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import session
from ebbtide.operators import ml, trees
from ebbtide.plans.inspect import physical_plan
from ebbtide.sources import delimited as DL
from ebbtide.sources.artifacts import ArtifactStore
from ebbtide.sources.tables import append_chunks, merged_type, read_chunks


def fresh(spark, name):
    """A folder of its own: the shared folder may outlive a run."""
    return session.scratch_dir(spark, f"{uuid.uuid4().hex}-{name}")


def _data(spark, n=900, seed=0, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(1)
    y = ((x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=n) * noise) > 0).astype(float)
    df = spark.createDataFrame([(int(i), Vectors.dense(*map(float, r)), float(t)) for i, (r, t) in enumerate(zip(x, y))], ["id", "features", "label"])
    return trees.with_features(df.repartition(4), "id", "label"), x, y


def _scores(model, d):
    return np.array([r.probability for r in model.transform(d, "id").orderBy("id").collect()])


def brute_boost(x, y, rounds, depth, rate=0.3, l2=1.0, min_weight=1.0):
    """Second-order boosting over all distinct values, recursively, in floating point."""
    scale = (y == 0).sum() / max((y == 1).sum(), 1)
    w, margin = np.where(y == 1, scale, 1.0), np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, out = (p - y) * w, p * (1 - p) * w, np.zeros(len(y))

        def part(rows, d):
            tg, th, best = g[rows].sum(), h[rows].sum(), None
            if d < depth:
                for f in range(x.shape[1]):
                    for v in np.unique(x[rows, f])[:-1]:
                        go = x[rows, f] <= v
                        gl, hl = g[rows][go].sum(), h[rows][go].sum()
                        if hl >= min_weight and th - hl >= min_weight:
                            gain = gl ** 2 / (hl + l2) + (tg - gl) ** 2 / (th - hl + l2)
                            if best is None or gain > best[0] + 1e-6:
                                best = gain, f, v
            if best and best[0] > tg ** 2 / (th + l2) + 1e-6:
                go = x[rows, best[1]] <= best[2]
                part(rows[go], d + 1)
                part(rows[~go], d + 1)
            else:
                out[rows] = -rate * tg / (th + l2)

        part(np.arange(len(y)), 0)
        margin += out
    return 1 / (1 + np.exp(-margin))


def test_boosting_equals_brute_force(spark):
    d, x, y = _data(spark, 300)
    model = trees.boosted(d, "id", rounds=4, rule=trees.Rule(max_depth=3))
    assert _scores(model, d) == pytest.approx(brute_boost(x, y, 4, 3), abs=1e-4)


def test_distributed_levels_give_the_same_trees(spark):
    d, _, _ = _data(spark)
    one = trees.boosted(d, "id", rounds=3, rule=trees.Rule(max_depth=4))
    many = trees.boosted(d.repartition(7), "id", rounds=3, rule=trees.Rule(max_depth=4), local_rows=100)
    assert (_scores(one, d) == _scores(many, d)).all()
    a, b = trees.forest(d, "id", trees=2), trees.forest(d.repartition(3), "id", trees=2, local_rows=100)
    assert (_scores(a, d) == _scores(b, d)).all()


def test_a_boosted_level_is_one_job(spark):
    """Rounds over shares of the rows: three levels a tree cost at most three jobs."""
    d, _, _ = _data(spark)
    jobs = []
    for rounds in (1, 3):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "boosted")
        trees.boosted(d, "id", rounds=rounds, rule=trees.Rule(max_depth=3), local_rows=20)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup(uuid.uuid4().hex, "")
    assert jobs[1] - jobs[0] <= 2 * 3


def test_shares_with_two_bin_and_constant_features(spark):
    """Eight features of two bins share a byte; nineteen of them, a constant and a wide one."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 2, (600, 19)), np.full(600, 7.0), rng.normal(size=600).round(1)]).astype(float)
    y = ((x[:, 0] + x[:, 9] + x[:, 18] + x[:, 20] + rng.normal(size=600) * 0.5) > 1.5).astype(float)
    df = spark.createDataFrame([(int(i), [*map(float, r)], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, features array<double>, label double")
    one, many = (trees.boosted(df.repartition(3), "id", rounds=3, rule=trees.Rule(max_depth=4), local_rows=n) for n in (1000, 100))
    assert one.to_json() != "" and (_scores(one, df) == _scores(many, df)).all()


def test_pure_nodes_draw_no_features(monkeypatch):
    drawn, draw = [], trees.Rule.drawn
    monkeypatch.setattr(trees.Rule, "drawn", lambda self, *a: drawn.append(a) or draw(self, *a))
    rule = trees.Rule(l2=0.0, min_weight=0.0, max_depth=None, negate=False, features=2)
    bins, h = np.random.default_rng(0).integers(0, 200, (500, 6)).astype(np.uint8), np.full(500, int(trees.UNIT))
    for g in (h, 0 * h):
        assert trees.grow_local(bins, g, h, rule, 256, 0, 1, 0).feature == [-1]
    assert not drawn


def test_few_rows_are_cut_as_by_histogram():
    rng = np.random.default_rng(1)
    for rule in (trees.Rule(), trees.Rule(l2=0.0, min_weight=0.0, max_depth=None, negate=False)):
        for n in (2, 3, 10, 60, 200):
            part = rng.integers(0, rng.choice([2, 5, 250]), (4, n)).astype(np.uint8)
            h = rng.integers(1, 5, n) * trees.UNIT
            g = np.where(rng.random(n) < 0.4, h, 0.0)
            assert trees._best_local(part, g, h, rule, 256, 0) == rule.best(*trees.sums(part, 256, g, h), None, 0)


def test_split_keeps_rows_where_they_are(spark):
    """A large table is not shuffled by class, of which there are two."""
    df = spark.range(50_000_000).selectExpr("id AS customer_id", "id % 2 AS churned", "id * 2 AS x")
    plan = physical_plan(ml.with_split(df))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_full_depth_tree_learns_every_row(spark):
    d, x, y = _data(spark, noise=2.0)
    model = trees.forest(d, "id", trees=1, bootstrap=False, features=None, balanced=False, local_rows=150)
    first = {}
    for r, t in zip(map(tuple, x), y):
        first.setdefault(r, []).append(t)
    # a full tree gives each distinct feature vector the mean of its labels
    assert _scores(model, d) == pytest.approx([np.mean(first[tuple(r)]) for r in x], abs=1e-6)
    assert max(model.trees[0].depth) > 8


def test_a_forest_stays_in_a_table(spark, monkeypatch):
    """The driver keeps the parts above the subtrees, and gets one row a node; scoring deals the rows
    to the subtrees and gives what the whole trees give, in any number of passes, parts and blocks."""
    d, _, _ = _data(spark, noise=2.0)
    sent, collect = [], type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: sent.extend(out := collect(self)) or out)
    one, many = (trees.forest(d, "id", trees=3, local_rows=n) for n in (1000, 100))
    assert [len(t.feature) for t in one.tops] == [1, 1, 1] and max(len(t.feature) for t in many.tops) < 100
    assert len(sent) < 100 * 3 and min(len(t.feature) for t in many.trees) > 200
    monkeypatch.undo()
    whole = _scores(trees.TreeModel("forest", many.cuts, many.trees), d)
    assert (_scores(one, d) == whole).all() and (_scores(many, d) == whole).all()
    for name, value in (("PASS_ROWS", 1000), ("SUBTREE_ROWS", 300), ("BLOCK_BITS", 6)):
        monkeypatch.setattr(trees, name, value)
    assert (_scores(many, d) == whole).all() and many.transform(d.where("id < 0"), "id").count() == 0


def test_models_survive_json(spark):
    d, _, _ = _data(spark, 300)
    model = trees.boosted(d, "id", rounds=2)
    assert (_scores(trees.TreeModel.from_json(model.to_json()), d) == _scores(model, d)).all()


def _tree_sql(model):
    """A boosted model as one SQL expression over the columns f0, f1, ..."""
    def node(t, k):
        if t.feature[k] < 0:
            return repr(t.value[k])
        edges = model.cuts[t.feature[k]]
        return f"CASE WHEN f{t.feature[k]} <= {edges[t.cut[k]]!r} THEN {node(t, t.left[k])} ELSE {node(t, t.right[k])} END"
    return "1 / (1 + exp(-(" + " + ".join(node(t, 0) for t in model.trees) + ")))"


def test_scores_and_metrics_in_sql(spark, customers, tmp_path):
    """The scored rows are written down; DuckDB recomputes probabilities from the trees and
    the metrics from the scores."""
    t = ml.TreeTraining(customers)
    model = t.boosted(rounds=10)
    n = len(model.cuts)
    rows = t.test.select("id", "label", *[F.col("features")[k].alias(f"f{k}") for k in range(n)])
    rows.write.parquet(str(tmp_path / "rows"))
    t.scored(model).where("is_test").write.parquet(str(tmp_path / "scored"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW r AS SELECT * FROM '{tmp_path}/rows/*.parquet'; CREATE VIEW s AS SELECT * FROM '{tmp_path}/scored/*.parquet'")
    off = con.execute(f"SELECT count(*), max(abs(p - probability)) FROM (SELECT id, {_tree_sql(model)} AS p FROM r) JOIN s USING (id)").fetchone()
    assert off[0] == t.test.count() and off[1] < 1e-9
    want = con.execute("""SELECT round(avg(CAST((probability >= .5) = (label = 1) AS INT)), 4),
        round((SELECT avg(CASE WHEN a.probability > b.probability THEN 1 WHEN a.probability = b.probability THEN .5 ELSE 0 END)
               FROM s a, s b WHERE a.label = 1 AND b.label = 0), 4) FROM s""").fetchone()
    got = t.metrics(model, "GradientBoosting").first()
    assert (got.accuracy, got.roc_auc) == pytest.approx(want, abs=1e-4)


# ---------------------------------------------------------------------------
# Delimited texts
# ---------------------------------------------------------------------------
TEXTS = [
    ('a,b,c\n1,"x, ""y""",3\n\n4,,6\n', ",", [["a", "b", "c"], ["1", 'x, "y"', "3"], ["4", None, "6"]]),
    ('a|b\n"q|r\nz"|2\nu|v|w', "|", [["a", "b"], ["q|r\nz", "2"], ["u", "v", "w"]]),
    ('a\tb\r\n5" x\t"open\r\n', "\t", [["a", "b"], ['5" x', '"open']]),
    ('"",""\n"""","a"b\n', ",", [[None, None], ['"', "ab"]]),
    ("a,b\n1\n2,3,4,5\n,", ",", [["a", "b"], ["1"], ["2", "3", "4", "5"], [None, None]]),
    ("a,b\n" + "1," + "x" * 200_000 + "\n" + '2,"' + 'y""' * 50_000 + '"\n', ",", [["a", "b"], ["1", "x" * 200_000], ["2", 'y"' * 50_000]]),
    ("", ",", []), (None, ",", []), ("no separator", None, []), ("\n \n", ",", []),
]


def test_cells_of_quoted_and_ragged_texts(spark):
    df = spark.createDataFrame([(k, t, s) for k, (t, s, _) in enumerate(TEXTS)], "doc_id long, text string, separator string").repartition(3)
    got: dict = {}
    for r in DL.cells(df).orderBy("doc_id", "record", "field").collect():
        rows = got.setdefault(r.doc_id, [])
        if r.field == 0:
            rows.append([])
        assert r.record == len(rows) - 1 and r.field == len(rows[-1])
        rows[-1].append(r.value)
    assert [got.get(k, []) for k in range(len(TEXTS))] == [want for _, _, want in TEXTS]


def test_field_types(spark):
    text = "i,d,b,s,e,m\n1,1.5,true,x,,1\n-2,2e3,FALSE,1,,x\n+3,.5,false,,,\n"
    out = DL.field_types(DL.parse_texts(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert {r.name: (r.type, r.n_values, r.n_empty) for r in out.collect()} == {
        "i": ("bigint", 3, 0), "d": ("double", 3, 0), "b": ("boolean", 3, 0), "s": ("string", 2, 1), "e": ("double", 0, 3), "m": ("string", 2, 1)}


def test_text_files_become_tables(spark):
    for sep in DL.SNIFF_SEPARATORS:
        path = fresh(spark, f"test-text-{ord(sep)}")
        spark.range(50).select(F.col("id").alias(" Row Id "), (F.col("id") / 4).alias("quarter")).write.option("header", True).option("sep", sep).csv(path)
        assert DL.sniff_file(spark, path) == sep
        out = DL.read_text_table(spark, path)
        assert out.dtypes == [("row_id", "int"), ("quarter", "double")] and out.agg(F.sum("row_id"), F.sum("quarter")).first() == (1225, 306.25)
    path = fresh(spark, "test-prose")
    spark.createDataFrame([("just prose",), ("of two lines",)], "t string").write.text(path)
    assert DL.sniff_file(spark, path) is None and DL.read_text_table(spark, path).count() == 2


# ---------------------------------------------------------------------------
# Chunks and artefacts
# ---------------------------------------------------------------------------
@pytest.mark.parametrize("a, b, want", [
    (T.IntegerType(), T.LongType(), T.LongType()), (T.IntegerType(), T.DoubleType(), T.DoubleType()), (T.DateType(), T.StringType(), T.StringType()),
    (T.DateType(), T.TimestampType(), T.TimestampType()), (T.DecimalType(10, 2), T.IntegerType(), T.DecimalType(12, 2)),
    (T.DecimalType(38, 2), T.LongType(), T.DecimalType(38, 2)), (T.DecimalType(38, 0), T.DecimalType(10, 5), T.DoubleType()),
    (T.NullType(), T.BooleanType(), T.BooleanType()), (T.BooleanType(), T.IntegerType(), T.StringType())])
def test_types_meet_in_one(a, b, want):
    assert merged_type(a, b) == want and merged_type(b, a) == want


def test_chunks_with_differing_types(spark):
    a = spark.createDataFrame([(1, 2, "x")], "`Row Id` int, n int, s string")
    b = spark.createDataFrame([(2**40, 2.5)], "row_id long, N double")
    c = spark.sql("SELECT 3 AS row_id, DATE'2020-01-02' AS s, NULL AS n, true AS extra")
    out = append_chunks([a, b, c])
    assert out.dtypes == [("row_id", "bigint"), ("n", "double"), ("s", "string"), ("extra", "boolean")]
    assert sorted(map(tuple, out.collect())) == [(1, 2.0, "x", None), (3, None, "2020-01-02", True), (2**40, 2.5, None, None)]
    with pytest.raises(ValueError):
        append_chunks([spark.sql("SELECT 1 AS `a b`, 2 AS A_B")])


def test_chunk_files(spark):
    paths = []
    for k, df in enumerate([spark.range(3).select(F.col("id").alias("v")), spark.range(3).select((F.col("id") + 0.5).alias("v"))]):
        paths.append(fresh(spark, f"test-chunk-{k}.csv"))
        df.write.option("header", True).csv(paths[-1])
    out = read_chunks(spark, paths)
    assert out.dtypes == [("v", "double")] and out.agg(F.sum("v")).first()[0] == 7.5


def test_only_whole_versions_are_read(spark):
    store = ArtifactStore(spark, fresh(spark, "test-artifacts"))
    with pytest.raises(LookupError):
        store.manifest()
    df = spark.range(5).select("id", (F.col("id") / 2).alias("x"))
    assert store.write(tables={"t": df}, texts={"note": "ü one"}) == 1

    def stop():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.write(tables={"t": df.limit(1)}, before_commit=stop)
    assert store.versions() == [1] and store.table("t").exceptAll(df).isEmpty() and store.text("note") == "ü one"
    assert store.write(tables={"t": df.limit(2)}, fmt="parquet") == 2
    assert store.table("t").count() == 2 and store.table("t", 1).count() == 5
    with pytest.raises(LookupError):
        store.text("note")
    # a second writer that wants the same number takes the next one
    assert not store._commit(f"{store.root}/absent", 2) and store.write(texts={"a": "b"}) == 3
    m = store.manifest(1)
    lost = next(f for f in m["files"] if f.endswith(".json"))
    store._fs.delete(store._path(f"{store.root}/{m['folder']}/{lost}"), False)
    with pytest.raises(OSError):
        store.table("t", 1)


def test_saved_model_scores_the_same(spark, customers):
    df = customers.select("customer_id", "region", "monthlycharges", "tenuremonths", "supporttickets", "churned")
    models = ml.TrainedModels(df, include_gbt=False)
    store = ArtifactStore(spark, fresh(spark, "test-models"))
    models.save_version(store)
    rows = lambda m, i: sorted(map(tuple, ml.score_customers(m, df, i).select("customer_id", "churn_probability", "risk_label").collect()))
    assert rows(store.model("model"), store.table("importances")) == rows(models.best, models.importances())
    assert sorted(map(tuple, store.table("metrics").collect())) == sorted(map(tuple, models.metrics.collect()))
    assert store.text("best") == models.best_name
    assert json.loads(store._read(f"{store.root}/manifest-00000001.json"))["parts"]["model"]["kind"] == "model"
