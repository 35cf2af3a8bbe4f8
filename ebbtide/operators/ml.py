"""Churn-propensity pipeline on Spark ML.

Training table = the enriched customer table (same columns at train and
score time). The fitted ``PipelineModel`` carries every preprocessing step
(median imputation, scaling, mode fill, one-hot), so scoring is one
``transform`` over the whole table. Everything that can be checked with SQL
(feature selection, split, imputation values, class weights, metrics on a
given score) is a plain DataFrame job.
"""

from __future__ import annotations

import os

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.quantiles import quantile_struct
from ebbtide.functions.columns import CHURN_ALIASES, find_col
from ebbtide.functions.ranking import with_totals_before
from ebbtide.functions.scalars import r, risk_label, safe_numeric
from ebbtide.operators import trees
from ebbtide.sources.artifacts import ArtifactStore

# Identifier columns, preferred features, split and model settings.
DROP_COLS = ["customer_id", "customerid", "id"]
PREFERRED_CAT = ["region", "state", "city_tier", "customer_segment", "acquisition_channel", "plan_type",
                 "contract_type", "payment_method", "gender"]
PREFERRED_NUM = ["tenure_months", "monthly_charges", "total_charges", "estimated_clv", "churn_risk_score",
                 "upsell_probability", "satisfaction_score", "complaints_90d", "payment_failures_12m",
                 "support_tickets_12m", "retention_offer_cost", "age", "num_products"]
MAX_CAT_CARDINALITY = 30
TEST_FRACTION = 0.2
SEED = 42
LR_MAX_ITER = 500
RF_TREES = 200
#: Depth of a tree of Spark's own forest, which holds a node table for each level; ``trees.forest`` grows full trees.
RF_DEPTH = 5
GBT_ITER = 200
TOP_IMPORTANCES = 30
TOP_FACTORS = 5
PRED_CUT = 0.5

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


# ---------------------------------------------------------------------------
# L1-L2: target and feature selection
# ---------------------------------------------------------------------------
def target_column(df: DataFrame) -> str:
    c = find_col(df, CHURN_ALIASES)
    if c is None:
        raise ValueError(f"no churn target column; expected one of {CHURN_ALIASES}")
    return c


def select_features(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names.

    Preferred names first, then the other numeric columns, then the other
    string columns with at most 30 distinct values (one aggregation over
    those candidate columns only)."""
    y = target_column(df)
    drop = {y} | {c for c in df.columns if c.lower() in DROP_COLS}
    cols = [f for f in df.schema.fields if f.name not in drop]
    names = [f.name for f in cols]
    num = [c for c in PREFERRED_NUM if c in names]
    num += [f.name for f in cols if isinstance(f.dataType, _NUMERIC) and f.name not in num]
    cat = [c for c in PREFERRED_CAT if c in names]
    cand = [f.name for f in cols if isinstance(f.dataType, T.StringType) and f.name not in cat]
    if cand:
        # HyperLogLog sorts out id-like columns (one pass, fixed memory even for billions of
        # values); what is anywhere near the cut is then counted exactly, and is small.
        near = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in cand]).first().asDict()  # one row
        cand = [c for c in cand if near[c] <= 4 * MAX_CAT_CARDINALITY]
    if cand:
        counts = dict(df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in cand])).alias("s"))
                      .select("s.*").where("v IS NOT NULL").distinct().groupBy("c").count().collect())  # one row a column
        cat += [c for c in cand if counts.get(c, 0) <= MAX_CAT_CARDINALITY]
    return num, cat


def feature_selection(df: DataFrame) -> DataFrame:
    num, cat = select_features(df)
    rows = [(i, c, "numeric") for i, c in enumerate(num)] + \
           [(len(num) + i, c, "categorical") for i, c in enumerate(cat)]
    return df.sparkSession.createDataFrame(rows, "position int, feature string, kind string")


# ---------------------------------------------------------------------------
# L3: stratified split; L6: class weights
# ---------------------------------------------------------------------------
#: Hash prefixes of which the split counts the rows before it ranks those at the cut.
SPLIT_BUCKETS = 1 << 16


def split_hash(df: DataFrame) -> Column:
    """The md5 of the row id as hexadecimal digits (reproducible, and independent of
    partitioning); their order is that of the 128-bit numbers."""
    cid = find_col(df, DROP_COLS) or df.columns[0]
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(cid).cast("string"), F.lit(""))))


def split_cuts(df: DataFrame, y: Column, h: Column, row_id: Column, test_fraction: float) -> DataFrame:
    """(cls, cut_hash, cut_id): in each class the last test row in order of (hash, id).

    Exact k-th selection: rows are counted by class and 16-bit prefix of the hash (map-side
    combined), a running count over those at most 65,536 rows a class finds the prefix that
    holds the k-th row, and only that prefix's rows, one in 65,536, are ranked."""
    d = df.where(y.isNotNull()).select(y.alias("cls"), h.alias("h"), row_id.alias("i"),
                                       F.conv(F.substring(h, 1, 4), 16, 10).cast("int").alias("bucket"))
    per = d.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("cls")
    run = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.select("cls", "bucket", "n", F.sum("n").over(run).alias("upto"),
                     F.floor(F.lit(test_fraction) * F.sum("n").over(own) + F.lit(0.5)).alias("k"))
    edge = per.where((F.col("k") > F.col("upto") - F.col("n")) & (F.col("k") <= F.col("upto"))).select(
        "cls", "bucket", (F.col("k") - F.col("upto") + F.col("n")).alias("rank"))
    at = Window.partitionBy("cls").orderBy("h", F.asc_nulls_first("i"))
    near = d.join(F.broadcast(edge), ["cls", "bucket"]).withColumn("r", F.row_number().over(at))
    return near.where(F.col("r") == F.col("rank")).select("cls", F.col("h").alias("cut_hash"), F.col("i").alias("cut_id"))


def with_split(df: DataFrame, test_fraction: float = TEST_FRACTION, label: Column | None = None) -> DataFrame:
    """Adds ``is_test``: in every class the first rows in order of (hash of the id, id),
    exactly as many as the nearest whole number to ``test_fraction`` of the class (rows with
    equal ids stay together). The cuts, one row a class, are joined to the rows; the table
    itself is not shuffled or sorted, and nothing runs while the plan is built. Rows without
    a label are training rows."""
    y = safe_numeric(F.col(target_column(df))) if label is None else label
    cid = F.col(find_col(df, DROP_COLS) or df.columns[0])
    cuts = split_cuts(df, y, split_hash(df), cid, test_fraction)
    tagged = df.withColumn("_h", split_hash(df)).withColumn("_cls", y)
    same_id = cid.isNull() | F.coalesce(cid <= F.col("cut_id"), F.lit(False))
    test = (F.col("_h") < F.col("cut_hash")) | ((F.col("_h") == F.col("cut_hash")) & same_id)
    # broadcast by name: a shuffle by class would send all rows of a class to one task
    return (tagged.join(F.broadcast(cuts), F.col("_cls") == F.col("cls"), "left")
            .select(*df.columns, F.coalesce(test, F.lit(False)).alias("is_test")))


def split_counts(df: DataFrame) -> DataFrame:
    y = target_column(df)
    return (with_split(df).groupBy(safe_numeric(F.col(y)).cast("int").alias("label"), F.col("is_test"))
            .agg(F.count(F.lit(1)).alias("rows")))


def class_weights(df: DataFrame) -> DataFrame:
    """balanced weights n / (2 * n_class) over the training rows."""
    y = target_column(df)
    tr = with_split(df).filter(~F.col("is_test"))
    per = tr.groupBy(safe_numeric(F.col(y)).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n_class"))
    n = tr.agg(F.count(F.lit(1))).scalar()
    return per.select("label", "n_class", r(n.cast("double") / (F.lit(2.0) * F.col("n_class")), 6).alias("weight"))


def _weighted(train: DataFrame, label: str) -> DataFrame:
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = train.agg(F.count(F.lit(1))).scalar()
    w = per.select(label, (n.cast("double") / (F.lit(2.0) * F.col("_nc"))).alias("w"))
    return train.join(F.broadcast(w), label)  # two rows


# ---------------------------------------------------------------------------
# Imputation values (checkable) and the preprocessing stages
# ---------------------------------------------------------------------------
def median_values(df: DataFrame, num: list[str]) -> DataFrame:
    """Exact median per numeric feature (linear interpolation) and the number
    of nulls it fills."""
    xs = [safe_numeric(F.col(c)) for c in num]
    one = df.agg(*[F.count(F.when(x.isNull(), F.lit(1))).alias(f"_z{i}") for i, x in enumerate(xs)]).withColumn(
        "_q", quantile_struct(df, xs, [0.5]))
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), r(F.col(f"_q.q{i}_0"), 6).alias("median"),
                 F.col(f"_z{i}").alias("nulls_filled")) for i, c in enumerate(num)])).alias("s")).select("s.*")


def mode_values(df: DataFrame, cat: list[str]) -> DataFrame:
    """Most frequent value per categorical feature (ties: smallest value) and
    the number of nulls it fills."""
    from ebbtide.operators.profile import categorical_profile
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in cat])
    null_rows = nulls.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls_filled")) for c in cat])).alias("s")).select("s.*")
    return (categorical_profile(df, cat).join(null_rows, "column")
            .select(F.col("column").alias("feature"), F.col("top").alias("mode"), "nulls_filled"))


def _stages(train: DataFrame, num: list[str], cat: list[str]) -> list:
    # exact medians: one small row of numbers, baked into the stage
    row = train.sparkSession.range(1).select(
        quantile_struct(train, [safe_numeric(F.col(c)) for c in num], [0.5]).alias("q")).first().q if num else []
    fill = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(nanvl(try_cast(`{c}` AS double), NULL), {float(row[i] or 0.0)!r}D) AS `_n_{c}`"
        for i, c in enumerate(num)) + " FROM __THIS__")
    stages = [fill, VectorAssembler(inputCols=[f"_n_{c}" for c in num], outputCol="_num_vec", handleInvalid="keep"),
              StandardScaler(inputCol="_num_vec", outputCol="_num_scaled", withMean=True, withStd=True)]
    feats = ["_num_scaled"]
    if cat:
        # mode fill: the modes are one small aggregate row, baked into the stage
        modes = {row["feature"]: row["mode"] for row in mode_values(train, cat).collect()}
        fill = SQLTransformer(statement="SELECT *, " + ", ".join(
            f"coalesce(CAST(`{c}` AS string), {_sql_str(modes.get(c))}) AS `_c_{c}`" for c in cat)
            + " FROM __THIS__")
        idx = StringIndexer(inputCols=[f"_c_{c}" for c in cat], outputCols=[f"_x_{c}" for c in cat],
                            handleInvalid="keep", stringOrderType="alphabetAsc")
        # dropLast drops the extra "unseen" slot: unknown categories encode as all zeros
        ohe = OneHotEncoder(inputCols=[f"_x_{c}" for c in cat], outputCols=[f"_o_{c}" for c in cat],
                            dropLast=True, handleInvalid="keep")
        stages += [fill, idx, ohe]
        feats += [f"_o_{c}" for c in cat]
    stages.append(VectorAssembler(inputCols=feats, outputCol="features"))
    return stages


def _sql_str(v) -> str:
    return "CAST(NULL AS string)" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---------------------------------------------------------------------------
# Train, evaluate, select, importances
# ---------------------------------------------------------------------------
def _classifiers(n_train: int, include_gbt: bool) -> list[tuple[str, object]]:
    out = [
        # sklearn's C=1 L2 penalty on a summed loss == regParam 1/n on Spark's mean loss
        ("LogisticRegression", LogisticRegression(featuresCol="features", labelCol="label", weightCol="w",
                                                  maxIter=LR_MAX_ITER, regParam=1.0 / max(n_train, 1),
                                                  elasticNetParam=0.0)),
        ("RandomForest", RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w",
                                                numTrees=RF_TREES, maxDepth=RF_DEPTH, seed=SEED)),
    ]
    if include_gbt:
        out.append(("GradientBoosting", GBTClassifier(featuresCol="features", labelCol="label", weightCol="w",
                                                      maxIter=GBT_ITER, seed=SEED)))
    return out


def prepared(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    y = target_column(df)
    num, cat = select_features(df)
    cid = find_col(df, DROP_COLS)
    keep = ([cid] if cid else []) + num + cat
    base = df.select(*keep, safe_numeric(F.col(y)).alias("label")).filter(F.col("label").isNotNull())
    return with_split(base, label=F.col("label")), num, cat


class TrainedModels:
    """Fitted pipelines, test-set metrics and the selected model."""

    def __init__(self, df: DataFrame, include_gbt: bool = True, checkpoint: bool = True):
        data, self.num, self.cat = prepared(df)
        spark = df.sparkSession
        if checkpoint:
            from ebbtide.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(spark)
            # cut the lineage of the feature table once; every model reads it
            data = data.checkpoint(eager=True)
        if data.count() <= trees.LOCAL_ROWS:
            # Spark's forest draws by partition and order: rows by class, as far as a task may hold them
            data = data.repartition("label").sortWithinPartitions("label")
        self.train = _weighted(data.filter(~F.col("is_test")), "label")
        self.test = data.filter(F.col("is_test"))
        n_train = self.train.agg(F.count(F.lit(1))).first()[0]
        self.models: dict[str, PipelineModel] = {}
        # the preprocessing is fitted once, and its features are written once for all models
        pre = Pipeline(stages=_stages(self.train, self.num, self.cat)).fit(self.train)
        features = pre.transform(self.train).select("features", "label", "w")
        features = features.checkpoint(eager=True) if checkpoint else features
        for name, clf in _classifiers(n_train, include_gbt):
            self.models[name] = PipelineModel(stages=[*pre.stages, clf.fit(features)])
        rows = [self._metrics(i, name, m) for i, (name, m) in enumerate(self.models.items())]
        self.metrics = rows[0]
        for x in rows[1:]:
            self.metrics = self.metrics.unionByName(x)
        best = self.metrics.agg(F.max_by("model_name", F.struct("roc_auc", (-F.col("ord")).alias("o")))).first()[0]
        self.best_name = best
        self.best = self.models[best]
        self.spark = spark

    def _metrics(self, ordinal: int, name: str, model: PipelineModel) -> DataFrame:
        pred = model.transform(self.test).select(
            "label", vector_to_array("probability")[1].alias("p"), F.col("prediction"))
        return classification_metrics(pred, "p", "label", "prediction").select(
            F.lit(ordinal).alias("ord"), F.lit(name).alias("model_name"), "*")

    def importances(self) -> DataFrame:
        """Top-30 features of the selected model (tree importances or |coef|), 6 dp."""
        clf = self.best.stages[-1]
        vec = self.best.transform(self.test.limit(1)).schema["features"]
        attrs = vec.metadata.get("ml_attr", {}).get("attrs", {})
        names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
        values = (clf.featureImportances.toArray() if hasattr(clf, "featureImportances")
                  else abs(clf.coefficients.toArray()))
        rows = [(_display_name(names.get(i, f"f{i}"), self.num), float(v)) for i, v in enumerate(values)]
        imp = self.spark.createDataFrame(rows, "feature string, importance double")  # one row per feature
        return (imp.orderBy(F.desc("importance"), F.asc("feature")).limit(TOP_IMPORTANCES)
                .select("feature", r(F.col("importance"), 6).alias("importance")))

    def save_version(self, store: ArtifactStore) -> int:
        """The selected model, all metrics and the importances as one committed version."""
        return store.write(tables={"metrics": self.metrics, "importances": self.importances()}, texts={"best": self.best_name},
                           models={"model": self.best})

    def save(self, path: str) -> str:
        self.best.write().overwrite().save(path)
        self.metrics.write.mode("overwrite").json(os.path.join(path, "_metrics"))
        return path


def _display_name(n: str, num: list[str]) -> str:
    """Readable feature name: scaled numeric slots map back to their column
    (by position), one-hot slots read ``<column>_<value>``."""
    if n.startswith("_num_scaled_") and n[len("_num_scaled_"):].isdigit():
        k = int(n[len("_num_scaled_"):])
        return num[k] if k < len(num) else n
    return n.removeprefix("_o_").removeprefix("_c_")


def classification_metrics(pred: DataFrame, score: str, label: str, prediction: str | None = None,
                           cut: float = PRED_CUT) -> DataFrame:
    """accuracy, precision, recall, F1 (positive class; 0 when undefined) and
    ROC-AUC, rounded to 4 dp. One aggregation + the AUC job."""
    y = F.col(label).cast("double") == F.lit(1.0)
    yhat = (F.col(prediction) == F.lit(1.0)) if prediction else (F.col(score) >= F.lit(cut))
    tp, fp = F.count(F.when(y & yhat, 1)), F.count(F.when(~y & yhat, 1))
    fn, tn = F.count(F.when(y & ~yhat, 1)), F.count(F.when(~y & ~yhat, 1))
    m = pred.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    c = F.col
    prec = F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).otherwise(F.lit(0.0))
    rec = F.when(c("tp") + c("fn") > 0, c("tp") / (c("tp") + c("fn"))).otherwise(F.lit(0.0))
    f1 = F.when(c("tp") > 0, F.lit(2.0) * c("tp") / (F.lit(2.0) * c("tp") + c("fp") + c("fn"))).otherwise(F.lit(0.0))
    auc = roc_auc(pred, score, label).scalar()
    return m.select(r((c("tp") + c("tn")) / (c("tp") + c("tn") + c("fp") + c("fn")), 4).alias("accuracy"),
                    r(prec, 4).alias("precision"), r(rec, 4).alias("recall"), r(f1, 4).alias("f1_score"),
                    r(auc, 4).alias("roc_auc"))


def roc_auc(pred: DataFrame, score: str, label: str) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney with tied scores counted half).

    Rows are reduced to (score, positives, negatives) per distinct score first (map-
    side combined), so each score's negatives below are a running total over ranges of
    distinct scores (``functions.ranking``) and no task orders them all. Products are
    doubles, which cannot overflow.
    """
    y = F.col(label).cast("double") == F.lit(1.0)
    per = (pred.filter(y.isNotNull()).select(F.col(score).cast("double").alias("s"), y.alias("y"))
           .groupBy("s").agg(F.count(F.when(F.col("y"), 1)).alias("pos"), F.count(F.when(~F.col("y"), 1)).alias("neg")))
    cum = with_totals_before(per, [F.col("s")], {"below": F.col("neg")}).select(
        *[F.col(c).cast("double").alias(c) for c in ("pos", "neg", "below")])
    return cum.agg(F.try_divide(F.sum(F.col("pos") * F.col("below") + F.col("pos") * F.col("neg") * F.lit(0.5)),
                                F.sum("pos") * F.sum("neg")).alias("auc"))


# ---------------------------------------------------------------------------
# scoring
# ---------------------------------------------------------------------------
def score_customers(model: PipelineModel, df: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """probability (4 dp), prediction (p >= .5), risk label, and the model's
    global top-5 risk factors (a literal array: fixed size) on every row."""
    cid = find_col(df, DROP_COLS)
    out = model.transform(df).select(
        F.col(cid).alias("customer_id"), r(vector_to_array("probability")[1], 4).alias("churn_probability"))
    out = out.select("customer_id", "churn_probability",
                     (F.col("churn_probability") >= F.lit(PRED_CUT)).alias("churn_prediction"),
                     risk_label(F.col("churn_probability")).alias("risk_label"))
    if factors is not None:
        top = [(row["feature"], row["importance"]) for row in factors.limit(TOP_FACTORS).collect()]  # <= 5 rows
        lit = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance"),
                                 F.lit("increases_risk").alias("direction")) for f, v in top])
        out = out.withColumn("top_risk_factors", lit)
    return out


# ---------------------------------------------------------------------------
# L8-L9 on histogram trees: boosted rounds and a forest of full depth
# ---------------------------------------------------------------------------
class TreeTraining:
    """The split, the preprocessing and the features (id, label, is_test, features) that
    tree models are trained on; written once."""

    def __init__(self, df: DataFrame):
        data, self.num, self.cat = prepared(df)
        self.id = find_col(df, DROP_COLS)
        data = data.checkpoint(eager=True)
        train = data.filter(~F.col("is_test"))
        self.pre = Pipeline(stages=_stages(train, self.num, self.cat)).fit(train)
        self.rows = trees.with_features(self.pre.transform(data), F.col(self.id).alias("id"), "label", "is_test").checkpoint(eager=True)
        self.train, self.test = self.rows.filter(~F.col("is_test")), self.rows.filter("is_test")

    def boosted(self, rounds: int = GBT_ITER, **kw) -> trees.TreeModel:
        """Second-order boosting, positives scaled by negatives / positives."""
        return trees.boosted(self.train, "id", rounds=rounds, **kw)

    def forest(self, n: int = RF_TREES, **kw) -> trees.TreeModel:
        """Balanced bootstrap trees, grown until their leaves are pure."""
        return trees.forest(self.train, "id", trees=n, seed=SEED, **kw)

    def scored(self, model: trees.TreeModel) -> DataFrame:
        """(id, label, is_test, probability) of every labelled row."""
        return model.transform(self.rows, "id", "label", "is_test")

    def metrics(self, model: trees.TreeModel, name: str) -> DataFrame:
        s = model.transform(self.test, "id", "label").withColumn("prediction", (F.col("probability") >= F.lit(PRED_CUT)).cast("double"))
        return classification_metrics(s, "probability", "label", "prediction").select(F.lit(name).alias("model_name"), "*")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
