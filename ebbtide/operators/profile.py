"""Dataset profiling (B3-B14) and domain tagging (B15-B17) for any table.

Every profile is a handful of aggregations over the input: per-column
statistics are computed side by side in one ``agg`` (partial aggregation on
each partition, one small final merge) and turned into one row per column
with ``explode(array(struct ...))``. Column lists come from the schema
(metadata on the driver); no data is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.value_counts import quantiles_of
from ebbtide.functions.scalars import r

# Quality-issue and rating cut-offs.
HIGH_MISSING_PCT = 20.0        # issue when a column is more than this % null
RATING_NULL_PCT = 10.0         # data-quality rating counts columns above this % null
OUTLIER_IQR_K = 3.0            # outside [q1 - k*iqr, q3 + k*iqr]
OUTLIER_MIN_COUNT, OUTLIER_MIN_FRAC = 5, 0.01
THRESHOLD_DP = 6
STAT_DP = 4

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    """String and boolean columns (booleans count as categorical, as in the reference)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def _rows(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def _batches(cols: list[str], size: int) -> list[list[str]]:
    return [cols[i:i + size] for i in range(0, len(cols), size)] or [[]]


# ---------------------------------------------------------------------------
# Column catalogue, missing report, top missing
# ---------------------------------------------------------------------------
def column_catalog(df: DataFrame, exact: bool = True) -> DataFrame:
    """name, dtype, null_count, null_pct (2 dp, denominator max(n,1)), unique_count.

    Distinct values are counted over (column, value) pairs that are combined on each
    partition before the shuffle, so repeated values move once and no ``Expand`` of
    whole rows is planned. ``exact=False`` uses HyperLogLog (one pass, fixed memory).
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dtype = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    if exact:
        pairs = df.select(F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.struct(
            F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))) for i, c in enumerate(df.columns)])).alias("p"))
        uniq = (pairs.filter(F.col("p").isNotNull()).select("p.*").groupBy("i", "v").agg(F.lit(1).alias("one"))
                .groupBy("i").agg(F.count(F.lit(1)).alias("unique_count")))
    else:
        one = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"_u{i}") for i, c in enumerate(df.columns)])
        uniq = _rows(one, [F.struct(F.lit(i).alias("i"), F.col(f"_u{i}").alias("unique_count"))
                           for i in range(len(df.columns))])
    place = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    nulls = null_catalog(df).withColumn("i", place[F.col("column")])
    return nulls.join(uniq, "i", "left").select(
        "column", dtype[F.col("column")].alias("dtype"), "null_count", "null_pct",
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"))


def null_catalog(df: DataFrame) -> DataFrame:
    """column, null_count, null_pct (2 dp, as in ``column_catalog``) — one
    aggregation of plain counts, no distinct counts and so no ``Expand``. For
    callers that only need nulls (issues, rating, summary, top missing)."""
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(f"_z{i}") for i, c in enumerate(df.columns)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"_z{i}").alias("null_count"),
                        r(F.col(f"_z{i}") / F.greatest(F.col("_n"), F.lit(1)) * F.lit(100.0), 2).alias("null_pct"))
               for i, c in enumerate(df.columns)]
    return _rows(one, structs)


def missing_report(df: DataFrame, exact: bool = True) -> DataFrame:
    """The catalogue rows of the columns with nulls; only these are counted."""
    cols = [x.column for x in null_catalog(df).filter(F.col("null_count") > 0).collect()]  # at most one row a column
    out = column_catalog(df.select(*cols), exact) if cols else column_catalog(df, exact=False).limit(0)
    return out


def top_missing(df: DataFrame, k: int = 5) -> DataFrame:
    return (null_catalog(df).filter(F.col("null_count") > 0).select("column", F.col("null_pct").alias("missing_pct"))
            .orderBy(F.desc("missing_pct"), F.asc("column")).limit(k))


# ---------------------------------------------------------------------------
# Duplicate rows (null-safe: grouping treats null = null, as pandas does)
# ---------------------------------------------------------------------------
def _repeated(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests with their counts, one row with the number of rows beyond the first of each
    identical group).

    A 128-bit digest of each row is counted first (map-side combined, 16 bytes a
    row); only rows whose digest repeats are then compared whole, and their partial
    aggregation collapses repeats on each partition, so a hot duplicate group never
    lands on one task.
    """
    digest = [F.xxhash64(*df.columns).alias("_h1"), F.xxhash64(F.lit("second"), *df.columns).alias("_h2")]
    seen = df.select(*digest).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_c"))
    rows = df.select(*df.columns, *digest).join(seen.filter(F.col("_c") > 1).select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
    groups = rows.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return seen, groups.agg(F.coalesce(F.sum(F.col("_c") - F.lit(1)), F.lit(0)).alias("duplicate_rows"))


def _share(part: Column, n: Column) -> Column:
    return r(part / F.greatest(n, F.lit(1)) * F.lit(100.0), 2)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """total_rows, duplicate_rows (= rows beyond the first of each identical group), duplicate_pct."""
    seen, repeats = _repeated(df)
    total = seen.agg(F.coalesce(F.sum("_c"), F.lit(0))).scalar()
    return (repeats.select(total.alias("total_rows"), "duplicate_rows")
            .withColumn("duplicate_pct", _share(F.col("duplicate_rows"), F.col("total_rows"))))


# ---------------------------------------------------------------------------
# Numeric summary (count, mean, sample std, min, 25/50/75 % linear, max)
# ---------------------------------------------------------------------------
def numeric_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column. Quantiles are exact (linear interpolation,
    like pandas ``describe``) at any size (``functions.quantiles``)."""
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, count bigint, mean double, std double, min double, p25 double, "
                "p50 double, p75 double, max double")
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"_c{i}"), F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                 F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    one = df.agg(*aggs).withColumn("_q", quantiles_of(df, cols, [0.25, 0.5, 0.75]))
    qs = [[F.col(f"_q.q{i}_{j}") for j in range(3)] for i in range(len(cols))]
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("count"),
                        r(F.col(f"_m{i}"), STAT_DP).alias("mean"), r(F.col(f"_s{i}"), STAT_DP).alias("std"),
                        F.col(f"_lo{i}").alias("min"),
                        r(qs[i][0], THRESHOLD_DP).alias("p25"),
                        r(qs[i][1], THRESHOLD_DP).alias("p50"),
                        r(qs[i][2], THRESHOLD_DP).alias("p75"),
                        F.col(f"_hi{i}").alias("max"))
               for i, c in enumerate(cols)]
    return _rows(one, structs)


# ---------------------------------------------------------------------------
# Categorical summary (unique, top value, its frequency; ties -> smallest value)
# ---------------------------------------------------------------------------
def categorical_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Unpivot to (column, value), count per value, then pick the mode per column.

    Two aggregations, both with partial aggregation: the first collapses
    repeated values map-side (a value holding a third of the rows is one
    partial row per partition), the second keeps one row per column.
    """
    cols = cols if cols is not None else categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, unique bigint, top string, top_freq bigint")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p"))
    counts = (pairs.select("p.column", "p.value").filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq")))
    per_col = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min_by(F.struct("value", "freq"), F.struct((-F.col("freq")).alias("nf"), F.col("value"))).alias("m"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    # columns that are entirely null still get a row (unique 0, no top value)
    return (F.broadcast(names).join(per_col, "column", "left")
            .select("column", F.coalesce("unique", F.lit(0)).alias("unique"),
                    F.col("m.value").alias("top"), F.coalesce(F.col("m.freq"), F.lit(0)).alias("top_freq")))


# ---------------------------------------------------------------------------
# IQR outliers; B10-B11: quality issues; B13 rating; B14 summary
# ---------------------------------------------------------------------------
def _fence_frame(df: DataFrame, cols: list[str], *more: Column) -> tuple[DataFrame, list[Column], list[tuple[Column, ...]]]:
    """The numeric columns with their quartiles projected once (and ``more``), the
    aggregates for the fences, and for each column (lower, upper, outliers, flagged) over
    the aggregated row, which has the number of rows as ``_n``."""
    x = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
                  *([quantiles_of(df, cols, [0.25, 0.75]).alias("_q")] if cols else []), *more)
    aggs, out = [F.count(F.lit(1)).alias("_n")], []
    cut = F.greatest(F.lit(float(OUTLIER_MIN_COUNT)), F.col("_n") * F.lit(OUTLIER_MIN_FRAC))
    for i in range(len(cols)):
        v, q1, q3 = F.col(f"_x{i}"), F.col(f"_q.q{i}_0"), F.col(f"_q.q{i}_1")
        lo, hi = q1 - F.lit(OUTLIER_IQR_K) * (q3 - q1), q3 + F.lit(OUTLIER_IQR_K) * (q3 - q1)
        aggs += [F.count(F.when((v < lo) | (v > hi), F.lit(1))).alias(f"_o{i}"), F.first(lo).alias(f"_lo{i}"), F.first(hi).alias(f"_hi{i}")]
        out.append((r(F.col(f"_lo{i}"), THRESHOLD_DP), r(F.col(f"_hi{i}"), THRESHOLD_DP), F.col(f"_o{i}"), F.col(f"_o{i}") > cut))
    return x, aggs, out


def iqr_outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column: q1, q3, fences, number of values outside them, and
    whether that number passes the reporting cut ``> max(5, 1 % of rows)``. All quartiles
    are one subquery; one aggregation counts the fence hits of all columns."""
    cols = cols if cols is not None else numeric_columns(df)
    x, aggs, fences = _fence_frame(df, cols)
    return _rows(x.agg(*aggs), [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), lo.alias("lower_fence"), hi.alias("upper_fence"),
                 n.alias("n_outliers"), flag.alias("flagged")) for i, (c, (lo, hi, n, flag)) in enumerate(zip(cols, fences))])


def quality_issues(df: DataFrame) -> DataFrame:
    """Rows (seq, issue_type, column, count, pct) in the reference's order:
    columns with > 20 % nulls, then duplicates, then every flagged outlier column.

    Nulls and outliers are counted in the same aggregation, the quartiles and the number
    of duplicate rows are subqueries of its one row, and the issues come from that row.
    The ordering window runs on the issue rows only (at most two a column).
    """
    num = numeric_columns(df)
    x, aggs, fences = _fence_frame(df, num, *[F.col(c).isNull().alias(f"_b{i}") for i, c in enumerate(df.columns)])
    one = x.agg(*aggs, *[F.count_if(F.col(f"_b{i}")).alias(f"_z{i}") for i in range(len(df.columns))])
    one = one.withColumn("_d", _repeated(df)[1].scalar())

    def issue(cond: Column, grp: int, pos: int, kind: str, column: str | None, count: Column, pct: Column) -> Column:
        return F.when(cond, F.struct(F.lit(grp).alias("grp"), F.lit(pos).alias("pos"), F.lit(kind).alias("issue_type"),
                                     F.lit(column).cast("string").alias("column"), count.cast("bigint").alias("count"),
                                     pct.cast("double").alias("pct")))

    found = []
    for i, c in enumerate(df.columns):
        pct = _share(F.col(f"_z{i}"), F.col("_n"))
        found.append(issue(pct > F.lit(HIGH_MISSING_PCT), 0, i, "high_missing", c, F.col(f"_z{i}"), r(pct, 1)))
    found.append(issue(F.col("_d") > 0, 1, 0, "duplicates", None, F.col("_d"), r(_share(F.col("_d"), F.col("_n")), 1)))
    for i, (c, (_, _, n, flag)) in enumerate(zip(num, fences)):
        found.append(issue(flag, 2, i, "outliers", c, n, F.lit(None)))
    rows = one.select(F.explode(F.array(*found)).alias("i")).where(F.col("i").isNotNull()).select("i.*")
    return rows.select(F.row_number().over(Window.orderBy("grp", "pos")).alias("seq"), "issue_type", "column", "count", "pct")


def data_quality_rating(df: DataFrame) -> DataFrame:
    """Good: no column > 10 % null and no duplicates; Fair: at most two such
    columns; Poor otherwise."""
    hi = null_catalog(df).agg(F.count(F.when(F.col("null_pct") > F.lit(RATING_NULL_PCT), F.lit(1)))).scalar()
    return (duplicate_rows(df).withColumn("high_null_columns", hi)
            .withColumn("rating", F.when((F.col("high_null_columns") == 0) & (F.col("duplicate_rows") == 0),
                                         F.lit("Good"))
                        .when(F.col("high_null_columns") <= 2, F.lit("Fair")).otherwise(F.lit("Poor")))
            .select("total_rows", "high_null_columns", "duplicate_rows", "rating"))


def dataset_profile_summary(df: DataFrame) -> DataFrame:
    """Row and column counts, numeric / categorical split, duplicates and the
    number of columns with any null, as one row."""
    miss = null_catalog(df).agg(F.count(F.when(F.col("null_count") > 0, F.lit(1)))).scalar()
    return (duplicate_rows(df).withColumn("columns_with_missing", miss)
            .select("total_rows", F.lit(len(df.columns)).alias("total_columns"),
                    F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
                    F.lit(len(categorical_columns(df))).cast("bigint").alias("categorical_columns"),
                    "duplicate_rows", "columns_with_missing"))


# ---------------------------------------------------------------------------
# Domain tagging and domain metadata
# ---------------------------------------------------------------------------
# Domains and their keywords, in rule order (ties go to the earlier rule).
DOMAIN_RULES = [
    ("Customer Retention", ["churn", "retention", "tenure", "subscription", "customer_id", "customerid",
                            "monthly_charges", "contract"]),
    ("Revenue Forecasting", ["sales", "revenue", "order", "sku", "product", "invoice", "fiscal", "forecast",
                             "discount"]),
    ("HR Analytics", ["employee", "attrition", "salary", "department", "hr", "headcount", "performance", "hire",
                      "termination"]),
    ("Credit Risk", ["loan", "credit", "default", "borrower", "interest", "delinquent", "repayment", "collateral",
                     "mortgage"]),
    ("Fraud Detection", ["fraud", "transaction", "merchant", "suspicious", "flagged", "card", "account_balance",
                         "anomaly"]),
    ("Supply Chain", ["inventory", "demand", "stock", "warehouse", "supply", "shipment", "sku", "logistics",
                      "reorder"]),
]
GENERAL_DOMAIN = "General Analytics"

# Per-domain use cases, key metrics and recommended analyses.
DOMAIN_META = {
    "Customer Retention": (
        ["Churn prediction", "Retention campaign targeting", "CLV optimisation", "Cohort analysis"],
        ["Churn rate", "Customer Lifetime Value (CLV)", "Monthly Recurring Revenue (MRR)", "Net Revenue Retention",
         "CSAT / NPS"],
        ["Segment churn by plan/region", "Build churn propensity model",
         "Run scenario simulation for retention budget", "Identify high-value at-risk customers"]),
    "Revenue Forecasting": (
        ["Sales trend forecasting", "Product performance analysis", "Discount impact modelling",
         "Revenue attribution"],
        ["Total revenue", "Revenue growth rate", "Average order value", "Conversion rate", "Win rate"],
        ["Time-series decomposition", "Product-level revenue breakdown", "Seasonal demand analysis",
         "Price elasticity study"]),
    "HR Analytics": (
        ["Attrition prediction", "Workforce planning", "Compensation benchmarking",
         "Diversity & inclusion reporting"],
        ["Attrition rate", "Average tenure", "Salary percentile", "Headcount growth", "Time-to-hire"],
        ["Attrition drivers by department", "Salary band analysis", "Performance vs. retention correlation",
         "Flight-risk identification"]),
    "Credit Risk": (
        ["Default probability scoring", "Credit limit optimisation", "Portfolio risk management",
         "Regulatory stress testing"],
        ["Default rate", "Loss Given Default (LGD)", "Probability of Default (PD)", "Debt-to-Income ratio"],
        ["Scorecard modelling", "Vintage analysis", "Segment-level risk profiling", "Delinquency trend tracking"]),
    "Fraud Detection": (
        ["Real-time fraud scoring", "Anomaly detection", "Transaction pattern analysis",
         "False positive reduction"],
        ["Fraud rate", "False positive rate", "Detection precision/recall", "Average fraud amount"],
        ["Merchant-level fraud clustering", "Time-of-day patterns", "Device / channel risk scoring",
         "Network graph analysis"]),
    "Supply Chain": (
        ["Demand forecasting", "Inventory optimisation", "Supplier performance tracking", "Stockout risk modelling"],
        ["Fill rate", "Days of inventory outstanding (DIO)", "Stockout frequency", "Lead time variance"],
        ["SKU-level demand decomposition", "Reorder point optimisation", "Supplier reliability scoring",
         "Safety stock calibration"]),
    "General Analytics": (
        ["Descriptive analysis", "KPI dashboard", "Trend identification", "Data quality baseline"],
        ["Record count", "Coverage %", "Numeric summary stats", "Categorical distribution"],
        ["Column profiling", "Outlier detection", "Correlation matrix", "Missing value imputation strategy"]),
}


def domain_scores(low: Column) -> list[Column]:
    """One score per domain: how many of its keywords occur in the lowered text."""
    return [sum((F.coalesce(F.contains(low, F.lit(k)), F.lit(False))).cast("int") for k in kws)
            for _, kws in DOMAIN_RULES]


def domain_pick(scores: list[Column]) -> Column:
    """Arg-max domain over per-domain score columns (earlier rule wins ties);
    General Analytics when nothing matches."""
    best = F.greatest(*scores)
    e = F.when(best <= 0, F.lit(GENERAL_DOMAIN))
    for (name, _), s in zip(DOMAIN_RULES, scores):
        e = e.when(s == best, F.lit(name))
    return e


def with_domain(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """Adds ``domain`` and ``score`` (hits of the winning domain).

    Three projections: the lowered text, so that all keyword tests share it; the
    keyword scores (each is then referenced
    several times by the arg-max, so Catalyst keeps them in their own
    projection instead of repeating the keyword tests), then the arg-max.
    Pure projections: tagging runs in the scan's codegen stage, no shuffle.
    """
    low = df.select(*keep, F.lower(text).alias("_low"))
    stage = low.select(*keep, *[s.alias(f"_d{i}") for i, s in enumerate(domain_scores(F.col("_low")))])
    cols = [F.col(f"_d{i}") for i in range(len(DOMAIN_RULES))]
    return stage.select(*keep, domain_pick(cols).alias("domain"), F.greatest(*cols).alias("score"))


def domain_tag_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tag every document by its whole text (not a prefix)."""
    return with_domain(docs, F.col(text_col), [id_col])


def domain_tag_columns(catalog: DataFrame) -> DataFrame:
    """Catalogue variant: rows (dataset, column) -> one domain per dataset from
    its space-joined column names (lower-case substring match)."""
    names = catalog.groupBy("dataset").agg(
        F.concat_ws(" ", F.array_sort(F.collect_list(F.lower("column")))).alias("names"))
    return with_domain(names, F.col("names"), ["dataset"]).drop("score")


def domain_metadata(spark) -> DataFrame:
    """The 7-row domain dimension (fixed size)."""
    rows = [(d, "; ".join(u), "; ".join(m), "; ".join(a)) for d, (u, m, a) in DOMAIN_META.items()]
    return spark.createDataFrame(rows, "domain string, use_cases string, key_metrics string, analysis string")


def domain_metadata_join(tagged: DataFrame) -> DataFrame:
    """Per-domain counts joined to the metadata dimension (broadcast: 7 rows)."""
    counts = tagged.groupBy("domain").agg(F.count(F.lit(1)).alias("documents"))
    return counts.join(F.broadcast(domain_metadata(tagged.sparkSession)), "domain", "left")


def profile_report(df: DataFrame, numeric: list[str], categorical: list[str], sample: int = 5,
                   key: str | None = None) -> DataFrame:
    """B14 + A9: the whole profile in one result of (section, item, value, label) rows:
    counts, numeric and categorical summaries, top missing columns, and the first rows
    in key order as text."""
    def long(rows: DataFrame, section: str, name: str, values: list[str], label: str | None = None) -> DataFrame:
        cells = [F.struct(F.lit(section).alias("section"), F.concat_ws(".", F.col(name), F.lit(v)).alias("item"),
                          F.col(v).cast("double").alias("value"),
                          (F.col(label) if label else F.lit(None).cast("string")).alias("label")) for v in values]
        return rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*")

    head = dataset_profile_summary(df)
    parts = [long(head.withColumn("_t", F.lit("table")), "summary", "_t", head.columns),
             long(numeric_profile(df, numeric), "numeric", "column",
                  ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]),
             long(categorical_profile(df, categorical), "categorical", "column", ["unique", "top_freq"], "top"),
             long(top_missing(df), "missing", "column", ["missing_pct"])]
    key = key or df.columns[0]
    first = df.orderBy(F.col(key)).limit(sample)
    parts.append(first.select(F.lit("sample").alias("section"), F.col(key).cast("string").alias("item"),
                              F.lit(None).cast("double").alias("value"),
                              F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical])
                              .alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_insights(df: DataFrame, dataset: str) -> DataFrame:
    """The issue list of a source with the metrics and analyses of its domain, one
    row an issue."""
    spark = df.sparkSession
    names = spark.range(1).select(F.lit((" ".join(df.columns) + " " + dataset).lower()).alias("names"))
    dom = with_domain(names, F.col("names"), []).select("domain")
    meta = dom.join(F.broadcast(domain_metadata(spark)), "domain", "left")  # 7-row dimension
    one = meta.select(F.struct(F.col("domain").alias("d"), F.col("key_metrics").alias("m"), F.col("analysis").alias("a"))).scalar()
    return quality_issues(df).select(F.lit(dataset).alias("dataset"), "seq", "issue_type", "column", "count", "pct", one.alias("_m")).select(
        "dataset", "seq", "issue_type", "column", "count", "pct", F.col("_m.d").alias("detected_domain"),
        F.col("_m.m").alias("key_metrics"), F.col("_m.a").alias("recommended_analyses"))


def source_context(df: DataFrame, dataset: str) -> DataFrame:
    """One row — rows, columns, the domain read from the column names
    (and the dataset name), the number of quality issues and the domain's use
    cases. The names are schema metadata; the counts come from the data."""
    spark = df.sparkSession
    names = spark.range(1).select(F.lit((" ".join(df.columns) + " " + dataset).lower()).alias("names"))
    dom = with_domain(names, F.col("names"), []).select("domain")
    meta = domain_metadata(spark).select("domain", "use_cases")
    issues = quality_issues(df).agg(F.count(F.lit(1)).alias("issue_count"))
    rows = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return (dom.join(F.broadcast(meta), "domain", "left")  # 7-row dimension
            .select(F.lit(dataset).alias("dataset"), F.lit(len(df.columns)).alias("total_columns"),
                    F.col("domain").alias("detected_domain"), "use_cases",
                    rows.scalar().alias("total_rows"), issues.scalar().alias("issue_count"))
            .select("dataset", "total_rows", "total_columns", "detected_domain", "issue_count", "use_cases"))
