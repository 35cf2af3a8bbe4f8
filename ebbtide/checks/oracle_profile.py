"""Oracle SQL (DuckDB dialect) for profiling and domain tagging."""

from ebbtide.checks.oracle_ops import ENRICHED_COLS
from ebbtide.checks.sqlbase import R, with_enriched
from ebbtide.operators.profile import DOMAIN_META, DOMAIN_RULES, GENERAL_DOMAIN

SQL = {}

CUST_COLS = [c.strip() for c in ENRICHED_COLS.split(",")]
CAT_COLS = ["region", "state", "customer_segment", "plantype", "contract_type"]
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
EVENT_NUM = ["event_id", "user_id", "value"]

_DTYPE = ("CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
          "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' "
          "WHEN 'FLOAT' THEN 'float' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp' "
          "ELSE lower(any_value(typeof({c}))) END")


def _catalog(src: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", {_DTYPE.format(c=c)} AS dtype,
  count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  {R(f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / CAST(greatest(count(*), 1) AS DOUBLE) * 100.0::DOUBLE", 2)} AS null_pct,
  count(DISTINCT {c}) AS unique_count FROM {src}""" for c in cols)


CATALOG_CTE = f"catalog AS ({_catalog('enriched', CUST_COLS)})"
SQL["column_catalog"] = with_enriched(CATALOG_CTE) + "SELECT * FROM catalog"
SQL["missing_report"] = with_enriched(CATALOG_CTE) + "SELECT * FROM catalog WHERE null_count > 0"
SQL["top_missing"] = with_enriched(CATALOG_CTE) + \
    'SELECT "column", null_pct AS missing_pct FROM catalog WHERE null_count > 0 ORDER BY null_pct DESC, "column" LIMIT 5'

EVENT_COLS = "event_id, ts, user_id, event_type, value, props"


def _dups(src: str, cols: str) -> str:
    return f"""SELECT coalesce(sum(c), 0) AS total_rows, coalesce(sum(c - 1), 0) AS duplicate_rows,
  {R("CAST(coalesce(sum(c - 1), 0) AS DOUBLE) / CAST(greatest(coalesce(sum(c), 0), 1) AS DOUBLE) * 100.0::DOUBLE", 2)} AS duplicate_pct
FROM (SELECT count(*) AS c FROM {src} GROUP BY {cols})"""


SQL["duplicate_rows"] = (
    "SELECT CAST(total_rows AS BIGINT) AS total_rows, CAST(duplicate_rows AS BIGINT) AS duplicate_rows, duplicate_pct "
    f"FROM ({_dups('events', EVENT_COLS)})")

SQL["numeric_profile"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, {R(f"avg(CAST({c} AS DOUBLE))", 4)} AS mean,
  {R(f"stddev_samp(CAST({c} AS DOUBLE))", 4)} AS std, min(CAST({c} AS DOUBLE)) AS min,
  {R(f"quantile_cont(CAST({c} AS DOUBLE), 0.25)", 6)} AS p25, {R(f"quantile_cont(CAST({c} AS DOUBLE), 0.5)", 6)} AS p50,
  {R(f"quantile_cont(CAST({c} AS DOUBLE), 0.75)", 6)} AS p75, max(CAST({c} AS DOUBLE)) AS max FROM lineitem"""
    for c in LINEITEM_NUM)

SQL["categorical_profile"] = with_enriched() + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count(*) AS "unique",
  arg_min(v, struct_pack(nf := -f, v := v)) AS top, CAST(max(f) AS BIGINT) AS top_freq
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS f FROM enriched WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in CAT_COLS)


def _fences(src: str, cols: list[str]) -> str:
    qs = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{i}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{i}"
        for i, c in enumerate(cols))
    return f"q AS (SELECT {qs}, count(*) AS n FROM {src})"


def _outliers(src: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        lo = f"(q.q1_{i} - 3.0::DOUBLE * (q.q3_{i} - q.q1_{i}))"
        hi = f"(q.q3_{i} + 3.0::DOUBLE * (q.q3_{i} - q.q1_{i}))"
        parts.append(f"""SELECT {i} AS ordinal, '{c}' AS "column", {R(f'any_value({lo})', 6)} AS lower_fence,
  {R(f'any_value({hi})', 6)} AS upper_fence,
  count(*) FILTER (WHERE CAST({c} AS DOUBLE) < {lo} OR CAST({c} AS DOUBLE) > {hi}) AS n_outliers,
  count(*) FILTER (WHERE CAST({c} AS DOUBLE) < {lo} OR CAST({c} AS DOUBLE) > {hi})
    > greatest(5.0::DOUBLE, any_value(q.n) * 0.01::DOUBLE) AS flagged
FROM {src}, q""")
    return "\nUNION ALL\n".join(parts)


SQL["iqr_outliers"] = "WITH " + _fences("events", EVENT_NUM) + "\n" + _outliers("events", EVENT_NUM)

# quality issues over documents left-joined to their labels (labels cover only some documents)
QI_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
QI_SRC = ("qi AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
          "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
QI_NUM = ["doc_id", "n_chars", "quality", "toxic"]
def quality_sql(src_cte: str, src: str, cols: list[str], num: list[str]) -> str:
    """CTEs ending in ``issues`` (seq, issue_type, column, count, pct) over ``src``."""
    pos = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cols))
    return (src_cte + ",\n" if src_cte else "") + f"cat_{src} AS ({_catalog(src, cols)}),\n" + \
        f"dup_{src} AS ({_dups(src, ', '.join(cols))}),\n" + _fences(src, num) + ",\n" + \
        f"outl AS ({_outliers(src, num)}),\n" + f"""
miss AS (SELECT 0 AS grp, CASE "column" {pos} END AS pos,
  'high_missing' AS issue_type, "column", null_count AS count, {R('null_pct', 1)} AS pct FROM cat_{src} WHERE null_pct > 20),
dupi AS (SELECT 1 AS grp, 0 AS pos, 'duplicates' AS issue_type, CAST(NULL AS VARCHAR) AS "column",
  CAST(duplicate_rows AS BIGINT) AS count, {R('duplicate_pct', 1)} AS pct FROM dup_{src} WHERE duplicate_rows > 0),
head AS (SELECT * FROM miss UNION ALL SELECT * FROM dupi),
o AS (SELECT 2 AS grp, ordinal AS pos, 'outliers' AS issue_type, "column", n_outliers AS count, CAST(NULL AS DOUBLE) AS pct
      FROM outl WHERE flagged),
allx AS (SELECT * FROM head UNION ALL SELECT * FROM o),
issues AS (SELECT CAST(row_number() OVER (ORDER BY grp, pos) AS INTEGER) AS seq, issue_type, "column", count, pct FROM allx)"""


SQL["quality_issues"] = "WITH " + quality_sql(QI_SRC, "qi", QI_COLS, QI_NUM) + "\nSELECT * FROM issues"

_CUST_DUPS = _dups("enriched", ", ".join(CUST_COLS))
SQL["data_quality_rating"] = with_enriched(CATALOG_CTE, f"dup AS ({_CUST_DUPS})") + """
SELECT CAST(d.total_rows AS BIGINT) AS total_rows, h.high_null_columns, CAST(d.duplicate_rows AS BIGINT) AS duplicate_rows,
  CASE WHEN h.high_null_columns = 0 AND d.duplicate_rows = 0 THEN 'Good'
       WHEN h.high_null_columns <= 2 THEN 'Fair' ELSE 'Poor' END AS rating
FROM (SELECT count(*) FILTER (WHERE null_pct > 10) AS high_null_columns FROM catalog) h, dup d"""

SQL["dataset_profile_summary"] = with_enriched(CATALOG_CTE, f"dup AS ({_CUST_DUPS})") + f"""
SELECT CAST(d.total_rows AS BIGINT) AS total_rows, {len(CUST_COLS)} AS total_columns,
  (SELECT count(*) FROM catalog WHERE dtype IN ('bigint', 'int', 'double', 'float', 'smallint', 'tinyint')) AS numeric_columns,
  (SELECT count(*) FROM catalog WHERE dtype IN ('string', 'boolean')) AS categorical_columns,
  CAST(d.duplicate_rows AS BIGINT) AS duplicate_rows,
  (SELECT count(*) FROM catalog WHERE null_count > 0) AS columns_with_missing
FROM dup d"""


def domain_sql(text: str) -> tuple[str, str]:
    """(domain expression, best-score expression) over a text expression."""
    low = f"lower({text})"
    scores = ["(" + " + ".join(f"CAST(coalesce(contains({low}, '{k}'), false) AS INTEGER)" for k in kws) + ")"
              for _, kws in DOMAIN_RULES]
    best = f"greatest({', '.join(scores)})"
    case = f"CASE WHEN {best} <= 0 THEN '{GENERAL_DOMAIN}' " + \
        " ".join(f"WHEN {s} = {best} THEN '{name}'" for (name, _), s in zip(DOMAIN_RULES, scores)) + " END"
    return case, best


_DOM, _BEST = domain_sql("text")
SQL["domain_tag_documents"] = f"SELECT doc_id, {_DOM} AS domain, {_BEST} AS score FROM documents"

_META = " UNION ALL ".join(
    "SELECT '{}' AS domain, '{}' AS use_cases, '{}' AS key_metrics, '{}' AS analysis".format(
        d, "; ".join(u), "; ".join(m), "; ".join(a)) for d, (u, m, a) in DOMAIN_META.items())
SQL["domain_metadata_join"] = f"""WITH tagged AS (SELECT {_DOM} AS domain FROM documents),
meta AS ({_META})
SELECT c.domain, c.documents, m.use_cases, m.key_metrics, m.analysis
FROM (SELECT domain, count(*) AS documents FROM tagged GROUP BY domain) c LEFT JOIN meta m ON c.domain = m.domain"""

CUST_NUM = ["customer_id", "tenuremonths", "monthlycharges", "paymentdelaydays", "supporttickets",
            "payment_failures_12m", "churned", "estimated_clv", "churn_risk_score", "satisfaction_score",
            "upsell_probability", "retention_offer_cost", "complaints_90d"]


def source_context_sql(dataset: str) -> str:
    names = (" ".join(CUST_COLS) + " " + dataset).lower()
    dom, _ = domain_sql(f"'{names}'")
    meta = " ".join(f"WHEN '{d}' THEN '{'; '.join(u)}'" for d, (u, _m, _a) in DOMAIN_META.items())
    return with_enriched(quality_sql("", "enriched", CUST_COLS, CUST_NUM)) + f"""
SELECT '{dataset}' AS dataset, (SELECT count(*) FROM enriched) AS total_rows, {len(CUST_COLS)} AS total_columns,
  {dom} AS detected_domain, (SELECT count(*) FROM issues) AS issue_count,
  CASE {dom} {meta} END AS use_cases"""


SQL["source_context"] = source_context_sql("customers")


def _long(src: str, section: str, name: str, values: list[str], label: str = "CAST(NULL AS VARCHAR)") -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{section}' AS section, {name} || '.{v}' AS item, CAST("{v}" AS DOUBLE) AS value, {label} AS label FROM ({src})"""
        for v in values)


_SUMMARY_COLS = ["total_rows", "total_columns", "numeric_columns", "categorical_columns", "duplicate_rows", "columns_with_missing"]
PROFILE_NUM = CUST_NUM  # the whole numeric section


def _numeric(src: str, c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", count({c}) AS count, {R(f"avg({x})", 4)} AS mean, {R(f"stddev_samp({x})", 4)} AS std,
  min({x}) AS min, {R(f"quantile_cont({x}, 0.25)", 6)} AS p25, {R(f"quantile_cont({x}, 0.5)", 6)} AS p50,
  {R(f"quantile_cont({x}, 0.75)", 6)} AS p75, max({x}) AS max FROM {src}"""


def profile_report_sql() -> str:
    summary = SQL["dataset_profile_summary"]
    top = SQL["top_missing"]
    cat = SQL["categorical_profile"]
    num = with_enriched() + "\nUNION ALL\n".join(_numeric("enriched", c) for c in PROFILE_NUM)
    label = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in CAT_COLS)
    sample = with_enriched() + (f"SELECT 'sample' AS section, CAST(customer_id AS VARCHAR) AS item, CAST(NULL AS DOUBLE) AS value, "
                                f"{label} AS label FROM enriched ORDER BY customer_id LIMIT 5")
    return "\nUNION ALL\n".join([
        _long(summary, "summary", "'table'", _SUMMARY_COLS),
        _long(num, "numeric", '"column"', ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]),
        _long(cat, "categorical", '"column"', ["unique", "top_freq"], "top"),
        _long(top, "missing", '"column"', ["missing_pct"]),
        f"SELECT * FROM ({sample})"])


SQL["profile_report"] = profile_report_sql()


def source_insights_sql(dataset: str) -> str:
    metrics, analyses = {}, {}
    for d, (_u, m, a) in DOMAIN_META.items():
        metrics[d], analyses[d] = "; ".join(m), "; ".join(a)
    names = (" ".join(CUST_COLS) + " " + dataset).lower()
    scores = [(d, sum(k in names for k in kws)) for d, kws in DOMAIN_RULES]
    best = max(x for _, x in scores)
    dom = next((d for d, x in scores if x == best), GENERAL_DOMAIN) if best > 0 else GENERAL_DOMAIN
    return with_enriched(quality_sql("", "enriched", CUST_COLS, CUST_NUM)) + f"""
SELECT '{dataset}' AS dataset, issues.*, '{dom}' AS detected_domain, '{metrics[dom]}' AS key_metrics,
  '{analyses[dom]}' AS recommended_analyses FROM issues"""


SQL["source_insights"] = source_insights_sql("customers")
