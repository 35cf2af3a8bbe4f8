"""Oracle SQL (DuckDB dialect) for sources and sinks."""

from ebbtide.checks.oracle_ops import ENRICHED_COLS, PRIO_CTES, top_ctes
from ebbtide.checks.sqlbase import with_enriched
from ebbtide.sources.io import NONBLANK_RE, SNIFF_MAX_SPREAD, SNIFF_SEPARATORS

SQL = {}

for _key in ("csv_scan", "json_roundtrip", "parquet_roundtrip"):
    SQL[_key] = with_enriched() + f"SELECT {ENRICHED_COLS} FROM enriched"

SQL["sample_rows"] = with_enriched() + f"SELECT {ENRICHED_COLS} FROM enriched ORDER BY customer_id LIMIT 10"

SQL["export_action_list"] = with_enriched(*PRIO_CTES, *top_ctes(500)) + \
    "SELECT customer_id, priority_class, estimated_clv, churn_risk_score FROM plx"

_SEP_SQL = {",": "','", "\t": "chr(9)", "|": "'|'"}
_stats = ", ".join(
    f"list_min(list_transform(lines, lambda x: len(string_split(x, {_SEP_SQL[s]})))) AS lo{i}, "
    f"list_max(list_transform(lines, lambda x: len(string_split(x, {_SEP_SQL[s]})))) AS hi{i}"
    for i, s in enumerate(SNIFF_SEPARATORS))
_pick = "CASE " + " ".join(
    f"WHEN nonblank_lines > 0 AND lo{i} > 1 AND hi{i} - lo{i} <= {SNIFF_MAX_SPREAD} THEN {_SEP_SQL[s]}"
    for i, s in enumerate(SNIFF_SEPARATORS)) + " END"
SQL["sniff_delimiter"] = f"""WITH l AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NONBLANK_RE}')) AS lines
  FROM documents),
s AS (SELECT doc_id, CAST(len(lines) AS INTEGER) AS nonblank_lines, {_stats} FROM l)
SELECT doc_id, nonblank_lines, {_pick} AS separator FROM s"""

SQL["text_preview"] = r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS text_chars,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS text_lines,
  CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS text_words,
  substr(text, 1, 8000) AS preview, length(text) > 8000 AS truncated
FROM documents"""

# --- sniffed texts as tables --------------------------------------------------
# The cells of the derived texts come from the orders themselves, not from the texts.
_ROWS = """o AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
    CASE o_custkey % 3 WHEN 0 THEN ',' WHEN 1 THEN chr(9) ELSE '|' END AS sep,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL),
cells AS (
  SELECT doc_id, 0 AS record, unnest(range(5)) AS field, unnest(['order key', 'status', 'price', 'even', 'remark']) AS value FROM o WHERE k = 1
  UNION ALL SELECT doc_id, k, unnest(range(5)), unnest([CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 4 <> 1 THEN o_orderstatus END,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END,
    'said "' || o_orderpriority || '"' || CASE WHEN o_orderkey % 2 = 0 THEN sep ELSE '' END || ' twice']) FROM o
  UNION ALL SELECT doc_id, n + 1, unnest(range(4)), unnest(['-1', 'X', '0', 'true']) FROM o WHERE k = 1)"""
SQL["delimited_cells"] = f"WITH {_ROWS} SELECT doc_id, CAST(record AS INTEGER) AS record, CAST(field AS INTEGER) AS field, value FROM cells"
SQL["delimited_types"] = f"""WITH {_ROWS}
SELECT doc_id, CAST(field AS INTEGER) AS field, max(value) FILTER (record = 0) AS name,
  ['bigint', 'string', 'bigint', 'boolean', 'string'][field + 1] AS type,
  count(value) FILTER (record > 0) AS n_values, count(*) FILTER (record > 0 AND value IS NULL) AS n_empty
FROM cells GROUP BY doc_id, field"""

_F = {s: rf'(?:"[^"]*(?:""[^"]*)*"[^{s}\n]*|[^{s}\n]*)' for s in SNIFF_SEPARATORS}
_R = {s: rf"(?:{f}[{s}])*{f}\n" for s, f in _F.items()}
_case = lambda x, pats, end: "CASE separator " + " ".join(
    f"WHEN {_SEP_SQL[s]} THEN regexp_extract_all({x}, '{p}{end(s)}')" for s, p in pats.items()) + " END"
SQL["delimited_documents"] = f"""WITH sniffed AS ({SQL['sniff_delimiter']}),
t AS (SELECT doc_id, separator, replace(text, chr(13) || chr(10), chr(10)) || CASE WHEN text LIKE '%' || chr(10) THEN '' ELSE chr(10) END AS text
  FROM documents JOIN sniffed USING (doc_id) WHERE separator IS NOT NULL),
r AS (SELECT doc_id, separator, list_filter({_case('text', _R, lambda s: '')}, lambda x: regexp_matches(x, '[^ \\t\\r\\f\\x0B\\n]')) AS lines FROM t),
l AS (SELECT doc_id, separator, unnest(range(len(lines))) AS record, unnest(lines) AS line FROM r),
f AS (SELECT doc_id, record, {_case('line', _F, lambda s: f'[{s}' + chr(92) + 'n]')} AS tokens FROM l),
c AS (SELECT doc_id, record, unnest(range(len(tokens))) AS field, unnest(tokens) AS token FROM f),
b AS (SELECT doc_id, record, field, token[:length(token) - 1] AS body FROM c)
SELECT doc_id, CAST(record AS INTEGER) AS record, CAST(field AS INTEGER) AS field,
  nullif(CASE WHEN regexp_matches(body, '^"[^"]*(?:""[^"]*)*"') THEN replace(regexp_extract(body, '(?s)^"([^"]*(?:""[^"]*)*)"(.*)$', 1), '""', '"')
    || regexp_extract(body, '(?s)^"([^"]*(?:""[^"]*)*)"(.*)$', 2) ELSE body END, '') AS value FROM b"""

SQL["text_table"] = "SELECT CAST(o_orderkey AS INTEGER) AS order_key, o_orderstatus, o_totalprice, o_orderpriority FROM orders"

SQL["append_chunks"] = with_enriched() + """
SELECT customer_id, CAST(floor(estimated_clv) AS DOUBLE) AS clv, region, NULL::VARCHAR AS tenuremonths FROM enriched WHERE customer_id % 3 = 0
UNION ALL SELECT customer_id, estimated_clv, NULL, CAST(tenuremonths AS VARCHAR) FROM enriched WHERE customer_id % 3 = 1
UNION ALL SELECT customer_id, estimated_clv, state, CAST(tenuremonths AS VARCHAR) || ' months' FROM enriched WHERE customer_id % 3 = 2"""

from ebbtide.checks.oracle_kpis import SQL as _KPIS  # noqa: E402

SQL["artifact_versions"] = _KPIS["churn_by_segment"]
