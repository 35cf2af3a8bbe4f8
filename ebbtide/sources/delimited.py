"""Sniffed text as a table (A4): whole texts into cells, with a type for each field.

A text's separator is sniffed, then the text is split into records and fields by quote-
aware patterns: a field that begins with a quote runs to its closing quote, separators
and line ends inside it are text and a doubled quote is one; elsewhere a quote is an
ordinary character, also one that is never closed. The patterns are possessive, so each
text is read once, left to right, whatever its length, and all of it runs in the JVM.

The result is long, one row for each cell: nothing depends on the number of columns of
the widest text. Records count from 0, the header; blank lines are no records. Fields
beyond the header have no name, missing ones no cell. An empty cell has a null value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.sources.io import NONBLANK_RE, SNIFF_MAX_SPREAD, SNIFF_SEPARATORS, read_delimited_text, sniff_delimiter

# Types of a field, the first that all of its values match.
FIELD_TYPES = [("bigint", r"^[+-]?[0-9]{1,18}$"), ("double", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
               ("boolean", r"^(true|false|True|False|TRUE|FALSE)$")]
EMPTY_TYPE, OTHER_TYPE = "double", "string"


def _field(sep: str) -> str:
    other = rf"[^{sep}\n]*+"
    return rf'(?:"[^"]*+(?:""[^"]*+)*+"{other}|{other})'


def _record(sep: str) -> str:
    return rf"(?:{_field(sep)}[{sep}])*+{_field(sep)}\n"


def _by_separator(sep: Column, expr) -> Column:
    """``expr(separator)`` for the row's separator."""
    out = None
    for s in SNIFF_SEPARATORS:
        out = F.when(sep == s, expr(s)) if out is None else out.when(sep == s, expr(s))
    return out


def records(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, separator, record, line) of texts (id, text, separator); those without a
    separator have none. A record ends with a line end that is not quoted."""
    t = F.regexp_replace("text", "\r\n", "\n")
    t = F.when(t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n")))
    found = _by_separator(F.col("separator"), lambda s: F.regexp_extract_all("_t", F.lit(_record(s)), F.lit(0)))
    lines = texts.where(F.col("separator").isNotNull()).select(id_col, "separator", t.alias("_t")).select(
        id_col, "separator", F.filter(found, lambda x: x.rlike(NONBLANK_RE.replace("]", "\\n]"))).alias("_r"))
    return lines.select(id_col, "separator", F.posexplode("_r").alias("record", "line"))


def cells(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, record, field, value) of each cell of texts (id, text, separator)."""
    found = _by_separator(F.col("separator"), lambda s: F.regexp_extract_all("line", F.lit(f"{_field(s)}[{s}\\n]"), F.lit(0)))
    out = records(texts, id_col).select(id_col, "record", F.posexplode(found).alias("field", "_f"))
    body = F.expr("left(_f, length(_f) - 1)")
    quoted = F.regexp_extract("_b", r'^"([^"]*+(?:""[^"]*+)*+)"([\s\S]*)$', 1)
    after = F.regexp_extract("_b", r'^"([^"]*+(?:""[^"]*+)*+)"([\s\S]*)$', 2)
    is_quoted = F.col("_b").rlike(r'^"[^"]*+(?:""[^"]*+)*+"')
    value = F.when(is_quoted, F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), after)).otherwise(F.col("_b"))
    return out.withColumn("_b", body).select(id_col, "record", "field", F.nullif(value, F.lit("")).alias("value"))


def parse_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The cells of every text that sniffs as a table."""
    return cells(sniffed_texts(docs, text_col, id_col), id_col)


def sniffed_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text, separator) without a join: the sniffing runs in the texts' own projection."""
    return sniff_delimiter(docs, text_col, id_col, keep_text=True).select(id_col, F.col(text_col).alias("text"), "separator")


def field_types(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, field, name, type, n_values, n_empty) of each named field, over all its cells.

    One hash aggregation of the cells by field (combined on the map side)."""
    v, data = F.col("value"), F.col("record") > 0
    fits = [F.coalesce(F.bool_and(F.when(data & v.isNotNull(), v.rlike(pat))), F.lit(True)).alias(f"_{t}") for t, pat in FIELD_TYPES]
    per = table.groupBy(id_col, "field").agg(
        F.max(F.when(~data, v)).alias("name"), F.count(F.when(data & v.isNotNull(), 1)).alias("n_values"),
        F.count(F.when(data & v.isNull(), 1)).alias("n_empty"), *fits)
    kind = F.when(F.col("n_values") == 0, F.lit(EMPTY_TYPE))
    for t, _ in FIELD_TYPES:
        kind = kind.when(F.col(f"_{t}"), F.lit(t))
    return per.where(F.col("name").isNotNull()).select(id_col, "field", "name", kind.otherwise(F.lit(OTHER_TYPE)).alias("type"), "n_values", "n_empty")


# ---------------------------------------------------------------------------
# Files
# ---------------------------------------------------------------------------
def sniff_file(spark: SparkSession, path: str) -> str | None:
    """The separator of a text file or folder of files, by the same rule over all lines;
    one aggregation, whatever the size (lines, not texts, are the rows)."""
    line = spark.read.text(path).where(F.col("value").rlike(NONBLANK_RE))
    aggs = []
    for k, s in enumerate(SNIFF_SEPARATORS):
        n = F.length("value") - F.length(F.replace("value", F.lit(s), F.lit(""))) + 1
        aggs += [F.min(n).alias(f"lo{k}"), F.max(n).alias(f"hi{k}")]
    row = line.agg(*aggs).first()
    return next((s for k, s in enumerate(SNIFF_SEPARATORS)
                 if row[f"lo{k}"] and row[f"lo{k}"] > 1 and row[f"hi{k}"] - row[f"lo{k}"] <= SNIFF_MAX_SPREAD), None)


def read_text_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A text file as the table it holds (names normalised, types inferred without a
    schema); a file that holds none as its lines."""
    sep = sniff_file(spark, path)
    return spark.read.text(path) if sep is None else read_delimited_text(spark, path, sep, schema)
