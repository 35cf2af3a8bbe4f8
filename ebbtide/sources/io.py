"""Text sources (delimiter sniffing, preview) and file sinks.

Sinks write under the shared folder named by ``spark.checkpoint.dir`` (a
fresh sub-folder per call), never a machine-local temp folder, so every
executor of a cluster can write and read them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import scratch_dir
from ebbtide.sources.tables import load_table

# Separators tried in order, the field-count spread allowed,
# and the preview length.
SNIFF_SEPARATORS = [",", "\t", "|"]
SNIFF_MAX_SPREAD = 2
PREVIEW_CHARS = 8000
# a line is blank when it holds only these characters (regex class, same in Java and RE2)
NONBLANK_RE = r"[^ \t\r\f\x0B]"


def _regex_literal(sep: str) -> str:
    return "\\|" if sep == "|" else sep


def _field_count(sep: str):
    pat = _regex_literal(sep)
    return lambda line: F.size(F.split(line, pat, -1))


def nonblank_lines(text_col: str = "text"):
    """Array of the text's lines (split on ``\\n``) that hold a non-blank character."""
    return F.filter(F.split(F.col(text_col), "\n", -1), lambda line: line.rlike(NONBLANK_RE))


def sniff_delimiter(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Per text: the first separator (, then tab then |) for which every
    non-blank line splits into more than one field and the field counts
    differ by at most two; null when none fits. All lines of the whole text
    are used. Higher-order array functions: one projection, no shuffle. With
    ``keep_text`` the text stays beside its separator."""
    kept = [text_col] if keep_text else []
    lines = docs.select(id_col, *kept, nonblank_lines(text_col).alias("_lines"))
    stats = []
    for i, sep in enumerate(SNIFF_SEPARATORS):
        counts = F.transform("_lines", _field_count(sep))
        stats.append(F.struct(F.array_min(counts).alias("lo"), F.array_max(counts).alias("hi")).alias(f"_s{i}"))
    staged = lines.select(id_col, *kept, F.size("_lines").alias("nonblank_lines"), *stats)
    pick = None
    for i, sep in enumerate(SNIFF_SEPARATORS):
        s = F.col(f"_s{i}")
        ok = (F.col("nonblank_lines") > 0) & (s["lo"] > 1) & (s["hi"] - s["lo"] <= SNIFF_MAX_SPREAD)
        pick = F.when(ok, F.lit(sep)) if pick is None else pick.when(ok, F.lit(sep))
    return staged.select(id_col, *kept, "nonblank_lines", pick.alias("separator"))


def read_delimited_text(spark: SparkSession, path: str, sep: str, schema=None, multiline: bool = False) -> DataFrame:
    """Parse a text file as a table once its separator is known (a quote is escaped by a
    second one). ``multiline`` lets quoted fields hold line ends, at the price of one task
    a file; without it Spark splits large files."""
    return load_table(spark, path, fmt="csv", schema=schema, sep=sep, escape='"', multiLine=multiline)


def text_preview(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 chars: int = PREVIEW_CHARS) -> DataFrame:
    """Display preview: the first ``chars`` characters, with the full text's
    length, line and word counts (computed over the whole text)."""
    t = F.col(text_col)
    return docs.select(id_col, F.length(t).alias("text_chars"),
                       F.size(F.split(t, "\n", -1)).alias("text_lines"),
                       F.size(F.filter(F.split(t, "\\s+", -1), lambda w: w != "")).alias("text_words"),
                       F.substring(t, 1, chars).alias("preview"),
                       (F.length(t) > chars).alias("truncated"))


def sample_rows(df: DataFrame, n: int = 10, order_by: str | None = None) -> DataFrame:
    """First ``n`` rows in key order (deterministic)."""
    if int(n) < 1:
        raise ValueError("n must be at least 1")
    key = order_by or df.columns[0]
    return df.orderBy(F.col(key)).limit(int(n))


# ---------------------------------------------------------------------------
# sinks (and the matching read-back)
# ---------------------------------------------------------------------------
def new_output_dir(spark: SparkSession, kind: str) -> str:
    return scratch_dir(spark, f"io/{kind}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, path: str, fmt: str, header_names: dict[str, str] | None = None) -> str:
    """Write ``df`` as csv (with header) / json / parquet; ``header_names``
    renames columns on the way out (e.g. display names)."""
    out = df
    if header_names:
        out = out.select(*[F.col(c).alias(header_names.get(c, c)) for c in df.columns])
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.format(fmt).save(path)
    return path


def roundtrip(df: DataFrame, fmt: str, header_names: dict[str, str] | None = None,
              explicit_schema: bool = True) -> DataFrame:
    """Write then read back through the format dispatcher. With
    ``explicit_schema`` the reader gets the written schema (production path);
    otherwise CSV types are inferred (one extra pass over the files)."""
    spark = df.sparkSession
    path = write_table(df, new_output_dir(spark, fmt), fmt, header_names)
    schema = None
    if explicit_schema and fmt in ("csv", "json"):
        if header_names:
            from pyspark.sql.types import StructField, StructType
            schema = StructType([StructField(header_names.get(f.name, f.name), f.dataType, True)
                                 for f in df.schema.fields])
        else:
            schema = df.schema
    return load_table(spark, path, fmt=fmt, schema=schema)


# The action-list export columns.
ACTION_LIST_COLS = ["customer_id", "priority_class", "estimated_clv", "churn_risk_score"]


def export_action_list(priority: DataFrame) -> tuple[str, DataFrame]:
    """Write the priority list's action columns as CSV with a header.

    The list is a top-n of the size that the caller asked for, written as one file.
    Returns (path, the file read back)."""
    spark = priority.sparkSession
    path = new_output_dir(spark, "action_list")
    sel = priority.select(*ACTION_LIST_COLS)
    sel.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path, load_table(spark, path, fmt="csv", schema=sel.schema)
