"""Table loading. Parquet is the default; csv/json/text by extension or
explicit format, unknown extensions are tried as CSV (with a header)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.columns import normalize_columns, normalize_name

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_EXT_FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".tsv": "csv",
                ".json": "json", ".jsonl": "json", ".ndjson": "json", ".txt": "text",
                ".orc": "orc"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def detect_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    return _EXT_FORMATS.get(ext, "csv")


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None,
               sep: str | None = None, normalize: bool = True, **options) -> DataFrame:
    """Format dispatch: explicit ``fmt`` > file extension > CSV.

    CSV is read with a header; without an explicit ``schema`` types are
    inferred (one extra pass — pass a schema in production). Column names are
    normalised (strip, lower, spaces -> underscores) unless ``normalize=False``.
    """
    fmt = fmt or detect_format(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
        if sep is None and path.lower().endswith(".tsv"):
            sep = "\t"
        if sep:
            reader = reader.option("sep", sep)
    for k, v in options.items():
        reader = reader.option(k, v)
    if fmt == "text":
        df = reader.text(path, wholetext=bool(options.get("wholetext", False)))
    else:
        df = reader.format(fmt).load(path)
    return normalize_columns(df) if normalize else df


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type of the lattice that holds the values of both: equal types stay, null
    gives way, integers widen to the longer one, decimals to enough places on both sides,
    numbers to double, dates to timestamps; everything else meets at string."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    whole = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    digits = dict(zip(whole, (3, 5, 10, 19)))
    if type(a) in whole and type(b) in whole:
        return max(a, b, key=lambda t: whole.index(type(t)))
    exact = [t if isinstance(t, T.DecimalType) else T.DecimalType(digits[type(t)], 0) if type(t) in whole else None for t in (a, b)]
    if all(exact):
        places = max(t.scale for t in exact)
        left = max(t.precision - t.scale for t in exact)
        return T.DecimalType(left + places, places) if left + places <= 38 else T.DoubleType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return T.TimestampType()
    return T.StringType()


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    """Fields by normalised name, in order of first appearance, each with the type that
    holds all its chunks' values."""
    fields: dict[str, T.DataType] = {}
    for s in schemas:
        names = [normalize_name(f.name) for f in s.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"columns of a chunk have the same name: {sorted(names)}")
        for name, f in zip(names, s.fields):
            fields[name] = merged_type(fields[name], f.dataType) if name in fields else f.dataType
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


def append_chunks(frames: list[DataFrame]) -> DataFrame:
    """Row append of chunks whose columns and types may differ: columns match by normalised
    name, a missing one is null, and types meet in ``merged_type`` before the union (which
    is no shuffle). The schema is settled on the driver; no row is read for it."""
    schema = merged_schema([f.schema for f in frames])
    out = None
    for f in frames:
        own = {normalize_name(c): f"`{c}`" for c in f.columns}
        f = f.select(*[(F.col(own[k.name]) if k.name in own else F.lit(None)).cast(k.dataType).alias(k.name) for k in schema.fields])
        out = f if out is None else out.unionAll(f)
    return out


def read_chunks(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Several files or folders, each with its own inferred types, as one table."""
    return append_chunks([load_table(spark, p, **options) for p in paths])
