"""Physical-plan inspection: what Catalyst chose for a DataFrame.

Used by the plan tests and handy when tuning: every operator here is
expressed declaratively, so the plan is where partitioning, pushdown and
codegen decisions show up.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# operators that mean row-at-a-time or batched Python evaluation, or all pairs
SLOW_PATH = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct")


def physical_plan(df: DataFrame) -> str:
    """The executed plan as text (before adaptive re-planning)."""
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> list[str]:
    """Operator names in the physical plan, in print order."""
    names = []
    for line in physical_plan(df).splitlines():
        m = re.search(r"([A-Z][A-Za-z]+)(?=[ (\[])", line.lstrip(" :+-*()0-9"))
        if m:
            names.append(m.group(1))
    return names


def slow_path_operators(df: DataFrame) -> list[str]:
    p = physical_plan(df)
    return [op for op in SLOW_PATH if op in p]


def exchanges(df: DataFrame) -> int:
    """Number of shuffles (``Exchange``, broadcast exchanges excluded)."""
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
                          physical_plan(df)))


def scan_pushdown(df: DataFrame) -> list[tuple[str, str]]:
    """(PushedFilters, ReadSchema) of every file scan, from the formatted plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = re.findall(r"PushedFilters: (\[.*?\])", text)
    schemas = re.findall(r"ReadSchema: (struct<.*?>)\n", text)
    return list(zip(pushed, schemas))
