"""ebbtide — customer-retention analytics as Spark DataFrame jobs.

Layout:
  functions/  column-expression builders (rounding, labels, alias resolution)
  sources/    table loading, the derived ``customers`` fixture, text scans, sinks
  operators/  the analytics operators (KPIs, cohorts, NBA rules, priority list,
              what-if, profiling, tagging, report tables, ML)
  plans/      session settings, scalar-subquery and plan-inspection helpers
  streaming/  the same column expressions on ``readStream`` frames
"""

__version__ = "0.1.0"
