"""Schema-only helpers: column-name normalisation and alias resolution.

These read ``df.columns`` on the driver (metadata, never data) and return
plain column names or ``Column`` objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# ---------------------------------------------------------------------------
# Alias lists, in the order they are tried (first hit wins).
# ---------------------------------------------------------------------------
CHURN_ALIASES = ["churn_flag", "churned", "churn", "is_churn"]
CLV_ALIASES = ["estimated_clv", "clv", "customer_lifetime_value", "ltv"]
KPI_CLV_ALIASES = ["estimated_clv", "clv", "customer_lifetime_value"]
RISK_ALIASES = ["churn_risk_score", "risk_score", "churn_score"]
SAT_ALIASES = ["satisfaction_score", "csat", "nps_score", "satisfaction"]
FEE_ALIASES = ["monthlycharges", "monthly_charges", "monthly_fee", "monthly_revenue", "monthlyrevenue"]
ID_ALIASES = ["customer_id", "customerid", "custid", "id"]
COMPLAINT_ALIASES = ["complaints_90d", "complaints", "support_tickets", "supporttickets"]
DIM_ALIASES = {
    "region": ["region", "city", "location"],
    "state": ["state", "province"],
    "city_tier": ["city_tier", "tier"],
    "customer_segment": ["customer_segment", "segment", "plantype", "plan_type"],
    "acquisition_channel": ["acquisition_channel", "channel"],
    "plan_type": ["plan_type", "plantype", "plan"],
    "contract_type": ["contract_type", "contracttype", "contract"],
}


def normalize_name(c: str) -> str:
    return c.strip().lower().replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """strip + lower + spaces->underscores on every column name."""
    return df.toDF(*[normalize_name(c) for c in df.columns])


def find_col(df_or_cols, aliases: list[str]) -> str | None:
    """Case-insensitive; the first alias (in list order) that exists wins."""
    cols = df_or_cols.columns if hasattr(df_or_cols, "columns") else list(df_or_cols)
    lmap = {c.lower(): c for c in cols}
    for a in aliases:
        if a.lower() in lmap:
            return lmap[a.lower()]
    return None


def find_dim(df_or_cols, canonical: str) -> str | None:
    return find_col(df_or_cols, DIM_ALIASES.get(canonical, [canonical]))


def find_col_containing(df_or_cols, *token_groups: tuple[str, ...]) -> str | None:
    """Looser resolution: the first column whose lower-case name contains all
    tokens of any group, e.g. ``("support", "ticket")``. Columns are tried in
    schema order."""
    cols = df_or_cols.columns if hasattr(df_or_cols, "columns") else list(df_or_cols)
    for c in cols:
        lc = c.lower()
        for group in token_groups:
            if all(t in lc for t in group):
                return c
    return None
