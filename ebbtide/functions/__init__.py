from ebbtide.functions.scalars import r, sigmoid  # noqa: F401
from ebbtide.functions.columns import find_col, normalize_columns  # noqa: F401
