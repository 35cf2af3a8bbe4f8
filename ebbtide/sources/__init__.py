from ebbtide.sources.tables import load_table, table  # noqa: F401
from ebbtide.sources.fixtures import customers  # noqa: F401
