from . import pipelines  # noqa: F401  registers its queries
from .oracle import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]
