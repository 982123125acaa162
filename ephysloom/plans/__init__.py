"""Named queries over the parquet tables, each with its DuckDB oracle where SQL
can express it."""

from .registry import ORACLES, QUERIES, query  # noqa: F401


def load() -> None:
    """Import every module that registers queries."""
    from . import clusters, data_problems, maps, models, names, trains, trials  # noqa: F401
