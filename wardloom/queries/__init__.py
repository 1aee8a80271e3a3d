"""All queries of the library, by name, with DuckDB SQL of those that SQL can express."""

from . import aggregates, evaluation, files, functions, nested, probes, relational, reports, scores, sources, stores, studies, tables  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

FLAGSHIP = "pf01_contract_table"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
