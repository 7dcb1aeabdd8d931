"""Every operator as a registered query over the test tables, each beside its SQL check."""

from fleetfold.workload import audits, clusters, core, epochs, places, positions, streams  # noqa: F401
from fleetfold.workload.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
