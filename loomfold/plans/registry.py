
from __future__ import annotations

from collections.abc import Callable

from loomfold.sources.tables import ROLES_SQL

FLAGSHIP = "A03"

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, more: str = ""):
    """Registers (spark, sf_dir) -> DataFrame; `sql` is its oracle over the roles, after further CTEs in `more`."""

    def keep(run: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            SQL[name] = f"with {ROLES_SQL}{',' + more if more else ''}\n{sql}"
        return run

    return keep


def _load() -> None:
    from loomfold.plans import catalog, models, more, recommend, records, reports  # noqa: F401  they register themselves


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
