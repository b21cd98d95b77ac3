"""Queries over the operators, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) as a query."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def load() -> None:
    from glyphmill.plans import formulas, latex, logs, packages, reports  # noqa: F401
