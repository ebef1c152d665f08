"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from . import problems, retrieval

MODULES = (problems, retrieval)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.oracle_sql().items()}
