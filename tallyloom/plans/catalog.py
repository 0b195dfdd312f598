"""Registry of the count-table queries and of the SQL that gives the same rows."""

from __future__ import annotations

from tallyloom.plans import diagnoses, models, more, panels, pilots, regressions, tuning, verdicts
from tallyloom.plans.registry import Query

MODULES = [panels, models, more, pilots, tuning, diagnoses, regressions, verdicts]


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.reg.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.reg.oracles.items()}
