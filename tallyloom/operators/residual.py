"""Residual budget: proposals become counts that keep what is observed and never exceed n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import compositions as co
from tallyloom.panel import known_sum, residual

RULES = ("cap", "rescale", "prop_other")


def fill(panel: DataFrame, rule: str = "cap", proposal: str = "p", other: str | None = None) -> DataFrame:
    """The panel with filled: counts without a gap. p: proposed shares, one a target.

    cap: proposals are scaled down only where they exceed the residual, the rest is Other's.
    rescale: positive proposals are always scaled to the residual, Other gets nothing; a row whose
    proposals are all 0 keeps the outcome of cap. prop_other: the residual is split over missing
    targets and Other in proportion; `other` names Other's proposal (else what the shares leave).
    A residual of 0 gives zeros. Weights that are all 0 leave null: a violation, see violations().
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    asked = F.zip_with("c", proposal, lambda v, p: F.when(v.isNull(), F.coalesce(p, F.lit(0.0))).otherwise(0.0))
    s = co.total(asked)
    left = F.greatest(residual() / F.col("n"), F.lit(0.0))
    if rule == "prop_other":
        own = F.col(other) if other else F.greatest(1 - co.total(F.col(proposal)), F.lit(0.0))
        weight = s + F.coalesce(own, F.lit(0.0))
        value = lambda p: F.when(residual() == 0, 0.0).when(weight > 0, residual() * p / weight)
    else:
        factor = F.when(s > left, left / s).otherwise(1.0) if rule == "cap" else F.when(s > 0, left / s).otherwise(1.0)
        value = lambda p: p * factor * F.col("n")
    return panel.withColumn("filled", F.zip_with("c", asked, lambda v, p: F.coalesce(v, value(p))))


def violations(filled: DataFrame) -> DataFrame:
    """row_id, code of rows that break an invariant: a null, a negative value, a sum over n, a changed count."""
    ok = 1e-10 * F.greatest(F.lit(1.0), F.col("n"))
    code = (
        F.when(F.exists("filled", lambda v: v.isNull()), "missing")
        .when(F.exists("filled", lambda v: v < 0), "negative")
        .when(co.total(F.col("filled")) > F.col("n") + ok, "over_total")
        .when(F.exists(F.zip_with("c", "filled", lambda v, f: v.isNotNull() & (v != f)), lambda x: x), "changed")
    )
    return filled.select("row_id", code.alias("code")).where("code is not null")


def allocate(budget: Column, logits: Column, unknown: Column) -> Column:
    """Splits budget over the parts marked unknown by the softmax of their logits; null elsewhere."""
    top = F.array_max(F.zip_with(logits, unknown, lambda z, m: F.when(m, z)))
    e = F.zip_with(logits, unknown, lambda z, m: F.when(m, F.exp(z - top)))
    return F.transform(e, lambda v: budget * v / co.total(e))


def unknown_mass() -> Column:
    """Share of n that the known counts leave."""
    return F.greatest(F.col("n") - known_sum(), F.lit(0.0)) / F.col("n")
