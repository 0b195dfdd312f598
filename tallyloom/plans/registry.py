"""Helpers by which query modules pair a plan with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Doubles are compared after rounding: the order of a sum differs between engines.
DIGITS = 9


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, negative zero as zero."""
    return df.select(*((F.round(F.col(c), DIGITS) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, plan: Query, body: str | None = None, keys: str = "", doubles: str = "", ctes: str = "") -> None:
        """body: SQL over the common tables in ctes; keys and doubles: the columns of its result."""
        self.queries[name] = lambda spark, sf_dir: rounded(plan(spark, sf_dir))
        if body:
            columns = [c for c in keys.split()] + [f"round({c}, {DIGITS}) + 0 AS {c}" for c in doubles.split()]
            head = f"WITH {ctes.strip()}, out_ AS (" if ctes else "WITH out_ AS ("
            self.oracles[name] = f"{head}{body}) SELECT {', '.join(columns)} FROM out_"
