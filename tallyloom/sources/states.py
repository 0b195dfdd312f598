"""Initial states of the staged model and masks as checked tables in a shared folder.

A state is written by Spark: its rows, then one row of facts, so that a state whose export was lost
half-way has no facts and is refused. Reading it back fits nothing: what can be told from the panel
and the recipe (training cells, labels, least shares, observed counts) is computed again, the
fillings themselves are bound by a digest of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyloom.functions import compositions as co
from tallyloom.operators import staged
from tallyloom.panel import half_least_positive
from tallyloom.sources.tables import table_digest

VERSION = 1
ROWS = "row_id bigint, inference array<double>, training array<double>, q array<boolean>, labels array<double>"
FACTS = "version int, no_missing boolean, rate double, seed bigint, delta_inference double, delta_training double, rows bigint, sum string, xor bigint"
#: Slack of a filled row's sum over its total.
OVER = 1e-9


class StateError(ValueError):
    """A stored state or mask that doesn't belong to this panel and recipe; code says why."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(f"{code}: {text}" if text else code)
        self.code = code


def whole(panel: DataFrame) -> bool:
    """Does no cell miss? True of an empty panel."""
    return panel.where(F.exists("c", lambda v: v.isNull())).isEmpty()


def expected(panel: DataFrame, rate: float, seed: int) -> tuple[DataFrame, float, float]:
    """The training view with its labels as shares, and half the least positive shares of both views."""
    view = staged.training_view(panel, rate, seed).withColumn("labels", F.transform("label", lambda v: v / F.col("n")))
    if view.where(F.exists("q", lambda x: x)).isEmpty():
        raise StateError("no_training_cells", "the recipe hides no cell")
    return view, half_least_positive(panel).first()["delta"], half_least_positive(view).first()["delta"]


def export(panel: DataFrame, rate: float, seed: int, path: str, k: int = 3) -> None:
    """Writes the first completions of the panel and of its training view, the training cells and labels.

    A panel without missing cells has nothing to complete: only that fact is written. An existing
    state is refused.
    """
    spark, digest = panel.sparkSession, {"rows": 0, "sum": None, "xor": None}
    deltas = (None, None)
    none = whole(panel)
    if not none:
        view, *deltas = expected(panel, rate, seed)
        mine = staged.initial(panel, k).select("row_id", F.col("filled").alias("inference"))
        trained = staged.initial(view.select(*panel.columns), k).select("row_id", F.col("filled").alias("training"))
        view.select("row_id", "q", "labels").join(mine, "row_id").join(trained, "row_id").select("row_id", "inference", "training", "q", "labels").write.mode("errorifexists").parquet(f"{path}/rows")
        stored = spark.read.parquet(f"{path}/rows")
        digest = table_digest(stored, stored.columns).first().asDict()
    facts = (VERSION, none, float(rate), int(seed), *deltas, digest["rows"], digest["sum"], digest["xor"])
    spark.createDataFrame([facts], FACTS).coalesce(1).write.mode("errorifexists").parquet(f"{path}/facts")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        found = spark.read.parquet(path)
    except AnalysisException as gone:
        raise StateError("incomplete", f"nothing to read at {path}") from gone
    if found.schema.simpleString() != spark.createDataFrame([], schema).schema.simpleString():
        raise StateError("columns", f"{path} has {found.schema.simpleString()}")
    return found


def restore(panel: DataFrame, rate: float, seed: int, path: str) -> DataFrame | None:
    """The rows of a stored state that fits the panel and the recipe; None for a panel without missing cells.

    StateError by code: incomplete, columns, version, no_missing, recipe, digest, delta, or what is
    wrong with the first row by row_id: other_rows (also repeated ones), training_cells, labels,
    observed_changed, not_completed.
    """
    spark = panel.sparkSession
    facts = stored(spark, f"{path}/facts", FACTS).collect()
    if len(facts) != 1 or facts[0]["version"] != VERSION:
        raise StateError("version")
    fact, none = facts[0], whole(panel)
    if fact["no_missing"] != none:
        raise StateError("no_missing", "the state and the panel differ on whether cells miss")
    if (fact["rate"], fact["seed"]) != (float(rate), int(seed)):
        raise StateError("recipe", f"made with rate {fact['rate']} and seed {fact['seed']}")
    if none:
        return None
    rows = stored(spark, f"{path}/rows", ROWS)
    if table_digest(rows, rows.columns).first().asDict() != {k: fact[k] for k in ("rows", "sum", "xor")}:
        raise StateError("digest", "the rows aren't those that were written")
    view, *deltas = expected(panel, rate, seed)
    if deltas != [fact["delta_inference"], fact["delta_training"]]:
        raise StateError("delta", "half the least positive share is another")
    mine = view.select("row_id", "n", F.zip_with("c", "label", lambda v, hidden: F.coalesce(v, hidden)).alias("seen"), F.col("c").alias("shown"), F.col("q").alias("cells"), F.col("labels").alias("shares"), F.lit(True).alias("here"))

    def same(was: Column, now: Column) -> Column:
        return (F.size(was) == F.size(now)) & F.forall(F.zip_with(was, now, lambda a, b: a.isNull() | a.eqNullSafe(b)), lambda ok: ok)

    def done(x: Column) -> Column:
        return F.forall(x, lambda v: F.coalesce((v >= 0) & ~F.isnan(v), F.lit(False))) & (co.total(x) <= F.col("n") * (1 + OVER))

    code = (
        F.when(F.col("here").isNull() | F.col("inference").isNull() | (F.col("times") > 1), "other_rows")
        .when(~F.col("q").eqNullSafe(F.col("cells")), "training_cells")
        .when(~F.col("labels").eqNullSafe(F.col("shares")), "labels")
        .when(~F.coalesce(same(F.col("seen"), F.col("inference")) & same(F.col("shown"), F.col("training")), F.lit(False)), "observed_changed")
        .when(~F.coalesce(done(F.col("inference")) & done(F.col("training")), F.lit(False)), "not_completed")
    )
    once = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("times"), *(F.first(c).alias(c) for c in rows.columns[1:]))
    bad = mine.join(once, "row_id", "full").select("row_id", code.alias("code")).where("code IS NOT NULL").orderBy("row_id").first()
    if bad:
        raise StateError(bad["code"], f"row {bad['row_id']}")
    return rows


def write_mask(masked: DataFrame, path: str) -> None:
    """row_id and h, the hidden cells, as Parquet."""
    masked.select("row_id", "h").write.mode("errorifexists").parquet(path)


def read_mask(panel: DataFrame, path: str) -> DataFrame:
    """The panel with the stored h. StateError: columns, other_rows, or not_observed for a hidden cell without a count."""
    mask = stored(panel.sparkSession, path, "row_id bigint, h array<boolean>")
    once = mask.groupBy("row_id").agg(F.count(F.lit(1)).alias("times"), F.first("h").alias("h"))
    both = panel.select("row_id", "c").join(once, "row_id", "full")
    hides = F.exists(F.zip_with("c", "h", lambda v, h: h & v.isNull()), lambda x: x)
    code = F.when(F.col("c").isNull() | F.col("h").isNull() | (F.col("times") > 1) | (F.size("c") != F.size("h")) | F.exists("h", lambda x: x.isNull()), "other_rows").when(hides, "not_observed")
    bad = both.select("row_id", code.alias("code")).where("code IS NOT NULL").orderBy("row_id").first()
    if bad:
        raise StateError(bad["code"], f"row {bad['row_id']}")
    return panel.join(mask, "row_id")
