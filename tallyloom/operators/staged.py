"""The staged sequence model: what can be prepared, and what needs a neural library.

prepare() gives the first completion, the training mask and its labels, the features and the packed
sequences. refine() trains a network; no neural library is installed with this package, so it fails
as invalid input and never falls back to something else.
"""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.hashing import TRAIN
from tallyloom.operators import masking, neighbours, residual, sequences
from tallyloom.panel import model_input


class InvalidInput(ValueError):
    code = "invalid_input"


def clr_features(panel: DataFrame) -> DataFrame:
    """row_id, f: centred logs over the known parts (zeros as half the least positive share), null elsewhere."""
    logs = F.transform("x", lambda v: F.log(F.when(v > 0, v)))
    known = F.size(F.filter(logs, lambda v: v.isNotNull()))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))) / F.nullif(known, F.lit(0))
    return model_input(panel).select("row_id", F.transform(logs, lambda v: v - mean).alias("f"))


def time_embedding(days: Column, size: int = 8) -> Column:
    """Sines, then cosines, of days at falling frequencies."""
    rates = [10_000.0 ** (-2 * k / size) for k in range(size // 2)]
    return F.array(*(F.sin(days * r) for r in rates), *(F.cos(days * r) for r in rates))


def training_view(panel: DataFrame, rate: float, seed: int) -> DataFrame:
    """The visible panel with c less the training cells q, and label: the counts that q hides."""
    marked = panel.withColumn("q", masking.random_cell(rate, seed, TRAIN))
    return marked.withColumn("label", F.zip_with("c", "q", lambda v, q: F.when(q, v))).withColumn("c", F.zip_with("c", "q", lambda v, q: F.when(~q, v)))


def initial(panel: DataFrame, k: int = 3) -> DataFrame:
    """The panel with filled: Jensen-Shannon neighbours, split over missing targets and Other by budget."""
    shares = neighbours.tsagris(panel, k).select("row_id", F.slice("x", F.lit(1), F.size("x") - 1).alias("p"), F.get("x", F.size("x") - 1).alias("p_other"))
    joined = panel.join(shares, "row_id", "left").withColumn("p", F.coalesce("p", F.transform("c", lambda v: F.lit(0.0))))
    return residual.fill(joined, "prop_other", other="p_other").drop("p", "p_other")


def prepare(panel: DataFrame, length: int, rate: float = 0.15, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The initial completion, and the packed sequences of the training view."""
    view = training_view(panel, rate, seed)
    return initial(panel), sequences.packed(view, length)


def refine(start: DataFrame) -> DataFrame:
    if importlib.util.find_spec("torch") is None:
        raise InvalidInput("refining needs torch, which isn't installed; nothing was refined")
    raise InvalidInput("no network is shipped with this package")
