"""Queries on verdicts by mask, decoys and what a mask target can reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.operators import cases, masking
from tallyloom.plans import models
from tallyloom.plans.panels import CUTS, RATE
from tallyloom.plans.registry import Registry
from tallyloom.storage import saved

reg = Registry()
REAL, DECOYS = ["same_day_mean"], ["zero_fill", "mean_fill"]


def case_scores(s, d):
    """mask (a seed's), case (a region), model, ord, error, diagnostic; seed names mask and case.

    Scores are taken at 12 digits: models that score alike differ behind them by the order of a sum,
    which must not decide who is worse.
    """
    case = F.concat_ws("|", "mask", "grp")
    mask = F.concat(F.lit("random_cell "), F.col("seed").cast("string"))
    filled = models.predicted(s, d).withColumn("mask", mask).withColumn("seed", case)
    seen = models.visible_cells(s, d).withColumn("mask", mask).withColumn("seed", case)
    rates = seen.groupBy("seed", "t").agg(F.avg((F.col("c") < 0.5).cast("double")).alias("zero"))
    filled = saved(filled, "cases")
    errors = filled.groupBy("mask", "seed", F.col("grp").alias("case"), "model").agg(F.avg(F.abs(F.col("pred_prop") - F.col("truth_prop"))).alias("error"))
    order = F.array_position(F.array(*(F.lit(m) for m in models.MODELS)), F.col("model"))
    both = errors.join(cases.zero_gap(filled, rates), ["seed", "model"], "left")
    return both.withColumns({"error": F.round("error", 12), "diagnostic": F.round("diagnostic", 12), "ord": order})


def by_mask(s, d):
    rates = cases.agreement(cases.pairwise(case_scores(s, d)))
    return cases.verdict_by_mask(rates.select(F.substring_index("seed", "|", 1).alias("mask"), "rate"))


SCORED = models.SCORES + """, zg AS (SELECT seed, grp, t, avg((v < 0.5)::INTEGER) AS zero FROM vs WHERE v IS NOT NULL GROUP BY ALL),
gg AS (SELECT model, seed, grp, sum(k * abs(x - zero)) / sum(k) AS diagnostic FROM (SELECT model, seed, grp, t, count(*) AS k, avg((pred_count < 0.5)::INTEGER) AS x FROM pred WHERE model_cell GROUP BY ALL) JOIN zg USING (seed, grp, t) GROUP BY ALL),
cg AS (SELECT 'random_cell ' || seed AS mask, grp AS "case", model, round(error, 12) AS error, round(diagnostic, 12) AS diagnostic, list_position(['zero_fill', 'mean_fill', 'same_day_mean'], model) AS ord FROM (SELECT model, seed, grp, avg(abs(pred_prop - truth_prop)) AS error FROM pred GROUP BY ALL) LEFT JOIN gg USING (model, seed, grp)),
pg AS (SELECT x.mask, x."case", CASE WHEN x.error - y.error IS NULL OR x.diagnostic - y.diagnostic IS NULL THEN 'na' WHEN abs(x.error - y.error) < 1e-3 THEN 'tie' WHEN x.diagnostic <> y.diagnostic AND sign(x.diagnostic - y.diagnostic) = sign(x.error - y.error) THEN 'match' ELSE 'mismatch' END AS verdict FROM cg x JOIN cg y ON x.mask = y.mask AND x."case" = y."case" AND x.ord < y.ord),
rg AS (SELECT mask, "case", avg((verdict = 'match')::INTEGER) FILTER (verdict IN ('match', 'mismatch')) AS rate FROM pg GROUP BY ALL),
vm AS (SELECT *, CASE WHEN cases < 4 THEN 'insufficient' WHEN mean_rate >= 0.8 AND least_rate >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT mask, count(rate) AS cases, avg(rate) AS mean_rate, min(rate) AS least_rate FROM rg GROUP BY mask))"""
reg.add("tier3_verdict_by_mask", by_mask,
        "SELECT * FROM vm UNION ALL SELECT NULL, sum(cases)::BIGINT, sum(mean_rate * cases) / sum(cases), min(least_rate), CASE WHEN bool_or(verdict = 'insufficient') THEN 'insufficient' WHEN bool_or(verdict = 'fail') THEN 'fail' ELSE 'pass' END FROM vm HAVING count(*) > 0",
        "mask cases verdict", "mean_rate least_rate", SCORED)
for _score in ("error", "diagnostic"):
    reg.add(f"tier3_decoys_{_score}", lambda s, d, score=_score: cases.decoys_worse(case_scores(s, d).withColumn("score", F.col(score)), REAL, DECOYS),
            f"""SELECT k.mask, k."case", decoy, f.{_score} > r.{_score} AS worse FROM (SELECT DISTINCT mask, "case" FROM cg) k CROSS JOIN (SELECT unnest(['zero_fill', 'mean_fill']) AS decoy)
            LEFT JOIN cg f ON f.mask = k.mask AND f."case" = k."case" AND f.model = decoy LEFT JOIN cg r ON r.mask = k.mask AND r."case" = k."case" AND r.model = 'same_day_mean'""",
            'mask "case" decoy worse', "", SCORED)

WITHOUT = "EUROPE"


def narrowed(s, d):
    """The panel without a region, and the target of all regions: that region's strata can't be reached."""
    panel = pn.orders_panel(s, d)
    cut = masking.cuts(panel).first()
    pi = masking.shares(panel.withColumn("q1", F.lit(cut["q1"])).withColumn("q2", F.lit(cut["q2"])), masking.model_decided()).collect()
    return panel.where(F.col("grp") != WITHOUT), masking.Target(cut["q1"], cut["q2"], {r["stratum"]: r["share"] for r in pi})


SEEN = f"{CUTS}, oc AS (SELECT stratum, count(*) AS cells FROM cells JOIN lab USING (row_id) WHERE c IS NOT NULL AND grp <> '{WITHOUT}' GROUP BY stratum)"
reg.add("mask_reachability", lambda s, d: masking.reachability((x := narrowed(s, d))[0], RATE, x[1]),
        f"SELECT stratum, pi, coalesce(cells, 0) AS cells, pi * goal AS wanted, greatest(pi * goal - coalesce(cells, 0), 0) AS lacking, cells IS NOT NULL AS reachable FROM pm LEFT JOIN oc USING (stratum), (SELECT sum(cells) * {RATE} AS goal FROM oc)", "stratum cells reachable", "pi wanted lacking", SEEN)
reg.add("mask_weight_record", lambda s, d: masking.weight_record((x := narrowed(s, d))[0], x[1]),
        f"""SELECT candidate_series, zero_weight_series, candidate_cells, unreachable_strata, unreachable_mass FROM (SELECT count(*) AS candidate_series, count(*) FILTER (w = 0) AS zero_weight_series FROM (SELECT e, t, sum(coalesce(pi, 0)) AS w FROM cells JOIN lab USING (row_id) LEFT JOIN pm USING (stratum) WHERE c IS NOT NULL AND grp <> '{WITHOUT}' GROUP BY e, t)),
        (SELECT sum(cells)::BIGINT AS candidate_cells FROM oc), (SELECT count(*) FILTER (cells IS NULL) AS unreachable_strata, coalesce(sum(pi) FILTER (cells IS NULL), 0) AS unreachable_mass FROM pm LEFT JOIN oc USING (stratum))""",
        "candidate_series zero_weight_series candidate_cells unreachable_strata", "unreachable_mass", SEEN)
