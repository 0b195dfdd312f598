"""Queries on older baselines, masks and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.functions import compositions as co
from tallyloom.functions.hashing import TRAIN, uniform
from tallyloom.operators import neighbours, pilots
from tallyloom.plans import models, panels
from tallyloom.plans.panels import BASE, completed
from tallyloom.plans.registry import Registry
from tallyloom.plans.sqltext import ORDERS, TRAIN as TRAIN_SQL, u

reg = Registry()
D = len(pn.PRIORITIES)

# --- baselines -------------------------------------------------------------------

MEANS = f"""{ORDERS}, m AS (SELECT t, avg(c) AS m FROM cells GROUP BY t), comp AS (SELECT t, m / sum(m) OVER () AS m FROM m),
sc AS (SELECT row_id, coalesce(median(c / m) FILTER (c > 0 AND m > 0), 1) AS s FROM cells JOIN comp USING (t) GROUP BY row_id),
fl AS (SELECT row_id, e, days, n, t, c, coalesce(c, m * s) AS count FROM cells JOIN comp USING (t) JOIN sc USING (row_id))"""
reg.add("train_mean_scaled", lambda s, d: completed(pilots.scaled_means(pn.orders_panel(s, d), D)), "SELECT row_id, t, count FROM fl", "row_id t", "count", MEANS)
reg.add("row_positive_mean", lambda s, d: completed(pilots.row_means(pn.orders_panel(s, d), D)), "SELECT row_id, t, coalesce(c, avg(c) FILTER (c > 0) OVER (PARTITION BY row_id), (SELECT avg(m) FROM m)) AS count FROM cells", "row_id t", "count", MEANS)
reg.add("hron_crossfit", lambda s, d: neighbours.hron(pn.orders_panel(s, d), exclude_own=True), "SELECT row_id, t, count(*) AS donors, median(v / list_aggregate(ox, 'median') * list_aggregate(qx, 'median')) AS p FROM lim WHERE d <= dk + 1e-12 * greatest(1, abs(dk)) GROUP BY row_id, t", "row_id t donors", "p",
        models.DIST.replace("AND o.bits <> q.bits)", "AND o.bits <> q.bits AND o.row_id // 100000 <> q.row_id // 100000)"))


def full_shares(s, d):
    return pn.cells(pn.orders_full(s, d)).select("row_id", "t", (F.col("c") / F.col("n")).alias("p"))


reg.add("spearman_feature_order", lambda s, d: pilots.feature_order(full_shares(s, d)), "SELECT t, score, row_number() OVER (ORDER BY round(score, 12) DESC, t) AS place FROM sr", "t place", "score",
        f"""{ORDERS}, fr AS (SELECT row_id, t, rank() OVER (PARTITION BY t ORDER BY truth / n) + (count(*) OVER (PARTITION BY t, truth / n) - 1) / 2.0::DOUBLE AS r FROM full_cells),
        sr AS (SELECT t, CASE WHEN min(rho) > 0 THEN exp(avg(ln(CASE WHEN rho > 0 THEN rho END))) ELSE 0 END AS score FROM (SELECT a.t AS t, b.t AS o, abs(corr(a.r, b.r)) AS rho FROM fr a JOIN fr b USING (row_id) GROUP BY a.t, b.t) GROUP BY t)""")
for _most, _name in ((False, "reference_parts_low"), (True, "reference_parts_high")):
    reg.add(_name, lambda s, d, m=_most: pilots.reference_parts(pn.cells(pn.orders_panel(s, d)), 2, m), f"SELECT t, avg((c IS NULL)::INTEGER) AS missing_rate FROM cells GROUP BY t ORDER BY missing_rate {'DESC' if _most else ''}, t LIMIT 2", "t", "missing_rate", ORDERS)

# --- masks -----------------------------------------------------------------------

reg.add("mask_hidden_variants", lambda s, d: pilots.hidden_variants(pn.orders_panel(s, d), D, 2), " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS label, row_number() OVER (ORDER BY {by}) AS place, t FROM pv) WHERE place <= 2" for name, by in (("rare", "a, b, t"), ("middle", "abs(a - 0.5), t"), ("common", "a DESC, b DESC, t"))), "label place t", "",
    f"{BASE}, pv AS (SELECT t, round(avg((c > 0)::INTEGER), 12) AS a, round(coalesce(avg(c / nullif(known, 0)), 0), 12) AS b FROM cells JOIN (SELECT row_id, known FROM rows_ WHERE seen = 4) USING (row_id) GROUP BY t)")


def draws():
    return F.transform("c", lambda v, i: uniform(F.col("e"), F.col("days"), i, TRAIN))


reg.add("mask_fixed_count", lambda s, d: pn.cells(pn.orders_full(s, d).withColumn("h", pilots.fixed_count(draws(), 2)), "h").where("h").select("row_id", "t"), f"SELECT row_id, t FROM (SELECT row_id, t, row_number() OVER (PARTITION BY row_id ORDER BY {u('e', 'days', 't', TRAIN_SQL)}, t) AS nth FROM full_cells) WHERE nth <= 2", "row_id t", "", ORDERS)


def logistic(weights: str) -> str:
    """The seven narrowing passes as chained tables, then the draws."""
    text = f"""{ORDERS}, zr AS MATERIALIZED (SELECT e, days, row_id, {weights} AS z FROM op JOIN (SELECT DISTINCT row_id, e, days FROM full_cells) USING (e, days)),
    zs AS MATERIALIZED (SELECT e, days, row_id, z / (SELECT stddev_pop(z) FROM zr) AS z FROM zr), i0 AS (SELECT -50.0::DOUBLE AS lo, 50.0::DOUBLE AS hi)"""
    for k in range(1, 8):
        text += f""", i{k} AS MATERIALIZED (SELECT lo + (hi - lo) / 32 * k AS lo, lo + (hi - lo) / 32 * (k + 1) AS hi FROM (
          SELECT lo, hi, count(*) FILTER (m < 0.3) AS k FROM (SELECT lo, hi, k, avg(1 / (1 + exp(-(z + lo + (hi - lo) / 32 * k)))) AS m FROM i{k - 1}, zs, (SELECT unnest(range(1, 32)) AS k) GROUP BY lo, hi, k) GROUP BY lo, hi))"""
    return text


DRAWN = "SELECT row_id, t FROM zs, i7, (SELECT unnest([{t}]) AS t) WHERE {u} < 1 / (1 + exp(-(z + (lo + hi) / 2)))"
for _name, _weights, _sql, _masked, _mar in (("mask_mar_logistic", [0.5, -0.3, 0.0, 0.0], "0.5 * c0 - 0.3 * c1", [2, 3], True), ("mask_mnar_logistic", [0.0, 0.0, 0.4, 0.2], "0.4 * c2 + 0.2 * c3", [0, 2], False)):
    reg.add(_name, lambda s, d, w=_weights, m=_masked, r=_mar: pilots.logistic_mask(pn.orders_full(s, d), w, m, 0.3, draws(), r), DRAWN.format(t=", ".join(map(str, _masked)), u=u("e", "days", "t", TRAIN_SQL)), "row_id t", "", logistic(_sql))

# --- plausibility, changes, gates ---------------------------------------------------


def predicted_images(s, d):
    z = F.transform("c", lambda v, i: F.col("days") % 7 * 0.1 + i * 0.2)
    return pn.orders_panel(s, d).withColumn("filled", pilots.anchored(F.col("c"), z))


reg.add("anchored_counts", lambda s, d: completed(predicted_images(s, d)), "SELECT row_id, t, coalesce(c, exp(ln(p) + coalesce(median(CASE WHEN c > 0 THEN ln(c) - ln(p) END) OVER (PARTITION BY row_id), 0))) AS count FROM (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY row_id) AS p FROM (SELECT row_id, t, c, days % 7 * 0.1 + t * 0.2 AS z FROM cells))", "row_id t", "count", ORDERS)
reg.add("scale_guard", lambda s, d: pilots.scale_guard(pilots.scaled_means(pn.orders_panel(s, d), D), 1.5), "SELECT max(r) AS most, median(r) AS middle, count(*) FILTER (r > 1.5) AS flagged, count(*) FILTER (a = 0) AS no_anchor FROM (SELECT row_id, coalesce(sum(c), 0) AS a, sum(count) / greatest(coalesce(sum(c), 0), 1) AS r FROM fl GROUP BY row_id)", "flagged no_anchor", "most middle", MEANS)
reg.add("implausible_rows", lambda s, d: pilots.implausible(pilots.scaled_means(pn.orders_panel(s, d), D).withColumn("first", F.col("filled")).withColumn("filled", F.transform("filled", lambda v: v * (1 + F.col("days") % 3 * 20)))), "SELECT row_id, r AS ratio FROM (SELECT row_id, sum(count * (1 + days % 3 * 20)) / greatest(any_value(n), sum(count), 1) AS r FROM fl GROUP BY row_id) WHERE r > 10", "row_id", "ratio", MEANS)


def moved(s, d):
    after = F.transform("p", lambda v, i: v * (1 + (F.col("days") + i) % 3 * 0.1))
    return panels.shares(s, d).withColumn("q", after)


_cov = " + ".join(f"(covar_samp(b[{i}], b[{j}]) - covar_samp(z[{i}], z[{j}])) ** 2" for i in range(1, 6) for j in range(1, 6))
reg.add("pass_change", lambda s, d: pilots.pass_change(moved(s, d), "p", "q", F.transform("p", lambda v, i: (F.col("days") + i) % 2 == 0), 5), f"SELECT sqrt({_cov}) / 4 AS c1, sum(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN (days + i - 1) % 2 = 0 THEN abs(b[i] - z[i]) ELSE 0 END))) / sum(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN (days + i - 1) % 2 = 0 THEN 1 ELSE 0 END))) AS c2, avg(-list_sum(list_transform(y, lambda v: v / list_sum(y) * ln(v / list_sum(y))))) AS entropy, avg(len(list_filter(y, lambda v: v / list_sum(y) < 1e-4)) / 5.0::DOUBLE) AS near_zero FROM chg", "", "c1 c2 entropy near_zero",
        panels.FULL + ", ch AS (SELECT row_id % 100000 AS days, z, list_transform([1, 2, 3, 4, 5], lambda i: p[i] * (1 + (row_id % 100000 + i - 1) % 3 * 0.1)) AS y FROM z), cl AS (SELECT days, z, y, list_transform(y, lambda v: ln(v)) AS g FROM ch), chg AS (SELECT days, z, y, list_transform(g, lambda v: v - list_sum(g) / 5) AS b FROM cl)")


def config_scores(s, d):
    """Squared and absolute errors by model, group and seed, beside those of filling zeros."""
    error = F.col("pred_prop") - F.col("truth_prop")
    per = models.predicted(s, d).groupBy("model", F.col("grp").alias("scenario"), "seed").agg(F.avg(error * error).alias("m2"), F.avg(F.abs(error)).alias("mae"))
    start = per.where("model = 'zero_fill'").select("scenario", "seed", F.col("m2").alias("start_m2"), F.col("mae").alias("start_mae"))
    return per.where("model <> 'zero_fill'").withColumnRenamed("model", "config").join(start, ["scenario", "seed"])


GATED = models.PRED + """, pe AS (SELECT model, grp, seed, avg((pred_prop - truth_prop) ** 2) AS m2, avg(abs(pred_prop - truth_prop)) AS mae FROM pred GROUP BY ALL),
gt AS (SELECT a.model AS config, a.grp, count(*) AS k, count(*) FILTER (1 - a.m2 / nullif(b.m2, 0) > 0.05 AND a.mae <= b.mae) AS good, avg(a.m2) AS m2 FROM pe a JOIN pe b ON a.grp = b.grp AND a.seed = b.seed AND b.model = 'zero_fill' WHERE a.model <> 'zero_fill' GROUP BY ALL),
ga AS (SELECT config, sum(k)::BIGINT AS cells, avg(m2) AS rank_stat, sum(k) = sum(good) AS qualified FROM gt GROUP BY config)"""
reg.add("efficacy_gates", lambda s, d: pilots.gates(config_scores(s, d), 0.05), "SELECT * FROM ga", "config cells qualified", "rank_stat", GATED)
reg.add("finalists", lambda s, d: pilots.finalists(pilots.gates(config_scores(s, d), 0.05), 1), "SELECT config, row_number() OVER (ORDER BY rank_stat, config) AS place FROM ga WHERE qualified QUALIFY place <= 1", "config place", "", GATED)
reg.add("point_errors", lambda s, d: pilots.point_errors(models.predicted(s, d), F.col("truth_count"), F.col("pred_count"), F.col("model_cell")), "SELECT count(*) FILTER (model_cell) AS cells, avg(abs(pred_count - truth_count)) FILTER (model_cell) AS mae, sqrt(avg((pred_count - truth_count) ** 2) FILTER (model_cell)) AS rmse FROM pred", "cells", "mae rmse", models.PRED)
