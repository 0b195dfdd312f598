"""Queries on neighbours, log-ratio fits, scores, support, cases and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.functions import compositions as co
from tallyloom.functions.hashing import HIDE, TRAIN, uniform
from tallyloom.operators import cases, imputers, logratio, masking, neighbours, residual, scoring, sequences, support
from tallyloom.plans import panels
from tallyloom.plans.panels import BASE, DONE, budget, completed, same_day_sql
from tallyloom.plans.registry import Registry
from tallyloom.plans.sqltext import ANCHOR, EVENTS, HIDE as HIDE_SQL, ORDERS, ROWS, u
from tallyloom.sources import tables

reg = Registry()

# --- neighbours ---------------------------------------------------------------


def orders_months(s, d):
    """The orders panel, all its months: what the pairwise queries run on."""
    return pn.orders_panel(s, d)


DIST = f"""{BASE}, need AS (SELECT row_id, t FROM x WHERE x IS NULL),
sh AS (SELECT row_id, t, ln(x) AS g, x FROM x WHERE x IS NOT NULL),
rw AS (SELECT row_id, list(t ORDER BY t) AS ts, list(g ORDER BY t) AS gs, list(x ORDER BY t) AS xs, bit_or(1 << t) AS bits FROM sh GROUP BY row_id),
ql AS (SELECT row_id, ts, gs, xs, bits, list_sum(gs) / len(gs) AS m FROM rw WHERE len(ts) < 5),
pr AS (SELECT q.row_id, q.xs AS qx, o.row_id AS donor, o.bits AS ob, list_transform(q.ts, lambda i: o.xs[list_position(o.ts, i)]) AS ox, o.ts AS ots, o.xs AS oxs, q.gs, q.m
       FROM ql q JOIN rw o ON (o.bits & q.bits) = q.bits AND o.bits <> q.bits),
pg AS (SELECT *, list_transform(ox, lambda v: ln(v)) AS og FROM pr),
ds AS (SELECT row_id, donor, ob, ots, oxs, qx, ox, sqrt(list_sum(list_transform(range(1, len(gs) + 1), lambda i: (gs[i] - m - og[i] + list_sum(og) / len(og)) ** 2))) AS d FROM pg),
cd AS (SELECT ds.row_id, n.t, donor, d, oxs[list_position(ots, n.t)] AS v, qx, ox FROM ds JOIN need n ON n.row_id = ds.row_id AND (ob & (1 << n.t)) <> 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id, t ORDER BY round(d, 12), donor) AS nth FROM cd),
lim AS (SELECT *, max(d) FILTER (nth <= 3) OVER (PARTITION BY row_id, t) AS dk FROM rk)"""
for _name, _adj, _ties in (("hron_knn", "median", "group"), ("hron_knn_sum", "sum", "group"), ("hron_ties_index", "median", "index")):
    _keep = "d <= dk + 1e-12 * greatest(1, abs(dk))" if _ties == "group" else "nth <= 3"
    reg.add(_name, lambda s, d, a=_adj, t=_ties: neighbours.hron(orders_months(s, d), 3, a, t),
            f"SELECT row_id, t, count(*) AS donors, median(v / list_aggregate(ox, '{_adj}') * list_aggregate(qx, '{_adj}')) AS p FROM lim WHERE {_keep} GROUP BY row_id, t", "row_id t donors", "p", DIST)
reg.add("hron_completed", lambda s, d: completed(residual.fill(imputers.with_proposals(p := pn.orders_panel(s, d), neighbours.hron(p)), "cap")), DONE, "row_id t", "count",
        DIST + budget("SELECT row_id, t, median(v / list_aggregate(ox, 'median') * list_aggregate(qx, 'median')) AS p FROM lim WHERE d <= dk + 1e-12 * greatest(1, abs(dk)) AND t < 4 GROUP BY row_id, t", "cap"))

TSA = f"""{BASE}, ps AS (SELECT row_id, list(p ORDER BY t) AS p, count(p) AS k FROM parts GROUP BY row_id),
q AS (SELECT row_id, p, [i for i in range(1, 6) if p[i] IS NOT NULL] AS s FROM ps WHERE k < 5),
o AS (SELECT row_id AS donor, p AS y FROM ps WHERE k = 5),
pr AS (SELECT row_id, donor, p, y, s, list_sum(list_transform(s, lambda i: p[i])) AS sp, list_sum(list_transform(s, lambda i: y[i])) AS sy FROM q, o WHERE len(s) > 0),
dv AS (SELECT row_id, donor, p, y, greatest(list_sum(list_transform(s, lambda i: CASE WHEN p[i] > 0 THEN p[i] / sp * ln(2 * (p[i] / sp) / (p[i] / sp + y[i] / sy)) ELSE 0 END + CASE WHEN y[i] > 0 THEN y[i] / sy * ln(2 * (y[i] / sy) / (p[i] / sp + y[i] / sy)) ELSE 0 END)), 0) AS d FROM pr WHERE sp > 0 AND sy > 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(d, 12), donor) AS nth FROM dv),
wm AS (SELECT list_transform(range(1, 6), lambda i: 0.0) AS z, list(av ORDER BY t) AS allm FROM (SELECT t, avg(parts.p) AS av FROM parts JOIN ps USING (row_id) WHERE ps.k = 5 GROUP BY t)),
mn AS (SELECT row_id, i, %s AS m FROM nn, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE nth <= 3 GROUP BY row_id, i),
mc AS (SELECT row_id, i, m / sum(m) OVER (PARTITION BY row_id) AS m FROM mn),
fl AS (SELECT q.row_id, j.i, q.p[j.i] AS v, coalesce(mc.m, allm[j.i] / list_sum(allm)) AS m, mc.m IS NULL AS fallback FROM q CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS i) j CROSS JOIN wm LEFT JOIN mc ON mc.row_id = q.row_id AND mc.i = j.i),
fs AS (SELECT *, 1 - coalesce(sum(v) OVER w, 0) AS lft, sum(CASE WHEN v IS NULL THEN m ELSE 0 END) OVER w AS sm, count(*) FILTER (v IS NULL) OVER w AS gaps FROM fl WINDOW w AS (PARTITION BY row_id))"""
TSA_OUT = "SELECT row_id, i - 1 AS part, coalesce(v, CASE WHEN lft <= 1e-12 THEN 0 WHEN sm > 0 THEN lft * m / sm ELSE lft / gaps END) AS value, fallback FROM fs"
for _name, _alpha, _inner in (("tsagris_jsd", 1.0, "avg(y[i])"), ("tsagris_half_power", 0.5, "pow(avg(sqrt(y[i])), 2)"), ("tsagris_geometric", 0.0, "CASE WHEN min(y[i]) > 0 THEN exp(avg(ln(CASE WHEN y[i] > 0 THEN y[i] END))) ELSE 0 END")):
    reg.add(_name, lambda s, d, a=_alpha: neighbours.tsagris(pn.orders_panel(s, d), 3, a).select("row_id", F.posexplode("x").alias("part", "value"), "fallback"), TSA_OUT, "row_id part fallback", "value", TSA.replace("%s", _inner))
reg.add("tsagris_tune", lambda s, d: neighbours.tune(pn.orders_panel(s, d), neighbours.ALL_KS, neighbours.ALL_ALPHAS))
reg.add("vector_topk", lambda s, d: neighbours.vector_topk((v := pn.read(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))).where("row_id % 20 = 0"), v, 5),
        "SELECT row_id, donor, d FROM (SELECT q.vec_id AS row_id, o.vec_id AS donor, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - o.embedding[i]::DOUBLE) ** 2)) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, o.vec_id) AS nth FROM embeddings q JOIN embeddings o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0) WHERE nth <= 5", "row_id donor", "d")

# --- log-ratio regression --------------------------------------------------------

MIC = f"""{ORDERS}, {ROWS}, dl AS (SELECT min(c / n) FILTER (c > 0) / 2 AS delta FROM cells),
rs AS (SELECT c.row_id, t, c.n, seen, resid, known, CASE WHEN c = 0 THEN delta ELSE c / c.n END AS v, delta, 5 - seen AS gaps FROM cells c JOIN rows_ USING (row_id), dl WHERE NOT (seen = 4 AND known = 0)),
ms AS (SELECT *, sum(v) OVER (PARTITION BY row_id) AS mass FROM rs),
yt AS (SELECT row_id, t, n, seen, CASE WHEN seen = 4 THEN v / (mass + CASE WHEN resid > 0 THEN resid / n ELSE delta END) WHEN mass > 1 - greatest(1e-12, gaps * delta) THEN v / mass * (1 - greatest(1e-12, gaps * delta)) ELSE v END AS y FROM ms
       UNION ALL SELECT row_id, 4, any_value(n), any_value(seen), CASE WHEN any_value(seen) = 4 THEN any_value(CASE WHEN resid > 0 THEN resid / n ELSE delta END) / (sum(v) + any_value(CASE WHEN resid > 0 THEN resid / n ELSE delta END)) END FROM ms GROUP BY row_id)"""


def prepared(s, d):
    return logratio.usable(logratio.prepared(pn.orders_panel(s, d)))


reg.add("micoda_prepared", lambda s, d: prepared(s, d).select("row_id", F.posexplode("y").alias("t", "y")), "SELECT row_id, t, y FROM yt", "row_id t", "y", MIC)
reg.add("micoda_alr_init", lambda s, d: logratio.alr_start(prepared(s, d), 5, 0).select(F.posexplode("beta").alias("t", "beta")), "SELECT a.t, avg(ln(a.y / r.y)) AS beta FROM yt a JOIN yt r ON a.row_id = r.row_id AND r.t = 0 WHERE a.seen = 4 GROUP BY a.t", "t", "beta", MIC)
reg.add("micoda_pattern_stats", lambda s, d: logratio.pattern_statistics(prepared(s, d), 5).select("pattern", "n", "log_left", "left_squares", "known_squares"),
        "SELECT pattern, count(*) AS n, sum(CASE WHEN pattern > 0 THEN ln(greatest(1 - s, 1e-300)) ELSE 0 END) AS log_left, sum(CASE WHEN pattern > 0 THEN greatest(1 - s, 1e-300) ** 2 ELSE 0 END) AS left_squares, coalesce(sum(q), 0) AS known_squares FROM (SELECT row_id, sum(CASE WHEN y IS NULL THEN 1 << t ELSE 0 END)::INTEGER AS pattern, coalesce(sum(y), 0) AS s, sum(y * y) AS q FROM yt GROUP BY row_id) GROUP BY pattern", "pattern n", "log_left left_squares known_squares", MIC)


def micoda(s, d, other):
    rows, fitted, _ = logratio.fit(pn.orders_panel(s, d), other=other)
    return completed(logratio.restored(rows, fitted.beta, other))


reg.add("micoda_v2", lambda s, d: micoda(s, d, True))
reg.add("micoda_r1", lambda s, d: micoda(s, d, False))


def line_fit(s, d):
    rows = pn.orders_full(s, d)
    b = logratio.ols(rows, [F.lit(1.0), F.col("days") / 365.0], F.col("n"))
    return s.createDataFrame([(float(b[0]), float(b[1]))], "intercept double, slope double")


reg.add("ols_trend", line_fit, "SELECT regr_intercept(n, days / 365.0::DOUBLE) AS intercept, regr_slope(n, days / 365.0::DOUBLE) AS slope FROM op", "", "intercept slope", ORDERS)
reg.add("covariance_matrix", lambda s, d: pn.orders_full(s, d).agg(*(F.covar_samp(F.get("c", F.lit(i)) / F.col("n"), F.get("c", F.lit(j)) / F.col("n")).alias(f"v{i}{j}") for i in range(4) for j in range(i, 4))),
        "SELECT " + ", ".join(f"covar_samp(c{i} / n, c{j} / n) AS v{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM op", "", " ".join(f"v{i}{j}" for i in range(4) for j in range(i, 4)), ORDERS)

# --- scores ------------------------------------------------------------------------

MODELS, SEEDS = ["zero_fill", "mean_fill", "same_day_mean"], [1, 2, 3, 4]


def predicted(s, d):
    return scoring.predictions(pn.orders_panel(s, d), MODELS, SEEDS)


def pred_sql() -> str:
    """The prediction table: hidden cells by seed, then each model on what is left."""
    seeds = ", ".join(f"({s}::BIGINT)" for s in SEEDS)
    return f"""{BASE}, sd AS (SELECT * FROM (VALUES {seeds}) v(seed)), dr AS (
      SELECT *, c IS NOT NULL AND {u("e", "days", "t", f"{HIDE_SQL} + seed")} < 0.1 AS h, {u("e", "days", "t", f"{ANCHOR} + seed")} AS a FROM cells, sd
    ), an AS (SELECT *, count(*) FILTER (c IS NOT NULL AND NOT h) OVER (PARTITION BY row_id, seed) AS stays, row_number() OVER (PARTITION BY row_id, seed ORDER BY CASE WHEN c IS NULL THEN 1 ELSE 0 END, a, t) AS nth FROM dr),
    hid AS (SELECT seed, row_id, e, grp, days, n, t, c AS truth_c, h AND NOT (stays = 0 AND nth = 1) AS h, CASE WHEN NOT (h AND NOT (stays = 0 AND nth = 1)) THEN c END AS v FROM an),
    vs AS (SELECT *, n - coalesce(sum(v) OVER (PARTITION BY seed, row_id), 0) AS resid FROM hid),
    mf AS (SELECT seed, t, avg(v / n) AS p FROM vs GROUP BY seed, t),
    sw AS (SELECT q.seed, q.row_id, q.t, {", ".join(f"count(*) FILTER (q.grp = o.grp AND abs(q.days - o.days) <= {w}) AS k{i}, sum(o.v) FILTER (q.grp = o.grp AND abs(q.days - o.days) <= {w}) / nullif(sum(o.n) FILTER (q.grp = o.grp AND abs(q.days - o.days) <= {w}), 0) AS p{i}" for i, w in enumerate((28, 56, 112)))}, sum(o.v) / sum(o.n) AS pa
           FROM vs q JOIN vs o ON q.seed = o.seed AND q.t = o.t AND o.v IS NOT NULL WHERE q.v IS NULL GROUP BY q.seed, q.row_id, q.t),
    pp AS (SELECT 'zero_fill' AS model, seed, row_id, t, n, resid, h, truth_c, v, e, grp, 0.0::DOUBLE AS p FROM vs
           UNION ALL SELECT 'mean_fill', seed, row_id, t, n, resid, h, truth_c, v, e, grp, p FROM vs JOIN mf USING (seed, t)
           UNION ALL SELECT 'same_day_mean', seed, row_id, t, n, resid, h, truth_c, v, e, grp, least(greatest(CASE WHEN k0 >= 20 THEN p0 WHEN k1 >= 20 THEN p1 WHEN k2 >= 20 THEN p2 ELSE pa END, 0), 1) FROM vs LEFT JOIN sw USING (seed, row_id, t)),
    su AS (SELECT *, greatest(resid / n, 0) AS lft, sum(CASE WHEN v IS NULL THEN p ELSE 0 END) OVER (PARTITION BY model, seed, row_id) AS s FROM pp),
    pred AS (SELECT model, seed, row_id, t, e, grp, n, truth_c AS truth_count, p * n * CASE WHEN s > lft THEN lft / s ELSE 1 END AS pred_count, truth_c / n AS truth_prop, p * CASE WHEN s > lft THEN lft / s ELSE 1 END AS pred_prop, resid = 0 AS forced_zero, resid <> 0 AS model_cell, truth_c = 0 AS truth_zero FROM su WHERE h)"""


PRED = pred_sql()
SCORES = PRED + ", runs AS (SELECT model, seed, avg(abs(pred_prop - truth_prop)) AS mae_prop FROM pred GROUP BY model, seed), ser AS (SELECT model, seed, avg(m) AS series_macro_mae_prop, count(*) AS series FROM (SELECT model, seed, e, t, avg(abs(pred_prop - truth_prop)) AS m FROM pred GROUP BY ALL) GROUP BY model, seed)"


def runs(s, d):
    return predicted(s, d).groupBy("model", "seed").agg(F.avg(F.abs(F.col("pred_prop") - F.col("truth_prop"))).alias("mae_prop"))


KEY = ["model", "seed"]
reg.add("prediction_rows", lambda s, d: predicted(s, d).select("model", "seed", "row_id", "t", "truth_count", "pred_count", "forced_zero", "model_cell", "truth_zero"), "SELECT model, seed, row_id, t, truth_count, pred_count, forced_zero, model_cell, truth_zero FROM pred", "model seed row_id t forced_zero model_cell truth_zero", "truth_count pred_count", PRED)
reg.add("error_groups", lambda s, d: scoring.masked_errors(predicted(s, d), KEY), " UNION ALL ".join(
    f"SELECT model, seed, '{g}' AS cell_group, count(*) FILTER ({w}) AS cells, avg(abs(pred_count - truth_count)) FILTER ({w}) AS mae_count, avg((pred_count - truth_count) ** 2) FILTER ({w}) AS mse_count, avg(abs(pred_prop - truth_prop)) FILTER ({w}) AS mae_prop, avg((pred_prop - truth_prop) ** 2) FILTER ({w}) AS mse_prop FROM pred GROUP BY model, seed"
    for g, w in {"all": "true", "truth_zero": "truth_zero", "truth_positive": "NOT truth_zero", "forced_zero": "forced_zero", "model": "model_cell", "model_truth_zero": "model_cell AND truth_zero"}.items()), "model seed cell_group cells", "mae_count mse_count mae_prop mse_prop", PRED)
reg.add("masked_errors", lambda s, d: scoring.masked_errors(predicted(s, d), ["model"]).where("cell_group = 'all'").select("model", "cells", "mae_count", "mse_prop"), "SELECT model, count(*) AS cells, avg(abs(pred_count - truth_count)) AS mae_count, avg((pred_prop - truth_prop) ** 2) AS mse_prop FROM pred GROUP BY model", "model cells", "mae_count mse_prop", PRED)
reg.add("series_macro_mae", lambda s, d: scoring.series_macro(predicted(s, d), KEY), "SELECT * FROM ser", "model seed series", "series_macro_mae_prop", SCORES)


def whole_rows(s, d):
    """Rows of the orders panel that lack nothing before any mask."""
    return pn.orders_panel(s, d).where(co.complete(F.col("c"))).select("row_id")


reg.add("implied_other", lambda s, d: scoring.implied_other(predicted(s, d), KEY, whole_rows(s, d)), "SELECT model, seed, avg(abs(x)) AS other_mae, avg(x) AS other_bias, count(*) AS rows, count(DISTINCT e) AS entities FROM (SELECT model, seed, row_id, e, (sum(truth_count) - sum(pred_count)) / max(n) AS x FROM pred WHERE row_id IN (SELECT row_id FROM rows_ WHERE seen = 4) GROUP BY ALL) GROUP BY model, seed", "model seed rows entities", "other_mae other_bias", PRED)
reg.add("stratum_mae", lambda s, d: scoring.stratum_errors(predicted(s, d), masking.cuts(pn.orders_panel(s, d))),
        "SELECT model, seed, kind, stratum, cells, CASE WHEN cells >= 30 THEN mae END AS mae FROM (SELECT model, seed, 'group' AS kind, grp AS stratum, count(*) AS cells, avg(abs(pred_prop - truth_prop)) AS mae FROM pred WHERE model_cell GROUP BY ALL UNION ALL SELECT model, seed, 'size', CASE WHEN n <= q1 THEN 'N1' WHEN n <= q2 THEN 'N2' ELSE 'N3' END, count(*), avg(abs(pred_prop - truth_prop)) FROM pred, cut WHERE model_cell GROUP BY ALL)", "model seed kind stratum cells", "mae",
        PRED + ", cut AS (SELECT quantile_cont(n, 1/3.0::DOUBLE) AS q1, quantile_cont(n, 2/3.0::DOUBLE) AS q2 FROM rows_ WHERE seen < 4 AND resid <> 0)")
reg.add("seed_summary", lambda s, d: scoring.seed_summary(runs(s, d), "mae_prop", ["model"]), "SELECT model, avg(mae_prop) AS mean, stddev_samp(mae_prop) AS sd, count(mae_prop) AS runs_ok, count(*) - count(mae_prop) AS runs_failed FROM runs GROUP BY model", "model runs_ok runs_failed", "mean sd", SCORES)


def failed(r):
    """Runs of which one, mean_fill on seed 2, has no score."""
    return r.withColumn("mae_prop", F.when(~((F.col("model") == "mean_fill") & (F.col("seed") == 2)), F.col("mae_prop")))


FAILED = SCORES + ", fr AS (SELECT model, seed, CASE WHEN model = 'mean_fill' AND seed = 2 THEN NULL ELSE mae_prop END AS mae_prop FROM runs), com AS (SELECT seed FROM fr WHERE mae_prop IS NOT NULL GROUP BY seed HAVING count(DISTINCT model) = 3)"
reg.add("common_seeds", lambda s, d: scoring.common_seeds(failed(runs(s, d)), 3), "SELECT model, seed, mae_prop FROM fr JOIN com USING (seed)", "model seed", "mae_prop", FAILED)
reg.add("model_ranking", lambda s, d: scoring.ranking(failed(runs(s, d))), "SELECT model, mean, row_number() OVER (ORDER BY mean NULLS LAST, model) AS place FROM (SELECT model, avg(mae_prop) AS mean FROM fr GROUP BY model)", "model place", "mean", FAILED)
PAIR = "SELECT a.model AS a, b.model AS b, avg(a.mae_prop - b.mae_prop) AS mean_diff, stddev_samp(a.mae_prop - b.mae_prop) AS sd_diff, count(*) FILTER (a.mae_prop < b.mae_prop) AS wins, count(*) FILTER (a.mae_prop > b.mae_prop) AS losses, count(*) FILTER (a.mae_prop = b.mae_prop) AS ties FROM fr a JOIN fr b ON a.seed = b.seed AND a.model < b.model WHERE a.mae_prop IS NOT NULL AND b.mae_prop IS NOT NULL GROUP BY ALL"
SIGN = "CASE WHEN wins + losses > 0 THEN least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: (factorial((wins + losses)::INTEGER) / (factorial(i::INTEGER) * factorial((wins + losses - i)::INTEGER)))::DOUBLE)) / pow(2, wins + losses)) END AS p"
reg.add("pair_diff", lambda s, d: scoring.pairs(failed(runs(s, d))), f"SELECT *, {SIGN} FROM ({PAIR})", "a b wins losses ties", "mean_diff sd_diff p", FAILED)
reg.add("paired_summary", lambda s, d: scoring.pairs(scoring.common_seeds(failed(runs(s, d)), 3)).select("a", "b", "mean_diff", "wins"), f"SELECT a, b, mean_diff, wins FROM ({PAIR.replace('FROM fr a JOIN fr b', 'FROM (SELECT * FROM fr JOIN com USING (seed)) a JOIN (SELECT * FROM fr JOIN com USING (seed)) b')})", "a b wins", "mean_diff", FAILED)
reg.add("sign_test", lambda s, d: pn.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("wins"), (F.col("n_nationkey") % 7).cast("long").alias("losses")).withColumn("p", scoring.sign_test(F.col("wins"), F.col("losses"))), f"SELECT wins, losses, {SIGN} FROM (SELECT n_nationkey::BIGINT AS wins, (n_nationkey % 7)::BIGINT AS losses FROM nation)", "wins losses", "p")
reg.add("rank_flips", lambda s, d: scoring.rank_flips(r := runs(s, d), scoring.series_macro(predicted(s, d), KEY)), "SELECT x.model AS a, y.model AS b, sign(x.m - y.m) <> sign(x.q - y.q) AS flipped FROM (SELECT model, avg(mae_prop) AS m, avg(series_macro_mae_prop) AS q FROM runs JOIN ser USING (model, seed) GROUP BY model) x JOIN (SELECT model, avg(mae_prop) AS m, avg(series_macro_mae_prop) AS q FROM runs JOIN ser USING (model, seed) GROUP BY model) y ON x.model < y.model", "a b flipped", "", SCORES)


def schedule(s, d):
    models = F.explode(F.array(*(F.lit(m) for m in MODELS))).alias("model")
    return s.range(1, 6).select(F.col("id").alias("seed"), models)


def statuses(s, d):
    return failed(runs(s, d)).select("model", "seed", F.when(F.col("mae_prop").isNull(), "failed").otherwise("completed").alias("status"))


reg.add("reliability", lambda s, d: scoring.reliability(schedule(s, d), statuses(s, d)), "SELECT model, count(*) FILTER (st = 'completed') AS completed, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (st = 'missing') AS missing, coalesce(string_agg(seed::VARCHAR, ',' ORDER BY seed) FILTER (st <> 'completed'), '') AS not_completed FROM (SELECT m.model, s.seed, CASE WHEN f.model IS NULL THEN 'missing' WHEN mae_prop IS NULL THEN 'failed' ELSE 'completed' END AS st FROM (SELECT DISTINCT model FROM runs) m CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS seed) s LEFT JOIN fr f ON f.model = m.model AND f.seed = s.seed) GROUP BY model", "model completed failed missing not_completed", "", FAILED)


def samples(s, d):
    """Observed shares (a) and mean-filled missing ones (b)."""
    filled = residual.fill(imputers.mean_fill(pn.orders_panel(s, d)))
    long = pn.cells(filled, "filled")
    return long.select("t", F.when(F.col("c").isNotNull(), "a").otherwise("b").alias("side"), (F.col("filled") / F.col("n")).alias("value"), "n")


W1 = f"""{BASE}{budget(panels.MEAN, "cap")}, sm AS (SELECT t, count / n AS value, CASE WHEN c.c IS NOT NULL THEN 'a' ELSE 'b' END AS side, n FROM done JOIN (SELECT row_id, t, c FROM cells) c USING (row_id, t)),
wv AS (SELECT t, value, sum(w) FILTER (side = 'a') AS wa, sum(w) FILTER (side = 'b') AS wb FROM (SELECT *, %s AS w FROM sm) GROUP BY t, value),
cu AS (SELECT t, value, coalesce(sum(wa) OVER o, 0) / sum(wa) OVER p - coalesce(sum(wb) OVER o, 0) / sum(wb) OVER p AS f, lead(value) OVER o - value AS step FROM wv WINDOW o AS (PARTITION BY t ORDER BY value), p AS (PARTITION BY t))"""
W1_OUT = "SELECT t, sum(abs(f) * step) AS distance FROM cu GROUP BY t"
reg.add("wasserstein_native", lambda s, d: scoring.wasserstein(samples(s, d).withColumn("weight", F.lit(1.0)), ["t"]), W1_OUT, "t", "distance", W1.replace("%s", "1.0::DOUBLE"))
reg.add("wasserstein_weighted", lambda s, d: scoring.wasserstein(samples(s, d).withColumn("weight", F.col("n")), ["t"]), W1_OUT, "t", "distance", W1.replace("%s", "n"))

# --- support and cases -------------------------------------------------------------


def support_sides(s, d):
    filled = pn.cells(residual.fill(imputers.mean_fill(pn.orders_panel(s, d))).withColumn("z", pn.forced_zero()), "filled", "z")
    asked = filled.where("c is null and not z").select("row_id", "t", "e", "grp", "days", "n", F.col("filled").alias("count"))
    return asked, filled.where("c is not null").select("row_id", "t", "e", "grp", "days", "n", "c")


def supported(s, d):
    asked, seen = support_sides(s, d)
    return support.support(asked.drop("n", "count"), seen)


SUP = f"""{BASE}{budget(panels.MEAN, "cap")}, ev AS (SELECT row_id, t, c.e, c.grp, c.days, c.n, count FROM cells c JOIN done USING (row_id, t) JOIN rows_ USING (row_id) WHERE c.c IS NULL AND rows_.resid <> 0),
ob AS (SELECT * FROM cells WHERE c IS NOT NULL),
rf AS (SELECT ev.row_id, ev.t, ob.row_id AS ref, ob.e, ob.c FROM ev JOIN ob ON ev.t = ob.t AND ev.grp = ob.grp AND abs(ev.days - ob.days) <= 62 AND ev.e <> ob.e),
sp AS (SELECT ev.row_id, ev.t, count(rf.ref) AS refs, count(DISTINCT rf.e) AS entities FROM ev LEFT JOIN rf USING (row_id, t) GROUP BY ev.row_id, ev.t),
ok AS (SELECT *, refs >= 10 AND entities >= 2 AS supported FROM sp),
pooled AS (SELECT t, f.k AS cells, f.z - o.z AS d1 FROM (SELECT t, count(*) AS k, avg((count < 0.5)::INTEGER) AS z FROM ev GROUP BY t) f JOIN (SELECT t, avg((c < 0.5)::INTEGER) AS z FROM ob GROUP BY t) o USING (t)),
lw AS (SELECT t, sum((c < 0.5)::INTEGER / refs) / sum(1.0 / refs) AS y FROM rf JOIN ok USING (row_id, t) WHERE supported GROUP BY t),
loc AS (SELECT t, count(*) AS cells, avg((count < 0.5)::INTEGER) - any_value(y) AS d1 FROM ev JOIN ok USING (row_id, t) JOIN lw USING (t) WHERE supported GROUP BY t)"""
reg.add("local_support", lambda s, d: supported(s, d).select("row_id", "t", "refs", "entities", "supported"), "SELECT * FROM ok", "row_id t refs entities supported", "", SUP)
reg.add("d1_pooled", lambda s, d: support.pooled_zero_gap(*support_sides(s, d)), "SELECT * FROM pooled", "t cells", "d1", SUP)
reg.add("d1_local", lambda s, d: support.local_zero_gap((x := support_sides(s, d))[0], support.support(x[0].drop("n", "count"), x[1]), x[1]), "SELECT * FROM loc", "t cells", "d1", SUP)
reg.add("reference_shift", lambda s, d: support.reference_shift(support.pooled_zero_gap(*(x := support_sides(s, d))), support.local_zero_gap(x[0], support.support(x[0].drop("n", "count"), x[1]), x[1])), "SELECT t, pooled.d1 AS pooled, loc.d1 AS local, sign(pooled.d1) * sign(loc.d1) < 0 OR abs(pooled.d1 - loc.d1) >= 0.1 AS shifted FROM pooled JOIN loc USING (t)", "t shifted", "pooled local", SUP)
reg.add("d1_over_targets", lambda s, d: support.over_targets(support.pooled_zero_gap(*support_sides(s, d))), "SELECT avg(d1) AS equal_mean, sum(d1 * cells) / sum(cells) AS cell_mean, count(*) AS targets FROM pooled", "targets", "equal_mean cell_mean", SUP)
reg.add("d2_pooled", lambda s, d: scoring.wasserstein((x := support_sides(s, d))[0].select("t", F.lit("a").alias("side"), (F.col("count") / F.col("n")).alias("value"), F.lit(1.0).alias("weight")).unionByName(x[1].select("t", F.lit("b").alias("side"), (F.col("c") / F.col("n")).alias("value"), F.lit(1.0).alias("weight"))), ["t"]), W1_OUT, "t", "distance",
        SUP + ", wv AS (SELECT t, value, sum(wa) AS wa, sum(wb) AS wb FROM (SELECT t, count / n AS value, 1.0::DOUBLE AS wa, 0.0::DOUBLE AS wb FROM ev UNION ALL SELECT t, c / n, 0, 1 FROM ob) GROUP BY t, value), cu AS (SELECT t, value, sum(wa) OVER o / sum(wa) OVER p - sum(wb) OVER o / sum(wb) OVER p AS f, lead(value) OVER o - value AS step FROM wv WINDOW o AS (PARTITION BY t ORDER BY value), p AS (PARTITION BY t))")


def local_sides(s, d):
    asked, seen = support_sides(s, d)
    sup = support.support(asked.drop("n", "count"), seen)
    a = asked.join(sup.where("supported").select("row_id", "t"), ["row_id", "t"]).select("t", F.lit("a").alias("side"), (F.col("count") / F.col("n")).alias("value"), F.lit(1.0).alias("weight"))
    return a.unionByName(support.reference_weights(sup, seen).select("t", F.lit("b").alias("side"), (F.col("c") / F.col("n")).alias("value"), "weight"))


reg.add("d2_local", lambda s, d: scoring.wasserstein(local_sides(s, d), ["t"]), W1_OUT, "t", "distance",
        SUP + ", wv AS (SELECT t, value, sum(wa) AS wa, sum(wb) AS wb FROM (SELECT t, count / n AS value, 1.0::DOUBLE AS wa, 0.0::DOUBLE AS wb FROM ev JOIN ok USING (row_id, t) WHERE supported UNION ALL SELECT rf.t, rf.c / ob.n, 0, 1.0 / refs FROM rf JOIN ok USING (row_id, t) JOIN ob ON ob.row_id = rf.ref AND ob.t = rf.t WHERE supported) GROUP BY t, value), cu AS (SELECT t, value, sum(wa) OVER o / sum(wa) OVER p - sum(wb) OVER o / sum(wb) OVER p AS f, lead(value) OVER o - value AS step FROM wv WINDOW o AS (PARTITION BY t ORDER BY value), p AS (PARTITION BY t))")
reg.add("d3_flags", lambda s, d: support.outside_support(*support_sides(s, d)), "SELECT t, count(*) FILTER (flag) AS flagged, count(*) AS cells, coalesce(sum(count / n) FILTER (flag), 0) AS mass FROM (SELECT ev.*, count >= 0.5 AND (days < lo OR days > hi) AS flag FROM ev JOIN (SELECT t, min(days) FILTER (c > 0) AS lo, max(days) FILTER (c > 0) AS hi FROM ob GROUP BY t) USING (t)) GROUP BY t", "t flagged cells", "mass", SUP)


def visible_cells(s, d):
    """Cells that the masks of the prediction table leave visible, by seed."""
    return pn.cells(scoring.hidden_cells(pn.orders_panel(s, d), "random_cell", 0.1, SEEDS), by=("seed",)).where("c is not null")


def case_rows(s, d):
    """Per seed and model its error, and as the diagnostic D1, which needs no truth."""
    rates = visible_cells(s, d).groupBy("seed", "t").agg(F.avg((F.col("c") < 0.5).cast("double")).alias("zero"))
    order = F.array_position(F.array(*(F.lit(m) for m in MODELS)), F.col("model"))
    return runs(s, d).withColumnRenamed("mae_prop", "error").join(cases.zero_gap(predicted(s, d), rates), KEY).withColumn("ord", order)


def flagged(s, d):
    """Prediction rows with the flag of the days of positive visible counts."""
    positive = F.when(F.col("c") > 0, F.col("days"))
    spans = visible_cells(s, d).groupBy("seed", "t").agg(F.min(positive).alias("first_day"), F.max(positive).alias("last_day"))
    return cases.outside_span(predicted(s, d), spans)


CASE = SCORES + ", zr AS (SELECT seed, t, avg((v < 0.5)::INTEGER) AS zero FROM vs WHERE v IS NOT NULL GROUP BY seed, t), dg AS (SELECT model, seed, sum(k * abs(x - zero)) / sum(k) AS diagnostic FROM (SELECT model, seed, t, count(*) AS k, avg((pred_count < 0.5)::INTEGER) AS x FROM pred WHERE model_cell GROUP BY ALL) JOIN zr USING (seed, t) GROUP BY ALL), cs AS (SELECT model, seed, mae_prop AS error, diagnostic, list_position(['zero_fill', 'mean_fill', 'same_day_mean'], model) AS ord FROM runs JOIN dg USING (model, seed)), pw AS (SELECT x.seed, x.model AS a, y.model AS b, CASE WHEN abs(x.error - y.error) < 1e-3 THEN 'tie' WHEN x.diagnostic <> y.diagnostic AND sign(x.diagnostic - y.diagnostic) = sign(x.error - y.error) THEN 'match' ELSE 'mismatch' END AS verdict FROM cs x JOIN cs y ON x.seed = y.seed AND x.ord < y.ord), ag AS (SELECT seed, avg((verdict = 'match')::INTEGER) FILTER (verdict <> 'tie') AS rate, count(*) FILTER (verdict <> 'tie') AS decided FROM pw GROUP BY seed), rg AS (SELECT seed, arg_min(model, [diagnostic, ord]) AS chosen, arg_min(error, [diagnostic, ord]) - min(error) AS regret FROM cs GROUP BY seed)"
reg.add("tier3_pairwise", lambda s, d: cases.pairwise(case_rows(s, d)), "SELECT * FROM pw", "seed a b verdict", "", CASE)
reg.add("tier3_agreement", lambda s, d: cases.agreement(cases.pairwise(case_rows(s, d))), "SELECT * FROM ag", "seed decided", "rate", CASE)
reg.add("tier3_regret", lambda s, d: cases.regret(case_rows(s, d)), "SELECT * FROM rg", "seed chosen", "regret", CASE)
reg.add("tier3_verdict", lambda s, d: cases.verdict(cases.agreement(cases.pairwise(r := case_rows(s, d))), cases.regret(r)), "SELECT *, CASE WHEN cases < 4 THEN 'insufficient' WHEN mean_rate >= 0.8 AND least_rate >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict, small_regret >= 9 AS regret_ok FROM (SELECT count(rate) AS cases, avg(rate) AS mean_rate, min(rate) AS least_rate FROM ag), (SELECT count(*) FILTER (regret <= 0.005) AS small_regret, count(*) AS regrets FROM rg)", "cases small_regret regrets verdict regret_ok", "mean_rate least_rate", CASE)
FLAGGED = PRED + ", sn AS (SELECT seed, t, min(days) FILTER (v > 0) AS lo, max(days) FILTER (v > 0) AS hi FROM vs GROUP BY seed, t), fg AS (SELECT pred.*, lo IS NULL OR row_id % 100000 < lo OR row_id % 100000 > hi AS flag FROM pred JOIN sn USING (seed, t) WHERE pred_count >= 0.5), gp AS (SELECT model, seed, count(*) FILTER (flag) AS flagged, count(*) FILTER (NOT flag) AS unflagged, avg(truth_zero::INTEGER) FILTER (flag) AS p_flagged, avg(truth_zero::INTEGER) FILTER (NOT flag) AS p_unflagged, avg(truth_zero::INTEGER) FILTER (flag) - avg(truth_zero::INTEGER) FILTER (NOT flag) AS gap FROM fg GROUP BY model, seed)"
reg.add("tier3_flag_precision", lambda s, d: cases.flag_precision(flagged(s, d)), "SELECT * FROM gp", "model seed flagged unflagged", "p_flagged p_unflagged gap", FLAGGED)
reg.add("tier3_flag_verdict", lambda s, d: cases.flag_verdict(cases.flag_precision(flagged(s, d))), "SELECT count(gap) AS cases, count(*) FILTER (gap >= 0.2) AS good, CASE WHEN count(gap) < 9 THEN 'insufficient' WHEN count(*) FILTER (gap >= 0.2) >= 9 THEN 'pass' ELSE 'fail' END AS verdict FROM gp", "cases good verdict", "", FLAGGED)
reg.add("hypothesis_better", lambda s, d: cases.hypothesis(scoring.pairs(runs(s, d)), "same_day_mean", "mean_fill"), f"SELECT 'same_day_mean' AS model, 'mean_fill' AS against, -mean_diff AS mean_diff, p, -mean_diff < 0 AND p <= 0.05 AS better, NOT (-mean_diff > 0 AND p <= 0.05) AS not_worse FROM (SELECT *, {SIGN} FROM ({PAIR})) WHERE a = 'mean_fill' AND b = 'same_day_mean'", "model against better not_worse", "mean_diff p", SCORES + ", fr AS (SELECT * FROM runs)")

# --- sequences and older measures -----------------------------------------------------


def order_cells(s, d):
    return pn.cells(pn.orders_panel(s, d))


reg.add("locf", lambda s, d: sequences.carried(order_cells(s, d), leading=False).select("row_id", "t", "carried"), "SELECT row_id, t, last_value(c IGNORE NULLS) OVER (PARTITION BY e, t ORDER BY days ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM cells", "row_id t", "carried", ORDERS)
reg.add("nocb", lambda s, d: sequences.carried(order_cells(s, d)).select("row_id", "t", "carried"), "SELECT row_id, t, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY e, t ORDER BY days ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(c IGNORE NULLS) OVER (PARTITION BY e, t ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS carried FROM cells", "row_id t", "carried", ORDERS)
reg.add("linear_interpolation", lambda s, d: sequences.interpolated(order_cells(s, d)).select("row_id", "t", "line"), "SELECT row_id, t, coalesce(c, CASE WHEN p IS NULL THEN qv WHEN q IS NULL THEN pv ELSE pv + (qv - pv) * (days - p) / (q - p) END) AS line FROM (SELECT *, max(CASE WHEN c IS NOT NULL THEN days END) OVER b AS p, last_value(c IGNORE NULLS) OVER b AS pv, min(CASE WHEN c IS NOT NULL THEN days END) OVER f AS q, first_value(c IGNORE NULLS) OVER f AS qv FROM cells WINDOW b AS (PARTITION BY e, t ORDER BY days ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY e, t ORDER BY days ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", "row_id t", "line", ORDERS)
reg.add("sequence_segments", lambda s, d: sequences.segments(pn.events_panel(s, d), 3, 7), "SELECT row_id, e, island, floor((nth - 1) / 3)::BIGINT AS segment, (nth - 1) % 3 AS place FROM (SELECT *, row_number() OVER (PARTITION BY e, island ORDER BY days) AS nth FROM (SELECT row_id, e, days, (sum(new) OVER (PARTITION BY e ORDER BY days))::BIGINT AS island FROM (SELECT row_id, e, days, CASE WHEN days - lag(days) OVER (PARTITION BY e ORDER BY days) <= 7 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT row_id, e, days FROM cells))))", "row_id e island segment place", "", EVENTS)
reg.add("pack_unpack", lambda s, d: sequences.unpacked(sequences.packed(pn.orders_panel(s, d), 96)).select("row_id", "days", F.posexplode("c").alias("t", "c")), "SELECT row_id, days, t, c FROM cells", "row_id days t", "c", ORDERS)
reg.add("missingness_patterns", lambda s, d: sequences.pattern_audit(pn.orders_panel(s, d)), "SELECT e, count(DISTINCT bits) AS patterns, 0 + bit_count(bit_and(bits))::INTEGER AS always, (bit_count(bit_or(bits)) - bit_count(bit_and(bits)))::INTEGER AS sometimes FROM (SELECT e, row_id, sum(CASE WHEN c IS NULL THEN 1 << t ELSE 0 END)::INTEGER AS bits FROM cells GROUP BY e, row_id) GROUP BY e", "e patterns always sometimes", "", ORDERS)
reg.add("prevalence_bins", lambda s, d: sequences.prevalence_bins(pn.cells(pn.events_panel(s, d))), "SELECT t, prevalence, ['rare', 'middle', 'common'][1 + floor((row_number() OVER (ORDER BY prevalence, t) - 1) * 3 / count(*) OVER ())::INTEGER] AS bin FROM (SELECT t, avg((c > 0)::INTEGER) AS prevalence FROM cells WHERE c IS NOT NULL GROUP BY t)", "t bin", "prevalence", EVENTS)
reg.add("detection_prepared", lambda s, d: sequences.detection_prepared(pn.orders_panel(s, d), 2.0, 0.5).select("row_id", F.posexplode("x").alias("t", "x")), "SELECT row_id, t, v / sum(v) OVER (PARTITION BY row_id) AS x FROM (SELECT row_id, t, CASE WHEN c < 2 THEN 0 ELSE c END + 0.5 AS v, count(c) OVER (PARTITION BY row_id) AS k FROM cells) WHERE k = 4", "row_id t", "x", ORDERS)


def filled_pairs(s, d):
    """Complete months beside the mean of their nation: a truth and a filling, both positive."""
    base = panels.shares(s, d)
    mean = base.groupBy("e").agg(F.array(*(F.avg(F.get("p", F.lit(j))) for j in range(5))).alias("q"))
    return base.join(mean, "e")


M = f"{panels.FULL}, k AS (SELECT DISTINCT row_id, e FROM full_cells), f AS (SELECT e, [" + ", ".join(f"avg(p[{j}])" for j in range(1, 6)) + "] AS q FROM k JOIN q USING (row_id) GROUP BY e), b AS (SELECT row_id, p, f.q, z, list_transform(f.q, lambda v: ln(v)) AS gq FROM k JOIN z USING (row_id) JOIN f USING (e)), dd AS (SELECT row_id, p, q, list_transform([1, 2, 3, 4, 5], lambda i: z[i] - gq[i] + list_sum(gq) / 5) AS df FROM b)"
reg.add("m1_m2", lambda s, d: sequences.clr_errors(filled_pairs(s, d), F.col("p"), F.col("q")).select("row_id", "clr_mae", "aitchison2"), "SELECT row_id, list_sum(list_transform(df, lambda v: abs(v))) / 5 AS clr_mae, list_sum(list_transform(df, lambda v: v * v)) AS aitchison2 FROM dd", "row_id", "clr_mae aitchison2", M)
reg.add("m3_covariance_gap", lambda s, d: sequences.covariance_gap(filled_pairs(s, d), [F.get("p", F.lit(j)) for j in range(5)], [F.get("q", F.lit(j)) for j in range(5)]), "SELECT sqrt(" + " + ".join(f"(covar_samp(p[{i}], p[{j}]) - covar_samp(q[{i}], q[{j}])) ** 2" for i in range(1, 6) for j in range(1, 6)) + ") AS gap FROM dd", "", "gap", M)
reg.add("shannon", lambda s, d: panels.shares(s, d).select("row_id", sequences.shannon(F.col("p")).alias("entropy")), "SELECT row_id, -list_sum(list_transform(p, lambda v: v * ln(v))) AS entropy FROM q", "row_id", "entropy", panels.FULL)
reg.add("self_masking", lambda s, d: sequences.masked_by_value(order_cells(s, d), 0.75, uniform(F.col("e"), F.col("days"), F.col("t"), TRAIN), 0.5).where("gone").select("row_id", "t"), f"SELECT row_id, t FROM cells JOIN (SELECT t, quantile_cont(c, 0.75) AS q FROM cells GROUP BY t) USING (t) WHERE c > q AND {u('e', 'days', 't', TRAIN)} < 0.5", "row_id t", "", ORDERS)

# --- sources ------------------------------------------------------------------------


def raw_texts(s, d):
    """Customers as a table of texts with blanks, repeats and wrong totals by their key."""
    k = F.col("c_custkey")
    return pn.read(s, d, "customer").select(F.when(k % 97 == 0, "").otherwise(F.concat(F.lit("c"), (k - F.when(k % 89 == 0, 1).otherwise(0)).cast("string"))).alias("entity"), F.lit("1995-01-01").alias("time"), F.when(k % 83 == 0, 0.0).otherwise(10.0).alias("n"), F.array((k % 11).cast("double"), F.lit(1.0)).alias("c"))


reg.add("load_violations", lambda s, d: tables.violations(raw_texts(s, d)).groupBy("code").agg(F.count(F.lit(1)).alias("rows")),
        "SELECT code, count(*) AS rows FROM (SELECT CASE WHEN entity = '' THEN 'empty_entity' WHEN n <= 0 THEN 'total_not_positive' WHEN c > n THEN 'counts_exceed_total' END AS code FROM r UNION ALL SELECT 'repeated_key' FROM (SELECT entity FROM r GROUP BY entity HAVING count(*) > 1)) WHERE code IS NOT NULL GROUP BY code", "code rows", "",
        "r AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN '' ELSE 'c' || (c_custkey - CASE WHEN c_custkey % 89 = 0 THEN 1 ELSE 0 END)::VARCHAR END AS entity, CASE WHEN c_custkey % 83 = 0 THEN 0.0 ELSE 10.0 END AS n, c_custkey % 11 + 1.0 AS c FROM customer)")


def mapping(s, d):
    """Nation to region, without the nations of one region."""
    return pn.read(s, d, "nation").join(pn.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(F.col("n_name").alias("entity"), "r_name")


MAP = f"{ORDERS}, mp AS (SELECT n_name AS entity, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')"
reg.add("group_map_join", lambda s, d: tables.with_groups(pn.orders_full(s, d).drop("grp"), mapping(s, d), "r_name").groupBy("grp").agg(F.count(F.lit(1)).alias("rows")), "SELECT r_name AS grp, count(*) AS rows FROM op LEFT JOIN mp USING (entity) GROUP BY r_name", "grp rows", "", MAP)
reg.add("unknown_entities", lambda s, d: tables.unknown_entities(pn.orders_full(s, d), mapping(s, d)), "SELECT DISTINCT entity FROM op WHERE entity NOT IN (SELECT entity FROM mp)", "entity", "", MAP)


def kinds(s, d):
    orders = pn.read(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("german"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("name"))
    out = None
    for column, fmt in (("day", None), ("german", "dd.MM.yyyy"), ("key", None), ("name", None)):
        rows, kind = tables.parse_times(orders, column, fmt)
        one = rows.agg(F.lit(column).alias("source"), F.lit(kind).alias("kind"), F.min("days").cast("double").alias("least"), F.max("days").cast("double").alias("most"), F.countDistinct("days").alias("times"))
        out = one if out is None else out.unionByName(one)
    return out


_DAY = "date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)))::DOUBLE"
reg.add("time_kinds", kinds, f"SELECT s.source, 'date' AS kind, 0.0 AS least, {_DAY} AS most, count(DISTINCT CAST(o_orderdate AS DATE)) AS times FROM orders, (SELECT unnest(['day', 'german']) AS source) s GROUP BY s.source UNION ALL SELECT 'key', 'numeric', min(o_orderkey), max(o_orderkey), count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'name', 'label', 0, count(DISTINCT o_orderpriority) - 1, count(DISTINCT o_orderpriority) FROM orders", "source kind times", "least most")
reg.add("cell_parser", lambda s, d: pn.read(s, d, "supplier").select(F.element_at(F.array(*(F.lit(x) for x in (" NA ", "nan", "", "1.5", "-2", "1e3", "1d", "inf", "1_0", "7"))), (F.col("s_suppkey") % 10 + 1).cast("int")).alias("text")).select("text", tables.number(F.col("text")).alias("value"), tables.cell_code(F.col("text")).alias("code")).groupBy("text", "value", "code").agg(F.count(F.lit(1)).alias("rows")),
        "SELECT k.text, k.value, k.code, count(*) AS rows FROM supplier JOIN (VALUES (0, ' NA ', NULL, NULL), (1, 'nan', NULL, NULL), (2, '', NULL, NULL), (3, '1.5', 1.5, NULL), (4, '-2', -2.0, 'negative'), (5, '1e3', 1000.0, NULL), (6, '1d', NULL, 'not_a_number'), (7, 'inf', NULL, 'not_a_number'), (8, '1_0', NULL, 'not_a_number'), (9, '7', 7.0, NULL)) k(i, text, value, code) ON s_suppkey % 10 = i GROUP BY ALL", "text code rows", "value")
