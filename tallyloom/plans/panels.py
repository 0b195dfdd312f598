"""Queries on panels, masks and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.functions import compositions as co
from tallyloom.functions.hashing import uniform
from tallyloom.operators import imputers, masking, residual
from tallyloom.plans.registry import Registry
from tallyloom.plans.sqltext import ANCHOR, EVENTS, HIDE, ORDER, ORDERS, POOL, ROWS, u

reg = Registry()
CELL = "row_id entity grp days t"
BASE = f"{ORDERS}, {ROWS}"
RATE, SEED = 0.1, 3


def cell_rows(df):
    return df.select("row_id", "entity", "grp", "days", "t", "n", "c")


reg.add("panel_orders_cells", lambda s, d: cell_rows(pn.cells(pn.orders_panel(s, d))), "SELECT row_id, entity, grp, days, t, n, c FROM cells", CELL, "n c", ORDERS)
reg.add("panel_events_cells", lambda s, d: cell_rows(pn.cells(pn.events_panel(s, d))), "SELECT row_id, entity, grp, days, t, n, c FROM cells", CELL, "n c", EVENTS)
reg.add("missing_pattern_counts", lambda s, d: pn.orders_panel(s, d).groupBy(F.array_join(F.transform("c", lambda v: F.when(v.isNull(), "0").otherwise("1")), "").alias("pattern")).agg(F.count(F.lit(1)).alias("rows")),
        "SELECT pattern, count(*) AS rows FROM (SELECT row_id, string_agg(CASE WHEN c IS NULL THEN '0' ELSE '1' END, '' ORDER BY t) AS pattern FROM cells GROUP BY row_id) GROUP BY pattern", "pattern rows", "", ORDERS)
reg.add("model_input", lambda s, d: pn.model_input(pn.orders_panel(s, d)).select("row_id", F.posexplode("x").alias("t", "x")), "SELECT row_id, t, x FROM x", "row_id t", "x", BASE)
reg.add("delta_min_positive", lambda s, d: pn.half_least_positive(pn.orders_panel(s, d)).crossJoin(F.broadcast(pn.half_least_positive(pn.orders_panel(s, d), False).withColumnRenamed("delta", "targets_only"))),
        "SELECT delta, (SELECT min(c / n) FILTER (c > 0) / 2 FROM cells) AS targets_only FROM delta", "", "delta targets_only", BASE)
reg.add("complete_rows", lambda s, d: pn.orders_panel(s, d).where(co.complete(F.col("c"))).select("row_id", pn.other().alias("other")), "SELECT row_id, resid / n AS other FROM rows_ WHERE seen = 4", "row_id", "other", BASE)
reg.add("forced_zero_cells", lambda s, d: pn.cells(pn.events_panel(s, d).withColumn("z", pn.forced_zero()), "z").where("z").select("row_id", "t"),
        "SELECT row_id, t FROM cells JOIN rows_ USING (row_id) WHERE c IS NULL AND resid = 0", "row_id t", "", f"{EVENTS}, {ROWS}")
reg.add("closure_audit", lambda s, d: pn.orders_panel(s, d).groupBy("grp").agg(F.count_if(pn.residual() == 0).alias("closed"), F.count_if(pn.residual() < 0).alias("over"), F.avg(pn.known_sum() / F.col("n")).alias("mean_known"), F.max(pn.known_sum() / F.col("n")).alias("max_known")),
        "SELECT grp, count(*) FILTER (resid = 0) AS closed, count(*) FILTER (resid < 0) AS over, avg(known / n) AS mean_known, max(known / n) AS max_known FROM rows_ GROUP BY grp", "grp closed over", "mean_known max_known", BASE)


# --- compositional functions on complete rows ---------------------------------

FULL = f"""{ORDERS}, r AS (SELECT row_id, any_value(n) AS n, sum(truth) AS s, list(truth ORDER BY t) AS l FROM full_cells GROUP BY row_id),
q AS (SELECT row_id, list_transform(list_append(l, n - s), lambda v: (v + 0.5) / (n + 2.5)) AS p FROM r),
lg AS (SELECT row_id, p, list_transform(p, lambda v: ln(v)) AS g FROM q),
z AS (SELECT row_id, p, list_transform(g, lambda v: v - list_sum(g) / 5) AS z FROM lg)"""


def shares(s, d):
    """Five parts, half a count added to each: positive and closed."""
    parts = F.concat("c", F.array(F.col("n") - pn.known_sum()))
    return pn.orders_full(s, d).select("row_id", "e", "days", F.transform(parts, lambda v: (v + 0.5) / (F.col("n") + 2.5)).alias("p"))


def long(df, x, name="value"):
    return df.select("row_id", F.posexplode(x).alias("part", name))


reg.add("closure", lambda s, d: long(pn.orders_full(s, d), co.closure(F.concat("c", F.array(F.lit(1.0))))), "SELECT row_id, i AS part, list_append(l, 1.0)[i + 1] / (s + 1) AS value FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS i)", "row_id part", "value", FULL)
reg.add("clr", lambda s, d: long(shares(s, d), co.clr(F.col("p"))), "SELECT row_id, i AS part, z[i + 1] AS value FROM z, (SELECT unnest([0, 1, 2, 3, 4]) AS i)", "row_id part", "value", FULL)
reg.add("softmax_of_clr", lambda s, d: long(shares(s, d), co.softmax(co.clr(F.col("p")))), "SELECT row_id, i AS part, p[i + 1] AS value FROM q, (SELECT unnest([0, 1, 2, 3, 4]) AS i)", "row_id part", "value", FULL)
reg.add("ilr", lambda s, d: long(shares(s, d), co.ilr(F.col("p"), 5)),
        "SELECT row_id, k - 1 AS part, sqrt((5 - k) / (6.0 - k)) * (z[k] - list_sum(z[k + 1:5]) / (5 - k)) AS value FROM z, (SELECT unnest([1, 2, 3, 4]) AS k)", "row_id part", "value", FULL)
reg.add("ilr_round_trip", lambda s, d: long(shares(s, d), co.ilr_inverse(co.ilr(F.col("p"), 5), 5)), "SELECT row_id, i AS part, p[i + 1] AS value FROM q, (SELECT unnest([0, 1, 2, 3, 4]) AS i)", "row_id part", "value", FULL)


def neighbours(s, d):
    """Each row beside the same nation's first month."""
    base = shares(s, d)
    first = base.groupBy("e").agg(F.min_by("p", "days").alias("q"))
    return base.join(first, "e")


NEXT = f"""{FULL}, k AS (SELECT DISTINCT row_id, e, days FROM full_cells), f AS (SELECT e, arg_min(p, days) AS q, arg_min(z, days) AS y FROM k JOIN z USING (row_id) GROUP BY e),
both_ AS (SELECT row_id, p, q, z, y FROM z JOIN k USING (row_id) JOIN f USING (e))"""
reg.add("jsd_to_first", lambda s, d: neighbours(s, d).select("row_id", co.jsd(F.col("p"), F.col("q")).alias("jsd")),
        "SELECT row_id, greatest(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: p[i] * ln(2 * p[i] / (p[i] + q[i])) + q[i] * ln(2 * q[i] / (p[i] + q[i])))), 0) AS jsd FROM both_", "row_id", "jsd", NEXT)
reg.add("aitchison_to_first", lambda s, d: neighbours(s, d).select("row_id", co.aitchison(F.col("p"), F.col("q")).alias("distance")),
        "SELECT row_id, sqrt(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: (z[i] - y[i]) ** 2))) AS distance FROM both_", "row_id", "distance", NEXT)
for _alpha, _name in ((1.0, "arithmetic"), (0.0, "geometric"), (0.5, "half_power")):
    _inner = {1.0: "avg(v)", 0.0: "exp(avg(ln(v)))", 0.5: "pow(avg(sqrt(v)), 2)"}[_alpha]
    reg.add(f"frechet_mean_{_name}", lambda s, d, a=_alpha: co.group_mean(shares(s, d), "e", "p", a),
            f"SELECT e, part, m / sum(m) OVER (PARTITION BY e) AS value FROM (SELECT e, part, {_inner} AS m FROM (SELECT e, i AS part, p[i + 1] AS v FROM k JOIN q USING (row_id), (SELECT unnest([0, 1, 2, 3, 4]) AS i)) GROUP BY e, part)", "e part", "value", NEXT)
reg.add("median_part", lambda s, d: shares(s, d).select("row_id", co.median_of(F.col("p")).alias("median"), co.median_of(F.slice("p", 1, 4)).alias("median_targets")),
        "SELECT row_id, list_median(p) AS median, list_median(p[1:4]) AS median_targets FROM q".replace("list_median", "list_aggregate").replace("list_aggregate(p)", "list_aggregate(p, 'median')").replace("list_aggregate(p[1:4])", "list_aggregate(p[1:4], 'median')"), "row_id", "median median_targets", FULL)

# --- masks --------------------------------------------------------------------

HIDDEN = f"""{BASE}, draw AS (
  SELECT row_id, e, days, t, n, truth, c, grp, entity, c IS NOT NULL AND {u("e", "days", "t", HIDE + SEED)} < {RATE} AS h, {u("e", "days", "t", ANCHOR + SEED)} AS a FROM cells
), anchored AS (
  SELECT *, count(*) FILTER (c IS NOT NULL AND NOT h) OVER (PARTITION BY row_id) AS stays,
         row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN c IS NULL THEN 1 ELSE 0 END, a, t) AS nth FROM draw
), masked AS (SELECT row_id, e, days, t, n, truth, c, grp, entity, h AND NOT (stays = 0 AND nth = 1) AS h FROM anchored)"""


def hidden_panel(s, d, rate=RATE, seed=SEED):
    return pn.orders_panel(s, d).withColumn("h", masking.random_cell(rate, seed))


reg.add("mask_random_cell", lambda s, d: pn.cells(hidden_panel(s, d), "h").where("h").select("row_id", "t"), "SELECT row_id, t FROM masked WHERE h", "row_id t", "", HIDDEN)
reg.add("mask_stats", lambda s, d: masking.statistics(pn.orders_panel(s, d), masking.random_cell(RATE, SEED)), """
SELECT sum(o)::BIGINT AS observed_cells, sum(k)::BIGINT AS hidden_cells, sum(k) / sum(o) AS actual_rate, count(*) FILTER (k > 0) AS rows_affected,
       count(*) FILTER (o = 4) AS complete_before, count(*) FILTER (o - k = 4) AS complete_after
FROM (SELECT row_id, count(c) AS o, count(*) FILTER (h) AS k FROM masked GROUP BY row_id)""", "observed_cells hidden_cells rows_affected complete_before complete_after", "actual_rate", HIDDEN)

SERIES = f"""{BASE}, series AS (SELECT e, t, count(c) AS size, {u("e", "0", "t", ORDER + SEED)} AS key FROM cells WHERE c IS NOT NULL GROUP BY e, t),
pat AS (SELECT DISTINCT e, bits FROM (SELECT e, row_id, sum(CASE WHEN c IS NULL THEN 0 ELSE 1 << t END)::INTEGER AS bits FROM cells GROUP BY e, row_id) WHERE bits > 0)"""


def fold(order: str) -> str:
    """The four draws of an entity one after the other, as chained tables."""
    text = f", dr AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY {order}, t) AS nth FROM series), a0 AS (SELECT DISTINCT e, 0 AS a FROM series)"
    for k in range(1, 5):
        text += f""", a{k} AS (SELECT a{k - 1}.e, CASE WHEN dr.t IS NULL OR EXISTS (SELECT 1 FROM pat WHERE pat.e = a{k - 1}.e AND (pat.bits & (1 << dr.t)) <> 0 AND (pat.bits & ~(a | (1 << dr.t))) = 0)
        THEN a ELSE a | (1 << dr.t) END AS a FROM a{k - 1} LEFT JOIN dr ON dr.e = a{k - 1}.e AND dr.nth = {k})"""
    return text + f""", acc AS (SELECT dr.*, (a4.a & (1 << t)) <> 0 AS accepted FROM dr JOIN a4 USING (e)),
    run AS (SELECT *, coalesce(sum(CASE WHEN accepted THEN size ELSE 0 END) OVER (ORDER BY {order}, e, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT count(c) FROM cells) * {RATE} AS goal FROM acc)"""


TAKEN = "SELECT e, t, size, accepted, accepted AND before < goal AS taken FROM run"
reg.add("mask_whole_feature", lambda s, d: masking.whole_feature(pn.orders_panel(s, d), RATE, SEED).select("e", "t", "size", "accepted", "taken"), TAKEN, "e t size accepted taken", "", SERIES + fold("key"))

CUTS = f"""{BASE}, cut AS (SELECT quantile_cont(n, 1/3.0::DOUBLE) AS q1, quantile_cont(n, 2/3.0::DOUBLE) AS q2 FROM rows_ WHERE seen < 4 AND resid <> 0),
lab AS (SELECT row_id, grp || '|' || CASE WHEN n <= q1 THEN 'N1' WHEN n <= q2 THEN 'N2' ELSE 'N3' END AS stratum FROM rows_, cut),
po AS (SELECT stratum, count(*) / sum(count(*)) OVER () AS p FROM cells JOIN lab USING (row_id) WHERE c IS NOT NULL GROUP BY stratum),
pm AS (SELECT stratum, count(*) / sum(count(*)) OVER () AS pi FROM cells JOIN lab USING (row_id) JOIN rows_ r USING (row_id) WHERE c IS NULL AND resid <> 0 GROUP BY stratum),
wt AS (SELECT e, t, sum(coalesce(pi, 0) / p) AS w FROM cells JOIN lab USING (row_id) JOIN po USING (stratum) LEFT JOIN pm USING (stratum) WHERE c IS NOT NULL GROUP BY e, t)"""


def cut_panel(s, d):
    p = pn.orders_panel(s, d)
    return p.join(F.broadcast(masking.cuts(p)))


reg.add("n_tertiles", lambda s, d: masking.cuts(pn.orders_panel(s, d)), "SELECT q1, q2 FROM cut", "", "q1 q2", CUTS)
reg.add("strata_shares", lambda s, d: masking.shares(cut_panel(s, d), masking.model_decided()), "SELECT stratum, pi AS share FROM pm", "stratum", "share", CUTS)
reg.add("mask_matched_weights", lambda s, d: masking.matched_weights(pn.orders_panel(s, d)), "SELECT e, t, w FROM wt", "e t", "w", CUTS)
reg.add("mask_whole_feature_matched", lambda s, d: masking.whole_feature(p := pn.orders_panel(s, d), RATE, SEED, masking.matched_weights(p)).select("e", "t", "size", "accepted", "taken"), TAKEN, "e t size accepted taken", "",
        f"""{CUTS}, series AS (SELECT e, t, count(c) AS size, -ln(1 - {u("e", "0", "t", ORDER + SEED)}) / any_value(w) AS key FROM cells JOIN wt USING (e, t) WHERE c IS NOT NULL AND w > 0 GROUP BY e, t),
        pat AS (SELECT DISTINCT e, bits FROM (SELECT e, row_id, sum(CASE WHEN c IS NULL THEN 0 ELSE 1 << t END)::INTEGER AS bits FROM cells GROUP BY e, row_id) WHERE bits > 0)""" + fold("key"))
reg.add("total_variation", lambda s, d: masking.total_variation(masking.shares(cut_panel(s, d), masking.observed()), masking.shares(cut_panel(s, d), masking.model_decided())),
        "SELECT sum(abs(coalesce(p, 0) - coalesce(pi, 0))) / 2 AS tv FROM po FULL JOIN pm USING (stratum)", "", "tv", CUTS)
reg.add("n_strata_rows", lambda s, d: cut_panel(s, d).groupBy(masking.stratum().alias("stratum")).agg(F.count(F.lit(1)).alias("rows")), "SELECT stratum, count(*) AS rows FROM lab GROUP BY stratum", "stratum rows", "", CUTS)
reg.add("cell_split", lambda s, d: pn.cells(hidden_panel(s, d).withColumn("z", F.transform(F.zip_with("c", "h", lambda v, h: F.when(~h, v)), lambda v: v.isNull() & (F.col("n") - co.total(F.zip_with("c", "h", lambda w, h: F.when(~h, w))) == 0))), "h", "z").where("h or c is null").groupBy(F.when(F.col("h"), "hidden").otherwise("missing").alias("origin"), F.when(F.col("z"), "forced").otherwise("model").alias("kind")).agg(F.count(F.lit(1)).alias("cells")), """
SELECT CASE WHEN h THEN 'hidden' ELSE 'missing' END AS origin, CASE WHEN n - vis = 0 THEN 'forced' ELSE 'model' END AS kind, count(*) AS cells
FROM (SELECT *, coalesce(sum(CASE WHEN NOT h THEN c END) OVER (PARTITION BY row_id), 0) AS vis FROM masked) WHERE h OR c IS NULL GROUP BY ALL""", "origin kind cells", "", HIDDEN)

# --- imputers and budgets --------------------------------------------------------


def completed(df):
    return df.select("row_id", F.posexplode("filled").alias("t", "count"))


def budget(proposed: str, rule: str) -> str:
    """Completed counts from a table prop (row_id, t, p) under a rule, as chained tables."""
    own = "greatest(1 - allp, 0)"
    value = {
        "cap": "p * n * CASE WHEN s > lft THEN lft / s ELSE 1 END",
        "rescale": "p * n * CASE WHEN s > 0 THEN lft / s ELSE 1 END",
        "prop_other": f"CASE WHEN resid = 0 THEN 0 WHEN s + {own} > 0 THEN resid * p / (s + {own}) END",
    }[rule]
    return f""", prop AS ({proposed}), asked AS (
      SELECT c.row_id, c.t, c.n, c.c, r.resid, greatest(r.resid / c.n, 0) AS lft, CASE WHEN c.c IS NULL THEN coalesce(p, 0) ELSE 0 END AS p, p AS raw FROM cells c JOIN rows_ r USING (row_id) LEFT JOIN prop USING (row_id, t)
    ), sums AS (SELECT *, sum(p) OVER (PARTITION BY row_id) AS s, coalesce(sum(raw) OVER (PARTITION BY row_id), 0) AS allp FROM asked),
    done AS (SELECT row_id, t, n, resid, coalesce(c, {value}) AS count FROM sums)"""


DONE = "SELECT row_id, t, count FROM done"
MEAN = "SELECT row_id, t, m AS p FROM cells JOIN (SELECT t, avg(c / n) AS m FROM cells GROUP BY t) USING (t)"
reg.add("zero_fill", lambda s, d: completed(residual.fill(imputers.zero_fill(pn.orders_panel(s, d)))), "SELECT row_id, t, coalesce(c, 0) AS count FROM cells", "row_id t", "count", BASE)
for _rule, _name in (("cap", "mean_fill"), ("rescale", "residual_rescale"), ("prop_other", "residual_prop_other")):
    reg.add(_name, lambda s, d, r=_rule: completed(residual.fill(imputers.mean_fill(pn.orders_panel(s, d)), r)), DONE, "row_id t", "count", BASE + budget(MEAN, _rule))
reg.add("residual_cap", lambda s, d: completed(residual.fill(imputers.mean_fill(pn.events_panel(s, d)), "cap")), DONE, "row_id t", "count", f"{EVENTS}, {ROWS}" + budget(MEAN, "cap"))
reg.add("residual_violations", lambda s, d: residual.violations(residual.fill(imputers.mean_fill(pn.orders_panel(s, d)))).groupBy("code").agg(F.count(F.lit(1)).alias("rows")),
        "SELECT code, count(*) AS rows FROM (SELECT row_id, CASE WHEN sum(count) > any_value(n) + 1e-10 * any_value(n) THEN 'over_total' WHEN min(count) < 0 THEN 'negative' END AS code FROM done GROUP BY row_id) WHERE code IS NOT NULL GROUP BY code", "code rows", "", BASE + budget(MEAN, "cap"))
DRAWN = f"""SELECT row_id, t, q.p FROM (SELECT row_id, t, least(floor({u("e", "days", "t", POOL)} * len), len - 1) AS place FROM cells JOIN (SELECT t, count(c) AS len FROM cells GROUP BY t) USING (t) WHERE c IS NULL) a
JOIN (SELECT t, c / n AS p, row_number() OVER (PARTITION BY t ORDER BY row_id) - 1 AS place FROM cells WHERE c IS NOT NULL) q USING (t, place)"""
reg.add("marginal_sampler", lambda s, d: completed(residual.fill(imputers.marginal_sampler(pn.orders_panel(s, d)))), DONE, "row_id t", "count", BASE + budget(DRAWN, "cap"))


def same_day_sql(exclude=False, time=True, group=True, weighting="n", w=28, min_obs=20, widen=2, frames=None) -> str:
    """k, level and p of every missing cell by a plain self-join of cells."""
    a, b = ("c", "n") if weighting == "n" else ("c / n", "1.0")
    frames = frames or ([w << k for k in range(widen + 1)] if time else [None])
    near = " AND ".join(["q.t = o.t", "o.c IS NOT NULL"] + (["q.e <> o.e"] if exclude else []))
    same = "q.grp = o.grp" if group else "true"
    cols = ", ".join(f"count(*) FILTER ({same} AND {'abs(q.days - o.days) <= ' + str(f) if f is not None else 'true'}) AS k{i}, sum(o.{a.replace('/ n', '/ o.n')}) FILTER ({same} AND {'abs(q.days - o.days) <= ' + str(f) if f is not None else 'true'}) / nullif(sum({b.replace('n', 'o.n')}) FILTER ({same} AND {'abs(q.days - o.days) <= ' + str(f) if f is not None else 'true'}), 0) AS p{i}" for i, f in enumerate(frames))
    pick = lambda x, last: "CASE " + " ".join(f"WHEN k{i} >= {min_obs} THEN {x.format(i=i)}" for i in range(len(frames))) + f" ELSE {last} END"
    return f"""SELECT row_id, t, {pick("k{i}", "kall")} AS k, ({pick("{i}", str(len(frames)))})::INTEGER AS level, least(greatest({pick("p{i}", "pall")}, 0), 1) AS p FROM (
      SELECT q.row_id, q.t, {cols}, count(*) AS kall, sum(o.{a.replace("/ n", "/ o.n")}) / nullif(sum({b.replace("n", "o.n")}), 0) AS pall
      FROM cells q JOIN cells o ON {near} WHERE q.c IS NULL GROUP BY q.row_id, q.t)"""


VARIANTS = {
    "same_day_window": {},
    "same_day_exclude": {"exclude": True},
    "same_day_no_time": {"time": False},
    "same_day_no_group": {"group": False},
    "same_day_unweighted": {"weighting": "equal"},
}
for _name, _v in VARIANTS.items():
    _o = {"exclude_own": _v.get("exclude", False), "use_time": _v.get("time", True), "use_group": _v.get("group", True), "weighting": _v.get("weighting", "n")}
    reg.add(_name, lambda s, d, o=_o: imputers.same_day(pn.orders_panel(s, d), **o), same_day_sql(**_v), "row_id t k level", "p", BASE)
#: Months as numbers (0, 1, 2, 4 on both sides) and as labels (the same month only).
MONTHS = BASE + ", cells_ AS (SELECT * REPLACE (days // 30 AS days) FROM cells)"
for _name, _kind, _frames in (("same_day_numbers", "numeric", [0, 1, 2, 4]), ("same_day_labels", "label", [0])):
    reg.add(_name, lambda s, d, k=_kind: imputers.same_day(pn.orders_panel(s, d).withColumn("days", F.floor(F.col("days") / 30)), min_obs=8, max_widen=3, kind=k), same_day_sql(min_obs=8, frames=_frames).replace("cells q", "cells_ q").replace("cells o", "cells_ o"), "row_id t k level", "p", MONTHS)
reg.add("same_day_cascade", lambda s, d: completed(residual.fill(imputers.same_day_mean(pn.orders_panel(s, d), exclude_own=True))), DONE, "row_id t", "count", BASE + budget(same_day_sql(exclude=True), "cap"))
reg.add("same_day_levels", lambda s, d: imputers.same_day(pn.orders_panel(s, d), window_days=0, min_obs=6).rollup("t", "level").agg(F.count(F.lit(1)).alias("cells")),
        f"SELECT t, level, count(*) AS cells FROM ({same_day_sql(w=0, min_obs=6)}) GROUP BY ROLLUP (t, level)", "t level cells", "", BASE)
