"""Queries on exact quantiles, donors with medians and the choice of donors by nested folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.operators import folds
from tallyloom.operators.quantiles import quantiles
from tallyloom.plans.models import DIST
from tallyloom.plans.panels import BASE
from tallyloom.plans.registry import Registry
from tallyloom.plans.sqltext import ANCHOR, HIDE, u

reg = Registry()
RATE, SEED = 0.2, 0


def line_prices(s, d):
    """Price of a unit on each line: a table that grows, with ties."""
    return pn.read(s, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


reg.add("column_quantiles", lambda s, d: quantiles(line_prices(s, d), ["l_returnflag", "l_linestatus"], F.col("price"), 0.3, few=2000).select("l_returnflag", "l_linestatus", "n", "quantile"),
        "SELECT l_returnflag, l_linestatus, count(*) AS n, quantile_cont(l_extendedprice / l_quantity, 0.3) AS quantile FROM lineitem WHERE l_extendedprice / l_quantity IS NOT NULL GROUP BY ALL", "l_returnflag l_linestatus n", "quantile")

reg.add("hron_median_fallback", lambda s, d: folds.with_medians(pn.orders_panel(s, d)),
        "SELECT need.row_id, need.t, coalesce(p, md, 1) AS p, p IS NULL AS fallback FROM need LEFT JOIN (SELECT row_id, t, median(v / list_aggregate(ox, 'median') * list_aggregate(qx, 'median')) AS p FROM rk WHERE nth <= 8 GROUP BY row_id, t) g USING (row_id, t) LEFT JOIN (SELECT t, median(x) AS md FROM x WHERE x > 0 GROUP BY t) USING (t)",
        "row_id t fallback", "p", DIST)

#: Complete rows with hidden cells, distances to the rows of other entities once, folds as filters over them.
FOLDS = f"""{BASE}, dr AS (SELECT c.row_id, c.t, {u("c.e", "c.days", "c.t", HIDE + SEED)} < {RATE} AS h, {u("c.e", "c.days", "c.t", ANCHOR + SEED)} AS a FROM cells c JOIN rows_ USING (row_id) WHERE seen = 4),
hd AS (SELECT row_id, t FROM (SELECT *, bool_and(h) OVER (PARTITION BY row_id) AS every, row_number() OVER (PARTITION BY row_id ORDER BY a, t) AS nth FROM dr) WHERE h AND NOT (every AND nth = 1)),
lost AS (SELECT row_id, t FROM hd UNION SELECT row_id, 4 FROM hd),
xs AS (SELECT x.row_id, x.t, x.x, ln(x.x) AS g, r.e, r.entity, r.grp FROM x JOIN rows_ r USING (row_id) WHERE x.x IS NOT NULL),
dn AS (SELECT row_id AS donor, any_value(e) AS e, any_value(grp) AS grp, list(t ORDER BY t) AS ts, list(x ORDER BY t) AS xs, list(g ORDER BY t) AS gs, bit_or(1 << t) AS bits FROM xs GROUP BY row_id),
qn AS (SELECT row_id, any_value(e) AS e, any_value(grp) AS grp, list(t ORDER BY t) AS ts, list(x ORDER BY t) AS qx, list(g ORDER BY t) AS gs, bit_or(1 << t) AS bits FROM xs WHERE row_id IN (SELECT row_id FROM hd) AND (row_id, t) NOT IN (SELECT row_id, t FROM lost) GROUP BY row_id),
pr AS (SELECT q.row_id, q.grp AS home, d.grp AS dgrp, donor, d.bits AS ob, d.ts AS ots, d.xs AS oxs, qx, q.gs, list_transform(q.ts, lambda i: d.xs[list_position(d.ts, i)]) AS ox FROM qn q JOIN dn d ON q.e <> d.e AND (d.bits & q.bits) = q.bits),
pg AS (SELECT *, list_transform(ox, lambda v: ln(v)) AS og, list_sum(gs) / len(gs) AS m FROM pr),
ds AS (SELECT row_id, home, dgrp, donor, ob, ots, oxs, list_aggregate(qx, 'median') / list_aggregate(ox, 'median') AS scale, sqrt(list_sum(list_transform(range(1, len(gs) + 1), lambda i: (gs[i] - m - og[i] + list_sum(og) / len(og)) ** 2))) AS d FROM pg),
cd AS (SELECT ds.row_id, lost.t, home, dgrp, donor, d, oxs[list_position(ots, lost.t)] * scale AS v FROM ds JOIN lost ON lost.row_id = ds.row_id AND (ob & (1 << lost.t)) <> 0),
os AS (SELECT DISTINCT grp AS fold FROM rows_),
rk AS (SELECT fold, row_id, t, v, row_number() OVER (PARTITION BY fold, row_id, t ORDER BY round(d, 12), donor) AS nth FROM cd JOIN os ON fold <> home AND fold <> dgrp),
pk AS (SELECT fold, row_id, t, k, median(v) AS p FROM rk, (SELECT unnest([1, 3, 5, 8]) AS k) WHERE nth <= k GROUP BY ALL),
md AS (SELECT fold, t, median(x) AS md FROM xs JOIN os ON fold <> grp WHERE x > 0 GROUP BY ALL),
fl AS (SELECT os.fold, xs.row_id, entity, ks.k, xs.g, l.t IS NOT NULL AS gone, p IS NULL AS spare, ln(CASE WHEN l.t IS NULL THEN xs.x ELSE coalesce(p, md, 1) END) AS f
       FROM xs JOIN os ON fold <> grp CROSS JOIN (SELECT unnest([1, 3, 5, 8]) AS k) ks JOIN (SELECT DISTINCT row_id FROM hd) hq ON hq.row_id = xs.row_id LEFT JOIN lost l ON l.row_id = xs.row_id AND l.t = xs.t
       LEFT JOIN pk ON pk.fold = os.fold AND pk.row_id = xs.row_id AND pk.t = xs.t AND pk.k = ks.k LEFT JOIN md ON md.fold = os.fold AND md.t = xs.t),
ms AS (SELECT fold, row_id, entity, k, sum((f - g - mf) ** 2) AS m2, count(*) FILTER (gone) AS parts, count(*) FILTER (gone AND spare) AS fallbacks
       FROM (SELECT *, avg(f - g) OVER (PARTITION BY fold, row_id, k) AS mf FROM fl) GROUP BY ALL),
fs AS (SELECT fold, entity, k, avg(m2) AS m2, count(*) AS rows, sum(parts)::BIGINT AS parts, sum(fallbacks)::BIGINT AS fallbacks FROM ms GROUP BY ALL)"""
reg.add("hron_fold_scores", lambda s, d: folds.fold_scores(pn.orders_panel(s, d)), 'SELECT fold, entity, k, m2, rows, parts, fallbacks FROM fs', 'fold entity k rows parts fallbacks', "m2", FOLDS)
reg.add("hron_fold_choice", lambda s, d: folds.choice(folds.fold_scores(pn.orders_panel(s, d))),
        'SELECT fold, k, m2, folds FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(m2, 12), k) AS nth FROM (SELECT fold, k, avg(m2) AS m2, count(m2) AS folds FROM fs GROUP BY ALL)) WHERE nth = 1', 'fold k folds', "m2", FOLDS)
