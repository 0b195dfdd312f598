"""The query of the diagnosis at all levels and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.operators import diagnosis, masking
from tallyloom.plans import models
from tallyloom.plans.registry import Registry
from tallyloom.storage import saved

reg = Registry()


def levels(s, d):
    """The models of the prediction table under its masks, each seed a mask."""
    mask = F.concat(F.lit("random_cell "), F.col("seed").cast("string")).alias("mask")
    filled = models.predicted(s, d).where("model_cell").select(mask, "model", "t", "grp", "days", "n", F.col("pred_count").alias("count"))
    seen = saved(models.visible_cells(s, d).select(mask, "t", "grp", "days", "n", "c"), "visible")
    return diagnosis.diagnose(filled, seen, masking.cuts(pn.orders_panel(s, d)))


SIZE = "CASE WHEN n <= q1 THEN 'N1' WHEN n <= q2 THEN 'N2' ELSE 'N3' END"
THRICE = "SELECT *, 'all' AS kind, 'all' AS stratum FROM {0} UNION ALL SELECT *, 'group', grp FROM {0} UNION ALL SELECT *, 'size', size FROM {0}"
reg.add("diagnose_levels", levels,
        """SELECT CASE WHEN grouping(t) = 0 THEN 'target' WHEN grouping(seed) = 0 THEN 'mask' ELSE 'model' END AS level, CASE WHEN grouping(seed) = 0 THEN 'random_cell ' || seed END AS mask, model, kind, stratum, t, sum(cells)::BIGINT AS cells,
           avg(d1) AS equal, sum(d1 * cells) / sum(cells) FILTER (d1 IS NOT NULL) AS weighted, count(d1) AS targets, (CASE WHEN kind = 'all' OR sum(cells) >= 30 THEN sum(d3) END)::BIGINT AS d3_cells, CASE WHEN kind = 'all' OR sum(cells) >= 30 THEN sum(mass) END AS d3_mass
           FROM tg GROUP BY GROUPING SETS ((seed, model, kind, stratum, t), (seed, model, kind, stratum), (model, kind, stratum))""",
        "level mask model kind stratum t cells targets d3_cells", "equal weighted d3_mass",
        models.PRED + f""", cut AS (SELECT quantile_cont(n, 1/3.0::DOUBLE) AS q1, quantile_cont(n, 2/3.0::DOUBLE) AS q2 FROM rows_ WHERE seen < 4 AND resid <> 0),
        sp AS (SELECT seed, t, min(days) FILTER (v > 0) AS lo, max(days) FILTER (v > 0) AS hi FROM vs WHERE v IS NOT NULL GROUP BY ALL),
        fa AS (SELECT p.model, p.seed, p.t, p.grp, p.n, p.pred_count AS c, coalesce(p.pred_count >= 0.5 AND (vs.days < lo OR vs.days > hi), false) AS flag, {SIZE.replace("n <=", "p.n <=")} AS size FROM pred p JOIN vs USING (seed, row_id, t) JOIN sp USING (seed, t), cut WHERE model_cell),
        fk AS ({THRICE.format("fa")}), per AS (SELECT seed, model, t, kind, stratum, count(*) AS cells, avg((c < 0.5)::INTEGER) AS x, count(*) FILTER (flag) AS d3, coalesce(sum(c / n) FILTER (flag), 0) AS mass FROM fk GROUP BY ALL),
        oa AS (SELECT seed, t, grp, v, {SIZE} AS size FROM vs, cut WHERE v IS NOT NULL), ok AS ({THRICE.format("oa")}), ob AS (SELECT seed, t, kind, stratum, avg((v < 0.5)::INTEGER) AS y FROM ok GROUP BY ALL),
        tg AS (SELECT per.*, CASE WHEN kind = 'all' OR cells >= 30 THEN x - y END AS d1 FROM per LEFT JOIN ob USING (seed, t, kind, stratum))""")
