"""Queries on log-ratio regression with covariates and on trimmed fits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.operators import alr, trimmed
from tallyloom.plans import models
from tallyloom.plans.registry import Registry

reg = Registry()
PAIRWISE = alr.Options(fit_rows="pairwise", reference=0, max_iter=1)


def yearly(s, d):
    """The parts of the orders panel with the years since its first day as the covariate."""
    return models.prepared(s, d).withColumn("z", F.array(F.col("days") / 365.0))


def pairwise_fit(s, d):
    _, fitted = alr.first_fit(yearly(s, d), PAIRWISE)
    rows = [(j, fitted.supports[j], *map(float, beta)) for j, beta in enumerate(fitted.coefficients) if j != fitted.reference]
    return s.createDataFrame(rows, "t int, rows long, intercept double, slope double")


PAIRS = models.MIC + """, pf AS (SELECT a.t, count(*) AS rows, regr_intercept(ln(a.y / r.y), days / 365.0::DOUBLE) AS intercept, regr_slope(ln(a.y / r.y), days / 365.0::DOUBLE) AS slope
FROM yt a JOIN yt r ON a.row_id = r.row_id AND r.t = 0 JOIN rows_ k ON k.row_id = a.row_id WHERE a.t <> 0 AND a.y IS NOT NULL AND r.y IS NOT NULL GROUP BY a.t),
ew AS (SELECT yt.row_id, yt.t, y, exp(coalesce(intercept, 0) + coalesce(slope, 0) * days / 365.0::DOUBLE) AS e FROM yt JOIN rows_ k ON k.row_id = yt.row_id LEFT JOIN pf ON pf.t = yt.t)"""
reg.add("alr_pairwise_fit", pairwise_fit, "SELECT * FROM pf", "t rows", "intercept slope", PAIRS)
reg.add("alr_filled_once", lambda s, d: alr.fit(yearly(s, d), PAIRWISE)[0].select("row_id", F.posexplode("x").alias("t", "x")),
        "SELECT row_id, t, coalesce(y, greatest(0, 1 - coalesce(sum(y) OVER w, 0)) * e / sum(CASE WHEN y IS NULL THEN e END) OVER w) AS x FROM ew WINDOW w AS (PARTITION BY row_id)", "row_id t", "x", PAIRS)
# A fixed point of many rounds; the tests repeat it row by row in NumPy.
reg.add("alr_version_one", lambda s, d: alr.fit(yearly(s, d), alr.Options(version="v1", fit_rows="pairwise", max_iter=5))[0].select("row_id", F.posexplode("x").alias("t", "x")))


def trimmed_row(s, found):
    return s.createDataFrame([(*map(float, found.beta), float(found.objective), found.h, found.solver)], "intercept double, slope double, objective double, h int, solver string")


def year_shares(s, d):
    """The share of all orders by year: few rows, of which the last year isn't whole."""
    years = pn.read(s, d, "orders").groupBy((F.year("o_orderdate") - 1992).alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    total = pn.read(s, d, "orders").agg(F.count(F.lit(1)).alias("total"))
    return years.join(F.broadcast(total)).select("year", (F.col("orders") / F.col("total")).alias("share"))


reg.add("lts_every_choice", lambda s, d: trimmed_row(s, trimmed.lts(year_shares(s, d), [F.lit(1.0), F.col("year")], F.col("share"), F.col("year"))),
        "SELECT intercept, slope, objective, h, 'every_choice' AS solver FROM fits ORDER BY objective LIMIT 1", "h solver", "intercept slope objective",
        """ys AS (SELECT year(o_orderdate) - 1992 AS x, count(*) / sum(count(*)) OVER () AS v, row_number() OVER (ORDER BY x) - 1 AS place, count(*) OVER () AS n FROM orders GROUP BY x),
        pick AS (SELECT choice, any_value((n + 3) // 2)::INTEGER AS h, regr_intercept(v, x) AS intercept, regr_slope(v, x) AS slope FROM (SELECT unnest(range(1 << (SELECT any_value(n) FROM ys)::INTEGER)) AS choice) JOIN ys ON choice & (1 << place) <> 0 GROUP BY choice HAVING count(*) = any_value((n + 3) // 2)),
        fits AS (SELECT choice, h, intercept, slope, sum((v - intercept - slope * x) ** 2) AS objective FROM pick JOIN ys ON choice & (1 << place) <> 0 GROUP BY ALL)""")
# Seeded starts by Spark's own hash; the tests hold them against every choice.
reg.add("lts_trend", lambda s, d: trimmed_row(s, trimmed.lts(pn.orders_full(s, d), [F.lit(1.0), F.col("days") / 365.0], F.col("n"), F.col("row_id"), starts=8)))
