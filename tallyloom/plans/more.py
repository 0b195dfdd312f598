"""Further queries: training views, features, donors, strata of diagnostics, sets, splits, streams as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom.functions.hashing import ORDER, uniform
from tallyloom.operators import masking, neighbours, residual, scoring, staged
from tallyloom.plans import models, panels
from tallyloom.plans.panels import BASE
from tallyloom.plans.registry import Registry
from tallyloom.plans.sqltext import ANCHOR, EVENTS, HIDE, ORDERS, TRAIN, u
from tallyloom.sources import states, tables
from tallyloom.storage import saved, shared_dir
from tallyloom.streaming import panels as streams

reg = Registry()

#: Training cells of the recipe (0.15, 3).
TRAINED = f"""{BASE}, dr AS (SELECT *, c IS NOT NULL AND {u("e", "days", "t", TRAIN + 3)} < 0.15 AS h, {u("e", "days", "t", ANCHOR + (TRAIN - HIDE) // 2 + 3)} AS a FROM cells),
        an AS (SELECT *, count(*) FILTER (c IS NOT NULL AND NOT h) OVER (PARTITION BY row_id) AS stays, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN c IS NULL THEN 1 ELSE 0 END, a, t) AS nth FROM dr)"""
reg.add("training_mask", lambda s, d: pn.cells(pn.orders_panel(s, d).withColumn("h", masking.random_cell(0.15, 3, TRAIN)), "h").where("h").select("row_id", "t"), "SELECT row_id, t FROM an WHERE h AND NOT (stays = 0 AND nth = 1)", "row_id t", "", TRAINED)


def restored_state(s, d):
    """The training cells' labels of a state that was exported and read back under its checks."""
    panel, path = saved(pn.orders_panel(s, d), "panel"), f"{shared_dir(s)}/states/{uuid.uuid4().hex}"
    states.export(panel, 0.15, 3, path)
    return states.restore(panel, 0.15, 3, path).select("row_id", F.posexplode("labels").alias("t", "label")).where("label IS NOT NULL")


reg.add("initial_state_labels", restored_state, "SELECT row_id, t, c / n AS label FROM an WHERE h AND NOT (stays = 0 AND nth = 1)", "row_id t", "label", TRAINED)
reg.add("clr_features", lambda s, d: staged.clr_features(pn.orders_panel(s, d)).select("row_id", F.posexplode("f").alias("t", "f")), "SELECT row_id, t, ln(CASE WHEN x > 0 THEN x END) - avg(ln(CASE WHEN x > 0 THEN x END)) OVER (PARTITION BY row_id) AS f FROM x", "row_id t", "f", BASE)
reg.add("time_embedding", lambda s, d: pn.orders_full(s, d).select("row_id", F.posexplode(staged.time_embedding(F.col("days"))).alias("k", "v")), "SELECT row_id, k, CASE WHEN k < 4 THEN sin(days * pow(10000.0, -2 * k / 8.0)) ELSE cos(days * pow(10000.0, -2 * (k - 4) / 8.0)) END AS v FROM (SELECT DISTINCT row_id, days FROM full_cells), (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k)", "row_id k", "v", ORDERS)
reg.add("initial_completion", lambda s, d: staged.initial(pn.orders_panel(s, d)).select("row_id", F.posexplode("filled").alias("t", "count")))
reg.add("donor_statistics", lambda s, d: neighbours.hron(pn.orders_panel(s, d)).groupBy("t").agg(F.avg("donors").alias("mean_donors"), F.median("donors").alias("median_donors"), F.max("donors").alias("max_donors"), F.count_if(F.col("donors") > 3).alias("tied")),
        "SELECT t, avg(k) AS mean_donors, median(k) AS median_donors, max(k) AS max_donors, count(*) FILTER (k > 3) AS tied FROM (SELECT row_id, t, count(*) AS k FROM lim WHERE d <= dk + 1e-12 * greatest(1, abs(dk)) GROUP BY row_id, t) GROUP BY t", "t max_donors tied", "mean_donors median_donors", models.DIST)


def strata(s, d):
    """D1 by target and group, and by target over all groups; null under 30 filled cells."""
    asked, seen = models.support_sides(s, d)
    a = asked.rollup("t", "grp").agg(F.count(F.lit(1)).alias("cells"), F.avg((F.col("count") < 0.5).cast("double")).alias("x")).where("t is not null")
    b = seen.rollup("t", "grp").agg(F.avg((F.col("c") < 0.5).cast("double")).alias("y")).where("t is not null")
    both = a.alias("a").join(b.alias("b"), (F.col("a.t") == F.col("b.t")) & F.col("a.grp").eqNullSafe(F.col("b.grp")))
    return both.select("a.t", "a.grp", "a.cells", F.when(F.col("cells") >= 30, F.col("x") - F.col("y")).alias("d1"))


reg.add("diagnose_strata", strata, "SELECT a.t, a.grp, cells, CASE WHEN cells >= 30 THEN x - y END AS d1 FROM (SELECT t, grp, count(*) AS cells, avg((count < 0.5)::INTEGER) AS x FROM ev GROUP BY ROLLUP (t, grp) HAVING t IS NOT NULL) a JOIN (SELECT t, grp, avg((c < 0.5)::INTEGER) AS y FROM ob GROUP BY ROLLUP (t, grp) HAVING t IS NOT NULL) b ON a.t = b.t AND a.grp IS NOT DISTINCT FROM b.grp", "t grp cells", "d1", models.SUP)


def truth_gap(s, d):
    """How far a model's zero rates are from the truth's, over targets weighted by cells."""
    rows = models.predicted(s, d).groupBy("model", "seed", "t").agg(F.count(F.lit(1)).alias("cells"), F.avg((F.col("pred_count") < 0.5).cast("double")).alias("a"), F.avg((F.col("truth_count") < 0.5).cast("double")).alias("b"))
    return rows.groupBy("model", "seed").agg((F.sum(F.col("cells") * F.abs(F.col("a") - F.col("b"))) / F.sum("cells")).alias("gap"))


reg.add("truth_gap", truth_gap, "SELECT model, seed, sum(k * abs(a - b)) / sum(k) AS gap FROM (SELECT model, seed, t, count(*) AS k, avg((pred_count < 0.5)::INTEGER) AS a, avg((truth_count < 0.5)::INTEGER) AS b FROM pred GROUP BY ALL) GROUP BY model, seed", "model seed", "gap", models.PRED)
reg.add("d1_proportion_threshold", lambda s, d: models.predicted(s, d).groupBy("model").agg((F.avg((F.col("pred_prop") < 1e-3).cast("double")) - F.avg((F.col("truth_prop") < 1e-3).cast("double"))).alias("d1")), "SELECT model, avg((pred_prop < 1e-3)::INTEGER) - avg((truth_prop < 1e-3)::INTEGER) AS d1 FROM pred GROUP BY model", "model", "d1", models.PRED)


def supported_errors(s, d):
    """Errors on hidden cells that have local support among the visible ones."""
    from tallyloom.operators import support

    rows = models.predicted(s, d).where("seed = 1 and model = 'mean_fill'")
    seen = pn.cells(pn.orders_panel(s, d)).where("c is not null").select("row_id", "t", "e", "grp", "days", "c")
    asked = rows.select("row_id", "t", "e", "grp", "days")
    good = support.support(asked, seen).where("supported").select("row_id", "t")
    return scoring.masked_errors(rows.join(good, ["row_id", "t"], "left_semi"), ["model"]).where("cell_group = 'all'").select("model", "cells", "mae_prop")


reg.add("supported_errors", supported_errors, "SELECT model, count(*) AS cells, avg(abs(pred_prop - truth_prop)) AS mae_prop FROM (SELECT p.*, (SELECT count(*) FROM cells o WHERE o.t = p.t AND o.grp = p.grp AND o.c IS NOT NULL AND o.e <> p.e AND abs(o.days - p.row_id % 100000) <= 62) AS refs, (SELECT count(DISTINCT o.e) FROM cells o WHERE o.t = p.t AND o.grp = p.grp AND o.c IS NOT NULL AND o.e <> p.e AND abs(o.days - p.row_id % 100000) <= 62) AS ents FROM pred p WHERE seed = 1 AND model = 'mean_fill') WHERE refs >= 10 AND ents >= 2 GROUP BY model", "model cells", "mae_prop", models.PRED)

def supported_errors_by_run(s, d):
    """The same for every model and seed; support is that of the cell, whatever hides it."""
    from tallyloom.operators import support

    rows = models.predicted(s, d)
    seen = pn.cells(pn.orders_panel(s, d)).where("c is not null").select("row_id", "t", "e", "grp", "days", "c")
    good = support.support(rows.select("row_id", "t", "e", "grp", "days").distinct(), seen).where("supported").select("row_id", "t")
    return scoring.masked_errors(rows.join(good, ["row_id", "t"], "left_semi"), ["model", "seed"]).where("cell_group = 'all'").select("model", "seed", "cells", "mae_prop")


reg.add("supported_errors_by_run", supported_errors_by_run, "SELECT model, seed, count(*) AS cells, avg(abs(pred_prop - truth_prop)) AS mae_prop FROM pred JOIN near USING (row_id, t) WHERE refs >= 10 AND ents >= 2 GROUP BY model, seed", "model seed cells", "mae_prop",
        models.PRED + ", asked AS (SELECT DISTINCT row_id, t, e, grp FROM pred), near AS (SELECT p.row_id, p.t, count(*) AS refs, count(DISTINCT o.e) AS ents FROM asked p JOIN cells o ON o.t = p.t AND o.grp = p.grp AND o.c IS NOT NULL AND o.e <> p.e AND abs(o.days - p.row_id % 100000) <= 62 GROUP BY ALL)")

# --- sets, splits, comparisons ------------------------------------------------------


def keys(s, d, by):
    return pn.read(s, d, "customer").select(F.col("c_custkey").alias("key")).where(F.col("key") % by == 0)


reg.add("key_symmetric_difference", lambda s, d: keys(s, d, 6).exceptAll(keys(s, d, 10)).unionByName(keys(s, d, 10).exceptAll(keys(s, d, 6))), "(SELECT c_custkey AS key FROM customer WHERE c_custkey % 6 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0)", "key")
reg.add("key_intersection", lambda s, d: keys(s, d, 6).intersect(keys(s, d, 10)), "SELECT c_custkey AS key FROM customer WHERE c_custkey % 6 = 0 INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0", "key")


def holdout(s, d):
    full = pn.orders_full(s, d)
    held = full.where(uniform(F.col("e"), F.col("days"), F.lit(9), ORDER) < 0.2).select("row_id")
    return full.join(held, "row_id", "left_anti").select("row_id")


reg.add("train_split", holdout, f"SELECT row_id FROM (SELECT e * 100000 + days AS row_id, {u('e', 'days', '9', ORDER)} AS x FROM op) WHERE x >= 0.2", "row_id", "", ORDERS)


def regression(s, d):
    """Two score tables side by side: what differs or is in one only."""
    a = models.runs(s, d)
    b = a.where("seed <> 4").withColumn("mae_prop", F.when(F.col("seed") == 2, F.col("mae_prop") + 1e-3).otherwise(F.col("mae_prop")))
    both = a.select("model", "seed", F.col("mae_prop").alias("x")).join(b.select("model", "seed", F.col("mae_prop").alias("y")), ["model", "seed"], "full")
    verdict = F.when(F.col("x").isNull() | F.col("y").isNull(), "only_one").when(F.abs(F.col("x") - F.col("y")) > 1e-9, "differs").otherwise("same")
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("runs"))


reg.add("score_regression_check", regression, "SELECT CASE WHEN seed = 4 THEN 'only_one' WHEN seed = 2 THEN 'differs' ELSE 'same' END AS verdict, count(*) AS runs FROM runs GROUP BY 1", "verdict runs", "", models.SCORES)
reg.add("table_digest", lambda s, d: tables.table_digest(pn.cells(pn.orders_panel(s, d)), ["row_id", "t", "c"]))


def lineitem_cells(s, d):
    """Supplier by quarter: counts of flag and status pairs."""
    line = pn.read(s, d, "lineitem").select("l_suppkey", F.date_trunc("quarter", "l_shipdate").cast("date").alias("start"), F.concat("l_returnflag", "l_linestatus").alias("kind"))
    return line.groupBy("l_suppkey", "start").pivot("kind", ["AF", "AO", "NF", "NO"]).count().select(F.col("l_suppkey").cast("long").alias("e"), F.date_format("start", "yyyy-MM-dd").alias("day"), *(F.coalesce(F.col(k), F.lit(0)).cast("double").alias(k.lower()) for k in ("AF", "AO", "NF", "NO")))


reg.add("panel_lineitem_cells", lineitem_cells, "SELECT l_suppkey AS e, strftime(date_trunc('quarter', l_shipdate), '%Y-%m-%d') AS day, " + ", ".join(f"(count(*) FILTER (l_returnflag || l_linestatus = '{k}'))::DOUBLE AS {k.lower()}" for k in ("AF", "AO", "NF", "NO")) + " FROM lineitem GROUP BY 1, 2", "e day", "af ao nf no")
reg.add("stream_window_counts", lambda s, d: streams.window_counts(pn.read(s, d, "events"), pn.EVENTS).select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.get("c", F.lit(0)).alias("clicks")), "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*)::DOUBLE AS n, (count(*) FILTER (event_type = 'click'))::DOUBLE AS clicks FROM events GROUP BY 1, 2", "user_id day", "n clicks")
reg.add("stream_sessions", lambda s, d: streams.sessions(pn.read(s, d, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest")), "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id", "user_id sessions longest")
