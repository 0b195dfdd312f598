"""Runs imputers on a count table: python -m tallyloom.run --data t.csv --schema s.toml --output out

Writes completed counts of the native pass by model, and with a mask the prediction table, errors by
group, seed summaries and model pairs; then config.json and artifacts.json. A model that fails is a
row of the status table, the others go on; the exit code is 1 then. A table that breaks the rules is
refused with code, entity, time, column and line as JSON on the error stream, exit code 2.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import imputers, logratio, masking, neighbours, residual, scoring
from tallyloom.plans import protocol
from tallyloom.sources import tables


def panel_of(spark: SparkSession, data: str, schema: tables.PanelSchema, base: Path = Path(".")) -> DataFrame:
    return panel_and_kind(spark, data, schema, base)[0]


def panel_and_kind(spark: SparkSession, data: str, schema: tables.PanelSchema, base: Path = Path(".")) -> tuple[DataFrame, str | None]:
    """The checked panel of a CSV with the rows' source fields and places, and the kind of its times.

    TableError names what is wrong, where and in which line.

    row_id and e are unique and rise with (entity, days); days are days, numbers or ranks by the
    kind of time. base: the folder that a relative group map is looked for in.
    """
    raw = tables.read_csv(spark, data, schema)
    panel = tables.panel_from(raw, schema)
    where = lambda entity, time: tables.line_of(spark, data, schema, entity, time)
    tables.check(panel, tables.cell_problems(raw, schema), where)
    rows, kind = tables.parse_times(panel, "time", schema.time_format) if schema.time else (panel.withColumn("days", F.lit(0)), None)
    rows = tables.grouped(spark, rows, schema, base, where)
    again = rows.groupBy("entity", "days").agg(F.count(F.lit(1)).alias("k"), F.max("time").alias("time")).where("k > 1").orderBy("entity", "days").first() if schema.time else None
    if again:
        raise tables.refused("repeated_time", again["entity"], again["time"], schema.time, where, f"it means the same day, {again['days']}, as another of its times")
    named = rows.join(tables.numbered(rows, "entity").withColumnRenamed("number", "e"), "entity")
    whole = named.agg(F.bool_and(F.col("days") == F.floor("days")).alias("whole")).first()["whole"]
    placed = named.withColumn("days", F.col("days").cast("long" if whole else "double")).orderBy("entity", "days")
    return placed.select(F.monotonically_increasing_id().alias("row_id"), "e", "entity", "grp", "days", "n", "c", "source", *tables.PLACE), kind


def neighbour_model(panel: DataFrame) -> DataFrame:
    """Jensen-Shannon neighbours as proposals; complete rows propose nothing."""
    near = neighbours.tsagris(panel).select("row_id", F.slice("x", F.lit(1), F.size("x") - 1).alias("p"))
    return panel.join(near, "row_id", "left").withColumn("p", F.coalesce("p", F.transform("c", lambda v: F.lit(0.0))))


def log_ratio_model(panel: DataFrame, d: int, other: bool, rule: str | None = None) -> DataFrame:
    """The log-ratio fit: the panel with filled, the residual split by itself, or by another rule."""
    rows, fit, _ = logratio.fit(panel, d, other)
    done = logratio.restored(rows, fit.beta, other).select("row_id", "filled")
    split = panel.join(done, "row_id", "left").withColumn("filled", F.coalesce("filled", "c"))
    if rule is None:
        return split
    shares = F.zip_with("c", "filled", lambda v, f: F.when(v.isNull(), F.coalesce(f, F.lit(0.0)) / F.col("n")).otherwise(0.0))
    # Its own split is that of prop_other already: in proportion, Other included.
    return split if rule == "prop_other" else residual.fill(split.withColumn("p", shares).drop("filled"), rule)


#: The rules that each model can be given; models that predict no share of Other take no prop_other,
#: and those without a rule of the runner's take none.
RULES_OF = {"same_day_mean": ("cap", "rescale"), "hron": residual.RULES, "tsagris": residual.RULES, "micoda_other": residual.RULES}


def refused_rules(chosen: list[str], rule: str) -> list[str]:
    return [n for n in chosen if rule not in RULES_OF.get(n, ())]


def models_of(d: int, kind: str | None = "date", rule: str | None = None) -> dict:
    """Registered models: panel -> panel with proposals (p) or counts (filled)."""
    return imputers.MODELS | {
        "mean_fill": lambda p: imputers.mean_fill(p, d),
        "same_day_mean": lambda p: imputers.same_day_mean(p, kind=kind, use_time=kind is not None),
        "hron": lambda p: imputers.with_proposals(p, neighbours.hron(p)),
        "tsagris": neighbour_model,
        "micoda": lambda p: log_ratio_model(p, d, False),
        "micoda_other": lambda p: log_ratio_model(p, d, True, rule),
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyloom")
    parser.add_argument("--data", required=True)
    parser.add_argument("--schema", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--mask", choices=masking.KINDS, default="none")
    parser.add_argument("--mask-rate", type=float, default=0.05)
    parser.add_argument("--seeds", type=int, nargs="+", default=[0, 1, 2, 3, 4])
    parser.add_argument("--only", nargs="+")
    parser.add_argument("--rule", choices=residual.RULES)
    args = parser.parse_args(argv)
    masking.validate_mask(args.mask, args.mask_rate)
    out = Path(args.output)
    if out.exists():
        parser.error(f"{out} exists")
    schema = tables.read_schema(args.schema)
    known = models_of(len(schema.targets))
    if unknown := set(args.only or []) - set(known):
        parser.error(f"unknown models: {sorted(unknown)}")
    chosen = args.only or sorted(known)
    if args.rule and (own := refused_rules(chosen, args.rule)):
        parser.error(f"--rule {args.rule} doesn't apply to {own}")
    rule = args.rule or "cap"
    spark = spark or SparkSession.builder.appName("tallyloom").getOrCreate()
    try:
        panel, kind = panel_and_kind(spark, args.data, schema, Path(args.schema).resolve().parent)
    except tables.TableError as error:
        stated = {k: getattr(error, k, None) for k in ("code", "entity", "time", "feature", "line")}
        print(json.dumps({"error": str(error)} | stated), file=sys.stderr)
        return 2
    out.mkdir(parents=True)
    panel.write.parquet(str(out / "panel"))  # numbers of rows stand from here on, whatever is lost
    whole = spark.read.parquet(str(out / "panel"))
    panel, source, names = whole.drop("source", *tables.PLACE), whole.select("row_id", "source", *tables.PLACE), tables.header(spark, args.data)
    known = models_of(len(schema.targets), kind, args.rule)
    status = []
    for name in chosen:
        try:
            filled = known[name](panel)
            filled = filled if "filled" in filled.columns else residual.fill(filled, rule)
            broken = residual.violations(filled).count()
            tables.write_completed(filled, source, str(out / f"completed_{name}"), names, schema.targets)
            tables.read_completed(spark, str(out / f"completed_{name}"), schema, source, names)
            status.append({"model": name, "pass": "native", "status": "partial" if broken else "completed", "violations": broken})
        except Exception as error:  # noqa: BLE001  one model's failure is a result
            status.append({"model": name, "pass": "native", "status": "failed", "code": type(error).__name__, "error": str(error)[:500]})
    if args.mask != "none":
        # These take all seeds in one plan; windows by days are those of dates.
        by_seed = ("zero_fill", "mean_fill", *["same_day_mean"] * (kind == "date"))
        fitted = [s["model"] for s in status if s["status"] != "failed"]
        one = {n: known[n] for n in fitted if n not in by_seed}
        rows = scoring.predictions(panel, fitted, args.seeds, args.mask_rate, rule, args.mask, one)
        tables.write_predictions(rows, str(out / "predictions"))
        rows = tables.read_predictions(spark, str(out / "predictions"))
        errors = scoring.masked_errors(rows, ["model", "seed"])
        tables.write_na_csv(errors, str(out / "errors"))
        runs = errors.where("cell_group = 'all'").select("model", "seed", "mae_prop")
        tables.write_na_csv(scoring.seed_summary(runs, "mae_prop", ["model"]), str(out / "summary"))
        tables.write_na_csv(scoring.pairs(scoring.common_seeds(runs, len(fitted))), str(out / "pairs"))
    (out / "status.json").write_text(json.dumps(status, indent=1))
    (out / "config.json").write_text(json.dumps(vars(args) | protocol.provenance(Path(__file__).resolve().parent), indent=1))
    tables.manifest(out, ["status.json", "config.json"])
    return int(any(s["status"] == "failed" for s in status))


if __name__ == "__main__":
    sys.exit(main())
