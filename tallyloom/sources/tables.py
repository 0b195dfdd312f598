"""Reading and writing count tables: schemas, strict CSV, times, groups, results, manifests."""

from __future__ import annotations

import csv
import hashlib
import json
import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts that stand for a missing cell, compared without case and outer blanks.
MISSING = ("", "na", "nan", "none")
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
KEYS = {"entity", "targets", "time", "total", "time_format", "group_col", "group_map"}


class TableError(ValueError):
    """A schema or table that breaks the rules."""


@dataclass(frozen=True)
class PanelSchema:
    entity: str
    targets: tuple[str, ...]
    time: str | None = None
    total: str | None = None
    time_format: str | None = None
    group_col: str | None = None
    group_map: str | None = None

    def __post_init__(self):
        if len(self.targets) < 2 or len(set(self.targets)) != len(self.targets):
            raise TableError("a schema needs at least two different targets")
        named = [self.entity, *self.targets, *(c for c in (self.time, self.total) if c)]
        if len(set(named)) != len(named):
            raise TableError("entity, time, total and targets must be different columns")
        if self.time_format and not self.time:
            raise TableError("time_format needs time")
        if self.group_map and not self.group_col:
            raise TableError("group_map needs group_col")


def read_schema(path: str) -> PanelSchema:
    """The [dataset] table of a TOML file; unknown keys are refused."""
    with open(path, "rb") as file:
        table = tomllib.load(file).get("dataset", {})
    if unknown := set(table) - KEYS:
        raise TableError(f"unknown keys: {sorted(unknown)}")
    if not {"entity", "targets"} <= set(table):
        raise TableError("a schema needs entity and targets")
    return PanelSchema(**table | {"targets": tuple(table["targets"])})


#: Where a row stands in its source: files, their blocks, the order within a read block.
PLACE = ("_file", "_block", "_nth")


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV; the header may hold quoted commas and line feeds."""
    lines = [r[0] for r in spark.read.text(path).take(100)]
    if not lines:
        raise TableError("the file is empty")
    head, rest = lines[0], lines[1:]
    while head.count('"') % 2 and rest:
        head += "\n" + rest.pop(0)
    return next(csv.reader([head.lstrip("\ufeff")], strict=True))


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Has a quoted field a line feed? Exactly then a line has an odd number of quotes."""
    return not spark.read.text(path).where((F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema: PanelSchema) -> DataFrame:
    """All columns as texts, with broken (the row has more or fewer fields than the header) and PLACE.

    A file is read in splits, unless some quoted field has a line feed: then each file is one split.
    """
    names = header(spark, path)
    wanted = [schema.entity, *schema.targets, *(c for c in (schema.time, schema.total) if c)]
    if len(set(names)) != len(names) or not set(wanted) <= set(names):
        raise TableError(f"the header lacks or repeats columns of {wanted}")
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    # Without pruning off, fields that no one reads aren't counted and a row of the wrong width passes.
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "enforceSchema": False, "columnPruning": False, "escape": '"', "multiLine": spans_lines(spark, path)}
    rows = spark.read.schema(f"{fields}, _bad string").options(**options).csv(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_nth"))
    return placed.withColumn("broken", F.col("_bad").isNotNull()).drop("_bad")


def texts(raw: DataFrame) -> Column:
    """The source fields of a row of read_csv() as one array, in the order of the header."""
    return F.array(*(F.col(f"`{c}`") for c in raw.columns if c not in (*PLACE, "broken")))


def missing(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*MISSING)


def number(text: Column) -> Column:
    """A finite number, null for a missing or unreadable text."""
    return F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("double"))


def cell_code(text: Column, may_lack: bool = True) -> Column:
    """Null if the text is a cell, else what is wrong: missing, not_a_number, infinite, negative."""
    value = number(text)
    return (
        F.when(text.isNull() | missing(text), None if may_lack else "missing")
        .when(value.isNull(), "not_a_number")
        .when(F.abs(value) == float("inf"), "infinite")
        .when(value < 0, "negative")
    )


def panel_from(raw: DataFrame, schema: PanelSchema) -> DataFrame:
    """Texts to entity, time, total (n) and counts (c); without a total, n is the sum of the targets.

    From a table of read_csv() also source (the fields as they stand there) and PLACE.
    """
    counts = F.array(*(F.when(~missing(F.col(t)), number(F.col(t))) for t in schema.targets))
    known = F.aggregate(counts, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return raw.select(F.trim(schema.entity).alias("entity"), (F.trim(schema.time) if schema.time else F.lit(None).cast("string")).alias("time"), (number(F.col(schema.total)) if schema.total else known).alias("n"), counts.alias("c"), *([F.col(schema.group_col).alias("grp")] if schema.group_col and schema.group_col in raw.columns else []), *([texts(raw).alias("source"), *PLACE] if set(PLACE) <= set(raw.columns) else []))


def cell_problems(raw: DataFrame, schema: PanelSchema) -> DataFrame:
    """entity, time, feature, code of rows with a wrong number of fields and of cells that can't be read."""
    asked = [(t, schema.total is not None) for t in schema.targets] + ([(schema.total, False)] if schema.total else [])
    cells = [F.struct(F.lit(c).alias("feature"), F.when(~F.col("broken"), cell_code(F.col(c), may_lack)).alias("code")) for c, may_lack in asked]
    width = F.struct(F.lit(None).cast("string").alias("feature"), F.when(F.col("broken"), "wrong_width").alias("code"))
    time = F.col(schema.time) if schema.time else F.lit(None).cast("string")
    return raw.select(F.col(schema.entity).alias("entity"), time.alias("time"), F.explode(F.array(width, *cells)).alias("p")).select("entity", "time", "p.*").where("code is not null")


def violations(panel: DataFrame) -> DataFrame:
    """entity, time, code of rows that break a rule: blanks, repeated keys, totals."""
    known = F.aggregate("c", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    code = (
        F.when(F.coalesce(F.trim("entity"), F.lit("")) == "", "empty_entity")
        .when(F.col("time").isNotNull() & (F.trim("time") == ""), "empty_time")
        .when(F.col("n").isNull() | (F.col("n") <= 0), "total_not_positive")
        .when(known > F.col("n"), "counts_exceed_total")
    )
    rows = panel.select("entity", "time", code.alias("code")).where("code is not null")
    twice = panel.groupBy("entity", "time").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("entity", "time", F.lit("repeated_key").alias("code"))
    return rows.unionByName(twice)


def line_of(spark: SparkSession, path: str, schema: PanelSchema, entity: str | None, time: str | None) -> int | None:
    """The first line of a CSV with that entity and time; looked for only when a row is refused."""
    raw = read_csv(spark, path, schema)
    feeds = F.aggregate(texts(raw), F.lit(0), lambda n, v: n + F.coalesce(F.length(v) - F.length(F.replace(v, F.lit("\n"), F.lit(""))), F.lit(0)))
    # Lines before a row: those of the ranges of rows before its own, and those within.
    placed = raw.withColumn("lines", 1 + feeds).repartitionByRange(*PLACE).sortWithinPartitions(*PLACE).withColumn("part", F.spark_partition_id())
    starts = placed.groupBy("part").agg(F.sum("lines").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("start"))  # a row a range
    own = F.sum("lines").over(Window.partitionBy("part").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)) - F.col("lines")
    same = lambda c, v: F.trim(F.col(f"`{c}`")).eqNullSafe(F.lit(v.strip() if v is not None else None))
    found = placed.withColumn("own", own).join(F.broadcast(starts), "part").where(same(schema.entity, entity) & (same(schema.time, time) if schema.time and time is not None else F.lit(True)))
    least = found.agg(F.min(F.col("start") + F.col("own")).alias("line")).first()["line"]
    return None if least is None else least + 2 + sum(n.count("\n") for n in header(spark, path))


def refused(code: str, entity: str | None, time: str | None = None, feature: str | None = None, where=None, why: str = "") -> TableError:
    """The error of a table's row, with code, entity, time, feature and line."""
    error = TableError(f"{code}: entity {entity!r}, time {time!r}" + (f", column {feature!r}" if feature else "") + (f": {why}" if why else ""))
    error.code, error.entity, error.time, error.feature = code, entity, time, feature
    error.line = where(entity, time) if where else None
    return error


def check(panel: DataFrame, more: DataFrame | None = None, where=None) -> None:
    """Raises the first problem by code, entity and time; more: further rows entity, time, feature, code."""
    found = violations(panel).withColumn("feature", F.lit(None).cast("string"))
    found = found if more is None else more.unionByName(found)
    first = found.orderBy(F.col("feature").isNull(), "code", "entity", "time", "feature").first()
    if first:
        raise refused(first["code"], first["entity"], first["time"], first["feature"], where)


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Distinct values of `by` in order with number: unique and rising, from one range sort, not dense."""
    return rows.select(*by).distinct().orderBy(*by).withColumn("number", F.monotonically_increasing_id())


def parse_times(rows: DataFrame, column: str, fmt: str | None = None) -> tuple[DataFrame, str]:
    """rows with days (and week for dates), and the kind: date, numeric or label.

    Dates (a format, or ISO) count days from the earliest; numbers stand for themselves; other
    texts take their rank among the distinct texts, which has no distance meaning.
    """
    text = F.trim(column)
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    date = F.to_date(F.try_to_timestamp(text, F.lit(fmt))) if fmt else F.when(iso, text.try_cast("date"))
    all_ = rows.agg(F.bool_and(date.isNotNull()).alias("dates"), F.bool_and(number(text).isNotNull()).alias("numbers"), F.min(date).alias("first")).first()
    if fmt and not all_["dates"]:
        raise TableError(f"a time doesn't follow {fmt!r}")
    if all_["dates"]:
        days = F.datediff(date, F.lit(all_["first"])).cast("long")
        return rows.withColumn("days", days).withColumn("week", F.floor(days / 7)), "date"
    if all_["numbers"]:
        return rows.withColumn("days", number(text)), "numeric"
    some = rows.agg(F.bool_or(iso).alias("iso")).first()
    if not fmt and some["iso"]:
        raise TableError("some times are YYYY-MM-DD dates and others aren't")
    # Ranks within ranges of the labels, the ranges placed by their sizes: no task holds all labels.
    placed = rows.select(text.alias("_t")).distinct().repartitionByRange("_t").sortWithinPartitions("_t").withColumn("_part", F.spark_partition_id()).persist()
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("k")).select("_part", (F.sum("k").over(Window.orderBy("_part")) - F.col("k")).alias("start"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_t")) - 1
    ranks = placed.withColumn("own", own).join(F.broadcast(starts), "_part").select("_t", (F.col("start") + F.col("own")).cast("long").alias("days"))
    return rows.join(ranks, text == F.col("_t")).drop("_t"), "label"


def with_groups(rows: DataFrame, mapping: DataFrame, group: str) -> DataFrame:
    """rows with grp from an entity -> group table (a lookup, broadcast if small)."""
    return rows.join(mapping.select(F.col("entity"), F.col(group).alias("grp")), "entity", "left")


def grouped(spark: SparkSession, rows: DataFrame, schema: PanelSchema, base: Path, where=None) -> DataFrame:
    """rows (entity, time, maybe grp) with grp: the CSV's column, else the schema's map, else one group for all."""
    if schema.group_col is None:
        return rows.withColumn("grp", F.lit("all"))
    if "grp" in rows.columns:
        if (empty := rows.where(F.coalesce(F.trim("grp"), F.lit("")) == "").orderBy("entity", "time").first()) is not None:
            raise refused("empty_group", empty["entity"], empty["time"], schema.group_col, where)
        return rows.withColumn("grp", F.trim("grp"))
    if schema.group_map is None:
        raise TableError(f"{schema.group_col!r} is no column of the table and the schema has no group_map")
    path = Path(schema.group_map)
    lookup = spark.read.option("header", True).csv(str(path if path.is_absolute() else base / path))
    if not {schema.entity, schema.group_col} <= set(lookup.columns):
        raise TableError(f"the group map needs columns {schema.entity!r} and {schema.group_col!r}")
    mapping = lookup.select(F.trim(schema.entity).alias("entity"), F.trim(schema.group_col).alias("g")).distinct()
    for code, bad in (("empty_group", mapping.where(F.coalesce("g", F.lit("")) == "")), ("group_conflict", map_conflicts(mapping, "g")), ("no_group", unknown_entities(rows, mapping))):
        if (first := bad.orderBy("entity").first()) is not None:
            # The entity's first row, if the table has one.
            row = rows.where(F.col("entity") == first["entity"]).agg(F.min("time").alias("time")).first()
            raise refused(code, first["entity"], row["time"], schema.group_col, where)
    return with_groups(rows, mapping, "g")


def unknown_entities(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    return rows.select("entity").distinct().join(mapping.select("entity"), "entity", "left_anti")


def map_conflicts(mapping: DataFrame, group: str) -> DataFrame:
    return mapping.groupBy("entity").agg(F.countDistinct(group).alias("k")).where("k > 1").select("entity")


def write_completed(filled: DataFrame, source: DataFrame, path: str, names: list[str], targets: tuple[str, ...]) -> None:
    """The source table with its missing targets filled, as a folder of CSV files in the order of the source.

    filled: row_id and filled; source: row_id, source (texts by names) and PLACE. Texts of observed
    cells, times and all other columns stay as they are; a filled count is the shortest text that
    reads back as the same number, and stays empty where filled is null. Spark publishes the folder
    when all parts are written; an existing one is refused.
    """
    both = source.join(filled.select("row_id", "filled"), "row_id", "left")
    cell = lambda i, k: F.when(F.coalesce(missing(F.get("source", F.lit(i))), F.lit(True)), F.get("filled", F.lit(k)).cast("string")).otherwise(F.get("source", F.lit(i)))
    columns = [(cell(i, targets.index(n)) if n in targets else F.get("source", F.lit(i))).alias(n) for i, n in enumerate(names)]
    plain = {"header": True, "escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    both.orderBy(*PLACE).select(*columns).write.mode("errorifexists").options(**plain).csv(path)


def read_completed(spark: SparkSession, path: str, schema: PanelSchema, source: DataFrame, names: list[str]) -> DataFrame:
    """row_id, filled of a folder that write_completed() wrote, checked against the source.

    Refused are: other columns or numbers of rows, rows whose keys the source lacks, changed texts
    outside the targets, changed observed counts, and counts that are missing, unreadable or negative.
    """
    raw = read_csv(spark, path, schema)
    if header(spark, path) != list(names):
        raise TableError(f"{path} has other columns than its source")
    keys = lambda side: [F.trim(F.get(side, F.lit(names.index(c)))) for c in (schema.entity, schema.time) if c]
    mine = source.select("row_id", F.col("source").alias("was"), F.struct(*keys("source")).alias("key"))
    read = raw.select("broken", texts(raw).alias("now")).withColumn("key", F.struct(*keys("now")))
    same = [F.get("was", F.lit(i)).eqNullSafe(F.get("now", F.lit(i))) for i, n in enumerate(names) if n not in schema.targets]
    at = [names.index(t) for t in schema.targets]
    seen = [F.coalesce(missing(F.get("was", F.lit(i))), F.lit(True)) | (number(F.get("was", F.lit(i))) == number(F.get("now", F.lit(i)))) for i in at]
    every = lambda tests: F.forall(F.array(*tests), lambda ok: F.coalesce(ok, F.lit(False))) if tests else F.lit(True)
    counts = F.array(*(number(F.get("now", F.lit(i))) for i in at))
    code = (
        F.when(F.col("row_id").isNull() | F.col("now").isNull(), "other_rows")
        .when(F.col("broken"), "wrong_width")
        .when(~every(same), "columns_changed")
        .when(~every(seen), "observed_changed")
        .when(~F.forall(counts, lambda v: F.coalesce(v >= 0, F.lit(False))), "unreadable_count")
    )
    both = mine.join(read, "key", "full").select("row_id", "key", counts.alias("filled"), code.alias("code"))
    bad = both.where("code IS NOT NULL").orderBy("code", "key").first()
    if bad:
        raise TableError(f"{path}: {bad['code']} at {list(bad['key'])}")
    if raw.count() != source.count():
        raise TableError(f"{path}: other_rows, some repeated")
    return both.select("row_id", "filled")


def write_predictions(rows: DataFrame, path: str) -> None:
    """The prediction table as Parquet by mask and model."""
    rows.write.mode("errorifexists").partitionBy("mask", "model").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_na_csv(rows: DataFrame, path: str) -> None:
    """Texts with NA for null."""
    rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in rows.columns)).write.mode("errorifexists").option("header", True).csv(path)


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and an order-free digest, the sum of row hashes, plus their xor."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(h).alias("xor"))


def manifest(run: Path, files: list[str]) -> dict[str, str]:
    """SHA-256 by file of a run folder, written beside them as artifacts.json."""
    found = {f: hashlib.sha256((run / f).read_bytes()).hexdigest() for f in sorted(files)}
    (run / "artifacts.json").write_text(json.dumps(found, indent=1))
    return found


def verify_manifest(run: Path) -> list[str]:
    """Files that are gone or changed since the manifest."""
    stated = json.loads((run / "artifacts.json").read_text())
    return [f for f, digest in stated.items() if not (run / f).exists() or hashlib.sha256((run / f).read_bytes()).hexdigest() != digest]
