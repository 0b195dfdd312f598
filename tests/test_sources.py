import pytest
from pyspark.sql import functions as F

from tallyloom.sources import tables

TOML = '[dataset]\nentity = "place"\ntime = "day"\ntotal = "n"\ntargets = ["a", "b"]\n'


def test_schema_rules(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text(TOML)
    assert tables.read_schema(str(path)).targets == ("a", "b")
    path.write_text(TOML + "extra = 1\n")
    with pytest.raises(tables.TableError):
        tables.read_schema(str(path))
    for bad in ({"targets": ("a",)}, {"targets": ("a", "a")}, {"targets": ("a", "place")}, {"time_format": "yyyy", "time": None}, {"group_map": "x"}):
        with pytest.raises(tables.TableError):
            tables.PanelSchema(**{"entity": "place", "targets": ("a", "b"), "time": "day"} | bad)


def test_csv_to_panel(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("place,day,n,a,b,note\nx,2024-01-01,10,3,NA,hi\nx,2024-01-02,10,0,nan,\ny,2024-01-01,4,4,0,z\n")
    schema = tables.PanelSchema("place", ("a", "b"), "day", "n")
    raw = tables.read_csv(spark, str(path), schema)
    panel = tables.panel_from(raw, schema)
    assert [r["c"] for r in panel.orderBy("entity", "time").collect()] == [[3.0, None], [0.0, None], [4.0, 0.0]]
    tables.check(panel)
    rows, kind = tables.parse_times(panel, "time")
    assert kind == "date" and [r["days"] for r in rows.orderBy("entity", "time").collect()] == [0, 1, 0]
    with pytest.raises(tables.TableError):
        tables.check(panel.unionByName(panel))
    with pytest.raises(tables.TableError):
        tables.check(panel.withColumn("n", F.lit(1.0)))
    with pytest.raises(tables.TableError):
        tables.read_csv(spark, str(path), tables.PanelSchema("place", ("a", "zz")))


def test_cell_codes(spark):
    texts = ["", " NA ", "1.5", "-1", "1d", "inf", "1e999", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tables.cell_code(F.col("t")).alias("code")).collect()
    assert {r["t"]: r["code"] for r in rows} == {"": None, " NA ": None, "1.5": None, "-1": "negative", "1d": "not_a_number", "inf": "not_a_number", "1e999": "infinite", "x": "not_a_number"}


def test_groups(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "entity string")
    mapping = spark.createDataFrame([("x", "g"), ("x", "h")], "entity string, g string")
    assert [r["entity"] for r in tables.unknown_entities(rows, mapping).collect()] == ["y"]
    assert [r["entity"] for r in tables.map_conflicts(mapping, "g").collect()] == ["x"]


def test_outputs(spark, tmp_path):
    source = spark.createDataFrame([(0, ["x", "NA", "2"], "f", 0, 0)], "row_id long, source array<string>, _file string, _block long, _nth long")
    filled = spark.createDataFrame([(0, [1.5, 2.0])], "row_id long, filled array<double>")
    tables.write_completed(filled, source, str(tmp_path / "out"), ["place", "a", "b"], ("a", "b"))
    row = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert (row["a"], row["b"]) == ("1.5", "2")
    with pytest.raises(Exception):
        tables.write_completed(filled, source, str(tmp_path / "out"), ["place", "a", "b"], ("a", "b"))
    tables.write_na_csv(spark.createDataFrame([(1, None)], "a int, b int"), str(tmp_path / "na"))
    assert spark.read.option("header", True).csv(str(tmp_path / "na")).first()["b"] == "NA"
    rows = spark.createDataFrame([("m", "random_cell", 1.0)], "model string, mask string, pred double")
    tables.write_predictions(rows, str(tmp_path / "p"))
    assert tables.read_predictions(spark, str(tmp_path / "p")).count() == 1
    assert tables.table_digest(rows, ["model", "pred"]).first()["rows"] == 1


def test_manifest(tmp_path):
    (tmp_path / "a.txt").write_text("1")
    tables.manifest(tmp_path, ["a.txt"])
    assert tables.verify_manifest(tmp_path) == []
    (tmp_path / "a.txt").write_text("2")
    assert tables.verify_manifest(tmp_path) == ["a.txt"]
