import json

import pytest
from pyspark.sql import functions as F

from tallyloom import panel as pn
from tallyloom import run
from tallyloom.operators import cases, imputers, residual, sequences, staged
from tallyloom.plans import protocol
from tallyloom.sources import tables

CSV = "place,day,n,a,b,c\n" + "".join(f"p{i % 4},2024-0{1 + i // 4}-01,{20 + i},{i % 5},{'NA' if i % 7 == 3 else 3},{(i * 3) % 8}\n" for i in range(24))
SCHEMA = '[dataset]\nentity = "place"\ntime = "day"\ntotal = "n"\ntargets = ["a", "b", "c"]\n'


def test_runner_end_to_end(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    (tmp_path / "s.toml").write_text(SCHEMA)
    args = ["--data", str(tmp_path / "t.csv"), "--schema", str(tmp_path / "s.toml"), "--output", str(tmp_path / "out"), "--mask", "random_cell", "--mask-rate", "0.2", "--seeds", "0", "1", "--only", "zero_fill", "mean_fill"]
    assert run.main(args, spark) == 0
    status = json.loads((tmp_path / "out/status.json").read_text())
    assert [s["status"] for s in status] == ["completed", "completed"]
    done = spark.read.option("header", True).csv(str(tmp_path / "out/completed_mean_fill"))
    assert done.count() == 24 and done.where("a is null or b is null or c is null").count() == 0
    assert spark.read.parquet(str(tmp_path / "out/predictions")).select("model", "seed").distinct().count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "out/pairs")).count() == 1
    with pytest.raises(SystemExit):
        run.main(args, spark)


def written(tmp_path, csv, schema=SCHEMA):
    (tmp_path / "t.csv").write_text(csv)
    (tmp_path / "s.toml").write_text(schema)
    return tables.read_schema(str(tmp_path / "s.toml"))


@pytest.mark.parametrize(
    ("row", "code", "feature"),
    [
        ("p9,2024-01-01,9,1,2\n", "wrong_width", None),
        ("p9,2024-01-01,9,1,2,3,4\n", "wrong_width", None),
        ("p9,2024-01-01,9,abc,2,3\n", "not_a_number", "a"),
        ("p9,2024-01-01,9,1,-5,3\n", "negative", "b"),
        ("p9,2024-01-01,,1,2,3\n", "missing", "n"),
        ("p9,2024-01-01,5,1,2,3\n", "counts_exceed_total", None),
        ("p1,2024-01-01,9,1,2,3\n", "repeated_key", None),
    ],
)
def test_bad_rows_are_refused_by_entity_and_line(spark, tmp_path, capsys, row, code, feature):
    written(tmp_path, CSV + row)
    args = ["--data", str(tmp_path / "t.csv"), "--schema", str(tmp_path / "s.toml"), "--output", str(tmp_path / "out")]
    assert run.main(args, spark) == 2 and not (tmp_path / "out").exists()
    said = json.loads(capsys.readouterr().err.strip().splitlines()[-1])
    assert (said["code"], said["entity"], said["feature"]) == (code, row.split(",")[0], feature)
    assert said["line"] == (3 if code == "repeated_key" else 26)


def test_times_and_numbers_of_rows(spark, tmp_path):
    numeric = "place,day,n,a,b,c\nx,0.25,9,1,2,3\nx,0.5,9,1,2,3\nx,200001,9,1,2,3\ny,1,9,1,2,3\nz,1,9,1,2,3\n"
    rows = run.panel_of(spark, str(tmp_path / "t.csv"), written(tmp_path, numeric)).collect()
    assert len({r["row_id"] for r in rows}) == 5 and sorted(r["days"] for r in rows if r["entity"] == "x") == [0.25, 0.5, 200001]
    labels = "place,day,n,a,b,c\n" + "".join(f"x,w{k:02},9,1,2,3\n" for k in (3, 1, 2))
    rows = run.panel_of(spark, str(tmp_path / "t.csv"), written(tmp_path, labels)).orderBy("row_id").collect()
    assert [r["days"] for r in rows] == [0, 1, 2]
    for bad in ("x,2024-01-01,9,1,2,3\nx,1,9,1,2,3\n", "x,1.0,9,1,2,3\nx,1,9,1,2,3\n"):
        with pytest.raises(tables.TableError):
            run.panel_of(spark, str(tmp_path / "t.csv"), written(tmp_path, "place,day,n,a,b,c\n" + bad))


def test_group_map(spark, tmp_path):
    schema = written(tmp_path, CSV, SCHEMA + 'group_col = "area"\ngroup_map = "map.csv"\n')
    mapped = lambda text: ((tmp_path / "map.csv").write_text("place,area\n" + text), run.panel_of(spark, str(tmp_path / "t.csv"), schema, tmp_path))[1]
    got = {(r["entity"], r["grp"]) for r in mapped("p0,north\np1,north\np2,south\np3,south\np8,x\n").collect()}
    assert got == {("p0", "north"), ("p1", "north"), ("p2", "south"), ("p3", "south")}
    for bad in ("p0,north\n", "p0,a\np0,b\np1,a\np2,a\np3,a\n", "p0,\np1,a\np2,a\np3,a\n"):
        with pytest.raises(tables.TableError):
            mapped(bad)


def test_six_targets_in_every_model_and_mask(spark, tmp_path):
    names = "abcdef"
    rows = [f"p{i % 4},2024-{1 + i // 4 % 12:02}-{1 + i // 48:02},{60 + i},{','.join('NA' if (i * 7 + k * 3) % 11 == 0 else str((i * (k + 2)) % 7 + k) for k in range(6))}" for i in range(96)]
    written(tmp_path, "place,day,n," + ",".join(names) + "\n" + "\n".join(rows) + "\n", '[dataset]\nentity = "place"\ntime = "day"\ntotal = "n"\ntargets = ["a", "b", "c", "d", "e", "f"]\n')
    for mask in ("random_cell", "whole_feature"):
        out = tmp_path / mask
        args = ["--data", str(tmp_path / "t.csv"), "--schema", str(tmp_path / "s.toml"), "--output", str(out), "--mask", mask, "--mask-rate", "0.1", "--seeds", "1"]
        only = ["--only", "mean_fill", "hron", "tsagris", "micoda", "micoda_other"] if mask == "random_cell" else ["--only", "mean_fill"]
        assert run.main(args + only, spark) == 0
        got = spark.read.parquet(str(out / "predictions"))
        assert got.where("t >= 4").groupBy("model").agg(F.avg("pred_count").alias("x")).where("x <= 0").count() == 0
        schema, source = tables.read_schema(str(tmp_path / "s.toml")), spark.read.parquet(str(out / "panel"))
        assert tables.read_completed(spark, str(out / "completed_mean_fill"), schema, source, tables.header(spark, str(tmp_path / "t.csv"))).count() == 96
    with pytest.raises(SystemExit):
        run.main(["--data", "x", "--schema", str(tmp_path / "s.toml"), "--output", str(tmp_path / "no"), "--only", "micoda", "--rule", "rescale"], spark)


ODD = 'place,"a note, quoted",day,n,a,b,c,more\n' + "".join(f'p{i % 4},"x, ""y""",2024-0{1 + i // 4}-01,{20 + i},{i % 5},{"NA" if i % 7 == 3 else "3.0"},{(i * 3) % 8:02d}, z \n' for i in range(24))


@pytest.mark.parametrize(
    ("row", "code"),
    [
        ("p9,q,2024-01-01,9,1,2\n", "wrong_width"),
        ("p9,q,2024-01-01,9,1,2,3,4,5\n", "wrong_width"),
        ("p9,q,2024-01-01,9,1,2,3,4,5,6,7\n", "wrong_width"),
        ('p9,"two\nlines",2024-01-01,9,1,2,x,4\n', "not_a_number"),
        (" p1 ,q, 2024-01-01,9,1,2,3,4\n", "repeated_key"),
    ],
)
def test_strict_with_columns_that_no_one_reads(spark, tmp_path, row, code):
    schema = written(tmp_path, ODD + row)
    with pytest.raises(tables.TableError) as error:
        run.panel_of(spark, str(tmp_path / "t.csv"), schema)
    assert error.value.code == code and error.value.line == (3 if code == "repeated_key" else 26)


def test_quoted_line_feeds_are_one_row(spark, tmp_path):
    schema = written(tmp_path, ODD + 'p9,"two\nlines, and ""quotes""",2024-01-01,9,1,2,3,4\n')
    rows = run.panel_of(spark, str(tmp_path / "t.csv"), schema)
    assert rows.count() == 25 and rows.where("entity = 'p9'").first()["source"][1] == 'two\nlines, and "quotes"'
    schema = written(tmp_path, 'place,"day\nof","n",a,b,c\nx,2024-01-01,9,1,2,3\nx,2024-01-02,1,1,2,3\n', SCHEMA.replace('"day"', '"day\\nof"'))
    with pytest.raises(tables.TableError) as error:
        run.panel_of(spark, str(tmp_path / "t.csv"), schema)
    assert (error.value.code, error.value.line) == ("counts_exceed_total", 4)


def test_every_refusal_names_its_row(spark, tmp_path):
    def refusal(csv, schema=SCHEMA, groups=None):
        if groups is not None:
            (tmp_path / "map.csv").write_text("place,area\n" + groups)
        with pytest.raises(tables.TableError) as error:
            run.panel_of(spark, str(tmp_path / "t.csv"), written(tmp_path, csv, schema), tmp_path)
        return error.value.code, error.value.entity, error.value.time, error.value.line

    mapped, own = SCHEMA + 'group_col = "area"\ngroup_map = "map.csv"\n', SCHEMA + 'group_col = "area"\n'
    assert refusal("place,day,n,a,b,c\nx,2,9,1,2,3\nx,1.0,9,1,2,3\nx,1,9,1,2,3\n") == ("repeated_time", "x", "1.0", 3)
    assert refusal(CSV, mapped, "p0,a\np1,a\np3,a\n") == ("no_group", "p2", "2024-01-01", 4)
    assert refusal(CSV, mapped, "p0,a\np1,a\np2,a\np2,b\np3,a\n") == ("group_conflict", "p2", "2024-01-01", 4)
    assert refusal(CSV, mapped, "p0,a\np1,\np2,a\np3,a\n") == ("empty_group", "p1", "2024-01-01", 3)
    assert refusal("place,area,day,n,a,b,c\nx,g,1,9,1,2,3\nx, ,2,9,1,2,3\n", own) == ("empty_group", "x", "2", 3)


def test_completed_tables_keep_texts_and_columns(spark, tmp_path):
    labels = ODD.replace("2024-01-01", "jan").replace("2024-02-01", "apr").replace("2024-03-01", "mar").replace("2024-04-01", "may").replace("2024-05-01", "jun").replace("2024-06-01", "jul")
    schema = written(tmp_path, labels)
    args = ["--data", str(tmp_path / "t.csv"), "--schema", str(tmp_path / "s.toml"), "--output", str(tmp_path / "out"), "--only", "mean_fill", "same_day_mean"]
    assert run.main(args, spark) == 0
    import csv as plain
    import io

    before = list(plain.reader(io.StringIO(labels)))
    parts = sorted((tmp_path / "out/completed_mean_fill").glob("part-*"))
    after = [row for k, part in enumerate(parts) for row in list(plain.reader(io.StringIO(part.read_text())))[k > 0 :]]
    assert after[0] == before[0] and len(after) == len(before)
    for old, new in zip(before[1:], after[1:]):
        assert all(n == o if o != "NA" else float(n) > 0 for o, n in zip(old, new))
    # What the re-reader refuses.
    names, source = tables.header(spark, str(tmp_path / "t.csv")), spark.read.parquet(str(tmp_path / "out/panel"))
    done = parts[0].read_text().splitlines(keepends=True) if len(parts) == 1 else [",".join(f'"{x}"' if "," in x else x for x in row) + "\n" for row in after]
    text = "".join(done)
    for k, (change, code) in enumerate([(lambda t: t.replace("jan", "JAN", 1), "other_rows"), (lambda t: t.replace("p0,", "p7,", 1), "other_rows"), (lambda t: t.replace(" z ", "w", 1), "columns_changed"), (lambda t: t.replace(",3.0,", ",4.0,", 1), "observed_changed"), (lambda t: t + t.splitlines(keepends=True)[1], "other_rows")]):
        (tmp_path / f"bad{k}.csv").write_text(change(text))
        with pytest.raises(tables.TableError, match=code):
            tables.read_completed(spark, str(tmp_path / f"bad{k}.csv"), schema, source, names)


def test_rules_by_model():
    assert run.refused_rules(["same_day_mean", "hron", "tsagris", "micoda_other"], "prop_other") == ["same_day_mean"]
    assert run.refused_rules(["zero_fill", "mean_fill", "marginal_sampler", "micoda"], "cap") == ["zero_fill", "mean_fill", "marginal_sampler", "micoda"]
    assert run.refused_rules(["same_day_mean", "hron", "micoda_other"], "rescale") == []


def test_windows_by_kind_of_time_and_guards(spark):
    assert imputers.half_widths("date", 28, 2) == [28, 56, 112] and imputers.half_widths("numeric", 28, 3) == [0, 1, 2, 4]
    assert imputers.half_widths("label", 28, 2) == [0] and imputers.half_widths(None, 28, 2) == [None]
    schema = "row_id long, e long, entity string, grp string, days long, n double, c array<double>"
    rows = [(i, i, "x", "g", i, 10.0, [float(i), 1.0 if i else None]) for i in range(4)]
    p = lambda kind, **more: imputers.same_day(spark.createDataFrame(rows, schema), kind=kind, min_obs=1, **more).first()["p"]
    assert p("numeric") == pytest.approx(0.1) and p("label") == pytest.approx(0.1)
    for bad in ([(0, 0, "x", "g", 0, 10.0, [1.0, None])], [(0, 0, "x", "g", 0, 1e308, [1.0, None]), (1, 1, "x", "g", 0, 10.0, [1.0, 2.0])], [(0, 0, "x", "g", 0, 2.0**53, [1.0, None]), (1, 1, "x", "g", 0, 10.0, [1.0, 2.0])]):
        with pytest.raises(Exception, match="no usable cell|2\\^53"):
            imputers.same_day(spark.createDataFrame(bad, schema)).collect()


def test_unseen_target_and_long_entities(spark):
    rows = [(i, 0, "x", "g", i, 9.0, [1.0, None]) for i in range(5)]
    panel = spark.createDataFrame(rows, "row_id long, e long, entity string, grp string, days long, n double, c array<double>")
    with pytest.raises(Exception, match="no observed value of target 1"):
        imputers.mean_fill(panel).collect()
    assert sequences.unpacked(sequences.packed(panel, 3)).count() == 5


def test_flags_and_verdicts(spark):
    pred = spark.createDataFrame([("m", 1, 0, 5, 3.0, True), ("m", 1, 0, 50, 3.0, True), ("m", 1, 0, 60, 0.0, True), ("m", 1, 0, 7, 1.0, False)], "model string, seed long, t int, days long, pred_count double, truth_zero boolean")
    spans = spark.createDataFrame([(1, 0, 0, 10)], "seed long, t int, first_day long, last_day long")
    r = cases.flag_precision(cases.outside_span(pred, spans)).first()
    assert (r["flagged"], r["unflagged"], r["p_flagged"], r["p_unflagged"], r["gap"]) == (1, 2, 1.0, 0.5, 0.5)
    gaps = lambda n: spark.createDataFrame([(0.3,)] * n, "gap double")
    assert [cases.flag_verdict(gaps(n)).first()["verdict"] for n in (8, 9)] == ["insufficient", "pass"]
    rates = lambda xs: spark.createDataFrame([(x,) for x in xs], "rate double")
    none = spark.createDataFrame([(0.0,)] * 9, "regret double")
    assert [cases.verdict(rates(x), none).first()["verdict"] for x in ([1.0] * 3, [1.0] * 4, [1.0, 1.0, 1.0, 0.4])] == ["insufficient", "pass", "fail"]
    assert cases.verdict(rates([1.0] * 4), none).first()["regret_ok"]


def test_protocol(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('masks = ["random_cell"]\nseeds = [1, 2]\nmodels = ["a", "b"]\npairs = [["a", "b"]]\n')
    config = protocol.read_config(path)
    stated = protocol.frozen_hash(config)
    protocol.check_frozen(config, stated)
    with pytest.raises(protocol.ProtocolError):
        protocol.check_frozen(config | {"seeds": [3]}, stated)
    protocol.check_frozen(config | {"seeds": [3], "amendment": "why"}, stated)
    with pytest.raises(protocol.ProtocolError):
        protocol.refuse_used([1, 5], [5])
    for bad in ("x = 1\n", 'masks = []\nseeds = []\n', 'masks = []\nseeds = []\nmodels = ["a"]\npairs = [["a", "z"]]\n'):
        path.write_text(bad)
        with pytest.raises(protocol.ProtocolError):
            protocol.read_config(path)
    assert protocol.cases(["m"], [1, 2]) == [("none", None), ("m", 1), ("m", 2)]
    assert protocol.combine([True, None]) == "not confirmed" and protocol.combine([None]) == "na" and protocol.combine([True]) == "confirmed"
    assert protocol.same_runs({"a": {"seconds": 1, "b": 2}}, {"a": {"seconds": 9, "b": 2}})
    assert protocol.mean_sd([1.0, 3.0]) == "2.0000 ± 1.4142" and protocol.mean_sd([None]) == "NA"
    assert protocol.update_block("x <!-- t -->old<!-- end t --> y", "t", "new") == "x <!-- t -->\nnew\n<!-- end t --> y"


def test_staged_model_prepares_and_refuses(spark, sf):
    panel = pn.orders_panel(spark, sf)
    start, packs = staged.prepare(panel, 96)
    assert residual.violations(start).count() == 0 and packs.count() == panel.select("e").distinct().count()
    view = staged.training_view(panel, 0.15, 1)
    assert view.where(F.exists(F.zip_with("label", "c", lambda a, b: a.isNotNull() & b.isNotNull()), lambda x: x)).count() == 0
    with pytest.raises(staged.InvalidInput):
        staged.refine(start)
