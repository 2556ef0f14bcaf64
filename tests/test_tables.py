import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import text as X
from voxlake.operators import atlas, catalog, events, template
from voxlake.operators.order import place_in_order
from voxlake.sources import images, tables


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("value", [0.5, 0.0, 1.0, -2.25, 1 / 3, 123456.0, 1234567.0, 1e-4, 1e-5, 99999.95, 999999.5, 1e20, -1e-300, 0.1 + 0.2, 100.0])
def test_short_decimals(spark, value):
    assert one(spark, X.short_decimal(F.col("v")), v=value) == "%g" % value


@pytest.mark.parametrize("value", [0.125, 0.135, 2.675, -0.001, 1e9, 0.005])
def test_fixed_decimals(spark, value):
    assert one(spark, X.fixed_decimal(F.col("v"), 2), v=value) == "%.2f" % value


def test_padding_keeps_long_numbers(spark):
    assert [one(spark, X.zero_padded(F.col("v"), w), v=v) for v, w in ((7, 2), (123, 2), (7, 3))] == ["07", "123", "007"]


def test_paths_there_and_back(spark):
    rows = [("D", 3, "02", "faces", 1), ("", 12, "", "rest", 10), (None, 123, None, "a", 4)]
    df = spark.createDataFrame(rows, "specie string, sub int, ses string, task string, run int")
    made = df.select("*", X.run_path(*[F.col(c) for c in ("specie", "sub", "ses", "task", "run")], "_bold.nii.gz").alias("path"))
    assert [r.path for r in made.collect()] == ["D-sub-03_ses-02_task-faces_run-01_bold.nii.gz", "sub-12_task-rest_run-10_bold.nii.gz", "sub-123_task-a_run-04_bold.nii.gz"]
    back = made.select(X.parse_run_path(F.concat(F.lit("/data/x/"), "path")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in back] == [("D", 3, "02", "faces", 1, "_bold.nii.gz"), (None, 12, None, "rest", 10, "_bold.nii.gz"), (None, 123, None, "a", 4, "_bold.nii.gz")]
    assert one(spark, X.without_suffix(F.col("v")), v="a.b.nii.gz") == "a.b"


def test_labels(spark):
    assert tuple(one(spark, X.parse_run_label(F.col("v")), v="Run 3 (Session 02)")) == (3, "02")
    assert tuple(one(spark, X.parse_session_run(F.col("v")), v="ses-01_run-7")) == ("01", 7)
    assert one(spark, X.run_label(F.col("v"), F.lit("")), v=4) == "Run 4"
    assert one(spark, X.single_spaced(F.col("v")), v="a    b  c") == "a b c"


def test_species(spark):
    assert [one(spark, X.species_name(F.col("v"), "Hum"), v=v) for v in "DHX"] == ["Dog", "Hum", "Hum"]
    with pytest.raises(Exception, match="unknown species"):
        one(spark, X.species_name(F.col("v")), v="X")
    assert [one(spark, X.brain_extraction_flag(F.col("v")), v=v) for v in "DHX"] == [0, 1, None]


def test_params(spark, tmp_path):
    assert one(spark, X.params(F.col("v")), v="a=1\n\nb = two \na=3\n") == {"a": "3", "b": "two"}
    assert one(spark, X.params_text(X.params(F.col("v"))), v="b=2\na=1") == "a=1\nb=2"
    for bad in ("a=b=c", "nothing"):
        with pytest.raises(Exception, match="not key=value"):
            one(spark, X.params(F.col("v")), v=bad)
    (tmp_path / "p.txt").write_text("x_lim1=4\r\nx_lim2=9\r\n")
    assert tables.read_params(spark, str(tmp_path)).first().params == {"x_lim1": "4", "x_lim2": "9"}


def test_motion_files(spark, tmp_path):
    (tmp_path / "D-sub-01_task-a_run-02.par").write_text("  1 2 3 4 5 6\n-1e-3\t2 3 4 5 6.5\n\n")
    rows = tables.read_motion(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r.sub, r.run, r.t, r.rx, r.tz) for r in rows] == [(1, 2, 0, 1.0, 6.0), (1, 2, 1, -1e-3, 6.5)]
    assert tables.read_motion(spark, str(tmp_path), rotations_first=False).orderBy("t").first().tx == 1.0
    (tmp_path / "bad.par").write_text("1 2 3\n")
    with pytest.raises(Exception, match="six columns"):
        tables.read_motion(spark, str(tmp_path / "bad.par")).collect()


def test_sidecars(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"SliceTiming": [0, 0.5, True, 1.25e-3], "Other": "x"}, indent=1))
    got = tables.timing_lines(tables.read_sidecar(spark, str(tmp_path))).orderBy("line_no").collect()
    assert [r.line for r in got] == ["0", "0.5", "1", "0.00125"]
    for name, content, message in (("none", {}, "no SliceTiming"), ("text", {"SliceTiming": "x"}, "isn't a list"), ("item", {"SliceTiming": [1, "x"]}, "a string")):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
        with pytest.raises(Exception, match=message):
            tables.read_sidecar(spark, str(tmp_path / f"{name}.json")).collect()


def test_templates(spark, tmp_path):
    (tmp_path / "t.fsf").write_text("# note\nset fmri(tr) 3.0\nset fmri(npts) 0\nset fmri(tr) and set fmri(npts)\nset feat_files(1) \"\"\nend")
    lines = tables.read_template(spark, str(tmp_path / "t.fsf"))
    made = template.fill(lines, template.rules(spark, template.PREPROCESS, {"TR": 2.0, "Volumes": 100, "Input": "a.nii"}))
    assert [r.line for r in made.orderBy("line_no").collect()] == ["# note", "set fmri(tr) 2.0", "set fmri(npts) 100", "set fmri(tr) 2.0", 'set feat_files(1) "a.nii"', "end"]
    two = spark.createDataFrame([("a", 0, "k v"), ("b", 0, "k v")], "job string, line_no int, line string")
    rules = spark.createDataFrame([("b", 0, "x", "k", "k new")], "job string, priority int, label string, find string, replacement string")
    assert sorted((r.job, r.line) for r in template.fill(two, rules, ("job",)).collect()) == [("a", "k v"), ("b", "k new")]
    tables.write_lines(made, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()][1] == "set fmri(tr) 2.0"


def test_catalog(spark):
    runs = catalog.run_grid(spark, [1, 2], ["01"], [1, 2]).withColumn("task", F.lit("a"))
    need = catalog.expected_files(runs, "preprocess_run", "d")
    assert sorted(r.path for r in need.collect())[0] == "d/BIDS/sub-01/sub-01_ses-01_task-a_run-01_bold.json"
    mean = catalog.expected_files(runs, "get_mean_fct", specie=F.lit("D"))
    assert sorted(r.path for r in mean.collect())[0] == "preprocessing/D-sub-01/D-sub-01_ses-01_task-a_run-01_reoriented.nii.gz"
    assert need.count() == 8
    there = need.where("not (sub = 2 and run = 2 and path like '%json')").select("path")
    assert {(r.sub, r.run): r.available for r in catalog.available(need, there, ["sub", "run"]).collect()} == {(1, 1): True, (1, 2): True, (2, 1): True, (2, 2): False}
    assert catalog.missing(need, there).count() == 1 and catalog.present(need, there).count() == 7
    assert catalog.catalogue(there).where("sub = 1").count() == 4
    with pytest.raises(ValueError):
        catalog.expected_files(runs, "nothing")
    assert catalog.search_ranges(spark, axes=("x",)).count() == 45


def test_jobs(spark, capsys):
    df = catalog.jobs(spark, [{"sub_N": 1, "Status": "Finished"}, {"sub_N": 2, "Status": "Pending"}, {"sub_N": 3}])
    left = catalog.unfinished(df)
    assert sorted(r.sub_N for r in left.collect()) == [2, 3]
    assert catalog.schedule(left).columns == list(catalog.SHOWN.values())
    assert catalog.dispatch("x", {"x": lambda: df}) is df and catalog.dispatch("y", {}) is None
    assert "no process y" in capsys.readouterr().out
    rows = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "r array<int>, s array<string>")
    assert [(p.run, p.ses) for p in catalog.paired(rows, "r", "s", ("run", "ses")).collect()] == [(1, "a"), (2, "b")]
    assert [(r.name, r.number) for r in catalog.numbered(spark.createDataFrame([("b",), ("a",)], "name string")).collect()] == [("a", 1), ("b", 2)]


def test_events(spark):
    df = spark.createDataFrame([(0.125, 1.0, 1.0), (2.345, 0.5, 1.0)], "onset double, duration double, one double")
    assert [r.x for r in df.select(events.event_lines(df).alias("x")).collect()] == ["0.12\t1.00\t1.00", "2.34\t0.50\t1.00"]
    assert events.concatenate([df, df]).where("file = 1").count() == 2


def test_atlas(spark, tmp_path):
    keys = atlas.roi_parts(spark.createDataFrame([(1, "F_A_B_L.nii.gz"), (2, "P_C_R.nii")], "index int, file string"))
    assert [(r.lobe, r.abbrev, r.side) for r in keys.orderBy("index").collect()] == [("F", "A_B", "L"), ("P", "C", "R")]
    assert [r.lobe_name for r in atlas.lobe_of(spark.createDataFrame([("CN",), ("X",)], "lobe string")).collect()] == ["Cingulate", None]
    (tmp_path / "l.csv").write_text("Number,Region\n1,  left   cortex \n", encoding="utf-8-sig")
    assert atlas.clean_names(tables.read_labels_csv(spark, str(tmp_path / "l.csv")), "Region").first().Region == "left cortex"
    (tmp_path / "l.xml").write_text('<atlas><data><label index="3" x="1.5" y="2" z="-3">Gyrus L</label></data></atlas>')
    assert tuple(tables.read_labels_xml(spark, str(tmp_path / "l.xml")).first()) == (3, 1.5, 2.0, -3.0, "Gyrus L")
    regions = spark.createDataFrame([("A_B", "Region")], "abbrev string, name string")
    for limit in (1, 10):
        assert {r.abbrev: r.name for r in atlas.region_of(keys, regions, "abbrev", limit).collect()} == {"A_B": "Region", "C": None}


def test_text_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, 0), (0, 1.5, 1)], "t int, a double, b int")
    tables.write_matrix(df, str(tmp_path / "m"), ["a", "b"], header=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["a b", "1.5 1", "2.5 0"]
    tables.write_quality_csv(df, str(tmp_path / "q"), ["t"])
    assert [r.value for r in spark.read.text(str(tmp_path / "q")).collect()] == ['"",t,a,b', "0,0,1.5,1", "1,1,2.5,0"]
    assert tables.read_affine("1 0\n0 1\n\n") == [[1.0, 0.0], [0.0, 1.0]]


def test_streaming_displacement(spark, tmp_path):
    import numpy as np

    from voxlake.model import CHANNELS
    from voxlake.operators.motion import framewise_displacement
    from voxlake.streaming.motion import streaming_displacement

    rng = np.random.default_rng(0)
    schema = "run int, t long, " + ", ".join(f"{c} double" for c in CHANNELS)
    rows = [(run, t, *map(float, rng.normal(size=6))) for run in (1, 2) for t in range(12)]
    batch = spark.createDataFrame(rows, schema)
    parts = [rows[0:3] + rows[12:20], rows[5:9] + rows[20:24], rows[3:5] + rows[9:12] + rows[0:1]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = streaming_displacement(stream).writeStream.format("memory").queryName("moved").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.run, r.t): r.fd for r in spark.table("moved").collect()}
    want = {(r.run, r.t): r.fd for r in framewise_displacement(batch, ["run"], detrend=False).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("range_rows", [3, 40, 100_000])
def test_places_in_a_long_list(spark, range_rows):
    rng = np.random.default_rng(0)
    names = ["".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(500)] + [None]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, k int").repartition(5)
    got = sorted((r.place, r.name) for r in place_in_order(df, "name", "place", 1, range_rows).collect())
    assert [p for p, _ in got] == list(range(1, 502)) and [n for _, n in got] == [None, *sorted(n for n in names if n)]
    assert place_in_order(df.limit(0), "name", "place").count() == 0


def test_templates_keep_repeated_lines_and_take_the_first_rule(spark):
    lines = spark.createDataFrame([(1, "set a"), (1, "set a"), (2, None), (3, "set b"), (4, "other")], "line_no int, line string")
    rules = spark.createDataFrame([(2, "x", "set", "second"), (1, "y", "set a", "first")], "priority int, label string, find string, replacement string")
    want = [(1, "first"), (1, "first"), (2, None), (3, "second"), (4, "other")]
    assert sorted(map(tuple, template.fill(lines, rules).collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, template.fill(lines, rules.limit(0)).collect()), key=repr) == sorted(map(tuple, lines.collect()), key=repr)
    two = lines.withColumn("job", F.lit("a")).union(lines.withColumn("job", F.lit("b")))
    got = template.fill(two, rules.withColumn("job", F.lit("b")), ("job",)).collect()
    assert sorted([(r.line_no, r.line) for r in got if r.job == "b"], key=repr) == sorted(want, key=repr)
    assert sorted([(r.line_no, r.line) for r in got if r.job == "a"], key=repr) == sorted(map(tuple, lines.collect()), key=repr)


def test_places_of_ties_are_the_same_each_time(spark):
    names = ["x"] * 500 + [f"n{k % 7}" for k in range(200)]
    rows = [(n, k) for k, n in enumerate(names)]
    got = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "name string, k int").repartition(parts)
        placed = place_in_order(df, "name", "place", range_rows=50)
        assert placed.schema["place"].dataType.simpleString() == "bigint"
        got.append(sorted((r.place, r.name, r.k) for r in placed.collect()))
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(700)) and [r[1] for r in got[0]] == sorted(names)


def test_grids_and_ranges_of_tables(spark):
    projects = spark.createDataFrame([("p", [1, 2], ["01", "02"], [1]), ("q", [3], [], [1]), ("r", [4], None, [1])], "project string, participants array<int>, sessions array<string>, runs array<int>")
    assert sorted(map(tuple, catalog.run_grid_of(projects).collect())) == [("p", 1, "01", 1), ("p", 1, "02", 1), ("p", 2, "01", 1), ("p", 2, "02", 1)]
    searches = spark.createDataFrame([(1, [3, 1, 2, 1], [5, 6]), (2, [1], [5, 6])], "id int, x array<int>, y array<int>")
    assert sorted(map(tuple, catalog.search_ranges_of(searches, ("x", "y")).collect())) == [(1, 1, 2, 5, 6), (1, 1, 3, 5, 6), (1, 2, 3, 5, 6)]


def test_label_tables_and_matrix_files_in_tables(spark):
    made = spark.createDataFrame([("a", "\ufeffN,R\r\n1,\"x, y\"\r\n\r\n2,z\r\n"), ("b", ""), ("c", "N,R")], "path string, value string")
    assert sorted(map(tuple, tables.labels_csv_rows(made, "n int, r string").collect())) == [("a", 1, "x, y"), ("a", 2, "z")]
    xml = spark.createDataFrame([("a", '<d><label index="3" x="1" y="2.5" z="-1"> left  </label></d>'), ("b", "<d></d>")], "path string, value string")
    assert list(map(tuple, tables.labels_xml_rows(xml).collect())) == [("a", 3, 1.0, 2.5, -1.0, "left")]
    assert images.matrix_rows(spark.createDataFrame([("a", None)], "path string, content binary")).count() == 0
