"""Motion files in tables: names are taken apart once a file, lines cut once, and odd files give what they always gave."""

import pytest

from voxlake.sources import tables

LINE = "1 2 3 4 5 6"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, value string")


def test_names_are_parsed_once_a_file_and_lines_are_cut_once(spark):
    df = tables.motion_rows(files(spark, ("sub-01_task-a_run-02.par", LINE)).repartition(1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines, each_file = plan.split("Generate", 1)
    assert "regexp_extract" not in lines and "regexp_extract" in each_file
    assert lines.count("split(trim(") == 1


def test_odd_files(spark):
    odd = files(
        spark,
        ("D-sub-01_ses-02_task-a_run-03.par", f"{LINE}\r\n\r\n   \n -1e-3\t2 3  4 5 NaN \n"),
        ("other.txt", LINE),
        (None, LINE),
        ("twice_sub-01_task-a_run-02.par", LINE),
        ("twice_sub-01_task-a_run-02.par", LINE),
        ("sub-01_task-a_run-01.par", None),
        ("sub-01_task-a_run-01.par", ""),
        ("sub-01_task-a_run-01.par", " \r\n  \n\n"),
        ("sub-99999999999_task-a_run-01.par", " \n"),
    )
    got = tables.motion_rows(odd)
    assert got.columns == ["path", "sub", "ses", "task", "run", "t", "rx", "ry", "rz", "tx", "ty", "tz"]
    want = [
        ("D-sub-01_ses-02_task-a_run-03.par", 1, "02", "a", 3, 0, 1.0, 2.0, 3.0, 4.0, 5.0, "6.0"),
        ("D-sub-01_ses-02_task-a_run-03.par", 1, "02", "a", 3, 1, -1e-3, 2.0, 3.0, 4.0, 5.0, "nan"),
        *[(path, None, None, None, None, 0, 1.0, 2.0, 3.0, 4.0, 5.0, "6.0") for path in ("other.txt", None, *["twice_sub-01_task-a_run-02.par"] * 2)],
    ]
    assert sorted(((*row[:-1], str(row[-1])) for row in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("value, text", [("1 2 3 4 5", "six columns"), (f"{LINE}\n{LINE} 7", "six columns"), ("\r\r\n", "six columns"), ("1 2 3 4 5 x", "x")])
def test_lines_that_are_not_six_numbers_are_refused(spark, value, text):
    df = tables.motion_rows(files(spark, ("sub-01_task-a_run-02.par", value)))
    with pytest.raises(Exception, match=text):
        df.collect()
    if "x" not in value and value.strip():
        assert df.select("path", "t").count() == len(value.split("\n"))


def test_a_number_too_long_for_a_name_is_refused_where_the_file_has_lines(spark):
    with pytest.raises(Exception, match="99999999999"):
        tables.motion_rows(files(spark, ("sub-99999999999_task-a_run-01.par", LINE))).collect()
