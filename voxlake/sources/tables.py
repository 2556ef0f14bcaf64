"""Text sources and sinks: motion files, sidecars, parameters, atlas tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import params, parse_run_path, short_decimal
from ..model import CHANNELS
from ..operators.order import place_in_order


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_motion(spark: SparkSession, path: str, rotations_first: bool = True) -> DataFrame:
    """A row a frame of white-space separated six-column files: path, the parts of its name, t, channels.

    t is the line's place in its file.  A line with another number of columns is
    an error.
    """
    return motion_rows(_texts(spark, path), rotations_first)


def motion_rows(files: DataFrame, rotations_first: bool = True) -> DataFrame:
    """read_motion for files that are in a table: path and value."""
    # a file without lines has no rows, so its name isn't looked at; of the others it is taken apart once a file, not once a line
    filled = files.where(F.col("value").rlike(r"[^ \r\n]|\r(?!\n)"))
    named = filled.select("path", "value", parse_run_path(F.col("path")).alias("p")).select("path", "value", "p.sub", F.col("p.session").alias("ses"), "p.task", "p.run")
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")
    rows = named.select("path", "sub", "ses", "task", "run", F.posexplode(lines).alias("t", "line"))
    # split in a step of its own: a line is cut once, both for the check and for the cells
    cells = rows.select("path", "sub", "ses", "task", "run", F.col("t").cast("long").alias("t"), F.split(F.trim("line"), r"\s+").alias("c"))
    sound = F.when(F.size("c") == 6, F.col("c")).otherwise(F.raise_error(F.lit("a motion file has six columns")).cast("array<string>"))
    names = CHANNELS if rotations_first else CHANNELS[3:] + CHANNELS[:3]
    checked = cells.withColumn("c", sound)
    return checked.select("path", "sub", "ses", "task", "run", "t", *[F.col("c")[k].cast("double").alias(n) for k, n in enumerate(names)])


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(path, slice_timing array<double>) of JSON sidecars; without a list of numbers under SliceTiming an error."""
    return sidecar_rows(_texts(spark, path))


def sidecar_rows(files: DataFrame) -> DataFrame:
    """read_sidecar for files that are in a table: path and value."""
    found = F.get_json_object("value", "$.SliceTiming")
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<double>")
    # true and false count as 1 and 0
    numbers = F.from_json(F.regexp_replace(F.regexp_replace(found, "true", "1"), "false", "0"), "array<double>")
    sound = F.when(found.isNull(), fail("no SliceTiming")).when(~found.startswith("["), fail("SliceTiming isn't a list")).when(found.contains('"'), fail("SliceTiming holds a string"))
    return files.select("path", sound.otherwise(numbers).alias("slice_timing"))


def timing_lines(sidecars: DataFrame) -> DataFrame:
    """A line a slice, with six significant digits."""
    return sidecars.select("path", F.posexplode("slice_timing").alias("line_no", "v")).select("path", "line_no", short_decimal(F.col("v")).alias("line"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """(path, params map<string, string>) of key=value files."""
    return _texts(spark, path).select("path", params(F.col("value")).alias("params"))


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file, lines in order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)


def read_labels_xml(spark: SparkSession, path: str) -> DataFrame:
    """(index, x, y, z, name) of label elements."""
    rows = spark.read.format("xml").option("rowTag", "label").schema("_index int, _x double, _y double, _z double, _VALUE string").load(path)
    return rows.select(F.col("_index").alias("index"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"), F.trim("_VALUE").alias("name"))


def write_lines(df: DataFrame, path: str, line: str = "line", order: str = "line_no") -> None:
    """One text file with the lines in order; for files a person reads, such as a filled template."""
    df.coalesce(1).sortWithinPartitions(order).select(line).write.mode("overwrite").text(path)


def matrix_line(columns: list[str]) -> Column:
    """A row of a text matrix: columns with single spaces between."""
    return F.concat_ws(" ", *columns)


def write_matrix(df: DataFrame, path: str, columns: list[str], header: bool = False, order: str = "t") -> None:
    """Columns as text with single spaces, one file."""
    rows = df.coalesce(1).sortWithinPartitions(order).select(matrix_line(columns).alias("line"))
    if header:
        rows = df.sparkSession.createDataFrame([(" ".join(columns),)], "line string").coalesce(1).union(rows).coalesce(1)
    rows.write.mode("overwrite").text(path)


def quality_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no long, line) of the quality table as CSV below its header: a leading row number from 0, then all columns, nulls empty.

    Rows are numbered in the order of whole-number columns that aren't negative.
    """
    key = F.concat_ws("/", *[F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 20, "0") for c in order])
    placed = place_in_order(df.withColumn("__key", key), "__key", "line_no")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return placed.select("line_no", F.concat_ws(",", F.col("line_no").cast("string"), *cells).alias("line"))


def write_quality_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """The quality table as one CSV file with a header and a leading row number without a name, from 0: a row a run, for a person to read."""
    head = df.sparkSession.createDataFrame([(-1, ",".join(['""', *df.columns]))], "line_no long, line string")
    head.unionByName(quality_lines(df, order)).coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def labels_csv_rows(files: DataFrame, schema: str) -> DataFrame:
    """Rows of label tables that are in a table (path, value): path and the columns of ``schema``; a mark at the start and the header line are left out."""
    lines = F.filter(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n"), lambda s: F.trim(s) != "")
    rows = files.select("path", F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    return rows.select("path", F.from_csv("line", schema, {"escape": '"'}).alias("r")).select("path", "r.*")


def labels_xml_rows(files: DataFrame) -> DataFrame:
    """(path, index, x, y, z, name) of the label elements of XML files that are in a table (path, value)."""
    parts = {c: F.xpath("value", F.lit(f"//label/@{c}")) for c in ("index", "x", "y", "z")} | {"name": F.xpath("value", F.lit("//label/text()"))}
    rows = files.select("path", F.inline(F.arrays_zip(*[v.alias(k) for k, v in parts.items()]))).toDF("path", *parts)
    return rows.select("path", F.col("index").cast("int").alias("index"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.trim("name").alias("name"))


def read_affine(text: str) -> list[list[float]]:
    """Rows of numbers of a text matrix."""
    return [[float(v) for v in line.split()] for line in text.strip().splitlines() if line.strip()]
