"""Runs, files and jobs: which there are, which could run, and what is left to do."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import parse_run_path, run_path, zero_padded
from ..model import JOB, schema
from .order import place_in_order

#: For each process its shown name and whether it is run for every run.
PROCESSES = {
    "preprocess_run": ("Preprocess", True),
    "get_mean_fct": ("Mean fct", False),
    "mean_to_STD": ("Mean to atlas", False),
    "run_to_STD": ("Runs to atlas", True),
    "process_motion": ("Motion", False),
}
#: For each process the folder in its dataset, whether names begin with the species, and the suffixes of the files it needs.
NEEDS = {
    "preprocess_run": ("BIDS", False, ("_bold.nii.gz", "_bold.json")),
    "get_mean_fct": ("preprocessing", True, ("_reoriented.nii.gz",)),
    "run_to_STD": ("preprocessing", True, ("_mc.nii.gz",)),
    "GLM": ("normalized", True, (".nii.gz",)),
}
#: The axis combinations that are offered.
COMBINATIONS = (("x", "y", "z"), ("-x", "z", "y"), ("x", "z", "-y"), ("-x", "y", "z"))
#: Shown name of each scheduled field.
SHOWN = {
    "sub_N": "Participant", "run_N": "Run", "Process": "Process", "Status": "Status", "Atlas_type": "Atlas_type", "Dataset": "Dataset", "Full_prepro": "Full_prepro", "Combination": "Combination", "session_and_run": "session_and_run",
}


def run_grid(spark: SparkSession, participants: Sequence[int], sessions: Sequence[str], runs: Sequence[int]) -> DataFrame:
    """All combinations of participant, session and run."""
    one = spark.range(1).select(F.array(*map(F.lit, participants)).alias("p"), F.array(*map(F.lit, sessions)).alias("s"), F.array(*map(F.lit, runs)).alias("r"))
    return one.select(F.explode("p").alias("sub"), "s", "r").select("sub", F.explode("s").alias("ses"), "r").select("sub", "ses", F.explode("r").alias("run"))


def run_grid_of(projects: DataFrame, participants: str = "participants", sessions: str = "sessions", runs: str = "runs") -> DataFrame:
    """All combinations of participant, session and run of each project: other columns, sub, ses, run.  An empty or null list gives none."""
    rest = [c for c in projects.columns if c not in (participants, sessions, runs)]
    rows = projects.select(*rest, F.explode(participants).alias("sub"), sessions, runs)
    return rows.select(*rest, "sub", F.explode(sessions).alias("ses"), runs).select(*rest, "sub", "ses", F.explode(runs).alias("run"))


def paired(df: DataFrame, left: str, right: str, names: tuple[str, str]) -> DataFrame:
    """Elements of two arrays side by side, as far as the shorter goes."""
    n = F.least(F.size(left), F.size(right))
    rows = df.select("*", F.explode(F.arrays_zip(F.slice(left, F.lit(1), n).alias("a"), F.slice(right, F.lit(1), n).alias("b"))).alias("__p"))
    return rows.select(*df.columns, F.col("__p.a").alias(names[0]), F.col("__p.b").alias(names[1]))


def search_ranges(spark: SparkSession, low: int = -180, high: int = 181, step: int = 40, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """All settings of a search: for each axis a range of two values, the first below the second."""
    values = spark.range(low, high, step).select(F.col("id").cast("int").alias("v"))
    pairs = values.alias("a").join(values.alias("b"), F.col("a.v") < F.col("b.v")).select(F.col("a.v").alias("lo"), F.col("b.v").alias("hi"))
    out = None
    for a in axes:
        part = pairs.select(F.col("lo").alias(f"{a}_min"), F.col("hi").alias(f"{a}_max"))
        out = part if out is None else out.crossJoin(part)
    return out


def search_ranges_of(searches: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """All settings of each search, whose columns ``axes`` have the values of an axis: other columns, <axis>_min, <axis>_max.

    A setting is, for each axis, a range between two of its values, the first
    below the second; repeated values count once.  Ranges of one axis are
    worked out inside the row, before any is multiplied with the others.
    """
    rest = [c for c in searches.columns if c not in axes]
    for a in axes:
        values = F.array_sort(F.array_distinct(F.col(a)))
        pairs = F.flatten(F.transform(values, lambda lo: F.transform(F.filter(values, lambda hi: hi > lo), lambda hi: F.struct(lo.alias("a"), hi.alias("b")))))  # noqa: B023
        searches = searches.withColumn(a, pairs)
    for a in axes:
        searches = searches.withColumn(a, F.explode(a)).withColumns({f"{a}_min": F.col(f"{a}.a"), f"{a}_max": F.col(f"{a}.b")}).drop(a)
    return searches.select(*rest, *[f"{a}_{end}" for a in axes for end in ("min", "max")])


def expected_files(runs: DataFrame, process: str, dataset: str = "", specie: Column | None = None) -> DataFrame:
    """A row a run (sub, ses, task, run) and file that the process needs: the run's columns and ``path`` below the folder of ``dataset``.

    A process without a rule, such as those that work on what others made, has
    no files and is never available.
    """
    if process not in NEEDS:
        raise ValueError(f"no rule for {process}; there are rules for {', '.join(NEEDS)}")
    folder, named, suffixes = NEEDS[process]
    kind = specie if named and specie is not None else F.lit("")
    person = F.concat(F.when(kind != "", F.concat(kind, F.lit("-"))).otherwise(""), F.lit("sub-"), zero_padded(F.col("sub")))
    at = F.concat_ws("/", *([F.lit(dataset)] if dataset else []), F.lit(folder), person)
    paths = [F.concat_ws("/", at, run_path(kind, F.col("sub"), F.col("ses"), F.col("task"), F.col("run"), s)) for s in suffixes]
    return runs.withColumn("path", F.explode(F.array(*paths)))


def present(expected: DataFrame, catalog: DataFrame, on: str = "path") -> DataFrame:
    return expected.join(catalog.select(on), on, "left_semi")


def missing(expected: DataFrame, catalog: DataFrame, on: str = "path") -> DataFrame:
    return expected.join(catalog.select(on), on, "left_anti")


def available(expected: DataFrame, catalog: DataFrame, by: Sequence[str], on: str = "path") -> DataFrame:
    """A row a run: whether all files that it needs exist."""
    known = catalog.select(F.col(on).alias("__path")).distinct()
    joined = expected.join(known, F.col(on) == F.col("__path"), "left")
    return joined.groupBy(*by).agg(F.bool_and(F.col("__path").isNotNull()).alias("available"))


def catalogue(paths: DataFrame) -> DataFrame:
    """Files with the parts of their names as columns."""
    return paths.withColumn("__p", parse_run_path(F.col("path"))).select(*paths.columns, "__p.*")


def jobs(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    fields = schema(JOB)
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


def unfinished(df: DataFrame, status: str = "Status", done: str = "Finished") -> DataFrame:
    """Jobs whose status isn't the final one; a job without a status is unfinished."""
    return df.where(~F.col(status).eqNullSafe(F.lit(done)))


def schedule(df: DataFrame, shown: Mapping[str, str] = SHOWN) -> DataFrame:
    """The scheduled fields under their shown names."""
    return df.select(*[F.col(c).alias(label) for c, label in shown.items()])


def dispatch(process: str, table: Mapping[str, Callable[[], DataFrame]]) -> DataFrame | None:
    """Run the named process; None, with a message, for an unknown one."""
    if process not in table:
        print(f"no process {process}; there are {', '.join(table)}")
        return None
    return table[process]()


def numbered(names: DataFrame, name: str = "name", order: str | None = None) -> DataFrame:
    """Names with their number by place in the list, from 1."""
    return place_in_order(names, order or name, "number", 1)
