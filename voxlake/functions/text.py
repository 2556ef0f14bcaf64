"""Text expressions: padded numbers, run names, key=value lines, short decimals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IMAGE_SUFFIX = r"\.nii(\.gz)?$"


def zero_padded(n: Column, width: int = 2) -> Column:
    """A whole number with leading zeros; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", n.cast("int"))


def fixed_decimal(v: Column, digits: int) -> Column:
    """A number with so many decimals, rounded as C's %f does: by its exact value, half to even."""
    return F.call_function("format_number", v.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def short_decimal(v: Column) -> Column:
    """A number with six significant digits and no trailing zeros, as C's %g writes it.

    Numbers below 1e-4 or from 1e6 on get an exponent of two digits at least.
    """
    text = F.call_function("format_number", v.cast("double"), F.lit("0.00000E0"))
    mantissa, exponent = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).cast("int")
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.lit(None).cast("string")
    for e in range(-4, 6):
        plain = F.when(exponent == e, fixed_decimal(v, 5 - e)).otherwise(plain)
    power = F.concat(tidy(mantissa), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(exponent)))
    return F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).when(v == 0, "0").otherwise(F.coalesce(tidy(plain), power))


def single_spaced(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def run_path(specie: Column, sub: Column, session: Column, task: Column, run: Column, suffix: str, width: int = 2) -> Column:
    """File name of a run: [specie]-sub-NN[_ses-SS]_task-T_run-RR<suffix>; no session part for an empty or null session."""
    ses = F.when(F.coalesce(session, F.lit("")) != "", F.concat(F.lit("_ses-"), session)).otherwise("")
    head = F.when(F.coalesce(specie, F.lit("")) != "", F.concat(specie, F.lit("-"))).otherwise("")
    return F.concat(head, F.lit("sub-"), zero_padded(sub, width), ses, F.lit("_task-"), task, F.lit("_run-"), zero_padded(run, width), F.lit(suffix))


def parse_run_path(path: Column) -> Column:
    """struct<specie, sub, session, task, run, suffix> of a run's file name; null parts where it has none."""
    name = F.substring_index(path, "/", -1)
    pattern = r"^(?:([A-Za-z]+)-)?sub-([0-9]+)(?:_ses-([^_]+))?_task-([^_]+)_run-([0-9]+)(.*)$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.struct(part(1).alias("specie"), part(2).cast("int").alias("sub"), part(3).alias("session"), part(4).alias("task"), part(5).cast("int").alias("run"), part(6).alias("suffix"))


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, IMAGE_SUFFIX, "")


def run_label(run: Column, session: Column) -> Column:
    """How a run is shown: ``Run 3 (Session 02)``."""
    return F.concat(F.lit("Run "), run.cast("string"), F.when(F.coalesce(session, F.lit("")) != "", F.concat(F.lit(" (Session "), session, F.lit(")"))).otherwise(""))


def parse_run_label(label: Column) -> Column:
    """struct<run, session> of a label."""
    return F.struct(F.regexp_extract(label, r"Run ([0-9]+)", 1).cast("int").alias("run"), F.regexp_extract(label, r"\(Session ([^)]+)\)", 1).alias("session"))


def parse_session_run(value: Column) -> Column:
    """struct<session, run> of ``ses-01_run-1``."""
    return F.struct(F.regexp_extract(value, r"ses-([^_]+)", 1).alias("session"), F.regexp_extract(value, r"run-([0-9]+)", 1).cast("int").alias("run"))


def params(text: Column) -> Column:
    """map<string, string> of key=value lines; empty lines are skipped, and a line with no or a second = is an error."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: F.trim(line) != "")
    pairs = F.transform(
        lines,
        lambda line: F.when(F.size(F.split(line, "=")) == 2, F.struct(F.trim(F.split(line, "=")[0]).alias("k"), F.trim(F.split(line, "=")[1]).alias("v"))).otherwise(
            F.raise_error(F.concat(F.lit("not key=value: "), line)).cast("struct<k:string,v:string>")
        ),
    )
    # of a key that is given twice the last value counts
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def params_text(values: Column) -> Column:
    """Lines key=value of a map, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n")


def species_name(code: Column, other: str | None = None) -> Column:
    """Dog for D and Hum for H; for anything else ``other``, or an error without it."""
    rest = F.lit(other) if other is not None else F.raise_error(F.concat(F.lit("unknown species "), code)).cast("string")
    return F.when(code == "D", "Dog").when(code == "H", "Hum").otherwise(rest)


def brain_extraction_flag(code: Column) -> Column:
    return F.when(code == "H", 1).when(code == "D", 0)
