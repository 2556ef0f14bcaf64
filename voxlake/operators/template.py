"""Filling line templates: each line is replaced as a whole by the first rule it contains."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What identifies the lines of a preprocessing and of a model template, in the order in which rules are tried.
PREPROCESS = {
    "Outputdir": "set fmri(outputdir)", "TR": "set fmri(tr)", "Volumes": "set fmri(npts)", "BET": "set fmri(bet_yn)",
    "Smooth": "set fmri(smooth)", "Input": "set feat_files(1)", "SliceTimming": "set fmri(st_file)",
}
MODEL = {
    "outputdir": "set fmri(outputdir)", "TR": "set fmri(tr)", "volumes": "set fmri(npts)", "BET": "set fmri(bet_yn)", "smooth": "set fmri(smooth)",
    "input": "set feat_files(1)", "atlas": "set fmri(regstandard)", "movement": "set confoundev_files(1)", "condition": "set fmri(custom1)",
}


#: The same for a model whose repetition time and volumes are kept.  The first key, with two brackets, is in no line.
MODEL_SHORT = {
    "atlas": "set fmri(regstandard))", "Smooth": "set fmri(smooth)", "Input": "set feat_files(1)", "movement": "set confoundev_files(1)", "cond": "set fmri(custom1) ",
}
#: What variants of the preprocessing template set: slice timing from a file, regular from below, or none, and motion correction.
VARIANT = {"slice_timing": "set fmri(st)", "motion_correction": "set fmri(mc)"}
SLICE_TIMING = {"file": 4, "regular": 1, "none": 0}


def rules(spark: SparkSession, find: Mapping[str, str], values: Mapping[str, object]) -> DataFrame:
    """(priority, label, find, replacement) in the order of ``find``; the replacement is the whole new line: the key without what stands after its first bracket, and the value, with quotes round a text."""
    shown = lambda v: f'"{v}"' if isinstance(v, str) else str(v)
    line = lambda key, v: f"{key[: key.index(')') + 1] if ')' in key else key} {shown(v)}"
    rows = [(k, label, key, line(key, values[label])) for k, (label, key) in enumerate(find.items()) if label in values]
    return spark.createDataFrame(rows, "priority int, label string, find string, replacement string")


#: Rules that a template may have.
MOST_RULES = 10_000


def _first(line: Column, found: Column) -> Column:
    """The replacement of the first rule in an array of (find, replacement) that the line contains, or the line."""
    hits = F.filter(found, lambda rule: F.contains(line, rule["find"]))
    return F.coalesce(F.get(hits, F.lit(0))["replacement"], line)


def fill(lines: DataFrame, rules: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines (line_no, line) with those that contain a rule's key replaced; of several rules the first counts.

    With ``by`` both frames have these columns and rules apply to their own
    template: its rules are one array, joined by template.  Without, the rules
    (MOST_RULES at most, an error beyond) are a literal, and filling is a
    projection.  Repeated lines stay; a null line contains nothing.
    """
    rule = F.struct("find", "replacement")
    if not by:
        rows = rules.select("priority", "find", "replacement").limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES:
            raise ValueError(f"a template has {MOST_RULES} rules at most")
        known = [F.struct(F.lit(r.find).alias("find"), F.lit(r.replacement).alias("replacement")) for r in sorted(rows)]
        return lines.select("line_no", (_first(F.col("line"), F.array(*known)) if known else F.col("line")).alias("line"))
    each = rules.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", rule.alias("rule")))), lambda x: x["rule"]).alias("__rules"))
    return lines.join(each, list(by), "left").select(*by, "line_no", F.coalesce(_first(F.col("line"), F.col("__rules")), F.col("line")).alias("line"))
