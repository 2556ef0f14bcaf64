"""Atlas lookups: labels, regions and lobes are small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Lobe by the key in ROI file names, in the spelling of the region table without its slip.
LOBES = {"CN": "Cingulate", "FR": "Frontal", "OC": "Occipital", "PR": "Parietal", "PS": "Temporal", "SM": "Sensory-motor", "SUB": "Subcortical"}


def clean_names(df: DataFrame, *columns: str) -> DataFrame:
    """Names without a byte order mark, outer spaces or repeated inner ones."""
    return df.withColumns({c: F.trim(F.regexp_replace(F.regexp_replace(c, "﻿", ""), r"\s+", " ")) for c in columns})


def roi_parts(keys: DataFrame, file: str = "file") -> DataFrame:
    """``lobe``, ``abbrev`` and ``side`` of files named <LOBE>_<ABBREV>_<L or R>.nii.gz."""
    pattern = r"^([^_]+)_(.+)_([LR])\.nii(?:\.gz)?$"
    return keys.withColumns({name: F.regexp_extract(file, pattern, k) for k, name in enumerate(("lobe", "abbrev", "side"), 1)})


def lobe_of(rois: DataFrame, key: str = "lobe") -> DataFrame:
    """ROIs with ``lobe_name``; null for an unknown key."""
    names = F.create_map(*[F.lit(x) for pair in LOBES.items() for x in pair])
    return rois.withColumn("lobe_name", F.try_element_at(names, F.col(key)))


def region_of(labels: DataFrame, regions: DataFrame, key: str, size_limit: int = 1_000_000) -> DataFrame:
    """Labels with their region's columns; the regions are broadcast only if there are fewer than ``size_limit``."""
    small = regions.limit(size_limit).count() < size_limit
    return labels.join(F.broadcast(regions) if small else regions, key, "left")
