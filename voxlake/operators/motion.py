"""Head-motion series: differences, detrending, framewise displacement, masks.

A series has a row a frame, an integer frame index and one column a channel;
``by`` names the columns of a run.  Everything here that looks along a run
shares one exchange by run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import fixed_decimal
from ..model import CHANNELS

RADIUS = 50.0


def scales(radius: float = RADIUS, rotations_first: bool = True) -> tuple[float, ...]:
    """Millimetres per unit of the six channels: arcs on a sphere of ``radius`` for rotations, 1 for translations."""
    return (radius,) * 3 + (1.0,) * 3 if rotations_first else (1.0,) * 3 + (radius,) * 3


def first_difference(c: str, t: str, by: Sequence[str]) -> Column:
    """Change from the frame before; 0 at the first."""
    return F.coalesce(F.col(c) - F.lag(c).over(W.partitionBy(*by).orderBy(t)), F.lit(0.0))


def slope(c: str, t: str, by: Sequence[str]) -> Column:
    """Least-squares slope of a channel over its run; 0 for a single frame."""
    return F.coalesce(F.regr_slope(F.col(c), F.col(t)).over(W.partitionBy(*by)), F.lit(0.0))


def framewise_displacement(df: DataFrame, by: Sequence[str], t: str = "t", channels: Sequence[str] = CHANNELS, scale: Sequence[float] | None = None, detrend: bool = True, name: str = "fd") -> DataFrame:
    """``df`` plus the sum over channels of the absolute, scaled change between frames.

    The change of a linearly detrended channel is its change less its slope:
    intercept and mean cancel, so no residuals are built.  The first frame has
    0, also in a run of one frame.  Null channels make the sum null.
    """
    scale = scale if scale is not None else scales()
    if len(scale) != len(channels):
        raise ValueError(f"{len(channels)} channels need as many scales, not {len(scale)}")
    order = W.partitionBy(*by).orderBy(t)
    total = None
    for c, s in zip(channels, scale, strict=True):
        change = F.col(c) - F.lag(c).over(order)
        part = F.abs(change - slope(c, t, by) if detrend else change) * F.lit(float(s))
        total = part if total is None else total + part
    return df.withColumn(name, F.when(F.row_number().over(order) == 1, F.lit(0.0)).otherwise(total))


def long_run_displacement(df: DataFrame, by: Sequence[str], t: str = "t", channels: Sequence[str] = CHANNELS, scale: Sequence[float] | None = None, detrend: bool = True, name: str = "fd", block: int = 65_536) -> DataFrame:
    """framewise_displacement for runs too long for one task; ``t`` counts a run's frames from 0 without gaps.

    Frames are dealt by run and block of ``block`` frames, the last frame of a
    block going to the next one too.  Slopes are partial aggregates, joined
    back by run.
    """
    scale = scale if scale is not None else scales()
    here = F.expr(f"`{t}` div {block}")
    carried = F.when((F.col(t) + 1) % block == 0, F.array(F.struct(here.alias("b"), F.lit(True).alias("own")), F.struct((here + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(here.alias("b"), F.lit(True).alias("own"))))
    rows = df.select("*", F.explode(carried).alias("__at")).select(*df.columns, F.col("__at.b").alias("__block"), F.col("__at.own").alias("__own"))
    order = W.partitionBy(*by, "__block").orderBy(t)
    changes = rows.withColumns({f"__d_{c}": F.col(c) - F.lag(c).over(order) for c in channels}).where("__own")
    if detrend:
        slopes = df.groupBy(*by).agg(*[F.coalesce(F.regr_slope(F.col(c), F.col(t)), F.lit(0.0)).alias(f"__s_{c}") for c in channels])
        changes = changes.join(slopes, list(by))
    total = None
    for c, s in zip(channels, scale, strict=True):
        part = F.abs(F.col(f"__d_{c}") - F.col(f"__s_{c}") if detrend else F.col(f"__d_{c}")) * F.lit(float(s))
        total = part if total is None else total + part
    return changes.select(*df.columns, F.when(F.col(t) == 0, F.lit(0.0)).otherwise(total).alias(name))


def detrend_linear(df: DataFrame, by: Sequence[str], t: str = "t", channels: Sequence[str] = CHANNELS, keep_mean: bool = False) -> DataFrame:
    """Channels replaced by their residuals from a straight line over the run, with the mean added back if asked."""
    run = W.partitionBy(*by)
    out = {}
    for c in channels:
        centred = F.col(c) - F.avg(c).over(run) - slope(c, t, by) * (F.col(t) - F.avg(t).over(run))
        out[c] = centred + F.avg(c).over(run) if keep_mean else centred
    return df.withColumns(out)


def detrend_polynomial(df: DataFrame, by: Sequence[str], t: str = "t", channels: Sequence[str] = CHANNELS, degree: int = 2, keep_mean: bool = False) -> DataFrame:
    """Channels replaced by their residuals from a polynomial over the run, with the mean added back if asked; NaN and null are left out of the fit and come back as NaN.

    Up to degree 2 the fit is a sum of polynomials that are orthogonal over the
    run's known frames, whose weights are moments: all of it shares one
    exchange by run.  Higher degrees need a run's frames together in one task.
    """
    if degree > 2:
        return _detrend_high(df, by, t, channels, degree, keep_mean)
    run, out, mean, line, square = W.partitionBy(*by), df, {}, {}, {}
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in channels}
    for c, y in known.items():
        mean[f"__m_{c}"] = F.avg(y).over(run)
        # places are centred over the known frames, which keeps the squares exact enough
        line[f"__x_{c}"] = F.col(t) - F.avg(F.when(y.isNotNull(), F.col(t))).over(run)
    out = out.withColumns(mean | line)
    if degree > 1:
        for c, y in known.items():
            x = F.col(f"__x_{c}")
            here = F.when(y.isNotNull(), x)
            square[f"__q_{c}"] = x * x - F.avg(here * here).over(run) - F.coalesce(F.regr_slope(x * x, here).over(run), F.lit(0.0)) * x
        out = out.withColumns(square)
    rest = {}
    for c, y in known.items():
        trend = F.col(f"__m_{c}")
        for part, least in ((f"__x_{c}", 2), (f"__q_{c}", 3))[:degree]:
            basis = F.when(y.isNotNull(), F.col(part))
            # a run of fewer known frames has a polynomial of lower degree
            weight = F.sum(y * basis).over(run) / F.nullif(F.sum(basis * basis).over(run), F.lit(0.0))
            trend = trend + F.when(F.count(y).over(run) >= least, F.coalesce(weight, F.lit(0.0)) * F.col(part)).otherwise(0.0)
        kept = F.col(f"__m_{c}") if keep_mean else F.lit(0.0)
        rest[c] = F.coalesce(y - trend + kept, F.lit(float("nan")))
    return out.select(*[rest[c].alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])


def _detrend_high(df: DataFrame, by: Sequence[str], t: str, channels: Sequence[str], degree: int, keep_mean: bool) -> DataFrame:
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(t)
        place = np.linspace(-1.0, 1.0, len(frame)) if len(frame) > 1 else np.zeros(1)
        for c in channels:
            y = frame[c].to_numpy(float)
            known = ~np.isnan(y)
            if known.any():
                basis = np.vander(place, min(degree, int(known.sum()) - 1) + 1)
                weights = np.linalg.lstsq(basis[known], y[known], rcond=None)[0]
                frame[c] = y - basis @ weights + (y[known].mean() if keep_mean else 0.0)
        return frame

    return df.groupBy(*by).applyInPandas(fit, df.schema)


def smooth_weights(window: int, degree: int) -> np.ndarray:
    """Least-squares smoothing: row i has the weights that give the polynomial's value at place i of the window."""
    place = np.arange(window) - window // 2
    basis = np.vander(place / max(1, window // 2), degree + 1)
    return basis @ np.linalg.pinv(basis)


def smooth_window(frames: int, tr: float, seconds: float = 240.0) -> int:
    """Frames of the smoothing window: those of ``seconds``, or the whole run where it is shorter, made odd downwards."""
    window = int(np.floor(seconds / tr + 0.5)) if frames * tr >= seconds else frames
    return window - 1 + window % 2


def detrend_smooth(df: DataFrame, by: Sequence[str], tr: float, t: str = "t", channels: Sequence[str] = CHANNELS, degree: int = 3, seconds: float = 240.0) -> DataFrame:
    """Channels less what regressing them on their own moving polynomial trend (and a constant) explains, plus their mean.

    A channel whose trend doesn't vary isn't regressed, yet its mean is added
    to it as to the others.  A run whose window has ``degree`` frames or fewer
    can't be smoothed and stays as it is.  Needs a run's frames together.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(t)
        n = len(frame)
        window = smooth_window(n, tr, seconds)
        if window <= degree:
            return frame
        weights, half = smooth_weights(window, degree), window // 2
        for c in channels:
            y = frame[c].to_numpy(float)
            trend = np.convolve(y, weights[half][::-1], "valid")
            trend = np.r_[weights[:half] @ y[:window], trend, weights[half + 1 :] @ y[-window:]]
            flat = np.ptp(trend) <= 1e-12 * max(1.0, float(np.abs(trend).max()))  # what rounding leaves of a constant
            basis = np.c_[trend, np.ones(n)]
            frame[c] = (y if flat else y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]) + y.mean()
        return frame

    return df.groupBy(*by).applyInPandas(fit, df.schema)


def channel_rms(df: DataFrame, by: Sequence[str], t: str = "t", channels: Sequence[str] = CHANNELS, scale: Sequence[float] | None = None) -> DataFrame:
    """Root mean square of each detrended, scaled channel: a row a run, columns ``rms_<channel>``.

    By moments: the residuals' mean square is var(y) - slope * cov(t, y), which
    aggregates partially and needs no window.
    """
    scale = scale if scale is not None else scales()
    rms = []
    for c, s in zip(channels, scale, strict=True):
        rest = F.var_pop(c) - F.coalesce(F.regr_slope(F.col(c), F.col(t)), F.lit(0.0)) * F.covar_pop(t, c)
        rms.append((F.sqrt(F.greatest(rest, F.lit(0.0))) * F.lit(float(s))).alias(f"rms_{c}"))
    return df.groupBy(*by).agg(*rms)


def keep_mask(value: str, threshold: float) -> Column:
    """1 where the frame is kept (at most the threshold), else 0."""
    return (F.col(value) <= F.lit(float(threshold))).cast("tinyint")


def lost_mask(value: str, threshold: float) -> Column:
    """Whether the frame is lost (above the threshold)."""
    return F.col(value) > F.lit(float(threshold))


def spike_regressors(df: DataFrame, by: Sequence[str], t: str = "t", lost: str = "lost", name: str = "spikes") -> DataFrame:
    """``df`` plus an array with a place for each lost frame of the run, 1 at the frame's own place; [0] where none is lost.

    A run of T frames of which K are lost gets T x K numbers, as a model that
    takes each spike as a regressor of its own needs them.
    """
    order, run = W.partitionBy(*by).orderBy(t), W.partitionBy(*by)
    flag = F.coalesce(F.col(lost).cast("int"), F.lit(0))
    nth = F.sum(flag).over(order.rowsBetween(W.unboundedPreceding, 0))
    count = F.sum(flag).over(run)
    rows = df.select("*", F.when(flag == 1, nth).otherwise(0).alias("__nth"), count.alias("__count"))
    one_hot = F.transform(F.sequence(F.lit(1), F.greatest(F.col("__count"), F.lit(1)).cast("int")), lambda k: (k == F.col("__nth")).cast("int"))
    return rows.select(*df.columns, one_hot.alias(name))


def motion_lines(df: DataFrame, channels: Sequence[str] = CHANNELS, mask: str = "mask") -> Column:
    """A frame's line of the mask file: channels with six decimals and the mask, tab-separated."""
    return F.concat_ws("\t", *[fixed_decimal(F.col(c), 6) for c in (*channels, mask)])
