"""Design matrices: event vectors on a fine time grid, convolved with a haemodynamic response, taken at the frames.

An event is on from its onset for its duration.  On a grid of ``steps`` places
a frame it covers the places i0 to i1 - 1, and its response at place j is the
sum of h[j - i] over them, which is C[j - i0] - C[j - i1] with C[m] the sum of
h[0] to h[m].  So an event makes one row for each frame that its response reaches,
however fine the grid is, and rows of a frame are summed with partial
aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Seconds that a response lasts.
SPAN = 32.0


def gamma_response(tr: float, steps: int = 20, sigma: float = 3.0, delay: float = 6.0) -> list[float]:
    """A gamma density with mean ``delay`` and standard deviation ``sigma``, in seconds, at the places of the grid; sums to 1."""
    return _sampled(tr, steps, [(1.0, delay, sigma)])


def double_gamma(tr: float, steps: int = 20, delay: float = 6.0, sigma: float = math.sqrt(6.0), dip_delay: float = 16.0, dip_sigma: float = 4.0, ratio: float = 6.0) -> list[float]:
    """A gamma density less a later one divided by ``ratio``; sums to 1."""
    return _sampled(tr, steps, [(1.0, delay, sigma), (-1.0 / ratio, dip_delay, dip_sigma)])


def _sampled(tr: float, steps: int, parts: list[tuple[float, float, float]]) -> list[float]:
    dt = tr / steps
    out = []
    for k in range(int(SPAN / dt)):
        at, total = k * dt, 0.0
        for weight, delay, sigma in parts:
            shape, scale = (delay / sigma) ** 2, sigma**2 / delay
            if at > 0:
                total += weight * math.exp((shape - 1) * math.log(at) - at / scale - math.lgamma(shape) - shape * math.log(scale))
        out.append(total)
    whole = sum(out)
    return [x / whole for x in out]


def running_sum(response: Sequence[float]) -> list[float]:
    """C[0] = 0 and C[k + 1] = C[k] + h[k]."""
    out = [0.0]
    for h in response:
        out.append(out[-1] + h)
    return out


def event_responses(events: DataFrame, runs: DataFrame, tr: float, response: Sequence[float], by: Sequence[str] = ("run",), steps: int = 20, regressor: str = "regressor") -> DataFrame:
    """(by, t, regressor, value, slope): what each event adds to each frame that its response reaches.

    ``events`` has onset and duration in seconds and the weight ``one``;
    ``runs`` has the number of ``frames`` of each run.  Events are at least one
    place of the grid long; those before the run count from where they began.
    ``slope`` is the central difference on the grid, a second.  Events with a
    null onset, duration or weight add nothing.
    """
    sums = F.array(*[F.lit(x) for x in running_sum(response)])
    span, dt = len(response), tr / steps
    i0 = F.floor(F.col("onset") / F.lit(dt) + 0.5).cast("long")
    i1 = F.greatest(i0 + 1, F.floor((F.col("onset") + F.col("duration")) / F.lit(dt) + 0.5).cast("long"))
    rows = events.where("onset is not null and duration is not null and one is not null").select(*by, F.col(regressor).alias("regressor"), "one", i0.alias("__i0"), i1.alias("__i1")).join(runs.select(*by, "frames"), list(by))
    first, last = F.greatest(F.ceil((F.col("__i0") - 1) / steps), F.lit(0)), F.least(F.floor((F.col("__i1") + span) / steps), F.col("frames") - 1)
    rows = rows.where(first <= last).withColumn("t", F.explode(F.sequence(first.cast("long"), last.cast("long"))))

    def reached(shift: int) -> Column:
        c = lambda i: F.element_at(sums, (F.least(F.greatest(F.col("t") * steps + shift - F.col(i) + 1, F.lit(0)), F.lit(span)) + 1).cast("int"))
        return c("__i0") - c("__i1")

    return rows.select(*by, "t", "regressor", (F.col("one") * reached(0)).alias("value"), (F.col("one") * (reached(1) - reached(-1)) / F.lit(2 * dt)).alias("slope"))


def design_matrix(events: DataFrame, runs: DataFrame, tr: float, names: Sequence[str], response: Sequence[float], by: Sequence[str] = ("run",), steps: int = 20, regressor: str = "regressor", derivatives: bool = False) -> DataFrame:
    """A row for each frame of each run, with a column for each name (and ``<name>_d``, its derivative, if asked).

    Runs without events have zeros; events of other names are left out; an
    empty table of runs gives an empty one.
    """
    if not names:
        raise ValueError("a design has one name at least")
    none = runs.where("frames > 0").select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames").cast("long") - 1)).alias("t"), F.lit(None).cast("string").alias("regressor"), F.lit(0.0).alias("value"), F.lit(0.0).alias("slope"))
    told = event_responses(events.where(F.col(regressor).isin(*names)), runs.where("frames > 0"), tr, response, by, steps, regressor)
    of = lambda name, part: F.sum(F.when(F.col("regressor") == name, F.col(part)).otherwise(0.0))
    columns = [c for n in names for c in ([of(n, "value").alias(n), of(n, "slope").alias(f"{n}_d")] if derivatives else [of(n, "value").alias(n)])]
    return none.unionByName(told).groupBy(*by, "t").agg(*columns)


def with_confounds(design: DataFrame, confounds: DataFrame, columns: Sequence[str], by: Sequence[str] = ("run",), t: str = "t") -> DataFrame:
    """The design plus columns of another table of frames, such as motion; frames that it lacks are left out."""
    return design.join(confounds.select(*by, t, *columns), [*by, t])
