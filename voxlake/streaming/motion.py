"""Displacement of frames as they arrive.

Without detrending, a frame's displacement needs only the frame before it: per
run that is the state.  Detrended displacement needs the whole run's slope and
is a batch operator.

A frame is held back until its predecessors have come: frames may arrive in any
order within a run, and each is put out once.  A frame that arrives again after
it was put out is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import CHANNELS
from ..operators.motion import scales
from ..session import prepare

#: Next frame expected, the last frame's channels, and frames that came early.
STATE = "next long, last array<double>, early_t array<long>, early array<array<double>>"


def streaming_displacement(frames: DataFrame, by: Sequence[str] = ("run",), t: str = "t", channels: Sequence[str] = CHANNELS, scale: Sequence[float] | None = None) -> DataFrame:
    """(by..., t, fd) for a stream of frames numbered from 0 in each run.

    State per run: one frame's channels and the frames that wait for an earlier
    one.  Frames without a number are dropped; a null channel gives a null sum.
    """
    weights = np.asarray(scale if scale is not None else scales(), float)
    if len(weights) != len(channels):
        raise ValueError(f"{len(channels)} channels need as many scales")
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["t long", "fd double"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, last, early_t, early = state.get if state.exists else (0, [], [], [])
        waiting = {int(k): list(v) for k, v in zip(early_t, early)}
        for batch in batches:
            for row in batch.itertuples(index=False):
                place = getattr(row, t)
                if place is not None and place == place and int(place) >= expected:
                    waiting.setdefault(int(place), [float(getattr(row, c)) if getattr(row, c) is not None else float("nan") for c in channels])
        out = []
        while expected in waiting:
            now = np.array(waiting.pop(expected), float)
            fd = float((np.abs(now - np.array(last, float)) * weights).sum()) if expected else 0.0
            out.append((*key, expected, None if fd != fd else fd))
            expected, last = expected + 1, now.tolist()
        state.update((expected, list(last), list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=[*by, "t", "fd"])

    prepare(frames.sparkSession)
    return frames.groupBy(*by).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)
