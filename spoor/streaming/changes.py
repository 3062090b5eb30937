"""Consecutive-duplicate removal on a stream: one last value a trajectory is all the state there is."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_changes(log: DataFrame, values: Sequence[str], order: Sequence[str], by: str = "traj_id") -> DataFrame:
    """Rows whose values differ from the row before in their trajectory; rows of a micro-batch are put in order first."""
    schema, values, order = log.schema, list(values), list(order)
    kept = ", ".join(f"{c} double" for c in values)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        last = state.get if state.exists else None
        now = list(rows[values].astype(float).itertuples(index=False, name=None))
        fresh = [a is None or tuple(a) != tuple(b) for a, b in zip([last, *now[:-1]], now, strict=True)]
        if now:
            state.update(now[-1])
        yield rows[fresh]

    return log.groupBy(by).applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.NoTimeout)
