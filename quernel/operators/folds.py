"""Aggregations of one's own: a state with empty, update, merge and finalize, folded in tasks and merged in a tree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.shared import settle


@dataclass(frozen=True)
class Reducer:
    """``update(state, batch)`` takes an Arrow batch; states go between tasks as bytes."""

    empty: Callable
    update: Callable
    merge: Callable
    to_bytes: Callable
    from_bytes: Callable
    finalize: Callable = staticmethod(lambda state: state)


def fold(df: DataFrame, reducer: Reducer, fan: int = 64):
    """The finalized state of all rows; each task folds its rows, and states are merged ``fan`` at a time until that many are left."""

    def first(batches):
        state, some = reducer.empty(), False
        for b in batches:
            if b.num_rows:
                state, some = reducer.update(state, b), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([reducer.to_bytes(state)], pa.binary())], ["state"])

    def again(batches):
        state, some = None, False
        for b in batches:
            for v in b.column(0).to_pylist():
                own = reducer.from_bytes(v)
                state, some = (own if not some else reducer.merge(state, own)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([reducer.to_bytes(state)], pa.binary())], ["state"])

    states = settle(df.mapInArrow(first, "state binary"), "states")
    while (n := states.count()) > fan:
        states = settle(states.repartition(-(-n // fan)).mapInArrow(again, "state binary"), "states")
    out = reducer.empty()
    for r in states.collect():  # at most ``fan`` states
        out = reducer.merge(out, reducer.from_bytes(bytes(r["state"])))
    return reducer.finalize(out)
