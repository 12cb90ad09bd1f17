"""Jobs as a state machine over a stream of events: each job's state is kept between batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .jobs import TERMINAL

OUT = "job long, state string, n_events long, started double, finished double"
KEPT = "state string, n_events long, started double, finished double, cancel boolean"

#: From a state, the events that change it.
MOVES = {
    None: {"pending": "pending"},
    "pending": {"running": "running", "cancel": "cancelled"},
    "running": {"done": "done", "failed": "failed", "cancelled": "cancelled"},
}


def advance(kept: tuple, kind: str, ts: float) -> tuple:
    """The state after an event. What a state doesn't take leaves it as it is; a running job only notes that it shall end."""
    state, n, started, finished, cancel = kept
    new = MOVES.get(state, {}).get(kind)
    cancel = bool(cancel) or (state == "running" and kind == "cancel")
    if new == "failed" and cancel:
        new = "cancelled"
    if new == "running":
        started = ts
    if new in TERMINAL:
        finished = ts
    return new or state, n + 1, started, finished, cancel


def _follow(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    kept = state.get if state.exists else (None, 0, None, None, False)
    events = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
    for kind, ts in zip(events["kind"], events["ts"]):
        kept = advance(kept, kind, ts)
    state.update(kept)
    yield pd.DataFrame({"job": [key[0]], "state": [kept[0]], "n_events": [kept[1]], "started": pd.Series([kept[2]], dtype=float), "finished": pd.Series([kept[3]], dtype=float)})


def follow(events: DataFrame) -> DataFrame:
    """A row for each job that a batch has events of (job, kind, ts, seq): its state then. State is as many rows as there are jobs."""
    return events.groupBy("job").applyInPandasWithState(_follow, OUT, KEPT, "update", "NoTimeout")


def follow_to_table(events: DataFrame, path: str, checkpoint: str) -> None:
    """Append each batch's changes as Parquet; what is there is read, then the stream stops and can be taken up again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch writes over itself

    follow(events).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
