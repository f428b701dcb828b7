"""The keyed state machines over streams, with the same transitions as in batch.

A micro-batch may bring a key's events in any order: they wait in the state until
the watermark passes them, then go through the machine in order of time and id.
So late data up to the watermark's delay change nothing, and what comes out is
what the batch form gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import MACHINES


def run_stream(events: DataFrame, machine: str, key: str, ts: str = "ts", event_id: str = "event_id", delay: str = "10 minutes", **settings) -> DataFrame:
    """``events``: key, ts (timestamp), event_id and the machine's fields; ``at`` is taken from ts."""
    m = MACHINES[machine]
    every = m.settings | settings
    names = [x.split()[0] for x in m.output.split(", ")]
    kind = dict(events.dtypes)[key]
    ddl = f"{key} {kind}, {event_id} long, {m.output}"

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = json.loads(state.get[0]) if state.exists else [dict(m.start), []]
        for batch in batches:
            waiting += [{k: v.item() if hasattr(v, "item") else v for k, v in e.items() if k not in (key, ts)} for e in batch.to_dict("records")]
        waiting.sort(key=lambda e: (e["at"], e[event_id]))
        mark = state.getCurrentWatermarkMs()
        rows = []
        while waiting and waiting[0]["at"] <= mark:
            e = waiting.pop(0)
            held, out = m.step(held, e, every)
            rows.append([keys[0], e[event_id], *(out[n] for n in names)])
        state.update((json.dumps([held, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0]["at"], mark) + 1)
        yield pd.DataFrame(rows, columns=[key, event_id, *names])

    timed = events.withColumn("at", F.unix_millis(F.col(ts).cast("timestamp"))).withColumn(ts, F.col(ts).cast("timestamp"))
    grouped = timed.withWatermark(ts, delay).groupBy(key)
    return grouped.applyInPandasWithState(run, ddl, "held string", "append", GroupStateTimeout.EventTimeTimeout)
