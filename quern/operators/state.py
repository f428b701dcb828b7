"""Keyed state machines: pure transitions, and their batch form.

A machine is a function of a state (a dict) and an event (a dict with ``at``,
milliseconds) that returns the next state and the output row.  The batch form
goes through a key's events in order; ``streaming.machines`` runs the same
functions over streams.  Nothing here depends on a clock or on chance: times come
from the events, and jitter is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[dict, dict, dict], tuple[dict, dict]]


@dataclass(frozen=True)
class Machine:
    step: Step
    start: dict
    output: str
    settings: dict = field(default_factory=dict)

    def run(self, events: list[dict], **settings) -> list[dict]:
        state, out, s = dict(self.start), [], self.settings | settings
        for e in events:
            state, row = self.step(state, e, s)
            out.append(row)
        return out


def breaker_step(state: dict, e: dict, s: dict) -> tuple[dict, dict]:
    """Closed, open, half-open.  Failures count in a window; an open breaker lets a try through after its timeout."""
    state = dict(state, failures=list(state["failures"]))
    allowed = True
    if state["state"] == "OPEN":
        if e["at"] - state["opened"] >= s["timeout"]:
            state["state"] = "HALF_OPEN"
        else:
            allowed = False
    if allowed:
        if not e["ok"]:
            state["failures"].append(e["at"])
        state["failures"] = [x for x in state["failures"] if x > e["at"] - s["window"]]
        if e["ok"]:
            state["run"] += 1
            if state["state"] == "HALF_OPEN" and state["run"] >= s["successes"]:
                state.update(state="CLOSED", failures=[], run=0)
        else:
            state["run"] = 0
            if len(state["failures"]) >= s["failures"]:
                state.update(state="OPEN", opened=e["at"])
    return state, {"state": state["state"], "allowed": allowed, "failures": len(state["failures"])}


def limiter_step(state: dict, e: dict, s: dict) -> tuple[dict, dict]:
    """Token bucket with an adaptive multiplier: halved on a throttle, raised on success, lowered on repeated errors; backoff doubles."""
    state = dict(state)
    since = e["at"] - state["last"] if state["last"] is not None else 10**9
    rate = s["rate"] * state["multiplier"]
    interval = 1000 / rate * max(0.1, 1.0 - (e.get("priority", 5) - 5) * 0.1)
    wait = 0.0 if state["burst"] > 0 and since > interval else max(0.0, interval - since)
    wait = max(wait, (state["backoff"] or 0) - e["at"])
    state["burst"] = min(s["burst"], state["burst"] + int(min(since, 10**9) / 1000 * s["rate"]))
    state["burst"] -= state["burst"] > 0
    state["last"] = e["at"]
    m = state["multiplier"]
    if e["status"] in (429, 503):
        state["errors"] += 1
        m *= 0.5
        if e["status"] == 429 or state["errors"] >= 3:
            state["backoff"] = e["at"] + min(300_000, 1000 * 2 ** (state["errors"] - 1))
    elif e["status"] < 400:
        state.update(errors=0, backoff=None)
        if m < 1.0:
            m = min(1.0, m * 1.1)
        if e.get("took") is not None:
            m = min(1.2, m * 1.05) if e["took"] < 1000 else max(0.5, m * 0.95) if e["took"] > 5000 else m
    else:
        state["errors"] += 1
        if state["errors"] >= 2:
            m = max(0.1, m * 0.8)
    state["multiplier"] = m
    return state, {"wait": round(wait, 3), "multiplier": round(m, 6), "burst": state["burst"], "errors": state["errors"]}


def pacing_step(state: dict, e: dict, s: dict) -> tuple[dict, dict]:
    """Least interval between requests of a key; a limit error holds the key until its retry-after or a fixed time."""
    ready = max(state["next"] or 0, state["held"] or 0)
    wait = max(0, ready - e["at"])
    at = e["at"] + wait
    held = at + (e.get("retry_after") or s["hold"]) if e["status"] == 429 else None
    return {"next": at + s["interval"], "held": held}, {"wait": wait, "starts": at}


def backoff(attempt: int, base: float = 1000, factor: float = 2, most: float = 60_000) -> float:
    return max(100.0, min(base * factor**attempt, most))


def tracker_step(state: dict, e: dict, s: dict) -> tuple[dict, dict]:
    """Cumulative counts of a key; blocks on many 429 or 403, or a low success rate; a success can lift the block."""
    state = dict(state, attempts=state["attempts"] + 1)
    if e["status"] < 400:
        state["good"] += 1
        rate = state["good"] / state["attempts"]
        if state["blocked"] and (state["limited"] or state["refused"]) and rate > s["rate"] * 2:
            state["blocked"] = False
    else:
        state["limited"] += e["status"] == 429
        state["refused"] += e["status"] == 403
        rate = state["good"] / state["attempts"]
        state["blocked"] |= e["status"] == 429 and state["limited"] >= s["limited"] or e["status"] == 403 and state["refused"] >= s["refused"]
        state["blocked"] |= state["attempts"] >= s["least"] and rate < s["rate"]
    return state, {"attempts": state["attempts"], "rate": round(rate, 6), "blocked": bool(state["blocked"])}


def registry_step(state: dict, e: dict, s: dict) -> tuple[dict, dict]:
    """Failures add one, successes take two; enough block for a time, many for good; a block past its time is forgotten."""
    state = dict(state)
    if state["until"] is not None and e["at"] > state["until"]:
        state = {"count": 0, "until": None, "forever": False}
    if e["ok"]:
        state["count"] = max(0, state["count"] - 2)
        if not state["count"]:
            state = {"count": 0, "until": None, "forever": False}
    else:
        state["count"] += 1
        if state["count"] >= s["forever"]:
            state.update(until=None, forever=True)
        elif state["count"] >= s["block"]:
            state["until"] = e["at"] + s["cooldown"]
    return state, {"count": state["count"], "blocked": state["forever"] or state["until"] is not None, "temporary": not state["forever"]}


def blacklist_step(state: dict, e: dict, s: dict) -> tuple[dict, dict]:
    """Errors in a window: many at all, or enough of one kind that are most of them."""
    errors = [x for x in state["errors"] if x[0] > e["at"] - s["window"]]
    if not e["ok"]:
        errors.append([e["at"], e["status"] == 403])
    bots = sum(x[1] for x in errors)
    listed = len(errors) >= s["errors"] or bots >= s["bots"] and bots / len(errors) > 0.8
    return {"errors": errors}, {"recent": len(errors), "listed": bool(listed), "retry_in": float(min(300_000, 1000 * 2 ** min(len(errors), 20)))}


# By kind of error, factor of delays, least delays, divisor of concurrency.
ADAPTATION = {429: (2, 10_000, 20_000, 2), 403: (3, 15_000, 30_000, 4), 404: (1, 1000, 3000, 1), 408: (1.5, 5000, 15_000, 1.5), 500: (2, 8000, 16_000, 1.5), 0: (1.2, 3000, 8000, 1.2)}
# End of fixed values.


def adaptive_step(state: dict, e: dict, s: dict) -> tuple[dict, dict]:
    """Delays grow, to ``longest`` at most, and concurrency shrinks by the kind of error."""
    state = dict(state)
    if e["status"] >= 400:
        factor, least, most, divisor = ADAPTATION.get(e["status"], ADAPTATION[0])
        state["low"] = min(s["longest"], max(least, int(state["low"] * factor)))
        state["high"] = min(s["longest"], max(most, int(state["high"] * factor)))
        state["slots"] = max(1, int(state["slots"] / divisor))
    return state, dict(state)


def cache_step(state: dict, e: dict, s: dict) -> tuple[dict, dict]:
    """Least-recently-used cache with a time to live: whether the item was there."""
    items = {k: v for k, v in state["items"].items() if e["at"] - v < s["ttl"]}
    hit = items.pop(e["item"], None) is not None
    items[e["item"]] = e["at"]
    while len(items) > s["most"]:
        del items[next(iter(items))]
    return {"items": items}, {"hit": hit, "held": len(items)}


MACHINES = {
    "breaker": Machine(breaker_step, {"state": "CLOSED", "failures": [], "run": 0, "opened": None}, "state string, allowed boolean, failures int", {"failures": 5, "successes": 2, "timeout": 60_000, "window": 60_000}),
    "limiter": Machine(limiter_step, {"last": None, "multiplier": 1.0, "burst": 5, "errors": 0, "backoff": None}, "wait double, multiplier double, burst int, errors int", {"rate": 1.0, "burst": 5}),
    "pacing": Machine(pacing_step, {"next": None, "held": None}, "wait long, starts long", {"interval": 500, "hold": 60_000}),
    "tracker": Machine(tracker_step, {"attempts": 0, "good": 0, "limited": 0, "refused": 0, "blocked": False}, "attempts int, rate double, blocked boolean", {"limited": 10, "refused": 5, "rate": 0.1, "least": 5}),
    "registry": Machine(registry_step, {"count": 0, "until": None, "forever": False}, "count int, blocked boolean, temporary boolean", {"block": 5, "forever": 20, "cooldown": 86_400_000}),
    "blacklist": Machine(blacklist_step, {"errors": []}, "recent int, listed boolean, retry_in double", {"window": 86_400_000, "errors": 10, "bots": 5}),
    "adaptive": Machine(adaptive_step, {"low": 2000, "high": 5000, "slots": 4}, "low int, high int, slots int", {"longest": 86_400_000}),
    "cache": Machine(cache_step, {"items": {}}, "hit boolean, held int", {"ttl": 3_600_000, "most": 1000}),
}


def _same(a, b) -> bool:
    return a == b or a != a and b != b


def run_batch(events: DataFrame, machine: str, key: str, order: list[str], **settings) -> DataFrame:
    """The machine's output for each event of each key, in ``order``.

    Events are sorted by key and order within partitions and read in batches, so
    only one state is held at a time, and a key of any length streams through (in
    one task, since each step needs the one before).  Null is a key like others.
    An event without time, status or outcome has no output and changes nothing.
    """
    m = MACHINES[machine]
    fields = {f.name: f for f in events.schema.fields}
    kept = [key, *order]
    output = StructType.fromDDL(m.output)
    schema = StructType([*(fields[c] for c in kept), *output.fields])
    arrow = to_arrow_schema(output)
    every = m.settings | settings
    needed = [c for c in ("at", "status", "ok") if c in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = dict(m.start), object()
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                if not _same(e[key], current):
                    state, current = dict(m.start), e[key]
                if any(e[c] is None for c in needed):
                    rows.append({})
                    continue
                state, out = m.step(state, e, every)
                rows.append(out)
            columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], schema.names)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def tracked(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The tracker's counts by a window: attempts of the key so far, and the rate of good ones."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count("*").over(w)
    return events.withColumns({"attempts": n.cast("int"), "rate": F.round(F.count_if(F.col("status") < 400).over(w) / n, 6)})


def blacklisted(events: DataFrame, key: str, window: int = 86_400_000, errors: int = 10, bots: int = 5) -> DataFrame:
    """The blacklist's rule by a window over time (``at``, milliseconds): errors in it, and whether they are too many or mostly of one kind."""
    w = Window.partitionBy(key).orderBy("at").rangeBetween(1 - window, Window.currentRow)
    recent, refused = F.count_if(~F.col("ok")).over(w), F.count_if(~F.col("ok") & (F.col("status") == 403)).over(w)
    listed = (recent >= errors) | ((refused >= bots) & (refused > 0.8 * recent))
    return events.withColumns({"recent": recent.cast("int"), "listed": listed})
