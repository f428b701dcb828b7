"""State machine queries over events: their types stand for the outcomes of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as Z
from ..operators.report import micros
from .registry import query


def events(t):
    e = F.col("event_type")
    status = F.when(e == "error", 429).when(e == "click", 403).when(e == "signup", 500).otherwise(200)
    return t("events").select("user_id", F.floor(micros("ts") / 1000).alias("at"), "event_id", status.alias("status"), (status < 400).alias("ok"), (F.col("value") * 20).alias("took"), F.floor(F.col("value") / 50).cast("int").alias("item"))


ORDER = ["at", "event_id"]
DAY = 86_400_000

# The SQL folds a key's events one by one in a recursive query: row 0 is the machine's start.
EVENTS = """e AS (SELECT user_id, event_id, ms, status, status < 400 AS ok, value * 20 AS took, CAST(floor(value / 50) AS INTEGER) AS item, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n
  FROM (SELECT *, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'error' THEN 429 WHEN 'click' THEN 403 WHEN 'signup' THEN 500 ELSE 200 END AS status FROM events))"""


def fold(start: dict[str, str], layers: list[dict[str, str]], output: dict[str, str]) -> str:
    """``start``: the state's columns; ``layers``: columns computed one after another from the state and the event, those named as the state's being the next one; ``output``: what a row says."""
    state = list(start)
    inner = f"SELECT e.*, {', '.join('w.' + c for c in state)} FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.n = w.n + 1"
    for layer in layers:
        own = [c for c in layer if c in state]
        inner = f"SELECT * {'EXCLUDE (' + ', '.join(own) + ')' if own else ''}, {', '.join(f'{v} AS {k}' for k, v in layer.items())} FROM ({inner})"
    return f"""WITH RECURSIVE {EVENTS}, w(user_id, n, ms, event_id, {', '.join(state)}) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, {', '.join(start.values())} FROM e
  UNION ALL SELECT user_id, n, ms, event_id, {', '.join(state)} FROM ({inner})
) SELECT user_id, ms AS "at", event_id, {', '.join(f'{v} AS {k}' for k, v in output.items())} FROM w WHERE n > 0"""


CIRCUIT = fold(
    {"st": "'CLOSED'", "fails": "[]::BIGINT[]", "run": "0", "opened": "NULL::BIGINT", "allowed": "true"},
    [
        {"allowed": f"NOT (st = 'OPEN' AND ms - opened < {DAY})", "now": f"CASE WHEN st = 'OPEN' AND ms - opened >= {DAY} THEN 'HALF_OPEN' ELSE st END"},
        {"live": f"[x for x in (CASE WHEN ok THEN fails ELSE list_append(fails, ms) END) if x > ms - {7 * DAY}]", "good": "run + 1"},
        {
            "closes": "allowed AND ok AND now = 'HALF_OPEN' AND good >= 2", "opens": "allowed AND NOT ok AND len(live) >= 3",
        },
        {
            "st": "CASE WHEN NOT allowed THEN st WHEN closes THEN 'CLOSED' WHEN opens THEN 'OPEN' ELSE now END", "fails": "CASE WHEN NOT allowed THEN fails WHEN closes THEN []::BIGINT[] ELSE live END",
            "run": "CASE WHEN NOT allowed THEN run WHEN closes OR NOT ok THEN 0 ELSE good END", "opened": "CASE WHEN opens THEN ms ELSE opened END",
        },
    ],
    {"state": "st", "allowed": "allowed", "failures": "CAST(len(fails) AS INTEGER)"},
)
LIMITER = fold(
    {"last": "NULL::BIGINT", "m": "1.0::DOUBLE", "burst": "5", "errors": "0", "backoff": "NULL::DOUBLE", "wait": "0.0::DOUBLE"},
    [
        {"since": "coalesce(ms - last, 1000000000)", "pause": "1000 / (0.001 * m)", "limited": "status IN (429, 503)"},
        {"wait": "greatest(CASE WHEN burst > 0 AND since > pause THEN 0.0 ELSE greatest(0.0, pause - since) END, coalesce(backoff, 0) - ms)::DOUBLE", "filled": "least(5, burst + CAST(trunc(least(since, 1000000000) / 1000 * 0.001::DOUBLE) AS INTEGER))"},
        {"burst": "filled - CAST(filled > 0 AS INTEGER)", "last": "ms", "errors": "CASE WHEN limited OR NOT ok THEN errors + 1 ELSE 0 END"},
        {"backoff": "CASE WHEN limited AND (status = 429 OR errors >= 3) THEN ms + least(300000, 1000 * pow(2, errors - 1)) WHEN ok THEN NULL ELSE backoff END", "risen": "CASE WHEN m < 1.0 THEN least(1.0, m * 1.1::DOUBLE) ELSE m END"},
        {"m": "CASE WHEN limited THEN m * 0.5 WHEN ok THEN CASE WHEN took < 1000 THEN least(1.2::DOUBLE, risen * 1.05::DOUBLE) WHEN took > 5000 THEN greatest(0.5, risen * 0.95::DOUBLE) ELSE risen END WHEN errors >= 2 THEN greatest(0.1::DOUBLE, m * 0.8::DOUBLE) ELSE m END"},
    ],
    {"wait": "round(wait, 3)", "multiplier": "round(m, 6)", "burst": "burst", "errors": "errors"},
)
PACING = fold(
    {"next": "0::BIGINT", "held": "0::BIGINT", "wait": "0::BIGINT", "starts": "0::BIGINT"},
    [{"wait": "greatest(0, greatest(next, held) - ms)"}, {"starts": "ms + wait"}, {"next": f"starts + {DAY // 4}", "held": f"CASE WHEN status = 429 THEN starts + {DAY} ELSE 0 END"}],
    {"wait": "wait", "starts": "starts"},
)
TRACKER = fold(
    {"attempts": "0", "good": "0", "limited": "0", "refused": "0", "blocked": "false"},
    [
        {"attempts": "attempts + 1", "good": "good + CAST(ok AS INTEGER)", "limited": "limited + CAST(status = 429 AS INTEGER)", "refused": "refused + CAST(status = 403 AS INTEGER)"},
        {"blocked": "CASE WHEN ok THEN blocked AND NOT (limited + refused > 0 AND good / attempts > 0.1 * 2) ELSE blocked OR status = 429 AND limited >= 10 OR status = 403 AND refused >= 5 OR attempts >= 5 AND good / attempts < 0.1 END"},
    ],
    {"attempts": "attempts", "rate": "round(good / attempts, 6)", "blocked": "blocked"},
)
REGISTRY = fold(
    {"hits": "0", "until": "NULL::BIGINT", "forever": "false"},
    [
        {"hits": "CASE WHEN ms > until THEN 0 ELSE hits END", "forever": "CASE WHEN ms > until THEN false ELSE forever END", "until": "CASE WHEN ms > until THEN NULL ELSE until END"},
        {"hits": "CASE WHEN ok THEN greatest(0, hits - 2) ELSE hits + 1 END"},
        {"until": f"CASE WHEN ok THEN CASE WHEN hits = 0 THEN NULL ELSE until END WHEN hits >= 20 THEN NULL WHEN hits >= 5 THEN ms + {DAY} ELSE until END", "forever": "CASE WHEN ok THEN forever AND hits > 0 ELSE forever OR hits >= 20 END"},
    ],
    {"count": "hits", "blocked": "forever OR until IS NOT NULL", "temporary": "NOT forever"},
)
ADAPTIVE = fold(
    {"low": "2000", "high": "5000", "slots": "4"},
    [{
        "low": f"CASE status WHEN 429 THEN least({DAY}, greatest(10000, low * 2)) WHEN 403 THEN least({DAY}, greatest(15000, low * 3)) WHEN 500 THEN least({DAY}, greatest(8000, low * 2)) ELSE low END",
        "high": f"CASE status WHEN 429 THEN least({DAY}, greatest(20000, high * 2)) WHEN 403 THEN least({DAY}, greatest(30000, high * 3)) WHEN 500 THEN least({DAY}, greatest(16000, high * 2)) ELSE high END",
        "slots": "CASE status WHEN 429 THEN greatest(1, slots // 2) WHEN 403 THEN greatest(1, slots // 4) WHEN 500 THEN greatest(1, CAST(trunc(slots / 1.5) AS INTEGER)) ELSE slots END",
    }],
    {"low": "low", "high": "high", "slots": "slots"},
)
CACHE = fold(
    {"items": "[]::STRUCT(k INTEGER, v BIGINT)[]", "hit": "false"},
    [{"live": f"[x for x in items if ms - x.v < {3 * DAY}]"}, {"hit": "len([x for x in live if x.k = item]) > 0", "items": "list_append([x for x in live if x.k <> item], {'k': item, 'v': ms})"}, {"items": "CASE WHEN len(items) > 4 THEN items[len(items) - 3 :] ELSE items END"}],
    {"hit": "hit", "held": "CAST(len(items) AS INTEGER)"},
)


@query(CIRCUIT)
def circuit_breaker(t):
    return Z.run_batch(events(t), "breaker", "user_id", ORDER, failures=3, timeout=DAY, window=7 * DAY)


@query(LIMITER)
def rate_limiter(t):
    return Z.run_batch(events(t), "limiter", "user_id", ORDER, rate=0.001)


@query(PACING)
def request_pacing(t):
    return Z.run_batch(events(t), "pacing", "user_id", ORDER, interval=DAY // 4, hold=DAY)


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, count(*) OVER w AS attempts, count(*) FILTER (event_type IN ('view', 'purchase')) OVER w AS good FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, CAST(attempts AS INTEGER) AS attempts, round(good / attempts, 6) AS rate FROM e""")
def error_tracker(t):
    return Z.tracked(events(t), "user_id", ORDER).select("event_id", "attempts", "rate")


@query(TRACKER)
def error_tracker_blocks(t):
    return Z.run_batch(events(t), "tracker", "user_id", ORDER)


@query(REGISTRY)
def block_registry(t):
    return Z.run_batch(events(t), "registry", "user_id", ORDER, cooldown=DAY)


@query("SELECT event_id, CAST(n AS INTEGER) AS recent, n >= 10 OR (b >= 5 AND b / n > 0.8) AS listed FROM (SELECT event_id, count(*) FILTER (event_type IN ('error', 'click', 'signup')) OVER w AS n, count(*) FILTER (event_type = 'click') OVER w AS b FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW))")
def blacklist_rule(t):
    return Z.blacklisted(events(t), "user_id", window=7 * DAY).select("event_id", "recent", "listed")


@query(ADAPTIVE)
def adaptive_settings(t):
    return Z.run_batch(events(t), "adaptive", "user_id", ORDER)


@query(CACHE)
def cache_eviction(t):
    return Z.run_batch(events(t), "cache", "user_id", ORDER, ttl=3 * DAY, most=4)


@query("SELECT user_id, count(*) AS requests, count(*) FILTER (event_type IN ('error', 'click', 'signup')) AS failures, round(count(*) FILTER (event_type IN ('view', 'purchase')) / count(*) * 100, 4) AS rate FROM events GROUP BY 1")
def breaker_statistics(t):
    return events(t).groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.count_if("ok") / F.count("*") * 100, 4).alias("rate"))
