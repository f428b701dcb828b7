"""Transitions of the state machines, and that streams and batches agree."""

import random

from pyspark.sql import functions as F

from quern.operators import state as Z
from quern.streaming.machines import run_stream


def events(*rows):
    return [{"at": at, "ok": ok, "status": 200 if ok else 500} for at, ok in rows]


def test_breaker_reaches_every_state():
    m = Z.MACHINES["breaker"]
    out = m.run(events(*((i * 10, False) for i in range(5)), (100, True), (60_050, True), (60_060, True)))
    assert [r["state"] for r in out] == ["CLOSED"] * 4 + ["OPEN", "OPEN", "HALF_OPEN", "CLOSED"]
    assert not out[5]["allowed"] and out[6]["allowed"]
    again = m.run(events(*((i * 10, False) for i in range(5)), (60_045, False), (60_046, True), (60_047, True)))
    assert [r["state"] for r in again[5:]] == ["HALF_OPEN", "HALF_OPEN", "CLOSED"]  # one failure in the window isn't enough


def test_breaker_window_slides():
    out = Z.MACHINES["breaker"].run(events(*((i * 20_000, False) for i in range(8))))
    assert all(r["state"] == "CLOSED" and r["failures"] <= 3 for r in out)


def test_limiter():
    e = lambda at, status, took=None: {"at": at, "status": status, "took": took}
    out = Z.MACHINES["limiter"].run([e(0, 200), e(10, 429), e(20, 429), e(30, 200, 500)])
    assert [r["multiplier"] for r in out] == [1.0, 0.5, 0.25, round(0.25 * 1.1 * 1.05, 6)]
    assert out[2]["wait"] >= 990 and out[3]["errors"] == 0
    low = Z.MACHINES["limiter"].run([e(i, 500) for i in range(40)])
    assert low[-1]["multiplier"] == 0.1


def test_pacing_and_backoff():
    out = Z.MACHINES["pacing"].run([{"at": 0, "status": 200}, {"at": 100, "status": 429}, {"at": 600, "status": 200}])
    assert [r["wait"] for r in out] == [0, 400, 59_900]
    assert [Z.backoff(n) for n in (0, 1, 10)] == [1000, 2000, 60_000]


def test_tracker_blocks_and_lifts():
    s = [{"at": i, "status": 403} for i in range(5)] + [{"at": 9, "status": 200}] * 2
    out = Z.MACHINES["tracker"].run(s)
    assert [r["blocked"] for r in out] == [False] * 4 + [True, True, False]


def test_registry():
    m = Z.MACHINES["registry"]
    out = m.run(events(*((i, False) for i in range(6)), (7, True), (8, True), (9, True)))
    assert [r["count"] for r in out] == [1, 2, 3, 4, 5, 6, 4, 2, 0] and out[4]["blocked"] and not out[-1]["blocked"]
    assert not m.run(events(*((i, False) for i in range(20))))[-1]["temporary"]
    assert m.run(events(*((i, False) for i in range(5)), (10**9, False)))[-1]["count"] == 1


def test_blacklist_adaptive_cache():
    bots = [{"at": i, "ok": False, "status": 403} for i in range(5)]
    assert [r["listed"] for r in Z.MACHINES["blacklist"].run(bots)] == [False] * 4 + [True]
    out = Z.MACHINES["adaptive"].run([{"status": 429}, {"status": 403}, {"status": 200}])
    assert [(r["low"], r["slots"]) for r in out] == [(10_000, 2), (30_000, 1), (30_000, 1)]
    cache = Z.MACHINES["cache"].run([{"at": i, "item": x} for i, x in enumerate("abcab")], most=2)
    assert [r["hit"] for r in cache] == [False] * 5


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(3), rnd.randrange(400_000), rnd.random() < 0.5) for i in range(200)]
    rows.append((9999, 7, 10_000_000, True))  # moves the watermark past all others
    rows.append((9998, 7, 20_000_000, True))
    schema = "event_id long, user_id long, ms long, ok boolean"
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms"))
    for n, part in enumerate((frame.where("event_id % 2 = 0 AND event_id < 9000"), frame.where("event_id % 2 = 1 AND event_id < 9000"), frame.where("event_id = 9999"), frame.where("event_id = 9998"))):
        part.drop("ms").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    batch = Z.run_batch(frame.withColumn("at", F.col("ms")), "breaker", "user_id", ["at", "event_id"]).where("user_id < 7")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in/0")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = run_stream(stream, "breaker", "user_id", delay="20 minutes").writeStream.format("memory").queryName("machines").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT event_id, state, allowed, failures FROM machines WHERE user_id < 7").collect())
    assert got == sorted(tuple(r) for r in batch.select("event_id", "state", "allowed", "failures").collect())


def test_null_keys_and_values(spark):
    """Null is a key of its own; events without time or status have no output and change nothing."""
    rows = [(None, 1, 1, 429), (None, 2, 2, 429), (None, 3, 3, 429), (7, 1, 4, 429), (7, None, 5, 429), (7, 2, 6, None), (7, 3, 7, 429)]
    events = spark.createDataFrame(rows, "key long, at long, event_id long, status int")
    out = Z.run_batch(events, "tracker", "key", ["at", "event_id"])
    assert dict(out.dtypes)["key"] == "bigint"
    assert {r.event_id: r.attempts for r in out.collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: None, 6: None, 7: 2}


def test_windows_say_what_the_machines_say(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 2]), t, t, s, s < 400) for t, s in enumerate(rnd.choices([200, 403, 429, 500], k=300))]
    events = spark.createDataFrame(rows, "key long, at long, event_id long, status int, ok boolean").repartition(3)
    order = ["at", "event_id"]
    columns = ("event_id", "attempts", "rate")
    assert sorted(Z.tracked(events, "key", order).select(*columns).collect()) == sorted(Z.run_batch(events, "tracker", "key", order).select(*columns).collect())
    columns = ("event_id", "recent", "listed")
    assert sorted(Z.blacklisted(events, "key", window=50).select(*columns).collect()) == sorted(Z.run_batch(events, "blacklist", "key", order, window=50).select(*columns).collect())
