import math
import random

import duckdb
from pyspark.sql import functions as F

from quern.llm.queries import ORACLES
from quern.llm.vector_approximation import top_k

from ..oracle import compare


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(ok) if m != n and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr("quern.llm.vector_approximation.BLOCK", 100)
    monkeypatch.setattr("quern.llm.vector_approximation.GROUP", 3)
    monkeypatch.setattr("quern.llm.vector_approximation.BATCH", 500)
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(500)]
    rows += [(i, [1.0] * 8) for i in range(600, 760)] + [(800, [0.5] * 3), (801, [1.0, 2.0, 3.0]), (850, []), (851, [])]
    rows += [(None, [0.0] * 8), (901, None), (902, [None] * 8), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (7, [9.0] * 8), (950, [1e6] * 8), (951, [1e6] * 8)]
    rows += [(950, [1e6] * 8), (950, [0.25] * 8), (100, [rnd.gauss(0, 1) for _ in range(8)]), (8, [9.0] * 8), (8, [9.0] * 8), (1000, [1e6] * 2), (1001, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "1 as size")
    got = sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)
    assert top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_against_sql(spark, tmp_path):
    """Repeated rows and copies, as the SQL has them."""
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(300)] + [(50, [0.5] * 6), (50, [0.5] * 6), (100, [0.5] * 6), (7, [0.5] * 6), (None, [1.0] * 6), (3, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(top_k(frame, F.col("vec_id") % 50 == 0), con, ORACLES["op8_top_k"]) == 5 * 8 + 5
