import hashlib
import os
import random

from quern.llm import warc
from quern.llm.common import new_path


def rows():
    rnd = random.Random(3)
    texts = ["", "a", "é" * 500, "x" * 3_000_000, *("".join(rnd.choice("abc\r\n") for _ in range(rnd.randint(0, 2000))) for _ in range(60))]
    out = [(i, f"http://e.com/{i}?a=b\n", rnd.choice(texts)) for i in range(300)]
    return [*out, (400, None, None), (None, "u", "only"), (None, "u", texts[5]), (401, "é", "\r\n\r\nWARC/1.1\r\n"), (299, "again", out[299][2])]


def brute(data, least):
    out = []
    for i, _, t in data:
        p = (t or "").encode()
        same = [j for j, _, u in data if (u or "") == (t or "") and j is not None]
        head = max(same) if same and len(p) >= least else i
        again = i != head
        out.append((i is None, i or 0, len(p), warc.digest(p), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    data = rows()
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as sha").repartition(4)
    for least in (0, 100):
        got = [(r[0] is None, r[0] or 0, *r[1:]) for r in warc.round_trip(pages, least).collect()]
        assert sorted(got, key=str) == brute(data, least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_files(spark):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    found = []
    for n in (1, 6):
        root = new_path(spark, "w")
        manifest = warc.write(pages.repartition(n), root, shard_bytes=1 << 20, file_bytes=20_000).orderBy("file").collect()
        folder = root.removeprefix("file://")
        for m in manifest:
            with open(f"{folder}/{m.file}", "rb") as f:
                assert hashlib.sha256(f.read()).hexdigest() == m.sha256
        assert sorted(x for x in os.listdir(folder) if not x.startswith("part-")) == ["_manifest"]
        found.append([tuple(m) for m in manifest])
        payloads = {r.page_id: bytes(r.payload) for r in warc.read(spark, root).where("record_type = 'response'").collect()}
        assert all(payloads[i] == (t or "").encode() for i, _, t in rows() if i is not None and i in payloads)
    assert found[0] == found[1] and len(found[0]) > 3


def test_one_id_with_many_records(spark):
    """Records of one id, and those without any, are spread over shards."""
    data = [(7, f"u{i}", f"{i} " * 3000) for i in range(400)] + [(None, f"v{i}", f"n{i} " * 3000) for i in range(400)] + [(1, "w", "one")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    root = new_path(spark, "w")
    manifest = warc.write(pages, root, shard_bytes=1 << 20).collect()
    assert len({m.file.split("-")[1] for m in manifest}) > 4 and sum(m.records for m in manifest) == len(data)
    assert sorted((str(r.page_id), r.url, bytes(r.payload).decode()) for r in warc.read(spark, root).collect()) == sorted((str(i), u, h) for i, u, h in data)
