import heapq
import random
import re

from quern.llm import chat_format as c


def cheapest(roles):
    """Least cost and then least count of turns, by search over all repairs."""
    best, heap = {}, [(0, 0, 0, None)]  # cost, turns, place, last role
    legal = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    while heap:
        cost, turns, i, last = heapq.heappop(heap)
        if (i, last) in best:
            continue
        best[i, last] = cost, turns
        if i == len(roles) and last == "assistant":
            return cost, turns
        for role in legal[last]:
            if role != "system":
                heapq.heappush(heap, (cost + c.INSERT, turns + 1, i, role))
        if i < len(roles):
            for role in c.CODES:
                change = 0 if role == roles[i] else c.RELABEL if roles[i] in c.CODES else c.NAME
                if role == last:
                    heapq.heappush(heap, (cost + change + c.MERGE, turns, i + 1, role))
                if role in legal[last]:
                    heapq.heappush(heap, (cost + change, turns + 1, i + 1, role))


def test_repairs(spark):
    rnd = random.Random(9)
    roles = ["system", "user", "assistant", None, "tool"]
    rows = []
    for conv in range(120):
        for turn in range(rnd.randint(1, 9)):
            rows.append((conv, turn, rnd.choice(roles), f"t{conv}.{turn}"))
    rows += [(500, t, rnd.choice(roles[:3]), f"t500.{t}") for t in range(3000)]  # spans all tasks
    rows += [(None, 1, "user", "tNone"), (None, None, "user", None), (501, 1, "user", "same"), (501, 1, "user", "same")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as key")
    found = {}
    for r in c.repaired(frame).collect():
        found.setdefault(r.conv_id, []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    source = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] is not None, r[1] or 0, r[2] or "")):
        source.setdefault(conv, []).append(role if role in c.CODES else None)
    for conv, got in found.items():
        got.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.out_turn, r.action != "keep"))
        text = "".join(r.fragment for r in got)
        said = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert re.fullmatch(r"(system )?(user assistant )+", "".join(x + " " for x in said)), (conv, said)
        assert text.count("<|end|>") == len(said)
        assert (sum(r.cost for r in got), len(said)) == cheapest(source[conv]), conv
    assert c.repaired(frame.limit(0)).count() == 0


def test_cuts_change_nothing(spark, monkeypatch):
    """The same rows out, whatever the partitions; conversations that span tasks have many equally good repairs."""
    rnd = random.Random(4)
    rows = [(conv, t, rnd.choice(["user", "assistant", "system", "tool", None]), f"{conv} {t} " + "x" * rnd.randint(0, 300)) for conv in range(6) for t in range(rnd.choice([3, 200, 900]))]
    rows += [(7, 1, "user", "y" * 2_000_000), (7, 2, "user", None), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = None
    for parts, size in ((1, 1 << 40), (4, 20_000), (13, 3_000)):
        monkeypatch.setattr(c, "PART", size)
        got = sorted(map(tuple, c.repaired(frame.repartition(parts)).collect()), key=str)
        assert len(got) == len(rows) and (want is None or got == want)
        want = got
