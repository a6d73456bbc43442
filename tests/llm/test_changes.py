import datetime
import random
import zlib

import pytest

from postloom.llm import changes
from postloom.llm.queries import QUERIES

DDL = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double, batch string"
EPOCH = datetime.date(1970, 1, 1)


def plain(given, batches=10, first=19723, days=160, wait=8):
    """The rules, client by client and row by row."""
    rows = list(dict.fromkeys(given))
    seqs = {}
    for r in rows:
        seqs.setdefault(r[1], set()).add(r[2])
    rank = {k: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda s: (s is not None, s)))} for k, v in seqs.items()}
    fed = []
    for change, client, seq, op, at, city, balance, *_ in rows:
        if at is None or change is None or (h := zlib.crc32(str(change).encode())) % 11 == 0:
            continue
        day = (at.date() - EPOCH).days + 5 * (h % 4)
        fed.append((day, change, rank[client][seq], client, op, city, balance, max(1, min(batches, 1 + (day - first) * batches // days))))
    state, out = {}, []

    def apply(client, batch, missed=0):
        s = state[client]
        while s["next"] in s["held"]:
            day, change, n, _, op, city, balance, _ = s["held"].pop(s["next"])
            if op == "I":
                s["city"], s["balance"] = city, balance
            elif op == "U":
                s["city"], s["balance"] = city or s["city"], s["balance"] if balance is None else balance
            elif op == "D":
                s["city"] = s["balance"] = None
            s["last"] = len(out), op
            out.append([change, client, "applied", batch, missed, s["city"], s["balance"], False])
            s["next"], missed = n + 1, 0

    largest = None
    for b in range(1, batches + 2):
        for client, s in state.items():
            while s["held"] and (b > batches or min(x[0] for x in s["held"].values()) + wait <= largest):
                least = min(s["held"])
                missed, s["next"] = least - s["next"], least
                apply(client, b, missed)
        for x in sorted((x for x in fed if x[7] == b), key=lambda x: (x[0], x[1], x[2], str(x[4]), str(x[5]), str(x[6]))):
            s = state.setdefault(x[3], {"next": 1, "held": {}, "city": None, "balance": None, "last": None})
            if x[2] in s["held"] or x[2] < s["next"]:
                out.append([x[1], x[3], "rejected", b, 0, None, None, False])
            else:
                s["held"][x[2]] = x
                apply(x[3], b)
            largest = max(x[0], largest or x[0])
    for s in state.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][7] = True
    return out


def made(seed, n, clients, gap=0):
    r, out = random.Random(seed), []
    for i in range(n):
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i * 120 // n + (gap if i > n // 2 else 0), hours=r.randrange(24))
        client = r.choice([None, 0, 0, 0, *range(clients)])
        row = (i if r.random() > 0.02 else None, client, r.choice([i // 3, i // 3, None]) if r.random() < 0.05 else i // 4, r.choice(["I", "U", "U", "U", "D", None]), None if r.random() < 0.05 else at, r.choice([None, "Ost", "Süd"]), r.choice([None, 1.005, -2.5, round(r.random() * 99, 2)]), "x")
        out += [row] * (2 if r.random() < 0.05 else 1)
    return out


def order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed,n,clients,gap", [(1, 400, 12, 0), (2, 60, 3, 40)])
def test_equals_the_rules(spark, seed, n, clients, gap):
    given = made(seed, n, clients, gap)
    got = changes.apply_changes(spark.createDataFrame(given, DDL).repartition(3))
    want = plain(given)
    assert any(x[4] for x in want) and any(x[2] == "rejected" for x in want)
    assert order(got.select("change_id", "client_id", "status", "batch", "missed", "city", "balance", "current").collect()) == order(want)


def test_empty_table_and_settings_stay(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert changes.apply_changes(spark.createDataFrame([], DDL)).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_dense_ranks(spark):
    r = random.Random(3)
    rows = [(r.choice([None, 1, 1, 1, 2]), r.choice([None, *range(50)])) for _ in range(500)]
    got = {(x.k, x.s): x.n for x in changes.dense_ranks(spark.createDataFrame(rows, "k long, s long"), "k", "s").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        for i, s in enumerate(sorted({s for q, s in rows if q == k}, key=lambda s: (s is not None, s))):
            want[k, s] = i + 1
    assert got == want


def test_the_query(spark):
    d = "/root/testdata/sf0.001"
    given = [tuple(x) for x in spark.read.parquet(f"{d}/client_changes.parquet").select("change_id", "client_id", "seq", "op", "valid_at", "city", "balance", "source", "segment").collect()]
    got = QUERIES["op13_change_applier"](spark, d).collect()
    want = [[*x[:6], None if x[6] is None else int((100 * x[6] + 0.5) // 1), x[7]] for x in plain(given)]
    assert order((r.change_id, r.client_id, r.status, r.batch, r.missed, r.city, r.cents, r.current) for r in got) == order(want)
