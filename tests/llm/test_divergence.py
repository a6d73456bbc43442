import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postloom.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DDL = "doc_id long, text string, lang string, source string, value string"


def plain(given, least=3, k=200):
    words = [(r[2] or "", r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in given]
    docs = {}
    for lang, _, ts in words:
        docs.setdefault(lang, Counter()).update(set(ts))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in docs.items()}
    counts = {}
    for lang, source, ts in words:
        for g in ((lang, source), (lang,)):
            counts.setdefault(g, Counter()).update(t for t in ts if t in kept[lang])
    total = {g: sum(c.values()) for g, c in counts.items()}
    p = lambda g, t: 1 + 10**9 * (counts[g][t] + 1) // (total[g] + len(kept[g[0]]))
    f = lambda p, q: (p - q) * (p - q) // q
    out = []
    for g in counts:
        if len(g) < 2:
            continue
        parts = {"pair": [], "term": []}
        for o in counts:
            if len(o) == 2 and o != g and o[0] == g[0]:
                parts["pair"].append((-sum(f(p(g, t), p(o, t)) for t in kept[g[0]]), o[1].encode()))
        for t in kept[g[0]]:
            if counts[g][t] and p(g, t) > p((g[0],), t):
                parts["term"].append((-f(p(g, t), p((g[0],), t)), t.encode()))
        for part, found in parts.items():
            found = sorted(found)[: k if part == "term" else None]
            out += [(*g, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def made(seed, n):
    r = random.Random(seed)
    odd = ["Straße", "straße", "ÉCOLE", "école", "漢字", "it's", "a1b", "\x00", "[x]", "@y", "\x7f", "z"]
    weights = [1 / (i + 1) for i in range(300)]
    rows = []
    for i in range(n):
        ws = [f"{chr(97 + w % 26)}{chr(97 + w // 26)}" for w in r.choices(range(300), weights, k=r.randrange(60))] + r.choices(odd, k=r.randrange(4))
        text = r.choice([" ", "\n", "-"]).join(ws)
        rows.append((i // 2, text if r.random() > 0.05 else None, r.choice(["en", "en", "de", None, ""]), r.choice(["hot", "hot", "s1", "s2", None, "ü"]), "clash"))
    return rows + rows[:5] + [(1, "alone", "xx", "only", "clash"), (2, "", "yy", "a", "x"), (2, None, "yy", "b", "x")]


@pytest.mark.parametrize("seed,k", [(1, 200), (2, 5)])
def test_equals_a_plain_program(spark, seed, k):
    given = made(seed, 400)
    got = divergence.audit(spark.createDataFrame(given, DDL).repartition(3), k=k)
    assert sorted(map(tuple, got.collect())) == plain(given, k=k)


def test_search_goes_on_until_bounds_fall_below(spark):
    """Ties at the k-th value, in buckets of equal bounds, and groups whose first buckets have no term above the language's."""
    given = [(i, " ".join(f"{chr(97 + j)}{chr(97 + i % 7)}" for j in range(26)), "en", f"s{i % 3}", "x") for i in range(90)]
    got = divergence.audit(spark.createDataFrame(given, DDL), k=4)
    assert sorted(map(tuple, got.collect())) == plain(given, k=4)


def test_merges_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = spark.createDataFrame([("en", f"t{i % 11}", 1, [f"s{i % 3}"], [i]) for i in range(300)], divergence.COUNTED)
        got = {r.term: (r.docs, dict(zip(r.sources, r.counts))) for r in divergence.merged(parts, 28).collect()}
        want = {}
        for i in range(300):
            n, by = want.setdefault(f"t{i % 11}", (0, Counter()))
            by[f"s{i % 3}"] += i
            want[f"t{i % 11}"] = n + 1, by
        assert got == {t: v for t, v in want.items() if v[0] >= 28}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], DDL)).count() == 0


def test_buckets_are_in_order_of_counts(spark):
    found = spark.range(1, 5000).withColumnRenamed("id", "c").select("c", F.expr(divergence.BUCKET).alias("b")).orderBy("c").collect()
    b = [r.b for r in found]
    assert b == sorted(b) and b[:31] == list(range(1, 32)) and len(set(b)) < 150
