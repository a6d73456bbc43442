import math
import zlib
from collections import Counter

import numpy as np

from postloom.llm import quality, toxicity

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    known, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()
    keep = quality.resample(docs, known).toPandas().set_index("doc_id").keep
    assert len(keep) == docs.count() and (keep[held.doc_id].to_numpy() == (held.quality == 1)).mean() >= 0.95
    toxic = toxicity.chain_probabilities(docs, toxicity.learn(docs, known)).toPandas().set_index("doc_id").toxic
    print("held out", (keep[held.doc_id].to_numpy() == (held.quality == 1)).mean(), (toxic[held.doc_id].to_numpy() == (held.toxic == 1)).mean())
    assert len(toxic) == docs.count() and (toxic[held.doc_id].to_numpy() == (held.toxic == 1)).mean() >= 0.9


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0, 2.0, True) for r in rows], "doc_id long, text string, row string, k double, p double, keep boolean").repartition(3)


EDGE = [(1, None), (2, ""), (3, "good plain words here"), (3, "other good words"), (None, "good words"), (2**53 + 1, "good plain words here"), (5, "bad " * 5000), (6, "bad bad worse"), (7, "plain good words")]


def test_resampling_equals_brute_force(spark):
    labels = spark.createDataFrame([(3, 1), (7, 1), (6, 0), (5, 0), (2**53 + 1, 1), (2**53, 0), (None, 1), (9, None)], "doc_id long, quality int")
    good, half = {3, 7, 2**53 + 1}, quality.BUCKETS // 2

    def buckets(text):
        w, out = (text or "").split(), []
        for i, x in enumerate(w):
            shape = [0 if j < 0 else 7 if j and w[j].lower() == w[j - 1].lower() else quality.shape(w[j]) for j in (i - 2, i - 1, i)]
            out += [("one", zlib.crc32(x.lower().encode()) % half), ("tri", shape[0] * 64 + shape[1] * 8 + shape[2])]
            if i:
                a, b = (zlib.crc32(v.lower().encode()) for v in w[i - 1 : i + 1])
                out.append(("two", ((a * 1_000_003 ^ b) * 2_654_435_761 % 2**64 - (2**64 if (a * 1_000_003 ^ b) * 2_654_435_761 % 2**64 >= 2**63 else 0) >> 7) % half))
        return out

    raw = Counter(b for _, t in EDGE for b in buckets(t))
    target = Counter(b for d, t in EDGE if d in good for b in buckets(t))
    ratio = {}
    for part, n, prior in (("one", half, 50.0 * half), ("two", half, 50.0 * half), ("tri", 512, 100.0)):
        all_raw = sum(v for (p, _), v in raw.items() if p == part) + 0.5 * n
        all_target = sum(v for (p, _), v in target.items() if p == part)
        for i in range(n):
            q = (raw[part, i] + 0.5) / all_raw
            ratio[part, i] = math.log((target[part, i] + prior * q) / (all_target + prior)) - math.log(q)
    weights = [sum(ratio[b] for b in buckets(t)) for _, t in EDGE]
    got = quality.resample(frame(spark, EDGE), labels, carry=True).collect()
    key = lambda d, t: (d is None, d or 0, t or "", t is None)
    got.sort(key=lambda r: key(r.doc_id, r.row.text))
    want = sorted(zip(EDGE, weights), key=lambda x: key(*x[0]))
    assert [r.row.doc_id for r in got] == [d for (d, _), _ in want] and np.allclose([r.log_weight for r in got], [w for _, w in want])
    known = [(w, d in good) for (d, _), w in want if d in good | {6, 5}]
    cut = quality.threshold(np.array([w for w, _ in known]), np.array([int(g) for _, g in known]))
    k = sum(w >= cut for _, w in want)
    edge = sorted((math.floor(r.gumbel_key * 2**20) for r in got), reverse=True)[k - 1]
    assert [r.keep for r in got] == [math.floor(r.gumbel_key * 2**20) >= edge for r in got]
    assert len({r.gumbel_key - r.log_weight for r in got if r.doc_id == 3}) <= 2


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(frame(spark, EDGE), none).where("keep").count() == len(EDGE) and quality.resample(frame(spark, []), none).count() == 0
    assert toxicity.learn(frame(spark, EDGE), none) is None
    got = toxicity.chain_probabilities(frame(spark, EDGE), None, carry=True)
    assert got.where("not toxic").select("row.*").columns == ["doc_id", "text", "row", "k", "p", "keep"] and got.where("not toxic").count() == len(EDGE)


def test_gumbel_keys_favour_heavy_documents(spark):
    rows = [(i, "fine tidy prose") for i in range(300)] + [(1000 + i, "junk junk mess") for i in range(300)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(1000 + i, 0) for i in range(40)], "doc_id long, quality int")
    got = quality.resample(frame(spark, rows), labels).toPandas()
    assert got[got.keep].doc_id.lt(1000).mean() > 0.7 and got.keep.sum() == 300


def test_chain_equals_a_plain_reading_of_its_weights(spark):
    rows = EDGE + [(100 + i, f"calm day number {i}") for i in range(60)] + [(200 + i, "you nasty fool" if i % 2 else "awful vile trash") for i in range(40)]
    labels = spark.createDataFrame([(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(40)], "doc_id long, toxic int")
    at, weights, cut = model = toxicity.learn(frame(spark, rows), labels)
    got = {(r.doc_id, r.row.text): r for r in toxicity.chain_probabilities(frame(spark, rows), model, carry=True).collect()}
    assert len(got) == len(set(rows))
    for d, t in rows:
        p, found = [], {at[f] for f in toxicity.features(t) if f in at}
        for w in weights:
            p.append(1 / (1 + math.exp(-max(-30, min(30, sum(w[i] for i in found) + sum(a * b for a, b in zip(p, w[len(at) :])) + w[-1])))))
        assert np.allclose(got[d, t].p, p) and got[d, t].toxic == (p[-1] >= cut)
    assert all(got[d, t].toxic == (d is not None and d >= 200 and d < 2**50) for d, t in rows)
    assert len(weights) == len(toxicity.CHAIN) and [len(w) - len(at) - 1 for w in weights] == list(range(len(weights)))


def test_features_are_grouped_by_the_documents_they_share():
    x = np.zeros((40, 6), np.float32)
    x[:20, :3] = x[20:30, 3:5] = x[30:, 5:] = 1
    of = toxicity.group_features(x)
    assert len({*of[:3]}) == len({*of[3:5]}) == 1 and len({of[0], of[3], of[5]}) == 3
