"""The network against loops over words, and word shares against plain counts."""
import re
from collections import Counter

import numpy as np

from postloom.llm import likelihood as L


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, x string, n int").repartition(3)


def parameters(seed=0):
    return np.random.default_rng(seed).normal(0, 0.3, L.SHAPE).astype(np.float32)


def slow(x, p):
    e, u, c = p
    total = 0.0
    for i, w in enumerate(x):
        around = [x[i + o] if 0 <= i + o < len(x) else 0 for o in L.OFFSETS]
        z = np.tanh(sum(e[k][a].astype(float) for k, a in enumerate(around))) @ u.astype(float) + c
        total += z[w] - np.log(np.exp(z).sum())
    return total


def test_every_word_is_predicted_from_both_sides():
    p, r = L.split(parameters()), np.random.default_rng(1)
    for n in (0, 1, 2, 5, 300, L.MOST, L.MOST + 1, 2 * L.MOST + 3):
        x = r.integers(1, L.V, n)
        assert np.isclose(L.log_likelihood(x, p), slow(x, p), rtol=1e-4, atol=1e-3)


def test_training_follows_the_gradient():
    x, before = np.random.default_rng(2).integers(1, L.V, 200), parameters()
    after, rate = before.copy(), 1e-2
    L.step(x, L.split(after), rate)
    moved = (before - after) / rate  # the gradient of the mean loss
    for i in np.random.default_rng(3).choice(np.flatnonzero(np.abs(moved) > 1e-3), 12):
        lo, hi = before.copy(), before.copy()
        lo[i] -= 0.05
        hi[i] += 0.05
        assert np.isclose((slow(x, L.split(lo)) - slow(x, L.split(hi))) / len(x) / 0.1, moved[i], rtol=0.05, atol=1e-4)


def test_words_have_their_share_of_their_class(spark):
    rows = [(i, " ".join(f"filler{j}" for j in range(250))) for i in range(10)] + [(100, "filler1 filler2 rareing filler3 filler4")]
    rows += [(200 + i, "filler1 filler2 oftening filler3 filler4") for i in range(5)] + [(300, "ofter"), (None, None), (2**53 + 1, ""), (400, "Filler1 FILLER2\trareing"), (400, "x " * 300_000)]
    rows[-2] = (400, "filler1\x0bfiller2 rareing\nfiller3  filler4 ")
    got = L.score(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == sorted((d or 0, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for d, t in rows)
    of = {(r.doc_id, r.n_words): r for r in got}
    n = Counter(w for _, t in rows for w in re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert np.isclose(of[200, 5].log_likelihood - of[100, 5].log_likelihood, np.log(n["oftening"] / n["rareing"]))
    assert np.isclose(of[400, 5].log_likelihood, of[100, 5].log_likelihood) and of[None, 0].mean_log_likelihood is None and of[2**53 + 1, 0].log_likelihood == 0


def test_text_like_the_corpus_scores_higher(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the rug " * 20) for i in range(200)] + [(900, "mat the on sat rug dog the and cat the sat on the " * 20)]
    got = L.score(frame(spark, rows)).toPandas().set_index("doc_id").mean_log_likelihood
    assert got[0] > got[900] + 0.3


def test_empty_table(spark):
    assert L.score(frame(spark, [])).count() == 0
