"""Class terms against a plain count on odd posts, and how often texts are read."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postloom.operators import posts as P


def plain(rows, least, most, stop, grams):
    n, holders = Counter(), {}
    for cluster, post, content in rows:
        words = [w for w in "".join(c if c.isalpha() else " " for c in (content or "").lower()).split() if len(w) >= 3 and w not in stop]
        for t in words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if grams == 2 else []):
            n[cluster, t] += 1
            holders.setdefault((cluster, t), set()).update({post} - {None})
    f, posts = Counter(), Counter()
    for (cluster, t), x in n.items():
        f[t] += x
        posts[t] += len(holders[cluster, t])
    best = sorted((t for t in f if posts[t] >= least), key=lambda t: (-f[t], t))[:most]
    return sorted((str(c), t, x, f[t]) for (c, t), x in n.items() if t in best)


ODD = [("a", 1, "red fox red fox"), ("a", 1, "red fox"), ("b", 1, "red hen"), ("a", 2, "blue fox, the red fox"), (None, 3, "red fox ox"), (None, None, "blue hen blue hen"), ("b", 4, None), ("b", 5, ""), ("b", 6, "no ox"), ("c", 7, "Äpfel äpfel 𝒳𝒴𝒵 red")]


@pytest.mark.parametrize("grams", [1, 2])
@pytest.mark.parametrize("least, most, stop, held", [(2, 50, (), 3), (1, 4, ("the", "fox"), 2_000_000), (2, 3, ("red",), 1)])
def test_terms_of_odd_posts(spark, grams, least, most, stop, held):
    """Repeated and null ids, null clusters and texts, no words, and counts in parts."""
    df = spark.createDataFrame(ODD, "cluster string, id long, content string").repartition(2)
    got = P.class_terms(df, least_posts=least, most=most, stop=stop, grams=grams, held=held).select("cluster", "term", "n", "f")
    assert sorted((str(r.cluster), r.term, r.n, r.f) for r in got.collect()) == plain(ODD, least, most, stop, grams)


def test_texts_are_read_once(spark):
    """Before, each use of the counts tokenised all texts again: three times in one query."""
    read = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [("ab"[i % 2], i, f"some words here and number {'x' * (i % 9 + 3)}") for i in range(300)]
    df = spark.createDataFrame(rows, "cluster string, id long, content string").where(F.length("content") > 0)
    seen = df.mapInPandas(passing, df.schema)
    assert P.ctfidf(P.class_terms(seen, grams=2)).count() == 20
    assert read.value <= 600  # once for the repeated ids, once for the words
