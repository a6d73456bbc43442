"""The join against a brute force over word tuples, which shares no code with it."""
import random
import re

import pytest

from postloom.llm import jaccard

EDGE = [(1, None), (2, ""), (3, "A b c d e f g"), (4, "a B c d e f g"), (5, "one two"), (6, " \t\n"), (7, "word " * 3000), (None, "a b c d e f g"), (3, "A b c d e f g"), (3, "z y x w v u t"), (8, "z y x w v u t"), (9, "One\x0btwo"), (10, "one\x85two")]


def words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(x, y):
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def groups(sets, use):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in use:
        for j in use:
            if i < j and linked(sets[i], sets[j]):
                root[find(j)] = find(i)
    return [find(i) for i in range(len(sets))]


def varied(seed, lengths, n, changes):
    r, rows = random.Random(seed), []
    for i in range(n):
        w = [f"w{i}_{j}" for j in range(r.choice(lengths))]
        for k in range(4):
            x = list(w)
            for _ in range(r.choice(changes)):
                x[r.randrange(len(x))] = f"z{r.random()}"
            rows.append((1000 + 4 * i + k, " ".join(x)))
    return rows


def passages(seed, n):
    """Documents that share one passage, some nearly whole."""
    r, p = random.Random(seed), " ".join(f"p{i}" for i in range(60))
    return [(5000 + i, p + " " + " ".join(f"q{r.random()}" for _ in range(r.choice([3, 8, 12, 60])))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "doc_id long, text string, node string, n int, row string").repartition(3)


@pytest.mark.parametrize("rows", [EDGE, EDGE + varied(2, [4, 6, 9, 12, 25, 60], 25, [0, 1, 1, 2]), varied(3, [120, 700, 1500], 6, [0, 1, 3, 5]), passages(4, 60)], ids=["edge", "short", "long", "passages"])
def test_components_links_and_survivors(spark, rows):
    sets = [shingles(t) for _, t in rows]
    named = [i for i, (d, _) in enumerate(rows) if d is not None]
    g, least = groups(sets, named), {}
    for i in named:
        least[g[i]] = min(least.get(g[i], rows[i][0]), rows[i][0])
    key = lambda x: (x[0] is None, *(v or 0 for v in x))
    want = sorted(((d, len(s), None if d is None else least[g[i]] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=key)
    assert sorted((tuple(r) for r in jaccard.classes_of(frame(spark, rows)).collect()), key=key) == want
    kinds = {sets[i] for i in named if sets[i]}
    near = {s: {o for o in kinds if o != s and linked(s, o)} for s in kinds}
    links, members = jaccard.links_of(frame(spark, rows))
    got = members.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == want
    assert sorted(((r.doc_id, r.n_links) for r in got), key=key) == sorted(((d, 0 if d is None else len(near.get(s, ()))) for (d, _), s in zip(rows, sets)), key=key)
    assert links.count() == sum(map(len, near.values())) // 2 == links.distinct().count()
    g = groups(sets, range(len(rows)))
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        if sets[i]:
            first.setdefault(g[i], i)
    kept = jaccard.keep_first(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "node", "n", "row"]
    ids = lambda x: sorted(("" if d is None else str(d), t or "", len(s)) if not s else ("", "", len(s)) if d is None else (str(d), "", len(s)) for d, t, s in x)
    assert ids((r.doc_id, r.text, shingles(r.text)) for r in kept.collect()) == ids((*rows[i], sets[i]) for i in [*first.values(), *[i for i, s in enumerate(sets) if not s]])


def test_empty_table(spark):
    none = frame(spark, [])
    assert jaccard.classes_of(none).count() == jaccard.keep_first(none).count() == jaccard.links_of(none)[1].count() == 0


@pytest.mark.parametrize("docs", [10, 10**9])
def test_linked_sets_share_a_signature_whatever_the_allocation(docs):
    import numpy as np

    r = np.random.default_rng(5)
    for n in [*range(4, 40), 64, 100, 333, 1000]:
        for _ in range(20):
            x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            d = jaccard.most(n, n)
            gone = int(r.integers(0, d // 2 + 1))
            y = np.unique(np.concatenate([x[r.permutation(n)[gone:]], r.integers(0, 2**64, int(r.integers(0, d - gone + 1)) if gone else 0, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                assert len(np.intersect1d(jaccard.signatures(x, docs), jaccard.signatures(y, docs))) or np.array_equal(x, y)


def test_rows_without_an_id_hide_no_link(spark):
    """The same set under a null id, first, last or alone in its partition."""
    base = [f"w{i}" for i in range(60)]
    same, near = " ".join(base), " ".join(base[:57] + ["x", "y", "z"])
    for rows in ([(None, same), (5, same), (6, near)], [(5, same), (6, near), (None, same)], [(None, same), (None, near), (5, same), (6, near)]):
        for parts in (1, 3):
            df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
            got = {r.doc_id: r.component_id for r in jaccard.classes_of(df if parts == 1 else df.repartition(parts)).collect()}
            assert got[5] == got[6] == 5
        members = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.links_of(df)[1].where("doc_id is not null").collect()}
        assert members == {5: (1, 5), 6: (1, 5)}
