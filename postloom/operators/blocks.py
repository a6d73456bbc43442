"""Pairs of all rows of a table, block by block: rows are dealt into blocks by a hash of their id, and each pair of blocks meets in one task, which goes through it piece by piece.

A row is sent once for each block, so a table is cut into BLOCKS blocks at most, whatever its size, until they would hold more than LARGEST rows: what is sent grows with the table, and a task's memory is bounded.
"""
import numpy as np
from pyspark.sql import functions as F

#: Rows a block holds, about, in a table of few of them.
BLOCK = 512
#: The most blocks of a table, and the most of a part of it that meets only some others, unless they would hold more than LARGEST rows, about.
BLOCKS, SOME, LARGEST = 24, 8, 50_000
#: The most partitions over which pairs of blocks are dealt.
PAIRS = 400
#: Rows of a block that are compared with as many of another at once.
TILE = 1024


def finite(vector):
    """Whether a vector column is there, not empty, and holds finite numbers only."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def vectors(df, id="id", vector="embedding"):
    """id, v (array<double>) of the rows whose id and vector can take part."""
    p = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return p.where(F.col("id").isNotNull() & finite("v"))


def paired(p, block=BLOCK):
    """Each row of p (with a column id) once for each block that its own meets: with g, the two blocks, and side: 0 in the first, 1 in the second, 2 where a block meets itself. Pairs of blocks are dealt over as many partitions as there are pairs, up to PAIRS and one for 256 rows: they are few bytes but long work."""
    n = p.count()
    subs = max(1, min(BLOCKS, -(-n // block)), -(-n // LARGEST))
    p = p.withColumn("s", F.expr(f"pmod(xxhash64(id), {subs}L)"))
    groups = F.expr(f"transform(sequence(0L, {subs - 1}L), x -> named_struct('g', named_struct('a', least(s, x), 'b', greatest(s, x)), 'side', if(s = x, 2, if(s < x, 0, 1))))")
    p = p.withColumn("x", F.explode(groups)).withColumn("g", F.col("x.g")).withColumn("side", F.col("x.side")).drop("x", "s")
    return p.repartition(max(1, min(PAIRS, subs * (subs + 1) // 2, n // 256)), "g")


def paired_within(p, group, block=BLOCK):
    """As paired, for the rows of each group by themselves, each of SOME blocks at most: g has the group as `of`."""
    subs = p.groupBy(F.col(group).alias("of")).agg(F.greatest(F.least(F.ceil(F.count("*") / block), F.lit(SOME)), F.ceil(F.count("*") / LARGEST)).alias("subs"))
    p = p.withColumnRenamed(group, "of").join(subs, "of").withColumn("s", F.expr("pmod(xxhash64(id), subs)"))
    groups = F.expr("transform(sequence(0L, subs - 1L), x -> named_struct('g', named_struct('of', of, 'a', least(s, x), 'b', greatest(s, x)), 'side', if(s = x, 2, if(s < x, 0, 1))))")
    return p.withColumn("x", F.explode(groups)).withColumn("g", F.col("x.g")).withColumn("side", F.col("x.side")).drop("x", "s", "subs")


def sides(pdf):
    """(first block's rows, second block's rows, whether it is one block), in order of ids, so that each pair's arithmetic is the same in every run."""
    pdf = pdf.sort_values("id", kind="stable")
    same = bool((pdf.side == 2).any())
    return pdf[pdf.side != 1], pdf[pdf.side != 0], same


def by_length(x, y):
    """(rows of x, rows of y, their matrices) for each length that vectors of both have."""
    of_x, of_y = (np.array([len(v) for v in z], np.int64) for z in (x, y))
    for n in np.intersect1d(of_x, of_y):
        i, j = np.flatnonzero(of_x == n), np.flatnonzero(of_y == n)
        yield i, j, np.stack([x[a] for a in i]), np.stack([y[a] for a in j])


def pieces(x, y, same, tile=TILE):
    """(places in x, places in y, matrices of their rows, in double precision) of all pairs of two lists' vectors of one length, `tile` by `tile`; where the lists are the same, each pair of pieces once."""
    for i, j, a, b in by_length(x, y):
        a = a.astype(float)
        b = a if same else b.astype(float)
        for s in range(0, len(i), tile):
            for t in range(s if same else 0, len(j), tile):
                yield i[s : s + tile], j[t : t + tile], a[s : s + tile], b[t : t + tile]


def exact(a, b, i, j):
    """Euclidean distances of rows i of a from rows j of b, added up dimension by dimension, so that a pair's is the same in every block."""
    total = np.zeros(len(i))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        total += (x[i] - y[j]) ** 2
    return np.sqrt(total)


def about(a, b):
    """(squared distances of all rows by a product, how far off they may be, scale): those of rows times the scale, a power of two that keeps squares finite."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    scale = 1.0 if most < 1e100 else 2.0**-700
    a, b = a * scale, b * scale
    of_a, of_b = (a * a).sum(1), (b * b).sum(1)
    return of_a[:, None] + of_b - 2 * (a @ b.T), 1e-11 * (of_a.max(initial=0) + of_b.max(initial=0)), scale
