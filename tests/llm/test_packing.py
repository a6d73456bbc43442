"""Packing against the library's own ids and a plain best-fit-decreasing packer."""
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from postloom.llm import packing

PATH = P.path("word_bpe_49k.json")
EDGE = [(1, None), (2, ""), (3, "Tie"), (4, "Tie"), (4, "Tie"), (None, "no id"), (5, "hello <|endoftext|> world<|startoftext|>x"), (6, "word " * 9000), (7, "x" * 30000), (8, "a\x1cb \x85 İstanbul, ΣΑΣ. é"), (9, "<|endof text|>")]


def library_ids(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, ids string, bin int").repartition(parts)


def test_words_are_encoded_as_the_library_does():
    e, r = packing.WordEncoder(PATH, limit=300), random.Random(4)
    texts = ["".join(r.choice("ab é́\n\t 1'sß漢\x1c\x1f\x85.,!  İΣ🙂가각") for _ in range(r.randrange(60))) for _ in range(600)] + [t or "" for _, t in EDGE] + ["it's don't naïve, ﬁne! 12ab <|endoftext|><|startoftext|> Ångström Å"]
    for at in range(0, len(texts), 50):
        assert [np.frombuffer(x, "<u4").tolist() for x in e(texts[at : at + 50])] == library_ids(texts[at : at + 50])


def plain_best_fit(lengths, size):
    """Number of bins of best-fit decreasing, by trying every bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_and_merging_by_counts_equal_the_plain_packer(seed):
    r = random.Random(seed)
    size, lengths = 64, [r.randrange(1, 65) for _ in range(r.randrange(1, 200))]
    where, offset, fill = packing.best_fit(lengths, size)
    assert len(fill) == plain_best_fit(lengths, size) and max(fill) <= size
    assert all(sum(n for n, w in zip(lengths, where) if w == b) == f for b, f in enumerate(fill))
    counts = {n: lengths.count(n) for n in set(lengths)}
    new = packing.merge_counts(counts, size)
    assert sum(n for n, _ in new) == plain_best_fit(lengths, size) and all(sum(f) <= size for _, f in new)
    assert sorted(x for n, fills in new for x in fills * n) == sorted(lengths)


def rows_of(n, seed=1):
    r = random.Random(seed)
    return EDGE + [(100 + i, " ".join(r.choice(["alpha", "beta,", "gamma", "x1"]) for _ in range(r.randrange(1, 90)))) for i in range(n)]


@pytest.mark.parametrize("size,parts,fan_in", [(2048, 3, 32), (64, 9, 2), (64, 5, 3), (7, 4, 2)])
def test_packing_is_whole_and_gapless(spark, size, parts, fan_in):
    rows = rows_of(60)
    got = packing.pack(frame(spark, rows, parts), PATH, size=size, fan_in=fan_in).toPandas()
    want = []
    for (d, _), ids in zip(rows, library_ids([t for _, t in rows])):
        want += [(-1 if d is None else d, p, at, len(ids[at : at + size]), zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), size))]
    key = got.doc_id.astype("Int64").fillna(-1)
    assert sorted(zip(key, got.piece, got.start, got.length, got.ids_crc32)) == sorted(want)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= size and len(fill) <= 1.02 * plain_best_fit([x[3] for x in want], size) + 1


def test_matrices_hold_every_document_and_reset_positions(spark, tmp_path):
    rows = rows_of(40)
    out = packing.write_matrices(frame(spark, rows), PATH, str(tmp_path / "m"), size=128).collect()
    found = {}
    for r in out:
        ids, pos = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(pos) == 128 and r.cu_seqlens[0] == 0 and not ids[r.cu_seqlens[-1] :].any() and not pos[r.cu_seqlens[-1] :].any()
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            found.setdefault((d, start), []).append(ids[a:b].tolist())
    want = {}
    for (d, _), ids in zip(rows, library_ids([t for _, t in rows])):
        for at in range(0, len(ids), 128):
            want.setdefault((d, at), []).append(ids[at : at + 128])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({r.sequence_id for r in out}) == len(out)


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), PATH).count() == packing.matrices(frame(spark, []), PATH).count() == 0
