"""Best-fit packing of token ids into sequences of bounded length."""
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from ..session import materialise
from .arrow import CACHE, by_bytes


class Capacities:
    """Segment tree over remaining capacities 0..size: finds the fullest bin that still holds an item."""

    def __init__(self, size):
        self.base = 1 << size.bit_length()
        self.count, self.bins = [0] * (2 * self.base), {}

    def _add(self, at, by):
        at += self.base
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room, bin_):
        self.bins.setdefault(room, []).append(bin_)
        self._add(room, 1)

    def take(self, least):
        """(room, bin) of the smallest room >= least, or None."""
        at = least + self.base
        while not self.count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.base:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.base
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit(lengths, size):
    """Best-fit decreasing: (bin of each item, offset in it, fill of each bin)."""
    tree, where, offset, fill = Capacities(size), [0] * len(lengths), [0] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        found = tree.take(n)
        room, b = found if found else (size, len(fill))
        if not found:
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            tree.put(room - n, b)
    return where, offset, fill


def words_of(text):
    """Runs of characters that are not Unicode white space; str.split alone would also cut at the four separators U+001C to U+001F."""
    return text.split() if not separators(text) else not_white(text)


separators, not_white = re.compile("[\x1c-\x1f]").search, regex.compile(r"[^\p{White_Space}]+").findall


#: ASCII marks but the apostrophe, which may begin a word's part.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Texts -> uint32 ids as bytes, then id `end`, as the library gives them without special tokens added.

    White space always separates this tokenizer's words, so each word is encoded once, new ones together, and cached. Texts that hold an added token, which may lie within a word, go to the library whole.
    """

    def __init__(self, path, end=0, limit=CACHE):
        self.tokenizer, self.cache, self.limit = Tokenizer.from_file(path), {}, limit
        self.last = np.array([end], "<u4").tobytes()
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda t: None
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def learn(self, words, together=100):
        """Put words into the cache. A word of letters, with or without marks at its end, has one or two parts, each closed by a token that says so; others are told apart by the place of each token's first character.

        ASCII letters and marks need no normalising and are their own bytes, so such words go through a tokenizer that only splits at spaces.
        """
        plain, simple, other = ([], [], []), ([], [], []), []
        for w in words:
            core = w.rstrip(MARKS)
            if not core.isalpha():
                other.append(w)
            elif w.isascii():
                plain[0].append(w)
                plain[1].append(w.lower() if core is w else f"{core.lower()} {w[len(core):]}")
                plain[2].append(1 if core is w else 2)
            elif "İ" in core:
                other.append(w)
            else:
                simple[0].append(w)
                simple[1].append(w)
                simple[2].append(1 if core is w else 2)
        for tokenizer, (names, texts, parts) in ((self.bare, plain), (self.tokenizer, simple)):
            for at in range(0, len(names), together):
                part = names[at : at + together]
                x = np.array(tokenizer.encode_batch_fast([" ".join(texts[at : at + together])], add_special_tokens=False)[0].ids, "<u4")
                ends, upto = np.flatnonzero(self.closes[x]) + 1, np.cumsum(parts[at : at + together])
                if len(ends) != upto[-1] or ends[-1] != len(x):
                    other += part
                    continue
                ids, to = x.tobytes(), (4 * ends[upto - 1]).tolist()
                self.cache.update(zip(part, map(ids.__getitem__, map(slice, [0, *to], to))))
        for at in range(0, len(other), together):
            part = other[at : at + together]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            starts = np.array([o[0] for o in e.offsets], np.int64)
            ends = np.cumsum([len(w) + 1 for w in part])
            to = (4 * np.searchsorted(starts, ends)).tolist()
            self.cache.update(zip(part, [ids[x:y] for x, y in zip([0, *to], to)]))

    def __call__(self, texts):
        special = {i: t for i, t in enumerate(texts) if t and "<|" in t and self.special(t)}
        words = [words_of(t or "") if i not in special else () for i, t in enumerate(texts)]
        every = set().union(*words)
        new = every.difference(self.cache)
        if len(self.cache) + len(new) > self.limit:
            self.cache = {w: self.cache[w] for w in every if w in self.cache}  # what is met again and again stays
        self.learn(list(new))
        get = self.cache.__getitem__
        out = [b"".join(map(get, w)) + self.last for w in words]
        for i, t in special.items():
            out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + self.last
        for w in [w for w in new if len(w) >= 100]:
            del self.cache[w]
        return out


_encoders = {}


def word_encoder(path):
    """This worker's encoder of a tokenizer file: its cache serves all tasks of the worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(batches, tokenizer, size, at_once=1 << 24):
    """Lists of (row's id, piece, start, ids) of whole documents cut into pieces of `size`; a list ends with the document that brings it to `at_once` bytes of ids."""
    encode, out, held = word_encoder(tokenizer), [], 0
    for b in by_bytes(batches, 1):
        for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
            out += [(doc, p, at // 4, ids[at : at + 4 * size]) for p, at in enumerate(range(0, len(ids), 4 * size))]
            held += len(ids)
            if held >= at_once:
                yield out
                out, held = [], 0
    if out:
        yield out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, offset long, fill int, g int, nth long"


def pieces(df, tokenizer, size=2048, keep_ids=False, id_col="doc_id", text_col="text"):
    """Each document's ids cut into pieces of `size`, packed best-fit among the next ones of its partition. Null text is empty text: one piece holding id 0.

    bin numbers the bins: partition, then place. nth numbers the bins of equal fill in a partition g.
    """

    def run(batches):
        from pyspark import TaskContext

        part, bins, nth = TaskContext.get().partitionId(), 0, Counter()
        for out in cut(batches, tokenizer, size, 1 << (23 if keep_ids else 26)):
            lengths = [len(x[3]) // 4 for x in out]
            where, offset, fill = best_fit(lengths, size)
            order = []
            for f in fill:
                order.append(nth[f])
                nth[f] += 1
            fill, order, where = np.array(fill, np.int32), np.array(order, np.int64), np.array(where)
            doc, piece, start, ids = zip(*out)
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(ids if keep_ids else [None] * len(ids), pa.binary())]
            cols += [pa.array(where + ((part << 32) + bins)), pa.array(offset, pa.int64()), pa.array(fill[where]), pa.array(np.full(len(where), part, np.int32)), pa.array(order[where])]
            bins += len(fill)
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PIECES.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def merge_counts(counts, size):
    """Best-fit decreasing of bins as items, equal ones together: [(number of new bins, [fill of each old one])] from {fill: number}.

    An item goes to the bin of least room that holds it, and so do the next of its size until that bin has no room for one more; so all bins of a room are dealt with at once.
    """
    rooms, by_room = [], {}  # rooms ascending; room -> [[number, fills]]

    def put(room, number, fills):
        if number:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append([number, fills])

    for f in sorted(counts, reverse=True):
        left = counts[f]
        while left:
            at = bisect_left(rooms, f)
            room = rooms[at] if at < len(rooms) else size
            q = room // f  # items that one of these bins takes
            if at < len(rooms):
                number, fills = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                number, fills = -(-left // q), []
            full = min(number, left // q)
            put(room - q * f, full, fills + [f] * q)
            left -= full * q
            some = min(left, q) if full < number else 0  # one bin takes the rest of the items
            put(room - some * f, int(some > 0), fills + [f] * some)
            left -= some
            put(room, number - full - int(some > 0), fills)
    return [(n, fills) for room in rooms for n, fills in by_room[room] if fills]


MOVES = "g int, fill int, lo long, hi long, to_g int, total int, nth long, bin long, shift int, counts array<long>"


def pack(df, tokenizer, size=2048, fan_in=32, **kw):
    """Hierarchical residual packing: local best fit, then underfull bins are merged as items up a tree of groups of fan_in.

    A merge works on the numbers of bins of each fill, `size` of them at most, so its input is bounded and none is left out; which bin goes where follows from its number among those of its fill.
    Every piece comes back once, with sequence_id and offset. An empty table gives no rows; equal or null ids are separate documents; extra columns are not carried.
    """
    found = materialise(pieces(df, tokenizer, size, **kw), "pieces")
    opened = found.where(f"offset = 0 and fill < {size}").select("bin", "g", "fill", "nth")
    groups = (found.agg(F.max("g")).first()[0] or 0) + 1
    level = opened.groupBy("g", "fill").agg(F.count("*").alias("n")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("fill", "n"))).alias("of"))
    level = level.select("g", F.transform(F.sequence(F.lit(0), F.lit(size)), lambda f: F.coalesce(F.element_at("of", f), F.lit(0))).alias("counts"))
    cur = opened.withColumn("sequence", F.col("bin")).withColumn("by", F.lit(0)).withColumn("first_bin", F.col("bin")).drop("bin")
    depth = 0
    while depth == 0 or groups > 1:
        depth += 1
        groups, level_of = -(-groups // fan_in), depth

        def merge(pdf):
            pdf = pdf.sort_values("g")
            g, counts = pdf.g.tolist(), np.array(pdf.counts.tolist(), np.int64)
            to, out, bins = g[0] // fan_in, [], 0
            total, taken = counts.sum(0), np.zeros(size + 1, np.int64)
            ends = counts.cumsum(0)  # bins of a fill are numbered through the groups
            new = np.zeros(size + 1, np.int64)
            for number, fills in merge_counts({int(f): int(total[f]) for f in np.flatnonzero(total)}, size):
                t, shift = sum(fills), 0
                for f in fills:
                    a, b = int(taken[f]), int(taken[f]) + number
                    taken[f] = b
                    for i in range(int(np.searchsorted(ends[:, f], a, "right")), len(g)):
                        base = int(ends[i, f] - counts[i, f])
                        lo, hi = max(a, base), min(b, int(ends[i, f]))
                        if lo >= b:
                            break
                        if lo < hi:
                            out.append((g[i], f, lo - base, hi - base, to, t, int(new[t]) + lo - a, (level_of << 58) + (to << 32) + bins + lo - a, shift, None))
                    shift += f
                new[t] += number
                bins += number
            new[size] = 0
            out.append((None, None, None, None, to, None, None, None, None, new.tolist()))
            kinds = [kind.split(" ") for kind in MOVES.split(", ")]
            return pd.DataFrame({name: pd.array(column, {"int": "Int32", "long": "Int64"}.get(kind, object)) for (name, kind), column in zip(kinds, zip(*out))})

        step = materialise(level.groupBy(F.expr(f"g div {fan_in}")).applyInPandas(merge, MOVES), f"merge{depth}")
        m = step.where("g is not null").selectExpr("g as mg", "fill as mfill", "lo", "hi", "to_g", "total", "nth as mnth", "bin as mbin", "shift")
        cur = cur.join(m, F.expr("g = mg and fill = mfill and nth >= lo and nth < hi"), "left")
        cur = cur.selectExpr("first_bin", "coalesce(to_g, g) g", "coalesce(total, fill) fill", "if(mg is null, nth, mnth + nth - lo) nth", "if(mg is null, sequence, mbin + nth - lo) sequence", "`by` + coalesce(shift, 0) `by`")
        level = step.where("counts is not null").selectExpr("to_g g", "counts")
    found = found.join(cur.select("first_bin", "sequence", "by"), found.bin == F.col("first_bin"), "left")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))


MATRIX = "sequence_id long, doc_ids array<long>, starts array<long>, ids binary, cu_seqlens array<int>, position_ids binary"


def matrices(df, tokenizer, size=2048, id_col="doc_id", text_col="text"):
    """A row per sequence: ids and position_ids (`size` little-endian uint32 each, zeros after the last token; positions start anew with each piece), cumulative piece lengths from 0, and each piece's document and place in it.

    Best-fit decreasing by segment tree among the next documents of a partition, about 2 million tokens at once; no shuffle. Each document's pieces, put together by start, are its ids and id 0.
    Null text is empty text (id 0 alone), an empty table gives no rows, equal or null ids are separate documents, and extra columns are not carried.
    """

    def run(batches):
        from pyspark import TaskContext

        number, count = TaskContext.get().partitionId() << 32, np.arange(size, dtype="<u4")
        for out in cut(batches, tokenizer, size, 1 << 23):
            where, _, fill = best_fit([len(x[3]) // 4 for x in out], size)
            of = [[] for _ in fill]
            for i in sorted(range(len(out)), key=lambda i: -len(out[i][3])):
                of[where[i]].append(i)
            rows = []
            for held in of:
                ends = [0]
                for i in held:
                    ends.append(ends[-1] + len(out[i][3]) // 4)
                ids = b"".join([out[i][3] for i in held]).ljust(4 * size, b"\0")
                at = b"".join([count[: b - a].tobytes() for a, b in zip(ends, ends[1:])]).ljust(4 * size, b"\0")
                rows.append((number, [out[i][0] for i in held], [out[i][2] for i in held], ids, ends, at))
                number += 1
            fields = [("sequence_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary())]
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[lo : lo + 256]), fields)], names=[n for n, _ in fields])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MATRIX)


def write_matrices(df, tokenizer, path, **kw):
    """Write the matrices as Parquet, which any of Spark's stores takes, and return the written table."""
    matrices(df, tokenizer, **kw).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
