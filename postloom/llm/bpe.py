"""Byte-level BPE by a hierarchical-bitmap rank queue."""
import base64
import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .arrow import in_parts, lists, rows


class RankQueue:
    """Buckets of positions per merge rank; three levels of 64-bit words find the first non-empty bucket."""

    def __init__(self):
        self.levels, self.buckets = ({}, {}, {}), {}

    def push(self, rank, positions):
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        for level in self.levels:
            word, rank = rank >> 6, rank & 63
            had = level.get(word, 0)
            level[word] = had | 1 << rank
            if had:
                break
            rank = word

    def pop(self):
        """(lowest rank, its positions from the left), or None."""
        rank = min(self.levels[2], default=None)
        if rank is None:
            return None
        for level in reversed(self.levels):
            bits = level[rank]
            rank = rank << 6 | (bits & -bits).bit_length() - 1
        word = rank
        for level in self.levels:
            bit, word = word & 63, word >> 6
            level[word] &= ~(1 << bit)
            if level[word]:
                break
            del level[word]
        return rank, sorted(self.buckets.pop(rank))


class BytePairs:
    """Ranks as tiktoken reads them; encode_pieces gives the ids of many pre-tokens, merged through one queue."""

    def __init__(self, data):
        self.ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, data.splitlines()) if k}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.pairs = np.full((256, 256), -1, np.int64)
        for k, v in self.ranks.items():
            if len(k) == 2:
                self.pairs[k[0], k[1]] = v
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def encode_pieces(self, pieces):
        """int32 ids, as bytes, of each non-empty piece (bytes). The pieces stand in one linked list with an empty part after each, over which no pair reaches."""
        get, ends = self.ranks.get, np.cumsum([len(p) + 1 for p in pieces]) - 1
        raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
        n = len(raw)
        first = np.append(self.pairs[raw[:-1], raw[1:]], -1)
        first[ends] = first[ends - 1] = -1
        start, ids = self.single[raw], None
        start[ends] = -2
        part, token, pair = [bytes([i]) for i in range(256)], start.tolist(), first.tolist()
        part = [part[i] for i in raw.tolist()]
        for i in ends.tolist():
            part[i] = b""
        left, right, queue = list(range(-1, n - 1)), list(range(1, n + 1)), RankQueue()
        some = np.flatnonzero(first >= 0)
        some = some[np.argsort(first[some], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[some], prepend=-1)).tolist()
        order = some.tolist()
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            queue.push(pair[order[a]], order[a:b])
        buckets, push = queue.buckets, queue.push
        while found := queue.pop():
            rank, positions = found
            for at, i in enumerate(positions):
                if pair[i] != rank:
                    continue  # stale
                j = right[i]
                right[i] = k = right[j]
                left[k] = i
                part[i] = mine = part[i] + part[j]
                token[i], token[j], pair[j] = rank, -1, -1
                pair[i], least = -1, rank
                if other := part[k]:
                    r = get(mine + other)
                    if r is not None:
                        pair[i] = least = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            push(r, [i])
                h = left[i]
                if h >= 0 and (other := part[h]):
                    pair[h] = -1
                    r = get(other + mine)
                    if r is not None:
                        pair[h] = r
                        least = r if r < least else least
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            push(r, [h])
                if least < rank and at + 1 < len(positions):
                    push(rank, positions[at + 1 :])
                    break
        token = np.array(token, np.int32)
        ids = token[token >= 0].tobytes()
        to = (4 * np.cumsum(token >= 0)[ends]).tolist()
        return [ids[a:b] for a, b in zip([0, *to], to)]


class Encoder:
    """Texts -> int32 arrays. Text is cut before single spaces between non-spaces, which no match crosses; units and pieces are cached up to a limit."""

    def __init__(self, data, pattern, limit=700_000):
        self.bpe, self.find, self.limit, self.units, self.pieces = BytePairs(data), regex.compile(pattern).findall, limit, {}, {}
        self.cut, self.odd = regex.compile(r"(?<=\S)(?= \S)").split, re.compile(r"\s\s|^\s|\s$|[^\S \n]").search

    def learn(self, wanted):
        """Put the units of a set into the cache."""
        found = {u: self.find(u) for u in wanted}
        new = {p for ps in found.values() for p in ps}.difference(self.pieces)
        if len(self.pieces) + len(new) > self.limit:
            self.pieces.clear()
            new = {p for ps in found.values() for p in ps}
        ranks, rest, pieces = self.bpe.ranks, [], self.pieces
        for p in new:
            whole = ranks.get(p.encode())
            if whole is None:
                rest.append(p)
            else:
                pieces[p] = np.int32(whole).tobytes()
        for at in range(0, len(rest), 800):  # so many share a queue: more would leave the processor's cache
            part = rest[at : at + 800]
            pieces.update(zip(part, self.bpe.encode_pieces([p.encode() for p in part])))
        self.units.update((u, b"".join([pieces[p] for p in ps])) for u, ps in found.items())

    def __call__(self, texts):
        cuts = []
        for text in texts:
            if not text:
                cuts.append(())
            elif self.odd(text):
                cuts.append(self.cut(text))
            else:
                words = text.split(" ")
                cuts.append([words[0], *[" " + w for w in words[1:]]])
        every = set().union(*cuts)
        wanted = every.difference(self.units)
        if len(self.units) + len(wanted) > self.limit:
            self.units.clear()
            wanted = every
        self.learn(wanted)
        out = [np.frombuffer(b"".join(map(self.units.__getitem__, c)), np.int32) for c in cuts]
        for u in wanted:
            if len(u) >= 100:
                del self.units[u]
        if any(len(u) >= 100 for u in wanted):
            for p in [p for p in self.pieces if len(p) >= 100]:
                del self.pieces[p]
        return out


_encoders = {}


def encoder(data, pattern):
    """This worker's encoder for a vocabulary and pattern: its caches serve all tasks of the worker."""
    key = hash(data), pattern
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data, pattern)
    return _encoders[key]


def encode(df, vocabulary, pattern, id_col="doc_id", text_col="text"):
    """id, ids array<int>: null text as empty text, one row per row of df; extra columns are not carried."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    data = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches):
        gc.disable()  # nothing here makes cycles, and the caches are slow to walk
        to_ids = encoder(data.value, pattern)
        for b in in_parts(batches):
            yield rows(schema, [b.column(0), lists(to_ids(b.column(1).to_pylist()), np.int32)])

    return df.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(df, vocabulary):
    """Adds decoded (binary) to (doc_id, ids); null or empty ids give empty bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    data = df.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches):
        known = BytePairs(data.value).bytes
        table = pa.array([known.get(i) for i in range(max(known) + 1)], pa.large_binary())
        for b in in_parts(batches):
            ids = b.column(1)
            lengths = np.diff(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).cumsum(), prepend=0) if len(ids) else np.empty(0, np.int64)
            flat = table.take(pc.list_flatten(ids))
            if flat.null_count:
                raise ValueError("an id that the vocabulary lacks")
            at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            whole = flat.buffers()[2].to_pybytes() if len(flat) else b""
            ends = at[np.cumsum(lengths)].tolist() if len(ids) else []
            yield rows(schema, [b.column(0), ids, [whole[x:y] for x, y in zip([0, *ends], ends)]])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
