"""Distinct-word table: words split by Spark, each distinct word encoded once, ids joined back by position; decoding by an id-to-piece join."""
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialise_by
from .arrow import rows, settings, word_hashes
from .packing import WordEncoder

#: ASCII white space, at which the tokenizer always ends a word; other white space is left within a unit, to the library.
WHITE = r"[\t-\r ]+"
BLOCKS = "block long, doc_ids array<long>, ends array<long>, places binary, buckets binary, sheets array<struct<bucket: int, words: binary>>"
#: Sheets of a bucket whose words are Python strings at once.
SHEETS = 64
#: Pieces that may be broadcast; a tokenizer with more is joined by a shuffle.
BROADCAST = 1_000_000


def packed_bytes(data):
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked_bytes(data):
    return zstandard.ZstdDecompressor().decompress(data)


def planes(numbers):
    """uint32 as bytes: all first bytes, then all second ones and so on, compressed, as most numbers are small."""
    out = np.empty((4, len(numbers)), np.uint8)
    for k in range(4):
        out[k] = numbers >> 8 * k & 255
    return packed_bytes(out.data if out.size else b"")


def unplanes(data):
    flat = np.frombuffer(unpacked_bytes(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view("<u4").ravel()


def blocks(df, buckets, words=1_500_000, id_col="doc_id", text_col="text"):
    """Whole documents in blocks of about `words` words. places: each word's place in the block's list of distinct words; buckets: of each distinct word; sheets: the distinct words of each bucket, with a blank between, compressed."""
    names = [x.split(" ")[0].rstrip(":") for x in BLOCKS.split(", ")[:5]] + ["sheets"]
    sheet = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), sheet]

    def block(number, ids, counts, parts):
        found = pa.concat_arrays(parts).dictionary_encode()
        n, places = len(found.dictionary), found.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(-np.bincount(places, minlength=n), kind="stable")
        rank = np.empty(n, np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)  # the commonest words have the smallest numbers, which take fewer bytes
        known, places = found.dictionary.take(pa.array(order)), rank[places]
        if n:
            one = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), known), " ")
            at = (word_hashes(np.frombuffer(one.buffers()[2], np.uint8), 1 << 19)[0] % np.uint64(buckets)).astype(np.int32)
        else:
            at = np.empty(0, np.int32)
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        ends = np.append(first, n).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), known.take(pa.array(order))), " ")
        texts = pa.array([packed_bytes(t.encode()) for t in texts.to_pylist()], pa.binary())
        sheets = pa.StructArray.from_arrays([pa.array(used, pa.int32()), texts], names=["bucket", "words"])
        held = [pa.array([number]), pa.array([ids], kinds[1]), pa.array([np.cumsum(counts)], kinds[2]), pa.array([planes(places)], pa.binary()), pa.array([planes(at)], pa.binary())]
        return pa.RecordBatch.from_arrays([*held, pa.ListArray.from_arrays(pa.array([0, len(sheets)], pa.int32()), sheets)], names=names)

    def run(batches):
        from pyspark import TaskContext

        number, ids, counts, parts, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for b in batches:
            lo = 0
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(size)
            while lo < b.num_rows:
                room = words - held + (upto[lo - 1] if lo else 0)
                hi = max(lo + 1, int(np.searchsorted(upto, room, "right")))
                flat = b.column(1).slice(lo, hi - lo).flatten()
                keep = pc.greater(pc.binary_length(flat), 0)  # white space before the first word or after the last gives an empty one
                held_back = np.append(0, np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64))
                counts += np.diff(held_back[np.append(0, np.cumsum(size[lo:hi]))]).tolist()
                parts.append(flat if pc.all(keep).as_py() else flat.filter(keep))
                ids += b.column(0).slice(lo, hi - lo).to_pylist()
                held += len(parts[-1])
                lo = hi
                if held >= words or hi < b.num_rows:
                    out = block(number, ids, counts, parts)
                    number, ids, counts, parts, held = number + 1, [], [], [], 0
                    yield out
                    pa.default_memory_pool().release_unused()
        if ids:
            yield block(number, ids, counts, parts)

    split = df.select(F.col(id_col).cast("long").alias("doc_id"), F.split(F.col(text_col).cast("string"), WHITE).alias("words"))
    return split.mapInArrow(run, BLOCKS)


def encode_sheets(sheets, tokenizer):
    """block, bucket, lengths, ids of (block, bucket, words): all sheets of a bucket meet in one task, bucket after bucket, so each distinct word of the corpus is encoded once, and a task's table holds the words of one bucket."""
    kind = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        gc.disable()
        try:
            encode, last = WordEncoder(tokenizer), None
            table = encode.cache
            for b in batches:
                bucket = b.column(1).to_pylist()
                cuts = [i for i in range(len(bucket)) if i == 0 or bucket[i] != bucket[i - 1]] + [len(bucket)]
                lengths, ids = [], []
                for lo, hi in zip(cuts, cuts[1:]):
                    if bucket[lo] != last:
                        table.clear()
                        last = bucket[lo]
                    for at in range(lo, hi, SHEETS):
                        texts = [unpacked_bytes(t).decode().split(" ") for t in b.column(2).slice(at, min(SHEETS, hi - at)).to_pylist()]
                        encode.learn(list(set().union(*texts).difference(table)))
                        for words in texts:
                            parts = list(map(table.__getitem__, words))
                            lengths.append(planes(np.fromiter(map(len, parts), np.int64, len(parts)) // 4))
                            ids.append(planes(np.frombuffer(b"".join(parts), "<u4")))
                yield rows(kind, [b.column(0), b.column(1), lengths, ids])
        finally:  # the worker goes on to other tasks
            gc.enable()

    return sheets.mapInArrow(run, "block long, bucket int, lengths binary, ids binary")


def gathered(data, start, length):
    """The stretches of an array that begin at `start` and hold `length` entries, one after the other."""
    ends = np.cumsum(length)
    return data[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def assemble(batches):
    """Batches of doc_id, ids from those of blocks joined with their encoded sheets, about 250,000 words at once."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    for b in batches:
        for i in range(b.num_rows):
            doc_ids, ends, places, buckets, sheets = (c[i].as_py() for c in b.columns)
            at = unplanes(buckets)
            sheets = sorted(sheets or [], key=lambda s: s["bucket"])
            data = np.concatenate([np.empty(0, "<u4"), *[unplanes(s["ids"]) for s in sheets]]).astype(np.int32)
            length, start = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            by_sheet = np.concatenate([np.empty(0, "<u4"), *[unplanes(s["lengths"]) for s in sheets]]).astype(np.int64)
            order = np.argsort(at, kind="stable")
            length[order], start[order] = by_sheet, np.cumsum(by_sheet) - by_sheet
            places, ends = unplanes(places), np.array([0, *ends], np.int64)
            lo = 0
            while lo < len(doc_ids):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 250_000, "right")) - 1)
                mine = places[ends[lo] : ends[hi]]
                flat = gathered(data, start[mine], length[mine])
                cuts = np.append(0, np.cumsum(length[mine]))[ends[lo : hi + 1] - ends[lo]].astype(np.int32)
                yield rows(kind, [pa.array(doc_ids[lo:hi], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))])
                lo = hi


def encoded_blocks(df, tokenizer, id_col="doc_id", text_col="text"):
    """Blocks joined with their encoded sheets, for assemble. Blocks are stored in files by their number, so that only the sheets' ids are sent to them."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.compression.codec": "uncompressed"}):  # a list of words takes more room than its text
        found = materialise_by(blocks(df, 4 * parts, id_col=id_col, text_col=text_col), "blocks", "block", parts)
    sheets = found.select("block", F.explode("sheets").alias("s")).select("block", "s.*")
    sheets = sheets.repartition("bucket").sortWithinPartitions("bucket")
    of = encode_sheets(sheets, tokenizer).repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "lengths", "ids")).alias("encoded"))
    return found.drop("sheets").join(of, "block", "left").select("doc_ids", "ends", "places", "buckets", "encoded")


def encode(df, tokenizer, id_col="doc_id", text_col="text"):
    """doc_id, ids array<int>: what the tokenizers library gives for each whole text, no special tokens added. For tokenizers that end a word at any white space.

    One row per row of df, equal or null ids included; null text is empty text, which has no ids; extra columns are not carried; an empty table gives no rows. The order of rows is not kept.

    What crosses the network is each block's distinct words and their ids, not the texts; a word that all documents share is sent once a block.
    """
    return encoded_blocks(df, tokenizer, id_col, text_col).mapInArrow(assemble, "doc_id long, ids array<int>")


def pieces_of(spark, tokenizer):
    """id, piece of the tokenizer's vocabulary, added tokens included."""
    vocab = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, t) for t, i in vocab.items()], "id int, piece string"), len(vocab)


PACKED = "block long, pos int, id int, doc_ids array<long>, lengths array<int>, ids binary"


def packer(most=250_000):
    """From batches of doc_id, ids to those of packed."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    schema = pa.schema([(x.split(" ")[0], k) for x, k in zip(PACKED.split(", "), kinds)])

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            length = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, lo = np.cumsum(length), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
                flat, n = b.column(1).slice(lo, hi - lo).flatten(), length[lo:hi]
                if flat.null_count:
                    real = flat.is_valid().to_numpy(zero_copy_only=False)
                    n = np.bincount(np.repeat(np.arange(hi - lo), n)[real], minlength=hi - lo)
                    flat = flat.drop_null()
                held = [pa.array([block], kinds[0]), pa.array([-1], kinds[1]), pa.nulls(1, kinds[2])]
                held += [pa.array([b.column(0).slice(lo, hi - lo).to_pylist()], kinds[3]), pa.array([n], kinds[4])]
                yield pa.RecordBatch.from_arrays([*held, pa.array([flat.to_numpy().astype("<i4").tobytes()], kinds[5])], schema=schema)
                known = pc.unique(flat)
                held = [pa.array(np.full(len(known), block)), pa.array(np.arange(len(known)), kinds[1]), known]
                yield pa.RecordBatch.from_arrays([*held, *[pa.nulls(len(known), k) for k in kinds[3:]]], schema=schema)
                block, lo = block + 1, hi

    return run


def packed(df, most=250_000):
    """Rows of (doc_id, ids array<int>) about 250,000 ids at once: a row at pos -1 with their documents and ids, then a row for each distinct id, in the order of their first places. Null ids count as absent."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(packer(most), PACKED)


def round_trip(df, tokenizer, id_col="doc_id", text_col="text"):
    """As decode(encode(df)), with ids assembled and packed in one step: a task has one Python worker less, and ids don't become rows between."""
    pack = packer()
    return decode_packed(encoded_blocks(df, tokenizer, id_col, text_col).mapInArrow(lambda batches: pack(assemble(batches)), PACKED), tokenizer)


def decode(df, tokenizer):
    """doc_id, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded: the pieces of (doc_id, ids array<int>) with a blank between, as the library joins them where the tokenizer has no decoder. Ids that the vocabulary lacks give no piece; null or empty ids give empty text.

    The distinct ids of about 250,000 at once are joined with the vocabulary, which is broadcast, so that they stay in order and no shuffle is needed. A vocabulary of over a million pieces is joined by a shuffle, and the rows sorted again.
    """
    return decode_packed(packed(df), tokenizer)


def decode_packed(coded, tokenizer):
    """What decode gives, of packed rows."""
    pieces, n = pieces_of(coded.sparkSession, tokenizer)
    kind = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    if n <= BROADCAST:
        joined = coded.join(F.broadcast(pieces), "id", "left")
    else:
        joined = coded.join(pieces, "id", "left").repartition("block").sortWithinPartitions("block", "pos")

    def texts(doc_ids, lengths, ids, found):
        flat = np.frombuffer(ids, "<i4")
        length = lengths.to_numpy().astype(np.int64)
        text = pa.concat_arrays(found).take(pa.array(flat).dictionary_encode().indices) if len(flat) else pa.array([], pa.string())
        held = length
        if text.null_count:
            row = np.repeat(np.arange(len(length)), length)
            held = np.bincount(row[text.is_valid().to_numpy(zero_copy_only=False)], minlength=len(length))
            text = text.drop_null()
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)).astype(np.int32)), text), " ")
        to = (4 * np.cumsum(length)).tolist()
        return rows(kind, [doc_ids, pa.array(length), [ids[a:z] for a, z in zip([0, *to], to)], text])

    def run(batches):
        head, found = None, []
        for b in batches:
            heads = np.flatnonzero(b.column(0).to_numpy() < 0)
            cuts = [0, *heads.tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi and b.column(0)[lo].as_py() < 0:
                    if head:
                        yield texts(*head, found)
                    head = b.column(1)[lo].values, b.column(2)[lo].values, b.column(3)[lo].as_py()
                    found, lo = [], lo + 1
                found.append(b.column(4).slice(lo, hi - lo))
        if head:
            yield texts(*head, found)

    return joined.select("pos", "doc_ids", "lengths", "ids", "piece").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
