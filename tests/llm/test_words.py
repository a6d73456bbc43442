import random
import sys

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postloom.llm import words

PATH = P.path("word_bpe_49k.json")
WHITE = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and chr(i).isspace() and i not in (0x1C, 0x1D, 0x1E, 0x1F)]


def texts():
    r = random.Random(5)
    odd = ["a", "B", "\xe9", "e\u0301", "\u0130", "\xdf", "'s", "'LL", "n't", "1", "23", "!", "...", "漢字", "<|endoftext|>", "<|startoftext", "\x1c", "\x1f", "\u200b", "\ufeff", "\u180e", "\0", "\U0001f600", "</w>", *WHITE, " ", " "]
    made = ["".join(r.choice(odd) for _ in range(r.randrange(40))) for _ in range(300)]
    return [None, "", "   ", "one", "one", " lead and trail ", "Word " * 5000, "x" * 3000, *made, *[f"a{w}b" for w in WHITE]]


@pytest.mark.parametrize("size,parts", [(50, 3), (1_500_000, 1)])
def test_equals_the_library(spark, size, parts, monkeypatch):
    given = texts()
    monkeypatch.setattr(words.blocks, "__defaults__", (size, "doc_id", "text"))
    df = spark.createDataFrame([(i if i % 7 else None, t, "clash", 1) for i, t in enumerate(given)], "doc_id long, text string, ids string, block int").repartition(parts)
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in enumerate(given):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i if i % 7 else -1, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in words.decode(words.encode(df, PATH), PATH).collect()]
    assert sorted(got) == sorted(want)


def test_each_distinct_word_is_encoded_once(spark):
    df = spark.createDataFrame([(i, f"shared word{i % 10} words") for i in range(200)], "doc_id long, text string").repartition(4)
    found = words.blocks(df, 8, words=30)
    sheets = found.select("block", F.explode("sheets").alias("s")).select("block", "s.*")
    homes, blocks = {}, set()
    for r in sheets.repartition(3, "bucket").select(F.spark_partition_id().alias("p"), "*").collect():
        blocks.add(r.block)
        for w in words.unpacked_bytes(r.words).decode().split(" "):
            homes.setdefault(w, set()).add((r.p, r.bucket))
    assert len(blocks) > 10 and len(homes) == 12 and all(len(h) == 1 for h in homes.values())


def test_empty_tables_and_unknown_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert words.decode(words.encode(empty, PATH), PATH).count() == 0
    given = spark.createDataFrame([(1, [320, 99_999_999, 320]), (1, []), (None, None), (2, [None, 320])], "doc_id long, ids array<int>")
    t = Tokenizer.from_file(PATH)
    got = {(r.doc_id, r.n_tokens): r.decoded for r in words.decode(given, PATH).collect()}
    assert got == {(1, 3): t.decode([320, 320], skip_special_tokens=False), (1, 0): "", (None, 0): "", (2, 1): t.decode([320], skip_special_tokens=False)}


def test_decodes_in_blocks(spark):
    r = random.Random(2)
    given = [(i, [r.randrange(49_000) for _ in range(r.randrange(60))]) for i in range(300)]
    t = Tokenizer.from_file(PATH)
    coded = words.packed(spark.createDataFrame(given, "doc_id long, ids array<int>").repartition(2), most=500)
    assert coded.where("pos = -1").count() > 10
    got = {x.doc_id: x.decoded for x in words.decode(spark.createDataFrame(given, "doc_id long, ids array<int>").repartition(2), PATH).collect()}
    assert got == {i: t.decode(ids, skip_special_tokens=False) for i, ids in given}


def test_large_vocabularies_are_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"some words {i} of text") for i in range(50)], "doc_id long, text string")
    coded = words.encode(df, PATH)
    near = sorted((r.doc_id, r.decoded) for r in words.decode(coded, PATH).collect())
    monkeypatch.setattr(words, "BROADCAST", 10)
    assert sorted((r.doc_id, r.decoded) for r in words.decode(coded, PATH).collect()) == near


def test_blocks_are_not_sent_again_and_a_task_has_two_workers(spark):
    """Before, all blocks were shuffled to meet their ids, and ids became rows between two workers."""
    df = spark.createDataFrame([(i, f"some words {i} of text") for i in range(50)], "doc_id long, text string").repartition(3)
    joined = words.encoded_blocks(df, PATH)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and "Exchange hashpartitioning(bucket" in plan
    out = words.round_trip(df, PATH)
    final = out._jdf.queryExecution().executedPlan().toString()
    assert final.count("MapInArrow") == 3  # of sheets, blocks and texts
    want = sorted(map(tuple, words.decode(words.encode(df, PATH), PATH).collect()))
    assert sorted(map(tuple, out.collect())) == want and len(want) == 50
