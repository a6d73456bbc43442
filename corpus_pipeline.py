"""documents -> quality -> toxicity -> near-duplicate removal -> packed sequences; each stage's rows are written and read by the next."""
import public_tokenizers as P

from postloom.llm import jaccard, packing, quality, toxicity
from postloom.session import clear, exists, materialise, table


def keep_quality(spark, docs, sf_dir):
    """Documents the resampler keeps; without labels, all of them."""
    return quality.resample(docs, table(spark, sf_dir, "labels"), carry=True).where("keep").select("row.*")


def keep_clean(spark, docs, sf_dir):
    """Documents the chain doesn't call toxic; without labels of both kinds, all of them."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.chain_probabilities(docs, model, carry=True).where("not toxic").select("row.*")


def keep_one(spark, docs, sf_dir):
    """One document of each near-duplicate group, that of smallest id; decided by row, so a text of its own stays even under a repeated id. Documents without words stay."""
    return jaccard.keep_first(docs)


def pack(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, P.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality", keep_quality), ("toxicity", keep_clean), ("jaccard", keep_one), ("packing", pack)]
ORACLE_SQL = None


def run(spark, sf_dir, folder=None):
    """The last stage's rows. With a folder, each stage's table stays there under its name, and a run that was broken off goes on after the last whole one; working tables go after each stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}" if folder else None
        if path and exists(spark, f"{path}/_SUCCESS"):
            docs = spark.read.parquet(path)
            continue
        docs = materialise(stage(spark, docs, sf_dir), name, path)
        if path:
            clear(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
