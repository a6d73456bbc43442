"""Chains of posts that an analyst finds in a cluster: prompts, answers and what they become."""
import json
import re

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from . import posts as P

#: Names under which an answer may hold its groups, their posts and their parts.
ROOTS, IDS = ("subtopics", "topics", "groups", "clusters", "sub_topics"), ("post_ids", "posts", "ids", "post_id", "items")
FIELDS = ("title", "label", "reasoning", "sentiment_arc")


def prompt_block(df, most=300, cluster="cluster_id"):
    """cluster, block: a cluster's posts in order of time, a line each, cut and without markup."""
    line = F.concat(F.lit('<post id="'), F.col("id").cast("string"), F.lit('" date="'), F.coalesce(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm"), F.lit("")), F.lit('">'), text.defuse(text.truncate_words(text.single_line(F.col("content")), most), wide=False), F.lit("</post>"))
    x = df.where(F.col(cluster).isNotNull()).select(cluster, "timestamp", "id", line.alias("line"))
    return x.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct(F.col("timestamp").isNull(), "timestamp", "id", "line"))).alias("x")).select(cluster, F.array_join(F.col("x.line"), "\n").alias("block"))


#: What stands for fields that an answer leaves out; a missing title is first sought under `label`.
DEFAULTS = {"title": "Untitled Timeline", "reasoning": "Posts grouped by semantic similarity.", "sentiment_arc": "Narrative evolution not specified."}


def claimed(ids, known):
    """The known ids that an answer's list names, each once: those that match without brackets and quotes; only if none does, for each the smallest known id that holds it or that it holds."""
    ids = [str(i).strip().strip("[]\"' ") for i in (ids if isinstance(ids, list) else [ids] if ids else [])]
    real = [i for i in ids if i in set(known)]
    if not real:
        near = [next((k for k in known if i in k or k in i), None) for i in ids if i]
        real = [k for k in near if k is not None]
    return list(dict.fromkeys(real))


def repair(answer, known):
    """Groups of an answer's JSON: [{id, title, label, reasoning, sentiment_arc, post_ids}], under whatever of the usual names, with DEFAULTS for what is not there; ids as by claimed. None if there is no JSON."""
    found = re.search(r"\{.*\}", re.sub(r"```[a-zA-Z]*", "", answer or ""), re.S)
    try:
        got = json.loads(found[0]) if found else None
    except ValueError:
        got = None
    if not isinstance(got, dict):
        return None
    groups = next((got[k] for k in ROOTS if isinstance(got.get(k), list)), [])
    known, out = sorted(map(str, known)), []
    for n, g in enumerate(g for g in groups if isinstance(g, dict)):
        g = DEFAULTS | ({"title": g["label"]} if "label" in g else {}) | g
        ids = next((g[k] for k in IDS if k in g), [])
        out.append({"id": str(g.get("id", n + 1)), **{f: str(g.get(f) or "") for f in FIELDS}, "post_ids": claimed(ids, known)})
    return out


GROUPS = "cluster_id {}, status string, group_pos int, title string, label string, reasoning string, sentiment_arc string, pos int, post string"


def extract(posts, analyst, most=300, tries=2):
    """A row per claimed post of each cluster's answer (status 'ok'), or one of status 'empty', 'small' (under two posts) or 'failed'. analyst: a prompt -> an answer."""
    kind = posts.schema["cluster_id"].dataType.simpleString()
    blocks = prompt_block(posts, most).join(posts.groupBy("cluster_id").agg(F.collect_list(F.col("id").cast("string")).alias("ids")), "cluster_id")

    def run(frames):
        for f in frames:
            rows = []
            for c, block, ids in zip(f.cluster_id, f.block, f.ids):
                none = lambda status: (c, status, None, None, None, None, None, None, None)  # noqa: B023, E731
                if len(ids) < 2:
                    rows.append(none("small"))
                    continue
                groups = None
                for _ in range(tries):
                    try:
                        groups = repair(analyst(block), ids)
                    except OSError:
                        groups = None
                    if groups is not None:
                        break
                if groups is None:
                    rows.append(none("failed"))
                elif not any(g["post_ids"] for g in groups):
                    rows.append(none("empty"))
                else:
                    rows += [(c, "ok", n, *[g[k] for k in FIELDS], p, i) for n, g in enumerate(groups) for p, i in enumerate(g["post_ids"])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in GROUPS.split(", ")]).astype({"group_pos": "Int32", "pos": "Int32"})

    return blocks.select("cluster_id", "block", "ids").mapInPandas(run, GROUPS.format(kind))


def complete(extracted):
    """Whether no cluster failed."""
    return extracted.where("status = 'failed'").isEmpty()


def remaining(posts, done, cluster="cluster_id"):
    """Posts of clusters that are not among those done."""
    return posts.join(done.select(cluster).distinct(), cluster, "left_anti")


def assemble(extracted, posts, least=2):
    """(assignments, edges, metadata) of the groups found: first claims hold, groups of `least` posts or more become chains in order of time, undated posts in their place."""
    ok = P.first_seen(extracted.where("status = 'ok'"), "group_pos", "post", "cluster_id", least)
    ok = ok.withColumn("subtopic_id", F.concat_ws("_", F.col("cluster_id").cast("string"), F.col("group_pos").cast("string")))
    x = ok.join(posts.select(F.col("id").cast("string").alias("post"), "timestamp"), "post")
    slots = P.pinned_order(x, "subtopic_id", "pos", "timestamp", "post")
    links = P.chain_links(slots, "subtopic_id", "new_slot", "post")
    a = links.join(ok.select("subtopic_id", "post", "cluster_id"), ["subtopic_id", "post"]).select(F.col("post").alias("id"), "cluster_id", F.col("role").alias("nova_role"), F.col("parent").alias("nova_parent"), F.col("depth").alias("nova_depth"), "subtopic_id")
    edges = links.where("parent is not null").select(F.col("parent").alias("source"), F.col("post").alias("target"), F.lit("nova").alias("type"), F.lit(1.0).alias("force"), F.col("role").alias("nova_role"))
    meta = ok.groupBy("subtopic_id").agg(F.first("cluster_id").alias("cluster_id"), *[F.first(f).alias(f) for f in FIELDS], F.count("*").alias("post_count"))
    return a, edges, meta


def by_month(prompt):
    """An offline analyst: posts of a month are a group, in order of time."""
    groups = {}
    for i, d in re.findall(r'<post id="([^"]*)" date="([^"]*)"', prompt):
        groups.setdefault(d[:7] or "undated", []).append(i)
    return json.dumps({"subtopics": [{"id": n + 1, "title": k, "label": k, "reasoning": "same month", "post_ids": v} for n, (k, v) in enumerate(sorted(groups.items()))]})


def name_clusters(posts, terms, labeller=None, tries=2):
    """cluster, label: the labeller's name for a cluster's keywords and representative posts if it gives a good one, else the five best keywords."""
    labels = P.keyword_labels(terms)
    if labeller is None:
        return labels
    words = terms.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), ", ").alias("words"))
    said = P.representatives(posts).join(posts.select("id", "content"), "id").groupBy(F.col("cluster_id").cast("string").alias("cluster")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: F.substring(x["content"], 1, 300)), "\n").alias("said"))

    @F.pandas_udf("string")
    def ask(words: pd.Series, said: pd.Series) -> pd.Series:
        out = []
        for w, s in zip(words, said):
            got = None
            for _ in range(tries):
                try:
                    got = labeller(f"Keywords: {w}\nPosts:\n{s}")
                except OSError:
                    continue
                if got and "topic" in got.lower():
                    break
            out.append(got)
        return pd.Series(out)

    x = words.withColumn("cluster", F.col("cluster").cast("string")).join(said, "cluster", "left")
    x = x.withColumn("said_label", text.label_of(ask("words", F.coalesce("said", F.lit("")))))
    return labels.withColumn("cluster", F.col("cluster").cast("string")).join(x.select("cluster", "said_label"), "cluster", "left").select("cluster", F.coalesce("said_label", "label").alias("label"))
