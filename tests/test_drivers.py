import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from postloom.operators import chains, drivers


def corpus(spark, clusters=5, each=6):
    rows = []
    for c in range(clusters):
        for i in range(each if c else 1):
            v = [0.0] * 8
            v[c], v[7] = 1.0, 0.1 * i
            rows.append((100 * c + i, c, f"post {i} <of> cluster {c}", f"2024-0{1 + i % 2}-0{1 + i}", v))
    rows.append((9_999, None, "nowhere", None, None))
    df = spark.createDataFrame(rows, "id long, cluster_id long, content string, timestamp string, embedding array<double>")
    return df.withColumn("timestamp", F.to_timestamp("timestamp"))


def asking(folder, answer):
    """An analyst that leaves a file for each time it is asked."""

    def ask(prompt):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(re.search(r"cluster (\d+)", prompt)[1])
        return answer(prompt)

    return ask


def asked(folder):
    return sorted(int(p.read_text()) for p in folder.iterdir())


def test_a_run_that_was_killed_asks_only_the_rest(spark, tmp_path):
    posts, path = corpus(spark), str(tmp_path / "kept")
    (tmp_path / "said").mkdir()
    analyst, waves = asking(tmp_path / "said", chains.by_month), []

    def killed(p):
        waves.append(1)
        if len(waves) > 2:
            raise KeyboardInterrupt
        return chains.extract(p, analyst)

    with pytest.raises(KeyboardInterrupt):
        drivers.by_cluster(posts, path, killed, wave=2)
    assert asked(tmp_path / "said") == [1, 2, 3]  # cluster 0 is too small to be asked about
    a, edges, meta = drivers.find_chains(posts, path, analyst, wave=2)
    assert asked(tmp_path / "said") == [1, 2, 3, 4]
    assert meta.count() == 8 and a.count() == 24 and edges.count() == 16
    drivers.find_chains(posts, path, analyst)
    assert asked(tmp_path / "said") == [1, 2, 3, 4]


def test_failed_clusters_are_asked_again_by_the_next_run(spark, tmp_path):
    posts, path = corpus(spark), str(tmp_path / "kept")
    (tmp_path / "said").mkdir()
    bad = asking(tmp_path / "said", lambda p: "none" if "cluster 3" in p else chains.by_month(p))
    with pytest.raises(drivers.Unfinished, match="3"):
        drivers.by_cluster(posts, path, lambda p: chains.extract(p, bad, tries=1))
    assert asked(tmp_path / "said") == [1, 2, 3, 4]
    assert drivers.by_cluster(posts, path, lambda p: chains.extract(p, bad, tries=1), accept=True).where("status = 'failed'").count() == 1
    assert asked(tmp_path / "said") == [1, 2, 3, 3, 4]
    good = drivers.by_cluster(posts, path, lambda p: chains.extract(p, asking(tmp_path / "said", chains.by_month)))
    assert good.where("status = 'failed'").isEmpty() and good.where("status = 'ok'").select("cluster_id").distinct().count() == 4
    assert asked(tmp_path / "said") == [1, 2, 3, 3, 3, 4]
    assert drivers.by_cluster(posts.limit(0), str(tmp_path / "none"), lambda p: chains.extract(p, bad)).count() == 0


def test_answers_about_pools():
    one = {"group_id": 1, "excluded_candidates": ["2"], "title": "t", "reasoning": "r"}
    said = lambda *g: "so: ```json\n" + json.dumps({"groups": list(g)}) + "```"
    assert drivers.review_of(said(one, 5), 2) == [(1, "t", "r", ["2"])]
    assert drivers.review_of(said({"group_id": 2}), 2) == [(2, "", "", [])]
    for bad in (said({"group_id": 0}), said({"group_id": 3}), said({"group_id": "1"}), said({}), "{}", '{"groups": {}}', "no", None):
        assert drivers.review_of(bad, 2) is None


def test_pools_are_reviewed(spark, tmp_path):
    posts = corpus(spark)
    rows = [(c, 100 * c + h, 100 * c + i, float(i)) for c in (1, 2, 3) for h, mine in ((0, (0, 1, 2)), (3, (3, 4))) for i in mine] + [(0, 0, 0, 0.0), (0, 0, 1, 1.0)]
    pools = spark.createDataFrame(rows, "cluster_id long, hub long, id long, delta double")
    prompts = {r.cluster_id: r for r in drivers.pool_prompts(pools, posts, shown=1).collect()}
    text = prompts[1].prompt.split("GROUP 1\n")[1]
    assert prompts[1].hubs == ["100", "103"] and text.startswith('REFERENCE: <post id="100">') and text.count("<post") == 4 and "<of>" not in text

    def analyst(prompt):
        if "cluster 3" in prompt:
            raise OSError
        ids = re.findall(r'  <post id="(\d+)"', prompt)
        return json.dumps({"groups": [{"group_id": 2, "title": "second", "excluded_candidates": []}, {"group_id": 1, "title": "first", "reasoning": "why", "excluded_candidates": [ids[0], "103", "nope"]}, {"group_id": 1, "title": "late", "excluded_candidates": ids}]})

    kept, told, log = drivers.review_pools(pools, posts, str(tmp_path / "kept"), analyst, accept=True, tries=1)
    assert sorted((r.hub, r.id) for r in pools.select("hub", "id").exceptAll(kept.select("hub", "id")).collect()) == [(100, 101), (200, 201)] == sorted((r.hub, r.excluded_id) for r in log.collect())
    titles = {r.hub: (r.title, r.reasoning) for r in told.collect()}
    assert titles == {100: ("first", "why"), 103: ("second", ""), 200: ("first", "why"), 203: ("second", ""), 300: ("", ""), 303: ("", ""), 0: ("", "")}
    with pytest.raises(drivers.Unfinished, match="3"):
        drivers.review_pools(pools, posts, str(tmp_path / "kept"), analyst, tries=1)


REPORT = "## Executive Summary\nx [E1]\n## Key Findings\ny [{}]\n## Interpretation\nz\n## Confidence Assessment\n- **Level:** High\n## Conclusion\nConfidence: High"


def test_from_question_to_report(spark, tmp_path):
    posts = corpus(spark)
    assignments, edges, _ = drivers.find_chains(posts, str(tmp_path / "kept"), chains.by_month)
    posts = posts.join(assignments.selectExpr("cast(id as long) id", "nova_role", "subtopic_id"), "id", "left").withColumn("adept_role", F.lit(None).cast("string"))
    edges = edges.selectExpr("cast(source as long) source", "cast(target as long) target", "type", "force")
    prompts = []

    def analyst(prompt):
        prompts.append(prompt)
        if "sub_queries" in prompt:
            return '{"sub_queries": ["about two"]}'
        return REPORT.format("E9, id x") if len(prompts) < 3 else REPORT.format("e2")

    embed = lambda qs: [[float(i == (2 if "two" in q else 1)) for i in range(8)] for q in qs]
    report, problems, context = drivers.answer_question("about one", posts, edges, analyst, embed, budget=5)
    assert problems == [] and len(prompts) == 3 and "<retrieved_evidence>" in prompts[1]
    assert "post 0 <of> cluster 1" in context and "cluster 3" not in context
    assert "## Sources\n- E1: 100 (post 0" in report and "- E2: " in report and "(#cite-E2)" in report
