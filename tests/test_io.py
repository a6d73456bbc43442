"""Files, services, runs and streams."""
import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom import runs
from postloom.operators import edges as E
from postloom.sources import files, services
from postloom.streaming import posts as S


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Title": "t", "selftext": " b ", "score": 3, "created_at": 1700000000}, {"Title": "", "selftext": "b2", "score": "x", "created_at": 1700000060}]))
    (tmp_path / "b.csv").write_text('id,text,engagement,timestamp\nx,"one, ""two""",5,2024-01-01T00:00:00+02:00\nx,three,7,soon\n')
    (tmp_path / "c.tsv").write_text("id\tmessage\n\tfour\n")
    (tmp_path / "d.txt").write_bytes(b"  plain \xff text \n")
    (tmp_path / "e.bin").write_text("no")
    (tmp_path / "sub").mkdir()
    got = files.load(spark, str(tmp_path)).collect()
    by = {r.content: r for r in got}
    assert set(by) == {"t\n\nb", "b2", 'one, "two"', "three", "four", "plain � text"}
    assert by['one, "two"'].id == "x" and by["three"].id == "x__dup1" and len(by["four"].id) == 16 and by["three"].timestamp is None
    assert by["t\n\nb"].engagement == 10.0 and by["b2"].engagement == 10.0 and by["three"].engagement == 10.0 and by['one, "two"'].engagement == 5.5
    assert spark.createDataFrame(got).select(F.unix_seconds("timestamp")).where("content = 'one, \"two\"'").first()[0] == 1704060000
    assert [r.content for r in files.load(spark, str(tmp_path), limit=1).collect()] == ["t\n\nb"]
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path), on_duplicate="error")
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "sub"))
    assert files.browse(spark, str(tmp_path)) == (["sub"], [(n, (tmp_path / n).stat().st_size) for n in ("a.json", "b.csv", "c.tsv", "d.txt")])


def test_aliases():
    assert files.match_alias(["Body", "TEXT"], ("content", "body", "text")) == "Body" and files.match_alias(["A", "a"], ("a",)) == "a" and files.match_alias([], ("a",)) is None


def test_embedding_with_bisection_and_cache(spark):
    class Touchy(services.HashingEmbedder):
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return super().__call__(texts)

    vectors, errors = services.bisected(Touchy(8), ["a", "bad", "c", "d"])
    assert list(errors) == [1] and vectors[1] is None and np.allclose(vectors[3], services.HashingEmbedder(8)(["d"])[0])
    df = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, "a b"), (4, None)], "id int, content string")
    out, new = services.embed_cached(df, Touchy(8), None)
    new = spark.createDataFrame(new.collect(), new.schema)
    assert {r.id: r.embedding is not None for r in out.collect()} == {1: True, 2: False, 3: True, 4: True} and new.count() == 2
    again, more = services.embed_cached(df.where("id < 2"), Touchy(8), new)
    assert more.count() == 0 and again.first().embedding is not None
    assert services.reusable(df, df, {"m": 1}, {"m": 1}) and not services.reusable(df, df.where("id > 1"), {}, {}) and not services.reusable(df, df, {"m": 1}, {"m": 2})

    def lost(texts):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        services.bisected(lost, ["a", "b"])


def test_analyst_requests_and_settings():
    a = services.HttpAnalyst("http://127.0.0.1:9/none", "m", "k", "anthropic", {"temperature": 0}, retries=2)
    head, body = a.request("s", "p", 5)
    assert head["x-api-key"] == "k" and body["max_tokens"] == 5 and body["temperature"] == 0 and a.answer_of({"content": [{"text": "x"}]}) == "x"
    b = services.HttpAnalyst("http://127.0.0.1:9/none", "m", "k")
    assert b.request("s", "p")[0]["Authorization"] == "Bearer k" and b.answer_of({"choices": [{"message": {"content": "y"}}]}) == "y"
    waits = []
    with pytest.raises(OSError):
        a("p", pause=waits.append)
    assert waits == [1] and not b.available()
    with pytest.raises(ConnectionError):
        services.HttpEmbedder("http://127.0.0.1:9/none", "m")(["a"])
    got = services.chat_config({"models": {"fast": {"url": "u", "model": "m"}}, "naming": {"model_slot": "fast", "model": "n", "other": 1}}, "naming", {"FAST_API_KEY": "z"})
    assert got == {"url": "u", "model": "n", "key": "z"}


def test_a_run_from_beginning_to_trash(spark, tmp_path):
    r = runs.Runs(spark, str(tmp_path))
    old = r.create("p", {"models": {"a": 1}, "naming": {"model_slot": "x", "n": 2}}, now=datetime.datetime(2024, 1, 1))
    run = r.create("p", {"naming": {"n": 1}})
    posts = spark.createDataFrame([(1, "x", "old", [1.0])], "id long, content string, cluster_label string, embedding_raw array<double>")
    edges = spark.createDataFrame([("1", "2", "follow", 1.0)], "source string, target string, type string, force double")
    assert r.active() == run and [x["run_id"] for x in r.list()] == [old, run] and r.last_stage(run) is None and r.status(run) == "crashed"
    assert r.lock(run, "me") and not r.lock(run, "you") and r.status(run) == "in_progress"
    r.unlock(run, "you")
    assert r.status(run) == "in_progress"
    r.unlock(run, "me")
    r.save_stage(run, "adr", posts)
    r.save_stage(run, "naming", posts, edges)
    assert r.last_stage(run) == "naming" and r.load_stage(run, "naming")[1].count() == 1 and r.load_stage(run, "adr")[1] is None
    with pytest.raises(KeyError):
        r.load_stage(run, "fa2")
    assert r.relabel(run, spark.createDataFrame([(1, "new", "t")], "id long, cluster_label string, cluster_topic string")) == ["naming"]
    assert r.load_stage(run, "naming")[0].first().cluster_label == "new" and r.load_stage(run, "adr")[0].first().cluster_label == "old"
    assert r.conflict(run, "clustering") == ["adr", "naming"] and r.resume(run, "full") == "naming"
    with pytest.raises(ValueError):
        r.resume(run, "clustering")
    r.save_state(run, posts, edges)
    g = r.graph(run)
    assert g["posts"].first().embedding == [1.0] and g["pools"].count() == 0 and "embedding_raw" not in spark.read.parquet(r.path(run, "clusters_render.parquet")).columns
    assert r.save_tables(run, some=edges, none=edges.where("false")) == ["some"]
    s = {x.run_id: x for x in r.summary().collect()}
    assert (s[run].status, s[run].n_posts, s[run].stage) == ("complete", 1, "naming") and s[old].status == "crashed"
    assert r.sync_models(old, {"models": {"b": 2}, "naming": {"model_slot": "y", "n": 9}})["naming"] == {"model_slot": "y", "n": 2}
    r.save_search(run, "20240101-000000-why.md", "é")
    assert r.searches(run) == ["20240101-000000-why.md"] and r.search(run, "20240101-000000-why.md") == "é" and r.delete_search(run, "20240101-000000-why.md")
    with pytest.raises(ValueError):
        r.search(run, "../run.json")
    r.trash(old)
    assert [x["run_id"] for x in r.list()] == [run]
    r.restore(old)
    r.trash(old)
    assert r.purge() == [old] and r.resume(run, "clustering", force=True) is None


def test_settings_and_gates():
    assert runs.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert runs.flattened({"x": {"api_key": "s", "n": 1}, "y": "z"}) == [("x", "n", "1"), ("", "y", '"z"')]
    assert runs.checked("q", 100, "full") == {"question": "q", "budget": 100, "mode": "full"} and runs.gate("continue", "x")
    for bad in ({"budget": 99}, {"mode": "x"}, {"run_id": "../x"}, {"question": " "}):
        with pytest.raises(ValueError):
            runs.checked(**bad)
    with pytest.raises(RuntimeError):
        runs.gate("stop", "x")
    assert runs.viewer("<script>{{a}}</script>", {"a": "</script><!--"}) == '<script>"<\\/script><\\!--"</script>'


def posts_of(spark, rows):
    return spark.createDataFrame(rows, "id string, content string, timestamp timestamp, embedding array<double>, cluster_id int, engagement double")


def test_streams_give_what_batches_give(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(f"p{i}" if i % 5 else None, f"c{i % 7}", t + datetime.timedelta(hours=i), [1.0, i / 10], i % 2, float(i)) for i in range(30)]
    a, b = posts_of(spark, rows[:20]), posts_of(spark, rows[15:])
    a.write.parquet(str(tmp_path / "in"))
    b.write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    every = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(r.id for r in run(S.new_posts(read(), "90 days"), "fresh").collect()) == sorted(r.id for r in S.new_posts(every).collect())
    known = posts_of(spark, [x for x in rows if x[0]])
    known.write.parquet(str(tmp_path / "known"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "known"))
    pairs = lambda df: sorted((r.source, r.target, round(r.force, 9)) for r in df.collect())
    assert pairs(run(S.follow(stream, 0.5, hours=10), "follow")) == pairs(E.follow(known, 0.5, hours=10.0)) != []
    assert sum(r.n for r in run(S.hourly(read()), "hourly", "complete").collect()) == 35
    stored = {"posts": None, "edges": []}

    def sink(batch, edges):
        new = spark.createDataFrame(batch.collect(), batch.schema)
        stored["edges"] += [(r.source, r.target) for r in edges.collect()]
        stored["posts"] = new if stored["posts"] is None else stored["posts"].unionByName(new)

    make = lambda new, old: E.incremental(new, old, lambda x: E.bridges(x, 0.5))
    q = S.into(spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "known")), lambda: stored["posts"] if stored["posts"] is not None else known.limit(0), make, sink, str(tmp_path / "into"))
    q.processAllAvailable()
    q.stop()
    assert sorted(stored["edges"]) == sorted((r.source, r.target) for r in E.bridges(known, 0.5).collect())


def test_manifests_are_watched(spark, tmp_path):
    r = runs.Runs(spark, str(tmp_path / "runs"))
    run = r.create("p", {})
    q = S.watch(spark, str(tmp_path / "runs")).writeStream.format("memory").queryName("manifests").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(x.run_id, x.status) for x in spark.table("manifests").collect()] == [(run, "in_progress")]
