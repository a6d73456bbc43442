"""Runs: folders of settings, stage checkpoints, state, searches and locks. Tables go through Spark's writers; small JSON files through its file systems, so a run may live in any store."""
import copy
import datetime
import json
import re
import secrets
import time

from pyspark.sql import functions as F

#: Stages in order.
STAGES = ("adr", "naming", "nova", "adept", "edges", "fa2")
RUN_ID = re.compile(r"^\d{8}-\d{6}-[0-9a-f]{4}$")
SEARCH = re.compile(r"^\d{8}-\d{6}-[a-z0-9-]{1,40}\.md$")


def merged(under, over):
    """under with what `over` says, at every depth."""
    out = copy.deepcopy(under)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def flattened(config, group=""):
    """(group, label, value) rows of settings, keys and passwords left out."""
    rows = []
    for k, v in sorted(config.items()):
        if re.search("key|secret|password|token$", k, re.I):
            continue
        rows += flattened(v, f"{group}.{k}".strip(".")) if isinstance(v, dict) else [(group, k, json.dumps(v))]
    return rows


def checked(question=None, budget=None, mode=None, run_id=None):
    """The arguments of a launch, if they are allowed."""
    if budget is not None and not 100 <= int(budget) <= 6000:
        raise ValueError("budget: 100 to 6000")
    if mode is not None and mode not in ("full", "clustering"):
        raise ValueError("mode: full or clustering")
    if run_id is not None and not RUN_ID.match(run_id):
        raise ValueError("run id")
    if question is not None and not question.strip():
        raise ValueError("an empty question")
    return {k: v for k, v in (("question", question), ("budget", budget), ("mode", mode), ("run_id", run_id)) if v is not None}


def gate(policy, problem):
    """What to do where a person would be asked: "continue", or an error."""
    if policy != "continue":
        raise RuntimeError(problem)
    return True


def safe_json(value):
    """JSON that may stand within a script element."""
    return json.dumps(value, ensure_ascii=False).replace("</", "<\\/").replace("<!--", "<\\!--")


def viewer(template, tokens):
    """A template with {{name}} replaced by safe JSON; a name without a value is an error."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: safe_json(tokens[m[1]]), template)


class Files:
    """Small files in any of Spark's stores."""

    def __init__(self, spark):
        self.spark, self.jvm = spark, spark._jvm

    def at(self, path):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path):
        fs, p = self.at(path)
        return fs.exists(p)

    def names(self, path):
        fs, p = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path):
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path, text, new=False):
        """Whole or not at all: written beside and renamed. new: an error if it is there."""
        fs, p = self.at(path)
        if new:
            stream = fs.create(p, False)
            stream.write(bytearray(text.encode()))
            stream.close()
            return
        _, beside = self.at(f"{path}.{secrets.token_hex(4)}.tmp")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        # FileContext's rename replaces the old file in one step, where the store can; FileSystem's doesn't replace
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        p = fs.makeQualified(p)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), p, options)

    def delete(self, path):
        fs, p = self.at(path)
        return fs.delete(p, True)

    def move(self, path, to):
        fs, p = self.at(path)
        _, q = self.at(to)
        fs.mkdirs(q.getParent())
        return fs.rename(p, q)


class Runs:
    """The runs of a folder."""

    def __init__(self, spark, root):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, run, *more):
        return "/".join([self.root, run, *more])

    def json(self, path, default=None):
        return json.loads(self.files.read(path)) if self.files.exists(path) else default

    def put(self, path, value):
        self.files.write(path, json.dumps(value, indent=1, sort_keys=True))

    def create(self, project, config, args=None, mode="full", now=None):
        """A new run's id; its settings are kept as they are now, and it becomes the active one."""
        now = now or datetime.datetime.now(datetime.timezone.utc)
        run = f"{now:%Y%m%d-%H%M%S}-{secrets.token_hex(2)}"
        self.put(self.path(run, "config.json"), config)
        self.put(self.path(run, "run.json"), {"run_id": run, "project_name": project, "status": "in_progress", "stage": None, "run_mode": mode, "cli_args": args or {}, "started_at": now.isoformat(), "finished_at": None})
        self.put(f"{self.root}/active.json", {"run_id": run})
        return run

    def load(self, run):
        got = self.json(self.path(run, "run.json"))
        if got is None:
            raise KeyError(run)
        return got

    def update(self, run, **values):
        self.put(self.path(run, "run.json"), self.load(run) | values)

    def active(self):
        return (self.json(f"{self.root}/active.json") or {}).get("run_id")

    def save_stage(self, run, stage, posts, edges=None, mode="full"):
        """Tables first, then what they are, then the run's pointer: a stage that has no meta.json was not finished."""
        at = self.path(run, "stages", stage)
        posts.write.mode("overwrite").parquet(f"{at}/posts.parquet")
        if edges is not None:
            edges.write.mode("overwrite").parquet(f"{at}/edges.parquet")
        self.put(f"{at}/meta.json", {"stage": stage, "run_mode": mode, "edges": edges is not None})
        self.update(run, stage=stage)

    def load_stage(self, run, stage):
        """(posts, edges or None)."""
        at, meta = self.path(run, "stages", stage), self.json(self.path(run, "stages", stage, "meta.json"))
        if meta is None:
            raise KeyError(f"{run}: no checkpoint of {stage}")
        return self.spark.read.parquet(f"{at}/posts.parquet"), self.spark.read.parquet(f"{at}/edges.parquet") if meta["edges"] else None

    def last_stage(self, run):
        """The furthest stage that was finished, as the folder has it."""
        return next((s for s in reversed(STAGES) if self.files.exists(self.path(run, "stages", s, "meta.json"))), None)

    def conflict(self, run, mode):
        """Stages that another mode would make void."""
        return [s for s in STAGES if (self.json(self.path(run, "stages", s, "meta.json")) or {"run_mode": mode})["run_mode"] != mode]

    def resume(self, run, mode=None, force=False):
        """The stage to go on after; another mode's stages are an error, or with force deleted."""
        bad = self.conflict(run, mode) if mode else []
        if bad and not force:
            raise ValueError(f"stages of another mode: {', '.join(bad)}")
        for s in bad:
            self.files.delete(self.path(run, "stages", s))
        self.update(run, status="in_progress")
        return self.last_stage(run)

    def save_state(self, run, posts, edges, embeddings=("embedding_raw", "embedding_lda")):
        """All posts, those to draw (without embeddings) and edges; the run is complete."""
        posts.write.mode("overwrite").parquet(self.path(run, "clusters.parquet"))
        posts.drop(*embeddings).write.mode("overwrite").parquet(self.path(run, "clusters_render.parquet"))
        edges.write.mode("overwrite").parquet(self.path(run, "edges.parquet"))
        self.update(run, status="complete", finished_at=datetime.datetime.now(datetime.timezone.utc).isoformat())

    def save_tables(self, run, **tables):
        """Tables by name; empty ones are not written. The names written."""
        out = []
        for name, df in tables.items():
            if not df.isEmpty():
                df.write.mode("overwrite").parquet(self.path(run, f"{name}.parquet"))
                out.append(name)
        return out

    def table(self, run, name, schema):
        """A saved table, or an empty one of the schema."""
        path = self.path(run, f"{name}.parquet")
        return self.spark.read.parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], schema)

    def graph(self, run):
        """posts, edges and metadata of a complete run; the embedding under whichever of its usual names, and empty tables for what was not saved."""
        posts = self.spark.read.parquet(self.path(run, "clusters.parquet"))
        name = next((c for c in ("embedding", "embedding_retrieval", "embedding_raw", "embedding_lda", "vector") if c in posts.columns), None)
        if name and name != "embedding":
            posts = posts.withColumn("embedding", F.col(name))
        return {"posts": posts, "edges": self.table(run, "edges", "source string, target string, type string, force double"),
                "chains": self.table(run, "nova_metadata", "subtopic_id string, title string, reasoning string"), "pools": self.table(run, "pool_explanations", "hub string, title string, reasoning string")}

    def relabel(self, run, labels, from_stage="naming"):
        """cluster_label and cluster_topic patched in every posts table of a run from a stage on. labels: id, cluster_label, cluster_topic."""
        done = []
        for s in STAGES[STAGES.index(from_stage) :]:
            at = self.path(run, "stages", s, "posts.parquet")
            if self.files.exists(at):
                new = patched(self.spark.read.parquet(at), labels)
                new.write.mode("overwrite").parquet(at + ".new")  # the old one is being read
                self.files.delete(at)
                self.files.move(at + ".new", at)
                done.append(s)
        return done

    def sync_models(self, run, config):
        """The run's settings with the model routing of others: models, and each section's model_slot and parallel_clusters."""
        own = self.json(self.path(run, "config.json"), {})
        out = own | {"models": config.get("models", {})}
        for k, v in config.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = out[k] | {n: v[n] for n in ("model_slot", "parallel_clusters") if n in v}
        self.put(self.path(run, "config.json"), out)
        return out

    def held(self, run, now=None):
        """Who holds a run's lock, if anybody still does: a lock whose time is over is nobody's."""
        got = self.json(self.path(run, "lock"))
        return got["owner"] if got and got["until"] > (now or time.time()) else None

    def lock(self, run, owner, seconds=60, now=None):
        """Whether the run's lock is now ours, for so many seconds; its owner renews it by locking again before they are over. A lock that its owner left, in a crash too, can be taken once its time is over."""
        path, now = self.path(run, "lock"), now or time.time()
        text = json.dumps({"owner": owner, "until": now + seconds})
        holder = self.held(run, now)
        if holder == owner:
            self.files.write(path, text)
            return True
        if holder:
            return False
        try:
            if self.files.exists(path):
                self.files.move(path, f"{path}.{secrets.token_hex(4)}.old")  # of several that find it over, one moves it
            self.files.write(path, text, new=True)
        except Exception as e:
            if "exist" in str(e).lower() or "not found" in str(e).lower():
                return False
            raise
        return self.held(run, now) == owner

    def unlock(self, run, owner):
        if self.held(run) == owner:
            self.files.delete(self.path(run, "lock"))

    def status(self, run, now=None):
        """A run in progress that nobody holds has crashed."""
        s = self.load(run)["status"]
        return "crashed" if s == "in_progress" and not self.held(run, now) else s

    def list(self):
        """Runs by the time they began."""
        return sorted((self.load(n) for n in self.files.names(self.root) if RUN_ID.match(n)), key=lambda r: r["started_at"])

    def summary(self):
        """A table of runs: run_id, project_name, status, stage, run_mode, started_at, locked, n_posts."""
        rows = []
        for r in self.list():
            run, state = r["run_id"], self.path(r["run_id"], "clusters.parquet")
            n = self.spark.read.parquet(state).count() if self.files.exists(state) else None
            rows.append((run, r["project_name"], self.status(run), self.last_stage(run), r["run_mode"], r["started_at"], self.files.exists(self.path(run, "lock")), n))
        return self.spark.createDataFrame(rows, "run_id string, project_name string, status string, stage string, run_mode string, started_at string, locked boolean, n_posts long")

    def trash(self, run):
        self.files.move(self.path(run), f"{self.root}/trash/{run}")

    def restore(self, run):
        self.files.move(f"{self.root}/trash/{run}", self.path(run))

    def purge(self):
        names = self.files.names(f"{self.root}/trash")
        self.files.delete(f"{self.root}/trash")
        return names

    def save_search(self, run, name, report):
        if not SEARCH.match(name):
            raise ValueError(name)
        self.files.write(self.path(run, "searches", name), report)

    def searches(self, run):
        """Names of saved searches, newest first."""
        return [n for n in reversed(self.files.names(self.path(run, "searches"))) if SEARCH.match(n)]

    def search(self, run, name):
        if not SEARCH.match(name):
            raise ValueError(name)
        return self.files.read(self.path(run, "searches", name))

    def delete_search(self, run, name):
        if not SEARCH.match(name):
            raise ValueError(name)
        return self.files.delete(self.path(run, "searches", name))


def patched(posts, patch, key="id"):
    """Posts with the columns of a patch in place of their own."""
    cols = [c for c in patch.columns if c != key]
    return posts.drop(*cols).join(patch, key, "left")


def differences(old, new, key="run_id"):
    """key, change ('added', 'removed' or 'changed') and the names of changed fields, of two snapshots of a table."""
    cols = [c for c in new.columns if c != key]
    o, n = old.select(F.col(key).alias("k0"), F.struct(*cols).alias("o")), new.select(F.col(key).alias("k1"), F.struct(*cols).alias("n"))
    x = o.join(n, F.col("k0") == F.col("k1"), "full_outer")
    fields = F.concat_ws(",", *[F.when(F.col("k0").isNotNull() & F.col("k1").isNotNull() & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in cols])
    change = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").when(fields != "", "changed")
    return x.select(F.coalesce("k0", "k1").alias(key), change.alias("change"), fields.alias("fields")).where("change is not null")


def clustering_only(posts):
    """Whether no post has a role in a chain or a pool."""
    return posts.agg((F.count("nova_role") + F.count("adept_role")).alias("n")).first().n == 0
