"""Posts from a folder of files."""
import os
from functools import reduce

from pyspark.sql import Window as W, functions as F

from ..functions import text
from ..operators import posts as P

#: Names, in order, under which a column is looked for, in any case.
ALIASES = {
    "id": ("id",), "content": ("content",), "title": ("title", "headline", "subject"), "body": ("content", "body", "text", "selftext", "message"),
    "engagement": ("engagement", "score"), "timestamp": ("timestamp", "created_at", "published_at", "posted_at"),
}


def match_alias(columns, names):
    """The column that bears the first of the names found, whatever its case; of columns that differ by case alone the last. None without one."""
    of = {c.lower(): c for c in columns}
    return next((of[n] for n in names if n in of), None)


def mapped(df, mapping):
    """Columns renamed by {to: from}, where the source is there and has another name; a column that bore the new name goes."""
    for to, old in mapping.items():
        if old in df.columns and old != to:
            df = df.drop(to).withColumnRenamed(old, to)
    return df


def canonical(df):
    """content, engagement, timestamp and id from whatever columns hold them.

    content as it is; without one, title and body with a blank line between if both have text. Numbers in a column of times are seconds.
    """
    cols = df.columns
    content, title, body = (match_alias(cols, ALIASES[k]) for k in ("content", "title", "body"))
    trim = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c else F.lit("")
    t, b = trim(title), trim(body)
    joined = trim(content) if content else F.when(b == "", t).when(t == "", b).otherwise(F.concat(t, F.lit("\n\n"), b))
    e, ts, i = (match_alias(cols, ALIASES[k]) for k in ("engagement", "timestamp", "id"))
    out = df.withColumn("_content", joined).withColumn("_time", text.parse_time(F.col(f"`{ts}`")) if ts else F.lit(None).cast("timestamp"))
    out = out.withColumn("_engagement", P.numeric(F.col(f"`{e}`")) if e else F.lit(None).cast("double")).withColumn("_id", F.col(f"`{i}`").cast("string") if i else F.lit(None).cast("string"))
    out = out.drop(*[c for c in (content, e, ts, i) if c], "content", "timestamp", "engagement", "id")
    return out.withColumnsRenamed({"_content": "content", "_time": "timestamp", "_engagement": "engagement", "_id": "id"})


def require(df, *columns):
    """df, if it has the columns."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def read_json(spark, path):
    """A record or a list of records a file."""
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark, path):
    return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.endswith("tsv") else ",", multiLine=True, escape='"')


def read_text(spark, path):
    """A post a file: its text, stripped, with bytes that are no UTF-8 replaced."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_replace(F.decode("content", F.lit("utf-8")) if not hasattr(F, "make_valid_utf8") else F.make_valid_utf8(F.col("content").cast("string")), r"^\s+|\s+$", "").alias("content"))


def read_pdf(spark, path):
    """A post a file: the text of its pages. Needs pypdf on the workers."""
    import pandas as pd

    @F.pandas_udf("string")
    def pages(raw: pd.Series) -> pd.Series:
        import io

        from pypdf import PdfReader

        return raw.map(lambda b: "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages).strip())

    return spark.read.format("binaryFile").load(path).select(pages("content").alias("content"))


READERS = {".json": read_json, ".csv": read_csv, ".tsv": read_csv, ".txt": read_text, ".md": read_text, ".pdf": read_pdf, ".parquet": lambda spark, path: spark.read.parquet(path)}


def listing(spark, folder):
    """(path, size) of a folder's files, by name, from any of Spark's stores; an error if it isn't there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(folder)
    return sorted((s.getPath().toString(), s.getLen(), s.isDirectory()) for s in fs.listStatus(at))


def browse(spark, folder):
    """(folders, files with sizes): visible sub-folders in any case's order, and files that can be read."""
    all_ = [(os.path.basename(p.rstrip("/")), n, d) for p, n, d in listing(spark, folder)]
    return sorted([n for n, _, d in all_ if d and not n.startswith(".")], key=str.lower), [(n, s) for n, s, d in all_ if not d and os.path.splitext(n)[1].lower() in READERS]


def load(spark, folder, mapping=None, limit=None, on_duplicate="suffix"):
    """Posts of a folder's files in the order of names: id, content, timestamp, engagement, file and whatever else they hold.

    Rows without content stay, with empty content. A column that files hold in unlike types is text. Engagement is ranked within its file, and missing values get the median. Ids: as ensure_ids; a repeated source id is an error if on_duplicate is "error". limit: the first rows by file and place, after all that.
    """
    files = [(p, os.path.splitext(p)[1].lower()) for p, _, d in listing(spark, folder) if not d]
    files = [(p, s) for p, s in files if s in READERS]
    if not files:
        raise ValueError(f"no file in {folder} that can be read")
    frames, kinds = [], {}
    for k, (path, suffix) in enumerate(files):
        df = canonical(mapped(READERS[suffix](spark, path), mapping or {}))
        df = df.withColumn("file", F.lit(os.path.basename(path))).withColumn("file_no", F.lit(k)).withColumn("pos", F.monotonically_increasing_id())
        frames.append(df)
        for c in df.schema:
            kinds.setdefault(c.name, set()).add(c.dataType.simpleString())
    unlike = {c for c, found in kinds.items() if len(found) > 1}
    frames = [df.withColumns({c: F.col(f"`{c}`").cast("string") for c in unlike & set(df.columns)}) for df in frames]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    out = require(out, "content")
    out = P.engagement_rank(out).withColumn("engagement", F.col("rank")).drop("rank")
    out = P.fill_median(out)
    if on_duplicate == "error":
        again = out.where("trim(coalesce(id, '')) <> ''").groupBy("id").count().where("count > 1").limit(5).collect()
        if again:
            raise ValueError(f"ids that repeat: {', '.join(r.id for r in again)}")
    out = P.ensure_ids(out, ("file_no", "pos"))
    return out.orderBy("file_no", "pos").limit(limit) if limit else out


def row_count(spark, path):
    """Rows of a Parquet table, from its footers."""
    return spark.read.parquet(path).count()
