"""Shared working folder: intermediate tables go where every executor can read them."""
import gc
import tempfile
import uuid


def shared_dir(spark):
    """The folder in spark.checkpoint.dir; a temporary one only on a local master where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="postloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders of working tables that this process has written.
_written = []


def materialise(df, tag, path=None):
    """Write df as Parquet in the shared folder, or at a path, and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    if path is None:
        folder = f"{shared_dir(spark)}/postloom-{uuid.uuid4().hex}"
        _written.append(folder)
        path = f"{folder}/{tag}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df, tag, key, parts):
    """As materialise, in `parts` buckets by a key: a join by it with rows dealt over as many partitions sends none of these."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/postloom-{uuid.uuid4().hex}"
    _written.append(folder)
    name = f"spark_catalog.default.{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", f"{folder}/{tag}").saveAsTable(name, format="parquet")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, until clear
    return found


def exists(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clear(spark):
    """Delete the working tables written so far: once the results that read them are stored."""
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    release(spark)


def release(spark):
    """Let Spark delete the shuffle files of plans that nobody holds any more; else they stay until the driver's memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
