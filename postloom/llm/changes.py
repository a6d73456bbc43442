"""Sequenced change applier: a keyed stream with event-time timers that applies each client's numbered changes in order, and jumps over numbers that stay out too long."""
import json
from itertools import groupby
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import Row

from ..session import exists, materialise, shared_dir
from .arrow import settings

DAY_MS = 86_400_000
#: Clients that share a state key, about: a call to the state store takes as long as some hundred rows.
TOGETHER = 64
#: A day after all others: the row that bears it moves the watermark past every timer.
SENTINEL = 2_900_000
STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STATE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "20s",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}
#: On file systems of the machine, Spark's other way to put a checkpoint file in place starts a process for each file.
BY_RENAME = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
FED = "lane long, client_id long, change_id long, n long, op string, city string, balance double, day long, at timestamp"
OUT = "change_id long, client_id long, n long, op string, status string, batch int, missed long, city string, balance double"


def dense_ranks(df, key, by):
    """key, by, n: the dense rank, from 1, of each distinct `by` among those of its key; null keys are a key, and a null `by` comes first.

    Pairs are dealt by range and numbered within each part; a key's parts add what stands in the parts before. So a key of any size is spread over the tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = df.select(key, by).distinct().repartitionByRange(parts, key, by).withColumn("part", F.spark_partition_id())
    pairs = materialise(pairs, "pairs")
    local = pairs.withColumn("local", F.row_number().over(Window.partitionBy("part", key).orderBy(by)))
    counts = pairs.groupBy(key, "part").agg(F.count("*").alias("own"))
    before = F.sum("own").over(Window.partitionBy(key).orderBy("part")) - F.col("own")
    counts = counts.select(F.col(key).alias("its_key"), F.col("part").alias("its_part"), before.alias("before"))
    joined = local.join(counts, (F.col("part") == F.col("its_part")) & F.col(key).eqNullSafe(F.col("its_key")))
    return joined.select(key, by, (F.col("local") + F.col("before")).alias("n"))


class Applier(StatefulProcessor):
    """A key's state is one value: the timer that is set, and its clients, each as [client, next number, city, balance, held], held as [n, day, change_id, op, city, balance]. The timer stands just before the key's earliest held day, and goes off when the watermark, which is `wait` days behind, has reached that day."""

    def __init__(self, label, wait):
        self.label, self.wait = label, wait

    def init(self, handle):
        self.handle = handle
        self.kept = handle.getValueState("clients", "timer long, clients string")

    def read(self):
        timer, clients = self.kept.get() or (None, "[]")
        return timer, {c[0]: c for c in json.loads(clients)}

    def write(self, timer, clients):
        due = min((h[1] for c in clients.values() for h in c[4]), default=None)
        due = None if due is None else due * DAY_MS - 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.kept.update((due, json.dumps(list(clients.values()))))

    @staticmethod
    def run(client, held, batch, missed=0):
        """Apply held changes as long as the next number is there."""
        while client[1] in held:
            n, _, change, op, city, balance = held.pop(client[1])
            if op == "I":
                client[2:4] = city, balance
            elif op == "U":
                client[2:4] = client[2] if city is None else city, client[3] if balance is None else balance
            elif op == "D":
                client[2:4] = None, None
            yield Row(change_id=change, client_id=client[0], n=n, op=op, status="applied", batch=batch, missed=missed, city=client[2], balance=client[3])
            client[1], missed = n + 1, 0

    def handleInputRows(self, key, rows, timerValues):
        rows = [r for r in rows if r.n > 0]
        if not rows:
            return
        rows.sort(key=lambda r: (r.client_id is not None, r.client_id, r.day, r.change_id, r.n, str(r.op), str(r.city), str(r.balance)))
        timer, clients = self.read()
        for id_, mine in groupby(rows, lambda r: r.client_id):
            client = clients.setdefault(id_, [id_, 1, None, None, []])
            held = {h[0]: h for h in client[4]}
            for r in mine:
                if r.n < client[1] or r.n in held:
                    yield Row(change_id=r.change_id, client_id=id_, n=r.n, op=r.op, status="rejected", batch=r.batch, missed=0, city=None, balance=None)
                    continue
                held[r.n] = [r.n, r.day, r.change_id, r.op, r.city, r.balance]
                yield from self.run(client, held, r.batch)
            client[4] = list(held.values())
        self.write(timer, clients)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = timerValues.getCurrentWatermarkInMs() // DAY_MS + self.wait
        batch = self.label(last) + 1
        _, clients = self.read()
        for client in clients.values():
            held = {h[0]: h for h in client[4]}
            while held and min(h[1] for h in held.values()) + self.wait <= last:
                least = min(held)
                missed, client[1] = least - client[1], least
                yield from self.run(client, held, batch, missed)
            client[4] = list(held.values())
        self.write(None, clients)  # the timer that went off is gone

    def close(self):
        pass


def fed(changes, batches, first_day, days):
    """The rows that take part, numbered, with their day and batch."""
    rows = changes.distinct()
    ranks = dense_ranks(rows, "client_id", "seq").select(F.col("client_id").alias("k"), F.col("seq").alias("s"), "n")
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    rows = rows.where(F.col("valid_at").isNotNull() & F.col("change_id").isNotNull() & (h % 11 != 0))
    rows = rows.withColumn("day", F.unix_date(F.col("valid_at").cast("date")) + 5 * (h % 4))
    rows = rows.join(ranks, F.col("client_id").eqNullSafe(F.col("k")) & F.col("seq").eqNullSafe(F.col("s")))
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / F.lit(days))))
    clients = rows.agg(F.approx_count_distinct("client_id")).first()[0]
    rows = rows.withColumn("lane", F.expr(f"pmod(xxhash64(client_id), {clients // TOGETHER + 1})"))
    cast = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in FED.split(", ")[:-1]]
    return rows.select(*cast, F.timestamp_seconds(F.col("day") * 86_400).alias("at"), batch.cast("int").alias("batch"))


def apply_changes(changes, batches=10, first_day=19_723, days=160, wait=8):
    """change_id, client_id, n, op, status (applied or rejected), batch, missed, city, balance, current for each distinct row of (change_id, client_id, seq, op, valid_at, city, balance) that takes part.

    A row's number n is the dense rank of its seq among its client's; h = crc32 of its decimal change_id; its day is that of valid_at plus 5 * (h % 4). Rows without valid_at or change_id, and those with h % 11 = 0, take no part, but count for the ranks. Days before the first go with batch 1. Null client ids are a client; a null seq is the lowest; an op other than I, U and D changes nothing; rows of equal day and change_id come in order of n, op, city and balance. Other columns make rows distinct and are not carried. An empty table gives no rows.

    Batches are written to a new folder of the shared one, and moved in front of a query that starts anew for each and goes on from its checkpoint. The watermark follows the largest day by `wait` days. When it passes a client's earliest held day, the timer's callback, in the batch without data that follows, jumps to the least held number. That is the start of the following batch, whose number it bears; a row with a day beyond all others, fed with the last batch, flushes what is held then as batch `batches` + 1. About 64 clients share a state key and a timer, which stands at the earliest day that any of them holds; the key's state is one value, read and written once in a batch that has rows of it. `current` is told by an aggregate over the results.
    """
    spark = changes.sparkSession
    home = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    fed(changes, batches, first_day, days).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{home}/cut")
    spark.range(1).selectExpr("0 lane", "null client_id", "null change_id", "-1 n", "null op", "null city", "null balance", f"{SENTINEL} day", f"timestamp_seconds({SENTINEL} * 86400l) at", f"{batches} batch").selectExpr(*[f"cast({c.split(' ')[0]} as {c.split(' ')[1]}) {c.split(' ')[0]}" for c in FED.split(", ")], "batch").write.mode("append").partitionBy("batch").parquet(f"{home}/cut")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(f"{home}/fed"))

    def label(day):
        return max(1, min(batches, 1 + (day - first_day) * batches // days))

    by_rename = {"spark.sql.streaming.checkpointFileManagerClass": BY_RENAME} if store.getScheme() == "file" else {}
    with settings(spark, SETTINGS | by_rename):
        for b in range(1, batches + 1):
            if exists(spark, f"{home}/cut/batch={b}"):
                store.rename(path(f"{home}/cut/batch={b}"), path(f"{home}/fed/batch={b}"))
            stream = spark.readStream.schema(f"{FED}, batch int").parquet(f"{home}/fed").withWatermark("at", f"{wait} days")
            done = stream.groupBy("lane").transformWithState(Applier(label, wait), OUT, "append", "eventTime")
            done.writeStream.format("parquet").option("path", f"{home}/done").option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(OUT).parquet(f"{home}/done")
    last = done.where("status = 'applied'").groupBy("client_id").agg(F.max("n").alias("last")).select(F.col("client_id").alias("k"), "last")
    joined = done.join(last, F.col("client_id").eqNullSafe(F.col("k")) & (F.col("n") == F.col("last")), "left")
    current = F.col("last").isNotNull() & (F.col("status") == "applied") & ~F.col("op").eqNullSafe(F.lit("D"))
    return joined.withColumn("current", current).drop("k", "last")
