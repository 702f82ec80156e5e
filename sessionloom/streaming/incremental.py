"""Structured Streaming over landed files: the batch operators, applied as files arrive.

Labels and cleaning are row-wise, so they run on the stream itself. Counts use a watermark. Session
features need whole sessions, so each micro-batch recomputes only the sessions that it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionloom.functions import text as T
from sessionloom.operators import cleaning, sessions


def turns(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def labelled(stream: DataFrame) -> DataFrame:
    """Cleaned and labelled turns; works on streams and tables alike."""
    return sessions.with_action_labels(cleaning.judged(stream).where("_drop_reason IS NULL").drop("_drop_reason"))


def event_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """window_start, key, n: tumbling counts; state is dropped once the watermark passes a window."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def _batches(spark: SparkSession, table: str, before: int) -> bool:
    """Whether the table holds an earlier batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return False
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return any(n.startswith("batch=") and int(n.removeprefix("batch=")) < before for n in names)


def current(spark: SparkSession, table: str, order: str = "row_id") -> DataFrame:
    """All turns that append_sessions has stored, with session features over whole sessions."""
    return sessions.enriched(spark.read.parquet(table).drop("batch"), order)


def append_sessions(stream: DataFrame, table: str, checkpoint: str, order: str = "row_id") -> StreamingQuery:
    """Appends enriched turns by batch number; a batch that runs again overwrites its own partition.

    A batch writes its own turns only, so what depends on a session's later turns (session_turn_count) is as of
    that batch; current() gives all turns with it up to date. Each batch reads the stored turns of its sessions,
    by a scan of the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("session_id", T.session_id())
        every = rows
        if _batches(spark, table, number):
            old = spark.read.parquet(table).where(F.col("batch") < number).select(*batch.columns).withColumn("session_id", T.session_id())
            every = old.join(rows.select("session_id").distinct(), "session_id", "left_semi").unionByName(rows.select(*old.columns))
        done = sessions.enriched(every.drop("session_id"), order).join(rows.select(order), order, "left_semi")
        done.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
