"""Incremental, checkpointed, replay-tolerant jobs over arriving files."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import running_credits
from ..session import scratch  # noqa: F401  queries name it from here


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, on the executors' disks with changelogs in the checkpoint, so it may outgrow memory."""
    store = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in store}
    try:
        for k, v in store.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that has arrived, its state in RocksDB. Each batch overwrites its own part of the table, so a replayed
    batch changes nothing; for update and complete modes the caller reads the latest row of each key."""
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch_id={number}")

    with rocksdb_state(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    return spark.read.schema(schema.add("batch_id", "long") if "batch_id" not in schema.names else schema).parquet(f"{root}/table")


def land(df: DataFrame, root: str, files: int = 4) -> DataFrame:
    """Write a table as arriving files and read it as a stream."""
    df.repartition(files).write.parquet(f"{root}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")


def land_in_order(df: DataFrame, root: str, order: str, key: str | None, batches: int = 4, files: int = 2) -> DataFrame:
    """The same, arriving in ranges of `order`, one after the other; the rows of a key and a range are in one file, so
    batches bring them in order wherever they are cut. Without a key a range is dealt evenly."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // batches + 1
    for k in range(batches):
        part = df.where(F.floor((F.col(order) - (low or 0)) / step) == k)
        (part.repartition(files, key) if key else part.repartition(files)).write.mode("append").parquet(f"{root}/in")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")


def stream_dedup(stream: DataFrame, key: str, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """The first arrival of each key. With a time and a delay a key is forgotten once the watermark passes its time by the delay, and
    rows from before the watermark are dropped; without them all keys are remembered, in RocksDB and not in memory."""
    if event_time and within:
        return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def stream_progress(stream: DataFrame) -> DataFrame:
    """Counters of each run, kept up to date (update mode)."""
    return stream.groupBy("run_id").agg(F.count("*").alias("events"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.max("ts").alias("last_activity_at"))


def stream_budget(stream: DataFrame, root: str, ceiling: int) -> DataFrame:
    """Running credits of each provider in order of arrival; once the ceiling is reached all is refused.

    Inside a batch sums are made in two steps (`running_credits`); what is carried from batch to batch is one
    row a provider, in a table of each batch's end, so a batch that is replayed starts from the same sums."""
    spark = stream.sparkSession
    totals = "source string, spent long"

    def fold(batch: DataFrame, number: int) -> None:
        base = spark.read.schema(totals).parquet(f"{root}/totals/batch_id={number - 1}") if number else spark.createDataFrame([], totals)
        before = base.select(F.col("source").alias("p"), F.col("spent").alias("base"))
        run = running_credits(batch)
        run = run.join(before, run["source"].eqNullSafe(before["p"]), "left").withColumn("spent", F.coalesce("base", F.lit(0)) + F.col("spent"))
        run = run.select("source", "id", F.col("spent").cast("long").alias("spent"), (F.col("spent") - F.col("credits") >= ceiling).alias("refused"))
        run.write.mode("overwrite").parquet(f"{root}/table/batch_id={number}")
        ends = base.unionByName(batch.select("source", F.col("credits").cast("long").alias("spent"))).groupBy("source").agg(F.sum("spent").alias("spent"))
        ends.write.mode("overwrite").parquet(f"{root}/totals/batch_id={number}")

    query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(fold).start()
    query.awaitTermination()
    return spark.read.schema("source string, id long, spent long, refused boolean, batch_id long").parquet(f"{root}/table")

