"""Traces as streams (R01-R06, W07, W08): sequence, latest status, resume.

The reference behaviour is an append-only event log with a latest-status view; that is
a streaming file source with an upsert per micro-batch.  Windowed counts with a
watermark are an extension of ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sequenced(events: DataFrame, run: str, ts: str, tie: str) -> DataFrame:
    """Each event's number in its run and seconds since the run's first."""
    w = Window.partitionBy(run).orderBy(ts, tie)
    start = F.min(ts).over(Window.partitionBy(run))
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return events.withColumn("sequence", F.row_number().over(w).cast("int")).withColumn("elapsed_seconds", F.round(seconds, 3))


def latest_status(events: DataFrame, run: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Each run's last event, by a partial aggregate, without a window."""
    return events.groupBy(run).agg(F.max_by(F.struct(*columns), F.struct(ts, tie)).alias("m"), F.count("*").alias("n_events")).select(run, "n_events", "m.*")


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New files of the log as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def materialise_latest(events: DataFrame, target: str, checkpoint: str, run: str, ts: str, tie: str, columns: list[str]):
    """The latest-status table kept up to date: one version a micro-batch, so a repeated batch rewrites the same one.

    Read it with ``read_latest``.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.select(run, ts, tie, *[c for c in columns if c not in (ts, tie)])
        if number:
            now = now.unionByName(spark.read.parquet(f"{target}/version={number - 1}"))
        now.groupBy(run).agg(F.max_by(F.struct(ts, tie, *[c for c in columns if c not in (ts, tie)]), F.struct(ts, tie)).alias("m")).select(run, "m.*").write.mode("overwrite").parquet(f"{target}/version={number}")

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """The newest committed version."""
    every = spark.read.parquet(target)
    newest = every.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{target}/version={newest}")


def resume(work: DataFrame, done: DataFrame, key: list[str], config: str, config_hash: str) -> DataFrame:
    """The rows whose key isn't done under the same configuration."""
    return work.join(done.where(F.col(config) == config_hash).select(*key).distinct(), key, "left_anti")


def run_id(content: str, config: str):
    """16 digits of the content's hash and 16 of the configuration's."""
    return F.concat_ws("-", F.substring(F.sha2(content, 256), 1, 16), F.substring(F.sha2(config, 256), 1, 16))


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts by event-time window with a watermark (on a timestamp with zone)."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    return e.withWatermark("_ts", late).groupBy(F.window("_ts", width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def with_retry(call, attempts: int = 3, wait=lambda k: 2**k, default=None, closed: bool = True):
    """A call tried again after growing waits; then its default, or the error if it must not pass."""
    import time

    def run(*a, **k):
        for i in range(attempts):
            try:
                return call(*a, **k)
            except Exception:
                if i == attempts - 1:
                    if closed:
                        raise
                    return default
                time.sleep(wait(i))
        return default

    return run
