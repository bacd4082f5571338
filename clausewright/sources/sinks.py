"""Sinks (K01-K09, K11): Spark writers behind projections that make rows fit the format."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, hoist: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Nested columns as JSON text; ``hoist[new] = (map column, key)`` fills a column from a map."""
    for new, (column, key) in (hoist or {}).items():
        value = F.try_element_at(column, F.lit(key)).cast("string")
        df = df.withColumn(new, F.coalesce(F.col(new).cast("string"), value) if new in df.columns else value)
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select([F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Named columns in order, quotes doubled."""
    flat(df.select(*fields) if fields else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """K03."""
    df.write.mode("append").json(path)


def replace_json(df: DataFrame, path: str) -> None:
    """All or nothing by the job's commit; keys in name order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def replace_keys(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows of other keys and the new rows; null keys match each other."""
    drop = new.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return old.join(drop, same, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_vectors(df: DataFrame, path: str, key: list[str], partition: str | None = None) -> int:
    """The table's rows of other keys and the new ones, as a version of its own below ``path``; the number of rows that a reader finds.

    ``current`` names the newest version and is written last, so a run that fails leaves the table as it was.  A number
    of rows other than those written raises.  Rows that repeat a key are all kept.
    """
    spark = df.sparkSession
    old = vectors(spark, path)
    rows = (df if old is None else replace_keys(old, df, key))
    seen = Observation()
    version = f"{path}/{uuid.uuid4().hex}"
    writer = rows.observe(seen, F.count("*").alias("n")).write
    (writer.partitionBy(partition) if partition else writer).parquet(version)
    n, want = spark.read.parquet(version).count(), seen.get["n"]
    if n != want:
        raise ValueError(f"{version} holds {n} of {want} rows")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return n


def vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table of ``upsert_vectors``; None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(spark.read.schema("version string").json(f"{path}/current").first()["version"])


def chat_rows(df: DataFrame, system: str, user: str, assistant: str, keep: list[str] | None = None) -> DataFrame:
    """``messages`` of one system, user and assistant turn each, beside the columns to ``keep``."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select(*(keep or []), F.array(turn("system", F.lit(system)), turn("user", F.col(user)), turn("assistant", F.col(assistant))).alias("messages"))
