"""Shared working tables, and column picking that survives odd inputs.

``Scratch`` writes intermediate tables as Parquet below the folder named by
``spark.checkpoint.dir``, which every executor can read: a lost executor costs
the tasks in flight and no finished table.  Only where the session names no
such folder (unit tests, a laptop) is a local one made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.shipping import ship

#: Characters that separate words in every contract of this package.
SPACE = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one made for this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="clausewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables of one operator call.

    Shuffle files last until the driver happens to collect its garbage; with ``tidy`` it does so after each table,
    so that the disk holds the last tables' shuffles only.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        self.n, self.paths, self.tidy = 0, {}, tidy

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again; cuts its lineage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        if self.tidy:
            self.spark._jvm.System.gc()
        again = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(again)] = (path, again)
        return again

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``keep`` that no later plan reads."""
        for t in tables:
            if found := self.paths.pop(id(t), None):
                delete(self.spark, found[0])


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns ``wanted[new] = old`` only, by position: other columns of any name, even twice the same, don't matter."""
    ship(df.sparkSession)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select([F.col(f"c{place(df, old)}").alias(new) for new, old in wanted.items()])


def place(df: DataFrame, name: str) -> int:
    """Position of the first column of that name; else of the first that differs in case only."""
    if name in df.columns:
        return df.columns.index(name)
    lower = [c.lower() for c in df.columns]
    if name.lower() not in lower:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return lower.index(name.lower())



def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def below(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most so many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def attach(base: DataFrame, lists: DataFrame, key: str, values: str, how: str, limit: int) -> DataFrame:
    """``base`` with the array column ``values`` of ``lists`` by ``key``: broadcast up to ``limit`` bytes, joined beyond."""
    size = lists.agg(F.coalesce(F.sum(F.size(values) * 8 + 24), F.lit(0)).alias("bytes")).first()["bytes"]
    return base.join(F.broadcast(lists) if size <= limit else lists, key, how).select(*base.columns, values)
