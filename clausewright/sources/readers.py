"""Scans (S01-S14, S17, S18): every reader is a Spark data source plus Column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clausewright.functions.text import blank_to_null, trimmed

BOM = "﻿"


def csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), defaults: dict[str, object] | None = None) -> DataFrame:
    """A header CSV of strings, quoted line feeds allowed; a byte order mark is no part of a name.

    Missing required columns raise; missing optional ones take their default.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.removeprefix(BOM).strip() for c in df.columns])
    if lost := set(required) - set(df.columns):
        raise ValueError(f"{path} lacks {sorted(lost)}")
    for name, value in (defaults or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


ALIASES = {"label": "clause_type", "Filename": "document_id"}


def clauses(df: DataFrame, metadata_fields: tuple[str, ...] = (), aliases: dict[str, str] = ALIASES) -> DataFrame:
    """The clause table under its canonical names, the clean text preferred, metadata and blank rows left out."""
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    candidates = [blank_to_null(c) for c in ("clause_text_clean", "clause_text", "clause_text_raw") if c in df.columns]
    df = df.withColumn("clause_text", F.coalesce(*candidates)).where("clause_text IS NOT NULL")
    if "is_metadata" in df.columns:
        df = df.where(~F.coalesce(F.lower(trimmed(F.col("is_metadata").cast("string"))).isin("true", "1", "yes"), F.lit(False)))
    return df.where(~F.col("clause_type").isin(*metadata_fields)) if metadata_fields else df


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON value a file; what can't be read is a row of nulls with its text in ``_corrupt_record``."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def jsonl_last(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines; unreadable ones and those without a key are skipped, and the last line of a key wins.

    The order is that of file names and of places in a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select("file", "block", "line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", F.struct("file", "block", "line")).alias("r")).select("r.*")


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


QA = "title string, paragraphs array<struct<context: string, qas: array<struct<id: string, question: string, is_impossible: boolean, answers: array<struct<text: string, answer_start: int>>>>>>"


def nested_qa(df: DataFrame) -> DataFrame:
    """A row per question of contracts (``QA``): title, category (after the last ``__`` of the id), answers."""
    p = df.select("title", F.posexplode("paragraphs").alias("paragraph", "p"))
    q = p.select("title", "paragraph", F.explode("p.qas").alias("q"))
    return q.select("title", "paragraph", F.col("q.id").alias("id"), F.element_at(F.split("q.id", "__"), -1).alias("category"), F.transform("q.answers", lambda a: a["text"]).alias("answers"), F.size("q.answers").alias("n_answers"))


def text_documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """A row per text file with an allowed suffix."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


def front_matter(files: DataFrame, registry: DataFrame | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """``filename, meta, body`` of files (filename, text) that start with a ``---`` block.

    ``registry`` (filename, meta map) gives defaults that the file's own entries replace.
    A file that lacks a required entry raises when it is read.
    """
    cut = F.split("text", r"(?m)^---\s*$", 3)
    lines = F.filter(F.split(F.get(cut, F.lit(1)), "\n"), lambda x: x.contains(":"))
    own = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", "")))))
    has = F.col("text").rlike(r"^\s*---") & (F.size(cut) == 3)
    empty = F.create_map().cast("map<string,string>")
    df = files.select("filename", F.when(has, own).otherwise(empty).alias("own"), F.when(has, trimmed(F.get(cut, F.lit(2)))).otherwise(F.col("text")).alias("body"))
    if registry is not None:
        df = df.join(registry.select("filename", F.col("meta").alias("base")), "filename", "left")
        merged = F.map_concat(F.map_filter(F.coalesce("base", empty), lambda k, _: ~F.map_contains_key("own", k)), F.col("own"))
        df = df.withColumn("own", merged)
    for name in required:
        df = df.withColumn("own", F.when(F.coalesce(F.try_element_at("own", F.lit(name)), F.lit("")) != "", F.col("own")).otherwise(F.raise_error(F.concat(F.col("filename"), F.lit(f" lacks {name}"))).cast("map<string,string>")))
    return df.select("filename", F.col("own").alias("meta"), "body")


def vectors(df: DataFrame, id_col: str = "vec_id", with_vectors: bool = True, skip: str | None = None) -> DataFrame:
    """The vector table, payload with or without vectors (a column not asked for is not read)."""
    df = df.where(f"NOT ({skip})") if skip else df
    return df if with_vectors else df.drop("embedding")


def index_census(index: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: points, distinct documents, expected documents that the index lacks."""
    have = index.select(key).distinct()
    lost = expected.select(key).distinct().join(have, key, "left_anti").agg(F.count("*").alias("n_missing"))
    return index.agg(F.count("*").alias("n_points"), F.count_distinct(key).alias("n_documents")).join(lost)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order that decides ties."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cached(spark: SparkSession, path: str, build, rows: int) -> DataFrame:
    """The Parquet cache at ``path`` if it holds so many rows; else built and written anew."""
    try:
        df = spark.read.parquet(path)
        if df.count() == rows:
            return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
