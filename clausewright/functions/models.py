"""External models behind small interfaces, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clausewright.operators.retrieval import hashing_vector


class Embedder(Protocol):
    def column(self, text: Column) -> Column: ...


class HashingEmbedder:
    """The default backend."""

    def __init__(self, dims: int = 768):
        self.dims = dims

    def column(self, text: Column) -> Column:
        return hashing_vector(text, self.dims)


def embed_distinct(df: DataFrame, text_col: str, embedder: Embedder) -> DataFrame:
    """Each distinct text is embedded once and joined back."""
    once = df.select(text_col).distinct().withColumn("embedding", embedder.column(F.col(text_col)))
    return df.join(once, text_col, "left")


class ModelClient(Protocol):
    def answer(self, prompts: pd.Series) -> pd.Series: ...


class StubModel:
    """Answers picked by the prompt's hash from a stated set; no network, the same everywhere."""

    def __init__(self, answers: list[str]):
        self.answers = answers

    def answer(self, prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: self.answers[int(hashlib.sha256((p or "").encode()).hexdigest(), 16) % len(self.answers)])


def ask(df: DataFrame, prompt: Column, client: ModelClient, out: str = "answer") -> DataFrame:
    """A batch of prompts at a time."""

    @F.pandas_udf(StringType())
    def run(p: pd.Series) -> pd.Series:
        return client.answer(p)

    return df.withColumn(out, run(prompt))


def passes(df: DataFrame, n: int) -> DataFrame:
    """N rows for each, numbered, for a sampled generator."""
    return df.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(n))))


def prompt(task: str, *parts: tuple[str, Column]) -> Column:
    """A task and named parts."""
    return F.concat_ws("\n\n", F.lit(task), *[F.concat(F.lit(f"{name}:\n"), F.coalesce(c.cast("string"), F.lit(""))) for name, c in parts])
