"""Quality classifier: regularised quadratic discriminant on document statistics.

Texts become ``FEATURES`` transformed statistics in one Arrow pass.  Per class, the
sums of the statistics and of their products over all labelled rows - an ordinary
partial aggregate that returns two rows - give means and covariances; these are
shrunk towards the pooled covariance and towards its diagonal, and each class keeps
the inverse of its Cholesky factor.  A document's score is the logistic function
of the difference of the two log densities plus the log odds of the classes.

Nothing but the text enters a score.  Labels are read only from rows that ``learn``
admits.

Defined results
* a null or empty text has the statistics of a text without words, and a score;
* rows that repeat an id are each scored, alike if their texts are; a null id counts
  as the empty text for the held-out split and never matches a label;
* labels without a class are ignored; an id labelled twice counts twice;
* with labels of one class only every score is that class; with none 0.5;
* an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm import textvec
from clausewright.llm.scratch import Scratch, pick

FEATURES = ("words", "word_bytes", "symbols", "upper", "exclaim", "stops", "digits", "lines", "quotes", "entropy", "distinct", "shouted", "echo")
#: Share of the pooled covariance in a class's, and of the pooled diagonal in both.
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
#: Probability from which a document counts as good.
GOOD_AT = 0.7

_KIND = {name: np.isin(np.arange(256), list(chars)) for name, chars in (("symbols", b"#*$%&|<>"), ("exclaim", b"!"), ("stops", b".,;:?"), ("digits", b"0123456789"), ("lines", b"\n"), ("quotes", b"\"'()[]{}=_/\\^~`@+"))}
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
#: First bytes of characters beyond ASCII count as letters, as do A-Z and a-z.
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0xC0)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, data, off in textvec.slices(column):
        n = len(off) - 1
        starts, ends, at = textvec.words(data, off)
        count = np.diff(at).astype(float)
        total = np.diff(off).astype(float)
        doc = np.repeat(np.arange(n), np.diff(off))
        hist = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
        w, size = np.maximum(count, 1), np.maximum(total, 1)
        f = out[first : first + n]
        f[:, 0] = np.log1p(count)
        letters = np.maximum(hist[:, _LETTER].sum(1), 1)
        word_doc = np.repeat(np.arange(n), np.diff(at))
        f[:, 1] = np.log1p(np.bincount(word_doc, ends - starts, n) / w)
        f[:, 2] = np.sqrt(hist[:, _KIND["symbols"]].sum(1) / w)
        f[:, 3] = np.sqrt(hist[:, _UPPER].sum(1) / letters)
        f[:, 4] = np.sqrt(hist[:, _KIND["exclaim"]].sum(1) / w)
        f[:, 5] = np.sqrt(hist[:, _KIND["stops"]].sum(1) / w)
        f[:, 6] = np.sqrt(hist[:, _KIND["digits"]].sum(1) / size)
        f[:, 7] = np.sqrt(hist[:, _KIND["lines"]].sum(1) / w)
        f[:, 8] = np.sqrt(hist[:, _KIND["quotes"]].sum(1) / size)
        p = hist / size[:, None]
        f[:, 9] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
        if len(starts):
            h = textvec.word_hashes(data, starts, ends)
            order = np.lexsort((h, word_doc))
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(word_doc[order]) != 0) | (h[order][1:] != h[order][:-1])
            # distinct words fall with length by themselves; their share of a power of the count hardly does
            f[:, 10] = np.log1p(np.bincount(word_doc[order], new, n)) - 0.85 * np.log1p(count)
            echo = np.zeros(len(h), bool)
            echo[1:] = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])
            f[:, 12] = np.sqrt(np.bincount(word_doc, echo, n) / w)
            shout = np.isin(data[ends - 1], np.frombuffer(b"!#$%&*|<>", np.uint8))
            f[:, 11] = np.sqrt(np.bincount(word_doc, shout, n) / w)
    return out


@dataclass
class Model:
    """Shift and scale of the statistics; for each class its share, mean, inverse Cholesky factor and log determinant."""

    shift: np.ndarray
    scale: np.ndarray
    share: dict[int, float]
    mean: dict[int, np.ndarray]
    whiten: dict[int, np.ndarray]
    logdet: dict[int, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if len(self.mean) < 2:
            return np.full(len(x), float(next(iter(self.mean))) if self.mean else 0.5)
        z, log = (x - self.shift) / self.scale, {}
        for k in (0, 1):
            d = (z - self.mean[k]) @ self.whiten[k].T
            log[k] = np.log(self.share[k]) - self.logdet[k] - 0.5 * (d * d).sum(1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """From each class's row count, sums and sums of products."""
    d = len(FEATURES)
    sums = {k: v for k, v in sums.items() if v[0] > 0}
    n = sum(v[0] for v in sums.values())
    shift = sum((v[1] for v in sums.values()), np.zeros(d)) / max(n, 1)
    spread = sum((np.diag(v[2]) for v in sums.values()), np.zeros(d)) / max(n, 1) - shift**2
    scale = np.sqrt(np.maximum(spread, 1e-9))
    mean = {k: (v[1] / v[0] - shift) / scale for k, v in sums.items()}
    own = {k: (v[2] / v[0] - np.outer(v[1], v[1]) / v[0] ** 2) / np.outer(scale, scale) for k, v in sums.items()}
    pooled = sum((v[0] / n * own[k] for k, v in sums.items()), np.zeros((d, d)))
    model = Model(shift, scale, {k: v[0] / n for k, v in sums.items()}, mean, {}, {})
    for k in sums:
        s = (1 - to_pooled) * own[k] + to_pooled * pooled
        s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        low = np.linalg.cholesky((s + s.T) / 2)
        model.whiten[k], model.logdet[k] = np.linalg.inv(low), float(np.log(np.diag(low)).sum())
    return model


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, f0, f1, ...``; one Arrow pass."""
    base = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["id", *[f"f{i}" for i in range(x.shape[1])]])

    return base.mapInArrow(run, f"id {kind}, " + ", ".join(f"f{i} double" for i in range(len(FEATURES))))


def learn(found: DataFrame, labels: DataFrame, admit: Column | None = None, label_col: str = "quality", label_id: str = "doc_id") -> Model:
    """The model of ``features`` and ``labels``; ``admit`` says of which ids labels may be read."""
    given = pick(labels, label_id=label_id, label=label_col).where(F.col("label").isin(0, 1))
    rows = found.join(given, found["id"] == given["label_id"])
    if admit is not None:
        rows = rows.where(admit)
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    total = rows.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(f"f{i}").alias(f"s{i}") for i in range(d)], *[F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"p{i}_{j}") for i, j in pairs])
    sums = {}
    for r in total.collect():  # two rows
        p = np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        sums[int(r["label"])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), p)
    return fit(sums)


def scored(found: DataFrame, model: Model) -> DataFrame:
    """``id, score`` from the table of ``features``."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["id", "score"])

    return found.mapInArrow(run, f"id {kind}, score double")


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column, computed beside the row: nothing is joined."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(column)))

    return run(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_at: float = GOOD_AT) -> DataFrame:
    """One row per document: ``id, held_out, score, predicted``; learnt from labels of rows not held out."""
    found = Scratch(docs.sparkSession, "classifier").keep(features(docs, id_col, text_col))
    model = learn(found, labels, ~held_out(F.col("id")))
    return scored(found, model).select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= good_at).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every whole text of ``documents``."""
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumnRenamed("id", "doc_id")
