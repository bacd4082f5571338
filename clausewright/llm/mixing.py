"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source gets a mean repetition rate ``target rows / its rows``.  A document's
count is the inverse Poisson distribution at a uniform number hashed from (seed,
id), so a lost task repeats the same draw; the row is exploded by its count, and
one hash exchange with a sort by hashed key inside each partition shuffles globally.

A rate above ``CHUNK`` is drawn as a sum of Poisson draws with equal smaller means,
as exp(-rate) would underflow.  Each table of cumulative probabilities ends where
the rest is below 2**-52, the resolution of the uniform number, so nothing is cut.

Defined results
* a null source is a source of its own; a null id draws as the text ``null``;
* rows that repeat an id and source draw the same count; a document of count 0 is
  left out, as sampling means to do; sources without a weight get no rows;
* texts are carried unread, whatever their length; an empty table gives no rows;
* ``copy_index`` replaces an input column of that name; others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.scratch import Scratch, below, place

#: Largest mean drawn at once.
CHUNK = 32
#: Sources up to which their table of rates is broadcast (about 1 kB each).
BROADCAST_SOURCES = 10_000
#: Exponent on a source's rows that gives its weight: 1 keeps shares, 0 makes them equal.
TEMPERATURE = 0.5


def uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5; the same in any engine."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def cumulative(mean: str) -> Column:
    """Array of P(X <= 0), P(X <= 1), ... for a Poisson of that mean (a column of at most CHUNK)."""
    return F.expr(
        f"aggregate(sequence(1, cast(ceil({mean} + 12 * sqrt({mean}) + 40) as int)),"
        f" named_struct('p', exp(-{mean}), 'c', exp(-{mean}), 'all', array(exp(-{mean}))),"
        f" (s, k) -> named_struct('p', s.p * {mean} / k, 'c', s.c + s.p * {mean} / k, 'all', concat(s.all, array(s.c + s.p * {mean} / k))),"
        " s -> s.all)"
    )


def rates(sizes: DataFrame, weights: DataFrame | None, epochs: float, temperature: float) -> DataFrame:
    """``source, rate, chunks, cdf`` from ``source, rows``; a row per source."""
    sizes = sizes.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(float(temperature)))) if weights is None else sizes.join(weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight")), F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    total = sizes.agg(F.sum("rows").alias("all_rows"), F.sum("weight").alias("all_weight"))
    found = sizes.join(F.broadcast(total), F.lit(True)).withColumn("rate", F.col("weight") / F.col("all_weight") * F.col("all_rows") * F.lit(float(epochs)) / F.col("rows"))
    found = found.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(CHUNK))).cast("int")).withColumn("mean", F.col("rate") / F.col("chunks"))
    return found.select("source", "rate", "chunks", cumulative("mean").alias("cdf"))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE, seed: int = 7, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as drawn, globally shuffled, with ``copy_index`` (long, from 0).

    ``weights`` (``source, weight``) states target shares; without it a source's
    weight is its rows to the power ``temperature``.  ``epochs`` times the rows of
    the weighted sources come out on average.
    """
    i, s, names = place(docs, id_col), place(docs, source_col), list(docs.columns)
    flat = docs.toDF(*[f"c{k}" for k in range(len(names))])
    sizes = flat.groupBy(F.col(f"c{s}").alias("source")).agg(F.count("*").alias("rows"))
    table = Scratch(docs.sparkSession, "mixing").keep(rates(sizes, weights, epochs, temperature))
    table = F.broadcast(table) if below(table, BROADCAST_SOURCES) else table
    given = F.coalesce(F.col(f"c{i}").cast("string"), F.lit("null"))
    drawn = F.expr("aggregate(transform(us, u -> size(filter(cdf, c -> c <= u))), 0, (a, b) -> a + b)")
    joined = flat.join(table, flat[f"c{s}"].eqNullSafe(table["source"]))
    us = F.transform(F.sequence(F.lit(1), F.col("chunks")), lambda k: uniform(F.lit(str(seed)), given, k.cast("string")))
    counted = joined.withColumn("us", us).withColumn("copies", drawn).where("copies > 0")
    copies = counted.select(*flat.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("copy_index"))
    key = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), given, F.col("copy_index").cast("string")))
    shuffled = copies.withColumn("order_key", key).repartition("order_key").sortWithinPartitions("order_key")
    kept = [F.col(f"c{k}").alias(n) for k, n in enumerate(names) if n.lower() != "copy_index"]
    return shuffled.select(*kept, "copy_index")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all of ``documents`` mixed to weights of the square root of a source's rows."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n_rows, pow(count(*)::DOUBLE, {TEMPERATURE}) AS weight FROM documents GROUP BY source
), total AS (SELECT sum(n_rows)::DOUBLE AS all_rows, sum(weight) AS all_weight FROM sizes),
rate AS (
  SELECT source, weight / all_weight * all_rows / n_rows AS rate, greatest(1, ceil(weight / all_weight * all_rows / n_rows / {CHUNK}))::INT AS chunks FROM sizes, total
), cdf AS (
  SELECT source, chunks, rate / chunks AS mean, 0 AS k, exp(-(rate / chunks)) AS p, exp(-(rate / chunks)) AS c FROM rate
  UNION ALL
  SELECT source, chunks, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 40)
), u AS (
  SELECT d.doc_id, d.source, x.i AS chunk,
         (('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || x.i::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(1, r.chunks + 1)) AS x(i)
), n AS (
  SELECT u.doc_id, u.source, count(cdf.k) AS copies
  FROM u LEFT JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY ALL
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, y.i::BIGINT AS copy_index
FROM documents d JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source, unnest(range(0, n.copies)) AS y(i)
"""
