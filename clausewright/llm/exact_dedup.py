"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  One scan counts (length, prefix hash) pairs; a pair that
occurs once decides its row without reading the full content again, and a length
that occurs once decides all its rows (a shared pair implies a shared length, so
one partial aggregate gives both levels).  A second scan hashes in full only rows
of shared pairs.  No shuffle carries text: rows travel as id, length and hash.

Defined results
* null text counts as empty, so all null and white-space texts are one group;
* of equal texts the row with the most code points in the original stays, then the
  smallest id; a null id loses against any other;
* rows that repeat an id are each returned; all that carry the kept id are kept;
* an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.scratch import SPACE, Scratch, below, pick, text_or_empty

#: Code points of the normalised text that the second level hashes.
PREFIX = 256
#: Shared (length, prefix) pairs up to which they are broadcast: 20 bytes each.
BROADCAST_PAIRS = 500_000


def normalised(text):
    return F.regexp_replace(text, SPACE + "+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, broadcast_pairs: int = BROADCAST_PAIRS, digest_all: bool = False) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, digest``.

    ``digest`` is the SHA-256 of the normalised text; it is null for rows that an
    earlier level decided, unless ``digest_all`` asks for every row's.
    """
    work = Scratch(docs.sparkSession, "exact-dedup")
    rows = pick(docs, id=id_col, text=text_col).select("id", F.length(text_or_empty()).alias("n"), normalised(text_or_empty()).alias("norm"))
    rows = rows.select("id", "n", "norm", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("pre"))
    shared = work.keep(rows.groupBy("len", "pre").agg(F.count("*").alias("size")).where("size > 1").select("len", "pre", F.lit(True).alias("shared")))
    if below(shared, broadcast_pairs):
        rows = rows.join(F.broadcast(shared), ["len", "pre"], "left")
        full = F.sha2("norm", 256) if digest_all else F.when(F.col("shared"), F.sha2("norm", 256))
        narrow = work.keep(rows.select("id", "n", "len", full.alias("digest"), F.coalesce("shared", F.lit(False)).alias("shared")))
    else:  # too many pairs to send everywhere: hash in the scan, so that still no text moves
        rows = rows.select("id", "n", "len", "pre", F.sha2("norm", 256).alias("digest"))
        narrow = work.keep(rows.join(shared, ["len", "pre"], "left").select("id", "n", "len", "digest", F.coalesce("shared", F.lit(False)).alias("shared")))
    hashed = narrow.where("shared")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = hashed.groupBy("len", "digest").agg(F.count("*").alias("group_size"), best.alias("best")).select("len", "digest", "group_size", F.col("best.id").alias("keep_id"))
    grouped = hashed.join(groups, ["len", "digest"]).select("id", "keep_id", "group_size", "digest")
    single = narrow.where("not shared").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    return grouped.unionByName(single).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every row and whole text of ``documents``."""
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
