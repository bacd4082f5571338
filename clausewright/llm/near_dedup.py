"""Near-duplicates by an LSH forest over min-hash signatures, confirmed on full shingle sets.

Signature.  ``trees * depth`` min-hashes of a text's set of word shingles; tree t
orders texts by its ``depth`` values.  Texts with equal sets are one class from the
start, stood for by their smallest id, so copies never meet as pairs.

Candidates.  In each tree texts that share a prefix of ``start`` values form a
region, whatever its size; the other values of ``depth`` order it.  ``start`` is the
depth at which a pair at the threshold is missed by all trees with probability below
``MISS``.  Regions of more than ``crowd`` texts are dealt out for the sorting of step 1
only.

Links are found in two steps, so that a region of m similar texts costs m links and
not m * m pairs:
1. every text and one neighbour with which it shares a prefix in sorted order, the one
   that the most trees give, are compared on their full sets; links make components;
2. only regions that still hold several components go on, once each whichever trees
   gave them.  Their sets are compared between components, in blocks of bounded
   size (a block with itself and with each other, whatever the region's size); pairs
   whose signatures differ by more than chance allows are passed over, the rest are
   confirmed in full, and a pair that confirmed links already join is not needed.

All links with a confirmed Jaccard similarity of at least ``percent`` in 100 are so
respected in components, but for those missed by all trees or by signature chance
(``Z`` standard deviations).

Defined results
* null or empty texts, and texts of white space only, have no shingles and link with
  nothing; fewer words than a shingle are one shingle;
* ties: a component is named by its smallest id, and that document is kept;
* rows that repeat an id and text are in one class and all kept or dropped alike; an
  id given to different texts links them; a row without an id comes back as its own
  component, named null, and kept;
* texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import textvec
from clausewright.llm.graph import components
from clausewright.llm.scratch import Scratch, pick, text_or_empty

TREES, DEPTH, MISS, Z = 16, 8, 2e-5, 4.0
#: Texts of a region above which step 1 deals it out; shingles in a block of a region; ids up to which they are broadcast.
CROWD, BLOCK, BROADCAST_IDS = 20_000, 300_000, 1_000_000


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets, each sorted, one after another, and their offsets."""
    data = textvec.LOWER[data]
    starts, ends, at = textvec.words(data, off)
    h = textvec.word_hashes(data, starts, ends)
    n, count = len(off) - 1, np.diff(at)
    first = np.arange(len(h))
    doc = np.repeat(np.arange(n), count)
    whole = first + size <= np.repeat(at[1:], count)
    value, owner = textvec.grams(h, size)[first[whole]], doc[whole]
    for k in np.flatnonzero((count > 0) & (count < size)):
        short = textvec.grams(h[at[k] : at[k + 1]], int(count[k]))
        value, owner = np.append(value, short ^ np.uint64(0x5851F42D4C957F2D * int(count[k]) % (1 << 64))), np.append(owner, k)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(n + 1))


def signatures(value: np.ndarray, off: np.ndarray, hashes: int) -> np.ndarray:
    """A row of ``hashes`` min-hashes for each set that isn't empty."""
    full = off[:-1][np.diff(off) > 0]
    factor = textvec.mix64(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
    add = textvec.mix64(np.arange(hashes + 1, 2 * hashes + 1, dtype=np.uint64))
    out = np.empty((len(full), hashes), np.uint32)
    for k in range(hashes if len(full) else 0):
        out[:, k] = np.minimum.reduceat(((value * factor[k] + add[k]) >> np.uint64(32)).astype(np.uint32), full)
    return out


def _fingerprints(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x27D4EB2F165667C5):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textvec.mix64(value + np.uint64(seed)))])
        out.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return out[0], out[1]


def described(base: DataFrame, size: int, hashes: int) -> DataFrame:
    """``id, n, f, g, sig`` of id, text: set size, fingerprint in two halves, signature (null for an empty set)."""
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, off in textvec.slices(b.column(1)):
                value, at = shingle_sets(data, off, size)
                n = np.diff(at)
                sig = np.full(len(n), None, object)
                sig[n > 0] = [row.tobytes() for row in signatures(value, at, hashes).astype("<u4")]
                f, g = _fingerprints(value, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(n)), pa.array(n.astype(np.int64)), pa.array(f), pa.array(g), pa.array(sig.tolist(), pa.binary())], ["id", "n", "f", "g", "sig"])

    return base.mapInArrow(run, f"id {kind}, n long, f long, g long, sig binary")


def full_sets(base: DataFrame, size: int) -> DataFrame:
    """``id, set`` of id, text: the sorted shingle hashes."""
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, off in textvec.slices(b.column(1)):
                value, at = shingle_sets(data, off, size)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(off) - 1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))], ["id", "set"])

    return base.mapInArrow(run, f"id {kind}, set array<long>")


def start_depth(percent: int, trees: int, depth: int) -> int:
    """The deepest prefix at which all trees miss a pair at the threshold with probability below MISS."""
    fit = [d for d in range(1, depth + 1) if (1 - (percent / 100) ** d) ** trees <= MISS]
    return max(fit, default=1)


def regions(classes: DataFrame, trees: int, depth: int, start: int, work: Scratch) -> DataFrame:
    """``key, label, id, m`` of classes (id, sig): texts that share a prefix with another, by region of m texts."""
    width = 4 * depth
    rows = classes.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("id", "tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("label"))
    keyed = rows.withColumn("key", F.xxhash64("tree", F.expr(f"substring(label, 1, {4 * start})")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return work.keep(keyed.join(sizes, "key").select("key", "label", "id", "m"))


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, x, y) whose sets x and y are similar enough."""
    both = F.size(F.array_intersect("x", "y"))
    return rows.withColumn("both", both).where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def between(rows: DataFrame, percent: int, hashes: int, kind: T.DataType) -> DataFrame:
    """Confirmed links (a, b) between components in each block group of ``rows`` (key, i, j, id, part, set)."""
    s = percent / 100
    least = math.floor(hashes * s - Z * math.sqrt(hashes * s * (1 - s)))
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, parts = table.column("id").to_pylist(), table.column("part").to_pylist()
        flat = table.column("set").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        off = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy())]).astype(np.int64)
        value = flat.flatten().to_numpy().view(np.uint64)
        size, sig = np.diff(off), signatures(value, off, hashes)
        root = {p: p for p in parts}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        for i in range(len(ids) - 1):
            low, high = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
            near = np.flatnonzero(100 * low >= percent * high) + i + 1
            if not len(near):
                continue
            near = near[(sig[near] == sig[i]).sum(1) >= least]
            mine = value[off[i] : off[i + 1]]
            for j in near:
                if find(parts[i]) == find(parts[j]):
                    continue
                both = len(np.intersect1d(mine, value[off[j] : off[j + 1]], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    root[find(parts[i])] = find(parts[j])
                    a.append(ids[i])
                    b.append(ids[j])
        t = table.schema.field("id").type
        return pa.table({"a": pa.array(a, t), "b": pa.array(b, t)})

    return rows.groupBy("key", "i", "j").applyInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """One row per document: ``id, n_shingles, component, kept``."""
    work = Scratch(docs.sparkSession, "near-dedup")
    base = pick(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("text"))
    kind = base.schema["id"].dataType
    all_ = work.keep(described(base, size, trees * depth))
    classes = work.keep(all_.where("id IS NOT NULL AND n > 0").groupBy("f", "g").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n")))
    found = regions(classes, trees, depth, start_depth(percent, trees, depth), work)

    # 1. each text's most frequent neighbour in sorted order (a crowd is dealt out)
    shares = F.ceil(F.col("m") / F.lit(crowd)).cast("int")
    pairs = found.withColumn("share", F.pmod(F.xxhash64("id"), shares)).selectExpr("id AS b", "lag(id) OVER (PARTITION BY key, share ORDER BY label, id) AS a").where("a IS NOT NULL AND a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("times"))
    best = pairs.groupBy("b").agg(F.max_by("a", "times").alias("a")).select("a", "b")
    members = work.keep(found.select("id").distinct())
    if members.count() <= BROADCAST_IDS:
        members = F.broadcast(members)
    sets = work.keep(full_sets(base.join(members, "id", "left_semi"), size).groupBy("id").agg(F.first("set").alias("set")))
    compared = best.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    links = work.keep(linked(compared, percent))
    first = components(links, work)

    # 2. regions that hold several components, each distinct one once
    parted = found.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("part"))
    parted = work.keep(parted.join(classes.select("id", "n"), "id"))
    mixed = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), F.count("*").alias("m"), F.sum("n").alias("weight")).where("low <> high")
    mixed = mixed.groupBy("who", "m").agg(F.min_by(F.struct("key", "weight"), "key").alias("one")).select("one.key", F.ceil(F.col("one.weight") / F.lit(block)).cast("int").alias("blocks"))
    rows = parted.join(mixed, "key").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    rows = rows.select("key", "id", "part", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", "id", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    more = work.keep(between(rows.join(sets, "id").select("key", "i", "j", "id", "part", "set"), percent, trees * depth, kind))
    final = components(first.toDF("a", "b").unionByName(more), work)
    work.drop(parted, sets, links, more)

    named = classes.select("f", "g", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("f", "g", F.coalesce("root", "id").alias("component"))
    full = all_.where("id IS NOT NULL AND n > 0").select("id", "n", "f", "g").join(named, ["f", "g"]).select("id", "n", "component")
    rest = all_.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component"))
    return full.unionByName(rest).select("id", F.col("n").alias("n_shingles"), "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every whole text of ``documents``, three-word shingles, similarity of 0.85 or more."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
