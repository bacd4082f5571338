"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

A window is ``window`` consecutive words.  Every window has an anchor, the leftmost
of its ``gram``-word grams with the smallest hash, so equal windows have equal
anchors.  The windows that share an anchor occurrence form a *reference block*: a
run of 1 to ``window - gram + 1`` starts, whose hash covers all its words.

The *reference* is every distinct block, indexed at its first occurrence (least id, then place).

1. anchors     Grams that occur once in the corpus decide their windows: nothing to
               find.  One narrow aggregate over the anchors, a seventh of all words.
2. index       Blocks with a repeated anchor are looked up in the reference.  All but
               a block's first occurrence get the place they repeat.
3. boundaries  Where a factor may end lie blocks that repeat nothing as a whole: they
               hold the ends of copied passages, and passages shorter than a block.
               These are looked up window by window among themselves; as a block's
               later copies repeat its windows, that finds every earlier start.
4. factors     Each document is parsed greedily from its first word on: a factor starts
               at the next start with a place in the reference and goes on, over blocks
               and the windows at their borders, as long as the reference goes on with
               the same words from the same place.  A factor has ``window`` words or
               more, and is a duplicate span.

Spans are the union of all factors, so a word is removed exactly if a window that covers
it also starts earlier.  A block's key has 128 bits (its own and
its anchor's hash), a window's 96.  Shuffles carry hashes and positions, counted before they are joined
back, and no text: lists of positions go to the texts, by broadcast while they are
small and by a join on the id beyond.  Text is read three times instead.  Keys of
``HOT`` rows or more are joined by broadcast: there is one for every ``HOT`` rows at most.

Defined results
* null and empty texts have no words; so do texts of white space only;
* a text shorter than the window loses nothing; long texts are read whole;
* rows without an id are returned whole, neither searched nor indexed;
* rows that repeat an id and text are one document and lose the same words; an id
  should not be given to different texts: they would share their spans;
* an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm import textvec
from clausewright.llm.scratch import Scratch, pick, text_or_empty

WINDOW, GRAM = 20, 8
#: Bytes of position lists up to which they are broadcast.
BROADCAST_BYTES = 48 << 20
#: Rows of a key from which it is joined apart, and such keys up to which they are broadcast.
HOT, BROADCAST_KEYS = 100_000, 100_000
#: Sorted spans that touch or overlap made one.
MERGED = (
    "aggregate(spans, cast(array() as array<struct<lo:int,hi:int>>), (got, x) -> case when size(got) = 0 or x.lo > element_at(got, -1).hi then concat(got, array(x))"
    " when x.hi <= element_at(got, -1).hi then got else concat(slice(got, 1, size(got) - 1), array(named_struct('lo', element_at(got, -1).lo, 'hi', x.hi))) end)"
)
BASES = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


class Layout:
    """Words, valid windows and blocks of a slice of texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int, gram: int):
        starts, ends, self.at = textvec.words(data, off)
        self.h = textvec.word_hashes(data, starts, ends)
        self.window, n = window, len(self.h)
        stop = np.repeat(self.at[1:], np.diff(self.at))
        self.valid = np.flatnonzero(np.arange(n) + window <= stop)
        self.grams = textvec.grams(self.h, gram)
        if not len(self.valid):
            self.owner = self.lo = self.count = self.anchor = np.zeros(0, np.int64)
            return
        least, where = self.grams[self.valid], np.zeros(len(self.valid), np.int64)
        for k in range(1, window - gram + 1):
            g = self.grams[self.valid + k]
            less = g < least
            least, where = np.where(less, g, least), np.where(less, k, where)
        owner = self.valid + where
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        self.anchor, self.lo = owner[first], self.valid[first]
        self.count = np.diff(np.concatenate([first, [len(owner)]]))

    def doc(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, word, "right") - 1

    def spans(self, lo: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit and a 32-bit hash of the words [lo, lo + length)."""
        out = []
        for base in BASES:
            inverse = pow(base, -1, 1 << 64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * textvec.powers(len(self.h), np.uint64(base)))])
            value = (total[lo + length] - total[lo]) * textvec.powers(len(self.h) + 1, np.uint64(inverse))[lo]
            out.append(textvec.mix64(value + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def marked(self, lists: pa.ListArray) -> np.ndarray:
        """Flags on the words whose places in their texts are listed."""
        flag = np.zeros(len(self.h) + 1, bool)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        place = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(size)), size)
        inside = place < np.diff(self.at)[text]
        flag[self.at[text[inside]] + place[inside]] = True
        return flag


def _scan(base: DataFrame, schema: str, find, window: int, gram: int) -> DataFrame:
    """``find(layout, lists)`` over all slices; returns columns after the id, given by text number first."""
    kind = base.schema["id"].dataType.simpleString()
    names = ["id", *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, off in textvec.slices(b.column(1)):
                n = len(off) - 1
                layout = Layout(data, off, window, gram)
                text, *columns = find(layout, b.column(2).slice(first, n) if b.num_columns > 2 else None)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text + first)), *[pa.array(c) for c in columns]], names)

    return base.mapInArrow(run, f"id {kind}, {schema}")


def _attach(base: DataFrame, lists: DataFrame, values: str, how: str, limit: int) -> DataFrame:
    """``base`` with the list column of ``lists`` by id."""
    size = lists.agg(F.coalesce(F.sum(F.size(values) * 8 + 24), F.lit(0)).alias("bytes")).first()["bytes"]
    return base.join(F.broadcast(lists) if size <= limit else lists, "id", how).select(*base.columns, values)


def _meet(rows: DataFrame, keys: DataFrame, key: list[str], work: Scratch, hot: int) -> DataFrame:
    """``rows`` joined with ``keys`` (key, n, ...) without ``n``; keys of ``hot`` rows or more don't go to one task."""
    keys = work.keep(keys)
    some = keys.where(F.col("n") >= hot).drop("n")
    if not 0 < some.count() <= BROADCAST_KEYS:
        return rows.join(keys.drop("n"), key)
    rest = rows.join(F.broadcast(some.select(*key)), key, "left_anti").join(keys.where(F.col("n") < hot).drop("n"), key)
    return rest.unionByName(rows.join(F.broadcast(some), key))


def _repeated(rows: DataFrame, key: list[str], work: Scratch, hot: int) -> DataFrame:
    """``id, lo, n, ref, ref_lo``: ``rows`` whose key also occurs earlier, with the least (id, lo) of their key."""
    firsts = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("id", "lo")).alias("first")).where("n > 1")
    found = _meet(rows.withColumnRenamed("n", "starts"), firsts, key, work, hot).where(F.struct("id", "lo") != F.col("first"))
    return found.select("id", "lo", F.col("starts").alias("n"), F.col("first.id").alias("ref"), F.col("first.lo").alias("ref_lo"))


def _parse(found: DataFrame) -> DataFrame:
    """Greedy factors of runs of starts: rows that follow each other in their document and in the reference made one."""
    rows = found.repartition("id").dropDuplicates(["id", "lo"])
    order = Window.partitionBy("id").orderBy("lo")
    goes_on = F.lag(F.struct(F.col("lo") + F.col("n"), "ref", F.col("ref_lo") + F.col("n"))).over(order).eqNullSafe(F.struct("lo", "ref", "ref_lo"))
    rows = rows.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("factor", F.sum("new").over(order))
    return rows.groupBy("id", "factor").agg(F.min("lo").alias("lo"), F.sum("n").cast("int").alias("n"), F.min(F.struct("lo", "ref", "ref_lo")).alias("at")).select("id", "lo", "n", "at.ref", "at.ref_lo")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """``id, lo, hi, ref, ref_lo``: the words [lo, hi) of a document that repeat those from ``ref_lo`` on of document ``ref``, an earlier start."""
    work = Scratch(docs.sparkSession, "substring-dedup")
    base = pick(docs, id=id_col, text=text_col).where("id IS NOT NULL").select("id", text_or_empty().alias("text"))

    def blocks(x: Layout, _):
        text = x.doc(x.lo)
        return text, x.grams[x.anchor].view(np.int64), x.spans(x.lo, x.count + x.window - 1)[0], (x.lo - x.at[text]).astype(np.int32), x.count.astype(np.int32)

    every = work.keep(_scan(base, "anchor long, h long, lo int, n int", blocks, window, gram))
    twice = every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    found = work.keep(_meet(every, twice, ["anchor"], work, hot))
    work.drop(every)
    repeated = work.keep(_repeated(found, ["anchor", "h"], work, hot))
    later = repeated.select("id", "lo").distinct()
    left = work.keep(found.join(later, ["id", "lo"], "left_anti").groupBy("id").agg(F.collect_set("lo").alias("places")))

    def windows(x: Layout, lists: pa.ListArray):
        at = np.flatnonzero(x.marked(lists)[x.lo])
        n = x.count[at]
        lo = np.repeat(x.lo[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = x.doc(lo)
        return text, (lo - x.at[text]).astype(np.int32), *x.spans(lo, np.full(len(lo), x.window))

    single = work.keep(_scan(_attach(base, left, "places", "inner", broadcast_bytes), "lo int, h long, c int", windows, window, gram))
    work.drop(found, left)
    more = _repeated(single.withColumn("n", F.lit(1)), ["h", "c"], work, hot)
    found = work.keep(_parse(repeated.unionByName(more)).select("id", "lo", (F.col("lo") + F.col("n") + F.lit(window - 1)).alias("hi"), "ref", "ref_lo"))
    work.drop(repeated, single)
    return found


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """``id, spans``: per document with any, the word ranges [lo, hi) that its factors cover."""
    found = factors(docs, id_col, text_col, window, gram, broadcast_bytes, hot)
    spans = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")).select("id", F.expr(MERGED).alias("spans"))
    return Scratch(docs.sparkSession, "substring-spans").keep(spans)


def removed(base: DataFrame, spans: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id, n_words, n_removed, kept``: each text's words outside its spans, joined by one space.  ``base``: id, text."""
    joined = _attach(base.select("id", text_or_empty().cast("binary").alias("text")), spans, "spans", "left", broadcast_bytes)
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            for raw, cut in zip(b.column(1), b.column(2), strict=True):
                words = raw.as_py().split()  # bytes split at exactly the white space of the contract
                n, k, out, at = len(words), 0, [], 0
                for s in cut.as_py() or ():
                    if s["lo"] > at:
                        out += words[at : s["lo"]]
                    k += max(0, min(s["hi"], n) - max(s["lo"], at))
                    at = max(at, s["hi"])
                total.append(n)
                gone.append(k)
                kept.append(b" ".join(out + words[at:] if at else words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: ``id, n_words, n_removed, kept`` (the text that is left)."""
    return removed(pick(docs, id=id_col, text=text_col), duplicate_spans(docs, id_col, text_col, window, gram))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every whole text of ``documents``, windows of 20 words."""
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
