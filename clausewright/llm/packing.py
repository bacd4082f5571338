"""Best-fit packing of tokenised documents into sequences of one capacity.

One Arrow pass turns each text to token ids (plus an end id), cuts those longer
than the capacity, and keeps a narrow row a piece.  The histogram of piece lengths,
at most ``capacity`` numbers, goes to ``bins.pack``.  Its plan assigns, per length,
runs of ranks to sequences; a piece's rank among those of its length is counted per
hash bucket with a running total over buckets, so that no task holds all pieces of a
common length.

A worker keeps ids of words it has met, about ``CACHE`` in two generations: the vocabulary's pieces
never cross white space, so a text's ids are its words' ids in a row.

Defined results
* a null or empty text is its end id alone; texts of any length are tokenised whole;
* rows that repeat an id are documents of their own; a null id is carried along;
* equal lengths are ranked by hash bucket, then id, so a plan does not depend on the
  order of rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm import bins, textvec
from clausewright.llm.scratch import Scratch, pick

CAPACITY, END = 4096, 1
#: Bytes of texts split into words together.
SLICE = 4_000_000
#: Words whose ids a worker keeps; pieces ranked together; words whose ids are put together at once.
CACHE, BUCKET, GATHER = 300_000, 200_000, 1 << 17
#: Signs that the vocabulary never joins to letters before them, and the ending of its tokens that end a run of letters or signs.
SIGNS, WORD_END = ".,;:!?#$%&*|", "</w>"
#: Letters known to stay one letter in lower case (others may become a letter and a mark, which joins the sign), then signs.
LETTERS_SIGNS = re.compile(f"([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([{re.escape(SIGNS)}]*)")


class Encoder:
    """Little-endian ids by word, filled as words come."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one text at a time: threads would only hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.now, self.old = Tokenizer.from_file(path), {"": b""}, {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for w, k in vocabulary.items() if w.endswith(WORD_END)]] = True

    def missing(self, words: set[str]) -> set[str]:
        """Words met neither in this generation nor in the one before, whose ids are taken over."""
        new = words.difference(self.now)
        again = self.old.keys() & new
        self.now.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return new - again

    def learn(self, words: set[str]) -> None:
        if len(self.now) > CACHE // 2:
            self.now, self.old = {"": b""}, self.now
        plain, signed, others = set(), [], []
        for w in self.missing(words):
            m = LETTERS_SIGNS.fullmatch(w)
            if m is None:
                others.append(w)
                continue
            letters, signs = m.groups()
            letters = letters.lower()
            plain.add(letters)
            if letters != w:
                plain.add(signs)
                signed.append((w, letters, signs))
        self._encode_plain(list(self.missing(plain)))
        self._encode(others)
        now = self.now
        for w, letters, signs in signed:
            now[w] = now[letters] + now[signs]

    def _encode_plain(self, words: list[str]) -> None:
        """Words that the vocabulary never cuts apart: each ends with the one token that carries the mark of a word's end."""
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(cut) != len(part):
                self._encode(part)
                continue
            data = ids.tobytes()
            self.now.update(zip(part, map(data.__getitem__, map(slice, [0, *cut], cut)), strict=True))

    def _encode(self, words: list[str]) -> None:
        """Many words as one text; each token belongs to the word that its offset lies in."""
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *[len(w) + 1 for w in part]])
            ids, offsets = np.array(found.ids, "<u4"), np.array(found.offsets, np.int64).reshape(-1, 2)
            cut = (np.searchsorted(offsets[:, 0], starts) * 4).tolist()
            data = ids.tobytes()
            for k, w in enumerate(part):
                self.now[w] = data[cut[k] : cut[k + 1]]

    def ids(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text, four bytes an id."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        for first, _, off in textvec.slices(column, SLICE):
            words = pc.ascii_split_whitespace(column.slice(first, len(off) - 1).fill_null(""))
            coded = words.flatten().dictionary_encode()
            known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            self.learn(set(known))
            found = list(map(self.now.__getitem__, known))
            flat, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
            begin, index = np.cumsum(size) - size, coded.indices.to_numpy()
            end = np.cumsum(size[index])
            data = b"".join(self._gather(flat, begin[index[at : at + GATHER]], size[index[at : at + GATHER]]) for at in range(0, len(index), GATHER))
            at = (4 * np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])]).tolist()
            del words, coded, known, found, flat, size, begin, index, end
            textvec.give_back()
            yield from map(data.__getitem__, map(slice, at, at[1:]))

    @staticmethod
    def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
        """The runs flat[begin : begin + size] one after the other."""
        place = np.repeat(begin - (np.cumsum(size) - size), size)
        place += np.arange(len(place))
        return flat[place].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, crc`` and, if asked for, ``ids``: a row per piece."""
    base = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind, mark = base.schema["id"].dataType.simpleString(), np.array([end], "<u4").tobytes()
    schema = f"id {kind}, piece int, start long, length int, crc long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, ids in enumerate(encoder(tokenizer).ids(b.column(1))):
                ids += mark
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, "<i4"))
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(n, c.type) for n, c in zip(["id", "piece", "start", "length", "crc", "ids"], columns, strict=False)]))

    return base.mapInArrow(run, schema)


def assign(found: DataFrame, plan: bins.Plan, total: int) -> DataFrame:
    """``found`` with ``sequence_id`` and ``offset``."""
    length, first, each, base, place = [], [], [], [], []
    used: dict[int, int] = {}
    sequences = 0
    for filling, n in plan:
        offset = 0
        for size, k in filling:
            length.append(size)
            first.append(used.get(size, 0))
            each.append(k)
            base.append(sequences)
            place.append(offset)
            used[size] = used.get(size, 0) + k * n
            offset += size * k
        sequences += n
    order = np.lexsort((first, length))
    runs = [np.array(x, np.int64)[order] for x in (length, first, each, base, place)]
    key = runs[0] * (1 << 48) + runs[1]
    buckets = max(1, -(-total // BUCKET))
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = bucketed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")) - 1)
    ranked = within.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "bucket")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id long, offset long"
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(len(names)).to_numpy().astype(np.int64), b.column(len(names) + 1).to_numpy()
            at = np.searchsorted(key, size * (1 << 48) + rank, "right") - 1
            over = rank - runs[1][at]
            columns = [*b.columns[: len(names)], pa.array(runs[3][at] + over // runs[2][at]), pa.array(runs[4][at] + over % runs[2][at] * size)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return ranked.select(*names, F.col("length").alias("size"), "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id, piece, start, length, crc[, ids], sequence_id, offset``."""
    found = Scratch(docs.sparkSession, "packing").keep(pieces(docs, tokenizer, capacity, end, id_col, text_col, with_ids))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    return assign(found, bins.pack(counts, capacity), sum(counts.values()))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every whole text of ``documents`` in sequences of 4096 tokens."""
    import public_tokenizers

    found = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
