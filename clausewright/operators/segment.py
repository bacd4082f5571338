"""Segmentation.

What is a matter of lines is built of Columns; state machines over a document's lines
run in an Arrow function per batch of documents, as one document is never split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.text import header_key, is_caps_title, leading_marker, text
from clausewright.functions.unicode import ratio

INLINE = re.compile(r"(?<=[.;:])\s+(?=(?:\d+(?:\.\d+)+|\(\s?(?:[a-z]|[ivx]{1,4}|\d{1,2})\s?\))\s+[A-Z\"“(])")
HEADING = re.compile(r"^(?:(?:article|section|clause|schedule)\s+[0-9ivxlc]+\b.*|\d+(?:\.\d+)*[.)]?\s+[A-Z][^.]{0,80}|[A-Z][A-Z ,&'/-]{5,99})$", re.I)
START = re.compile(r"^(?:\d+(?:\.\d+)*[.)]?\s+\S|\((?:[a-z]{1,2}|[ivx]+|\d+)\)\s+\S|(?:article|section|clause)\s+[0-9ivxlc]+\b)", re.I)
LEAST, MOST = 40, 3000


def split_line(line: str) -> list[str]:
    """A line cut before markers that follow a sentence mark and open a sentence."""
    return [p.strip() for p in INLINE.split(line) if p.strip()]


def pack_sentences(clause: str, most: int = MOST) -> list[str]:
    """An oversized clause cut at inline markers, else into packs of whole sentences."""
    if len(clause) <= most:
        return [clause]
    out: list[str] = []
    for part in split_line(clause):
        pack = ""
        for s in re.split(r"(?<=[.!?;])\s+", part):
            if pack and len(pack) + 1 + len(s) > most:
                out.append(pack)
                pack = ""
            pack = f"{pack} {s}".strip()
        if pack:
            out.append(pack)
    return out


def split_clauses(raw: str | None, least: int = LEAST, most: int = MOST) -> list[str]:
    """Lines to clauses: a structural start opens one, a bare heading is carried to the next, short ones are joined to the one before."""
    clauses: list[str] = []
    now: list[str] = []
    heading = ""

    def close() -> None:
        nonlocal now, heading
        body = " ".join(now).strip()
        if body:
            whole = f"{heading} {body}".strip()
            if len(whole) < least and clauses:
                clauses[-1] += " " + whole
            else:
                clauses.append(whole)
            heading = ""
        now = []

    for line in (raw or "").splitlines():
        for part in split_line(line.strip()):
            bare = (HEADING.match(part) and len(part) < 100 and not part.rstrip().endswith((".", ";", ","))) and part.isupper()
            if bare:
                close()
                heading = f"{heading} {part}".strip()
            else:
                if START.match(part):
                    close()
                now.append(part)
        if not line.strip() and now:
            close()
    close()
    if heading:
        clauses.append(heading)
    return [p for c in clauses for p in pack_sentences(c, most)]


def clauses(df: DataFrame, key: str, text_col: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``key, clause_index, clause``."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b["t"], strict=True) for i, c in enumerate(split_clauses(t, least, most))]
            yield pd.DataFrame(rows, columns=[key, "clause_index", "clause"])

    return df.select(key, F.col(text_col).alias("t")).mapInPandas(run, f"{key} {kind}, clause_index int, clause string")


def chunks(df: DataFrame, key: str, text_col: str, size: int = 1200, overlap: int = 150) -> DataFrame:
    """G04."""
    t, step = text(text_col), size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < F.length(t)))
    one = df.select(key, t.alias("_t"), F.posexplode(starts).alias("chunk_index", "_s"))
    return one.select(key, "chunk_index", F.substring("_t", F.col("_s") + 1, F.lit(size)).alias("chunk"))


def lines(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key, line_index, line`` of lines that aren't blank."""
    return df.select(key, F.posexplode(F.split(text(text_col), "\n")).alias("line_index", "line")).where("trim(regexp_replace(line, '\\\\s+', ' ')) <> ''")


def edge_keys(df: DataFrame, key: str, text_col: str, edge: int = 2, least: int = 2, longest: int = 180, unicode: bool = True) -> DataFrame:
    """Keys of the first and last lines that several pages share.  A page's lines are ranked inside its array."""
    ls = F.filter(F.transform(F.split(text(text_col), "\n"), lambda x: F.struct(x.alias("line"), header_key(x, unicode).alias("k"))), lambda x: x["k"] != "")
    d = df.select(key, ls.alias("l"))
    ends = F.concat(F.slice("l", 1, edge), F.slice(F.reverse("l"), 1, edge))
    e = d.select(key, F.explode(F.array_distinct(F.transform(F.filter(ends, lambda x: F.length(x["line"]) <= longest), lambda x: x["k"]))).alias("edge_key"))
    return e.groupBy("edge_key").agg(F.count_distinct(key).alias("n_documents")).where(F.col("n_documents") >= least)


def strip_furniture(pages: DataFrame, doc: str, page: str, text_col: str, edge: int = 6, similar: float = 0.9, share: float = 0.5) -> DataFrame:
    """``doc, page, text`` without edge lines that are alike on at least ``share`` of a document's pages.

    A document's pages go to one task: their number is a book's, not a corpus's.
    """
    kinds = dict(pages.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(page)
        split = [(t or "").split("\n") for t in pdf["t"]]
        edges = [[x.strip() for x in (ls[:edge] + ls[-edge:]) if x.strip()] for ls in split]
        groups: list[tuple[str, set[int]]] = []
        for p, es in enumerate(edges):
            for e in dict.fromkeys(re.sub(r"\d+", "#", x.lower()) for x in es):
                for k, at in groups:
                    if ratio(k, e) >= similar:
                        at.add(p)
                        break
                else:
                    groups.append((e, {p}))
        common = [k for k, at in groups if len(at) >= max(2, share * len(split))]

        def furniture(x: str) -> bool:
            k = re.sub(r"\d+", "#", x.strip().lower())
            return bool(k) and any(ratio(c, k) >= similar for c in common)

        out = []
        for ls in split:
            n = len(ls)
            out.append("\n".join(x for i, x in enumerate(ls) if not ((i < edge or i >= n - edge) and furniture(x))))
        return pd.DataFrame({doc: pdf[doc], page: pdf[page], "text": out})

    return pages.select(doc, page, F.col(text_col).alias("t")).groupBy(doc).applyInPandas(run, f"{doc} {kinds[doc]}, {page} {kinds[page]}, text string")


def strip_footnotes(c: Column) -> Column:
    """Without footnote lines and the plain lines that continue them up to a blank one."""
    ls = F.split(text(c), "\n")
    note = lambda x: x.rlike(r"^\s*(?:\[\d{1,3}\]\s|\*{1,3}\s+\S|†\s+\S)")
    folded = F.aggregate(
        ls,
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside")),
        lambda s, x: F.when(note(x), F.struct(s["kept"].alias("kept"), F.lit(True).alias("inside"))).when(s["inside"] & (F.trim(x) != "") & ~x.rlike(r"^\s*\d+[.)]"), F.struct(s["kept"].alias("kept"), F.lit(True).alias("inside"))).otherwise(F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), F.lit(False).alias("inside"))),
        lambda s: s["kept"],
    )
    return F.array_join(folded, "\n")


def hierarchy(rows: list[tuple[int, str | None, float]]) -> list[tuple[str, str | None, int]]:
    """(id, parent id, depth) of ordered (order, marker, indent) rows: numbers nest by their dots, letters and romans under the path before; a repeated id gets #2, #3."""
    out, path, seen = [], [], {}
    counters: dict[float, int] = {}
    for _, marker, indent in rows:
        if not marker:
            counters[indent] = counters.get(indent, 0) + 1
            counters = {k: v for k, v in counters.items() if k <= indent}
            kind, core = ("implicit", f"i{counters[indent]}")
        else:
            core = re.sub(r"[().\s]+$|^[(\s]+", "", marker).lower()
            kind = "number" if re.fullmatch(r"\d+(\.\d+)*", core) else "roman" if re.fullmatch(r"[ivx]+", core) else "letter"
        if kind == "number":
            want = core.split(".")
            while path and not (path[-1][1] == "number" and want[: len(path[-1][2])] == path[-1][2] and len(want) > len(path[-1][2])):
                path.pop()
            key = core
        else:
            want = [core]
            while path and path[-1][1] == kind:
                path.pop()
            if any(p[1] == kind for p in path):
                while path and path[-1][1] != kind:
                    path.pop()
                if path:
                    path.pop()
            key = (path[-1][0] + "." if path else "") + core
        seen[key] = seen.get(key, 0) + 1
        name = key if seen[key] == 1 else f"{key}#{seen[key]}"
        out.append((name, path[-1][0] if path else None, len(path)))
        path.append((name, kind, want))
    return out


def tree(blocks: DataFrame, doc: str, order: str, text_col: str, indent: str) -> DataFrame:
    """``doc, order, clause_id, parent_clause, depth`` of a document's blocks."""
    kinds = dict(blocks.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        found = hierarchy(list(zip(pdf[order], [m if isinstance(m, str) else None for m in pdf["marker"]], pdf[indent], strict=True)))
        return pd.DataFrame({doc: pdf[doc], order: pdf[order], "clause_id": [f[0] for f in found], "parent_clause": [f[1] for f in found], "depth": [f[2] for f in found]})

    return blocks.select(doc, order, leading_marker(text_col).alias("marker"), indent).groupBy(doc).applyInPandas(run, f"{doc} {kinds[doc]}, {order} {kinds[order]}, clause_id string, parent_clause string, depth int")


def tree_problems(nodes: DataFrame, doc: str, node: str, parent: str, number: str, text_col: str, page: str, longest: int = 12_000) -> DataFrame:
    """``doc, node, problem``: repeated text, repeated number among siblings, too long, before its parent's page."""
    same = F.count("*").over(Window.partitionBy(doc, F.sha1(text(text_col)))) > 1
    sibling = (F.count("*").over(Window.partitionBy(doc, parent, number)) > 1) & F.col(number).isNotNull()
    up = nodes.select(doc, F.col(node).alias(parent), F.col(page).alias("_pp"))
    j = nodes.withColumn("_same", same).withColumn("_sib", sibling).join(up, [doc, parent], "left")
    codes = F.array_compact(F.array(F.when(F.col("_same"), "duplicate_text"), F.when(F.col("_sib"), "duplicate_sibling_number"), F.when(F.length(text(text_col)) > longest, "too_long"), F.when(F.col(page) < F.col("_pp"), "page_order")))
    return j.select(doc, node, F.explode(codes).alias("problem"))


def page_of(offsets: DataFrame, spans: DataFrame, doc: str, offset: str, start: str, end: str, page: str) -> DataFrame:
    """The page whose [start, end) holds the offset, else the document's last page.

    An equi-join on the document with its span array, which is a document's and so bounded; the span is then found inside the row.
    """
    by = spans.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(page).alias("p")))).alias("_spans"))
    hit = F.filter("_spans", lambda x: (F.col(offset) >= x["s"]) & (F.col(offset) < x["e"]))
    found = F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["p"]).otherwise(F.element_at("_spans", -1)["p"])
    return offsets.join(by, doc, "left").withColumn("page", found).drop("_spans")


def headed(df: DataFrame, doc: str, order: str, is_heading: Column, value: str) -> DataFrame:
    """Each row with the last heading before it."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("heading", F.last(F.when(is_heading, F.col(value)), ignorenulls=True).over(w))


def segments(df: DataFrame, doc: str, order: str, start: str, length: str) -> DataFrame:
    """Each start with where the next one begins, the last with the text's length."""
    return df.withColumn("end", F.lead(start).over(Window.partitionBy(doc).orderBy(order, start))).withColumn("end", F.coalesce("end", F.col(length)))


def suffixed(df: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """A repeated name gets #2, #3 ... in order."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), n.cast("string"))))


def running_most(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """W09."""
    return df.withColumn("running_max", F.max(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def blank_line_split(df: DataFrame, key: str, text_col: str, ladder: list[tuple[str, str]], default: str = "other") -> DataFrame:
    """``key, part_index, part, label``: paragraphs, labelled by the first phrase of the ladder in their first line."""
    parts = F.filter(F.split(text(text_col), r"\n\s*\n"), lambda x: F.trim(x) != "")
    label = F.lit(default)
    head = F.lower(F.substring_index("part", "\n", 1))
    for phrase, to in reversed(ladder):
        label = F.when(head.contains(phrase.lower()), F.lit(to)).otherwise(label)
    return df.select(key, F.posexplode(parts).alias("part_index", "part")).withColumn("label", label)


def segment_metrics(rows: DataFrame, by: list[str], clause: str) -> DataFrame:
    """Counts and lengths of clauses, and how many are numbered, titled, short or long."""
    n = F.length(text(clause))
    return rows.groupBy(*by).agg(F.count("*").alias("n_clauses"), F.sum(n).alias("n_chars"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.count_if(leading_marker(clause).isNotNull()).alias("n_numbered"), F.count_if(is_caps_title(clause)).alias("n_titles"), F.count_if(n < LEAST).alias("n_short"), F.count_if(n > MOST).alias("n_long"))
