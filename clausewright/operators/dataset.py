"""Dataset preparation and audits."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from clausewright.functions.text import blank_to_null, text, trimmed


def answer_pairs(columns: list[str], suffix: str = "answer") -> list[tuple[str, str]]:
    """(text column, answer column) pairs, the suffix in any case and with stray spaces."""
    plain = {re.sub(r"\s+", " ", c).strip().lower(): c for c in columns}
    found = []
    for c in columns:
        m = re.fullmatch(rf"\s*(.+?)\s*-\s*{suffix}\s*", c, re.I)
        if m and (base := re.sub(r"\s+", " ", m[1]).strip().lower()) in plain:
            found.append((plain[base], c))
    return found


def find_column(columns: list[str], *parts: str) -> str | None:
    """The column that spells the parts, whatever its case, spaces, - and _."""
    want = re.sub(r"[\s_-]+", "", "".join(parts)).lower()
    return next((c for c in columns if re.sub(r"[\s_-]+", "", c).lower() == want), None)


@F.pandas_udf(ArrayType(StringType()))
def _literal(s: pd.Series) -> pd.Series:
    def one(x):
        try:
            v = ast.literal_eval(x)
        except (ValueError, SyntaxError, MemoryError):
            return None
        return [str(i) for i in v] if isinstance(v, (list, tuple)) else [str(v)]

    return s.map(lambda x: None if x is None else one(x))


def parse_spans(c: Column) -> Column:
    """A list written as text as an array, blanks left out; other text is a list of itself.

    Lists with backslash escapes, which JSON reads otherwise, go through Python.
    """
    t = trimmed(c)
    listed = t.startswith("[")
    read = F.from_json(t, "array<string>", {"allowSingleQuotes": "true"})
    slow = _literal(F.when(listed & (read.isNull() | t.contains("\\")), t))
    got = F.when(listed & ~t.contains("\\") & read.isNotNull(), read).when(listed & slow.isNotNull(), slow).otherwise(F.array(t))
    return F.filter(F.transform(got, trimmed), lambda x: x != "")


def wide_to_long(df: DataFrame, key: str, pairs: list[tuple[str, str]], spans=None) -> DataFrame:
    """A row per (row, type, span): ``key, clause_type, span_index, clause_text, answer``.

    One scan: the pairs become an array of structs that is exploded, not a union of scans.
    """
    one = F.array(*[F.struct(F.lit(t.strip()).alias("clause_type"), F.col(f"`{t}`").cast("string").alias("raw"), F.col(f"`{a}`").cast("string").alias("answer")) for t, a in pairs])
    long = df.select(key, F.explode(one).alias("p")).select(key, "p.*")
    split = spans or (lambda c: F.filter(F.array(c), lambda x: trimmed(x) != ""))
    return long.select(key, "clause_type", "answer", F.posexplode(split(F.col("raw"))).alias("span_index", "clause_text"))


def metadata_flag(label: Column, fields: list[str]) -> Column:
    """P05."""
    return F.lower(trimmed(label)).isin([f.lower() for f in fields])


def eligible(source: dict[str, Column], claim: Column, tiers: dict[str, list[str]], jurisdiction: Column, contract_type: Column) -> Column:
    """The source's tier is good enough for the claim, and its jurisdiction and contract types, where given, hold the asked ones."""
    good = F.lit(False)
    for name, allowed in tiers.items():
        good = good | ((claim == name) & source["tier"].isin(allowed))
    fits = lambda have, want: F.coalesce(F.size(have), F.lit(0)).isin(0, -1) | F.array_contains(have, want)
    return good & fits(source["jurisdictions"], jurisdiction) & fits(source["contract_types"], contract_type)


def permissive(column: Column, wanted: list[str], any_value: str = "general") -> Column:
    """P10: equal to one of the values, or general, or not given."""
    return column.isNull() | column.isin([*wanted, any_value])


def transferability(same_jurisdiction: Column, same_type: Column) -> Column:
    """P11."""
    return F.when(same_jurisdiction & same_type, "direct").when(same_jurisdiction, "same_law_other_contract").when(same_type, "other_law_same_contract").otherwise("persuasive_only")


def source_record(df: DataFrame, defaults: dict[str, str], tiers: tuple[str, ...] = ("A", "B", "C", "D")) -> DataFrame:
    """Blanks filled with defaults; a tier that isn't one raises when read."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(blank_to_null(c) if c in df.columns else F.lit(None), F.lit(v)))
    bad = ~F.col("tier").isin(*tiers)
    return df.withColumn("tier", F.when(bad, F.raise_error(F.concat(F.lit("no such tier: "), F.col("tier"))).cast("string")).otherwise(F.col("tier")))


def validity(clause: Column, is_metadata: Column, verdict: Column | None = None, least: int = 20) -> Column:
    """METADATA, TOO_SHORT, NUMBERED (taken as a clause), VALID or REJECTED; a missing verdict lets pass."""
    numbered = text(clause).rlike(r"^\s*(?:\d+(?:\.\d+)*[.)]|\([a-z0-9]{1,3}\))\s+\S")
    said = F.coalesce(verdict, F.lit(True)) if verdict is not None else F.lit(True)
    return F.when(is_metadata, "METADATA").when(F.length(trimmed(clause)) < least, "TOO_SHORT").when(numbered, "NUMBERED").when(said, "VALID").otherwise("REJECTED")


def risk_only(findings: DataFrame) -> DataFrame:
    """P14."""
    return findings.where("status <> 'NO_RISK'")


def valid_positive(status: Column, flag: Column, evidence: Column, clause: Column) -> Column:
    """A risk whose flag is set and whose evidence stands in the clause."""
    return (status == "RISK") & F.coalesce(flag, F.lit(False)) & (trimmed(evidence) != "") & F.contains(text(clause), text(evidence))


def severity_shim(df: DataFrame) -> DataFrame:
    """The retired columns as nulls; only a range check of a given factor is real."""
    return df.withColumn("severity", F.lit(None).cast("string")).withColumn("severity_score", F.lit(None).cast("double"))


def jurisdiction_sensitive(words: list[str], *columns: Column) -> Column:
    """P17."""
    low, out = F.lower(F.concat_ws(" ", *columns)), F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def unlabelled_status(findings: Column) -> Column:
    """A clause without a label keeps what its findings say."""
    return F.when(F.exists(findings, lambda s: s == "RISK"), "RISK").when((F.size(findings) > 0) & F.forall(findings, lambda s: s == "NO_RISK"), "NO_RISK").otherwise("INSUFFICIENT_EVIDENCE")


def overlap_flags(df: DataFrame, doc: str, key: str, label: str) -> DataFrame:
    """Per (document, text key) the distinct labels: count, sorted list, whether there are several.  One aggregate, joined back."""
    labels = df.groupBy(doc, key).agg(F.array_sort(F.collect_set(label)).alias("_l"))
    labels = labels.select(doc, key, F.size("_l").cast("long").alias("same_text_label_count"), F.array_join("_l", "|").alias("same_text_labels"), (F.size("_l") > 1).alias("cross_category_span_reuse"))
    return df.join(labels, [doc, key])


def label_ceiling(df: DataFrame, key: str, label: str) -> DataFrame:
    """One row: rows that a one-label-a-text classifier could get right at most, and their share."""
    top = df.groupBy(key, label).agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return top.agg(F.sum("top").alias("n_best"), F.sum("all").alias("n_rows")).withColumn("ceiling", F.round(F.col("n_best") / F.col("n_rows"), 6))


def exclusive_quantile(values: Column, q: float) -> Column:
    """Of a sorted array, by rank q * (n + 1) with interpolation (not the inclusive method of ``percentile``)."""
    n = F.size(values)
    at = F.greatest(F.lit(1.0), F.least(n.cast("double"), F.lit(q) * (n + 1)))
    low = F.floor(at).cast("int")
    a, b = F.get(values, low - 1).cast("double"), F.get(values, F.least(n, low + 1) - 1).cast("double")
    return a + (b - a) * (at - low)


def length_profile(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Per group n, least, median, most, exclusive 95th percentile.

    Counts per distinct value are gathered, not rows; quantiles are read off running counts.
    """
    c = df.withColumn("_v", value.cast("long")).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy("_v")
    c = c.withColumn("_hi", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))

    def at(rank: Column) -> Column:  # the value of that rank (from 1)
        return F.max(F.when((rank <= F.col("_hi")) & (rank > F.col("_hi") - F.col("_c")), F.col("_v")))

    n = F.col("_n")
    p = F.greatest(F.lit(1.0), F.least(n.cast("double"), F.lit(0.95) * (n + 1)))
    low = F.floor(p)
    g = c.groupBy(*by, "_n").agg(F.min("_v").alias("least"), F.max("_v").alias("most"), at(F.floor((n + 1) / 2)).alias("m1"), at(F.ceil((n + 1) / 2)).alias("m2"), at(low).alias("a"), at(F.least(n, low + 1)).alias("b"))
    return g.select(*by, n.alias("n"), "least", ((F.col("m1") + F.col("m2")) / 2.0).alias("median"), "most", F.round(F.col("a") + (F.col("b") - F.col("a")) * (p - low), 6).alias("p95"))


def yes_without_span(long: DataFrame, answer: str, spans: str) -> DataFrame:
    """A06."""
    return long.where((F.lower(trimmed(F.col(answer))) == "yes") & (F.coalesce(F.size(spans), F.lit(0)) <= 0))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key ``b`` has too."""
    return a.join(b.select(key).distinct(), key, "left_semi")


def action_histogram(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """A08."""
    return df.select(F.explode(F.filter(F.split(text(column), re.escape(separator)), lambda x: F.trim(x) != "")).alias("action")).groupBy(F.trim("action").alias("action")).agg(F.count("*").alias("n"))


def low_support(df: DataFrame, label: str, least: int = 10) -> DataFrame:
    """A09."""
    return df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < least)


def leaking(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in several splits."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


def split_documents(df: DataFrame, doc: str, share: float | None = None, first: int | None = None, seed: int = 0) -> DataFrame:
    """``split`` of train or test, whole documents at a time, by the hashed order of their ids.

    With ``share`` each document is dealt by its own hash, without an exchange; ``first`` takes exactly so many documents for train.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc).cast("string")))
    if share is not None:
        u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(16**8))
        return df.withColumn("split", F.when(u < share, "test").otherwise("train"))
    ids = df.select(doc).distinct().withColumn("_h", digest).orderBy("_h", doc).limit(first).select(F.col(doc).alias("_d"))
    return df.join(ids, F.col(doc) == F.col("_d"), "left").withColumn("split", F.when(F.col("_d").isNotNull(), "train").otherwise("test")).drop("_d")


def field_mismatches(expected: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, problem``: missing, unexpected, or the name of a field that differs (nulls equal each other)."""
    a = expected.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = stored.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    differ = [F.when(F.col("_a") & F.col("_b") & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]
    return j.select(key, F.explode(F.array_compact(F.array(F.when(F.col("_b").isNull(), F.lit("missing")), F.when(F.col("_a").isNull(), F.lit("unexpected")), *differ))).alias("problem"))


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side``: what only one of them has; empty if the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))
