"""Rules on text: matching, findings, applicability, evidence, missing checks.

A rule table is config: a few hundred rows at most, unrolled to literal patterns, so
that each task compiles a pattern once, the scan feeds the match without an exchange,
and a row without a match is dropped before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.regexkit import checked
from clausewright.functions.text import text


@dataclass(frozen=True)
class Rule:
    """A pattern, the contexts in which it doesn't count, and what a match says.  ``hint`` is a literal that any match holds."""

    id: str
    domain: str
    pattern: str
    exclude: tuple[str, ...] = ()
    question: str = ""
    hint: str = ""
    sources: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for p in (self.pattern, *self.exclude):
            checked(p)


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """The rules as rows."""
    return spark.createDataFrame([(r.id, r.domain, r.pattern, list(r.exclude), r.question, list(r.sources)) for r in rules], "rule_id string, domain string, pattern string, exclude array<string>, question string, sources array<string>")


#: Characters on either side of a match that exclusions are looked for in.
WINDOW = 180


def matches(df: DataFrame, rules: list[Rule], text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per (input row, matching rule) with ``rule_id, domain, position, quote``.

    A match doesn't count if an exclusion occurs within ``window`` characters of it.
    No match gives no row, which never says that a risk is absent.
    """
    t = text(text_col)

    def hit(r: Rule) -> Column:
        quote = F.regexp_extract(t, r.pattern, 0)
        at = F.regexp_instr(t, F.lit(r.pattern))
        found = t.rlike(r.pattern)
        if r.hint:
            found = F.lower(t).contains(r.hint.lower()) & found
        if r.exclude:
            start = F.greatest(F.lit(1), at - window)
            near = F.substring(t, start, at - start + F.length(quote) + window)
            found = found & ~reduce(lambda a, b: a | b, [near.rlike(p) for p in r.exclude])
        return F.when(found, F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.domain).alias("domain"), at.alias("position"), quote.alias("quote")))

    return df.withColumn("_hit", F.explode(F.array_compact(F.array(*[hit(r) for r in rules])))).select(*df.columns, "_hit.*")


def applicable(clauses: DataFrame, checks: DataFrame) -> DataFrame:
    """(clause, check) where labels are equal, one contains the other, or a keyword of the check's category occurs.

    ``clauses``: clause_id, label, text; ``checks``: category, check_id, keywords array.
    A check id used in several categories is told apart by its category.
    """
    many = checks.groupBy("check_id").agg(F.count_distinct("category").alias("_n"))
    slug = F.regexp_replace(F.lower("category"), "[^a-z0-9]+", "-")
    named = checks.join(many, "check_id").withColumn("check_id", F.when(F.col("_n") > 1, F.concat("check_id", F.lit("@"), slug)).otherwise(F.col("check_id"))).drop("_n")
    named = F.broadcast(named)  # a check table is config
    label, category = F.lower(F.coalesce("label", F.lit(""))), F.lower("category")
    equal = label == category
    part = (label != "") & (label.contains(category) | category.contains(label))
    word = F.exists("keywords", lambda k: F.lower(F.coalesce("text", F.lit(""))).contains(F.lower(k)))
    how = F.when(equal, "label").when(part, "partial").when(word, "keyword")
    return clauses.join(named, equal | part | word).select("clause_id", "category", "check_id", how.alias("how")).dropDuplicates(["clause_id", "category", "check_id"])


def domains(df: DataFrame, taxonomy: dict[str, list[str]], key: str, text_col: str = "text") -> DataFrame:
    """``key, domain, hits`` for each domain with an indicator in the text, most hits first per key by rank."""
    low = F.lower(text(text_col))
    hits = [F.struct(F.lit(d).alias("domain"), reduce(lambda a, b: a + b, [low.contains(w.lower()).cast("int") for w in ws]).alias("hits")) for d, ws in taxonomy.items()]
    ranked = F.array_sort(F.filter(F.array(*hits), lambda x: x["hits"] > 0), lambda a, b: F.when(a["hits"] != b["hits"], b["hits"] - a["hits"]).when(a["domain"] < b["domain"], -1).otherwise(1))
    return df.select(key, F.posexplode(ranked).alias("rank", "d")).select(key, "d.domain", "d.hits", (F.col("rank") + 1).alias("rank"))


def family_flags(df: DataFrame, families: dict[str, list[str]], label_col: str, text_col: str) -> DataFrame:
    """A boolean column per family: a term in the label or in the text."""
    both = F.concat_ws("\n", F.lower(text(label_col)), F.lower(text(text_col)))
    return df.select("*", *[reduce(lambda a, b: a | b, [both.contains(w.lower()) for w in ws]).alias(f"is_{k}") for k, ws in families.items()])


def signals(flagged: DataFrame, families: list[str], doc: str, clause: str, least: int = 2, cap: int = 20) -> DataFrame:
    """``doc, signal, n, clauses`` where at least ``least`` clauses of a document belong to a family (first ``cap`` ids)."""
    long = flagged.select(doc, clause, F.explode(F.array_compact(F.array(*[F.when(F.col(f"is_{f}"), F.lit(f)) for f in families]))).alias("signal"))
    found = long.groupBy(doc, "signal").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(clause)).alias("clauses")).where(F.col("n") >= least)
    return found.withColumn("clauses", F.slice("clauses", 1, cap))


def gap_signals(flagged: DataFrame, doc: str, hits: str, markers: str, references: str, hierarchy: str) -> DataFrame:
    """Evidence gap (fewer markers than hits) and precedence gap (two references or more, no hierarchy)."""
    n = flagged.groupBy(doc).agg(*[F.count_if(F.col(c)).alias(c) for c in (hits, markers, references, hierarchy)])
    gap = F.when((F.col(hits) > 0) & (F.col(markers) < F.col(hits)), "evidence_gap")
    order = F.when((F.col(references) >= 2) & (F.col(hierarchy) == 0), "precedence_gap")
    return n.select(doc, F.explode(F.array_compact(F.array(gap, order))).alias("signal"))


def single_signals(df: DataFrame, key: str, table: dict[str, list[list[str]]], text_col: str = "text") -> DataFrame:
    """``key, signal`` where of every word group of a signal one word occurs."""
    low = F.lower(text(text_col))
    say = [F.when(reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [low.contains(w) for w in g]) for g in groups]), F.lit(name)) for name, groups in table.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*say))).alias("signal"))


def locate_evidence(findings: DataFrame, clauses: DataFrame) -> DataFrame:
    """``resolved`` clause of each finding's evidence: its own clause, else the one other clause of the document that holds it.

    findings: doc, finding_id, clause_id, evidence; clauses: doc, clause_id, text.
    status: TARGET, CONTEXT, AMBIGUOUS or NOT_FOUND.
    """
    held = findings.join(clauses.withColumnRenamed("clause_id", "at"), "doc").where((F.col("evidence") != "") & F.contains("text", "evidence"))
    by = held.groupBy("finding_id").agg(F.bool_or(F.col("at") == F.col("clause_id")).alias("own"), F.count_distinct("at").alias("n"), F.min("at").alias("first"))
    joined = findings.join(by, "finding_id", "left")
    status = F.when(F.col("own"), "TARGET").when(F.col("n") == 1, "CONTEXT").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    return joined.withColumn("status", status).withColumn("resolved", F.when(F.col("own"), F.col("clause_id")).when(F.col("n") == 1, F.col("first"))).drop("own", "n", "first")


def missing(expected: DataFrame, returned: DataFrame, key: list[str], status: str = "INSUFFICIENT_EVIDENCE") -> DataFrame:
    """The returned rows, and one explicit row for every expected key without any."""
    lost = expected.select(*key).distinct().join(returned.select(*key).distinct(), key, "left_anti").withColumn("status", F.lit(status))
    return returned.unionByName(lost, allowMissingColumns=True)


def complete(expected: DataFrame, found: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """Per group whether all expected keys were found, with counts."""
    have = found.select(*group, *key).distinct().withColumn("_f", F.lit(1))
    n = expected.select(*group, *key).distinct().join(have, [*group, *key], "left").groupBy(*group).agg(F.count("*").alias("n_expected"), F.count("_f").alias("n_found"))
    return n.withColumn("complete", F.col("n_expected") == F.col("n_found"))


def resolve_status(answer: Column, trigger: Column, evidence_ok: Column) -> Column:
    """RISK only if the answer is the triggering one and the evidence is verified; no verified evidence is never 'no risk'."""
    return F.when(F.upper(answer).isin("YES", "NO") & evidence_ok & (F.upper(answer) == F.upper(trigger)), "RISK").when(F.upper(answer).isin("YES", "NO") & evidence_ok, "NO_RISK").otherwise("INSUFFICIENT_EVIDENCE")


def precedence(flags: dict[str, Column], default: str) -> Column:
    """The first status whose flag holds."""
    out = F.lit(default)
    for name, c in reversed(flags.items()):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def contract_status(findings: DataFrame, doc: str, status: str = "status", ranked: tuple[str, ...] = ("RISK", "INSUFFICIENT_EVIDENCE", "NO_RISK")) -> DataFrame:
    """Per document the worst status, and how many findings have each."""
    n = findings.groupBy(doc).agg(F.count("*").alias("n_findings"), *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in ranked])
    return n.withColumn("contract_status", precedence({s: F.col(f"n_{s.lower()}") > 0 for s in ranked}, "NOT_ASSESSED"))


def domain_summary(findings: DataFrame, doc: str, domain: str, clause: str, score: str | None = None) -> DataFrame:
    """Per document and domain the findings, the affected clauses and the top score."""
    more = [F.max(score).alias("top_score")] if score else []
    return findings.groupBy(doc, domain).agg(F.count("*").alias("n_findings"), F.count_distinct(clause).alias("n_clauses"), *more)


def coverage(families: DataFrame, rows: DataFrame, family: str, classified: str, searched: str) -> DataFrame:
    """Each family of the dimension: found by classifier, by search only, or not."""
    by = rows.groupBy(family).agg(F.count_if(F.col(classified)).alias("n_classified"), F.count_if(F.col(searched)).alias("n_searched"))
    j = families.join(by, family, "left").na.fill(0, ["n_classified", "n_searched"])
    return j.withColumn("coverage", F.when(F.col("n_classified") > 0, "classifier").when(F.col("n_searched") > 0, "search").otherwise("not_found"))


def with_authority(findings: DataFrame, checks: DataFrame, taxonomy: dict[str, str] | None = None) -> DataFrame:
    """The check's declared domain, else the taxonomy's for the finding's type, else the finding's own."""
    j = findings.join(checks.select("check_id", F.col("domain").alias("declared")), "check_id", "left")
    guess = F.try_element_at(F.create_map(*[F.lit(x) for kv in (taxonomy or {"": ""}).items() for x in kv]), F.col("risk_type"))
    return j.withColumn("domain", F.coalesce("declared", guess, "domain")).drop("declared")


def with_sources(findings: DataFrame, sources: DataFrame, key: str, ids: str = "source_ids") -> DataFrame:
    """The records of an id list, in the list's order."""
    one = findings.select(key, F.posexplode_outer(ids).alias("_i", "source_id")).join(sources, "source_id", "left")
    record = F.struct("_i", "source_id", *[c for c in sources.columns if c != "source_id"])
    got = one.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("source_id").isNotNull(), record))).alias("sources"))
    return findings.join(got, key, "left")


def support_score(evidence: Column, agreement: Column, indicator: Column) -> Column:
    """A27."""
    return F.bround(0.5 * evidence + 0.3 * agreement + 0.2 * indicator, 4)
