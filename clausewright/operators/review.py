"""Findings as a reviewer sees them (E31-E35), questions (E09-E11) and chat windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.text import text
from clausewright.functions.unicode import source_quote


def infer_domain(ladder: list[tuple[str, str]], *fields: Column, default: str = "general") -> Column:
    """The first domain whose pattern occurs in the joined fields."""
    joined = F.lower(F.concat_ws(" ", *fields))
    return F.coalesce(*[F.when(joined.rlike(p), F.lit(d)) for d, p in ladder], F.lit(default))


def evidence_list(one: Column, many: Column) -> Column:
    """An array of distinct quotes from a string or an array, blanks left out."""
    both = F.concat(F.coalesce(many, F.array().cast("array<string>")), F.array(F.coalesce(one, F.lit(""))))
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != ""))


def clause_list(c: Column) -> Column:
    """Sorted distinct whole numbers of an array of texts."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: x.try_cast("int")), lambda x: x.isNotNull())))


def build_review(scopes: list[DataFrame], doc: str, check: str, clauses: str) -> DataFrame:
    """Findings of several scopes, first scope first: without NO_RISK and ERROR, one row for a check and clause list, flagged or unresolved."""
    every = None
    for k, s in enumerate(scopes):
        s = s.withColumn("scope", F.lit(k))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    every = every.where("status NOT IN ('NO_RISK', 'ERROR')").withColumn("_key", F.array_join(clauses, ","))
    w = Window.partitionBy(doc, check, "_key").orderBy("scope", "status")
    one = every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")
    return one.withColumn("section", F.when(F.col("status") == "RISK", "flagged").otherwise("unresolved"))


def suppress(signals: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """Signals whose id no finding has."""
    return signals.join(findings.select(*key).distinct(), key, "left_anti")


def topics(review: DataFrame, doc: str, topic: str) -> DataFrame:
    """Topics with their sizes, largest first, then by name."""
    n = review.groupBy(doc, topic).agg(F.count("*").alias("n"), F.count_if(F.col("section") == "flagged").alias("n_flagged"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), F.asc(topic))).cast("int"))


def flags_per_clause(review: DataFrame, doc: str, clauses: str) -> DataFrame:
    """E35."""
    return review.select(doc, F.explode(clauses).alias("clause")).groupBy(doc, "clause").agg(F.count("*").alias("n_flags"))


def chat_window(turns: DataFrame, conv: str, turn: str, role: str, content: str, last: int = 8, last_user: int = 3) -> DataFrame:
    """Per conversation the last turns, and the last user turns' texts in order.

    The k last are kept before anything is gathered, so a very long conversation costs a sort, not memory.
    """
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    history = turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    user = turns.where(F.col(role) == "user").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last_user)
    a = history.groupBy(conv).agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, role))), lambda x: x[role]), ">").alias("roles"))
    b = user.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn), text(content).alias("t")))), lambda x: x["t"]), " ").alias("retrieval_text"))
    return a.join(b, conv, "left")


def verify_citations(citations: DataFrame, sources: DataFrame, answer: str, source: str, quote: str, cap: int = 8) -> DataFrame:
    """Citations whose quote stands in the source named, in the source's words, once each, the first ``cap`` per answer."""
    j = citations.join(sources.select(source, F.col("text").alias("_text")), source).withColumn("verified_quote", source_quote(F.col("_text"), F.col(quote)))
    ok = j.where("verified_quote IS NOT NULL").drop("_text")
    w = Window.partitionBy(answer, source, F.lower("verified_quote")).orderBy("position", "verified_quote", quote)
    ok = ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return ok.withColumn("place", F.row_number().over(Window.partitionBy(answer).orderBy("position", source, "verified_quote"))).where(F.col("place") <= cap)


def unverified(citations: DataFrame, verified: DataFrame, answer: str, key: list[str]) -> DataFrame:
    """Per answer whether any citation failed."""
    j = citations.select(answer, *key).join(verified.select(answer, *key, F.lit(True).alias("_ok")).distinct(), [answer, *key], "left")
    return j.groupBy(answer).agg(F.bool_or(F.col("_ok").isNull()).alias("has_unverified"))


def direct_answer(questions: DataFrame, clauses: DataFrame, question: str, doc: str) -> DataFrame:
    """A question for exactly one clause number gets that clause, the first at a tie."""
    from clausewright.functions.text import single_clause_lookup

    q = questions.withColumn("number", single_clause_lookup(question)).where("number IS NOT NULL")
    return q.join(clauses, [doc, "number"]).groupBy(doc, "question_id").agg(F.min_by(F.struct("clause_id", "text"), "clause_id").alias("clause")).select(doc, "question_id", "clause.*")


def excerpts(question_terms: Column, clause: Column, limit: int = 300) -> Column:
    """The clause's first words around the first term that occurs."""
    at = F.array_min(F.filter(F.transform(question_terms, lambda t: F.position(t, F.lower(clause))), lambda x: x > 0))
    return F.when(at > 0, F.substring(clause, F.greatest(F.lit(1), at - limit // 3), F.lit(limit)))


def context(selected: DataFrame, doc: str, order: str, clause: str, cap: int = 12, chars: int = 2200, budget: int = 30_000, few: int = 7) -> DataFrame:
    """Per document a JSON payload of its first ``cap`` clauses, cut to ``chars``; ``few`` of them if it exceeds the budget."""
    w = Window.partitionBy(doc).orderBy(order)
    kept = selected.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    items = kept.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.substring(text(clause), 1, chars).alias("text")))).alias("_i"))
    whole, less = F.to_json("_i"), F.to_json(F.slice("_i", 1, few))
    return items.select(doc, F.when(F.length(whole) > budget, less).otherwise(whole).alias("payload"), F.when(F.length(whole) > budget, F.least(F.size("_i"), F.lit(few))).otherwise(F.size("_i")).alias("n_clauses"))
