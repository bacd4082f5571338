"""Checks that read several clauses of a contract.

A check table is config: it is unrolled to literals or broadcast.  What is gathered of a
document is its clauses, so no group grows with the corpus.  The model is asked through
``models.ask``; its answers count only where exact, fitting evidence stands behind them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import models
from clausewright.functions.text import text
from clausewright.operators import metrics, rules

UNSURE, LACKING = "DON'T KNOW", "INSUFFICIENT_EVIDENCE"

# The signals' names, labels and terms; a label or a term in the text makes a clause a hit.
ECONOMIC = (
    ("Exclusivity", "Minimum Commitment", "Volume Restriction", "Price Restriction", "Most Favored Nation", "Revenue/Profit Sharing"),
    ("exclusivity", "exclusive", "minimum commitment", "take or pay", "minimum purchase", "minimum volume", "volume restriction", "usage cap", "quantity limit", "price restriction", "price increase",
     "most favored", "most favoured", "mfn", "revenue sharing", "profit sharing", "net sales", "net revenue", "profit share"),
)
EXIT = (
    ("Renewal Term", "Termination For Convenience", "Notice Period To Terminate Renewal", "Post-Termination Services"),
    ("renewal term", "auto-renew", "automatically renew", "non-renewal", "indefinite term", "terminate this agreement", "termination of this agreement", "right to terminate", "early termination",
     "termination without consent", "terminate for convenience", "termination for convenience", "post-termination", "transition assistance", "wind-down", "assistance after termination"),
)
REMEDY = (
    ("Cap On Liability", "Uncapped Liability", "Indemnification", "Warranty", "Liquidated Damages"),
    ("liability", "liability cap", "cap on liability", "aggregate liability", "maximum liability", "uncapped liability", "unlimited liability", "indemnification", "indemnify", "hold harmless", "warranty", "liquidated damages"),
)
CONTROL = (
    ("Anti-Assignment", "Change Of Control", "ROFR/ROFO/ROFN", "Third-Party Beneficiary"),
    ("assignment", "assign", "change of control", "right of first refusal", "right of first offer", "right of first negotiation", "third-party beneficiary", "third party beneficiary"),
)
IP = (
    ("IP Ownership Assignment", "License Grant", "Source Code Escrow", "Post-Termination Services", "Irrevocable Or Perpetual License"),
    ("intellectual property", "license grant", "licence grant", "source code escrow", "source code", "perpetual license", "irrevocable license", "post-termination services", "work product", "deliverables"),
)
AUDIT = (
    ("Audit Rights", "Revenue/Profit Sharing", "Most Favored Nation", "Price Restrictions", "Minimum Commitment"),
    ("audit rights", "audit", "revenue sharing", "profit sharing", "most favored", "most favoured", "price restriction", "minimum commitment", "net sales", "net revenue"),
)
AUDIT_MARKS = ("records", "report", "audit", "books", "accounting", "retention", "measurement")
SCOPE = ("license", "exclusivity", "non-compete", "noncompete", "no-solicit", "affiliate")
SCOPE_MARKS = ("territory", "geographic", "customer", "affiliate", "duration", "term")
REFERENCES = ("order of precedence", "priority", "in case of conflict", "master agreement", "order form", "exhibit", "schedule", "online terms")
HIERARCHY = ("order of precedence", "prevail over", "prevails over", "takes precedence", "priority over")
#: Clause ids that a signal names, scope and others.
NAMED_SCOPE, NAMED = 6, 8


def _any(value: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(value)
    return reduce(lambda a, b: a | b, [low.contains(w.lower()) for w in words])


def interaction_signals(clauses: DataFrame, doc: str = "doc", clause: str = "clause_id", label: str = "label", text_col: str = "text") -> DataFrame:
    """``doc, signal, n, clauses``: the eight signals that clauses of a document give together.

    Scope, economic, exit, remedy, control and IP need two hits; an evidence gap is a hit without a
    marker; a precedence gap is two references without a stated hierarchy.  ``clauses`` are the first
    ids, in the order of the ids, of those that hit.  Null labels and texts hit nothing.
    """
    family = lambda f: _any(text(label), f[0]) | _any(text(text_col), f[1])
    wording = lambda words: _any(text(text_col), words)
    flags = {
        "scope_conflict": wording(SCOPE) & wording(SCOPE_MARKS), "economic_stack": family(ECONOMIC), "exit_failure": family(EXIT), "remedy_mismatch": family(REMEDY),
        "control_mismatch": family(CONTROL), "ip_continuity_gap": family(IP), "evidence_gap": family(AUDIT), "precedence_gap": wording(REFERENCES),
    }
    hit = clauses.select(F.col(doc), F.col(clause), *[c.alias(k) for k, c in flags.items()], wording(AUDIT_MARKS).alias("_mark"), wording(HIERARCHY).alias("_order"))
    long = hit.select(doc, clause, "_mark", "_order", F.explode(F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in flags]))).alias("signal"))
    found = long.groupBy(doc, "signal").agg(F.count("*").alias("n"), F.count_if("_mark").alias("_marks"), F.bool_or("_order").alias("_ordered"), F.array_sort(F.collect_list(clause)).alias("clauses"))
    gap, order = F.col("signal") == "evidence_gap", F.col("signal") == "precedence_gap"
    found = found.where(F.when(gap, F.col("_marks") < F.col("n")).when(order, (F.col("n") >= 2) & ~F.col("_ordered")).otherwise(F.col("n") >= 2))
    return found.select(doc, "signal", "n", F.slice("clauses", 1, F.when(F.col("signal") == "scope_conflict", NAMED_SCOPE).otherwise(NAMED)).alias("clauses"))


@dataclass(frozen=True)
class Check:
    """A question on a whole contract; ``terms`` are the words of clauses that may support an answer (none: any clause)."""

    id: str
    kind: str
    question: str
    terms: tuple[str, ...] = ()


FINDINGS = "array<struct<check_id:string,answer:string,clause_ids:array<int>,evidence:array<struct<clause_id:int,quote:string>>,why:string>>"


def _verdict(answer: Column, evidence_ok: Column) -> Column:
    return F.when((answer == "YES") & evidence_ok, "POTENTIAL_RISK").when((answer == "NO") & evidence_ok, "NO_RISK").otherwise(LACKING)


def contract_checks(clauses: DataFrame, checks: list[Check], client: models.ModelClient, passes: int = 3, batch: int = 4) -> DataFrame:
    """``doc, check_id, kind, answer, agreement, status, evidence, clause_ids`` for every document and check.

    ``clauses``: doc, clause_id, text.  The checks are asked ``batch`` at a time, ``passes`` times each, with all
    clauses of the document; the reply is a JSON list of findings.  A reply that can't be read, or that leaves a check
    out, abstains.  The answer of more than half of the passes counts, from the first pass that gave it.  Its evidence
    must stand word for word in a clause of the document, one of the check's topic where the document has any, and
    its clauses must be just those that the finding declares; else the status is ``INSUFFICIENT_EVIDENCE`` and the
    topic's own clauses are the evidence.  No checks or no clauses give no rows.
    """
    spark = clauses.sparkSession
    table = F.broadcast(spark.createDataFrame([(c.id, c.kind, list(c.terms)) for c in checks], "check_id string, kind string, terms array<string>"))
    clauses = clauses.select("doc", F.col("clause_id").cast("int").alias("clause_id"), "text").where("clause_id IS NOT NULL AND trim(coalesce(text, '')) <> ''")
    if not checks:
        return clauses.limit(0).select("doc", F.lit("").alias("check_id"), F.lit("").alias("kind"), F.lit("").alias("answer"), F.lit(0.0).alias("agreement"), F.lit("").alias("status"), F.expr("cast(null as array<struct<clause_id:int,quote:string>>)").alias("evidence"), F.expr("cast(null as array<int>)").alias("clause_ids"))
    groups = [checks[k : k + batch] for k in range(0, len(checks), batch)]
    asked = F.array(*[F.struct(F.lit(i).alias("batch"), F.array(*[F.lit(c.id) for c in g]).alias("ids"), F.lit(json.dumps([{"id": c.id, "kind": c.kind, "question": c.question} for c in g])).alias("questions")) for i, g in enumerate(groups)])
    whole = clauses.groupBy("doc").agg(F.to_json(F.array_sort(F.collect_list(F.struct("clause_id", "text")))).alias("clauses"))
    rows = models.passes(whole.select("doc", "clauses", F.explode(asked).alias("b")).select("doc", "clauses", "b.*"), passes)
    prompt = models.prompt("Answer each check YES, NO or DON'T KNOW, with exact quotes.", ("CHECKS", F.col("questions")), ("CLAUSES", F.col("clauses")), ("PASS", F.col("pass")))
    replies = models.ask(rows, prompt, client).select("doc", "ids", "pass", F.explode(F.from_json("answer", FINDINGS)).alias("f"))
    said = replies.where(F.array_contains("ids", F.col("f.check_id"))).select(F.struct("doc", "f.check_id").alias("key"), "pass", "f.*")
    said = said.withColumn("answer", F.when(F.upper("answer").isin("YES", "NO"), F.upper("answer")).otherwise(UNSURE)).dropDuplicates(["key", "pass"])
    votes = metrics.strict_majority(said, "key", "answer", "pass", passes)
    first = said.join(votes.select("key", F.col("answer").alias("agreed")), "key").groupBy("key").agg(F.min_by(F.struct("clause_ids", "evidence"), F.struct(F.col("answer") != F.col("agreed"), "pass")).alias("f"))
    told = votes.join(first, "key").select("key.*", "answer", "agreement", F.array_sort(F.array_distinct(F.coalesce("f.clause_ids", F.array().cast("array<int>")))).alias("declared"), F.col("f.evidence").alias("quotes"))

    low = F.lower("text")
    topic = clauses.join(table, F.exists("terms", lambda w: low.contains(F.lower(w)))).groupBy("doc", "check_id").agg(F.array_sort(F.collect_set(F.struct("clause_id", F.col("text").alias("quote")))).alias("topic"))
    every = clauses.select("doc").distinct().select("doc", F.explode(F.array(*[F.lit(c.id) for c in checks])).alias("check_id")).join(table.select("check_id", "kind"), "check_id")
    every = every.join(told, ["doc", "check_id"], "left").join(topic, ["doc", "check_id"], "left")
    quoted = every.select("doc", "check_id", "topic", F.explode("quotes").alias("q")).join(clauses.withColumnRenamed("clause_id", "at"), "doc").where((F.col("q.clause_id") == F.col("at")) & (F.trim("q.quote") != "") & F.contains("text", F.col("q.quote")))
    quoted = quoted.where(F.col("topic").isNull() | F.exists("topic", lambda x: x["clause_id"] == F.col("at"))).groupBy("doc", "check_id").agg(F.array_sort(F.collect_set("q")).alias("held"))
    j = every.join(quoted, ["doc", "check_id"], "left").withColumn("answer", F.coalesce("answer", F.lit(UNSURE))).withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))
    ok = F.coalesce(F.array_sort(F.array_distinct(F.col("held.clause_id"))) == F.col("declared"), F.lit(False))
    j = j.withColumn("status", _verdict(F.col("answer"), ok))
    none = F.expr("cast(array() as array<struct<clause_id:int,quote:string>>)")
    j = j.withColumn("evidence", F.coalesce(F.when(ok, F.col("held")).otherwise(F.col("topic")), none))
    return j.select("doc", "check_id", "kind", "answer", "agreement", "status", "evidence", F.array_distinct(F.col("evidence.clause_id")).alias("clause_ids"))


def clause_analysis(clauses: DataFrame, checks: DataFrame, client: models.ModelClient, passes: int = 3) -> DataFrame:
    """``clause_id, category, check_id, how, answer, agreement, evidence, status`` of every check that applies to a clause.

    ``clauses``: clause_id, label, text; ``checks``: category, check_id, keywords, question, trigger.  The reply is a JSON
    object of answer and evidence; one that can't be read abstains.  The answer of more than half of the passes counts;
    the evidence of the first pass that gave it must stand in the clause.
    """
    pairs = rules.applicable(clauses, checks.select("category", "check_id", "keywords"))
    table = F.broadcast(checks.select("category", F.col("check_id").alias("_id"), "question", "trigger"))
    pairs = pairs.withColumn("_id", F.split("check_id", "@")[0]).join(table, ["category", "_id"]).join(clauses.select("clause_id", "text"), "clause_id").drop("_id")
    rows = models.passes(pairs, passes)
    prompt = models.prompt("Answer YES, NO or DON'T KNOW, with an exact quote.", ("QUESTION", F.col("question")), ("CLAUSE", F.col("text")), ("PASS", F.col("pass")))
    reply = F.from_json("reply", "answer string, evidence string")
    said = models.ask(rows, prompt, client, "reply").withColumn("r", reply).select(F.struct("clause_id", "category", "check_id").alias("key"), "pass", F.when(F.upper("r.answer").isin("YES", "NO"), F.upper("r.answer")).otherwise(UNSURE).alias("answer"), "r.evidence")
    votes = metrics.strict_majority(said, "key", "answer", "pass", passes)
    first = said.join(votes.select("key", F.col("answer").alias("agreed")), "key").groupBy("key").agg(F.min_by("evidence", F.struct(F.col("answer") != F.col("agreed"), "pass")).alias("evidence"))
    told = votes.join(first, "key").select("key.*", "answer", "agreement", "evidence")
    j = pairs.join(told, ["clause_id", "category", "check_id"])
    held = F.coalesce((F.trim("evidence") != "") & F.contains("text", "evidence"), F.lit(False))
    return j.withColumn("status", rules.resolve_status(F.col("answer"), F.col("trigger"), held)).select("clause_id", "category", "check_id", "how", "answer", "agreement", F.when(held, F.col("evidence")).alias("evidence"), "status")
