"""Checks on several clauses of a contract, with made-up clauses and models."""

import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle

from clausewright.operators import checks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test module

CLAUSES = "doc string, clause_id int, label string, text string"
TWO = [("a", 1, "Cap", "Liability is capped at fees."), ("a", 2, "Indemnity", "Indemnities fall under the cap."), ("a", 3, None, None)]
ASKED = [checks.Check(f"X{i}", "cross", f"Question {i}?", ("liability",)) for i in range(1, 11)] + [checks.Check(f"D{i}", "document", f"Document {i}?") for i in range(1, 4)]


class Scripted:
    """``say(ids, pass)`` gives the reply."""

    def __init__(self, say):
        self.say = say

    def answer(self, prompts):
        def one(p):
            part = p.split("CHECKS:\n")[1].split("\n\nCLAUSES:\n")[0]
            return self.say([c["id"] for c in json.loads(part)], int(p.rsplit("PASS:\n")[1]))

        return prompts.map(one)


def finding(i, answer="NO", clause_ids=(), evidence=()):
    return {"check_id": i, "answer": answer, "clause_ids": list(clause_ids), "evidence": [{"clause_id": c, "quote": q} for c, q in evidence], "why": ""}


def run(spark, say, passes=1, asked=ASKED):
    got = checks.contract_checks(spark.createDataFrame(TWO, CLAUSES), asked, Scripted(say), passes).collect()
    return {r.check_id: r for r in got}


def test_every_check_comes_back_and_no_needs_evidence(spark):
    def say(ids, _):
        assert len(ids) <= 4
        return json.dumps([finding(i, "NO", [1]) for i in ids])

    got = run(spark, say)
    assert set(got) == {c.id for c in ASKED}
    assert {(r.answer, r.status) for r in got.values()} == {("NO", "INSUFFICIENT_EVIDENCE")}
    assert [e.clause_id for e in got["X1"].evidence] == [1] and got["D1"].evidence == []


def test_an_unreadable_batch_abstains(spark):
    got = run(spark, lambda ids, _: "cut off [" if "X1" in ids else json.dumps([finding(i) for i in ids]))
    assert [got[f"X{i}"].answer for i in range(1, 11)] == ["DON'T KNOW"] * 4 + ["NO"] * 6


def test_evidence_must_be_exact_fit_the_topic_and_the_declared_clauses(spark):
    quotes = {
        "X1": finding("X1", "YES", [1], [(1, "Liability is capped")]),
        "X2": finding("X2", "NO", [1], [(1, "Liability is capped")]),
        "X3": finding("X3", "YES", [1], [(1, "Liability was capped")]),
        "X4": finding("X4", "YES", [2], [(2, "fall under the cap")]),
        "D1": finding("D1", "YES", [1, 2], [(2, "fall under the cap")]),
        "D2": finding("D2", "YES", [2], [(2, "fall under the cap")]),
        "D3": finding("other", "YES", [2], [(2, "fall under the cap")]),
    }
    got = run(spark, lambda ids, _: json.dumps([quotes.get(i) or finding(i) for i in ids]))
    status = {i: got[i].status for i in quotes}
    lacking = "INSUFFICIENT_EVIDENCE"
    assert status == {"X1": "POTENTIAL_RISK", "X2": "NO_RISK", "X3": lacking, "X4": lacking, "D1": lacking, "D2": "POTENTIAL_RISK", "D3": lacking}
    assert got["D3"].answer == "DON'T KNOW" and got["D2"].clause_ids == [2]


@pytest.mark.parametrize(("answers", "answer", "agreement"), [(["YES", "YES", "NO"], "YES", 2 / 3), (["YES", "NO", "maybe"], "DON'T KNOW", 1 / 3), (["YES", "", ""], "DON'T KNOW", 2 / 3)])
def test_votes(spark, answers, answer, agreement):
    got = run(spark, lambda ids, n: json.dumps([finding(i, answers[n - 1], [1], [(1, "Liability")]) for i in ids]), 3, ASKED[:1])["X1"]
    assert got.answer == answer and got.agreement == pytest.approx(agreement, abs=1e-4)
    assert got.status == ("POTENTIAL_RISK" if answer == "YES" else "INSUFFICIENT_EVIDENCE")


def test_no_checks_or_clauses(spark):
    none = spark.createDataFrame([], CLAUSES)
    client = Scripted(lambda ids, _: "[]")
    assert checks.contract_checks(none, ASKED, client).count() == 0
    assert checks.contract_checks(spark.createDataFrame(TWO, CLAUSES), [], client).count() == 0


def test_clause_analysis(spark):
    rows = spark.createDataFrame([("Cap", "c1", ["capped"], "Is it capped?", "YES"), ("Cap", "c2", ["capped"], "Is it open?", "YES")], "category string, check_id string, keywords array<string>, question string, trigger string")

    class Model:
        def answer(self, prompts):
            return prompts.map(lambda p: json.dumps({"answer": "yes", "evidence": "capped at fees"}) if "Is it capped?" in p else "no JSON")

    got = checks.clause_analysis(spark.createDataFrame(TWO, CLAUSES).drop("doc"), rows, Model()).collect()
    assert {(r.clause_id, r.check_id, r.answer, r.evidence, r.status) for r in got} == {(1, "c1", "YES", "capped at fees", "RISK"), (1, "c2", "DON'T KNOW", None, "INSUFFICIENT_EVIDENCE")}
    assert pd.Series([r.agreement for r in got]).eq(1.0).all()


def test_interaction_signals(spark):
    rows = [
        ("a", 1, "", "The MFN clause and net sales."), ("a", 2, "Exclusivity", None), ("a", 3, None, "See Exhibit A."), ("a", 4, None, "The Order Form applies."),
        ("b", 1, "Audit Rights", "Each year."), ("b", 2, None, "An audit of the books; exhibit B."), ("b", 3, None, "The order of precedence is as follows."),
        ("c", 1, None, "A license for the territory."), ("c", 2, None, "Affiliate use."), ("c", 3, "License Grant", "Source code."),
    ]
    got = {(r.doc, r.signal): (r.n, r.clauses) for r in checks.interaction_signals(spark.createDataFrame(rows, CLAUSES)).collect()}
    assert got == {
        ("a", "economic_stack"): (2, [1, 2]), ("a", "evidence_gap"): (1, [1]), ("a", "precedence_gap"): (2, [3, 4]),
        ("b", "evidence_gap"): (2, [1, 2]), ("c", "scope_conflict"): (2, [1, 2]),
    }
