"""Text functions on small texts of our own wording."""

import uuid

import pytest
from pyspark.sql import functions as F

from clausewright.functions import models, unicode
from clausewright.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def run(value, build):
        return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("x")).first()["x"]

    return run


def test_clean(one):
    got = one("“Fee”  is​ due\n", T.conservative_clean)
    assert got.text == '"Fee" is due' and got.actions == ["invisible_removed", "nbsp_replaced", "quotes_straightened", "whitespace_collapsed"]
    assert one(None, T.conservative_clean).text == "" and one("plain", T.conservative_clean).actions == []
    assert one("Wait... what?!", T.collapse_punctuation) == "Wait. what!"
    assert one("See Sec. 4 of the Agmt", T.expand_abbreviations) == "See Section 4 of the Agreement"
    assert one(" nan ", T.clean_or_null) is None and one(" x ", T.clean_or_null) == "x"
    got = one("Page 3 of 9\nThe fee is due.\n12", T.strip_boilerplate)
    assert got.text == "The fee is due." and got.removed == 2
    assert one("Page 1\nArt. 2 Fee!!", T.advanced_preprocess).folded == "article 2 fee!"


@pytest.mark.parametrize(("line", "kind"), [("1.2 Fees", "decimal"), ("3. Term", "integer"), ("(iv) notice", "roman"), ("(b) notice", "letter"), ("Section 4 Law", "named"), ("Fees are due", "none")])
def test_markers(one, line, kind):
    assert one(line, lambda c: T.marker_kind(T.leading_marker(c))) == kind


def test_line_tests(one):
    assert one("GOVERNING LAW", T.is_caps_title) and not one("GOVERNING LAW 2", T.is_caps_title) and not one("Law", T.is_caps_title)
    assert one("Page 4 of 10", T.is_page_number) and not one("4 pages", T.is_page_number)
    assert one("(a) the fee", T.is_structural_start) and not one("the fee", T.is_structural_start)
    assert one("[3] see the annex", T.is_footnote)
    assert one("“Fee” means the sum due.", T.is_definition) and not one("The fee means much.", T.is_definition)
    assert one("Name: A\nTitle: B", T.is_signature) and not one("1. Name: A Title: B", T.is_signature)


def test_extraction(one):
    got = one("Due 2024-01-05: $1,200.50 or 5 % within 30 days, 30 Days.", T.spans)
    assert got.dates == ["2024-01-05"] and got.money == ["$1,200.50"] and got.percentages == ["5 %"] and got.durations == ["30 days"]
    s = one("The supplier shall pay under Section 3. Unless Schedule A says so, \"Fee\" is due.", T.clause_structure)
    assert s.sections == ["Section 3"] and s.documents == ["Schedule A"] and s.terms == ["Fee"] and len(s.duties) == 1 and len(s.exceptions) == 1 and s.role == "obligation"
    m = one("This is between Alpha Ltd and Beta Inc. It is governed by the laws of France.", T.metadata)
    assert m.parties.value == ["Alpha Ltd", "Beta Inc"] and m.governing_law.value == "France" and m.forum.value is None
    assert one("a. B c? D", lambda c: F.size(T.sentences(c))) == 3


def test_labels(one):
    table = {"law": r"(?i)\blaw\b", "fee": r"(?i)\bfee\b"}
    assert one("fee and law", lambda c: T.first_label(c, table)) == "law"
    assert one("fee and law", lambda c: T.first_label(c, table, F.array(F.lit("fee")))) == "fee"
    assert one("fee and law", lambda c: T.tags(c, table)) == ["law", "fee"]
    pairs = [("a", "b", "left", "right")]
    assert one("right", lambda c: T.resolve_pairs(c, F.lit("a"), pairs)).label == "b"
    assert one("left right", lambda c: T.resolve_pairs(c, F.lit("a"), pairs)) == ("a", "unchanged")
    assert one("right", lambda c: T.resolve_pairs(c, F.lit("z"), pairs)).label == "z"


def test_questions(one):
    q = one("What is the notice period in clause 3, 4 and 5?", lambda c: T.question_terms(c, {"notice": ["terminate"]}))
    assert q.direct == ["notice", "period", "clause"] and q.expanded == ["terminate"]
    assert one("clauses 3, 4 and 5", T.clause_numbers) == ["3", "4", "5"]
    assert one("show clause 7.2", T.single_clause_lookup) == "7.2" and one("clauses 1 and 2", T.single_clause_lookup) is None
    assert one("Who are the parties and what must they do?", T.intents).party is False


def test_model_output(one):
    raw = '<think>hm {"label": "x"}</think> so: {"label": "FEE"}'
    assert one(raw, lambda c: T.closed_set_prediction(c, ["fee", "law"]))[:2] == ("fee", "json")
    assert one(" Law. ", lambda c: T.closed_set_prediction(c, ["fee", "law"]))[:2] == ("law", "text")
    assert one("none", lambda c: T.closed_set_prediction(c, ["fee"]))[:2] == (None, "out_of_set")
    assert one(None, lambda c: T.closed_set_prediction(c, ["fee"]))[1] == "empty"


def test_checklist(one):
    raw = '<think>x</think>[{"id": "a", "answer": "yes", "evidence": "e"}, {"id": "b", "answer": "NO"}, {"id": "b", "answer": "YES"}, {"id": "c", "answer": "maybe"}, {"id": "z", "answer": "NO"}]'
    got = one(raw, lambda c: T.checklist_answers(c, F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert [tuple(x) for x in got] == [("a", "yes", "e")]
    assert one("no json", T.checklist_answers) == [] and one(None, T.checklist_answers) == []


def test_small_tools(one):
    assert one("Fee & Law!", T.slug) == "fee-law" and one("abcdefghij", lambda c: T.clip(c, 8)) == "abcde..." and one("limitations", T.stem) == "limit"
    assert one("a b c d", lambda c: T.shingles(F.split(c, " "), 3)) == ["a b c", "b c d"] and one("a", lambda c: T.shingles(F.split(c, " "), 3)) == []
    assert one("7.5", lambda c: T.bounded_number(c, 0, 5)) is None and one("4", lambda c: T.bounded_number(c, 0, 5)) == 4.0
    assert one("2024-02-30", T.iso_date) is None and str(one("2024-02-28", T.iso_date)) == "2024-02-28"
    assert one("doc", lambda c: T.stable_uuid(c, F.lit("fee"), F.lit("0"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc::fee::0"))
    assert one("Laws of England and New York", lambda c: T.codes(c, {"england": "UK", "new york": "US-NY"})) == ["UK", "US-NY"]
    assert one("Alpha pays 5%; Beta pays 9%", lambda c: T.attributed(c, "Beta", "9%")) and not one("Alpha pays 5%; Beta pays 9%", lambda c: T.attributed(c, "Beta", "5%"))
    assert T.phrase_pattern("party agreement") is None and one("Late  fee due", lambda c: c.rlike(T.phrase_pattern("late fee")))
    assert one("Missing cap", T.polarity) == "NO" and one("x", lambda c: T.mapped(c, {"X": "y"}, [], "z")) == "y"


def test_quotes(one):
    source = "The Supplier shall pay the “Fee” — in full — by Monday."
    assert unicode.locate_quote(source, 'shall pay the "fee" - in full') == "shall pay the “Fee” — in full"
    assert unicode.locate_quote(source, "The Supplier shall ... by Monday.") == source
    assert unicode.locate_quote(source, "The Supplier shall never pay") is None and unicode.locate_quote(source, "pay") is None
    assert one("x", lambda c: unicode.source_quote(F.lit(source), F.lit("in full - by Monday"))) == "in full — by Monday"
    text, starts, ends = unicode.folded("ﬁne  Ab")
    assert text == "fine ab" and len(starts) == len(ends) == len(text)
    assert unicode.sentence_at("One. See e.g. two. Three.", 10) == "See e.g. two."
    assert unicode.ratio("", "") == 1.0 and unicode.greedy_distinct(["the fee is due", "the fee is due.", "law"]) == [0, 2]


def test_models(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c",)], "t string")
    got = models.embed_distinct(df, "t", models.HashingEmbedder(64)).collect()
    assert all(abs(sum(v * v for v in r.embedding.values()) - 1) < 1e-9 for r in got)
    asked = models.ask(df, models.prompt("Say", ("text", F.col("t"))), models.StubModel(["YES", "NO"])).collect()
    assert len(asked) == 3 and {r.answer for r in asked} <= {"YES", "NO"} and models.passes(df, 3).count() == 9


def test_contract_metadata(one):
    m = one("Party A (Buyer): Alpha Ltd Address: 1 Road\nParty B: Beta Inc\nThis Agreement is dated 3 May 2021. It takes effect upon signature by both. Expiration date: 2025-01-31. Disputes shall be heard in Lyon.", T.metadata)
    assert m.parties.value == ["Alpha Ltd", "Beta Inc"] and m.agreement_date.value == "3 May 2021" and m.expiration_date.value == "2025-01-31"
    assert m.effective_date.value is None and m.effective_date_condition.value == "It takes effect upon signature by both"
    assert m.forum.value == "Lyon" and m.expiration_terms.value is None and "heard in Lyon" in m.forum.evidence
    m = one("Commencement Date: May 3, 2021. Effective upon notice. It is valid for an indefinite term.", T.metadata)
    assert m.effective_date.value == "May 3, 2021" and m.effective_date_condition.value is None
    assert m.expiration_terms.value == "It is valid for an indefinite term" and m.parties.value is None
    empty = one("", T.metadata)
    assert all(f.value is None and f.evidence is None for f in empty)
