"""Operators on micro-fixtures of our own wording."""

import json
import math

import pytest
from pyspark.sql import functions as F

from clausewright.operators import dataset, governance, metrics, retrieval, review, rules, segment
from clausewright.sources import readers, sinks
from clausewright.streaming import trace


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rules(spark):
    table = [rules.Rule("renew", "exit", r"(?i)renews? automatically", (r"(?i)\bnot\b",)), rules.Rule("cap", "money", r"\$\d+", hint="$")]
    df = spark.createDataFrame([(1, "It renews automatically for $5."), (2, "It does not renew automatically."), (3, None), (4, "not " + "x" * 200 + " renews automatically")], "id int, text string")
    got = rules.matches(df, table).select("id", "rule_id", "position", "quote").collect()
    assert {tuple(r) for r in got} == {(1, "renew", 4, "renews automatically"), (1, "cap", 29, "$5"), (4, "renew", 206, "renews automatically")}
    with pytest.raises(Exception):
        rules.Rule("bad", "x", "(")


def test_applicable(spark):
    c = spark.createDataFrame([(1, "Renewal Term", "x"), (2, None, "late fee due"), (3, "", "nothing")], "clause_id int, label string, text string")
    k = spark.createDataFrame([("Renewal", "c1", ["renew"]), ("Fees", "c1", ["late fee"]), ("Fees", "c2", ["late fee"])], "category string, check_id string, keywords array<string>")
    assert set(rows(rules.applicable(c, k))) == {(1, "Renewal", "c1@renewal", "partial"), (2, "Fees", "c1@fees", "keyword"), (2, "Fees", "c2", "keyword")}


def test_evidence(spark):
    c = spark.createDataFrame([("d", 1, "the fee is due"), ("d", 2, "the cap is ten"), ("d", 3, "the cap is ten too")], "doc string, clause_id int, text string")
    f = spark.createDataFrame([("d", "a", 1, "fee is due"), ("d", "b", 1, "ten too"), ("d", "c", 1, "cap is ten"), ("d", "e", 1, "nowhere"), ("d", "g", 1, "")], "doc string, finding_id string, clause_id int, evidence string")
    got = {r.finding_id: (r.status, r.resolved) for r in rules.locate_evidence(f, c).collect()}
    assert got == {"a": ("TARGET", 1), "b": ("CONTEXT", 3), "c": ("AMBIGUOUS", None), "e": ("NOT_FOUND", None), "g": ("NOT_FOUND", None)}


def test_status(spark):
    df = spark.createDataFrame([("YES", "YES", True), ("NO", "YES", True), ("YES", "YES", False), ("MAYBE", "YES", True)], "a string, t string, e boolean")
    assert [r.s for r in df.select(rules.resolve_status(F.col("a"), F.col("t"), F.col("e")).alias("s")).collect()] == ["RISK", "NO_RISK", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"]
    s = spark.createDataFrame([(1, "caps and law"), (2, "caps")], "id int, text string")
    assert rows(rules.single_signals(s, "id", {"both": [["caps"], ["law", "rule"]]})) == [(1, "both")]
    assert rows(rules.domains(s, {"money": ["caps"], "law": ["law", "and"]}, "id").orderBy("id", "rank")) == [(1, "law", 2, 1), (1, "money", 1, 2), (2, "money", 1, 1)]


def test_unpivot(spark):
    df = spark.createDataFrame([("f1", "['one', \"it's two\"]", "Yes", "plain", "No"), ("f2", "[]", "No", r"['a\xe9b']", "Yes"), ("f3", None, None, " ", None)], "Filename string, Fee string, `Fee-Answer` string, Law string, `Law - Answer` string")
    pairs = dataset.answer_pairs(df.columns)
    assert pairs == [("Fee", "Fee-Answer"), ("Law", "Law - Answer")] and dataset.find_column(df.columns, "fee", "answer") == "Fee-Answer"
    got = dataset.wide_to_long(df, "Filename", pairs, dataset.parse_spans).select("Filename", "clause_type", "span_index", "clause_text", "answer")
    assert set(rows(got)) == {("f1", "Fee", 0, "one", "Yes"), ("f1", "Fee", 1, "it's two", "Yes"), ("f1", "Law", 0, "plain", "No"), ("f2", "Law", 0, "aéb", "Yes")}


def test_quantile(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 11)] + [("b", 7)], "g string, v int")
    got = {r.g: (r.n, r.least, r.median, r.most, r.p95) for r in dataset.length_profile(df, F.col("v"), ["g"]).collect()}
    assert got == {"a": (10, 1, 5.5, 10, 10.0), "b": (1, 7, 7.0, 7, 7.0)}
    array = F.array(*[F.lit(i) for i in range(1, 21)])
    assert abs(spark.range(1).select(dataset.exclusive_quantile(array, 0.95)).first()[0] - 19.95) < 1e-9


def test_splits(spark):
    df = spark.createDataFrame([(f"d{i // 3}", i) for i in range(60)], "doc string, n int")
    s = dataset.split_documents(df, "doc", first=5)
    assert s.where("split = 'train'").count() == 15 and dataset.leaking(s, "doc", "split").count() == 0
    m = dataset.field_mismatches(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "b"), (3, "c")], "k int, v string"), "k", ["v"])
    assert set(rows(m)) == {(1, "v"), (2, "missing"), (3, "unexpected")}


def test_retrieval(spark):
    h = spark.createDataFrame([("q", i, l, s) for i, (l, s) in enumerate([("a", 0.9), ("a", 0.8), ("a", 0.7), ("b", 0.6), ("c", 0.5)])], "q string, id int, label string, score double")
    assert [r.id for r in retrieval.diversify(h, "q", "label", "score", "id", 2, 4).orderBy("place").collect()] == [0, 1, 3, 4]
    assert [r.id for r in retrieval.diversify(h, "q", "label", "score", "id", 1, 5).orderBy("place").collect()] == [0, 3, 4, 1, 2]
    k = retrieval.knn(retrieval.ranked(h, ["q"], "score", "id"), "q", "label").first()
    assert (k.top1, k.majority, k.weighted) == ("a", "a", "a")
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, z array<double>, s array<double>")
    assert tuple(v.select(retrieval.cosine(F.col("a"), F.col("a")), retrieval.cosine(F.col("a"), F.col("z")), retrieval.cosine(F.col("a"), F.col("s"))).first()) == (1.0, 0.0, 0.0)
    d = spark.createDataFrame([(1, "Fee fee due"), (2, "law of the land"), (3, None)], "id int, text string")
    assert [r.id for r in retrieval.select_clauses(d, ["fee"], ["law"], "id").collect()] == [1, 2]
    assert [r.id for r in retrieval.select_clauses(d, ["fee"], [], "id", explicit=[3]).collect()] == [3, 1]
    p = retrieval.letter_probabilities(spark.createDataFrame([("k", "A", -0.1), ("k", "B", -2.0), ("k", "A", -3.0)], "k string, l string, lp double"), "k", "l", "lp")
    assert abs(sum(r.p for r in p.collect()) - 1) < 1e-9


def test_metrics(spark):
    assert metrics.mcnemar_p(0, 0) == 1.0 and abs(metrics.mcnemar_p(1, 9) - 22 / 1024) < 1e-9
    df = spark.createDataFrame([(1, 0.9, "c1"), (0, 0.1, "c1"), (1, 0.3, "c2"), (0, 0.3, "c2"), (1, 1.0, "c3")], "y int, p double, c string")
    assert metrics.auroc(df, F.col("y"), F.col("p")).first()[0] == round((1 + 1 + 1 + 0.5 + 1 + 1) / 6, 6)
    bins = {r.bin: r.n for r in metrics.calibration_bins(df, F.col("y"), F.col("p")).collect()}
    assert bins == {9: 2, 1: 1, 3: 2}
    v = spark.createDataFrame([("k", "YES", 1), ("k", "NO", 2), ("k", "YES", 3), ("j", "YES", 1), ("j", "NO", 2)], "k string, a string, o int")
    assert set(rows(metrics.strict_majority(v, "k", "a", "o", 3))) == {("k", "YES", round(2 / 3, 6)), ("j", "DON'T KNOW", round(1 / 3, 6))}
    assert set(rows(metrics.plurality(v, "k", "a", "o"))) == {("k", "YES", 2), ("j", "YES", 1)}
    m = metrics.fit_calibration(spark.createDataFrame([(i / 100, int(i + 17 * (i % 5) > 60)) for i in range(100)], "x double, y int"), "x", "y")
    assert m[0] > 0 and metrics.fit_calibration(df, "p", "y") is None
    got = df.select(metrics.calibrated(F.col("p"), m, F.col("c") == "c1").alias("q")).collect()
    assert [r.q is None for r in got] == [False, False, True, True, True] and abs(got[0].q - 1 / (1 + math.exp(-(m[0] * 0.9 + m[1])))) < 1e-9


def test_bootstrap(spark):
    df = spark.createDataFrame([(f"c{i % 8}", i % 3, (i * 7) % 3) for i in range(120)], "c string, g int, p int")
    got = metrics.cluster_bootstrap_accuracy(df, "c", "g", "p", n=100).first()
    w = {(r.c, r.replicate): r.weight for r in metrics.replicates(df.select("c").distinct(), "c", 100).collect()}
    accuracies = []
    sums = {c: (sum(1 for i in range(120) if f"c{i % 8}" == c), sum(1 for i in range(120) if f"c{i % 8}" == c and i % 3 == (i * 7) % 3)) for c in {f"c{k}" for k in range(8)}}
    for b in range(1, 101):
        n = sum(w.get((c, b), 0) * s[0] for c, s in sums.items())
        if n:
            accuracies.append(sum(w.get((c, b), 0) * s[1] for c, s in sums.items()) / n)
    accuracies.sort()
    at = lambda q: accuracies[int(q * (len(accuracies) - 1))] * (1 - (q * (len(accuracies) - 1)) % 1) + accuracies[min(len(accuracies) - 1, int(q * (len(accuracies) - 1)) + 1)] * ((q * (len(accuracies) - 1)) % 1)
    assert abs(got.low - at(0.025)) < 1e-5 and abs(got.high - at(0.975)) < 1e-5


def test_segments(spark):
    text = "PAYMENT TERMS\n1. The buyer shall pay each invoice within thirty days of receipt.\n2. Late sums bear interest; (a) At five percent a year, and more.\n\nThis paragraph stands alone and is long enough to be one."
    got = segment.split_clauses(text)
    assert got[0].startswith("PAYMENT TERMS 1.") and any(c.startswith("(a) At") or "(a) At" in c for c in got) and got[-1].startswith("This paragraph")
    assert segment.split_clauses("") == segment.split_clauses(None) == []
    assert all(len(c) <= 100 for c in segment.pack_sentences("One short sentence here. " * 20, 100))
    assert segment.hierarchy([(0, "1.", 0.0), (1, "(a)", 1.0), (2, "(b)", 1.0), (3, "2.", 0.0), (4, "(a)", 1.0), (5, "2.", 0.0)]) == [("1", None, 0), ("1.a", "1", 1), ("1.b", "1", 1), ("2", None, 0), ("2.a", "2", 1), ("2#2", None, 0)]
    df = spark.createDataFrame([("d", p, f"ACME Contract\nbody {p} text\nPage {p}") for p in range(4)], "doc string, page int, text string")
    assert [r.text for r in segment.strip_furniture(df, "doc", "page", "text", edge=1).orderBy("page").collect()] == [f"body {p} text" for p in range(4)]
    one = spark.createDataFrame([("a\n[1] note\nmore\n\nb",)], "t string").select(segment.strip_footnotes(F.col("t"))).first()[0]
    assert one == "a\n\nb"
    nodes = spark.createDataFrame([("d", "1", None, "1", "x", 2), ("d", "1.a", "1", "a", "y", 1), ("d", "1.b", "1", "a", "y", 3)], "doc string, id string, up string, num string, text string, page int")
    assert set(rows(segment.tree_problems(nodes, "doc", "id", "up", "num", "text", "page"))) == {("d", "1.a", "duplicate_text"), ("d", "1.b", "duplicate_text"), ("d", "1.a", "duplicate_sibling_number"), ("d", "1.b", "duplicate_sibling_number"), ("d", "1.a", "page_order")}


def test_review(spark):
    c = spark.createDataFrame([("a", "s1", "the Fee is due monthly", 0), ("a", "s1", "THE FEE is due monthly", 1), ("a", "s1", "the fee is never due", 2)], "answer string, source string, quote string, position int")
    s = spark.createDataFrame([("s1", "Here the  fee is due monthly, always.")], "source string, text string")
    ok = review.verify_citations(c, s, "answer", "source", "quote")
    assert [(r.position, r.verified_quote) for r in ok.collect()] == [(0, "the  fee is due monthly")]
    assert rows(review.unverified(c, ok, "answer", ["position"])) == [("a", True)]
    sel = spark.createDataFrame([("d", i, "x" * 50) for i in range(20)], "doc string, o int, text string")
    got = review.context(sel, "doc", "o", "text", cap=12, chars=10, budget=200, few=3).first()
    assert got.n_clauses == 3 and len(json.loads(got.payload)) == 3
    e = spark.createDataFrame([(" q ", ["q", "r", ""], ["3", "x", "1", "3"])], "one string, many array<string>, ids array<string>")
    assert tuple(e.select(review.evidence_list(F.col("one"), F.col("many")), review.clause_list(F.col("ids"))).first()) == (["q", "r"], [1, 3])
    q = spark.createDataFrame([("d", "q1", "show clause 2"), ("d", "q2", "show clauses 1 and 2")], "doc string, question_id string, question string")
    cl = spark.createDataFrame([("d", "2", 7, "two"), ("d", "2", 9, "other")], "doc string, number string, clause_id int, text string")
    assert rows(review.direct_answer(q, cl, "question", "doc")) == [("d", "q1", 7, "two")]


def test_governance(spark):
    play = json.dumps({"sources": {"s": {"title": "T", "tier": "A"}}, "clause_types": {"Fees": {"keywords": ["fee"], "checklist": [{"id": "c1", "question": " Is it capped? ", "flag_if": "no", "domain": "money", "sources": ["s"]}, {"id": "", "question": "x"}]}}, "cross_clause_checks": [{"id": "x", "pair": ["a", "b"], "question": "q"}], "document_checks": []})
    p = spark.createDataFrame([(play,)], "j string").select(F.from_json("j", governance.PLAYBOOK).alias("p")).select("p.*")
    assert [(r.check_id, r.question) for r in governance.clause_checks(p).collect()] == [("c1", "Is it capped?")] and governance.cross_checks(p).count() == 1
    r = spark.createDataFrame([("c1",), ("c2",)], "id string")
    with pytest.raises(Exception, match="no registry record"):
        governance.attach_registry(r, spark.createDataFrame([("c1", 1)], "id string, v int"), ["id"]).collect()
    assert rows(governance.registry_audit(spark.createDataFrame([("c1",), ("c1",), ("z",)], "id string"), r, "id")) == [(3, 1, 1, 1)]
    g = spark.createDataFrame([("the fee", "fee", 4, 7, "x", "y"), ("the fee", "fee", 0, 3, "x", "x")], "t string, q string, s int, e int, a string, b string")
    got = g.select(governance.gold_problems(F.col("t"), F.col("q"), F.col("s"), F.col("e"), F.sha2("q", 256), (F.col("a"), F.col("b")))).collect()
    assert [r[0] for r in got] == [[], ["offset_mismatch", "same_reviewer"]]
    m = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, sha256 string")
    f = spark.createDataFrame([("a", bytearray(b"1"))], "path string, content binary")
    assert set(rows(governance.manifest_audit(m, f))) == {("a", "changed"), ("b", "missing")}
    s = governance.scenarios(spark.createDataFrame([("c1",)], "check_id string"), {"positive": "RISK", "control": "NO_RISK"})
    assert {r.scenario_id for r in s.collect()} == {"c1__positive", "c1__control"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"a ""b""\nc"\n', encoding="utf-8")
    got = readers.csv(spark, str(tmp_path / "a.csv"), ("id",), {"flag": False})
    assert rows(got) == [("1", 'a "b"\nc', False)]
    with pytest.raises(ValueError, match="lacks"):
        readers.csv(spark, str(tmp_path / "a.csv"), ("nope",))
    (tmp_path / "b.jsonl").write_text('{"k": "a", "v": 1}\nbroken\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n{"v": 4}\n')
    assert set(rows(readers.jsonl_last(spark, str(tmp_path / "b.jsonl"), "k string, v int", "k"))) == {("a", 3), ("b", 2)}
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(tmp_path / "b.jsonl"), "k string, v int").collect()
    (tmp_path / "n").mkdir()
    (tmp_path / "n/x.md").write_text("---\ntitle: T: one\ntier: A\n---\nBody text")
    files = readers.text_documents(spark, str(tmp_path / "n"), "*.md")
    reg = spark.createDataFrame([("x.md", {"tier": "B", "law": "UK"})], "filename string, meta map<string,string>")
    r = readers.front_matter(files, reg, ("title",)).first()
    assert r.meta == {"tier": "A", "law": "UK", "title": "T: one"} and r.body == "Body text"
    qa = spark.createDataFrame([("t", [{"context": "c", "qas": [{"id": "f__Fee", "question": "q", "is_impossible": False, "answers": [{"text": "five", "answer_start": 1}]}]}])], readers.QA)
    assert rows(readers.nested_qa(qa)) == [("t", 0, "f__Fee", "Fee", ["five"], 1)]
    c = spark.createDataFrame([("d", " ", "raw", "true", "Fee"), ("d", "clean", "raw", "no", "Fee"), ("d", None, None, None, "Fee")], "document_id string, clause_text_clean string, clause_text string, is_metadata string, label string")
    assert [r.clause_text for r in readers.clauses(c).collect()] == ["clean"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], {"k": "v"}, None)], "id int, l array<string>, m map<string,string>, p string")
    assert rows(sinks.flat(df, {"p": ("m", "k")})) == [(1, '["a"]', '{"k":"v"}', "v")]
    sinks.csv(df.select("id", "l"), str(tmp_path / "c"), ["l", "id"])
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).columns == ["l", "id"]
    where = str(tmp_path / "v")
    assert sinks.vectors(spark, where) is None
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sinks.upsert_vectors(first, where, ["id"]) == 2
    assert sinks.upsert_vectors(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), where, ["id"]) == 3
    assert sorted(map(tuple, sinks.vectors(spark, where).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [m.role for m in sinks.chat_rows(spark.createDataFrame([("q", "a")], "u string, s string"), "sys", "u", "s").first().messages] == ["system", "user", "assistant"]
    got = sinks.replace_keys(spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string"), spark.createDataFrame([(None, "x"), (2, "y")], "k int, v string"), ["k"])
    assert set(rows(got)) == {(1, "a"), (None, "x"), (2, "y")}


def test_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = str(tmp_path / "log")
    events.repartition(3).write.parquet(log)
    s = trace.stream(spark, log, events.schema, 1)
    trace.materialise_latest(s, str(tmp_path / "latest"), str(tmp_path / "cp"), "user_id", "ts", "event_id", ["event_type"]).awaitTermination(120)
    want = {(r.user_id, r.event_type) for r in trace.latest_status(events, "user_id", "ts", "event_id", ["event_type"]).collect()}
    assert {(r.user_id, r.event_type) for r in trace.read_latest(spark, str(tmp_path / "latest")).collect()} == want
    done = spark.createDataFrame([(1, "h"), (2, "other")], "k int, config string")
    assert {r.k for r in trace.resume(spark.createDataFrame([(1,), (2,), (3,)], "k int"), done, ["k"], "config", "h").collect()} == {2, 3}
    q = trace.windowed_counts(s, "ts", "event_type", "1 day").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    assert trace.with_retry(lambda: 1 / 0, 2, lambda k: 0, default="d", closed=False)() == "d"


def test_running(spark):
    df = spark.createDataFrame([(float(k % 97) if k % 97 else None, k) for k in range(97)], "s double, n long")
    for down in (False, True):
        rows = sorted(df.collect(), key=lambda r: (r.s is not None, r.s or 0.0), reverse=down)
        want, total = {}, 0
        for r in rows:
            total += r.n
            want[r.n] = (total, total - r.n)
        got = metrics.running(metrics.running(df, "s", {"a": "n"}, down), "s", {"b": "n"}, down, inclusive=False).collect()
        assert {r.n: (r.a, r.b) for r in got} == want


def test_dense_topk_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k), 1.0, -float(k % 3)]) for k in range(12)], "vec_id long, embedding array<double>")
    queries = rows.toDF("q_id", "embedding")
    whole = sorted(map(tuple, retrieval.dense_topk(queries, rows, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    assert sorted(map(tuple, retrieval.dense_topk(queries, rows, 3).collect())) == whole


def test_rrf_full(spark):
    rows = spark.createDataFrame([("q", 1, 0.9, 0.1), ("q", 2, 0.5, 0.5), ("q", 3, 0.5, 0.2)], "q string, id int, a double, b double")
    got = {r.id: (r.rank_left, r.rank_right, r.rrf) for r in retrieval.rrf_full(rows, ["q"], "a", "b", "id").collect()}
    assert got == {1: (0, 2, 1 / 60 + 1 / 62), 2: (1, 0, 1 / 61 + 1 / 60), 3: (2, 1, 1 / 62 + 1 / 61)}


def test_starter_playbook(spark):
    seed = governance.playbook_or_starter(spark.createDataFrame([], governance.PLAYBOOK))
    per_clause = governance.clause_checks(seed).collect()
    assert {r.check_id for r in per_clause} == {i for _, items in governance.STARTER.values() for i, *_ in items}
    assert all(r.keywords and r.flag_if in ("YES", "NO") and r.sources == ["starter"] for r in per_clause)
    assert {r.check_id for r in governance.cross_checks(seed).collect()} == {"X-1", "X-2"}
    assert governance.playbook_or_starter(seed) is seed
