"""Odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from clausewright.llm import classifier, exact_dedup, html_text, line_dedup, mixing, near_dedup, packing, quality_rules, substring_dedup, warc
from clausewright.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, id string, norm int, kept string, copy_index string, places int, label string, key int"
PROSE = " ".join(f"word{i % 97} of the house{i}" for i in range(30))
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))


def row(i, text, source="a"):
    return (i, text, None, source, None, "other", "x", 1, "no", "c", 3, "l", 9)


ROWS = [
    row(1, None), row(2, ""), row(3, " \n\t "), row(4, PROSE), row(4, PROSE), row(5, PROSE + "  "), row(6, LONG, None), row(7, LONG + " end"),
    row(None, PROSE), row(None, None, None), row(8, "one"), row(9, "ONE"), row(10, "\u0000 \U0001f600 é́ \n|\n###\n***"), row(11, "a b\na b\na b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (6, 1, 1), (None, 1, 0), (8, None, 0), (9, 0, None)], "doc_id long, quality int, toxic int")


def tokens():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_empty_tables(spark, none, labels):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack(none, tokens()).count() == 0
    assert classifier.classify(none, labels).count() == 0
    assert classifier.classify(none, labels.limit(0)).count() == 0
    assert html_text.extract(none, "doc_id", "source", "text").count() == 0
    uri = Scratch(spark, "warc-test").root
    assert warc.write(none, uri, "doc_id", "source", "text").count() == 0
    assert warc.read(spark, uri).count() == 0


def test_exact(odd):
    got = {(r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()}
    assert {(5, 5, 4, True), (4, 5, 4, False), (None, 5, 4, False)} <= got
    assert {(1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (None, 3, 4, False)} <= got
    assert {(6, 6, 1, True), (8, 8, 1, True), (9, 9, 1, True)} <= got
    assert exact_dedup.exact_dedup(odd).count() == len(ROWS)


def test_exact_without_broadcast(odd):
    a = sorted(map(str, exact_dedup.exact_dedup(odd, digest_all=True).collect()))
    assert a == sorted(map(str, exact_dedup.exact_dedup(odd, digest_all=True, broadcast_pairs=0).collect()))


def test_quality(odd):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == len(ROWS)
    by = {r.id: r for r in got if r.id is not None}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[6].n_words == 60_000
    assert (by[11].n_dup_lines, by[11].n_repeat_words, by[11].word_chars) == (2, 6, 6)
    assert by[10].n_symbols == 7


def test_near(odd):
    got = [(r.id, r.n_shingles, r.component, r.kept) for r in near_dedup.near_duplicates(odd, size=3, percent=85).collect()]
    assert len(got) == len(ROWS)
    by = {g[0]: g for g in got if g[0] is not None}
    assert by[1][1:] == (0, 1, True) and by[3][1:] == (0, 3, True)
    assert by[5][2:] == (4, False) and sum(g == by[4] for g in got) == 2
    assert by[7][2:] == (6, False) and by[9][2:] == (8, False) and by[8][1] == 1
    assert sum(g[0] is None and g[2] is None and g[3] for g in got) == 2


def test_substring(odd):
    got = [(r.id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(odd).collect()]
    assert len(got) == len(ROWS)
    n = len(PROSE.split())
    assert got.count((4, n, 0)) == 2 and (5, n, n) in got and (None, n, 0) in got and (None, 0, 0) in got
    assert (6, 60_000, 0) in got and (7, 60_001, 60_000) in got


def test_lines(odd):
    got = line_dedup.line_dedup(odd)
    assert got.columns == odd.columns and got.count() == len(ROWS)
    by = {}
    for r in got.collect():
        by.setdefault(r[0], []).append(r[1])
    assert by[1] == [None] and by[2] == [""] and by[3] == [" \n\t "]
    assert by[4] == [PROSE, PROSE] and by[5] == [""] and sorted(by[None], key=str) == [None, PROSE]
    assert by[8] == ["one"] and by[9] == [""] and by[11] == ["a b"]
    assert by[6] == [LONG] and by[7] == [""]


def test_mixing(odd, spark):
    got = mixing.mix(odd, epochs=2.0)
    assert got.columns[:9] == odd.columns[:9] and got.columns[-1] == "copy_index" and got.columns.count("copy_index") == 1
    again = mixing.mix(odd.repartition(7), epochs=2.0)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(odd, weights, epochs=100.0).select("source").collect()} == {"a"}


def test_packing(odd):
    got = packing.pack(odd, tokens(), with_ids=True).collect()
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    assert [r.length for r in got if r.id == 1] == [1]
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 4096


def test_classifier(odd, labels):
    got = classifier.classify(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    one = classifier.classify(odd, labels.where("quality = 1")).collect()
    assert {r.score for r in one} <= {1.0}


def test_html(odd):
    got = html_text.extract(odd, "doc_id", "source", "text").collect()
    assert len(got) == len(ROWS) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.id == 1] == [""]


def test_warc(spark, odd):
    uri = Scratch(spark, "warc-test").root
    manifest = warc.write(odd, uri, "doc_id", "source", "text", roll_bytes=20_000, least=500)
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS)
    got = warc.read(spark, uri).collect()
    raw = sorted(((r[0], r[3], (r[1] or "").encode()) for r in ROWS), key=str)
    want = {(i, u) for i, u, _ in raw}
    assert {(r.id, r.url) for r in got} == want and len(got) == len(ROWS)
    for r in got:
        if r.record_type == "response":
            assert (r.id, r.url, bytes(r.payload)) in raw
    assert {(r.id, r.refers_to) for r in got if r.record_type == "revisit"} == {(None, 4)}


def test_warc_files_depend_on_the_rows_alone(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = []
    for parts, shuffle in ((1, "3"), (9, "11")):
        uri = Scratch(spark, "warc-test").root
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        found.append(sorted(map(tuple, warc.write(pages.repartition(parts), uri, roll_bytes=30_000, shard_bytes=40_000).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) > 2
