"""Operators against brute force that knows nothing of their candidates."""

import random

from clausewright.llm import line_dedup, near_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_short_lines_by_edits(spark):
    """Every link of lines below 50 characters, at any place and of any kind of edit."""
    r = random.Random(7)
    lines = []
    for _ in range(60):
        base = "".join(r.choice("abcdefgh ") for _ in range(r.randrange(8, 48))).strip() or "a"
        lines.append(" ".join(base.split()))
        for _ in range(2):
            x = list(lines[-1])
            for _ in range(r.randrange(1, 6)):
                at = r.randrange(len(x))
                x[at] = r.choice([x[at] + "z", "y", ""])
            lines.append(" ".join("".join(x).split()) or "b")
    lines = [x for x in dict.fromkeys(lines) if len(x) < 50] + ["page 3 of 9 in all", "page 4 of 9 in all"]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            if 10 * distance(x, y) <= max(len(x), len(y)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: x if find(i) == i else "" for i, x in enumerate(lines)} and "" in got.values()


def test_long_lines_by_edits(spark):
    """Lines of 10 to 80 words with one word changed are found but for the stated share; others stay."""
    r = random.Random(8)
    docs = []
    for i in range(100):
        w = [f"{r.choice('abcdefgh')}{r.randrange(10**5)}" for _ in range(r.randrange(10, 80))]
        docs.append((2 * i, " ".join(w)))
        w[r.randrange(len(w))] = "other"
        docs.append((2 * i + 1, " ".join(w)))
    want = {i for i, x in docs if i % 2 and 10 * distance(x, docs[i - 1][1]) <= max(len(x), len(docs[i - 1][1]))}
    got = {x.id for x in line_dedup.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 0


def test_crowd_loses_no_link(spark):
    """Members of a family, each with one link near the threshold, in regions larger than ``crowd``."""
    r = random.Random(4)
    texts = {}
    for f in range(40):
        w = [f"f{f}w{k}" for k in range(104)]
        for i in range(6):
            texts[6 * f + i] = " ".join(w)
            at = r.randrange(0, 90)
            w = w[:at] + [f"n{f}x{i}y{k}" for k in range(6)] + w[at + 6 :]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(100)} for i, t in texts.items()}
    want = {i: i for i in texts}
    for i in sorted(texts):
        for j in range(i - i % 6, i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if c == old else c for k, c in want.items()}
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=5, percent=80, crowd=1).collect()
    assert {g.id: g.component for g in got} == want and set(want.values()) != set(want)


def test_bucket_of_strangers_loses_no_link(spark, monkeypatch):
    """Two alike lines meet in one bucket only, where any number of strangers stand between them."""
    from clausewright.llm.scratch import Scratch

    r = random.Random(9)
    texts = []
    for _ in range(60):
        x = "".join(r.choice("abcdefgh") for _ in range(r.randrange(60, 120)))
        texts += [x, x[:30] + "z" + x[31:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = [((i, 0), len(x), None, [7, r.randrange(1 << 60)]) for i, x in enumerate(texts)]
    lines = spark.createDataFrame(rows, "line struct<id: long, place: int>, chars int, short string, blocks array<long>")
    for block in (1000, 20):
        monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
        found = line_dedup.groups(lines, docs, 0.9, Scratch(spark, "test"), 1 << 20).collect()
        assert {(x.line.id, x.root.id) for x in found} == {(2 * k + 1, 2 * k) for k in range(60)}


def test_moved_passages_by_edits(spark):
    """Pairs that cannot be followed in pieces are judged by their whole edit distance."""
    r = random.Random(10)
    pairs = []
    for _ in range(60):
        x = "".join(r.choice("ab ") for _ in range(400)) if r.random() < 0.5 else "ab cd " * 80
        y = list(x)
        for _ in range(r.randrange(20, 44)):
            y[r.randrange(len(y))] = r.choice("abcdef")
        at, to = r.randrange(100, 300), r.randrange(100, 300)
        y = y[:at] + y[at + 14 :]
        pairs.append((x, "".join(y[:to] + list(x[at : at + 14]) + y[to:])))
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(t for p in pairs for t in p)], "line long, norm string")
    got = {x.a // 2 for x in line_dedup.verified(spark.createDataFrame([(2 * i + 1, 2 * i) for i in range(len(pairs))], "a long, b long"), texts, 0.9).collect()}
    want = {i for i, (x, y) in enumerate(pairs) if 10 * distance(x, y) <= max(len(x), len(y))}
    assert got == want and 0 < len(want) < len(pairs)


def test_replaced_words_by_edits(spark):
    """Pairs proved word by word, or whose starts differ most, are the pairs that the whole edit distance gives."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    pairs = []
    for k in range(90):
        x = [word(r.randrange(1, 9)) for _ in range(60)] if k % 9 else [word(2), word(150), word(40)]
        y = list(x)
        for at in range(r.randrange(0, 12)) if k % 3 == 0 else [r.randrange(len(x)) for _ in range(r.randrange(1, 12))]:
            at = min(at, len(y) - 1)
            y[at] = word(len(y[at])) if len(y[at]) < 20 else "z" + y[at][2:]
        pairs.append((" ".join(x), " ".join(y if k % 2 else y[1:])))
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(t for p in pairs for t in p)], "line long, norm string")
    got = {x.a // 2 for x in line_dedup.verified(spark.createDataFrame([(2 * i + 1, 2 * i) for i in range(len(pairs))], "a long, b long"), texts, 0.9).collect()}
    proved = texts.selectExpr("norm x").limit(1).selectExpr("x", "concat(x, 'z') y").selectExpr(f"{line_dedup.worded()} d", "levenshtein(x, y) e").first()
    want = {i for i, (x, y) in enumerate(pairs) if 10 * distance(x, y) <= max(len(x), len(y))}
    assert got == want and 0 < len(want) < len(pairs) and proved.d == proved.e == 1


def test_shuffles_go_with_each_table(spark):
    """The next table of a tidy operator frees the shuffle files of those before."""
    import time

    from clausewright.llm.scratch import Scratch

    def shuffles():
        names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {x for x in names if "/shuffle_" in x}

    old, work = shuffles(), Scratch(spark, "test", tidy=True)
    work.keep(spark.range(1000).selectExpr("id % 7 k").groupBy("k").count())
    made = shuffles() - old
    time.sleep(1)  # Spark's listeners hold the last plan for a moment
    work.keep(spark.range(10))
    until = time.time() + 20
    while made & shuffles() and time.time() < until:
        time.sleep(0.1)
    assert made and not made & shuffles()
