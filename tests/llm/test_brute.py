"""The queries against plain Python on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from clausewright.llm import bins, catalog, classifier, html_text, line_dedup, mixing, near_dedup, packing, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_base_counts(spark, sf_dir, docs):
    for r in quality_rules.query(spark, sf_dir).collect():
        text = docs[r.doc_id]
        w = WORD.findall(text)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_em_finds_junk(spark):
    good = [(i, " ".join(random.Random(i).choices("the of and to in that is was house river stone green".split(), k=80))) for i in range(80)]
    junk = [(100 + i, " ".join(x + "$$$" for x in random.Random(i).choices("qua zor blim trux fend gop lirt".split(), k=80))) for i in range(12)]
    got = quality_rules.quality_rules(spark.createDataFrame(good + junk, "doc_id long, text string")).collect()
    p = {r.id: r.posterior for r in got}
    assert min(p[i] for i, _ in good) > 0.5 > max(p[i] for i, _ in junk)


def test_em_against_plain(spark, sf_dir):
    """The same model fitted on the rows one by one."""
    import math

    got = quality_rules.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    votes = [[r[f"vote_{name}"] for name in quality_rules.RULES] for r in got]
    share, a = quality_rules.START_SHARE, [quality_rules.START_ACCURACY] * len(quality_rules.RULES)

    def posterior(v):
        return 1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(x * math.log(p / (1 - p)) for x, p in zip(v, a, strict=True)))))

    for _ in range(quality_rules.ROUNDS):
        q = [posterior(v) for v in votes]
        new = []
        for j in range(len(a)):
            hit = sum(p if v[j] == 1 else 1 - p for v, p in zip(votes, q, strict=True) if v[j])
            n = sum(v[j] != 0 for v in votes)
            new.append(min(quality_rules.MOST, max(quality_rules.LEAST, (hit + quality_rules.PRIOR[0]) / (n + sum(quality_rules.PRIOR)))))
        share, a = min(0.99, max(0.01, (sum(q) + 1) / (len(votes) + 2))), new
    for r, v in zip(got, votes, strict=True):
        assert abs(r.posterior - posterior(v)) < 1e-9


def jaccard_components(texts: dict, size: int, percent: int) -> dict:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            x = len(sets[i] & sets[j])
            if x and 100 * x >= percent * (len(sets[i]) + len(sets[j]) - x):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, near_dedup.BLOCK), (5, 80, 400)])
def test_near(spark, size, percent, block):
    """Families around the threshold, in one block and in several."""
    r = random.Random(size)
    texts, n = {}, 0
    for _ in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(40, 160))]
        for _ in range(r.randrange(1, 18)):
            copy = list(base)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            texts[n] = " ".join(copy)
            n += 1
    texts |= {n: "", n + 1: "Two words", n + 2: "two WORDS"}
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=size, percent=percent, block=block).collect()
    assert {g.id: (g.n_shingles, g.component) for g in got} == jaccard_components(texts, size, percent)


def test_substring(spark, sf_dir, docs):
    seen, want = set(), {}
    for i in sorted(docs):
        w = WORD.findall(docs[i])
        cut = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                cut[k : k + 20] = [True] * 20
            seen.add(x)
        kept = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        want[i] = (len(w), sum(cut), hashlib.sha256(kept.encode()).hexdigest())
    got = substring_dedup.query(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    joined = substring_dedup.duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), broadcast_bytes=-1)
    plain = substring_dedup.duplicate_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_substring_factors(spark, sf_dir, docs):
    """Each factor repeats its reference's words, an earlier start, and no factor goes on where the one before it ends."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = substring_dedup.factors(table).collect()
    words = {i: WORD.findall(t) for i, t in docs.items()}
    assert found
    for f in found:
        assert f.hi - f.lo >= 20 and (f.ref, f.ref_lo) < (f.id, f.lo)
        assert words[f.id][f.lo : f.hi] == words[f.ref][f.ref_lo : f.ref_lo + f.hi - f.lo]
    ends = {(f.id, f.hi - 19, f.ref, f.ref_lo + f.hi - f.lo - 19) for f in found}
    assert not ends & {(f.id, f.lo, f.ref, f.ref_lo) for f in found}
    assert sorted(found) == sorted(substring_dedup.factors(table, hot=2).collect())


def test_substring_overlaps(spark):
    r = random.Random(3)
    words = ["a", "b"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 120)))) for i in range(12)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string"), window=6, gram=3).collect()
    seen, want = set(), {}
    for i, t in texts:
        w = t.split()
        cut = [False] * len(w)
        for k in range(len(w) - 5):
            x = tuple(w[k : k + 6])
            if x in seen:
                cut[k : k + 6] = [True] * 6
            seen.add(x)
        want[i] = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
    assert {x.id: x.kept for x in got} == want


def test_lines(spark):
    import regex

    r = random.Random(5)
    base = [" ".join(f"Word{r.randrange(400)}," for _ in range(r.randrange(3, 70))) for _ in range(25)]
    texts = []
    for i in range(40):
        lines = []
        for x in r.choices(base, k=5):
            w = x.split()
            if r.random() < 0.5:
                w[r.randrange(len(w))] = f"other{r.randrange(9)}"
            lines.append(" ".join(w) if r.random() < 0.5 else " ".join(w).upper())
        texts.append((i, "\n".join(lines)))
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    normal = lambda x: regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip(" ")
    distinct = list(dict.fromkeys(normal(x) for _, t in texts for x in t.split("\n")))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for n, x in enumerate(distinct):
        for y in distinct[n + 1 :]:
            most = int(0.1 * max(len(x), len(y)) + 1e-6)
            if abs(len(x) - len(y)) <= most and distance(x, y) <= most:
                links += 1
                root[find(x)] = find(y)
    assert links
    done, want = set(), {}
    for i, t in texts:
        kept = []
        for x in t.split("\n"):
            if find(normal(x)) not in done:
                kept.append(x)
            done.add(find(normal(x)))
        want[i] = "\n".join(kept)
    assert got == want


def test_poisson_rates(spark):
    rows = [(i, "big" if i < 3000 else "small") for i in range(4000)]
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, epochs=20.0).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["big"] / 20_000 - 1) < 0.03 and abs(n["small"] / 60_000 - 1) < 0.03


def test_packing(spark, sf_dir, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = {}, 0
    for i, e in zip(docs, tokenizer.encode_batch(list(docs.values()), add_special_tokens=False), strict=True):
        ids = [*e.ids, 1]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[i, p] = (at, len(part), zlib.crc32(part.tobytes()))
    got = packing.query(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    full = collections.Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert full[r.sequence_id] == r.offset
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 4096 and len(full) <= -(-total // 4096) + 1


def test_words_are_tokenised_apart():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["a\x1cb\x85c\xa0d e <|startoftext|>x<|endoftext|> İÉ é ́x it's I'LL 12345 ###!! 'S", "\x00 \x1f ΑΣ Σ ΣΑΣ, Ab.c Ab.. AB. ab, x!? <|ENDOFTEXT|>", "", "  \n\t "]
    direct = Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(path).ids(odd)] == [e.ids for e in direct]


def test_words_by_the_tokeniser_itself():
    """100,000 words of letters of many scripts, signs, marks and digits, as the tokenizer has them in a text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(11)
    letters = "abcxyzABCXYZ" * 3 + "ÀÉÎÕÜßàéîõüÿµªº" + "İıŁłŒœŐő" + "ΑΣας" + "АБвг" + "א漢字あア" + "\u0301\u0307\u200d\u00a0"
    words = ["".join(r.choice(letters + "0123456789'-" if r.random() < 0.8 else packing.SIGNS) for _ in range(r.randrange(1, 9))) for _ in range(100_000)]
    words += ["İ!", "xİ.", "éİ,", "İİ;#", "É!", "ÿ?"]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    path = public_tokenizers.path("word_bpe_49k.json")
    direct = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(path).ids(texts)]
    assert got == [e.ids for e in direct]


def test_bins():
    r = random.Random(1)

    def least(items, capacity):
        best = len(items)

        def go(k, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if k == len(items):
                best = len(rooms)
                return
            for i in {x: i for i, x in enumerate(rooms)}.values():
                if rooms[i] >= items[k]:
                    go(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1 :]])
            go(k + 1, [*rooms, capacity - items[k]])

        go(0, [])
        return best

    won = 0
    hard = [(10, [5, 4, 4, 3, 2, 2]), (10, [4, 4, 3, 3, 3, 3]), (100, [45, 35, 35, 30, 20, 20, 15])]
    hard += [(100, sorted((r.randint(15, 60) for _ in range(10)), reverse=True)) for _ in range(60)]
    for capacity, items in hard + [(c, sorted((r.randint(1, c) for _ in range(r.randint(1, 9))), reverse=True)) for c in (r.choice([10, 30, 100]) for _ in range(60))]:
        best = sum(n for _, n in bins.best_fit(dict(collections.Counter(items)), capacity))
        won += best > least(items, capacity)
        plan = bins.pack(dict(collections.Counter(items)), capacity)
        placed = collections.Counter()
        for filling, n in plan:
            assert sum(s * k for s, k in filling) <= capacity
            for s, k in filling:
                placed[s] += k * n
        assert placed == collections.Counter(items)
        assert sum(n for _, n in plan) == least(items, capacity)
    assert won  # best fit alone is not enough


def test_classifier_held_out(spark, sf_dir):
    got = {r.doc_id: r for r in classifier.query(spark, sf_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [got[i].predicted == q for i, q in truth.items() if got[i].held_out]
    assert sum(right) >= 0.9 * len(right)


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
    <div id="cookie-notice">We use cookies of the house.</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b> text,<br>next&nbsp;line.
    <p>Second &lt;p&gt; with <a href="y">a link</a> inside.</p><script>var x = "</p><p>no";</script><form><input><p>Sign up</p></form><ul><li>one<li>two</ul>
    <aside>Aside</aside><!-- <p>hidden</p> --></article></main><section id="comments"><p>I think so too, and so does all of the family of the dog.</p></section>
    <footer>&copy; 2020</footer><p>cut <a hre"""
    assert html_text.main_text(page).split("\n") == ["Title & more", "First bold text, next line.", "Second <p> with a link inside.", "one", "two"]
    plain = "<div class=menu><a href=x>Home</a></div><div><h2>Short title</h2><p>" + "The cat and the dog sat on the mat in the house of the family. " * 4 + "</p><p>Brief.</p></div><div class=ads>" + "Buy it in the shop of the town and the city. " * 9 + "</div>"
    assert html_text.main_text(plain).split("\n")[0] == "Short title" and html_text.main_text(plain).endswith("Brief.")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""


def test_html_layouts():
    """The article is found whatever its wrappers are called; comments and marked parts are not."""
    art = "<p>" + "The cat and the dog sat on the mat in the house of the family. " * 4 + "</p>"
    text = html_text.main_text(art)
    assert text
    around = "<div class=sidebar><p>Aside of the house and of the family.</p></div>"
    for page in (
        f'<div class="layout has-sidebar"><article>{art}</article></div>',
        f"<div class='content-sidebar-wrap'><main>{art}</main>{around}</div>",
        f'<article><div class="elementor-widget">{art}</div></article>',
        f'<article>{art}</article><ol class=commentlist><li><article class="comment-body">{art}</article></ol>',
    ):
        assert html_text.main_text(page) == text
    assert html_text.main_text(f'<article><header class="entry-header"><h1>Title</h1></header>{art}</article>') == "Title\n" + text


def test_html_second_pass(spark, sf_dir):
    """The labels of every page against the rules said plainly, block by block."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        found = html_text.blocks(r.html or "")
        has_main = any(m and not o for _, _, m, o in found)
        label = [html_text.first_pass(*b, has_main) for b in found]
        own = [i for i, (_, _, m, o) in enumerate(found) if label[i] and not o and (m or not has_main)]
        kept = []
        for i, (t, _, m, _) in enumerate(found):
            x = label[i]
            if not x:
                a = max((j for j in own if j < i), default=None)
                b = min((j for j in own if j > i), default=None)
                near = sorted((abs(j - i), label[j]) for j in (a, b) if j is not None)
                votes = sum(v for _, v in near)
                if m:
                    x = 1 if votes > -1 else -1
                elif not near:
                    x = 1 if len(t) >= html_text.LONG else -1
                else:
                    x = near[0][1] if len(near) == 1 or near[0][0] < near[1][0] or near[0][1] == near[1][1] else -1
            if x > 0:
                kept.append(t)
        assert html_text.main_text(r.html) == "\n".join(kept)


def test_oracles(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in catalog.oracle_sql().items():
        want = con.sql(sql)
        got = catalog.queries()[name](spark, sf_dir).select(*want.columns)
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall())), name
