"""Queries on text: rules, labels, cleaning, spans, datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import dataset, rules
from clausewright.operators.metrics import checks as check_rows
from clausewright.plans.tables import FAMILIES, LABELS, PAIRS, RULES, SPAN_PATTERNS, normal_key, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches_sql() -> str:
    """One arm a rule: the first match's place and words, unless an exclusion stands near it."""
    arms = []
    for r in RULES:
        q = f"regexp_extract(t, {lit(r.pattern)}, 0)"
        at = f"(length(string_split(regexp_replace(t, {lit(r.pattern)}, chr(1)), chr(1))[1]) + 1)"
        near = f"substr(t, greatest(1, {at} - 180), {at} - greatest(1, {at} - 180) + length({q}) + 180)"
        no = "".join(f" AND NOT regexp_matches({near}, {lit(x)})" for x in r.exclude)
        arms.append(f"SELECT doc_id, source, {lit(r.id)} AS rule_id, {lit(r.domain)} AS domain, {at}::INT AS position, {q} AS quote FROM d WHERE regexp_matches(t, {lit(r.pattern)}){no}")
    return "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(arms) + ")"


def findings(spark, d):
    return rules.matches(table(spark, d, "documents").select("doc_id", "source", "text"), RULES).drop("text")


@query(_matches_sql() + " SELECT source, rule_id, domain, count(*) AS n_findings, count(DISTINCT doc_id) AS n_clauses, min(doc_id) AS first_clause FROM f GROUP BY ALL")
def q_rule_findings(spark, d):
    """Findings of the rule table rolled up per contract."""
    return findings(spark, d).groupBy("source", "rule_id", "domain").agg(F.count("*").alias("n_findings"), F.count_distinct("doc_id").alias("n_clauses"), F.min("doc_id").alias("first_clause"))


@query(_matches_sql() + " SELECT doc_id, rule_id, position, quote FROM f")
def q_rule_matches(spark, d):
    """Every finding with its place and words."""
    return findings(spark, d).select("doc_id", "rule_id", "position", "quote")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {lit(p)}) THEN {lit(k)}" for k, p in LABELS.items()) + " END AS label FROM documents")
def q_first_match_label(spark, d):
    """T19."""
    return table(spark, d, "documents").select("doc_id", T.first_label("text", LABELS).alias("label"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), {lit(p)}) THEN {lit(k)} END" for k, p in LABELS.items()) + "], lambda x: x IS NOT NULL), ',') AS labels FROM documents")
def q_all_labels(spark, d):
    """T16, T20, T22."""
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tags("text", LABELS), ",").alias("labels"))


def _pairs_sql() -> str:
    first = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {lit(p)}) THEN {lit(k)}" for k, p in LABELS.items()) + " END"
    label, reason = "", ""
    for a, b, x, y in PAIRS:
        l, r = f"regexp_matches(t, {lit(x)})", f"regexp_matches(t, {lit(y)})"
        label += f" WHEN p IN ('{a}', '{b}') AND {l} AND NOT {r} THEN '{a}' WHEN p IN ('{a}', '{b}') AND {r} AND NOT {l} THEN '{b}'"
        reason += f" WHEN p IN ('{a}', '{b}') AND {l} <> {r} THEN '{a}|{b}'"
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {first} AS p FROM documents) SELECT doc_id, p AS predicted, CASE{label} ELSE p END AS label, CASE{reason} ELSE 'unchanged' END AS reason FROM d"


@query(_pairs_sql())
def q_conflict_resolution(spark, d):
    """T21."""
    df = table(spark, d, "documents").withColumn("predicted", T.first_label("text", LABELS))
    r = T.resolve_pairs("text", F.col("predicted"), PAIRS)
    return df.select("doc_id", "predicted", r["label"].alias("label"), r["reason"].alias("reason"))


@query(
    "SELECT doc_id, "
    + ", ".join(f"len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), {lit(p)}), lambda x: lower(x))))::INT AS n_{k}, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), {lit(p)}), lambda x: lower(x)))), ',') AS {k}" for k, p in SPAN_PATTERNS.items())
    + " FROM documents"
)
def q_span_extract(spark, d):
    """T17, U05."""
    s = T.spans("text", SPAN_PATTERNS)
    df = table(spark, d, "documents").select("doc_id", s.alias("s"))
    return df.select("doc_id", *[c for k in SPAN_PATTERNS for c in (F.size(f"s.{k}").alias(f"n_{k}"), F.array_join(F.array_sort(F.transform(f"s.{k}", F.lower)), ",").alias(k))])


@query("SELECT x AS span, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '&[a-z]+;')) AS x FROM pages) GROUP BY x")
def q_span_hist(spark, d):
    """Character references of the pages."""
    e = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(T.text("html"), F.lit("&[a-z]+;"), F.lit(0))).alias("span"))
    return e.groupBy("span").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


@query(
    r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t0 FROM documents), b AS (SELECT *, replace(t0, chr(160), ' ') AS t1 FROM a),
    c AS (SELECT *, regexp_replace(t1, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g') AS t2 FROM b), e AS (SELECT *, regexp_replace(regexp_replace(t2, '[\x{2018}\x{2019}\x{201A}\x{201B}]', chr(39), 'g'), '[\x{201C}\x{201D}\x{201E}\x{201F}]', chr(34), 'g') AS t3 FROM c),
    f AS (SELECT *, trim(regexp_replace(t3, '\s+', ' ', 'g')) AS t4 FROM e)
    SELECT doc_id, md5(t4) AS clean_md5, length(t4)::INT AS n, array_to_string(list_sort(list_filter([CASE WHEN t0 <> t1 THEN 'nbsp_replaced' END, CASE WHEN t1 <> t2 THEN 'invisible_removed' END, CASE WHEN t2 <> t3 THEN 'quotes_straightened' END, CASE WHEN t3 <> t4 THEN 'whitespace_collapsed' END], lambda x: x IS NOT NULL)), ';') AS actions FROM f"""
)
def q_text_clean_actions(spark, d):
    """T01, T02."""
    df = table(spark, d, "documents").select("doc_id", T.conservative_clean("text", unicode=False).alias("c"))
    return df.select("doc_id", F.md5("c.text").alias("clean_md5"), F.length("c.text").alias("n"), F.array_join("c.actions", ";").alias("actions"))


@query(r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?]){2,}', '\1', 'g'), '\s+', ' ', 'g')))::INT AS n, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?]){2,}', '\1', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def q_preprocess(spark, d):
    """T04, T05."""
    p = T.preprocess("text", quotes=False, abbreviations=False, unicode=False)
    return table(spark, d, "documents").select("doc_id", F.length(p).alias("n"), F.md5(p).alias("h"))


_KEY = r"substr(sha1(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), ' '))), 1, 16)"


@query(
    f"""WITH k AS (SELECT doc_id, source, lang, {_KEY} AS text_key FROM documents), g AS (SELECT text_key, count(DISTINCT lang) AS n, string_agg(DISTINCT lang, '|' ORDER BY lang) AS l, count(*) AS copies FROM k GROUP BY text_key)
    SELECT doc_id, k.text_key, n::BIGINT AS same_text_label_count, l AS same_text_labels, n > 1 AS cross_category_span_reuse FROM k JOIN g USING (text_key)"""
)
def q_overlap_flags(spark, d):
    """Labels that the same text has anywhere."""
    df = table(spark, d, "documents").select("doc_id", "lang", normal_key().alias("text_key")).withColumn("all", F.lit(1))
    return dataset.overlap_flags(df, "all", "text_key", "lang").drop("all", "lang")


@query(f"WITH c AS (SELECT {_KEY} AS k, lang, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT k, max(n) AS top, sum(n) AS al FROM c GROUP BY k) SELECT sum(top)::BIGINT AS n_best, sum(al)::BIGINT AS n_rows, round(sum(top) / sum(al), 6) AS ceiling FROM g")
def q_label_ceiling(spark, d):
    """A03."""
    return dataset.label_ceiling(table(spark, d, "documents").select("lang", normal_key().alias("k")), "k", "lang")


@query(
    """WITH l AS (SELECT lang, coalesce(length(text), 0) AS v FROM documents), r AS (SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY v) AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
    p AS (SELECT *, greatest(1.0::DOUBLE, least(n::DOUBLE, 0.95::DOUBLE * (n + 1))) AS pr FROM r)
    SELECT lang, n, min(v)::BIGINT AS least, median(v)::DOUBLE AS median, max(v)::BIGINT AS most,
    round(max(CASE WHEN i = floor(pr) THEN v END) + (max(CASE WHEN i = least(n, floor(pr) + 1) THEN v END) - max(CASE WHEN i = floor(pr) THEN v END)) * (max(pr) - floor(max(pr))), 6) AS p95 FROM p GROUP BY lang, n"""
)
def q_length_profile(spark, d):
    """A04, A05."""
    return dataset.length_profile(table(spark, d, "documents"), F.length(T.text("text")), ["lang"])


@query("SELECT l_orderkey, l_linenumber, lower(name) AS clause_type, round(value, 2) AS amount FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, price, discount, tax INTO NAME name VALUE value) WHERE value > 0.05")
def q_wide_to_long(spark, d):
    """P03 on numbers: one exploded array, not four scans."""
    pairs = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("clause_type"), F.round(c, 2).alias("amount"), F.col(c).alias("v")) for k, c in pairs.items()])).alias("p")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", one).where("p.v > 0.05").select("l_orderkey", "l_linenumber", "p.clause_type", "p.amount")


@query(f"WITH k AS (SELECT {_KEY} AS text_key, CASE WHEN ('0x' || substr(md5('0:' || source), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT text_key, count(DISTINCT split) AS n_splits, count(*) AS n FROM k GROUP BY text_key HAVING count(DISTINCT split) > 1")
def q_split_leakage(spark, d):
    """Texts on both sides of a split by contract."""
    s = dataset.split_documents(table(spark, d, "documents"), "source", share=0.3).withColumn("text_key", normal_key())
    return dataset.leaking(s, "text_key", "split")


@query(f"WITH k AS (SELECT *, {_KEY} AS text_key, CASE WHEN ('0x' || substr(md5('0:' || source), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT doc_id, text_key FROM k WHERE split = 'test' AND text_key IN (SELECT text_key FROM k WHERE split = 'train')")
def q_train_test_overlap(spark, d):
    """J13, A07, U02."""
    s = dataset.split_documents(table(spark, d, "documents"), "source", share=0.3).withColumn("text_key", normal_key())
    return dataset.shared_keys(s.where("split = 'test'"), s.where("split = 'train'"), "text_key").select("doc_id", "text_key")


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(
    f"""WITH p AS (SELECT item_id AS probe, {_WORDS} AS w FROM benchmark), q AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    a AS (SELECT DISTINCT probe, array_to_string(w[i:i + 4], ' ') AS g FROM p, unnest(range(1, greatest(len(w) - 3, 1))) AS t(i) WHERE len(w) >= 5), b AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM q, unnest(range(1, greatest(len(w) - 3, 1))) AS t(i) WHERE len(w) >= 5),
    na AS (SELECT probe, count(*) AS n FROM a GROUP BY probe), nb AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id), s AS (SELECT probe, doc_id, count(*) AS c FROM a JOIN b USING (g) GROUP BY ALL),
    j AS (SELECT s.probe, s.doc_id, round(c / (na.n + nb.n - c), 6) AS jaccard FROM s JOIN na USING (probe) JOIN nb USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY jaccard DESC, doc_id) AS k FROM j)
    SELECT probe, doc_id, jaccard, jaccard >= 0.9 AS near_duplicate FROM r WHERE k = 1"""
)
def q_shingle_jaccard(spark, d):
    """Each benchmark item's most similar document, met through shared five-word shingles.

    Probes are a fixed set; only documents' shingles that a probe has leave their task.
    """
    # outer explodes: a plain one gets a filter on its array's size, pushed below the words, which then are cut anew for each shingle
    grams = lambda df, key: df.select(key, T.tokens("text").alias("w")).select(key, T.shingles(F.col("w"), 5).alias("gs")).select(key, F.explode_outer("gs").alias("g")).where("g IS NOT NULL")
    docs = table(spark, d, "documents").withColumn("words", T.tokens("text"))
    # sizes are taken before the explode, so that no exploded row drags its whole array along
    b = docs.select("doc_id", T.shingles(F.col("words"), 5).alias("gs")).select("doc_id", F.size("gs").alias("nb"), "gs").select("doc_id", "nb", F.explode_outer("gs").alias("g")).where("g IS NOT NULL")
    a = grams(table(spark, d, "benchmark").select(F.col("item_id").alias("probe"), "text"), "probe")
    na = a.groupBy("probe").agg(F.count("*").alias("na"))
    s = b.join(a, "g").groupBy("probe", "doc_id", "nb").agg(F.count("*").alias("c")).join(na, "probe")
    s = s.withColumn("jaccard", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6))
    best = s.groupBy("probe").agg(F.max(F.struct(F.col("jaccard"), (-F.col("doc_id")).alias("d"))).alias("m"))
    return best.select("probe", (-F.col("m.d")).alias("doc_id"), "m.jaccard", (F.col("m.jaccard") >= 0.9).alias("near_duplicate"))


_LOW = "concat_ws(chr(10), lower(coalesce(lang, '')), lower(coalesce(text, '')))"
_FLAG = {k: "(" + " OR ".join(f"contains({_LOW}, {lit(w)})" for w in ws) + ")" for k, ws in FAMILIES.items()}


@query(
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT source, doc_id, '{k}' AS signal FROM documents WHERE {c}" for k, c in _FLAG.items())
    + "), g AS (SELECT source, signal, count(*) AS n, list_sort(list(DISTINCT doc_id)) AS l FROM f GROUP BY ALL HAVING count(*) >= 2) SELECT source, signal, n, array_to_string(l[1:20], ',') AS clauses FROM g"
)
def q_family_signals(spark, d):
    """J04, E02, O05."""
    f = rules.family_flags(table(spark, d, "documents"), FAMILIES, "lang", "text")
    return rules.signals(f, list(FAMILIES), "source", "doc_id").withColumn("clauses", F.array_join("clauses", ","))


@query(
    f"""WITH f AS (SELECT source, {_FLAG["ip"]} AS ip, {_FLAG["exit"]} AS ex, {_FLAG["scope"]} AS sc, {_FLAG["remedy"]} AS re FROM documents), n AS (SELECT source, count(*) FILTER (ip) AS ip, count(*) FILTER (ex) AS ex, count(*) FILTER (sc) AS sc, count(*) FILTER (re) AS re FROM f GROUP BY source)
    SELECT source, 'evidence_gap' AS signal FROM n WHERE ex > 0 AND sc < ex UNION ALL SELECT source, 'precedence_gap' FROM n WHERE re >= 2 AND ip = 0"""
)
def q_gap_signals(spark, d):
    """Fewer markers than hits; references without a hierarchy."""
    f = rules.family_flags(table(spark, d, "documents"), FAMILIES, "lang", "text")
    return rules.gap_signals(f, "source", "is_exit", "is_scope", "is_remedy", "is_ip")


@query(
    "WITH l AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), {lit(p)}) THEN {lit(k)}" for k, p in LABELS.items()) + " END AS family FROM documents), s AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS family, count(*) FILTER (regexp_matches(coalesce(text, ''), {lit(p)})) AS n_searched FROM documents" for k, p in LABELS.items())
    + ") SELECT s.family, count(l.family) AS n_classified, s.n_searched, CASE WHEN count(l.family) > 0 THEN 'classifier' WHEN s.n_searched > 0 THEN 'search' ELSE 'not_found' END AS coverage FROM s LEFT JOIN l ON l.family = s.family GROUP BY s.family, s.n_searched"
)
def q_coverage(spark, d):
    """Families found by first-match label, by search only, or not."""
    df = table(spark, d, "documents")
    both = df.select(T.first_label("text", LABELS).alias("label"), F.explode(T.tags("text", LABELS)).alias("family")).select("family", (F.col("family") == F.col("label")).alias("own"), F.lit(True).alias("seen"))
    fam = spark.createDataFrame([(k,) for k in LABELS], "family string")
    return rules.coverage(fam, both, "family", "own", "seen")


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\\blicen[cs]e') THEN 'licence' WHEN contains(t, '|') THEN 'table' WHEN contains(t, '!!') THEN 'shout' ELSE 'prose' END AS category FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)".replace("\\\\", "\\"))
def q_category_ladder(spark, d):
    """T25, E31."""
    t = F.lower(T.text("text"))
    return table(spark, d, "documents").select("doc_id", F.when(t.rlike(r"(?i)\blicen[cs]e"), "licence").when(t.contains("|"), "table").when(t.contains("!!"), "shout").otherwise("prose").alias("category"))


@query(r"SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^\s*[0-9]{1,4}\s*$')))::INT AS n_kept, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^\s*[0-9]{1,4}\s*$')))::INT AS n_removed FROM documents")
def q_strip_boilerplate(spark, d):
    """T06, T09."""
    s = T.strip_boilerplate("text", r"^\s*[0-9]{1,4}\s*$", unicode=False)
    return table(spark, d, "documents").select("doc_id", F.size(F.split(s["text"], "\n")).alias("n"), s["removed"].alias("n_removed"), T.text("text").alias("t")).select("doc_id", (F.size(F.split("t", "\n")) - F.col("n_removed")).alias("n_kept"), "n_removed")


@query(f"SELECT doc_id, len({_WORDS})::INT AS n_alnum, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))::INT AS n_word, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}'))::INT AS n_long, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))::INT AS n_plain FROM documents")
def q_tokenizers(spark, d):
    """T35."""
    return table(spark, d, "documents").select("doc_id", *[F.size(T.tokens("text", k)).alias(f"n_{k}") for k in ("alnum", "word", "long", "plain")])


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '(^|\\.)example\\.(org|net)$') AS allowed FROM pages".replace("\\\\", "\\"))
def q_host_allowlist(spark, d):
    """E19."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    return table(spark, d, "pages").select("page_id", host.alias("host"), host.rlike(r"(^|\.)example\.(org|net)$").alias("allowed"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.page')) AS n_pages, count(*) FILTER (json_valid(props)) AS n_valid FROM events GROUP BY event_type")
def q_json_props(spark, d):
    """M05."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.page").alias("p"), F.try_parse_json("props").isNotNull().alias("ok"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("p").alias("n_pages"), F.count_if("ok").alias("n_valid"))


@query("WITH s AS (SELECT doc_id, i, substr(t, i, 1200) AS chunk, length(t) AS n FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), unnest(range(1, greatest(length(t), 1) + 1, 1050)) AS r(i)) SELECT doc_id, ((i - 1) // 1050)::INT AS chunk_index, length(chunk)::INT AS n_chars, md5(chunk) AS h FROM s WHERE i = 1 OR i - 1 + 150 < n")
def q_chunks(spark, d):
    """1200 characters with 150 shared; a start whose chunk would only repeat the end is left out."""
    from clausewright.operators.segment import chunks

    c = chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("h"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS z, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS k FROM l WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
    e AS (SELECT regexp_replace(k, '[0-9]+', '#', 'g') AS edge_key, doc_id FROM n WHERE (a <= 2 OR z <= 2) AND length(line) <= 180)
    SELECT edge_key, count(DISTINCT doc_id) AS n_documents FROM e GROUP BY edge_key HAVING count(DISTINCT doc_id) >= 2"""
)
def q_edge_lines(spark, d):
    """Header and footer lines that several documents share."""
    from clausewright.operators.segment import edge_keys

    return edge_keys(table(spark, d, "documents"), "doc_id", "text", unicode=False)


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^.!?]', '', 'g'))::BIGINT AS n_marks, contains(coalesce(text, ''), 'the') AS has_the, coalesce(text, '') = '' AS is_blank, n_chars = length(coalesce(text, '')) AS same_length FROM documents")
def q_text_tests(spark, d):
    """Small predicates over texts."""
    t = T.text("text")
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(t, "[^.!?]", "")).cast("long").alias("n_marks"), t.contains("the").alias("has_the"), (t == "").alias("is_blank"), (F.col("n_chars") == F.length(t)).alias("same_length"))


@query("WITH t AS (SELECT count(*) FILTER (NOT coalesce(text <> '', false)) AS a, count(*) FILTER (NOT coalesce(n_chars >= 50, false)) AS b, count(*) FILTER (NOT coalesce(lang IN ('en', 'fr', 'de', 'es'), false)) AS c FROM documents) SELECT 'has_text' AS \"check\", a AS n_failed, a = 0 AS passed FROM t UNION ALL SELECT 'long_enough', b, b = 0 FROM t UNION ALL SELECT 'known_language', c, c = 0 FROM t")
def q_release_checks(spark, d):
    """Named checks over one scan."""
    return check_rows(table(spark, d, "documents"), {"has_text": F.col("text") != "", "long_enough": F.col("n_chars") >= 50, "known_language": F.col("lang").isin("en", "fr", "de", "es")})


@query("SELECT doc_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'source': source})) AS fingerprint FROM documents")
def q_row_fingerprint(spark, d):
    """T42, M06."""
    return table(spark, d, "documents").select("doc_id", T.fingerprint("source", "doc_id", "lang").alias("fingerprint"))


@query("WITH x AS (SELECT action, count(*) AS n FROM (SELECT unnest(string_split(event_type || ';' || (CASE WHEN value > 50 THEN 'large' ELSE 'small' END), ';')) AS action FROM events) GROUP BY action) SELECT * FROM x")
def q_action_histogram(spark, d):
    """A08."""
    e = table(spark, d, "events").select(F.concat_ws(";", "event_type", F.when(F.col("value") > 50, "large").otherwise("small")).alias("a"))
    return dataset.action_histogram(e, "a")


@query("SELECT source, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY source HAVING count(*) < 10")
def q_low_support(spark, d):
    """A09."""
    return dataset.low_support(table(spark, d, "documents").where("lang = 'es'"), "source")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), ' (?:the|und|les|los) '))), ',') AS found FROM documents")
def q_keywords(spark, d):
    """T18, T41."""
    t = F.lower(T.text("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(" (?:the|und|les|los) "), F.lit(0)))), ",").alias("found"))
