"""Queries on vectors, postings, votes and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import metrics as M
from clausewright.operators import retrieval as R
from clausewright.plans.tables import table

Q: dict = {}
SQL: dict[str, str] = {}

#: The stated query set: vectors whose id divides by 25, against all vectors.
STEP = 25


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DOT = "list_sum(list_transform(list_zip(a::DOUBLE[], b::DOUBLE[]), lambda z: z[1] * z[2]))"
_HITS = f"""WITH q AS (SELECT vec_id AS q_id, embedding AS a FROM embeddings WHERE vec_id % {STEP} = 0), e AS (SELECT vec_id, embedding AS b, label FROM embeddings),
s AS (SELECT q_id, vec_id, label, round({_DOT} / (sqrt(list_sum(list_transform(a::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(b::DOUBLE[], lambda x: x * x)))), 6) AS score FROM q, e WHERE q_id <> vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id))::INT AS rank FROM s), h AS (SELECT * FROM r WHERE rank <= 10) """


def hits(spark, d, k=10):
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("q_id"), "embedding")
    top = R.dense_topk(q, e, k)
    return top.join(e.select("vec_id", "label"), "vec_id")


@query(_HITS + "SELECT q_id, vec_id, label, score, rank FROM h")
def q_cosine_topk(spark, d):
    """V03, V04, J06, W01, O02."""
    return hits(spark, d)


@query(_HITS + "SELECT q_id, arg_min(label, rank) AS top1 FROM h GROUP BY q_id")
def q_knn_top1(spark, d):
    """V16."""
    return R.knn(hits(spark, d), "q_id", "label").select("q_id", "top1")


@query(_HITS + ", n AS (SELECT q_id, label, count(*) AS n, min(rank) AS f FROM h GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, f) AS k FROM n) SELECT q_id, label AS majority FROM o WHERE k = 1")
def q_knn_majority(spark, d):
    """The first seen at a tie."""
    return R.knn(hits(spark, d), "q_id", "label").select("q_id", "majority")


@query(_HITS + ", n AS (SELECT q_id, label, round(sum(greatest(score, 0)), 6) AS s, min(rank) AS f FROM h GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, f) AS k FROM n) SELECT q_id, label AS weighted FROM o WHERE k = 1")
def q_knn_weighted(spark, d):
    """V16."""
    return R.knn(hits(spark, d), "q_id", "label").select("q_id", "weighted")


@query(_HITS + ", a AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, vec_id) AS n FROM h), b AS (SELECT *, (row_number() OVER (PARTITION BY q_id ORDER BY n > 2, score DESC, vec_id))::INT AS place FROM a) SELECT q_id, vec_id, label, score, rank, place FROM b WHERE place <= 5")
def q_diversified_topk(spark, d):
    """V05."""
    return R.diversify(hits(spark, d), "q_id", "label", "score", "vec_id").select("q_id", "vec_id", "label", "score", "rank", "place")


@query(_HITS + ", v AS (SELECT q_id, label, sum(1.0::DOUBLE / (60 + rank)) AS s FROM h GROUP BY ALL) SELECT q_id, label, round(s / sum(s) OVER (PARTITION BY q_id), 6) AS share FROM v")
def q_label_votes(spark, d):
    """V12."""
    return R.label_votes(hits(spark, d), "q_id", "label", 1.0 / (60 + F.col("rank")))


@query(_HITS + ", f AS (SELECT q_id, label, min(rank) AS first_rank FROM h GROUP BY ALL), p AS (SELECT *, (row_number() OVER (PARTITION BY q_id ORDER BY first_rank, label))::INT AS place FROM f) SELECT * FROM p WHERE place <= 3")
def q_shortlist(spark, d):
    """V13."""
    return R.shortlist(hits(spark, d), "q_id", "label", "rank", 3)


@query(_HITS + ", a AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY score DESC, vec_id) AS n FROM h) SELECT q_id, vec_id, label, score, (row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id))::INT AS place FROM a WHERE n <= 2")
def q_evidence_quota(spark, d):
    """V14."""
    return R.evidence_quota(hits(spark, d), "q_id", "label", "score", "vec_id", 2).select("q_id", "vec_id", "label", "score", "place")


@query(_HITS + ", g AS (SELECT vec_id AS q_id, label AS gold FROM embeddings WHERE vec_id % 25 = 0), f AS (SELECT q_id, min(rank) AS hit FROM h JOIN g USING (q_id) WHERE label = gold GROUP BY q_id), j AS (SELECT hit FROM g LEFT JOIN f USING (q_id)) SELECT count(*) AS n, round(avg(CASE WHEN hit = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE / hit ELSE 0.0 END), 6) AS mrr_5 FROM j")
def q_retrieval_quality(spark, d):
    """V17, A15, W02."""
    gold = table(spark, d, "embeddings").where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("q_id"), F.col("label").alias("gold"))
    return R.retrieval_quality(hits(spark, d), gold, "q_id", "label", "gold")


@query(
    f"""WITH e AS (SELECT vec_id, embedding, vec_id // 10 AS doc FROM embeddings), p AS (SELECT x.doc, x.vec_id, y.vec_id AS other, x.embedding AS a, y.embedding AS b FROM e x JOIN e y ON x.doc = y.doc AND x.vec_id <> y.vec_id),
    s AS (SELECT doc, vec_id, other, round({_DOT} / (sqrt(list_sum(list_transform(a::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(b::DOUBLE[], lambda x: x * x)))), 6) AS score FROM p), r AS (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other))::INT AS rank FROM s)
    SELECT doc, vec_id, other, score, rank FROM r WHERE rank <= 3"""
)
def q_same_group_context(spark, d):
    """Neighbours within groups of ten."""
    e = table(spark, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 10))
    return R.neighbours(e, "doc", "vec_id", "embedding", 3)


def _bm25_sql(k1: float, distinct: bool) -> str:
    qtf = "SELECT DISTINCT item_id, unnest(w) AS term, 1 AS qtf FROM q" if distinct else "SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(w) AS term FROM q) GROUP BY ALL"
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), q AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM benchmark),
    t AS ({qtf}), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d), i AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, avgdl FROM p, s GROUP BY term, n, avgdl),
    x AS (SELECT item_id, doc_id, round(sum(idf * tf * ({k1} + 1)::DOUBLE / (tf + {k1}::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(w) / avgdl)) * qtf), 6) AS score FROM t JOIN p USING (term) JOIN i USING (term) JOIN d USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM x WHERE score > 0) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5"""


def bm25_hits(spark, d, k1=1.2, distinct=False, k=5):
    s = R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", k1=k1, distinct_terms=distinct)
    return R.ranked(s, ["item_id"], "score", "doc_id", k=k)


@query(_bm25_sql(1.2, False))
def q_bm25_topk(spark, d):
    """V06, A32."""
    return bm25_hits(spark, d)


@query(_bm25_sql(1.5, True))
def q_bm25_distinct(spark, d):
    """V07."""
    return bm25_hits(spark, d, 1.5, True)


_TFIDF = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), q AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL), n AS (SELECT count(*) AS n FROM d), i AS (SELECT term, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM p, n GROUP BY term, n HAVING count(*) >= 2),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM p JOIN i USING (term)), dl AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM dw GROUP BY doc_id), qp AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM q) GROUP BY ALL),
qw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM qp JOIN i USING (term)), ql AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY item_id),
s AS (SELECT item_id, doc_id, round(sum((qw.w / ql.l) * (dw.w / dl.l)), 6) AS score FROM qw JOIN ql USING (item_id) JOIN dw USING (term) JOIN dl USING (doc_id) GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM s) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5"""


@query(_TFIDF)
def q_tfidf_topk(spark, d):
    """Queries weighted with the corpus's statistics only."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    post = R.postings(docs, "doc_id")
    stats = R.document_frequency(post).where("df >= 2").join(F.broadcast(docs.agg(F.count("*").alias("n"))))
    a = R.tfidf(items, "item_id", grams=1, statistics=stats)
    b = R.tfidf(docs, "doc_id", grams=1, statistics=stats)
    return R.ranked(R.sparse_scores(a, b, "item_id", "doc_id"), ["item_id"], "score", "doc_id", k=5)


_MERGE = "WITH a AS (" + _bm25_sql(1.2, False) + "), b AS (" + _bm25_sql(1.5, True) + ") "


@query(_MERGE + ", m AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS rank_a, b.rank AS rank_b, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id) SELECT *, least(rank_a, rank_b) AS best_rank FROM m")
def q_rrf_merge(spark, d):
    """V09, V10."""
    return R.rrf_merge(bm25_hits(spark, d), bm25_hits(spark, d, 1.5, True), ["item_id", "doc_id"])


_JOINED = "SELECT doc_id, coalesce(quality, 0) AS gold, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS pred, source, lang, toxic, least(1.0, n_chars / 4000.0)::DOUBLE AS prob FROM labels JOIN documents USING (doc_id)"


def judged(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return j.select("doc_id", F.coalesce("quality", F.lit(0)).alias("gold"), (F.col("n_chars") >= 300).cast("int").alias("pred"), "source", "lang", "toxic", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("prob"))


@query(f"SELECT gold, pred, count(*) AS n FROM ({_JOINED}) GROUP BY ALL")
def q_confusion(spark, d):
    """A10."""
    return M.confusion(judged(spark, d), "gold", "pred")


_CLASSES = f"""WITH j AS ({_JOINED}), l AS (SELECT DISTINCT gold AS label FROM j), c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM l, j GROUP BY label),
m AS (SELECT label, tp, fp, fn, tp + fn AS support, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM c) """


@query(_CLASSES + "SELECT * FROM m")
def q_per_class(spark, d):
    """A10."""
    return M.per_class(judged(spark, d), "gold", "pred")


@query(_CLASSES + "SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, count(*) AS n_labels FROM m WHERE support > 0")
def q_macro_f1(spark, d):
    """A10, A11."""
    return M.macro(M.per_class(judged(spark, d), "gold", "pred"), supported_only=True)


@query(
    f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 0) AS tn, count(*) FILTER (gold = 0 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred = 0) AS fn FROM ({_JOINED}))
    SELECT n, tp, tn, fp, fn, round((tp + fn) / n, 6) AS prevalence, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
    round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c"""
)
def q_binary_metrics(spark, d):
    """A12."""
    return M.binary(judged(spark, d), F.col("gold"), F.col("pred"))


@query(
    f"""WITH j AS ({_JOINED}), b AS (SELECT least(9, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[], lambda e: e <= prob))) AS bin, gold, prob FROM j), g AS (SELECT bin, count(*) AS n, avg(gold) AS o, avg(prob) AS p FROM b GROUP BY bin)
    SELECT (SELECT round(sum(n * abs(o - p)) / sum(n), 6) FROM g) AS ece, (SELECT sum(n)::BIGINT FROM g) AS n, (SELECT round(avg((prob - gold) * (prob - gold)), 6) FROM j) AS brier"""
)
def q_ece(spark, d):
    """A14."""
    return M.ece(judged(spark, d), F.col("gold"), F.col("prob"))


@query(f"WITH j AS ({_JOINED}), c AS (SELECT prob, sum(gold) AS pos, count(*) - sum(gold) AS neg FROM j GROUP BY prob), x AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(pos * (below + neg / 2))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 6) AS auroc, sum(pos)::BIGINT AS n_positive, sum(neg)::BIGINT AS n_negative FROM x")
def q_auc(spark, d):
    """A13."""
    return M.auroc(judged(spark, d), F.col("gold"), F.col("prob"))


@query(f"WITH j AS ({_JOINED}), c AS (SELECT prob, sum(gold) AS pos, count(*) AS n FROM j GROUP BY prob), x AS (SELECT *, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(n) OVER (ORDER BY prob DESC) AS k FROM c) SELECT round(sum(pos * tp::DOUBLE / k::DOUBLE) / sum(pos)::DOUBLE, 6) AS average_precision FROM x")
def q_average_precision(spark, d):
    """A13."""
    return M.average_precision(judged(spark, d), F.col("gold"), F.col("prob"))


@query(
    f"""WITH j AS (SELECT toxic::INT AS a, gold::INT AS b FROM ({_JOINED}) WHERE toxic IS NOT NULL), o AS (SELECT a, b, count(*) AS n FROM j GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t, sum(n) FILTER (a = b)::DOUBLE AS same, sum(n * (a - b) * (a - b))::DOUBLE AS sq, sum(n * abs(a - b))::DOUBLE AS off FROM o),
    e AS (SELECT sum(x.n * y.n) FILTER (x.a = y.b)::DOUBLE AS es, sum(x.n * y.n * (x.a - y.b) * (x.a - y.b))::DOUBLE AS eq FROM (SELECT a, sum(n)::DOUBLE AS n FROM o GROUP BY a) x, (SELECT b, sum(n)::DOUBLE AS n FROM o GROUP BY b) y)
    SELECT t::BIGINT AS n, round((same / t - es / (t * t)) / (1 - es / (t * t)), 6) AS kappa, round(1 - sq * t / eq, 6) AS quadratic_kappa, round(off / t, 6) AS mae FROM t, e"""
)
def q_kappa(spark, d):
    """A21."""
    return M.kappa(judged(spark, d), F.col("toxic"), F.col("gold"))


@query(f"SELECT source, max(gold) AS any_gold, max(pred) AS any_pred, max(toxic)::INT AS any_toxic, count(*) AS n FROM ({_JOINED}) GROUP BY source")
def q_cluster_rollup(spark, d):
    """A24."""
    return M.rollup_any(judged(spark, d), "source", ["gold", "pred", "toxic"])


@query(f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (pred = gold AND toxic <> gold) AS a, count(*) FILTER (pred <> gold AND toxic = gold) AS b, avg((pred = gold)::INT) AS pa, avg((toxic = gold)::INT) AS pb FROM ({_JOINED})) SELECT n, a AS only_a, b AS only_b, round(pow(greatest(abs(a - b) - 1, 0), 2) / (a + b), 6) AS chi_square, round(2 * asin(sqrt(pa)) - 2 * asin(sqrt(pb)), 6) AS cohens_h FROM c")
def q_mcnemar(spark, d):
    """A19."""
    return M.mcnemar(judged(spark, d), F.col("gold"), F.col("pred"), F.col("toxic"))


@query("WITH d AS (SELECT o_totalprice AS x, year(o_orderdate)::DOUBLE AS y FROM orders WHERE o_totalprice > 0), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM d) SELECT count(*) AS n, round(corr(ln(x), y), 6) AS pearson_log, round(corr(rx, ry), 6) AS spearman FROM r")
def q_corr(spark, d):
    """A20."""
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.year("o_orderdate").cast("double").alias("y"))
    return M.correlations(o, "x", "y")


@query(f"SELECT count(*) AS n, round(avg((pred = 0)::INT), 6) AS abstention_rate, round(avg((pred <> 0)::INT), 6) AS coverage, round(avg(CASE WHEN pred = 0 THEN gold END), 6) AS positive_rate_abstained FROM ({_JOINED})")
def q_abstention(spark, d):
    """A23."""
    return M.abstention(judged(spark, d), F.when(F.col("pred") == 1, 1), F.col("gold"))


@query(
    "WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(n / sum(n) OVER (), 6) AS prior, round((1.0::DOUBLE / n) / sum(1.0::DOUBLE / n) OVER () * count(*) OVER (), 6) AS weight FROM g"
)
def q_class_weights(spark, d):
    """A33."""
    return R.class_weights(table(spark, d, "embeddings"), "label")


@query("SELECT count(*) AS n_points, count(DISTINCT len(embedding)) AS n_dims, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS n_not_finite, 0::BIGINT AS n_duplicate_ids FROM embeddings")
def q_vector_audit(spark, d):
    """V32, E27."""
    return R.vector_audit(table(spark, d, "embeddings"), "vec_id", "embedding")


_GRID = _HITS + """, g AS (SELECT vec_id AS q_id, label AS gold FROM embeddings WHERE vec_id % 25 = 0), p AS (SELECT q_id, label, greatest(sum(greatest(score, 0)) / 10, 1e-4) AS p1, greatest(count(*) / 10, 1e-4) AS p2 FROM h GROUP BY ALL),
a AS (SELECT p.*, i / 20.0::DOUBLE AS alpha FROM p, range(0, 21) AS r(i)), z AS (SELECT *, round(alpha * ln(p1) + (1 - alpha) * ln(p2), 9) AS score FROM a), t AS (SELECT q_id, alpha, max({'s': score, 'l': label}).l AS label FROM z GROUP BY ALL)
SELECT alpha, count(*) AS n, count(*) FILTER (label = gold) AS n_right, round(avg((label = gold)::INT), 6) AS accuracy FROM t JOIN g USING (q_id) GROUP BY alpha"""


@query(_GRID)
def q_fusion_grid(spark, d):
    """Accuracy of the fused label along the grid."""
    h = hits(spark, d)
    gold = table(spark, d, "embeddings").where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("q_id"), F.col("label").alias("gold"))
    p = h.groupBy("q_id", "label").agg((F.sum(F.greatest("score", F.lit(0.0))) / 10).alias("p1"), (F.count("*") / 10).alias("p2"))
    s = R.alphas(p).withColumn("score", F.round(R.fuse(F.col("p1"), F.col("p2"), F.lit(1.0), F.col("alpha")), 9))
    top = s.groupBy("q_id", "alpha").agg(F.max(F.struct("score", "label")).alias("m")).select("q_id", "alpha", "m.label")
    return top.join(gold, "q_id").groupBy("alpha").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("gold")).alias("n_right"), F.round(F.avg((F.col("label") == F.col("gold")).cast("int")), 6).alias("accuracy"))


@query()
def q_bootstrap_ci(spark, d):
    """Contracts resampled 200 times.  The draws have no SQL twin; tests hold them against brute force."""
    return M.cluster_bootstrap_accuracy(judged(spark, d), "source", "gold", "pred", n=200)


@query()
def q_bootstrap_macro_f1(spark, d):
    """A17, A18."""
    return M.cluster_bootstrap_macro_f1(judged(spark, d), "source", "gold", "pred", n=200)


@query("SELECT vec_id, label FROM embeddings ORDER BY md5('3:' || vec_id::VARCHAR), vec_id LIMIT 20")
def q_seeded_sample(spark, d):
    """A sampling operator."""
    return R.sample(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 20, 3)


@query("SELECT doc_id, round(len(list_intersect(list_distinct(a), list_distinct(b))) * 2.0::DOUBLE / greatest(1, len(list_distinct(a)) + len(list_distinct(b))), 6) AS f1 FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS a, ['the', 'of', 'and', 'in'] AS b FROM documents)")
def q_token_f1(spark, d):
    """A22."""
    words = table(spark, d, "documents").select("doc_id", T.tokens("text", "plain").alias("w"))
    return words.select("doc_id", F.round(M.token_f1(F.col("w"), F.array(*[F.lit(x) for x in ("the", "of", "and", "in")])), 6).alias("f1"))


@query("WITH s AS (SELECT CASE WHEN q_id IS NULL THEN 0 ELSE 1 END AS has, * FROM (SELECT doc_id, n_chars, CASE WHEN lang = 'en' THEN doc_id END AS q_id FROM documents)) SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS place FROM s QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 20")
def q_longest_documents(spark, d):
    """A top-k report."""
    top = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return top.withColumn("place", F.expr("row_number() OVER (ORDER BY n_chars DESC, doc_id)").cast("int"))
