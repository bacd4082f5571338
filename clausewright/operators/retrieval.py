"""Vectors, postings, ranking and votes.

Postings are rows ``(doc, term, tf)``: term statistics are partial aggregates and a
query meets only documents that share a term.  Dense search sends the query set
(stated, and checked for its size) to the vectors, keeps the k best of each task's
part before the exchange (``WindowGroupLimit``), and never shuffles the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions.text import tokens

#: Query vectors up to which they are broadcast as one table; beyond, blocks of queries are searched one after another.
QUERY_BLOCK = 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unlike length or without length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def metric(name: str):
    """Similarity by name; larger is nearer."""
    return {"cosine": cosine, "dot": dot, "euclid": lambda a, b: -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))}[name]


def ranked(df: DataFrame, by: list[str], score: str, tie: str, rank: str = "rank", k: int | None = None) -> DataFrame:
    """Rank by score, highest first, ties by the smaller id; the k best if given."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    df = df.withColumn(rank, F.row_number().over(w).cast("int"))
    return df.where(F.col(rank) <= k) if k else df


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, vector: str = "embedding", qid: str = "q_id", did: str = "vec_id", similarity: str = "cosine", digits: int = 6) -> DataFrame:
    """``q_id, vec_id, score, rank`` of each query's k nearest, itself left out if ids agree.

    The corpus comes already filtered by payload.  Queries are broadcast ``QUERY_BLOCK`` at a time, so that any
    number of them is searched; norms are taken once a row, not once a pair.
    """
    q, c = queries.select(qid, F.col(vector).alias("_q")), corpus.select(did, F.col(vector).alias("_c"))
    score = metric(similarity)(F.col("_q"), F.col("_c"))
    if similarity == "cosine":
        q, c = q.withColumn("_nq", norm(F.col("_q"))), c.withColumn("_nc", norm(F.col("_c")))
        n = F.col("_nq") * F.col("_nc")
        score = F.when((F.size("_q") == F.size("_c")) & (n > 0), dot(F.col("_q"), F.col("_c")) / n).otherwise(0.0)

    def search(block: DataFrame) -> DataFrame:
        scored = c.join(F.broadcast(block), F.col(qid) != F.col(did)).select(qid, did, F.round(score, digits).alias("score"))
        return ranked(scored, [qid], "score", did, k=k)

    blocks = -(-q.count() // QUERY_BLOCK)
    if blocks <= 1:
        return search(q)
    at = F.pmod(F.xxhash64(qid), F.lit(blocks))
    return reduce(DataFrame.unionByName, [search(q.where(at == b)) for b in range(blocks)])


def postings(docs: DataFrame, did: str, text_col: str = "text", kind: str = "alnum", grams: int = 1) -> DataFrame:
    """``did, term, tf``: counts of words and, with ``grams=2``, of word pairs."""
    words = tokens(text_col, kind)
    t = docs.select(did, words.alias("w"))
    if grams == 2:
        pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        t = t.select(did, F.concat("w", pairs).alias("w"))
    return t.select(did, F.explode("w").alias("term")).groupBy(did, "term").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    """``term, df``."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def lengths(docs: DataFrame, did: str, text_col: str = "text", kind: str = "alnum") -> DataFrame:
    """``did, dl`` for every document, empty ones too."""
    return docs.select(did, F.size(tokens(text_col, kind)).cast("long").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, did: str, qid: str, k1: float = 1.2, b: float = 0.75, distinct_terms: bool = False, kind: str = "alnum", text_col: str = "text", digits: int = 6) -> DataFrame:
    """``qid, did, score`` above 0.

    Query terms count as often as they occur, or once with ``distinct_terms``.  Only query terms'
    postings meet the statistics, so the join's rows grow with matches, not with the vocabulary.
    """
    q = queries.select(qid, F.explode(tokens(text_col, kind)).alias("term"))
    q = q.distinct().withColumn("qtf", F.lit(1).cast("long")) if distinct_terms else q.groupBy(qid, "term").agg(F.count("*").alias("qtf"))
    dl = lengths(docs, did, text_col, kind)
    stats = dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    post = postings(docs, did, text_col, kind).join(q.select("term").distinct(), "term", "left_semi")
    idf = document_frequency(post).join(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select("term", "idf", "avgdl")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hits = post.join(idf, "term").join(dl, did).withColumn("w", weight).select(did, "term", "w")
    return hits.join(q, "term").groupBy(qid, did).agg(F.round(F.sum(F.col("w") * F.col("qtf")), digits).alias("score")).where("score > 0")


def tfidf(docs: DataFrame, did: str, min_df: int = 2, grams: int = 2, kind: str = "alnum", text_col: str = "text", statistics: DataFrame | None = None) -> DataFrame:
    """``did, term, w``: sublinear tf, smooth idf, unit length.  ``statistics`` (term, df, n) comes from training text if given."""
    post = postings(docs, did, text_col, kind, grams)
    if statistics is None:
        n = docs.agg(F.count("*").alias("n"))
        statistics = document_frequency(post).where(F.col("df") >= min_df).join(F.broadcast(n))
    w = post.join(statistics, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).select(did, "term", "w")
    length = w.groupBy(did).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return w.join(length, did).select(did, "term", (F.col("w") / F.col("len")).alias("w"))


def sparse_scores(a: DataFrame, b: DataFrame, aid: str, bid: str, digits: int = 6) -> DataFrame:
    """``aid, bid, score``: dot products over shared terms."""
    return a.select(aid, "term", F.col("w").alias("_a")).join(b.select(bid, "term", F.col("w").alias("_b")), "term").groupBy(aid, bid).agg(F.round(F.sum(F.col("_a") * F.col("_b")), digits).alias("score"))


def hashing_vector(c: Column | str, dims: int = 768, kind: str = "alnum") -> Column:
    """``map<int, double>``: words and word pairs hashed to ``dims`` places, counts at unit length.

    Places come from xxhash64, so they differ from other implementations' by design.
    """
    w = tokens(c, kind)
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    places = F.array_sort(F.transform(F.concat(w, pairs), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")))
    counts = F.transform(F.array_distinct(places), lambda p: F.struct(p.alias("k"), F.size(F.filter(places, lambda x: x == p)).cast("double").alias("v")))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x["v"] * x["v"]))
    return F.map_from_entries(F.transform(counts, lambda x: F.struct(x["k"], x["v"] / length)))


def rrf_full(scores: DataFrame, by: list[str], left: str, right: str, tie: str, k: int = 60) -> DataFrame:
    """Every row ranked by both scores of its group (``by``), from 0; ``rrf`` is the sum of 1 / (k + rank).

    Ties go to the smaller ``tie``.  Groups are one query's scores of the corpus: keep them to the rows that have a score.
    """
    place = lambda score: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))) - 1
    ranks = scores.withColumn("rank_left", place(left)).withColumn("rank_right", place(right))
    return ranks.withColumn("rrf", 1.0 / (k + F.col("rank_left")) + 1.0 / (k + F.col("rank_right")))


def rrf_merge(a: DataFrame, b: DataFrame, by: list[str], k: int = 60, digits: int = 9) -> DataFrame:
    """Two truncated lists (by, rank from 1): full outer, ``rrf`` and ``best_rank``."""
    j = a.select(*by, F.col("rank").alias("rank_a")).join(b.select(*by, F.col("rank").alias("rank_b")), by, "full_outer")
    score = F.coalesce(1.0 / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("rank_b")), F.lit(0.0))
    return j.withColumn("rrf", F.round(score, digits)).withColumn("best_rank", F.least("rank_a", "rank_b"))


def without_documents(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Documents left out before any statistics are taken (the leakage-safe form when done first)."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def diversify(hits: DataFrame, q: str, label: str, score: str, tie: str, per_label: int = 2, limit: int = 5) -> DataFrame:
    """At most ``per_label`` hits a label, best first; places left over go to the rest by score."""
    inner = Window.partitionBy(q, label).orderBy(F.desc(score), F.asc(tie))
    outer = Window.partitionBy(q).orderBy(F.col("_n") > per_label, F.desc(score), F.asc(tie))
    d = hits.withColumn("_n", F.row_number().over(inner)).withColumn("place", F.row_number().over(outer).cast("int"))
    return d.where(F.col("place") <= limit).drop("_n")


def label_votes(hits: DataFrame, q: str, label: str, weight: Column, digits: int = 6) -> DataFrame:
    """Each label's share of the weights."""
    s = hits.groupBy(q, label).agg(F.sum(weight).alias("_s"))
    return s.withColumn("share", F.round(F.col("_s") / F.sum("_s").over(Window.partitionBy(q)), digits)).drop("_s")


def shortlist(hits: DataFrame, q: str, label: str, rank: str, limit: int) -> DataFrame:
    """Labels in the order in which they first occur."""
    first = hits.groupBy(q, label).agg(F.min(rank).alias("first_rank"))
    w = Window.partitionBy(q).orderBy("first_rank", label)
    return first.withColumn("place", F.row_number().over(w).cast("int")).where(F.col("place") <= limit)


def evidence_quota(hits: DataFrame, q: str, label: str, score: str, tie: str, quota: int) -> DataFrame:
    """``quota`` hits a label, given back with similarity rising."""
    w = Window.partitionBy(q, label).orderBy(F.desc(score), F.asc(tie))
    kept = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(q).orderBy(F.asc(score), F.asc(tie))).cast("int"))


def neighbours(rows: DataFrame, doc: str, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """Each row's k nearest of the same document, itself left out."""
    other = rows.select(doc, F.col(key).alias("other"), F.col(vector).alias("_v"))
    s = rows.join(other, doc).where(F.col(key) != F.col("other")).select(doc, key, "other", F.round(cosine(F.col(vector), F.col("_v")), digits).alias("score"))
    return ranked(s, [key], "score", "other", k=k)


def knn(hits: DataFrame, q: str, label: str, score: str = "score", rank: str = "rank") -> DataFrame:
    """``q, top1, majority, weighted``: nearest's label; most frequent, first seen at a tie; largest sum of non-negative scores."""
    by = hits.groupBy(q, label).agg(F.count("*").alias("n"), F.min(rank).alias("first"), F.round(F.sum(F.greatest(F.col(score), F.lit(0.0))), 6).alias("s"))
    order = -F.col("first")
    return by.groupBy(q).agg(F.min_by(label, "first").alias("top1"), F.max_by(label, F.struct(F.col("n"), order)).alias("majority"), F.max_by(label, F.struct(F.col("s"), order)).alias("weighted"))


def retrieval_quality(hits: DataFrame, gold: DataFrame, q: str, label: str, gold_label: str, k: int = 5, digits: int = 6) -> DataFrame:
    """One row: queries, accuracy of the first hit, recall at k, mean reciprocal rank within k."""
    first = hits.join(gold.select(q, gold_label), q).where(F.col(label) == F.col(gold_label)).groupBy(q).agg(F.min("rank").alias("hit"))
    j = gold.select(q).join(first, q, "left")
    avg = lambda c: F.round(F.avg(c), digits)
    return j.agg(F.count("*").alias("n"), avg(F.when(F.col("hit") == 1, 1.0).otherwise(0.0)).alias("recall_1"), avg(F.when(F.col("hit") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}"), avg(F.when(F.col("hit") <= k, 1.0 / F.col("hit")).otherwise(0.0)).alias(f"mrr_{k}"))


def fuse(p1: Column, p2: Column, prior: Column, alpha: Column, beta: float = 0.0, floor: float = 1e-4) -> Column:
    """Log-linear score."""
    safe = lambda c: F.log(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)))
    return alpha * safe(p1) + (1 - alpha) * safe(p2) - beta * safe(prior)


def alphas(df: DataFrame, step: float = 0.05) -> DataFrame:
    """Each row for each alpha of the grid; alpha is k / steps, so that grids agree to the last bit."""
    n = round(1 / step)
    return df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("alpha", F.col("_k") / F.lit(float(n))).drop("_k")


def letter_probabilities(df: DataFrame, key: str, letter: str, logprob: str) -> DataFrame:
    """Of each letter the largest log probability, as shares that sum to 1."""
    best = df.groupBy(key, letter).agg(F.exp(F.max(logprob)).alias("p"))
    return best.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(key)))


def permutation_average(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """A label's mean score over the orders in which a model saw it."""
    return df.groupBy(key, label).agg(F.avg(score).alias("score"), F.count("*").alias("n_orders"))


def rerank(hits: DataFrame, q: str, scorer, tie: str, k: int) -> DataFrame:
    """Hits by another scorer (a Column function of the row)."""
    return ranked(hits.withColumn("rerank_score", scorer), [q], "rerank_score", tie, "rerank", k)


def select_clauses(clauses: DataFrame, direct: list[str], expanded: list[str], did: str, kind: str = "long", text_col: str = "text", limit: int = 12, explicit: list | None = None, boost: dict | None = None) -> DataFrame:
    """``did, score``: idf-weighted direct terms (x 5) and expanded ones (x 0.25), 1000 for a clause named outright, boosts by id.

    Counts and lookups both fold case, so a capital never makes a word rare.
    """
    spark = clauses.sparkSession
    terms = spark.createDataFrame([(t, 5.0) for t in direct] + [(t, 0.25) for t in expanded if t not in direct], "term string, weight double")
    post = postings(clauses, did, text_col, kind).join(F.broadcast(terms), "term")
    n = clauses.agg(F.count("*").alias("n"))
    idf = document_frequency(post).join(F.broadcast(n)).withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 0.5))).select("term", "idf")
    s = post.join(idf, "term").groupBy(did).agg(F.sum(F.col("idf") * F.col("weight")).alias("score"))
    s = clauses.select(did).join(s, did, "left").na.fill(0.0, ["score"])
    if explicit:
        s = s.withColumn("score", F.col("score") + F.when(F.col(did).isin(*explicit), 1000.0).otherwise(0.0))
    for key, more in (boost or {}).items():
        s = s.withColumn("score", F.col("score") + F.when(F.col(did) == F.lit(key), F.lit(float(more))).otherwise(0.0))
    return s.where("score > 0").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), did).limit(limit)


def topic_evidence(clauses: DataFrame, terms: list[str], did: str, text_col: str = "text", k: int = 5, group: str | None = None) -> DataFrame:
    """Clauses by the lengths of the terms that occur (35 at most each) plus 10 a term; the k best, per group if given."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    hit = [F.when(low.contains(t.lower()), F.lit(min(len(t), 35) + 10)).otherwise(0) for t in terms]
    d = clauses.withColumn("topic_score", sum(hit[1:], hit[0])).where("topic_score > 0")
    return ranked(d, [group] if group else [], "topic_score", did, k=k) if group else d.orderBy(F.desc("topic_score"), did).limit(k)


def pair_candidates(clauses: DataFrame, labels: list[str], stems: list[str], doc: str, clause: str, label: str, text_col: str, cap: int = 20) -> DataFrame:
    """Per document the clauses of the labels; where there are none, those whose text holds a stem; the first ``cap``."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    by_label = F.lower(F.col(label)).isin([x.lower() for x in labels])
    by_text = F.lit(False)
    for s in stems:
        by_text = by_text | low.contains(s.lower())
    d = clauses.withColumn("_p", F.when(by_label, 1).when(by_text, 2)).where("_p IS NOT NULL")
    w = Window.partitionBy(doc)
    d = d.withColumn("_best", F.min("_p").over(w)).where("_p = _best")
    return d.withColumn("_n", F.row_number().over(w.orderBy(clause))).where(F.col("_n") <= cap).drop("_p", "_best", "_n")


def first_of_key(df: DataFrame, q: str, key: list[str], score: str, tie: str, cap: int) -> DataFrame:
    """The best row of each key, at most ``cap`` a query."""
    w = Window.partitionBy(q, *key).orderBy(F.desc(score), F.asc(tie))
    d = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return ranked(d, [q], score, tie, "place", cap)


def fuse_confidence(model: Column, vote: Column, agree: Column, boost: float = 0.05) -> Column:
    """The mean of both, more if they agree, kept within 0 and 1; halves round to even."""
    both = (F.coalesce(model, F.lit(0.0)) + F.coalesce(vote, F.lit(0.0))) / 2
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both + F.when(agree, boost).otherwise(0.0))), 4)


def decide(rule: Column, model: Column, model_ok: Column, vote: Column, vote_share: Column, least: float = 0.5) -> Column:
    """struct(label, source, status): a precise rule, then an admissible model answer, then a clear vote, else none."""
    label = F.coalesce(rule, F.when(model_ok, model), F.when(vote_share >= least, vote))
    source = F.when(rule.isNotNull(), "rule").when(model_ok & model.isNotNull(), "model").when((vote_share >= least) & vote.isNotNull(), "vote").otherwise("none")
    return F.struct(label.alias("label"), source.alias("source"), F.when(label.isNotNull(), "CLASSIFIED").otherwise("UNCLASSIFIED").alias("status"))


def lexical_label(df: DataFrame, key: str, text_col: str, labels: list[str], ratio=None) -> DataFrame:
    """The label with the most words shared (x 2), plus a similarity if given; the larger label at a tie."""
    words = F.array_distinct(tokens(text_col))
    rows = df.select(key, text_col, words.alias("_w"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    score = 2.0 * F.size(F.array_intersect("_w", F.array_distinct(tokens("label"))))
    score = score + ratio(F.col(text_col), F.col("label")) if ratio is not None else score
    return rows.withColumn("score", score).groupBy(key).agg(F.max(F.struct("score", "label")).alias("m")).select(key, "m.label", "m.score")


def vector_audit(df: DataFrame, did: str, vector: str) -> DataFrame:
    """One row: points, dimensions seen, vectors with a value that isn't finite, ids given twice."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    twice = df.groupBy(did).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_duplicate_ids"))
    return df.agg(F.count("*").alias("n_points"), F.count_distinct(F.size(vector)).alias("n_dims"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"), F.count_if(~finite).alias("n_not_finite")).join(twice)


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows by hashed order: the same ones wherever and whenever they are drawn."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def class_weights(df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """``label, n, prior, weight``: shares, and inverse frequencies with mean 1."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return n.withColumn("prior", F.round(F.col("n") / F.sum("n").over(every), digits)).withColumn("weight", F.round((1.0 / F.col("n")) / F.sum(1.0 / F.col("n")).over(every) * F.count("*").over(every), digits))
