"""Queries on events, conversations and the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import governance as G
from clausewright.operators import metrics as M
from clausewright.operators import review, rules, segment
from clausewright.operators import retrieval as R
from clausewright.plans.tables import table
from clausewright.sources import readers, sinks
from clausewright.streaming import trace

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM n) SELECT user_id, event_type, n FROM r WHERE k = 1")
def q_plurality_vote(spark, d):
    """First seen at a tie."""
    return M.plurality(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM n) SELECT user_id, CASE WHEN 2 * n > 30 THEN event_type ELSE 'DON''T KNOW' END AS answer, round(n / 30, 6) AS agreement FROM r WHERE k = 1")
def q_majority_vote(spark, d):
    """Missing passes abstain."""
    return M.strict_majority(table(spark, d, "events"), "user_id", "event_type", "event_id", expected=30)


@query("SELECT user_id, max({'value': value, 'event_id': event_id}).value AS value, max({'value': value, 'event_id': event_id}).event_id AS event_id, arg_max(event_type, {'value': value, 'event_id': event_id}) AS event_type FROM events GROUP BY user_id")
def q_argmax_summary(spark, d):
    """A28, O03."""
    return M.summary_row(table(spark, d, "events"), "user_id", "event_type", ["value", "event_id"])


@query("WITH e AS (SELECT DISTINCT u.user_id, t.event_type FROM events u, (SELECT DISTINCT event_type FROM events) t), r AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90) SELECT user_id, event_type, 'ANSWERED' AS status FROM r UNION ALL SELECT user_id, event_type, 'INSUFFICIENT_EVIDENCE' FROM e WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM r)")
def q_missing_checks(spark, d):
    """An explicit row for each expected answer without any."""
    e = table(spark, d, "events")
    expected = G.candidates(e.select("user_id").distinct(), e.select("event_type").distinct())
    got = e.where("value > 90").select("user_id", "event_type").distinct().withColumn("status", F.lit("ANSWERED"))
    return rules.missing(expected, got, ["user_id", "event_type"])


@query("WITH t AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 50) SELECT u.user_id, count(*) AS n_expected, count(f.user_id) AS n_found, count(*) = count(f.user_id) AS complete FROM u CROSS JOIN t LEFT JOIN f ON f.user_id = u.user_id AND f.event_type = t.event_type GROUP BY u.user_id")
def q_completeness(spark, d):
    """J12, R03."""
    e = table(spark, d, "events")
    expected = G.candidates(e.select("user_id").distinct(), e.select("event_type").distinct())
    return rules.complete(expected, e.where("value > 50"), ["user_id"], ["event_type"])


_STATUS = "CASE WHEN value > 95 THEN 'RISK' WHEN value < 5 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NO_RISK' END"


@query(f"WITH f AS (SELECT user_id, {_STATUS} AS status FROM events) SELECT user_id, count(*) AS n_findings, count(*) FILTER (status = 'RISK') AS n_risk, count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE') AS n_insufficient_evidence, count(*) FILTER (status = 'NO_RISK') AS n_no_risk, CASE WHEN bool_or(status = 'RISK') THEN 'RISK' WHEN bool_or(status = 'INSUFFICIENT_EVIDENCE') THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NO_RISK' END AS contract_status FROM f GROUP BY user_id")
def q_status_precedence(spark, d):
    """A29."""
    return rules.contract_status(table(spark, d, "events").withColumn("status", F.expr(_STATUS)), "user_id")


@query("SELECT r_name, n_name, count(*) AS n_findings, count(DISTINCT s_suppkey) AS n_clauses, max(s_acctbal) AS top_score FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def q_domain_summary(spark, d):
    """A29, A30 over a star of dimensions."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rules.domain_summary(s, "r_name", "n_name", "s_suppkey", "s_acctbal")


@query("SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 'a' WHEN user_id % 3 = 1 THEN 'b' ELSE 'c' END AS grp, count(*) AS n, count(*) FILTER (value > 50) AS n_ok, round(count(*) FILTER (value > 50) / count(*), 6) AS rate FROM events GROUP BY GROUPING SETS ((), (1), (2))")
def q_conformance(spark, d):
    """By type, by check and over all."""
    e = table(spark, d, "events").select("event_type", F.expr("CASE WHEN user_id % 3 = 0 THEN 'a' WHEN user_id % 3 = 1 THEN 'b' ELSE 'c' END").alias("grp"), F.when(F.col("value") > 50, 1).otherwise(0).alias("observed_status"), F.lit(1).alias("expected_status"))
    return G.conformance(e, "event_type", "grp")


@query("WITH t AS (SELECT conv_id, turn, role, CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 THEN role ELSE role || '#' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) END AS unique_name FROM conversations) SELECT * FROM t")
def q_duplicate_suffix(spark, d):
    """W06, G10."""
    return segment.suffixed(table(spark, d, "conversations"), ["conv_id"], "role", "turn").select("conv_id", "turn", "role", "unique_name")


@query("WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(length(text)) OVER (PARTITION BY conv_id)::BIGINT AS total FROM conversations) SELECT conv_id, turn, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn, start), total) AS \"end\" FROM s")
def q_lead_segments(spark, d):
    """W05, G13."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("long")
    s = table(spark, d, "conversations").withColumn("start", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).withColumn("total", F.sum(n).over(Window.partitionBy("conv_id")))
    return segment.segments(s, "conv_id", "turn", "start", "total").select("conv_id", "turn", "start", "end")


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM conversations")
def q_heading_ffill(spark, d):
    """W04."""
    c = table(spark, d, "conversations").withColumn("h", F.md5("text"))
    return segment.headed(c, "conv_id", "turn", F.col("role") == "user", "h").select("conv_id", "turn", "role", "heading")


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running_max FROM events")
def q_running_max(spark, d):
    """W09."""
    return segment.running_most(table(spark, d, "events"), ["user_id"], "value", "event_id").select("user_id", "event_id", "running_max")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS sequence, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE, 3) AS elapsed_seconds FROM events")
def q_trace_sequence(spark, d):
    """W07."""
    return trace.sequenced(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "sequence", "elapsed_seconds")


@query("SELECT user_id, count(*) AS n_events, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY user_id")
def q_latest_status(spark, d):
    """W08, R02."""
    return trace.latest_status(table(spark, d, "events"), "user_id", "ts", "event_id", ["event_type", "value"])


@query("SELECT user_id, event_id, value FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type, floor(value / 10)) = 1")
def q_unique_answers(spark, d):
    """Answers given twice count for nothing."""
    e = table(spark, d, "events")
    once = e.groupBy("user_id", "event_type", F.floor(F.col("value") / 10)).agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"), F.min("value").alias("value")).where("n = 1")
    return once.select("user_id", "event_id", "value")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations), u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles FROM r WHERE k <= 8 GROUP BY conv_id), b AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS retrieval_text FROM u WHERE k <= 3 GROUP BY conv_id) SELECT a.conv_id, n_turns, roles, retrieval_text FROM a LEFT JOIN b USING (conv_id)")
def q_chat_window(spark, d):
    """W11."""
    return review.chat_window(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("WITH p AS (SELECT doc_id AS id, n_chars AS off, source FROM documents), s AS (SELECT source, n AS page, n * 2000 AS a, (n + 1) * 2000 AS b FROM (SELECT DISTINCT source FROM documents), range(0, 4) AS r(n)) SELECT id, coalesce((SELECT page FROM s WHERE s.source = p.source AND off >= a AND off < b), 3) AS page FROM p")
def q_range_lookup(spark, d):
    """The page that holds an offset, else the last."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("off"), "source")
    spans = docs.select("source").distinct().withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("a", F.col("page") * 2000).withColumn("b", F.col("page") * 2000 + 2000)
    return segment.page_of(docs, spans, "source", "off", "a", "b", "page").select("id", "page")


_REVIEW = "SELECT doc_id, source, lang, CASE WHEN n_chars % 4 = 0 THEN 'NO_RISK' WHEN n_chars % 4 = 1 THEN 'RISK' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, n_chars % 5 AS c FROM documents"


def review_rows(spark, d):
    r = table(spark, d, "documents").select("doc_id", "source", "lang", F.expr("CASE WHEN n_chars % 4 = 0 THEN 'NO_RISK' WHEN n_chars % 4 = 1 THEN 'RISK' ELSE 'INSUFFICIENT_EVIDENCE' END").alias("status"), F.array(F.col("n_chars") % 5).alias("clauses"))
    return review.build_review([r.where("doc_id % 2 = 0"), r.where("doc_id % 2 = 1")], "source", "lang", "clauses")


@query(f"WITH r AS ({_REVIEW}), k AS (SELECT *, doc_id % 2 AS scope FROM r WHERE status <> 'NO_RISK'), x AS (SELECT *, row_number() OVER (PARTITION BY source, lang, c ORDER BY scope, status) AS n FROM k) SELECT source, lang, c::VARCHAR AS clauses, scope::INT AS scope, status, CASE WHEN status = 'RISK' THEN 'flagged' ELSE 'unresolved' END AS section FROM x WHERE n = 1")
def q_review_dedupe(spark, d):
    """E33."""
    return review_rows(spark, d).select("source", "lang", F.array_join("clauses", ",").alias("clauses"), "scope", "status", "section")


@query(f"WITH r AS ({_REVIEW}), k AS (SELECT *, doc_id % 2 AS scope FROM r WHERE status <> 'NO_RISK'), x AS (SELECT *, row_number() OVER (PARTITION BY source, lang, c ORDER BY scope, status) AS n FROM k), g AS (SELECT source, lang, count(*) AS n, count(*) FILTER (status = 'RISK') AS n_flagged FROM x WHERE n = 1 GROUP BY ALL) SELECT *, (row_number() OVER (PARTITION BY source ORDER BY n DESC, lang))::INT AS place FROM g")
def q_topic_order(spark, d):
    """E35."""
    return review.topics(review_rows(spark, d), "source", "lang")


@query("SELECT r_name, p_type, count(*) AS n FROM region, (SELECT DISTINCT p_type FROM part) GROUP BY ALL")
def q_rules_x_profiles(spark, d):
    """Config by config."""
    return G.candidates(table(spark, d, "part").select("p_type").distinct(), table(spark, d, "region")).groupBy("r_name", "p_type").agg(F.count("*").alias("n"))


@query("WITH j AS (SELECT r_regionkey, r_name, n_name, n_nationkey % 2 = 0 AS verified FROM region LEFT JOIN nation ON n_regionkey = r_regionkey) SELECT r_regionkey, r_name, count(n_name) AS n_citations, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS titles, coalesce(bool_and(verified), false) AS all_verified FROM j GROUP BY ALL")
def q_registry_roll_up(spark, d):
    """J19, E14."""
    n = table(spark, d, "nation")
    mapping = n.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    catalog = n.select("n_nationkey", F.col("n_name").alias("title"), (F.col("n_nationkey") % 2 == 0).alias("verified"))
    return G.with_citations(table(spark, d, "region"), mapping, catalog, "r_regionkey", "n_nationkey")


@query("SELECT r_name, count(n_name) AS n_rules, count(n_name) = 0 AS missing FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 4) ON n_regionkey = r_regionkey GROUP BY r_name")
def q_domain_report(spark, d):
    """E29."""
    r = table(spark, d, "region")
    n = table(spark, d, "nation").where("n_nationkey < 4").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name")
    return G.domain_report(n, r.select("r_name"), "r_name")


@query("WITH x AS (SELECT o_orderkey, count(*) AS n, sum(l_quantity) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT count(*) AS n_orders, round(sum(q), 2) AS quantity, max(n) AS most FROM x")
def q_left_join(spark, d):
    """J07."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")), "o_orderkey", "left")
    return j.agg(F.count("*").alias("n_orders"), F.round(F.sum("q"), 2).alias("quantity"), F.max(F.coalesce("n", F.lit(1))).alias("most"))


@query("SELECT c_custkey AS key, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def q_field_mismatches(spark, d):
    """J14, J22, U03."""
    from clausewright.operators.dataset import field_mismatches

    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return field_mismatches(a, b.join(a, "key", "left_semi"), "key", [])


@query("SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1 AND value > 99.5) UNION ALL SELECT user_id, event_type, value FROM events WHERE event_id % 2 = 1 AND value > 99.5)")
def q_replace_keys(spark, d):
    """K05, U06, U01."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return sinks.replace_keys(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 AND value > 99.5"), ["user_id"]).select("user_id", "event_type", "value")


@query("SELECT count(*) AS n_points, count(DISTINCT user_id) AS n_documents, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)) AS n_missing FROM events")
def q_index_census(spark, d):
    """S14."""
    return readers.index_census(table(spark, d, "events"), table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), "user_id")


@query("SELECT conv_id, turn, to_json({'role': role, 'n': length(text)}) AS turn_json FROM conversations")
def q_nested_to_json(spark, d):
    """K02, K09."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.struct("role", F.length("text").alias("n")).alias("turn_json"))
    return sinks.flat(c)


@query("SELECT event_type, (user_id % 7)::BIGINT AS k, event_id, round(value, 2) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY value DESC, event_id) = 1")
def q_first_of_key(spark, d):
    """V27, U05."""
    e = table(spark, d, "events").withColumn("k", F.col("user_id") % 7)
    return R.first_of_key(e, "event_type", ["k"], "value", "event_id", 100).select("event_type", "k", "event_id", F.round("value", 2).alias("value"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def q_daily_counts(spark, d):
    """A01, M07."""
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query()
def q_segments(spark, d):
    """Clauses of every document; a state machine, held against a plain run in the tests."""
    return segment.clauses(table(spark, d, "documents"), "doc_id", "text")


@query()
def q_quote_verify(spark, d):
    """Every whole user turn located in its conversation's whole wording, the first of each conversation."""
    c = table(spark, d, "conversations")
    users = c.where("role = 'user'").select("conv_id", F.col("turn").alias("position"), F.col("text").alias("quote"), F.col("conv_id").cast("string").alias("source"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n")
    source = c.groupBy(F.col("conv_id").cast("string").alias("source")).agg(whole.alias("text"))
    return review.verify_citations(users, source, "conv_id", "source", "quote")
