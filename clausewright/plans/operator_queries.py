"""Queries that call one operator each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import checks, dataset, governance, retrieval, review, rules
from clausewright.plans.tables import table
from clausewright.sources import sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def words(names: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + n.lower().replace("'", "''") + "'" for n in names) + "]"


def held(column: str, names: tuple[str, ...]) -> str:
    return f"len(list_filter({words(names)}, lambda w: contains(lower(coalesce({column}, '')), w))) > 0"


#: A status for each document, as a run would give it.
_STATUS = "CASE WHEN doc_id % 5 = 0 THEN 'RISK' WHEN doc_id % 5 < 3 THEN 'NO_RISK' ELSE 'INSUFFICIENT_EVIDENCE' END"
_FAMILIES = {"economic_stack": checks.ECONOMIC, "exit_failure": checks.EXIT, "remedy_mismatch": checks.REMEDY, "control_mismatch": checks.CONTROL, "ip_continuity_gap": checks.IP, "evidence_gap": checks.AUDIT}


@query(
    "WITH f AS ("
    + " UNION ALL ".join(
        f"SELECT source, doc_id, '{k}' AS signal, {held('text', checks.AUDIT_MARKS)} AS mark, false AS ordered FROM documents WHERE {held('lang', f[0])} OR {held('text', f[1])}" for k, f in _FAMILIES.items()
    )
    + f" UNION ALL SELECT source, doc_id, 'scope_conflict', false, false FROM documents WHERE {held('text', checks.SCOPE)} AND {held('text', checks.SCOPE_MARKS)}"
    + f" UNION ALL SELECT source, doc_id, 'precedence_gap', false, {held('text', checks.HIERARCHY)} FROM documents WHERE {held('text', checks.REFERENCES)}), "
    "g AS (SELECT source, signal, count(*) AS n, count(*) FILTER (mark) AS marks, bool_or(ordered) AS ordered, list_sort(list(doc_id)) AS l FROM f GROUP BY ALL) "
    f"SELECT source, signal, n, array_to_string(l[1:CASE signal WHEN 'scope_conflict' THEN {checks.NAMED_SCOPE} ELSE {checks.NAMED} END], ',') AS clauses FROM g "
    "WHERE CASE signal WHEN 'evidence_gap' THEN marks < n WHEN 'precedence_gap' THEN n >= 2 AND NOT ordered ELSE n >= 2 END"
)
def q_interaction_signals(spark, d):
    """E02."""
    found = checks.interaction_signals(table(spark, d, "documents"), "source", "doc_id", "lang", "text")
    return found.withColumn("clauses", F.array_join("clauses", ","))


@query("SELECT conv_id, turn, to_json([{'role': 'system', 'content': 'Answer briefly.'}, {'role': 'user', 'content': role}, {'role': 'assistant', 'content': text}]) AS messages FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def q_chat_rows(spark, d):
    """K09."""
    c = table(spark, d, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    return sinks.chat_rows(c, "Answer briefly.", "role", "text", ["conv_id", "turn"]).withColumn("messages", F.to_json("messages"))


@query("WITH p AS (SELECT doc_id, unnest([{'t': 'source', 'c': source, 'a': lang}, {'t': 'lang', 'c': lang, 'a': source}]) AS p FROM documents) SELECT doc_id, p.t AS clause_type, 0 AS span_index, p.c AS clause_text, p.a AS answer FROM p WHERE trim(coalesce(p.c, '')) <> ''")
def q_paired_columns(spark, d):
    """P03."""
    return dataset.wide_to_long(table(spark, d, "documents"), "doc_id", [("source", "lang"), ("lang", "source")]).select("doc_id", "clause_type", "span_index", "clause_text", "answer")


@query("SELECT doc_id, CASE WHEN trim(source) IN ('', 'nan', '[]') THEN NULL ELSE trim(source) END AS source, lower(trim(coalesce(lang, ''))) IN ('en', 'fr') AS is_metadata FROM documents")
def q_cleaned_fields(spark, d):
    """P05, P06."""
    return table(spark, d, "documents").select("doc_id", T.clean_or_null("source").alias("source"), dataset.metadata_flag(F.col("lang"), ["EN", "fr"]).alias("is_metadata"))


@query("SELECT doc_id, source, lang FROM documents WHERE lang IS NULL OR lang IN ('en', 'general')")
def q_permissive_filter(spark, d):
    """P10."""
    return table(spark, d, "documents").where(dataset.permissive(F.col("lang"), ["en"])).select("doc_id", "source", "lang")


@query("WITH m AS (SELECT lang AS l, source AS s FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)) SELECT doc_id, CASE WHEN lang = l AND source = s THEN 'direct' WHEN lang = l THEN 'same_law_other_contract' WHEN source = s THEN 'other_law_same_contract' ELSE 'persuasive_only' END AS transfer FROM documents, m")
def q_transferability(spark, d):
    """P11."""
    docs = table(spark, d, "documents")
    one = docs.agg(F.min_by(F.struct("lang", "source"), "doc_id").alias("one")).scalar()
    return docs.select("doc_id", dataset.transferability(F.col("lang") == one["lang"], F.col("source") == one["source"]).alias("transfer"))


@query(f"SELECT doc_id, {_STATUS} AS status FROM documents WHERE {_STATUS} <> 'NO_RISK'")
def q_risk_only(spark, d):
    """P14."""
    return dataset.risk_only(table(spark, d, "documents").select("doc_id", F.expr(_STATUS).alias("status")))


@query(f"SELECT doc_id, ({_STATUS}) = 'RISK' AND n_chars > 100 AND trim(left(coalesce(text, ''), 9)) <> '' AS is_positive FROM documents WHERE n_chars IS NOT NULL")
def q_valid_positive(spark, d):
    """Evidence cut from the text itself, so it stands there."""
    docs = table(spark, d, "documents").where("n_chars IS NOT NULL")
    return docs.select("doc_id", dataset.valid_positive(F.expr(_STATUS), F.col("n_chars") > 100, F.substring(T.text("text"), 1, 9), F.col("text")).alias("is_positive"))


@query("SELECT doc_id, NULL::VARCHAR AS severity, NULL::DOUBLE AS severity_score FROM documents")
def q_severity_shim(spark, d):
    """P16."""
    return dataset.severity_shim(table(spark, d, "documents").select("doc_id"))


@query("SELECT doc_id, contains(lower(concat_ws(' ', source, text)), 'licen') OR contains(lower(concat_ws(' ', source, text)), 'court') AS is_sensitive FROM documents")
def q_jurisdiction_words(spark, d):
    """P17."""
    return table(spark, d, "documents").select("doc_id", dataset.jurisdiction_sensitive(["Licen", "court"], F.col("source"), F.col("text")).alias("is_sensitive"))


@query(f"WITH g AS (SELECT source, list({_STATUS}) AS l FROM documents GROUP BY source) SELECT source, CASE WHEN list_contains(l, 'RISK') THEN 'RISK' WHEN len(list_filter(l, lambda s: s <> 'NO_RISK')) = 0 THEN 'NO_RISK' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM g")
def q_unlabelled_status(spark, d):
    """P18."""
    statuses = table(spark, d, "documents").select("source", F.expr(_STATUS).alias("s")).groupBy("source").agg(F.collect_set("s").alias("l"))
    return statuses.select("source", dataset.unlabelled_status(F.col("l")).alias("status"))


@query(f"WITH a AS (SELECT doc_id, {_STATUS} AS before, CASE WHEN n_chars > 1000 THEN 'RISK' ELSE 'NO_RISK' END AS after FROM documents) SELECT doc_id, before, after FROM a WHERE before <> after")
def q_changed_status(spark, d):
    """J15, J16."""
    docs = table(spark, d, "documents")
    return governance.changed(docs.select("doc_id", F.expr(_STATUS).alias("status")), docs.select("doc_id", F.when(F.col("n_chars") > 1000, "RISK").otherwise("NO_RISK").alias("status")), "doc_id", "status")


@query(f"WITH f AS (SELECT source, {_STATUS} AS status, text, CASE WHEN doc_id % 3 = 0 THEN '\x01' ELSE left(text, 5) END AS evidence FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS n, count(*) FILTER (status = 'RISK') AS n_risk, count(*) FILTER (status = 'RISK' AND NOT contains(text, evidence)) AS n_invalid_evidence FROM f GROUP BY source")
def q_run_audit(spark, d):
    """A36."""
    f = table(spark, d, "documents").where("text IS NOT NULL").select("source", F.expr(_STATUS).alias("status"), "text", F.when(F.col("doc_id") % 3 == 0, "\x01").otherwise(F.substring("text", 1, 5)).alias("evidence"))
    return governance.run_audit(f, "source")


@query("SELECT lang, source, max(CASE WHEN n_chars > 500 THEN 1 ELSE 0 END) AS present, sum(CASE WHEN n_chars > 500 THEN 2 ELSE 0 END)::BIGINT AS n_answers FROM documents GROUP BY lang, source")
def q_presence(spark, d):
    """E21."""
    answers = F.when(F.col("n_chars") > 500, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return governance.presence(table(spark, d, "documents").withColumn("answers", answers), "lang", "source", "answers")


@query("SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'the') AND regexp_matches(lower(coalesce(text, '')), '[0-9]+') AS all_concepts, (CASE WHEN regexp_matches(lower(coalesce(text, '')), 'the') THEN 0 ELSE 1 END + CASE WHEN regexp_matches(lower(coalesce(text, '')), '[0-9]+') THEN 0 ELSE 1 END)::INT AS n_missing, coalesce(n_chars, 0) >= 300 AS cited FROM documents")
def q_answer_evaluation(spark, d):
    """E23."""
    return table(spark, d, "documents").select("doc_id", governance.answer_evaluation(F.col("text"), ["the", "[0-9]+"], F.col("n_chars"), 300).alias("e")).select("doc_id", "e.*")


@query("SELECT p_partkey, v AS scenario_type, CASE v WHEN 'clean' THEN 'NO_RISK' ELSE 'RISK' END AS expected_status, concat_ws('__', p_partkey::VARCHAR, v) AS scenario_id FROM (SELECT p_partkey, unnest(['clean', 'planted']) AS v FROM part)")
def q_scenarios(spark, d):
    """E24."""
    rows = governance.scenarios(table(spark, d, "part").select(F.col("p_partkey").alias("check_id")), {"clean": "NO_RISK", "planted": "RISK"})
    return rows.withColumnRenamed("check_id", "p_partkey")


@query("SELECT p.doc_id AS path, CASE WHEN q.doc_id IS NULL THEN 'missing' WHEN p.doc_id % 4 = 1 THEN 'changed' ELSE 'ok' END AS state FROM documents p LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 2) q USING (doc_id)")
def q_manifest_audit(spark, d):
    """E26."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), T.text("text").alias("content"))
    manifest = files.select("path", F.sha2(F.when(F.col("path") % 4 == 1, F.concat("content", F.lit("+"))).otherwise(F.col("content")), 256).alias("sha256"))
    return governance.manifest_audit(manifest, files.where("path % 4 <> 2"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS domain, CASE WHEN lang IN ('en', 'de') THEN lang END AS subdomain FROM documents")
def q_canonical_domain(spark, d):
    """E20."""
    return table(spark, d, "documents").select("doc_id", governance.canonical_domain(F.col("lang"), {"en": "english", "de": "german"}).alias("c")).select("doc_id", "c.*")


@query("WITH h AS (SELECT d.doc_id, d.source, t.domain, len(list_filter(t.words, lambda w: contains(lower(coalesce(d.text, '')), w))) AS hits FROM documents d, (VALUES ('law', ['licen', 'court', 'law']), ('trade', ['price', 'mail', '%']), ('speech', ['the', 'que', 'und'])) t(domain, words)) SELECT doc_id, domain, hits::INT AS hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, domain)::INT AS rank FROM h WHERE hits > 0")
def q_domains(spark, d):
    """J03."""
    return rules.domains(table(spark, d, "documents"), {"law": ["licen", "court", "law"], "trade": ["price", "mail", "%"], "speech": ["the", "que", "und"]}, "doc_id")


@query("WITH f AS (SELECT doc_id, source, {} AS status FROM documents) SELECT source, count(*) AS n_findings, count(*) FILTER (status = 'RISK') AS n_risk, count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE') AS n_insufficient_evidence, count(*) FILTER (status = 'NO_RISK') AS n_no_risk, CASE WHEN bool_or(status = 'RISK') THEN 'RISK' WHEN bool_or(status = 'INSUFFICIENT_EVIDENCE') THEN 'INSUFFICIENT_EVIDENCE' WHEN bool_or(status = 'NO_RISK') THEN 'NO_RISK' ELSE 'NOT_ASSESSED' END AS contract_status FROM f GROUP BY source".format(_STATUS))
def q_contract_status(spark, d):
    """A29."""
    return rules.contract_status(table(spark, d, "documents").select("source", F.expr(_STATUS).alias("status")), "source")


@query("SELECT doc_id, round_even(0.5 * (n_chars % 7) / 7 + 0.3 * (n_chars % 5) / 5 + 0.2 * (n_chars % 2), 4) AS score FROM documents")
def q_support_score(spark, d):
    """A27."""
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", rules.support_score(n % 7 / 7, n % 5 / 5, n % 2).alias("score"))


@query("WITH e AS (SELECT event_type, event_id, value, user_id FROM events), r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) - 1 AS a, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 97 DESC, event_id) - 1 AS b FROM e) SELECT event_type, event_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 9) AS rrf FROM r")
def q_rrf_full(spark, d):
    """V08."""
    e = table(spark, d, "events").withColumn("other", F.col("event_id") % 97)
    return retrieval.rrf_full(e, ["event_type", "user_id"], "value", "other", "event_id").select("event_type", "event_id", F.round("rrf", 9).alias("rrf"))


@query("WITH v AS (SELECT conv_id, bool_or(NOT contains(text, 'e')) AS has_unverified FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) SELECT conv_id, has_unverified FROM v")
def q_unverified(spark, d):
    """E09."""
    c = table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    return review.unverified(c.select("conv_id", "turn"), c.where(F.contains("text", F.lit("e"))).select("conv_id", "turn"), "conv_id", ["turn"])
