"""Playbooks, registries, gold records and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.operators.metrics import all_problems

PLAYBOOK = (
    "sources map<string, struct<title: string, tier: string>>, clause_types map<string, struct<keywords: array<string>, checklist: array<struct<id: string, question: string, flag_if: string, domain: string, sources: array<string>>>>>, "
    "cross_clause_checks array<struct<id: string, pair: array<string>, question: string, flag_if: string, domain: string>>, document_checks array<struct<id: string, question: string, flag_if: string, domain: string>>"
)


#: What a run uses where no playbook is given: per clause type its keywords and (id, question, answer that flags, domain).
STARTER = {
    "Liability": (["liability", "liable", "damages"], [("LIA-1", "Is the total liability of each party capped?", "NO", "liability"), ("LIA-2", "Are there losses that no cap covers?", "YES", "liability")]),
    "Termination": (["terminate", "termination", "expiry"], [("TER-1", "Can one party end the contract without cause while the other can't?", "YES", "exit"), ("TER-2", "Is a notice period stated?", "NO", "exit")]),
    "Payment": (["fee", "price", "payment", "invoice"], [("PAY-1", "Can prices rise without consent?", "YES", "commercial"), ("PAY-2", "Is the time of payment stated?", "NO", "commercial")]),
    "Confidentiality": (["confidential", "secret"], [("CON-1", "Does the duty of secrecy end at a stated time?", "NO", "information")]),
}
STARTER_CROSS = [("X-1", ["Liability", "Payment"], "Can a payment remedy exceed the liability cap?", "YES", "liability"), ("X-2", ["Termination", "Payment"], "Do fees stay due after the contract ends?", "YES", "exit")]
STARTER_DOCUMENT = [("DOC-1", "Is an order of precedence stated for attached documents?", "NO", "structure"), ("DOC-2", "Is the governing law stated?", "NO", "structure")]
STARTER_SOURCES = {"starter": ("Starter questions, not legal guidance", "D")}


def starter_playbook(spark) -> DataFrame:
    """One row of the playbook's schema, with this library's own seed questions; every one names the tier-D source."""
    types = {k: (words, [(i, q, flag, domain, list(STARTER_SOURCES)) for i, q, flag, domain in items]) for k, (words, items) in STARTER.items()}
    return spark.createDataFrame([(STARTER_SOURCES, types, STARTER_CROSS, STARTER_DOCUMENT)], PLAYBOOK)


def playbook_or_starter(playbook: DataFrame) -> DataFrame:
    """The playbook, or the starter where it has no row."""
    return playbook if playbook.limit(1).count() else starter_playbook(playbook.sparkSession)


def clause_checks(playbook: DataFrame) -> DataFrame:
    """``category, check_id, question, flag_if, domain, sources, keywords``; blank ids and questions left out."""
    c = playbook.select(F.explode("clause_types").alias("category", "t")).select("category", "t.keywords", F.explode("t.checklist").alias("c"))
    return c.select("category", F.col("c.id").alias("check_id"), F.trim("c.question").alias("question"), "c.flag_if", "c.domain", F.col("c.sources").alias("sources"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")).where("check_id <> '' AND question <> ''")


def cross_checks(playbook: DataFrame) -> DataFrame:
    """E12."""
    return playbook.select(F.explode("cross_clause_checks").alias("c")).select(F.col("c.id").alias("check_id"), "c.pair", "c.question", "c.flag_if", "c.domain").where("size(pair) = 2")


def attach_registry(rules: DataFrame, registry: DataFrame, key: list[str]) -> DataFrame:
    """Each rule with its record; a rule without one raises when it is read."""
    j = rules.join(registry.withColumn("_found", F.lit(True)), key, "left")
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return j.withColumn("_found", F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no registry record for "), named)).cast("boolean")).otherwise(True)).where("_found").drop("_found")


def candidates(rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every rule under every contract profile.  Both are config: profiles are broadcast, rows are their product by intent."""
    return rules.join(F.broadcast(profiles), F.lit(True))


def with_citations(rules: DataFrame, mapping: DataFrame, catalog: DataFrame, rule: str, authority: str) -> DataFrame:
    """Rules with their authorities rolled up: count, sorted titles, whether all are verified; a rule without any stays."""
    j = rules.select(rule).join(mapping, rule, "left").join(catalog, authority, "left")
    n = j.groupBy(rule).agg(F.count(authority).alias("n_citations"), F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("titles"), F.coalesce(F.bool_and(F.col("verified")), F.lit(False)).alias("all_verified"))
    return rules.join(n, rule)


def lifecycle_problems(status: Column, reviewer: Column, approved_at: Column, cases: Column, citations: Column) -> Column:
    """What a rule's status asks for and the record lacks."""
    active = status == "ACTIVE"
    return all_problems({"unknown_status": ~status.isin("DRAFT", "CANDIDATE", "REVIEWED", "ACTIVE", "RETIRED"), "active_without_reviewer": active & (F.coalesce(F.trim(reviewer), F.lit("")) == ""), "active_without_date": active & approved_at.isNull(), "active_without_cases": active & (F.coalesce(cases, F.lit(0)) == 0), "active_without_citation": active & (F.coalesce(citations, F.lit(0)) == 0), "draft_with_date": (status == "DRAFT") & approved_at.isNotNull()})


def registry_audit(registry: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """One row: records, ids given twice, rules without a record, records without a rule."""
    twice = registry.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_duplicate_ids"))
    lost = rules.select(key).distinct().join(registry.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_without_record"))
    loose = registry.select(key).distinct().join(rules.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n_dangling"))
    return registry.agg(F.count("*").alias("n_records")).join(twice).join(lost).join(loose)


def next_actions(*todo: tuple[str, Column]) -> Column:
    """What is still to do, in order, joined by semicolons."""
    return F.concat_ws(";", *[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in todo])


def gold_problems(text: Column, quote: Column, start: Column, end: Column, digest: Column, reviewers: tuple[Column, Column]) -> Column:
    """Quote, hash, offsets and independence of a gold evidence record."""
    return all_problems({"empty_quote": F.coalesce(F.trim(quote), F.lit("")) == "", "offsets_out_of_order": start >= end, "offset_mismatch": F.substring(text, start + 1, end - start) != quote, "hash_mismatch": F.sha2(quote, 256) != digest, "same_reviewer": reviewers[0].eqNullSafe(reviewers[1])})


def canonical_domain(c: Column, names: dict[str, str]) -> Column:
    """struct(domain, subdomain): the canonical name, the earlier label kept below it."""
    to = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(F.trim(c)))
    return F.struct(F.coalesce(to, c).alias("domain"), F.when(to.isNotNull() & (F.lower(to) != F.lower(F.trim(c))), c).alias("subdomain"))


def presence(rows: DataFrame, doc: str, category: str, answers: str) -> DataFrame:
    """Per document and category whether any answer is given."""
    return rows.groupBy(doc, category).agg(F.max((F.size(answers) > 0).cast("int")).alias("present"), F.sum(F.size(answers).cast("long")).alias("n_answers"))


def answer_evaluation(answer: Column, concepts: list[str], citations: Column, least: int = 1) -> Column:
    """struct(all_concepts, n_missing, cited): every concept's pattern occurs, enough citations."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    miss = F.size(F.array_compact(F.array(*[F.when(~low.rlike(c), F.lit(c)) for c in concepts])))
    return F.struct((miss == 0).alias("all_concepts"), miss.alias("n_missing"), (F.coalesce(citations, F.lit(0)) >= least).alias("cited"))


def scenarios(checks: DataFrame, variants: dict[str, str]) -> DataFrame:
    """A scenario per check and variant, with the status expected."""
    m = F.create_map(*[F.lit(x) for kv in variants.items() for x in kv])
    return checks.select("*", F.explode(m).alias("scenario_type", "expected_status")).withColumn("scenario_id", F.concat_ws("__", "check_id", "scenario_type"))


def scenario_audit(matrix: DataFrame, files: DataFrame, anchors: str, file: str) -> DataFrame:
    """Per scenario: the file is there, its hash agrees, anchors that its text lacks."""
    j = matrix.join(files.select(file, F.col("text").alias("_t")), file, "left")
    lost = F.size(F.filter(anchors, lambda a: ~F.contains(F.coalesce("_t", F.lit("")), a)))
    return j.select("scenario_id", F.col("_t").isNotNull().alias("has_file"), F.coalesce(F.sha2("_t", 256) == F.col("sha256"), F.lit(False)).alias("hash_ok"), lost.alias("n_missing_anchors"))


def manifest_audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``path, state``: ok, missing or changed.  files: path, content."""
    j = manifest.join(files.select("path", F.sha2("content", 256).alias("_h")), "path", "left")
    return j.select("path", F.when(F.col("_h").isNull(), "missing").when(F.col("_h") != F.col("sha256"), "changed").otherwise("ok").alias("state"))


def conformance(runs: DataFrame, kind: str, check: str) -> DataFrame:
    """Conformity by scenario type, by check and over all, from one aggregate."""
    ok = F.count_if(F.col("observed_status") == F.col("expected_status"))
    return runs.groupingSets([[], [kind], [check]], kind, check).agg(F.count("*").alias("n"), ok.alias("n_ok"), F.round(ok / F.count("*"), 6).alias("rate"))


def changed(a: DataFrame, b: DataFrame, key: str, status: str) -> DataFrame:
    """Rows of two runs by a unique id whose status differs."""
    j = a.select(key, F.col(status).alias("before")).join(b.select(key, F.col(status).alias("after")), key)
    return j.where(~F.col("before").eqNullSafe(F.col("after")))


def domain_report(rules: DataFrame, domains: DataFrame, domain: str) -> DataFrame:
    """Rules per canonical domain, those without any too."""
    return domains.join(rules.groupBy(domain).agg(F.count("*").alias("n_rules")), domain, "left").na.fill(0, ["n_rules"]).withColumn("missing", F.col("n_rules") == 0)


def run_audit(findings: DataFrame, doc: str) -> DataFrame:
    """Per run the findings by status and how many lack evidence that stands in the text."""
    return findings.groupBy(doc).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "RISK").alias("n_risk"), F.count_if((F.col("status") == "RISK") & ~F.contains("text", "evidence")).alias("n_invalid_evidence"))
