"""Text functions: Columns in, Columns out (T01-T29, T33-T35, T37-T45, M*).

All are built-in expressions but for Unicode folding (``unicode.py``), so Catalyst
sees through them and they run inside code generation.  A null text counts as empty
unless said otherwise; every pattern is a parameter or a module constant.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright.functions.regexkit import any_of, rx

# --- basics -----------------------------------------------------------------


def text(c: Column | str) -> Column:
    """Null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trimmed(c: Column | str) -> Column:
    """Null as empty, outer white space gone (any Unicode white space)."""
    return F.regexp_replace(text(c), rx(r"^\s+|\s+$"), "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def clean_or_null(c: Column | str, missing: tuple[str, ...] = ("", "nan", "[]")) -> Column:
    """Null for blanks and for the texts that stand for a missing value."""
    t = trimmed(c)
    return F.when(~F.lower(t).isin(*missing), t)


def fold_replace(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered (pattern, replacement) rules applied one after another."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


# --- cleaning ---------------------------------------------------------------

QUOTES = {"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"'}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"


def straight_quotes(c: Column) -> Column:
    """Curly quotes made straight."""
    return F.translate(c, "".join(QUOTES), "".join(QUOTES.values()))


def one_space(c: Column, unicode: bool = True) -> Column:
    """Runs of white space made one space, outer ones gone."""
    return F.trim(F.regexp_replace(c, rx(r"\s+", unicode=unicode), " "))


def conservative_clean(c: Column | str, unicode: bool = True) -> Column:
    """struct(text, actions) - NBSP, invisible characters, curly quotes and white space normalised, with what was done, sorted.

    Canonical composition is left to ``unicode.nfc`` before this, where it matters.
    """
    t0 = text(c)
    t1 = F.translate(t0, "\u00a0", " ")
    t2 = F.translate(t1, INVISIBLE, "")
    t3 = straight_quotes(t2)
    t4 = one_space(t3, unicode)
    done = [("nbsp_replaced", t0, t1), ("invisible_removed", t1, t2), ("quotes_straightened", t2, t3), ("whitespace_collapsed", t3, t4)]
    actions = F.array_sort(F.array_compact(F.array(*[F.when(a != b, F.lit(n)) for n, a, b in done])))
    return F.struct(t4.alias("text"), actions.alias("actions"))


#: Our own list of short forms and what they stand for, in the order applied.
ABBREVIATIONS = [
    (r"\bAgmt\b\.?", "Agreement"), (r"\bAmt\b\.?", "Amount"), (r"\bArt\b\.", "Article"), (r"\bCl\b\.", "Clause"), (r"\bCo\b\.", "Company"), (r"\bCorp\b\.", "Corporation"),
    (r"\bDept\b\.", "Department"), (r"\bExh\b\.", "Exhibit"), (r"\bInc\b\.", "Incorporated"), (r"\bLtd\b\.", "Limited"), (r"\bNo\b\.", "Number"), (r"\bPara\b\.", "Paragraph"),
    (r"\bSec\b\.", "Section"), (r"\bw/o\b", "without"),
]


def expand_abbreviations(c: Column, rules: list[tuple[str, str]] = ABBREVIATIONS, unicode: bool = True) -> Column:
    """T03."""
    return fold_replace(c, [(rx(p, unicode=unicode), to) for p, to in rules])


def collapse_punctuation(c: Column) -> Column:
    """A run of sentence marks leaves its last one."""
    return F.regexp_replace(c, r"([.!?]){2,}", "$1")


def preprocess(c: Column | str, quotes: bool = True, abbreviations: bool = True, punctuation: bool = True, unicode: bool = True) -> Column:
    """The above in order, each on request."""
    t = text(c)
    t = straight_quotes(t) if quotes else t
    t = expand_abbreviations(t, unicode=unicode) if abbreviations else t
    t = collapse_punctuation(t) if punctuation else t
    return one_space(t, unicode)


BOILERPLATE = r"^\s*(?:page\s+\d+(?:\s+of\s+\d+)?|-?\s*\d{1,4}\s*-?|exhibit\s+[a-z0-9.-]+|schedule\s+[a-z0-9.-]+|confidential)\s*$"


def strip_boilerplate(c: Column | str, pattern: str = BOILERPLATE, unicode: bool = True) -> Column:
    """struct(text, removed) without lines that only number pages or name exhibits."""
    lines = F.split(text(c), "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(rx(pattern, unicode=unicode, ignore_case=True)))
    return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("removed"))


def advanced_preprocess(c: Column | str, unicode: bool = True) -> Column:
    """struct(text, folded, notes)."""
    stripped = strip_boilerplate(c, unicode=unicode)
    whole = preprocess(stripped["text"], unicode=unicode)
    notes = F.array_compact(F.array(F.when(stripped["removed"] > 0, F.concat(F.lit("boilerplate_lines:"), stripped["removed"].cast("string"))), F.when(whole != text(c), F.lit("normalised"))))
    return F.struct(whole.alias("text"), F.lower(whole).alias("folded"), notes.alias("notes"))


def embedding_text(c: Column | str, unicode: bool = True) -> Column:
    """T08."""
    return F.lower(preprocess(c, unicode=unicode))


# --- line and block tests ----------------------------------------------------


def header_key(c: Column | str, unicode: bool = True) -> Column:
    """A line's key for repeated headers: lower case, digits as #, white space single."""
    return F.regexp_replace(F.lower(one_space(text(c), unicode)), r"\d+", "#")


def is_page_number(c: Column | str) -> Column:
    """T09."""
    return F.trim(text(c)).rlike(r"(?i)^(?:page\s*)?[-–]?\s*\d{1,4}\s*[-–]?(?:\s*(?:of|/)\s*\d{1,4})?$")


def is_caps_title(c: Column | str) -> Column:
    """6 to 100 characters, 1 to 8 words, capitals only, no digit."""
    t = F.trim(text(c))
    return t.rlike(r"^[A-Z][A-Z \t&,.'()/-]+$") & F.length(t).between(6, 100) & ~t.rlike(r"\d") & F.size(F.split(t, r"\s+")).between(1, 8)


def is_structural_start(c: Column | str) -> Column:
    """A line that opens a numbered, lettered, named or titled part."""
    t = F.trim(text(c))
    return t.rlike(r"^\d+(?:\.\d+)*[.)]?\s+\S") | t.rlike(r"(?i)^(?:article|section|clause|schedule|annex|appendix)\s+[0-9ivxlc]+\b") | t.rlike(r"^\((?:[a-z]{1,2}|[ivx]+|\d+)\)\s+\S") | is_caps_title(c)


def is_footnote(c: Column | str) -> Column:
    """T12."""
    t = F.trim(text(c))
    return t.rlike(r"^(?:\[\d{1,3}\]|\d{1,3}\s+(?i:see|cf\.|note)\b|\*{1,3}\s+\S|†\s+\S)")


DEFINITION_CUES = ("shall mean", "means", "has the meaning", "is defined as", "refers to")


def is_definition(c: Column | str, cues: tuple[str, ...] = DEFINITION_CUES) -> Column:
    """A quoted term near the start and a defining phrase."""
    t = F.lower(F.substring(straight_quotes(text(c)), 1, 300))
    return t.rlike(r'^\W{0,3}"[^"]{2,60}"') & reduce(lambda a, b: a | b, [t.contains(x) for x in cues])


MARKERS = (r"^(\d+(?:\.\d+)+)[.)]?(?=\s|$)", r"^(\d+)[.)](?=\s|$)", r"(?i)^((?:article|section|clause)\s+[0-9ivxlc]+(?:\.\d+)*)\b", r"^(\([a-z0-9]{1,4}\))(?=\s|$)", r"^([A-Za-z][.)])(?=\s|$)")


def leading_marker(c: Column | str, patterns: tuple[str, ...] = MARKERS) -> Column:
    """The first pattern's marker; null without any."""
    t = F.trim(text(c))
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])


def marker_kind(marker: Column) -> Column:
    """Decimal, integer, roman, letter, named or none; roman is tested before letter."""
    core = F.lower(F.regexp_replace(marker, r"[().\s]+$|^[(\s]+", ""))
    return (
        F.when(marker.isNull(), "none").when(core.rlike(r"^(?:article|section|clause)"), "named").when(core.rlike(r"^\d+(?:\.\d+)+$"), "decimal")
        .when(core.rlike(r"^\d+$"), "integer").when(core.rlike(r"^[ivxlc]+$"), "roman").when(core.rlike(r"^[a-z]{1,2}$"), "letter").otherwise("other")
    )


SIGNATURE_LABELS = r"(?i)\b(?:signature|signed|by|name|title|date|witness)\s*:"


def is_signature(c: Column | str) -> Column:
    """Under 800 characters, two labels or more, not numbered."""
    t = text(c)
    return (F.length(t) < 800) & (F.size(F.regexp_extract_all(t, F.lit(SIGNATURE_LABELS), F.lit(0))) >= 2) & leading_marker(t).isNull()


# --- taggers and extractors --------------------------------------------------


def tags(c: Column | str, patterns: dict[str, str]) -> Column:
    """Labels of all patterns that occur, in the table's order."""
    t = text(c)
    return F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(label)) for label, p in patterns.items()])))


def first_label(c: Column | str, patterns: dict[str, str], allowed: Column | None = None) -> Column:
    """The first pattern's label that occurs and, if a list is given, is allowed."""
    t = text(c)
    hit = lambda label, p: t.rlike(p) if allowed is None else t.rlike(p) & F.array_contains(allowed, label)
    return F.coalesce(*[F.when(hit(label, p), F.lit(label)) for label, p in patterns.items()])


#: (left label, right label, evidence for left, evidence for right).
def resolve_pairs(c: Column | str, predicted: Column, pairs: list[tuple[str, str, str, str]]) -> Column:
    """struct(label, reason): of a confusable pair the one whose pattern alone occurs; the first pair that decides."""
    t = text(c)
    label, reason = predicted, F.lit("unchanged")
    for left, right, is_left, is_right in reversed(pairs):
        a, b, mine = t.rlike(is_left), t.rlike(is_right), predicted.isin(left, right)
        label = F.when(mine & a & ~b, F.lit(left)).when(mine & b & ~a, F.lit(right)).otherwise(label)
        reason = F.when(mine & (a != b), F.lit(f"{left}|{right}")).otherwise(reason)
    return F.struct(label.alias("label"), reason.alias("reason"))


SPANS = {
    "dates": r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4})\b",
    "money": r"(?i)(?:[$€£]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:usd|eur|gbp|dollars|euros)\b)",
    "percentages": r"\d+(?:\.\d+)?\s?%",
    "durations": r"(?i)\b\d+\s+(?:day|week|month|year|hour)s?\b",
    "numbers": r"\b\d+(?:\.\d+)?\b",
}


def dedupe_ignoring_case(array: Column) -> Column:
    """An array's first occurrences, upper and lower case alike."""
    low = F.transform(array, F.lower)
    return F.filter(array, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def spans(c: Column | str, patterns: dict[str, str] = SPANS) -> Column:
    """Struct of arrays, a kind each, first occurrences in order."""
    return F.struct(*[dedupe_ignoring_case(F.regexp_extract_all(text(c), F.lit(p), F.lit(0))).alias(k) for k, p in patterns.items()])


def keywords(c: Column | str, vocabulary: list[str]) -> Column:
    """The words of the vocabulary that occur, in its order."""
    t = F.lower(text(c))
    return F.array_compact(F.array(*[F.when(t.contains(w.lower()), F.lit(w)) for w in vocabulary]))


def sentences(c: Column | str) -> Column:
    """Cut after a sentence mark that white space and a capital, digit or quote follow."""
    return F.filter(F.split(text(c), r"(?<=[.!?;])\s+(?=[\p{Lu}\d\"'(])"), lambda s: F.trim(s) != "")


def clause_structure(c: Column | str, duties: int = 12, exceptions: int = 10) -> Column:
    """Sections and documents referred to, dependencies, defined terms, duties, exceptions, scope, role and direction."""
    t, s = text(c), sentences(c)
    every = lambda p, g=0: dedupe_ignoring_case(F.regexp_extract_all(t, F.lit(p), F.lit(g)))
    pick = lambda p: F.filter(s, lambda x: x.rlike(p))
    low = F.lower(t)
    return F.struct(
        every(r"(?i)\b(?:section|clause|article)\s+\d+(?:\.\d+)*").alias("sections"),
        every(r"(?i)\b(?:schedule|exhibit|annex|appendix)\s+[A-Z0-9]+\b").alias("documents"),
        every(r"(?i)\b(?:subject to|pursuant to|in accordance with|notwithstanding)\b").alias("dependencies"),
        every(r"[\"“]([^\"”]{2,60})[\"”]", 1).alias("terms"),
        F.slice(pick(r"(?i)\b(?:shall|must|agrees? to|is required to)\b"), 1, duties).alias("duties"),
        F.slice(pick(r"(?i)\b(?:except|unless|provided that|other than)\b"), 1, exceptions).alias("exceptions"),
        F.struct(low.rlike(r"\b(?:worldwide|global)\b").alias("worldwide"), low.rlike(r"\bexclusive\b").alias("exclusive"), low.rlike(r"\b(?:perpetual|irrevocable)\b").alias("perpetual")).alias("scope"),
        F.when(low.rlike(r"\bshall not\b|\bmay not\b"), "restriction").when(low.rlike(r"\bshall\b|\bmust\b"), "obligation").when(low.rlike(r"\bmay\b"), "right").otherwise("statement").alias("role"),
        F.when(low.rlike(r"\b(?:each|both|either) part(?:y|ies)\b"), "mutual").when(low.rlike(r"\bparty\b"), "one_way").otherwise("unstated").alias("direction"),
    )


#: A date in figures or with its month's name.
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|[A-Za-z]{3,9}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4}|\d{1,2}(?:st|nd|rd|th)? (?:day of )?[A-Za-z]{3,9}\.?,? \d{4})"
#: Per field the patterns in order of precedence; group 1 is the value.
METADATA: dict[str, tuple[str, ...]] = {
    "agreement_date": (rf"(?is)\b(?:agreement date|date of this agreement|dated as of|agreement is dated|agreement dated)\s*[:-]?\s*({DATE})", rf"(?is)\bagreement (?:is |was )?(?:made|entered into)(?: as of| on)\s+({DATE})"),
    "effective_date": (rf"(?is)\b(?:effective date|effective as of|commencement date)\s*(?:is|[:-])?\s*({DATE})",),
    "expiration_date": (rf"(?is)\b(?:expiration date|expiry date|expires? on|end date)\s*(?:is|[:-])?\s*({DATE})",),
    "governing_law": (r"(?is)\bgoverned by(?: and construed in accordance with)?\s+(?:the laws? of\s+)?(?:the )?(?:state of )?([^.;\n]{2,120})",),
    "forum": (r"(?is)\bjurisdiction of\s+(?:the )?([^.;\n]{3,160})", r"(?is)\bdisputes? (?:shall be |will be )?(?:brought|heard|resolved|settled) in\s+([^.;\n]{3,160})", r"(?is)\bcourts? (?:of|in|located in) ([^.;\n]{3,160})"),
}
#: Wordings that stand in for a date: the field they are given if that date is missing.
CONDITIONS = {
    "effective_date": ("effective_date_condition", r"(?is)([^.;\n]{0,100}(?:takes? effect|effective)\s+upon\s+[^.;\n]{3,180})"),
    "expiration_date": ("expiration_terms", r"(?is)([^.;\n]{0,120}(?:for an indefinite term|continues? indefinitely)[^.;\n]{0,100})"),
}
#: Two names each: labelled sides first, then an opening's wording.
PARTIES = (
    r"(?is)\bparty\s+a\s*(?:\([^)]*\))?\s*:\s*([^\r\n]{1,180}?)(?:\s+address\s*:[^\r\n]*)?\s+party\s+b\s*(?:\([^)]*\))?\s*:\s*([^\r\n]{1,180}?)(?=\s+address\s*:|[\r\n]|$)",
    r"(?is)\bbetween\s+(.{2,160}?)\s+and\s+(.{2,160}?)(?:[.,;(\n]|\s+as of\b|$)",
)


def metadata(c: Column | str, patterns: dict[str, tuple[str, ...]] = METADATA, conditions: dict[str, tuple[str, str]] = CONDITIONS, parties: tuple[str, ...] = PARTIES) -> Column:
    """Per field the captured value and its evidence, null where nothing matches; the parties are an array of two names.

    A condition is given only where its date is missing.
    """
    t = text(c)
    edges = lambda v: F.nullif(F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"^[ :;,.\"()]+|[ :;,.\"()]+$", ""), F.lit(""))
    said = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 0)), F.lit(""))
    value = {k: F.coalesce(*[edges(F.regexp_extract(t, p, 1)) for p in ps]) for k, ps in patterns.items()}
    fields = {k: F.struct(value[k].alias("value"), F.coalesce(*[said(p) for p in ps]).alias("evidence")) for k, ps in patterns.items()}
    for date, (name, p) in conditions.items():
        lacks = value[date].isNull() if date in value else F.lit(True)
        fields[name] = F.struct(F.when(lacks, edges(F.regexp_extract(t, p, 1))).alias("value"), F.when(lacks, said(p)).alias("evidence"))
    two = [F.when(said(p).isNotNull(), F.struct(F.array(edges(F.regexp_extract(t, p, 1)), edges(F.regexp_extract(t, p, 2))).alias("value"), said(p).alias("evidence"))) for p in parties]
    nobody = F.struct(F.lit(None).cast("array<string>").alias("value"), F.lit(None).cast("string").alias("evidence"))
    return F.struct(F.coalesce(*two, nobody).alias("parties"), *[f.alias(k) for k, f in fields.items()])


# --- lookups ------------------------------------------------------------------


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def mapped(c: Column | str, exact: dict[str, str], ladder: list[tuple[str, str]], default: str) -> Column:
    """An exact label, else the first phrase contained in it, else the default."""
    t = F.lower(trimmed(c))
    out = F.lit(default)
    for phrase, to in reversed(ladder):
        out = F.when(t.contains(phrase.lower()), F.lit(to)).otherwise(out)
    return F.coalesce(F.try_element_at(literal_map({k.lower(): v for k, v in exact.items()}), t), out) if exact else out


def guidance_query(c: Column | str, label: Column, limit: int = 400) -> Column:
    """T26."""
    return F.concat_ws(" ", label, F.substring(one_space(text(c)), 1, limit))


# --- questions -------------------------------------------------------------------

STOP = "a an and are as at be by can do does for from has have how i in is it of on or our that the this to was we what when which who why will with you".split()


def question_terms(c: Column | str, concepts: dict[str, list[str]] | None = None, stop: list[str] = STOP) -> Column:
    """struct(direct, expanded): terms of three letters or more without stop words; terms of concepts whose pattern occurs."""
    t = F.lower(text(c))
    direct = F.array_distinct(F.array_except(F.regexp_extract_all(t, F.lit("[a-z0-9]{3,}"), F.lit(0)), F.array(*[F.lit(x) for x in stop])))
    none = F.array().cast("array<string>")
    more = F.flatten(F.array(none, *[F.when(t.rlike(p), F.array(*[F.lit(x) for x in ws])).otherwise(none) for p, ws in (concepts or {}).items()]))
    return F.struct(direct.alias("direct"), F.array_except(F.array_distinct(more), direct).alias("expanded"))


def clause_numbers(c: Column | str) -> Column:
    """Numbers named after clause, section or article, lists such as "3, 4 and 5" too."""
    runs = F.regexp_extract_all(F.lower(text(c)), F.lit(r"\b(?:clauses?|sections?|articles?)\s+(\d+(?:\.\d+)*(?:(?:\s*,\s*(?:and\s+)?|\s+and\s+)\d+(?:\.\d+)*)*)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(r"\d+(?:\.\d+)*"), F.lit(0)))))


def single_clause_lookup(c: Column | str) -> Column:
    """The number, if the text asks for exactly one clause."""
    found = clause_numbers(c)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


INTENTS = {"risk": r"\b(?:risk|risks|risky|danger|exposure)\b", "gap": r"\b(?:missing|absent|lack|lacks|gap|gaps)\b", "overview": r"\b(?:summary|summarise|summarize|overview|about)\b", "help": r"^\s*(?:help|hi|hello)\b", "party": r"\b(?:who are the parties|parties to|which parties)\b"}


def intents(c: Column | str, patterns: dict[str, str] = INTENTS) -> Column:
    """Struct of booleans; a question about duties isn't one about who the parties are."""
    t = F.lower(text(c))
    found = {k: t.rlike(p) for k, p in patterns.items()}
    if "party" in found:
        found["party"] = found["party"] & ~t.rlike(r"\b(?:must|shall|oblig|duty|duties|responsib)")
    return F.struct(*[v.alias(k) for k, v in found.items()])


# --- small tools -----------------------------------------------------------------


def snippet(c: Column | str, needle: Column | str, around: int = 60) -> Column:
    """The text around the needle's first place; empty where it doesn't occur."""
    t, n = text(c), F.lit(needle) if isinstance(needle, str) else needle
    at = F.locate(needle, t) if isinstance(needle, str) else F.expr("1") * F.position(n, t)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(t, start, at - start + F.length(n) + around)).otherwise("")


def clip(c: Column | str, n: int, mark: str = "...") -> Column:
    """At most n characters, the mark included."""
    t = text(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - len(mark))), F.lit(mark))).otherwise(t)


def slug(c: Column | str) -> Column:
    """T34."""
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(c: Column) -> Column:
    """The commonest English endings off words that keep four letters."""
    return F.regexp_replace(F.lower(c), r"^(.{4,}?)(?:ations?|ements?|ments?|ings?|ities|ies|ed|es|s)$", "$1")


TOKENS = {"word": "[a-z0-9_]+", "alnum": "[a-z0-9]+", "long": "[a-z0-9]{3,}", "plain": "[a-z]+"}


def tokens(c: Column | str, kind: str = "alnum") -> Column:
    """One of the tokenizers, on lower-cased text."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKENS.get(kind, kind)), F.lit(0))


def shingles(words: Column, n: int) -> Column:
    """The distinct n-grams of a word array, joined by a space; empty for fewer words."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def strip_reasoning(c: Column | str) -> Column:
    """Without a model's thinking block, closed or cut."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def last_json_object(c: Column | str) -> Column:
    """The last flat object's text, or null."""
    found = F.regexp_extract_all(strip_reasoning(c), F.lit(r"(?s)\{[^{}]*\}"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def closed_set_prediction(c: Column | str, labels: list[str], field: str = "label") -> Column:
    """struct(prediction, status, raw): the object's label, or the bare text, if it is one of the labels in any case."""
    raw = text(c)
    obj = last_json_object(raw)
    said = F.trim(F.coalesce(F.get_json_object(obj, f"$.{field}"), F.regexp_replace(strip_reasoning(raw), "[\"'.\\s]+$|^[\"'\\s]+", "")))
    label = F.try_element_at(literal_map({x.lower(): x for x in labels}), F.lower(said))
    status = F.when(F.trim(raw) == "", "empty").when(label.isNull(), "out_of_set").when(obj.isNotNull(), "json").otherwise("text")
    return F.struct(label.alias("prediction"), status.alias("status"), raw.alias("raw"))


def checklist_answers(c: Column | str, valid_ids: Column | None = None, allowed: tuple[str, ...] = ("YES", "NO", "DON'T KNOW")) -> Column:
    """array<struct(id, answer, evidence)> of a model's JSON array: admissible answers to known ids; an id given twice counts for nothing."""
    read = F.from_json(F.regexp_extract(strip_reasoning(c), r"(?s)\[.*\]", 0), "array<struct<id: string, answer: string, evidence: string>>")
    got = F.coalesce(read, F.array().cast("array<struct<id: string, answer: string, evidence: string>>"))
    ids = F.transform(got, lambda x: x["id"])
    known = (lambda x: F.array_contains(valid_ids, x["id"])) if valid_ids is not None else (lambda x: F.lit(True))
    return F.filter(got, lambda x: F.upper(x["answer"]).isin(*allowed) & known(x) & (F.size(F.filter(ids, lambda i: i == x["id"])) == 1))


def phrase_pattern(phrase: str, generic: tuple[str, ...] = ("agreement", "party", "clause", "contract")) -> str | None:
    """A pattern for a keyword phrase on word borders; None for one of generic words only."""
    words = re.findall(r"[a-z0-9]+", phrase.lower())
    if not words or all(w in generic for w in words):
        return None
    return r"(?i)\b" + r"\W+".join(map(re.escape, words)) + r"\b"


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the row's JSON with columns in name order; nulls are kept as keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def codes(c: Column | str, aliases: dict[str, str]) -> Column:
    """Distinct codes of the aliases that occur as words, sorted."""
    t = F.lower(text(c))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(any_of([a.lower()])), F.lit(code)) for a, code in aliases.items()]))))


def compatible(a: Column, b: Column) -> Column:
    """Whether two code sets meet; an empty one fits all."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def attributed(c: Column | str, entity: str, fact: str, separator: str = r"[;\n]|\bwhereas\b|\bwhile\b") -> Column:
    """Whether one segment of a comparison names the entity and states the fact."""
    return F.exists(F.split(F.lower(text(c)), separator), lambda s: s.contains(entity.lower()) & s.rlike(fact))


def polarity(flag: Column, overrides: dict[str, str] | None = None, key: Column | None = None) -> Column:
    """The answer that triggers a check, from how its flag is worded."""
    t = F.lower(F.trim(text(flag)))
    said = F.when(t.rlike(r"^(?:no|not|missing|absent|lacks?|without)\b"), "NO").when(t.rlike(r"^(?:yes|present|contains?|includes?|has)\b"), "YES").otherwise("YES")
    return F.coalesce(F.try_element_at(literal_map(overrides), key), said) if overrides and key is not None else said


def bounded_number(c: Column, low: float, high: float) -> Column:
    """The number, if the text is finite and in range; else null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & n.between(low, high), n)


def iso_date(c: Column) -> Column:
    """The date, if the text is one; else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def stable_uuid(*parts: Column) -> Column:
    """A version-5 UUID of the parts joined by ``::``, in the URL name space."""
    name = F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(F.concat_ws("::", *parts), "utf-8"))
    h = F.sha1(name)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))
