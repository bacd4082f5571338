"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0) on counts of a document.  A
two-class model takes the rules as independent given the class, each right with an
accuracy of its own when it votes; expectation-maximisation estimates these and the
share of good documents from the votes alone, and a document stays where its
posterior probability of being good is at least one half.

One scan turns texts to a few counts a row, written to the shared folder.  The
votes of all documents then aggregate to at most 3**rules distinct patterns, and
each EM round is an aggregate over that bounded table which returns one row of
sums, so rounds cost the same at any corpus size.

Repeated three-word windows are found inside the row: the windows' 64-bit hashes
are sorted with their positions and equal neighbours marked, O(n log n) for a text
of n words, without an exchange (within one text of 20,000 words two different
windows share a hash with probability 1e-11).

Defined results
* a null or empty text, or one of white space only, has no words and fails the base;
* every row comes back once, rows that repeat an id too; a null id is carried along;
* an empty table gives no rows; without votes the prior decides; other columns,
  whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.scratch import SPACE, Scratch, pick, text_or_empty

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this from or are an not have they which you his her "
    "le la les de des du et un une en que qui dans pour par sur au aux est elle il ne pas "
    "der die das und ist nicht ein eine zu mit von für auf den dem im sich auch es "
    "el los las y del por con una su para al lo como más o pero se"
).split()
#: Rule: its value, then the tests at which it votes good and bad (None: it never does); elsewhere it abstains.
RULES = {
    "symbols": (lambda c: c("n_symbols") / c("n_words"), None, (">=", 0.2)),
    "upper_case": (lambda c: c("n_upper") / F.greatest(c("n_letters"), F.lit(1)), None, (">=", 0.5)),
    "exclamation": (lambda c: c("n_exclaim") / c("n_words"), None, (">=", 0.3)),
    "repeats": (lambda c: c("n_repeat_words") / c("n_words"), None, (">=", 0.3)),
    "repeated_lines": (lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)), None, (">=", 0.3)),
    "word_length": (lambda c: c("word_chars") / c("n_words"), (("between", 3.0, 9.0)), (">=", 14.0)),
    "stop_words": (lambda c: c("n_stop") / c("n_words"), (">=", 0.08), ("<=", 0.02)),
    "letters": (lambda c: c("n_letters") / F.greatest(c("word_chars"), F.lit(1)), (">=", 0.92), ("<=", 0.8)),
    "plain": (lambda c: (c("n_symbols") + c("n_exclaim")) / c("n_words"), ("<=", 0.02), (">=", 0.15)),
}
#: Rounds of EM; the share and accuracy they start from; pseudo-votes, right and wrong, that hold an accuracy off 0 and 1.
ROUNDS, START_SHARE, START_ACCURACY, PRIOR = 20, 0.8, 0.8, (8.0, 2.0)
#: A rule counts as better than a coin, and as never quite sure.
LEAST, MOST = 0.55, 0.995


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the counts of every whole text; one narrow pass."""
    left = lambda drop: F.length(F.regexp_replace("t", drop, ""))
    d = pick(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("t"))
    d = d.select(
        "id",
        F.filter(F.split("t", SPACE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        left("[^#*$%&|<>]+").alias("n_symbols"),
        left("[^!]+").alias("n_exclaim"),
        left("[^\\p{Lu}]+").alias("n_upper"),
        left("[^\\p{L}]+").alias("n_letters"),
    )
    plain = ["id", "n_symbols", "n_exclaim", "n_upper", "n_letters"]
    windows = "if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), i -> named_struct('h', xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), 'i', i)))"
    d = d.select(
        *plain,
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr(f"sort_array({windows})").alias("w"),
    )
    plain += ["n_words", "word_chars", "n_stop", "n_lines", "n_dup_lines"]
    twice = "filter(w, (x, j) -> coalesce(get(w, j - 1).h = x.h, false) or coalesce(get(w, j + 1).h = x.h, false))"
    d = d.select(*plain, F.expr(f"sort_array(transform({twice}, x -> x.i))").alias("starts"))
    covered = "aggregate(transform(starts, (s, k) -> least(3, coalesce(get(starts, k + 1) - s, 3))), 0, (a, b) -> a + b)"
    return d.select("id", *[F.col(c).cast("long").alias(c) for c in plain[1:]], F.expr(covered).cast("long").alias("n_repeat_words"))


def votes(found: DataFrame) -> DataFrame:
    """``found`` with one column ``vote_<rule>`` of -1, 0 or 1 for each rule."""

    def test(value: Column, rule: tuple | None) -> Column:
        if rule is None:
            return F.lit(False)
        if rule[0] == "between":
            return value.between(*rule[1:])
        return value <= rule[1] if rule[0] == "<=" else value >= rule[1]

    def vote(value: Column, good: tuple | None, bad: tuple | None) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(test(value, bad), -1).when(test(value, good), 1).otherwise(0).cast("int")

    count = lambda c: F.greatest(F.col(c), F.lit(1)) if c == "n_words" else F.col(c)
    return found.select("*", *[vote(value(count), good, bad).alias(f"vote_{name}") for name, (value, good, bad) in RULES.items()])


def posterior(share: float, right: dict[str, float]) -> Column:
    """Probability of good, given the share of good and each rule's accuracy."""
    score = F.lit(math.log(share / (1 - share)))
    for name, a in right.items():
        score = score + F.col(f"vote_{name}") * F.lit(math.log(a / (1 - a)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def fit(voted: DataFrame, work: Scratch) -> tuple[float, dict[str, float]]:
    """EM over the table of vote patterns; returns the share of good and the rules' accuracies."""
    patterns = work.keep(voted.groupBy(*[f"vote_{r}" for r in RULES]).agg(F.count("*").alias("n")).coalesce(1))
    share, right = START_SHARE, dict.fromkeys(RULES, START_ACCURACY)
    for _ in range(ROUNDS):
        q = patterns.withColumn("q", posterior(share, right))
        total = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("good")]
        for r in RULES:
            v = F.col(f"vote_{r}")
            total.append(F.sum(F.when(v == 1, F.col("n") * F.col("q")).when(v == -1, F.col("n") * (1 - F.col("q"))).otherwise(0.0)).alias(f"right_{r}"))
            total.append(F.sum(F.when(v != 0, F.col("n")).otherwise(0)).alias(f"votes_{r}"))
        s = q.agg(*total).first()
        if not s["n"]:
            break
        share = min(0.99, max(0.01, (s["good"] + 1) / (s["n"] + 2)))
        right = {r: min(MOST, max(LEAST, (s[f"right_{r}"] + PRIOR[0]) / (s[f"votes_{r}"] + sum(PRIOR)))) for r in RULES}
    work.drop(patterns)
    return share, right


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """One row per document: ``id``, the counts, a vote column per rule, ``posterior``, ``base_failed`` and ``kept``."""
    work = Scratch(docs.sparkSession, "quality-rules")
    voted = votes(work.keep(counts(docs, id_col, text_col)))
    share, right = fit(voted, work)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("posterior", posterior(share, right)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= keep_at))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every whole text of ``documents``."""
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
