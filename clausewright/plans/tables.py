"""The fixture tables, and the rule tables and vocabularies that the queries use on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.operators.rules import Rule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Patterns shared with the SQL side: no look-around, no flags but (?i).
RULES = [
    Rule("licence", "ip", "(?i)licen[cs]e", ("(?i)copyright",), "Is a licence named?", "licen"),
    Rule("email", "privacy", r"[A-Za-z0-9_]+@[A-Za-z0-9_]+\.[a-z]+", (), "Is an address given?", "@"),
    Rule("percent", "economic", r"\d+%", (), "Is a share stated?", "%"),
    Rule("long_number", "privacy", r"\d{6,}", ("(?i)licen[cs]e",), "Is a long number given?"),
    Rule("the_of", "scope", r"(?i)\bthe of\b", (r"(?i)\bwith\b",), "Is the scope stated?", "the of"),
    Rule("and_the", "remedy", r"(?i)\band the\b", (), "Is the remedy stated?", "and the"),
]

#: Label patterns, in order of precedence.
LABELS = {"licence": "(?i)licen[cs]e", "table": r"\|", "address": "@", "shouting": "!!", "english": "(?i)(^| )the ", "french": "(?i)(^| )les? ", "german": "(?i)(^| )und ", "spanish": "(?i)(^| )el "}

PAIRS = [("english", "french", " of ", " des "), ("german", "english", " nicht ", " of "), ("spanish", "french", " los ", " une ")]

FAMILIES = {"scope": ["the of", "of the"], "remedy": ["and the", "with the"], "ip": ["license", "licence"], "exit": ["that", "this"]}
SPAN_PATTERNS = {"numbers": r"[0-9]+", "capitals": "[A-Z]{3,}", "addresses": r"[A-Za-z0-9_]+@[A-Za-z0-9_]+\.[a-z]+"}


def normal_key():
    """The key of a text: lower case, runs of plain white space single, 16 digits of its SHA-1."""
    return F.substring(F.sha1(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[ \t\r\n]+", " ")))), 1, 16)
