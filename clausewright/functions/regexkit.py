"""One place for the regular-expression dialect.

``rx(p)`` makes ``\\s \\w \\b`` Unicode-aware, as document text needs; ``unicode=False``
leaves the plain pattern, the form that other SQL engines share.
"""

from __future__ import annotations

import re


def rx(pattern: str, *, unicode: bool = True, ignore_case: bool = False, dot_all: bool = False) -> str:
    """The pattern with its flags in front."""
    flags = ("U" if unicode else "") + ("i" if ignore_case else "") + ("s" if dot_all else "")
    return f"(?{flags}){pattern}" if flags else pattern


def any_of(words: list[str] | tuple[str, ...], *, whole: bool = True) -> str:
    """A pattern for any of some literal phrases, on word borders if ``whole``."""
    body = "|".join(re.escape(w).replace("\\ ", "\\s+") for w in sorted(words, key=len, reverse=True))
    return f"\\b(?:{body})\\b" if whole else f"(?:{body})"


def checked(pattern: str) -> str:
    """The pattern, if it compiles; the rule tables are checked with this when they are loaded."""
    re.compile(pattern.replace("(?U)", "").replace("(?Ui)", "(?i)"))
    return pattern
