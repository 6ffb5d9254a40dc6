"""Text and path functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEGATION = r"\b(never|do not|don't|without)\b"
DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def positive_tokens(text: Column) -> Column:
    """The same, with all that follows the first negation left out."""
    return tokens(F.regexp_replace(F.lower(text), f"(?s){NEGATION}.*$", ""))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$") & (F.length(text) <= 64)


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def path_problem(path: Column) -> Column:
    """Why a relative POSIX path is not portable; null if it is."""
    parts = F.split(path, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.startswith("/") | path.rlike("^[A-Za-z]:"), "absolute")
        .when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "control")
        .when(F.exists(parts, lambda p: p.isin("", ".", "..")), "segment")
        .when(F.exists(parts, lambda p: p.rlike(DEVICES)), "device")
        .when(F.exists(parts, lambda p: p.rlike(r"[. ]$")), "ending")
    )


def first_word_sets(found: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Names of the rules of which any word is among the tokens, in the rules' order."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(found, F.array(*map(F.lit, words))), F.lit(name)) for name, words in rules]))
