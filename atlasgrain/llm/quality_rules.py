"""Quality rules: a threshold table compiled into one Spark projection.

The table ``RULES`` names a feature with its least and greatest accepted value. ``quality_features`` adds the
features and ``quality_verdict`` turns the table into one boolean expression; nothing leaves the JVM and no row
moves between partitions, so the operator is one scan at any size.

Defined results: null text counts as empty; a text without words has all counts 0 and fails the base rule; repeated
rows each get their own verdict; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, words

#: feature, least, greatest; None: no bound.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.5, 11.0),
    ("symbol_ratio", None, 0.1),
    ("upper_ratio", None, 0.4),
    ("dup_line_ratio", None, 0.3),
    ("stop_ratio", 0.02, None),
]
MIN_WORDS = 50
STOP_WORDS = sorted(
    set(
        "the of and to in is that for it as with be on by this are was or an at le la de des les et en un une du que pour "
        "qui dans sur par der die und den von zu das mit ist im ein eine nicht auf auch el los y se por con las una es del no su".split()
    )
)
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _repeat_words(n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by a 64-bit hash of their words,
    sorted with their places, so the cost is n log n even for one very long text."""
    hashed = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]).alias("h"), i.alias("i"))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def starts(s: Column) -> Column:
        twin = lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
    # transform(array(x), f) binds x once; a plain lambda body would sort anew for each element
    return F.transform(F.array(F.sort_array(hashed)), lambda s: F.aggregate(starts(s), zero, step, lambda a: a["n"]))[0]


def quality_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, n_lines and n_upper (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.size("_w")
    lines = F.filter(F.split(body, "\n"), lambda x: F.rtrim(F.regexp_replace(x, "[\x09-\x0d]", " ")) != "")
    return (
        docs.withColumn("_w", words(F.col(text)))
        .withColumn("_l", lines)
        .withColumns(
            {
                "n_words": n.cast("long"),
                "word_chars": F.length(F.array_join("_w", "")).cast("long"),
                "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", ""))).cast("long"),
                "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
                "n_repeat_words": _repeat_words(n),
                "n_stop": F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
                "n_lines": F.size("_l").cast("long"),
                "n_upper": (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}", ""))).cast("long"),
            }
        )
        .drop("_w", "_l")
    )


_FEATURES = {
    "mean_word_chars": "word_chars * 1.0D / nullif(n_words, 0)",
    "symbol_ratio": "n_symbols * 1.0D / nullif(n_words, 0)",
    "upper_ratio": "n_upper * 1.0D / nullif(word_chars, 0)",
    "dup_line_ratio": "n_dup_lines * 1.0D / nullif(n_lines, 0)",
    "stop_ratio": "n_stop * 1.0D / nullif(n_words, 0)",
}


def rule_expressions(rules: list[tuple[str, float | None, float | None]] = RULES, suffix: str = "D") -> str:
    """The table as one SQL condition; ``suffix`` marks double literals ('D' for Spark, '' for other engines)."""
    parts = []
    for feature, low, high in rules:
        x = _FEATURES[feature].replace("1.0D", f"1.0{suffix}" if suffix else "1.0::DOUBLE")
        parts += [f"{x} >= {low!r}{suffix}"] * (low is not None) + [f"{x} <= {high!r}{suffix}"] * (high is not None)
    return " AND ".join(f"({p})" for p in parts) or "true"


def quality_verdict(docs: DataFrame, text: str = "text", rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """Features with ``base_failed`` (under 50 words, or over half of them in repeated 3-word windows) and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.coalesce(F.expr(rule_expressions(rules)), F.lit(False))
    return quality_features(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    plain = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in plain.items()])
    # the row number keeps the condition above the projection; pushed below, it would compute the counts anew for each use
    kept = quality_verdict(renamed, plain["text"]).withColumn("_row", F.monotonically_increasing_id()).where("kept AND _row >= 0")
    return kept.select(*[F.col(a).alias(c) for c, a in plain.items()])


ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM d, (VALUES (0), (1), (2)) s(o) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop,
        (length(body) - length(regexp_replace(body, '\\p{{Lu}}', '', 'g'))) AS n_upper
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {rule_expressions(suffix="")} END AS kept FROM b
"""


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality_verdict(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
