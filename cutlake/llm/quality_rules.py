"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm.common import read

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by an this or from at not have "
    "der die das und zu den von mit ist auf für ein eine nicht sich dem des im "
    "le la les de et en un une que pour dans est du au par sur ne pas il "
    "el los las del y por con para se su al lo como es no"
).split()
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

# The threshold table: a text goes if count (comparison) bound * base. ``one`` is 1.
RULES: tuple[tuple[str, str, float, str], ...] = (
    ("n_symbols", ">", 0.3, "n_words"),
    ("word_chars", "<", 1.5, "n_words"),
    ("word_chars", ">", 25.0, "n_words"),
    ("n_dup_lines", ">", 0.5, "n_lines"),
    ("n_bullet_lines", ">", 0.9, "n_lines"),
    ("n_ellipsis_lines", ">", 0.5, "n_lines"),
    ("n_stop_words", "<", 1.0, "one"),
)


def words_of(text: Column) -> Column:
    """The runs of characters between blanks (space, tab to carriage return)."""
    spaced = reduce(lambda held, blank: F.replace(held, F.lit(blank), F.lit(" ")), BLANKS, text)
    return F.array_remove(F.split(spaced, " "), "")


def _measured(docs: DataFrame) -> DataFrame:
    """The given columns as a struct ``row``, and beside it one column per measure.

    Each step is a projection of its own only where a value is used more than once; none of
    them shuffles or leaves the JVM.
    """
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    step = docs.select(row.alias("row")).select("row", F.coalesce("row.text", F.lit("")).alias("text"))
    step = step.select("row", "text", words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window))
    plain = reduce(lambda held, symbol: F.replace(held, F.lit(symbol), F.lit("")), SYMBOLS, F.col("text"))
    step = step.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(plain)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•|]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.array_intersect("words", F.lit(STOP_WORDS))).cast("long").alias("n_stop_words"),
        hashes.alias("hashes"),
    )
    # Sort windows by hash and place where any two are equal; most texts have none and stop here.
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    placed = F.sort_array(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.select("*", F.when(repeats, placed).alias("placed")).drop("hashes")
    alike = lambda x, k: (x["h"] == F.get("placed", k - 1)["h"]) | F.coalesce(x["h"] == F.get("placed", k + 1)["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("placed", lambda x, k: F.coalesce(alike(x, k), F.lit(False))), lambda x: x["i"]))
    step = step.select("*", starts.alias("starts")).drop("placed")
    # Each marked window counts its words up to the next marked one.
    covered = F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return step.select("*", F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words")).drop("starts")


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _rejected(rules: Iterable[tuple[str, str, float, str]]) -> Column:
    """The threshold table as one condition."""
    found = F.lit(False)
    for count, comparison, bound, base in rules:
        limit = F.lit(float(bound)) * (F.lit(1) if base == "one" else F.col(base))
        found = found | (F.col(count) > limit if comparison == ">" else F.col(count) < limit)
    return found


def quality(docs: DataFrame, rules: Iterable[tuple[str, str, float, str]] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row.

    A null text counts as empty: no words, so base_failed. Repeated rows and null ids stay
    as they are; other columns are not read.
    """
    measured = _measured(docs.select("doc_id", "text")).withColumn("base_failed", _base_failed())
    return measured.select("row.doc_id", *[c for c in measured.columns if c != "row"], (~F.col("base_failed") & ~_rejected(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: Iterable[tuple[str, str, float, str]] = RULES) -> DataFrame:
    """The rows that pass, with all their columns, whatever these are called."""
    kept = F.when(~_base_failed() & ~_rejected(rules), F.array("row"))
    # Exploded, not filtered: a filter would move below the projections and repeat their work.
    return _measured(docs).select(F.explode_outer(kept).alias("row")).where(F.col("row").isNotNull()).select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    found = quality(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_rule(count: str, comparison: str, bound: float, base: str) -> str:
    return f"{count} {comparison} CAST({bound} AS DOUBLE) * {'1' if base == 'one' else base}"


_STOPS = ", ".join(f"'{word}'" for word in sorted(set(STOP_WORDS)))
_BLANK = r"[\x20\x09-\x0D]"


def sql_ctes(table: str) -> str:
    """CTEs whose last, ``quality``, has the columns of ``quality()`` for a table with doc_id and text."""
    return rf"""
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
windows AS (SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS g
        FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})),
marked AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after FROM marked) GROUP BY rid),
m AS (SELECT rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^{_BLANK}*[-*•|]'))) AS BIGINT) AS n_bullet_lines,
        CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){_BLANK}*$'))) AS BIGINT) AS n_ellipsis_lines,
        CAST(len(list_intersect(list_distinct(words), [{_STOPS}])) AS BIGINT) AS n_stop_words FROM w),
b AS (SELECT m.*, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
quality AS (SELECT *, NOT base_failed AND NOT ({' OR '.join(_sql_rule(*rule) for rule in RULES)}) AS kept FROM f)"""


SQL = f"""
WITH {sql_ctes('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM quality
"""
