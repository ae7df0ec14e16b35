"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

All counts are whole numbers and all rules compare whole numbers, so no rounding decides a row.
3-word windows are compared by a 64-bit hash of their words' 64-bit hashes.

Rows: a null text has no words (all counts 0) and fails; so does an empty one. Repeated doc_ids are
judged row by row, a null doc_id passes through, an empty table gives no rows, and other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwarden.llm.quality_model import STOP_WORDS
from graphwarden.llm.textbatch import id_text

#: Fixed values of the counts.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: (rule, column, least or None, most or None, per): column must be within the bounds, each times `per` of PER / 100.
RULES = (
    ("word_length_low", "word_chars", 250, None, "n_words"),
    ("word_length_high", "word_chars", None, 1200, "n_words"),
    ("symbols", "n_symbols", None, 20, "n_words"),
    ("stop_words", "n_stops", 3, None, "n_words"),
    ("repeated_lines", "n_dup_lines", None, 30, "n_lines"),
)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _from(array: Column, at: int) -> Column:
    """The array from its element number `at` on."""
    return F.slice(array, at, F.greatest(F.size(array) - (at - 1), F.lit(0)))


def _covered(hashes: Column) -> Column:
    """Words in 3-word windows that occur twice or more; hashes: of the windows, in order."""

    def some(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def among(p):
            again = F.transform(p, lambda v, j: F.when((F.get(p, j - 1)["x"] == v["x"]) | (F.get(p, j + 1)["x"] == v["x"]), v["i"]))
            at = F.array_sort(F.filter(again, lambda v: v.isNotNull()))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
            return F.aggregate(at, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])

        return let(pairs, among)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(some(h)))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    stops = F.filter(F.col("w"), lambda x: F.lower(x).isin(STOP_WORDS))
    hashes = F.transform("w", lambda x: F.xxhash64(x))

    def both(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    windows = let(hashes, lambda h: F.slice(F.zip_with(F.zip_with(h, _from(h, 2), both), _from(h, 3), both), 1, F.greatest(F.size(h) - 2, F.lit(0))))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
    first = id_text(docs).select(
        "doc_id",
        words.alias("w"),
        (F.size(F.split(text, f"[{SYMBOLS}]", -1)) - 1).cast("bigint").alias("n_symbols"),
        line_counts.alias("l"),
    )
    return first.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        _covered(windows).alias("n_repeat_words"),
        F.size(stops).cast("bigint").alias("n_stops"),
        F.col("l.n").alias("n_lines"),
    )


def verdict() -> Column:
    """The rules as one expression over the counts: true if all hold."""
    out = F.lit(True)
    for _, column, least, most, per in RULES:
        if least is not None:
            out = out & (100 * F.col(column) >= least * F.col(per))
        if most is not None:
            out = out & (100 * F.col(column) <= most * F.col(per))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed and kept of each document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts(docs).withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict()))


def oracle() -> str:
    """The same rows in DuckDB."""
    word = r"[^\x20\x09-\x0D]+"
    stops = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    rules = " AND ".join([f"100 * {c} >= {lo} * {per}" for _, c, lo, _, per in RULES if lo is not None] + [f"100 * {c} <= {hi} * {per}" for _, c, _, hi, per in RULES if hi is not None])
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '{word}') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l
  FROM d
), win AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) AS o(j) GROUP BY k
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stops,
         CAST(len(l) AS BIGINT) AS n_lines
  FROM w LEFT JOIN covered USING (k)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {rules} AS kept
FROM counts"""
