r"""Quality rules: a threshold table compiled into Spark columns (no user functions).

Every statistic is a built-in expression over the text or its array of words, so the
whole operator is a scan and projections: no shuffle, any size, any skew.

Defined cases: a null or blank text has no words, all counts 0, fails the base rule and
is not kept.  Repeated rows are judged one by one.  Other columns pass through unless
they bear the name of a result column, which then replaces them; inner columns take names that the caller's do not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "ist", "mit", "und", "von", "zu",
    "au", "avec", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pour", "que", "un", "une",
    "con", "el", "los", "las", "no", "para", "por", "se", "su", "y",
)

#: (statistic, least, most): null means no bound on that side.  Judged after the base rule.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 2.0, 20.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.01, None),
    ("dup_line_share", None, 0.4),
)
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_words(ws: Column, hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the same text, first occurrence included."""
    n = F.size(hashes)
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.array_compact(F.transform(s, lambda x, k: F.when(F.coalesce(same(x, k), F.get(s, k + 1)["h"] == x["h"]), x["i"]))))

    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(window), p - acc["last"])).alias("sum"))
    # a one-element array binds the sorted list once for the lambdas below
    count = F.transform(F.array(ordered), lambda s: F.aggregate(positions(s), start, step, lambda acc: acc["sum"]))[0]
    return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(count).cast("long")


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_stop_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\u000b\f\r", "")) > 0)
    ws, ls, win = fresh(docs.columns, "words", "lines", "windows")
    out = docs.withColumn(ws, words(text)).withColumn(ls, lines)
    n = F.size(ws)
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn(win, hashes)
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(body, " \t\n\u000b\f\r", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(ls).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": repeated_words(F.col(ws), F.col(win)),
            "n_stop_words": F.size(F.filter(ws, lambda w: w.isin(*STOP_WORDS))).cast("long"),
        }
    ).drop(ws, ls, win)


def verdict(thresholds=THRESHOLDS) -> Column:
    """One boolean column: every statistic of the table lies within its bounds."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    stats = {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
    }
    kept = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            kept = kept & (stats[name] >= least)
        if most is not None:
            kept = kept & (stats[name] <= most)
    return kept


def quality_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS, least_words: int = 20, most_repeat_percent: int = 30) -> DataFrame:
    """``docs`` with the base statistics, ``base_failed`` and ``kept``."""
    out = base_statistics(docs, text)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS s FROM pos),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup WHERE c > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(ws, lambda x: x IN ({_LIST}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 20.0 AND n_symbols / greatest(n_words, 1) <= 0.25
  AND n_stop_words / greatest(n_words, 1) >= 0.01 AND n_dup_lines / greatest(n_lines, 1) <= 0.4 AS kept FROM b
"""
