"""Quality rules: a table of thresholds compiled into one Spark projection.

Words are runs of anything but ``\\x20`` and ``\\x09-\\x0D``. Every statistic is a
built-in expression on the row's own text, so the job is one map over the scan: no
shuffle, no Python, and any key may hold any share of the rows.

Defined results: a null or empty text has no words and fails the base rule. Repeated
rows are judged alike. ``judge`` replaces columns of the input that clash with the
statistics' names, ``keep`` changes no column. An empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it on with as are was be by this from at or an a not which have "
    "der die das und ist von mit zu den ein eine auf nicht auch für sich dem des im es sie er wird "
    "le la les de du et un une en est que qui dans pour pas sur par au avec elle il ce "
    "el los las y del que en un una por con para no se su al lo como más es"
).split()


class Rule(NamedTuple):
    """Reject where ``100 * numerator`` is below ``low`` or above ``high`` times ``denominator`` (None: no bound)."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The verdict beyond the base rule. Ratios are whole percentages, so both engines decide alike.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=250, high=1000),
    Rule("symbols", "n_symbols", "word_chars", high=3),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=40),
)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(hashes: Column) -> Column:
    """Words inside 3-word windows whose hash is found twice or more; ``hashes`` has one entry for each window."""

    def positions(s: Column) -> Column:
        twin = lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])
        marked = F.transform(s, lambda e, k: F.when(F.coalesce(twin(e, k), F.lit(False)), e["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("c"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["c"] + F.least(F.lit(3), i - a["last"])).alias("c"), i.alias("last"))
        return F.aggregate(p, start, step, lambda a: a["c"])

    indexed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(indexed, lambda s: let(positions(s), covered)))


def text_statistics(docs: DataFrame, text: str = "text", more: bool = False) -> DataFrame:
    """``docs`` with the long columns that rules name: words, lines, symbols and repetitions of the whole text. ``more``: kinds of characters too."""
    whole = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0
    base = docs.withColumns({"_words": F.array_remove(F.split(whole, SPACE), ""), "_lines": F.filter(F.split(whole, "\n"), has_word)})
    n = F.size("_words")
    base = base.withColumn(
        "_windows",
        F.transform(F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))),
    )
    counts = {
        "n_words": n,
        "word_chars": F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w)),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_window_words(F.col("_windows")),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
    }
    if more:
        without = lambda chars: F.length(whole) - F.length(F.translate(whole, chars, ""))
        counts |= {
            "n_distinct_words": F.size(F.array_distinct("_words")),
            "n_upper": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "n_digits": without("0123456789"),
            "n_marks": without("!?|"),
            "n_stops": without(".,"),
        }
    return base.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_words", "_lines", "_windows")


def verdicts(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that reject the row, in the table's order."""

    def rejects(r: Rule) -> Column:
        a, b = F.lit(100) * F.col(r.numerator), F.col(r.denominator)
        bounds = ([a < F.lit(r.low) * b] if r.low is not None else []) + ([a > F.lit(r.high) * b] if r.high is not None else [])
        return bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]

    return F.filter(F.array(*[F.when(rejects(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its statistics, ``base_failed``, ``failed_rules`` and ``kept``."""
    base_failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    out = text_statistics(docs, text).withColumns({"base_failed": base_failed, "failed_rules": verdicts(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they are, whatever their names.

    Spark would push the filter below the statistics and write out each of them wherever the verdict
    names it; a row number in the same projection holds the filter above, so each is computed once.
    """
    rows = docs.select(F.struct(*["`" + c.replace("`", "``") + "`" for c in docs.columns]).alias("_row"), F.col("text"))
    judged = judge(rows).withColumn("_id", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_id") >= 0)).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _rule_sql(r: Rule) -> str:
    bounds = ([f"100 * {r.numerator} < {r.low} * {r.denominator}"] if r.low is not None else []) + ([f"100 * {r.numerator} > {r.high} * {r.denominator}"] if r.high is not None else [])
    return "(" + " OR ".join(bounds) + ")"


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: CTEs from a table ``docs`` (doc_id, text) to ``judged``.
JUDGED_SQL = f"""
parts AS (
  SELECT doc_id, coalesce(text, '') AS whole,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM docs),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM parts)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
stats AS (
  SELECT p.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(whole) - length(translate(whole, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop_words
  FROM parts p LEFT JOIN repeats r ON r.doc_id = p.doc_id),
judged AS (
  SELECT *, base_failed IS FALSE AND NOT ({" OR ".join(map(_rule_sql, RULES))}) AS kept
  FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats))"""

ORACLE_SQL = f"""WITH docs AS (SELECT doc_id, text FROM documents), {JUDGED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
