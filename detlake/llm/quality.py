"""Quality rules: one projection compiled from a table of thresholds.

Every rule is a ratio of counts that one projection over the text yields: lengths,
symbols, stop words, lines, repeated three-word windows. No user function and no
shuffle: a document is judged where it is read.

Repeated windows are found without comparing all pairs: each window becomes one long
that holds its hash above its position, the longs are sorted, and equal windows are
then neighbours. Neighbours are compared by their full 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detlake.llm.common import whole_text, words_of

# Frequent function words of the four languages of the tables.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "are", "this", "at", "from", "or", "an",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "er", "es",
    "de", "la", "le", "et", "les", "est", "pour", "dans", "qui", "une", "un", "du", "au", "sur", "par", "que", "avec", "plus",
    "el", "en", "y", "los", "se", "del", "las", "por", "con", "no", "su", "para", "lo", "una", "al",
]

# Characters that count as symbols, and marks of shouting.
SYMBOLS = r"[#*$%&|<>]"
SHOUTS = r"[!?]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``low <= scale * numerator / denominator <= high``; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The table of thresholds. Ratios are taken per word, per letter or per line.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=1.5, high=14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("shouts_per_word", "n_shouts", "n_words", high=0.2),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("words_with_letter", "n_letter_words", "n_words", low=0.7),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.4),
)


def _window_hash(words: Column, position: Column) -> Column:
    at = position.cast("int")
    return F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))


def text_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one struct column ``measures``; all are longs.

    Null text counts as empty: every measure is zero. Other columns pass unchanged.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(F.struct(*kept).alias("row"), whole_text(f"`{text}`").alias("t"))
    step = step.select("row", "t", words_of(F.col("t")).alias("w"))
    bits = F.ceil(F.log2(F.size("w") + F.lit(1))).cast("int")
    step = step.select("row", "t", "w", F.call_function("shiftleft", F.lit(-1).cast("long"), bits).alias("_high"))
    w = F.col("w")
    packed = F.transform(
        w,
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
        .bitwiseAND(F.col("_high"))
        .bitwiseOR(i.cast("long")),
    )
    step = step.select(
        "row",
        "t",
        "w",
        "_high",
        F.sort_array(F.slice(packed, 1, F.greatest(F.size("w") - 2, F.lit(0)))).alias("s"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    s, high, low = F.col("s"), F.col("_high"), F.bitwise_not(F.col("_high"))

    def same(x: Column, y: Column) -> Column:
        """Equal windows: equal kept hash bits first, the full hashes only then."""
        return F.when(
            x.bitwiseXOR(y).bitwiseAND(high) == 0,
            _window_hash(w, x.bitwiseAND(low)) == _window_hash(w, y.bitwiseAND(low)),
        ).otherwise(False)

    repeats = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
    covered = F.flatten(
        F.transform(
            repeats,
            lambda x: F.array(x.bitwiseAND(low), x.bitwiseAND(low) + 1, x.bitwiseAND(low) + 2),
        )
    )
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, "")),
        "n_shouts": F.length("t") - F.length(F.regexp_replace("t", SHOUTS, "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.size(F.array_distinct(covered)),
        "n_stop_words": F.size("w") - F.size(F.filter("w", lambda x: ~F.lower(x).isin(STOP_WORDS))),
        "n_letter_words": F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))),
    }
    # A generator of one row: a later filter on a measure is then not pushed below it, where
    # it would evaluate the arrays again for every field it names.
    measures = F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])
    return step.select("row", F.explode(F.array(measures)).alias("measures")).select(
        "row.*", "measures"
    )


def rule_passes(rule: Rule, measures: str = "measures") -> Column:
    ratio = F.try_divide(F.col(f"{measures}.{rule.numerator}"), F.col(f"{measures}.{rule.denominator}"))
    held = F.lit(True)
    if rule.low is not None:
        held = held & (ratio >= F.lit(rule.low))
    if rule.high is not None:
        held = held & (ratio <= F.lit(rule.high))
    return F.coalesce(held, F.lit(True))


def base_failed(measures: str = "measures") -> Column:
    n = F.col(f"{measures}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{measures}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with ``measures``, ``base_failed``, ``broken`` (names of broken rules) and ``kept``.

    Null or empty text has no words and fails the length rule. Columns of ``df`` that bear
    one of these four names are replaced. Repeated rows are judged alike, an empty table
    gives an empty table, and texts are read whole however long.
    """
    own = ("measures", "base_failed", "broken", "kept")
    rest = df.drop(*[c for c in df.columns if c.lower() in own and c != text])
    broken = F.filter(
        F.array(*[F.when(~rule_passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    judged = text_measures(rest, text).withColumns(
        {"base_failed": base_failed(), "broken": broken if rules else F.array().cast("array<string>")}
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_rules(docs).select(
        "doc_id", *[F.col(f"measures.{n}").alias(n) for n in names], "base_failed", "kept"
    )


def _rule_sql(rule: Rule) -> str:
    ratio = f"{rule.numerator} / nullif({rule.denominator}, 0)"
    bounds = [f"{ratio} {sign} {bound}" for sign, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None]
    return f"coalesce({' AND '.join(bounds)}, TRUE)"


_STOPS_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)),
  lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, u.i, w[u.i] || ' ' || w[u.i + 1] || ' ' || w[u.i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) AS z(k) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
  length(t) - length(regexp_replace(t, '{SHOUTS}', '', 'g')) AS n_shouts, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS_SQL}))) AS n_stop_words,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words FROM w LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(map(_rule_sql, RULES))} AS kept FROM b
"""
