"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a count made by built-in functions inside the row, so a text
is read once and nothing is shuffled. A rule compares two counts:
low * of <= count <= high * of, for texts of at least so many words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, within

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Common function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with is in it for on was as are this by from at or an not but "
    "der die das und ist nicht von zu mit den ein eine im auf für des dem sich als auch "
    "de la le les et un une du que en pour dans qui est sur pas au avec ne se "
    "el los las una y por con para es no su lo del al como más se"
).split()


class Rule(NamedTuple):
    name: str
    count: str
    of: str
    low: float
    high: float
    words: int = 0


#: Thresholds; each is a share or a mean of the two counts named.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols per word", "n_symbols", "n_words", 0.0, 0.25),
    Rule("exclamation marks per word", "n_exclaims", "n_words", 0.0, 0.5),
    Rule("words in capitals", "n_capitals", "n_words", 0.0, 0.5),
    Rule("words with a letter", "n_letters", "n_words", 0.55, 1.0),
    Rule("stop words", "n_stops", "n_words", 0.01, 0.9, 60),
    Rule("repeated lines", "n_dup_lines", "n_lines", 0.0, 0.45),
    Rule("lines with a bullet", "n_bullets", "n_lines", 0.0, 0.9, 60),
    Rule("lines that break off", "n_ellipses", "n_lines", 0.0, 0.5, 60),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_capitals", "n_letters", "n_stops", "n_lines", "n_dup_lines", "n_bullets", "n_ellipses", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _how_many(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def repeated_words(words: Column, length: int = 5) -> Column:
    """Words in windows of so many words that are found twice or more, the first included.

    Windows are told apart by 64 bit hashes. Only texts with a repeat sort their windows.
    """

    def covered(hashes: Column) -> Column:
        n = F.size(hashes)
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: ((j > 0) & (x["h"] == F.get(s, F.greatest(j - 1, F.lit(0)))["h"])) | ((j < n - 1) & (x["h"] == F.get(s, F.least(j + 1, n - 1))["h"])))
        places = F.sort_array(F.transform(let(order, twice), lambda x: x["i"]))
        total = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("sum"), F.lit(-length).alias("at")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(length), i - a["at"])).alias("sum"), i.alias("at")))["sum"]
        return let(places, total)

    def of(hashed: Column) -> Column:
        windows = F.transform(F.slice(hashed, 1, F.size(hashed) - (length - 1)), lambda _, i: F.xxhash64(*(F.get(hashed, i + k) for k in range(length))))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(words) < length, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of)).cast("long")


def measures(text: Column) -> Column:
    """A struct of MEASURES of a text, as longs; a null text is empty."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column, lines: Column, text: Column) -> Column:
        lower = lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))
        count = {
            "n_words": F.size(words).cast("long"),
            "word_chars": _without(text, SPACE).cast("long"),
            "n_symbols": (F.char_length(text) - _without(text, SYMBOLS)).cast("long"),
            "n_exclaims": (F.char_length(text) - _without(text, "!")).cast("long"),
            "n_capitals": _how_many(words, lambda w: (F.char_length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))),
            "n_letters": _how_many(words, lambda w: F.lower(w) != F.upper(w)),
            "n_stops": _how_many(words, lambda w: lower(w).isin(STOP_WORDS)),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_bullets": _how_many(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•")),
            "n_ellipses": _how_many(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")),
            "n_repeat_words": repeated_words(words),
        }
        return F.struct(*(count[k].alias(k) for k in MEASURES))

    words = lambda t: F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    return let(text, lambda t: let(words(t), lambda w: let(lines(t), lambda x: of(w, x, t))))


def verdict(count: Callable[[str], Column], rules: Sequence[Rule] = RULES) -> Column:
    """True if every rule of the table holds; a rule whose divisor is zero holds."""
    out = F.lit(True)
    for r in rules:
        num, den = count(r.count), count(r.of)
        out = out & ((count("n_words") < r.words) | ((num >= den * r.low) & (num <= den * r.high)))
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: a struct of MEASURES, base_failed and kept.

    base_failed: fewer than ten words, or over a fifth of them in repeated
    windows. kept: neither that nor a broken rule. Null and empty texts have no
    words and fail. Rows are judged one by one, so repeated rows, null ids and
    extra columns don't matter.
    """
    raw, name = within(docs.columns, "measured", "quality")
    measured = docs.withColumn(raw, measures(F.col("text")))
    count = lambda k: F.col(f"{raw}.{k}")
    failed = (count("n_words") < 10) | (100 * count("n_repeat_words") > 20 * count("n_words"))
    parts = [*(count(k).alias(k) for k in MEASURES), failed.alias("base_failed"), (~failed & verdict(count, rules)).alias("kept")]
    return measured.withColumn(name, F.struct(*parts)).drop(raw), name


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, q = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(f"{q}.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def sql(rules: Sequence[Rule] = RULES) -> str:
    """The same judgement in DuckDB's SQL, from the same tables of words and thresholds."""
    space = r"[\x20\x09-\x0D]"
    held = " AND ".join(["n_repeat_words * 5 <= n_words", "n_words >= 10", *(f"(n_words < {r.words} OR {r.count} BETWEEN {r.of} * {r.low}::DOUBLE AND {r.of} * {r.high}::DOUBLE)" for r in rules)])
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM p WHERE len(words) >= 5),
g AS (SELECT r, i, hash(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS h FROM w),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(5, i - before)) AS n FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 5) AS before FROM t) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{space}+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclaims,
    len(list_filter(words, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_capitals,
    len(list_filter(words, lambda x: lower(x) <> upper(x))) AS n_letters,
    len(list_filter(words, lambda x: rtrim(lower(x), '.,;:!?') IN ({stops}))) AS n_stops,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(lines, lambda x: ltrim(x)[1:1] IN ('-', '*', '•'))) AS n_bullets,
    len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipses,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM p LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {held} AS kept
FROM m
"""


OP5_SQL = sql()
