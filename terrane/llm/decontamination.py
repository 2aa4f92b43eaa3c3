"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words, and has WINDOW - GRAM + 1 runs of GRAM
words. Of each window the smallest hash of such a run is kept, the first one on ties,
once for all windows in a row that choose it. Two windows of the same words choose the same
run, so every span of WINDOW shared words brings a kept hash of a document
together with one of the benchmark. Such a hit is extended: each window around
the run is compared with the benchmark's windows as text, so that a hash decides nothing. Items
of fewer words are one window each, and all runs of that many words ask for them.

Built-in functions only. A document's words are dealt out to rows inside the task
that reads it; rows without a kept hash of the benchmark end there.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table, written

WINDOW, GRAM = 10, 5
GRAMS = WINDOW - GRAM + 1
#: The words of a text: runs of what isn't ASCII without 0-9 and a-z, named by what they hold, as Java reads that ten times as fast.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none of a null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def hashed(rows: DataFrame) -> DataFrame:
    """rows (words ..) with arrays: hashes of the words, grams of each GRAM of them, and lows, the smallest of each window's
    grams. Texts of fewer words than a window have no grams and no lows."""
    many, n = F.size("words") >= WINDOW, F.size("words")
    none = F.array().cast("array<bigint>")
    run = lambda column, i, k: [F.get(column, i + j) for j in range(k)]
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("grams", F.when(many, F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*run("hashes", i, GRAM)))).otherwise(none))
    return rows.withColumn("lows", F.when(many, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.least(*run("grams", i, GRAMS)))).otherwise(none))


def _kept() -> Column:
    """Places of the windows that keep another gram than the window before, -1 before them."""
    new = lambda i: (i == 0) | (F.get("grams", i - 1) == F.get("lows", i - 1)) | (F.get("lows", i) < F.get("lows", i - 1))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - WINDOW), new)
    return F.concat(F.array(F.lit(-1)), F.when(F.size("words") >= WINDOW, places).otherwise(F.array().cast("array<int>")))


def _short(n: int, i: Column) -> Column:
    """The hash of a window of n words, fewer than WINDOW, at place i."""
    return F.xxhash64(F.lit(n), *(F.get("hashes", i + j) for j in range(n)))


def windows_of(items: DataFrame) -> DataFrame:
    """item_id, win (words with spaces between), n (words) and fp (the kept hash) of all windows of items (item_id, text)."""
    base = hashed(items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0))
    base = base.withColumn("n", F.least(F.size("words"), F.lit(WINDOW))).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))))
    fp = F.coalesce(*(F.when(F.col("n") == n, _short(n, F.lit(0))) for n in range(1, WINDOW)), F.get("lows", F.col("i")))
    return base.select("item_id", F.array_join(F.slice("words", F.col("i") + 1, F.col("n")), " ").alias("win"), "n", fp.alias("fp"))


def _covered(spans: str) -> Column:
    """How many whole numbers some intervals (start, end) cover together."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"].cast("long")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items for each row of docs (doc_id, text).

    n_hit counts the words within occurrences of windows of items (item_id,
    text), items are the ids that these windows belong to, as strings, sorted. Null and wordless
    texts have no words; items without words have no windows; an item without an
    id makes hits but isn't listed; rows of one item_id are one item. Repeated rows of docs are each a row of the
    result. No items, or no hits, leave n_hit 0. A document's list of items, and of places that are hit, is one value: the first grows
    with the benchmark, the second with the text.
    """
    every = written(windows_of(items).distinct())
    known = written(every.select("win", "n", "fp").distinct().withColumn("wid", F.monotonically_increasing_id()))
    asked = written(known.select("fp").distinct().withColumn("known", F.lit(True)))  # a file of known size: sent to all tasks only if it is small
    lengths = sorted(r.n for r in known.select("n").where(F.col("n") < WINDOW).distinct().collect())  # under WINDOW
    key = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), F.col("text").isNull(), F.col("doc_id").isNull(), "text", "doc_id").alias("k2")]
    rows = hashed(docs.select("doc_id", *key, words(F.col("text")).alias("words")))
    own = ["doc_id", "k1", "k2", F.size("words").alias("n_words")]
    # each document has one row besides, its head at -1, which brings its number of words; windows that keep one gram follow each other
    probes = rows.select(*own, "words", "lows", F.explode(_kept()).alias("i"))
    probes = probes.select("doc_id", "k1", "k2", "n_words", "i", F.lit(WINDOW).alias("n"), F.get("lows", F.col("i")).alias("fp"), F.slice("words", F.col("i") + F.when(F.col("i") < 0, 2).otherwise(1), WINDOW + GRAMS - 1).alias("near"))
    for n in lengths:
        runs = rows.where(F.size("words") >= n).select(*own, "words", "hashes", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("i"))
        probes = probes.unionByName(runs.select("doc_id", "k1", "k2", "n_words", "i", F.lit(n).alias("n"), _short(n, F.col("i")).alias("fp"), F.slice("words", F.col("i") + 1, n).alias("near")))
    found = probes.join(asked, "fp", "left").where("i < 0 or known")
    found = found.withColumn("start", F.explode(F.when(F.col("i") < 0, F.array("i")).otherwise(F.sequence("i", F.col("i") + F.size("near") - F.col("n")))))
    win = F.when(F.col("i") >= 0, F.array_join(F.slice("near", F.col("start") - F.col("i") + 1, F.col("n")), " "))
    hits = found.select("doc_id", "k1", "k2", "n_words", "start", (F.col("start") + F.col("n")).alias("end"), win.alias("win")).join(known.select("win", "wid"), "win", "left").where("start < 0 or wid is not null")
    whole = hits.groupBy("k1", "k2").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(F.col("start") < 0, 1).otherwise(0)).cast("int").alias("copies"),
        F.collect_set(F.when(F.col("start") >= 0, F.struct("start", "end"))).alias("spans"),
        F.collect_set("wid").alias("wids"),
    )
    whole = written(whole.select("k1", "k2", "doc_id", "n_words", "copies", _covered("spans").alias("n_hit"), "wids"))
    named = every.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "win").join(known.select("win", "wid"), "win").select("item", "wid").distinct()
    listed = whole.where(F.size("wids") > 0).select("k1", "k2", F.explode("wids").alias("wid")).join(named, "wid").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = whole.drop("wids").join(listed, ["k1", "k2"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    result = written(out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items"))
    released(every, known, asked, whole)
    return result


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents against all rows of benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS MATERIALIZED (SELECT DISTINCT n, win FROM v),
p AS (SELECT r, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) l WHERE len(w) >= l.n),
h AS MATERIALIZED (SELECT r, p.i, p.n, k.win FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM p) p JOIN k ON k.win = p.win AND k.n = p.n),
c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM (SELECT DISTINCT r, win FROM h) JOIN v USING (win) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
