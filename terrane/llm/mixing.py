"""Mixing sources to target weights with hash-threshold histograms.

A document's place is a hash of it. Of each source, whole repeats of all
documents are taken as often as they fit in the target, and of the rest the
documents whose place lies under a threshold. The threshold is found without
sorting documents: words are summed by source and bucket of the place, the
bucket that crosses the budget is dealt into finer buckets, and so on for three
levels of 4096; only documents of that bucket are summed again. Documents that
share the last place, equal rows as a rule, are counted, and as many are taken as come nearest.
Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, within, written

WEIGHTS, MOST = (5, 2, 1), 3
DIGITS, LEVELS = 3, 3
#: Up to so many sources, their thresholds are sent to every task; beyond, they are joined.
SENT_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """A number of LEVELS * DIGITS hex digits that depends on the document's id and text alone."""
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, LEVELS * DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """src, none (no source), source_size and target for each source of sizes (src, none, source_size).

    Weights go to sources by code point, null last. All sources share the sum of
    sizes by weight; none gets over `most` times its size, and what is over is
    shared again among the others. One row a source: filled by level, sources
    that stop soonest first.
    """
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("none", "src")) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("long")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "none", "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("gone", F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.col("spent")) / (F.sum("w").over(every) - F.col("gone")))
    rows = rows.withColumn("open", F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("at"), "none", "src", "level"))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce("open", F.lit(float(most) * 2**53)))
    return rows.select("src", "none", "source_size", target.alias("target"))


def _attach(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return docs.join(F.broadcast(sources) if few else sources, ["src", "none"])


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, str]:
    """docs with one more column, whose name is returned: a struct of size, source_size, target, copies and taken.

    taken = copies * size: the whole repeats, and one more if the document's
    place lies under its source's threshold. The source's words then differ
    from its target by at most half a document. No row is taken more than `most` times. Null texts have size 0; a null
    source is a source. Rows that agree in id and text share a place; where the threshold falls on it, some of them are
    taken once more, in the order of their columns. Other columns are kept as they are.
    """
    src, none, at, size, turn, q = within(docs.columns, "src", "none", "place", "size", "turn", "mixed")
    full = docs.withColumn(src, F.coalesce("source", F.lit(""))).withColumn(none, F.col("source").isNull())
    full = full.withColumn(size, n_words(F.col("text"))).withColumn(at, place(F.col("doc_id"), F.col("text")))
    sized = written(full.select(F.col(src).alias("src"), F.col(none).alias("none"), F.col(at).alias("place"), F.col(size).alias("size")))
    sums = written(sized.groupBy("src", "none").agg(F.sum("size").alias("source_size")))
    few = sums.count() <= SENT_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets(sums, weights, most).withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    running = Window.partitionBy("src", "none").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(LEVELS):
        # the documents of the bucket that the last level ended in, dealt into finer ones
        shift = 4 * DIGITS * (LEVELS - 1 - level)
        inside = _attach(sized, state.select("src", "none", "prefix"), few).withColumn("b", F.shiftright("place", shift))
        inside = inside.where(F.shiftright("b", 4 * DIGITS) == F.col("prefix")) if level else inside
        before = state.select("src", "none", "source_size", "target", "whole", "budget")
        bars = inside.groupBy("src", "none", "b").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("m")).withColumn("sum", F.sum("words").over(running))
        crossing = bars.join(F.broadcast(before) if few else before, ["src", "none"]).where((F.col("sum") > F.col("budget")) & (F.col("sum") - F.col("words") <= F.col("budget")))
        left = F.col("budget") - (F.col("sum") - F.col("words"))
        state = written(crossing.select("src", "none", "source_size", "target", "whole", left.alias("budget"), F.col("b").alias("prefix"), F.col("words").alias("edge_words"), F.col("m").alias("edge_m")))
    # of the m documents at the last place, those that make up what is left, to the nearest whole one
    share = F.col("budget") * F.col("edge_m") / F.col("edge_words")
    more = (F.floor(share) + F.when(share - F.floor(share) > 0.5, 1).otherwise(0)).cast("long")
    state = written(state.withColumn("more", more).select("src", "none", "target", "whole", F.when(F.col("more") == F.col("edge_m"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("limit"), F.when(F.col("more") == F.col("edge_m"), 0).otherwise(F.col("more")).alias("more")))
    limits = sums.join(state, ["src", "none"], "left")
    limits = limits.select(F.col("src").alias(src), F.col("none").alias(none), F.struct("source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("limit", F.lit(0)).alias("limit"), F.coalesce("more", F.lit(0)).alias("more")).alias(q))
    joined = full.join(F.broadcast(limits) if few else limits, [src, none])
    under = (F.col(at) < F.col(f"{q}.limit")).cast("int")
    if not state.where("more > 0").isEmpty():
        # equal rows are one row while they are shared out, and only those at a threshold are
        split = (F.col(at) == F.col(f"{q}.limit")) & (F.col(f"{q}.more") > 0)
        ties = joined.where(split).groupBy(*docs.columns, src, none, at, size).agg(F.count(F.lit(1)).alias("m"), F.first(q).alias("q"))
        upto = F.sum("m").over(Window.partitionBy(src, none).orderBy(size, "doc_id", F.md5("text"), *docs.columns).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ties = ties.withColumn("own", F.greatest(F.lit(0), F.least(F.col("m"), F.col("q.more") - (upto - F.col("m")))))
        ties = ties.select(*docs.columns, src, none, at, size, F.col("q").alias(q), F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("m")), lambda k: (k <= F.col("own")).cast("int"))).alias(turn))
        joined = joined.where(~split).withColumn(turn, under).unionByName(ties)
    else:
        joined = joined.withColumn(turn, under)
    copies = F.least(F.col(f"{q}.whole") + F.col(turn), F.lit(most))
    found = F.struct(F.col(size).alias("size"), F.col(f"{q}.source_size").alias("source_size"), F.col(f"{q}.target").alias("target"), copies.alias("copies"), (copies * F.col(size)).alias("taken"))
    return joined.withColumn(q, found).select(*docs.columns, q), q


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, q = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", *(F.col(f"{q}.{k}").alias(k) for k in ("size", "source_size", "target", "taken")))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 9))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * (SELECT arg_min(level, (cap / w)) FROM f WHERE cap > w * level)) AS target FROM f),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT source, place, sum(size)::BIGINT AS words, count(*) AS m FROM d GROUP BY source, place),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM b),
l AS (
  SELECT c.source, place AS edge, (budget - (upto - words)) * m / words AS share
  FROM c JOIN (SELECT *, target - whole * source_size AS budget FROM k) k ON c.source IS NOT DISTINCT FROM k.source
  WHERE upto > budget AND upto - words <= budget),
n AS (SELECT *, row_number() OVER (PARTITION BY source, place ORDER BY size) AS nth FROM d)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN place < edge OR place = edge AND nth <= floor(share) + CASE WHEN share - floor(share) > 0.5 THEN 1 ELSE 0 END THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n JOIN k ON n.source IS NOT DISTINCT FROM k.source LEFT JOIN l ON n.source IS NOT DISTINCT FROM l.source
"""
