"""A trie of conversation prefixes on composable fingerprints.

A turn is an element (two numbers of 62 bits, in four lanes modulo a prime); a
sequence of turns is the sum of its elements, each times the lane's base to the power of its
place. Such sums form a monoid: a sequence put behind another one is multiplied
by a power of the base and added. A rebuilt conversation, the head of one and
the rest of another, is never made: the fingerprint of each of its prefixes comes
from the running sums of the two stored conversations. Rows hold such sums,
numbers of stored turns and counts; texts stay where they are.

Equal fingerprints at a depth are a node. That they are one sequence is verified by
references: all members' last turns must be of one class, and their
prefixes one shorter of one node; a class is turns of one hash, and where it has
several stored turns their texts are compared. Should any of that fail, all is
done again under another salt.

What is summed over subtrees needs no walk. A node's members are the conversations
that begin with it, and each node of its subtree belongs to the smallest member
of its own, which is one of these. So a subtree's sum is the sum over members
of what each has of its own below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, table, written

#: Lanes of a fingerprint: a prime and the bases of its powers.
PRIME, BASES = (1 << 31) - 1, (1103515245, 747796405, 1597334677, 2014566391)
LANES = len(BASES)
#: Conversations that share the head of one, turns that such a head may have at most less one, places that are summed by one task.
FAMILY, HEADS, BLOCK = 20, 4, 256
_S, _T = [f"s{k}" for k in range(LANES)], [f"t{k}" for k in range(LANES)]


def running(df: DataFrame, key: str, block: Column, order: Sequence[Column | str], sums: dict[str, str], back: bool = False) -> DataFrame:
    """df with running sums (name: column) within each key, in the order given, itself included; back: from the end.

    Blocks of rows are summed by themselves, and then the blocks of a key, so
    that a key of very many rows isn't one task. block is a long that grows with the order, null first."""
    df = df.withColumn("blk", F.coalesce(block.cast("long"), F.lit(-(1 << 62))))
    totals = df.groupBy(key, "blk").agg(*(F.sum(c).alias(f"all_{n}") for n, c in sums.items()))
    by_block = Window.partitionBy(key).orderBy(F.col("blk").desc() if back else F.col("blk")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "blk", *(F.coalesce(F.sum(f"all_{n}").over(by_block), F.lit(0)).alias(f"before_{n}") for n in sums))
    inside = Window.partitionBy(key, "blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.select("*", *(F.sum(c).over(inside).alias(f"in_{n}") for n, c in sums.items())).join(before, [key, "blk"])
    return rows.select(*(c for c in df.columns if c != "blk" and c not in sums), *((F.col(f"in_{n}") + F.col(f"before_{n}")).alias(n) for n in sums))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _powers(base: int, e: np.ndarray) -> np.ndarray:
    """base to each of some powers, modulo the prime."""
    out, b, e = np.ones(len(e), np.uint64), base % PRIME, e.copy()
    while e.any():
        out = np.where(e & 1, out * np.uint64(b) % np.uint64(PRIME), out)
        b, e = b * b % PRIME, e >> 1
    return out


def _elements(columns: Sequence[str]):
    """Of (ka, kb, pos ..): the same and t0 .., each lane's element times its base to the power of pos."""

    def run(batches):
        for batch in batches:
            ka, kb, pos = (batch.column(c).to_numpy() for c in ("ka", "kb", "pos"))
            lanes = [x.view(np.uint64) >> np.uint64(s) & np.uint64((1 << 31) - 1) for x in (ka, kb) for s in (0, 32)]
            t = [x % np.uint64(PRIME) * _powers(b, pos) % np.uint64(PRIME) for x, b in zip(lanes, BASES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x.astype(np.int64)) for x in t)], [*columns, *_T])

    return run


def _numbered(rows: DataFrame, salt: int) -> DataFrame:
    """conv_id, pos (from 1), ka, kb (a turn's hash), words and its element times base^pos, of rows (conv_id, turn, role, text) without nulls in role and text."""
    sha = F.sha2(F.concat(F.lit(f"{salt}:"), F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    part = lambda i: F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long")
    base = rows.select("conv_id", "turn", part(0).alias("ka"), part(1).alias("kb"), n_words(F.col("text")).alias("words"))
    # equal rows are counted before they are numbered; turns of one number are put into the order of their texts
    base = written(base.groupBy("conv_id", "turn", "ka", "kb").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("m")))
    turn = F.coalesce("turn", F.lit(0))
    tied = base.groupBy("conv_id", F.col("turn").isNull().alias("none"), turn.alias("at")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    texts = rows.join(tied, (rows.conv_id == tied.conv_id) & (F.col("turn").isNull() == tied.none) & (turn == tied["at"]), "left_semi").select("conv_id", "turn", part(0).alias("ka"), part(1).alias("kb"), "role", "text").distinct()
    ranks = texts.select("conv_id", F.col("turn").isNull().alias("none"), turn.alias("at"), "ka", "kb", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("nth"))
    base = base.withColumn("none", F.col("turn").isNull()).withColumn("at", turn).join(ranks, ["conv_id", "none", "at", "ka", "kb"], "left")
    base = base.withColumn("nth", F.coalesce("nth", F.lit(0)))
    placed = running(base.drop("none", "at"), "conv_id", F.floor(F.col("turn") / BLOCK), [F.col("turn").asc_nulls_first(), F.col("nth"), F.col("ka"), F.col("kb")], {"end": "m"})
    placed = placed.select("conv_id", "ka", "kb", "words", F.explode(F.sequence(F.col("end") - F.col("m") + 1, F.col("end"))).alias("pos"))
    columns = ["conv_id", "pos", "ka", "kb", "words"]
    return placed.select(*columns).mapInArrow(_elements(columns), ", ".join(f"{c} long" for c in (*columns, *_T)))


def _one_text_a_key(rows: DataFrame, salt: int, turns: DataFrame) -> bool:
    """Whether turns of one hash are of one role and text; those of a hash that one stored turn has needn't be read."""
    sha = F.sha2(F.concat(F.lit(f"{salt}:"), F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    part = lambda i: F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("long")
    shared = turns.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ka", "kb")
    both = F.struct("role", "text")
    seen = rows.select(part(0).alias("ka"), part(1).alias("kb"), "role", "text").join(shared, ["ka", "kb"], "left_semi").groupBy("ka", "kb").agg(F.min(both).alias("lo"), F.max(both).alias("hi"))
    return seen.where("lo <> hi").isEmpty()


def _members(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, last (depth of the whole), fa, fb, pa, pb (fingerprints of the prefix and of the one before), ka, kb and words
    of each prefix of each rebuilt conversation, from depth 1 on; and conv_id and last of all."""
    heads = turns.where(F.col("pos") < HEADS).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ka", "kb", "words", *_S, *_T))).alias("head"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = convs.join(heads, "conv_id", "left").withColumn("base", base).withColumn("h", h)
    lead = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("lead"))
    none = F.expr("filter(array(struct(" + ", ".join(f"0L AS {c}" for c in ("pos", "ka", "kb", "words", *_S, *_T)) + ")), x -> false)")
    known = own.join(lead, "base", "left").withColumn("lead", F.slice(F.coalesce("lead", none), 1, F.col("h")))
    known = known.withColumn("led", F.size("lead")).withColumn("last", F.col("led") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    # sums of the turns that are left out, as far as there are more, and of the head that comes before
    at = lambda a, i, c: F.coalesce(F.get(a, i)[c], F.lit(0))
    known = written(known.select("conv_id", "h", "led", "last", "lead", *(at("head", F.col("h") - 1, s).alias(f"out_{s}") for s in _S), *(at("lead", F.col("led") - 1, s).alias(f"in_{s}") for s in _S)))

    def packed(columns: list[Column], names: tuple[str, str]) -> list[Column]:
        two = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
        return [two(columns[0], columns[1]).alias(names[0]), two(columns[2], columns[3]).alias(names[1])]

    def shift(k: int) -> Column:  # base^(led - h), a power of at most -3
        inverse = pow(BASES[k], PRIME - 2, PRIME)
        return F.element_at(F.array(*(F.lit(pow(inverse, d, PRIME)) for d in range(HEADS))), F.col("h") - F.col("led") + 1)

    rest = turns.join(known.drop("lead"), "conv_id").where("pos > h")
    new = [F.pmod(F.col(f"in_s{k}") + shift(k) * F.pmod(F.col(f"s{k}") - F.col(f"out_s{k}"), F.lit(PRIME)), F.lit(PRIME)) for k in range(LANES)]
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("led")).alias("depth"), "last", "ka", "kb", "words", *(c.alias(f"f{k}") for k, c in enumerate(new)), *((shift(k) * F.col(f"t{k}") % PRIME).alias(f"e{k}") for k in range(LANES)))
    first = known.select("conv_id", "last", F.inline("lead")).select("conv_id", F.col("pos").alias("depth"), "last", "ka", "kb", "words", *(F.pmod(F.col(f"s{k}"), F.lit(PRIME)).alias(f"f{k}") for k in range(LANES)), *(F.col(f"t{k}").alias(f"e{k}") for k in range(LANES)))
    every = first.unionByName(rest)
    before = [F.pmod(F.col(f"f{k}") - F.col(f"e{k}"), F.lit(PRIME)) for k in range(LANES)]
    out = written(every.select("conv_id", F.col("depth").cast("long"), F.col("last").cast("long"), "ka", "kb", "words", *packed([F.col(f"f{k}") for k in range(LANES)], ("fa", "fb")), *packed(before, ("pa", "pb"))))
    ends = written(known.select("conv_id", F.col("last").cast("long")))
    released(known)
    return out, ends


def _chains(ends: DataFrame) -> DataFrame:
    """depth, fa, fb and ends_sha256 of nodes that conversations (depth, fa, fb, conv_id) end at: ids ascending, as a stream. A digest is a chain,
    so the ids of one node pass through one task; a hash state is held."""

    def run(batches):
        at, state, done = None, None, []
        for batch in batches:
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "fa", "fb", "conv_id"))):
                if key != at:
                    done += [(*at, state.hexdigest())] if at else []
                    at, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["depth", "fa", "fb", "ends_sha256"])
                done = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], ["depth", "fa", "fb", "ends_sha256"])

    dealt = ends.repartition("depth", "fa", "fb").sortWithinPartitions("depth", "fa", "fb", "conv_id")
    return dealt.mapInArrow(run, "depth long, fa long, fb long, ends_sha256 string")


_NODE = ["depth", "fa", "fb"]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    Rows (conv_id, turn, role, text) go by turn, null first; rows of one turn by role
    and text, and repeated rows are each a turn. Null roles and texts are empty.
    Rows without a conv_id belong to no conversation. Every conversation is
    rebuilt: the first h turns of conversation c - c % 20, h = crc32(c) % 4, then its own
    after its first h. The root is a node as soon as there is a conversation; no
    conversations give no rows.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    for salt in count():
        turns = written(_numbered(rows, salt))
        if _one_text_a_key(rows, salt, turns):
            summed = written(running(turns, "conv_id", F.floor(F.col("pos") / BLOCK), ["pos"], dict(zip(_S, _T))))
            convs = summed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
            members, ends = _members(summed, convs)
            released(summed)
            same = [F.min(c).alias(f"lo_{c}") for c in ("ka", "kb", "pa", "pb")] + [F.max(c).alias(f"hi_{c}") for c in ("ka", "kb", "pa", "pb")]
            nodes = members.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("last").alias("deepest"), *same)
            nodes = written(nodes)
            odd = nodes.where(" or ".join(f"lo_{c} <> hi_{c}" for c in ("ka", "kb", "pa", "pb")))
            if odd.isEmpty():
                break
            released(members, ends, nodes)
        released(turns)
    released(turns)
    nodes = nodes.select(*_NODE, "conv_id", "n_convs", "words", (F.col("deepest") == F.col("depth")).alias("leaf"), F.col("lo_pa").alias("pa"), F.col("lo_pb").alias("pb"))
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("last").alias("deepest")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fa"), F.lit(0).cast("long").alias("fb"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), (F.col("deepest") == 0).alias("leaf"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    nodes = written(nodes.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    # of each conversation, what its own nodes save from each depth on, all of them, and whether its last one is a leaf
    own = running(nodes.select("conv_id", "depth", "saved", "leaf"), "conv_id", F.floor(F.col("depth") / BLOCK), [F.col("depth").desc()], {"below": "saved"}, back=True)
    own = written(own)
    each = own.groupBy("conv_id").agg(F.max("below").alias("whole"), F.max(F.col("leaf").cast("int")).alias("leaves"))
    every = members.select("conv_id", *_NODE).unionByName(ends.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in _NODE)))
    subtree = every.join(each, "conv_id").groupBy(*_NODE).agg(F.sum("whole").alias("whole"), F.sum("leaves").alias("n_leaves"))
    # the smallest member's nodes above this one aren't in its subtree
    total = nodes.join(subtree, _NODE).join(own.select("conv_id", "depth", "below"), ["conv_id", "depth"]).join(each.select("conv_id", F.col("whole").alias("mine")), "conv_id")
    total = total.withColumn("saved_tokens", F.col("whole") - F.col("mine") + F.col("below"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count(F.lit(1)).alias("n_children"))
    # a node whose smallest member is its parent's too has its id; only tops of such runs ask their parents
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("parent"))
    asked = nodes.join(tops, "conv_id").where("depth = top and depth > 0").select("conv_id", "depth", "pa", "pb").join(parents, ["depth", "pa", "pb"]).select("conv_id", "depth", "parent")
    final = members.where("depth = last").select("conv_id", *_NODE).unionByName(ends.where("last = 0").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in _NODE)))
    out = total.join(children, _NODE, "left").join(_chains(final), _NODE, "left").join(asked, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    result = written(out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long"), F.col("saved_tokens").cast("long"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
    released(members, ends, nodes, own)
    return result


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT conv_id::BIGINT AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT c, own, list_transform(range(0, 8 * len(c::VARCHAR)), lambda i: ((ascii(substr(c::VARCHAR, i // 8 + 1, 1)) >> (i % 8)::INT) & 1)::BIGINT) AS bits FROM t),
h AS (SELECT c, own, xor(list_reduce(list_concat([4294967295::BIGINT], bits), lambda x, bit: xor(x >> 1, 3988292384 * (xor(x, bit) & 1))), 4294967295) % 4 AS h FROM b),
r AS MATERIALIZED (
  SELECT h.c, list_concat(coalesce(t.own, [])[1:h.h], h.own[h.h + 1:]) AS turns FROM h LEFT JOIN t ON t.c = h.c - h.c % 20),
p AS MATERIALIZED (SELECT c, d, turns[1:d]::VARCHAR || '|' || d AS node, CASE WHEN d > 0 THEN turns[1:d - 1]::VARCHAR || '|' || (d - 1) END AS up,
  CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words, len(turns) = d AS ends
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS MATERIALIZED (
  SELECT node, any_value(up) AS up, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM p GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT a.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM (SELECT DISTINCT a.node, b.node AS under FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d) a JOIN n x ON x.node = a.under LEFT JOIN k ON k.node = x.node GROUP BY a.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n u ON u.node = n.up
"""
