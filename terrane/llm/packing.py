"""Packing token sequences: sum-of-squares placement of each piece.

Every document's ids end in a separator; only documents longer than a sequence
are cut. A piece goes where the sum, over all gaps, of the squared number of
open sequences with that gap becomes smallest, or into a new sequence if that is
smaller still. Pieces are dealt into groups of bounded size, and each group is
packed by a task of its own that holds lengths, never ids.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

LENGTH, SEPARATOR, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Pieces that one task packs, about.
GROUP = 1 << 17
#: Equal pieces that are dealt to one group as one.
TOGETHER = 64
#: What a vocabulary is tried on before its words are looked up one by one.
PROBES = ("It's THE   end.\n\tOf a,b;c: \"d\" e--f (g) x..y 3.14 ~ \u00c9t\u00e9 Stra\u00dfe \u4f60\u597d \U0001f600 ok? yes!", "don't stop, un believable\u00a0words", "<|endoftext|> a_b http://x.org/y?z=1&w=2", " lead and trail ")
_KEPT_WORDS, _LONG_WORD, _FINAL = 600_000, 64, (b".", b",", b";", b":", b"!", b"?")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokens(dict):
    """ids of a text as bytes (little-endian, unsigned 32 bit), word by word.

    For vocabularies like word_bpe_49k: lower case, byte level, white space
    dropped, and no token spans it. A text's ids are then those of its words;
    words are looked up once seen, up to a number of them (the frequent ones come
    early). A word of letters alone goes straight to the merges, and a final full
    stop or the like after a letter or digit is a token of its own. A vocabulary
    that gives PROBES other ids is refused.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge, self.letters = tokenizer.encode, tokenizer.model.tokenize, _byte_letters()
        for text in PROBES:
            if self(text.encode()) != np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes():
                raise ValueError(f"the words of {path} can't be looked up one by one")

    def __missing__(self, word: bytes) -> bytes:
        if word[-1:] in _FINAL and word[-2:-1].isalnum():
            out = self[word[:-1]] + self[word[-1:]]
        else:
            ids = self._ids(word)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < _KEPT_WORDS and len(word) <= _LONG_WORD:
            self[word] = out
        return out

    def _ids(self, word: bytes) -> list[int]:
        if word.isalpha():  # ASCII
            return [t.id for t in self.merge(word.lower().decode())]
        text = word.decode()
        lower = "".join([c.lower() for c in text])
        if text.isalpha() and lower.isalpha() and unicodedata.is_normalized("NFC", text):
            return [t.id for t in self.merge(lower.encode().decode("latin-1").translate(self.letters))]
        return self.encode(text, add_special_tokens=False).ids

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """key (a hash of the row), doc_id, piece, start, length and ids_crc32 of each document's pieces."""

    def run(batches):
        import public_tokenizers

        ids = WordTokens(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            data, at = utf8(batch.column("text"))
            rows = []
            for i in range(batch.num_rows):
                got = ids(data[at[i] : at[i + 1]].tobytes()) + end
                n = len(got) // 4
                rows += [(i, k, s, min(length, n - s), zlib.crc32(got[4 * s : 4 * (s + length)])) for k, s in enumerate(range(0, n, length))]
            of, *rest = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(of)) for c in ("key", "doc_id")] + [pa.array(x.astype(np.int32) if k == 0 else x) for k, x in enumerate(rest)], ["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    return rows.mapInArrow(run, f"key long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(lengths: Iterable[int], size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, by sum of squares.

    Moving a sequence from gap g to g - n changes the sum by 2 (N[g - n] - N[g] + 1);
    full sequences don't count, and a new one adds 2 N[size - n] + 1. Ties go to
    the smallest gap.
    """
    open_with = np.zeros(size + 1, np.int64)
    cost = np.zeros(size + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    which, offset, count = [], [], 0
    far = np.int64(1) << 60
    for n in lengths:
        before, after = open_with[n:], cost[n:]
        np.subtract(open_with[: size + 1 - n], before, out=after)
        after += 1
        after *= 2
        after[0] = 1 - 2 * before[0]  # fills up
        after[before == 0] = far
        g = int(after.argmin()) + n
        new = 2 * open_with[size - n] + 1 if n < size else 0
        if cost[g] == far or g == size or new < cost[g]:
            b, g, count = count, size, count + 1
        else:
            b = by_gap[g].pop()
            open_with[g] -= 1
        which.append(b)
        offset.append(size - g)
        if g > n:
            by_gap[g - n].append(b)
            open_with[g - n] += 1
    return np.array(which, np.int64), np.array(offset, np.int64)


def repack(lengths: np.ndarray, which: np.ndarray, offset: np.ndarray, size: int) -> None:
    """Empties the sequences with the largest gaps, best fit first, into fewer; in place."""
    n = int(which.max()) + 1 if len(which) else 0
    fill = np.bincount(which, lengths, n).astype(np.int64)
    loose = np.flatnonzero(fill < size)
    if not len(loose):
        return
    moved = np.flatnonzero(fill[which] < size)
    moved = moved[np.argsort(-lengths[moved], kind="stable")]
    gaps: list[list[int]] = [[] for _ in range(size + 1)]
    has, to, used = np.zeros(size + 1, bool), np.empty(len(moved), np.int64), 0
    at = np.empty(len(moved), np.int64)
    for k, x in enumerate(lengths[moved].tolist()):
        g = x + int(has[x:].argmax())
        if not has[g]:
            b, g, used = used, size, used + 1
        else:
            b = gaps[g].pop()
            has[g] = bool(gaps[g])
        to[k], at[k] = b, size - g
        if g > x:
            gaps[g - x].append(b)
            has[g - x] = True
    if used < len(loose):
        which[moved], offset[moved] = loose[to], at


def pack(found: DataFrame, groups: int, length: int = LENGTH) -> DataFrame:
    """found (doc_id, length and more columns) with sequence_id and offset. Pieces are dealt to groups by what they are; equal ones are counted and dealt TOGETHER by TOGETHER."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        n = rows.column("length").to_numpy()
        group = rows.column("group_").to_numpy()[0]
        order = np.random.default_rng(5).permutation(len(n))
        which, offset = np.empty_like(n), np.empty_like(n)
        which[order], offset[order] = place(n[order].tolist(), length)
        repack(n, which, offset, length)
        _, which = np.unique(which, return_inverse=True)
        out = rows.drop_columns(["group_", "key", "part"]).append_column("sequence_id", pa.array((int(group) << 40) + which)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=20_000)

    same = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("m"))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / TOGETHER)))).repartition(groups, "key", "piece", "part")
    each = parts.withColumn("m", F.least(F.lit(TOGETHER).cast("long"), F.col("m") - F.col("part") * TOGETHER))
    dealt = each.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m").sortWithinPartitions("key", "piece", "start", "length", "ids_crc32").withColumn("group_", F.spark_partition_id().cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "key")
    return dealt.mapInArrow(run, schema + ", sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs (doc_id, text).

    A null or empty text is its separator alone. Rows with equal or null ids
    are documents of their own; extra columns are not read; no rows give none.
    A task packs about `group` pieces: there are groups enough for a row's one, and one more for
    each `length` bytes (a token has a byte or more), and equal rows are dealt out like others, TOGETHER at a time.
    """
    rows, most = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.floor(F.octet_length("text") / length)), F.lit(0))).first()
    groups = max(1, -(-(rows + most) // group))
    return pack(pieces(docs, vocabulary, length), groups, length)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
