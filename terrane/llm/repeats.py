"""Exact removal of repeated byte strings: a depth-limited radix sort of sampled suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else, in the same text or in another. Suffixes are ordered through
``length`` bytes only, most significant digit first, and equal groups are the
repeated windows:

1. Every window of ``length`` bytes belongs to one anchor, the k-gram with the
   least hash in it (rightmost of ties). Equal windows have equal anchors at
   equal places, so the suffixes of anchors, about 1 in 75, stand for all.
   First digit: the anchor's k-gram. Groups of one end here.
2. Second digit: the whole range of bytes that the anchor's windows cover.
   Anchors that share it are repeated as a whole; this takes whole copies.
3. What is left lies at the rims of repeated passages. There each window of the
   anchor is ordered through all of its ``length`` bytes, first in blocks of
   neighbouring windows (what they share, then what they span), then singly.

Digits are compared by 64 and 128 bit hashes. Each pass is an aggregation with
partial sums and a join back, which adaptive execution can split where a
passage is very common; no pass makes pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8, written

LENGTH, GRAM, SEGMENT = 200, 48, 1 << 19
_LOW = (1 << 20) - 1
_POWERS: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, powers of a random odd base and of its inverse (mod 2^64)."""
    got = _POWERS.get((seed, 0))
    if got is None or len(got[1]) < n:
        rng = np.random.default_rng(seed)
        words, base = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1), int(rng.integers(1 << 62)) * 4 + 3
        inverse = pow(base, -1, 1 << 64)
        size = max(n, SEGMENT + 2048)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]), dtype=np.uint64)
        got = _POWERS[seed, 0] = (words, up, down)
    return got


def window_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each window of so many bytes."""
    n = len(data)
    words, up, down = _powers(seed, n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words[data] * up[:n], out=total[1:])
        out = (total[length:] - total[:-length]) * down[: n - length + 1]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a segment of bytes: each anchor's place and k-gram hash, and the first
    and last window that it stands for."""
    n, width = len(data) - length + 1, length - gram + 1
    h = window_hashes(data, gram, 1)
    at = np.arange(len(h), dtype=np.uint64)
    key = (h & ~np.uint64(_LOW)) | (np.uint64(_LOW) - at)
    rows = -(-len(key) // width)
    padded = np.full(rows * width, ~np.uint64(0), np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    place = (np.uint64(_LOW) - (least[first] & np.uint64(_LOW))).astype(np.int64)
    return place, h[place], first, last


def _segments(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text that between them hold each window once."""
    for s in range(0, max(0, len(data) - length + 1), SEGMENT):
        yield s, data[s : s + SEGMENT + length - 1]


_ANCHORS = "k1 long, k2 long, gram long, c1 long, first long, last long, place long"
_SPANS = "array<struct<first:long,last:long>>"


def _anchor_rows(length: int, gram: int):
    """Of (k1, k2, text): a row for each anchor. c1 hashes all bytes of its windows, and where it stands in them."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, at = utf8(batch.column("text"))
            rows: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                for s, part in _segments(data[at[i] : at[i + 1]], length):
                    place, h, first, last = anchors(part, length, gram)
                    raw = part.tobytes()
                    whole = np.array([digest(raw[a : b + length], p - a) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())], np.uint64)
                    for to, x in zip(rows, (np.full(len(h), i), h.view(np.int64), whole.view(np.int64), first + s, last + s, place + s)):
                        to.append(x)
            if rows[0]:
                of, *rest = map(np.concatenate, rows)
                keys = [batch.column(k).to_numpy()[of] for k in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, *rest)], ["k1", "k2", "gram", "c1", "first", "last", "place"])

    return run


def _rows_of_windows(split):
    """Of (k1, k2, text, spans): what split gives for each span of each text, with the text's keys."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            k1, k2, spans = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), batch.column("spans")
            for i in range(batch.num_rows):
                out = split(data[at[i] : at[i + 1]], spans[i].as_py())
                if out and len(out["first"]):
                    n = len(out["first"])
                    yield pa.RecordBatch.from_pydict({"k1": np.full(n, k1[i]), "k2": np.full(n, k2[i]), **out})

    return run


def _blocks(length: int, width: int):
    """Windows of an anchor, dealt into blocks by their distance from it. core hashes
    the bytes that all windows of a block share, full those that any window has."""

    def split(text, spans):
        raw, digest, rows = text.tobytes(), xxhash.xxh3_64_intdigest, []
        for x in spans:
            a, first, last = x["place"], x["first"], x["last"]
            for q in range((a - last) // width, (a - first) // width + 1):
                s, e = max(first, a - width * q - width + 1), min(last, a - width * q)
                rows.append((x["gram"], digest(raw[a - width * q : a - width * q - width + 1 + length], q), digest(raw[s : e + length], (q << 20) + (a - s)), s, e))
        gram, core, full, s, e = zip(*rows)
        return {"gram": np.array(gram, np.int64), "core": np.array(core, np.uint64).view(np.int64), "full": np.array(full, np.uint64).view(np.int64), "first": np.array(s, np.int64), "last": np.array(e, np.int64)}

    return split


def _single(length: int):
    """Each window of the spans: its hash and place."""

    def split(text, spans):
        hashes = [window_hashes(text[x["first"] : x["last"] + length], length, 2).view(np.int64) for x in spans]
        return {"gram": np.repeat(np.array([x["gram"] for x in spans], np.int64), [len(h) for h in hashes]), "w": np.concatenate(hashes), "first": np.concatenate([np.arange(x["first"], x["last"] + 1) for x in spans])}

    return split


def runs_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or adjacent [start, end)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def _kept_rows(batches):
    """Of (doc_id, text, spans): counts, digest of what stays, and the removed runs."""
    for batch in batches:
        data, at = utf8(batch.column("text"))
        spans, rows = batch.column("spans"), []
        for i in range(batch.num_rows):
            text = data[at[i] : at[i + 1]]
            found = spans[i].as_py() or []
            starts, ends = (np.array([x[k] for x in found], np.int64) for k in ("first", "last"))
            if found:
                starts, ends = runs_of(starts, ends)
            kept, last = hashlib.sha256(), 0
            for a, b in zip(starts.tolist(), ends.tolist()):
                kept.update(text[last:a].tobytes())
                last = b
            kept.update(text[last:].tobytes())
            rows.append((len(text), int((ends - starts).sum()), len(starts), kept.hexdigest(), [{"first": a, "last": b} for a, b in zip(starts.tolist(), ends.tolist())]))
        out = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = 16) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (array of
    [first, last) byte ranges) for each row of docs (doc_id, text).

    A null text is empty; a text shorter than length loses nothing. Rows with
    equal doc_id, null ids and repeated rows are documents of their own, and
    repeated rows are copies of each other: they share one list of spans, so work
    grows with their number. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), F.col("doc_id").isNull(), "doc_id", text).alias("k2"))
    found = texts.where(F.octet_length("text") >= length).select("k1", "k2", "text").mapInArrow(_anchor_rows(length, gram), _ANCHORS)
    # Written, counts meet the rows in a join of two plain exchanges, which adaptive execution can split where a key is hot.
    many = lambda df, *by: written(df.groupBy(*by).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(*by))
    twice = written(found.join(many(found, "gram"), "gram"))

    def ordered(df: DataFrame, by: list[str], digit: str, *place: str) -> tuple[DataFrame, DataFrame]:
        """The rows that share a digit, and one row for each digit of the groups that hold both unshared and other rows."""
        digits = written(df.groupBy(*by, digit).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "first", "last", *place)).alias("one")))
        mixed = digits.groupBy(*by).agg(F.sum("copies").alias("n"), F.min("copies").alias("least")).where("n > 1 and least = 1").select(*by)
        return df.join(digits.where("copies > 1").select(*by, digit), [*by, digit]), digits.join(mixed, by).select("gram", "one.*")

    def per_document(df: DataFrame, *columns: str) -> DataFrame:
        # a set: rows that are equal in id and text share their keys, and each has the same spans
        return df.groupBy("k1", "k2").agg(F.collect_set(F.struct(*columns)).alias("spans"))

    def of_windows(spans: DataFrame, split, schema: str) -> DataFrame:
        return texts.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(_rows_of_windows(split), "k1 long, k2 long, " + schema)

    copied, parts = ordered(twice, ["gram"], "c1", "place")
    blocks = written(of_windows(per_document(parts, "gram", "first", "last", "place"), _blocks(length, width), "gram long, core long, full long, first long, last long"))
    shared, rest = ordered(blocks, ["gram", "core"], "full")
    windows = written(of_windows(per_document(rest, "gram", "first", "last"), _single(length), "gram long, w long, first long"))
    again = written(windows.join(many(windows, "gram", "w"), ["gram", "w"]).select("k1", "k2", "first"))

    end = (F.col("last") + length).alias("last")
    spans = copied.select("k1", "k2", "first", end)
    spans = spans.unionByName(shared.select("k1", "k2", "first", end))
    spans = spans.unionByName(again.select("k1", "k2", "first", (F.col("first") + length).alias("last")))
    return texts.join(per_document(spans, "first", "last"), ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_kept_rows, docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed " + _SPANS)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("removed")


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, hash(b[i + 1 : i + 200]) AS h FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, coalesce(i - lag(i) OVER o > 200, true)::INT AS new FROM w SEMI JOIN twice USING (h) WINDOW o AS (PARTITION BY r ORDER BY i)),
run AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM hit) GROUP BY r, g),
gap AS (
  SELECT r, s AS till, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS since FROM run
  UNION ALL SELECT d.r, octet_length(b), NULL, coalesce(max(e), 0) FROM d LEFT JOIN run USING (r) GROUP BY d.r, b),
kept AS (SELECT g.r, string_agg(hex(b[since + 1 : till]), '' ORDER BY since) AS x FROM gap g JOIN d USING (r) WHERE till > since GROUP BY g.r),
sums AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
