"""Near-duplicates by SimHash fingerprints and pivot distance tables.

A fingerprint bit is 1 if more than half of a text's shingle hashes have it.
Equal fingerprints are one class, and only classes are compared. Candidates
meet in tables keyed by some of the fingerprint's bits. Within such a bucket,
each class has a row of Hamming distances to many reference fingerprints; by
the triangle inequality two classes whose rows differ anywhere by more than
the limit are too far apart, and only what is left is verified on the bits. A
bucket emits a link to one of its members for each other member that it can
reach, not its pairs, and a member that is reached is not compared again.

Up to three differing bits are found without a miss: six blocks of bits, and a
table for each three of them (three differing bits leave three blocks equal).
For a similarity of shingle sets, fingerprints are wider and of distinct
shingles, tables take bits at fixed random places, and each link is verified on
the sets; what isn't one class by then is asked again; see near_classes().
"""

from __future__ import annotations

import math
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import released, table, utf8, within, written

REFERENCES, WIDTH = 12, 8
#: Bits of a table's key at least, classes that a key of unrelated texts should have at most, and the share of pairs just
#: similar enough that all tables together may miss.
KEY_BITS, IN_BUCKET, MISSED = 20, 64, 0.0875
#: Tables whose rows are dealt to buckets at once, at most; the disk that this takes is that of so many tables. The first are fewer: what they
#: find to be one class isn't asked for again, so that a large group makes links by its rows, not by its rows in every table.
FIRST, AT_ONCE = 4, 32
#: Rows of a bucket up to which all its pairs are verified at once, and rows that one of a larger bucket is verified against in the first turn.
SMALL, ASKED = 8, 16


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of so many words, space-joined, A-Z lower-cased; the whole sequence if it is shorter, none of no words."""
    parts = text.lower().split()
    if not parts:
        return []
    joined, n = b" ".join(parts), len(parts)
    if n <= words:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - words]]).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes, the bits that are set in more than half of them.

    Every eighth bit is counted at once, in the bytes of a sum of 255 hashes.
    """
    lanes, n = hashes.shape
    blocks = -(-n // 255)
    padded = np.zeros((lanes, blocks * 255), np.uint64)
    padded[:, :n] = hashes
    counts = np.empty((lanes, 8, 8), np.int64)
    for k in range(8):
        sums = ((padded >> np.uint64(k)) & np.uint64(0x0101010101010101)).reshape(lanes, blocks, 255).sum(2)
        counts[:, :, k] = sums.astype("<u8").view(np.uint8).reshape(lanes, blocks, 8).sum(1, dtype=np.int64)
    return np.packbits(2 * counts.reshape(lanes, 64) > n, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: bytes, words: int = 3, lanes: int = 1) -> np.ndarray:
    """lanes numbers of 64 bits. The first takes XXH64 with seed 42; each further one remixes that hash."""
    return _fingerprint_of(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, words)], np.uint64), lanes)


def _fingerprint_of(hashes: np.ndarray, lanes: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    mixed = np.empty((lanes, len(hashes)), np.uint64)
    mixed[0] = hashes
    with np.errstate(over="ignore"):
        for lane in range(1, lanes):
            h = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed[lane] = h ^ (h >> np.uint64(31))
    return majority(mixed)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, words)], np.uint64))


def fingerprints(texts: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """All columns of texts but text, and fp: a long, or lanes * 8 bytes if lanes > 1."""
    rest = [c for c in texts.columns if c != "text"]

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            found = [fingerprint(raw[a:b], words, lanes) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            bits = np.stack(found) if found else np.zeros((0, lanes), np.uint64)
            fp = pa.array(bits[:, 0].view(np.int64)) if lanes == 1 else pa.array([x.tobytes() for x in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), fp], [*rest, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, schema + (", fp long" if lanes == 1 else ", fp binary"))


def set_fingerprints(texts: DataFrame, words: int = 5, lanes: int = WIDTH) -> DataFrame:
    """All columns of texts but text, sk (16 bytes that tell the set of shingles) and fp (lanes * 8 bytes, of distinct shingles)."""
    rest = [c for c in texts.columns if c != "text"]

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            sets = [shingle_set(raw[a:b], words) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            sk = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            fp = pa.array([_fingerprint_of(x, lanes).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), sk, fp], [*rest, "sk", "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, schema + ", sk binary, fp binary")


def pivot_table(bits: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (row of 64 bit lanes) to the reference fingerprints."""
    references = np.random.default_rng(11).integers(0, 1 << 64, (REFERENCES, bits.shape[1]), np.uint64, endpoint=False)
    return np.stack([np.bitwise_count(bits ^ r).sum(1, dtype=np.int16) for r in references])


def _may_link(distances: np.ndarray, most: int) -> bool:
    """Whether any two of a few rows of a pivot table agree everywhere to so many bits."""
    apart = np.abs(distances[:, :, None] - distances[:, None, :]).max(0)
    return int((apart <= most).sum()) > apart.shape[0]


def reach(bits: np.ndarray, distances: np.ndarray, most: int) -> np.ndarray:
    """For each row the first row of its component, where rows of at most so many differing bits are linked. distances: the rows' pivot table."""
    root = np.arange(len(bits))
    pool = np.arange(1, len(bits))
    queue, top = [0], 0
    while len(pool):
        if not queue:
            top, pool = int(pool[0]), pool[1:]
            queue.append(top)
            continue
        x = queue.pop()
        near = pool
        for row in distances:
            near = near[np.abs(row[near] - row[x]) <= most]
            if not len(near):
                break
        near = near[np.bitwise_count(bits[near] ^ bits[x]).sum(1) <= most]
        if len(near):
            root[near] = top
            queue.extend(near.tolist())
            pool = pool[~np.isin(pool, near, assume_unique=True)]
    return root


def marked(one: np.ndarray) -> bytes:
    """A set of hashes as bits at the places that their low bits name, 8 to 16 bits or so a hash: the size (4 bytes), then the bits."""
    n = len(one)
    bits = np.zeros(64 << max(0, (n - 1).bit_length() - 3), np.uint8)
    bits[(one & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.array([n], "<u4").tobytes() + np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(x: bytes | None, others: list[bytes | None], least: float) -> np.ndarray:
    """Whether sets may have a Jaccard similarity of at least so much with x, by their marked() bits; True where one isn't known.

    A place that x holds and another doesn't is a hash at least that they don't share, and of two sets that share s hashes the similarity
    is s / (|x| + |y| - s): what is refused isn't similar, for certain."""
    if x is None:
        return np.ones(len(others), bool)
    out = np.ones(len(others), bool)
    n, own = int.from_bytes(x[:4], "little"), np.frombuffer(x[4:], np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, y in enumerate(others):
        if y is not None:
            by_length.setdefault(len(y) - 4, []).append(i)
    for length, at in by_length.items():
        wide = np.frombuffer(b"".join(others[i][4:] for i in at), np.uint64).reshape(len(at), -1)
        sizes = np.array([int.from_bytes(others[i][:4], "little") for i in at])
        words = min(len(own), length // 8)  # the longer ones are folded: both lengths are powers of two
        a = np.bitwise_or.reduce(own.reshape(-1, words), 0)
        b = np.bitwise_or.reduce(wide.reshape(len(at), -1, words), 1)
        shared = np.minimum(n - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), sizes - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
        out[at] = shared >= least * (n + sizes - shared)
    return out


def unsure(bits: np.ndarray, distances: np.ndarray, root: np.ndarray, most: int, turn: int = 0, known: np.ndarray | None = None, marks: np.ndarray | None = None, least: float = 0.0):
    """(x, rows, more) for each row x outside the largest class: what it is to be verified against in this turn.

    The rows outside its component within so many differing bits, closest
    first, are taken ASKED at a time, four times as many each turn. Those known
    to be x's class by now are left out, and those that marks tell aren't similar to
    at least so much. more: whether any is left for later turns.
    """
    known = root if known is None else known
    first, last = (ASKED * 4 ** (turn - 1) if turn else 0), ASKED * 4**turn
    names, counts = np.unique(known, return_counts=True)
    for x in np.flatnonzero(known != names[counts.argmax()]).tolist():
        near = np.flatnonzero(root != root[x])
        for row in distances:
            near = near[np.abs(row[near] - row[x]) <= most]
            if len(near) <= first:
                break
        if len(near) <= first:
            continue
        d = np.bitwise_count(bits[near] ^ bits[x]).sum(1)
        near = near[d <= most][np.argsort(d[d <= most], kind="stable")]
        now, later = near[first:last], near[last:]
        now, later = now[known[now] != known[x]], later[known[later] != known[x]]
        if marks is not None:
            now, later = (rows[may_be_similar(marks[x], list(marks[rows]), least)] for rows in (now, later))
        more = bool(len(later))
        if len(now) or more:
            yield x, now, more


def _lanes_of(column: pa.Array, lanes: int) -> np.ndarray:
    if lanes == 1:
        return column.to_numpy().view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, lanes)


def _buckets(batches, lanes: int, others: tuple[str, ...] = ()):
    """Of rows (t, key, fp and others) sorted by t and key: (bits, keys, others, groups) of whole buckets of two rows and more. One bucket is held."""
    held, at = [], None  # parts of the bucket that may go on

    def closed():
        if sum(len(part[0]) for part in held) > 1:
            bits, keys, *rest = zip(*held)
            yield np.concatenate(bits), np.concatenate(keys, 1), [np.concatenate(x) for x in rest], [(0, sum(map(len, bits)))]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column("t").to_numpy(), batch.column("key").to_numpy()])
        every = [_lanes_of(batch.column("fp"), lanes), *(batch.column(c).to_numpy(zero_copy_only=False) for c in others)]
        edges = np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)), [batch.num_rows]])
        part = lambda i, j: (every[0][i:j], keys[:, i:j], *(x[i:j] for x in every[1:]))  # noqa: B023, E731
        if at is not None and (keys[:, 0] == at).all():
            held.append(part(0, edges[1]))
            edges = edges[1:]
        if len(edges) > 1:  # the held bucket is whole, and the last one of this batch is held
            yield from closed()
            sizes = np.diff(edges[:-1])
            yield every[0], keys, every[1:], [(int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(sizes > 1)]
            held, at = [part(edges[-2], edges[-1])], keys[:, -1]
    yield from closed()


def _bucket_links(most: int):
    """Of (t, key, fp) sorted by t and key: links (a, b) between 64 bit fingerprints of a bucket, one for each that is reached from another."""

    def run(batches):
        for bits, _, _, groups in _buckets(batches, 1):
            distances, a, b = pivot_table(bits), [], []
            two = np.array([i for i, j in groups if j - i == 2], int)
            two = two[(np.abs(distances[:, two] - distances[:, two + 1]) <= most).all(0)]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1) <= most]
            a, b = [two], [two + 1]
            for i, j in groups:
                if j - i > 2 and (j - i > 64 or _may_link(distances[:, i:j], most)):
                    root = reach(bits[i:j], distances[:, i:j], most)
                    moved = np.flatnonzero(root != np.arange(j - i))
                    a, b = [*a, i + moved], [*b, i + root[moved]]
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(bits[x, 0].view(np.int64)) for x in (a, b)], ["a", "b"])

    return run


def _first_asks(bits: np.ndarray, distances: np.ndarray, most: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of rows of a bucket to verify first, and whether there may be more. known: classes of the rows by now, which aren't asked for again.

    Rows are taken by components of links up to `most` bits. All pairs of a small one
    are taken; of a large one each row with the one closest to what most of them
    have, which is near to what copies were made from."""
    n = len(bits)
    known = np.arange(n) if known is None else known
    root = np.zeros(n, int) if n <= SMALL else reach(bits, distances, most)
    a, b, more = [], [], False
    for top in np.unique(root):
        rows = np.flatnonzero(root == top)
        if len(rows) <= SMALL:
            i, j = np.triu_indices(len(rows), 1)
            i, j = rows[i], rows[j]
        else:
            middle = np.packbits(2 * np.unpackbits(np.ascontiguousarray(bits[rows]).view(np.uint8), axis=1).sum(0, dtype=np.int64) > len(rows)).view(np.uint64)
            first = rows[np.bitwise_count(bits[rows] ^ middle).sum(1).argmin()]
            i, j, more = rows[rows != first], np.full(len(rows) - 1, first), more or bool((known[rows] != known[first]).any())
        near = (known[i] != known[j]) & (np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= most)
        a.append(i[near])
        b.append(j[near])
    return np.concatenate(a), np.concatenate(b), more


def _near_pairs(lanes: int, most: int, turn: int, least: float):
    """Of (t, key, node, fp, known and, after turn 0, mark) sorted by t, key and node: pairs (a, b) of nodes of a bucket to verify in this
    turn. A bucket that has more of them than a turn asks for gives a row of its t and key, without nodes."""
    names = ["a", "b", "t", "key"]

    def run(batches):
        for bits, keys, (node, known, *marks), groups in _buckets(batches, lanes, ("node", "known", "mark")[: 3 if turn else 2]):
            distances, a, b, open_, held = pivot_table(bits), [], [], [], 0
            made = lambda a, b: pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(x)]) for x in (a, b)] + [pa.nulls(sum(map(len, a)), k) for k in (pa.int32(), pa.int64())], names)  # noqa: B023, E731
            for i, j in groups:
                if (known[i:j] == known[i]).all() or j - i <= 64 and not _may_link(distances[:, i:j], most):
                    continue
                if not turn:
                    x, y, more = _first_asks(bits[i:j], distances[:, i:j], most, known[i:j])
                    asks = [(x, y, more)] if len(x) or more else []
                else:
                    asks = ((np.full(len(now), x), now, more) for x, now, more in unsure(bits[i:j], distances[:, i:j], np.arange(j - i), most, turn - 1, known[i:j], marks[0][i:j], least))
                left = False
                for x, y, more in asks:
                    a.append(i + x)
                    b.append(i + y)
                    held, left = held + len(x), left or more
                    if held > 1 << 16:
                        yield made(a, b)
                        a, b, held = [], [], 0
                if left:
                    open_.append(keys[:, i])
            if held:
                yield made(a, b)
            if open_:
                t, key = np.array(open_).T
                no = pa.nulls(len(open_), pa.int64())
                yield pa.RecordBatch.from_arrays([no, no, pa.array(t, pa.int32()), pa.array(key, pa.int64())], names)

    return run


def block_keys(fp: str = "fp", blocks: int = 6, keep: int = 3) -> F.Column:
    """(t, key) of each table of a 64 bit fingerprint: its bits in three of six blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    some = [sum(x) for x in combinations(masks, keep)]
    return F.array(*(F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(some)))


def _sampled_keys(lanes: int, tables: range, bits: int):
    """Of (node, fp, known): a row (t, key, node, fp, known) for each table, keyed by bits at its fixed random places."""
    places = {t: np.random.default_rng([17, t]).choice(64 * lanes, bits, replace=False) for t in tables}
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            column, n = batch.column("fp"), batch.num_rows
            if n:
                each = np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1), axis=1, bitorder="little")
                for t in tables:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(each[:, places[t]] @ powers), batch.column("node"), column, batch.column("known")], ["t", "key", "node", "fp", "known"])

    return run


def _classes(links: DataFrame) -> DataFrame:
    """(node, root) of the ends of links (a, b), through any chain."""
    links = written(links.select(F.col("a").alias("i"), F.col("b").alias("j")))
    roots = written(components(links.select(F.explode(F.array("i", "j")).alias("id")).distinct(), links))
    released(links)
    return roots


def linked_classes(fps: DataFrame, most: int = 3) -> DataFrame:
    """(node, root) of the 64 bit fingerprints in fps (fp) that differ in at most three bits from others, through any chain; roots themselves aren't listed."""
    if most > 3:
        raise ValueError("the tables of three blocks of six find up to three differing bits")
    dealt = fps.select("fp").distinct().select(F.inline(block_keys()), "fp")
    return _classes(dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_links(most), "a long, b long")).where("node <> root")


def bits_apart(similarity: float, lanes: int) -> int:
    """Differing bits to expect of sets of equal size with such a Jaccard similarity s: their cosine is 2 s / (1 + s), and a bit differs with the angle's share of a half turn."""
    return round(64 * lanes * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)


def key_plan(classes: int, similarity: float = 0.8) -> tuple[int, int]:
    """Bits of a key and number of tables for so many classes.

    Keys have KEY_BITS bits, and more from IN_BUCKET * 2^KEY_BITS classes on, so
    that unrelated classes don't fill the buckets. A pair just similar enough
    agrees in a bit with a known probability, and there are as many tables as it takes
    for MISSED of such pairs to share no key.
    """
    bits = max(KEY_BITS, math.ceil(math.log2(max(1, classes) / IN_BUCKET)))
    meet = (1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log1p(-meet)) if meet < 1 else 1


def table_rounds(tables: int) -> list[range]:
    """The tables in order, FIRST at first and then as many as there were and twice as many again, up to AT_ONCE."""
    out = [range(min(FIRST, tables))]
    while out[-1].stop < tables:
        out.append(range(out[-1].stop, min(out[-1].stop + min(3 * out[-1].stop, AT_ONCE), tables)))
    return out


def _shingle_sets(words: int):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            raw = data.tobytes()
            sets = [shingle_set(raw[a:b], words).view(np.int64) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return run


def _marks(batches):
    """Of (node, set): (node, mark)."""
    for batch in batches:
        marks = [marked(x.values.to_numpy().view(np.uint64)) for x in batch.column("set")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(marks, pa.binary())], ["node", "mark"])


def _similar(least: float):
    """Of (a, b, x, y): the pairs whose sets x and y have a Jaccard similarity of at least so much."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                keep.append(both >= least * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_classes(nodes: DataFrame, texts: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = WIDTH) -> DataFrame:
    """(node, root) of shingle sets with a Jaccard similarity of at least so much, through any chain; sets without links aren't listed.

    nodes: node, fp and the place k1, k2 of one text of each set; texts: k1, k2,
    text. The tables of key_plan() let a pair meet with a probability of 0.91 at
    0.8, 0.98 at 0.85 and over 0.999 at 0.9; every pair that meets within the limit of
    differing bits, isn't one class through others and that marks of the sets don't rule out for certain is verified on its sets. Small buckets ask at once, large ones for a few
    pairs a row that are likely, and in turns for what isn't one class by then.
    """
    bits, tables = key_plan(nodes.count(), similarity)
    most = bits_apart(similarity - 0.12, lanes)
    deal = lambda df, turn: df.repartition("t", "key").sortWithinPartitions("t", "key", "node").mapInArrow(_near_pairs(lanes, most, turn, similarity), "a long, b long, t int, key long")
    rounds = table_rounds(tables)
    asked = sets = roots = left = None
    for turn in count(1 - len(rounds)):  # first asks up to 0, then what large buckets still have
        seen = nodes.select("node", "fp").join(roots, "node", "left") if roots is not None else nodes.select("node", "fp", F.col("node").alias("root"))
        seen = seen.select("node", "fp", F.coalesce("root", "node").alias("known"))
        keyed = seen.mapInArrow(_sampled_keys(lanes, range(tables) if turn > 0 else rounds[turn - 1], bits), "t int, key long, node long, fp binary, known long")
        if turn > 0:
            keyed = keyed.join(left, ["t", "key"], "left_semi")
            keyed = keyed.join(sets.mapInArrow(_marks, "node long, mark binary"), "node", "left") if sets is not None else keyed.withColumn("mark", F.lit(None).cast("binary"))
        links = written(deal(keyed, max(0, turn)))
        pairs = links.where("a is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = written(pairs.join(asked, ["a", "b"], "left_anti") if asked is not None else pairs)
        if not pairs.isEmpty():
            ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            one = written((ends.join(sets.select("node"), "node", "left_anti") if sets is not None else ends).join(nodes.select("node", "k1", "k2"), "node"))
            more = written(texts.join(one, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "text").mapInArrow(_shingle_sets(words), "node long, set array<long>"))
            sets = more if sets is None else sets.unionByName(more)
            side = lambda c, v: sets.select(F.col("node").alias(c), F.col("set").alias(v))  # noqa: B023, E731
            found = written(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"))
            if not found.isEmpty():  # a class that is known is a link a member, however many were verified
                true = found.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))) if roots is not None else found
                before, roots = roots, _classes(true)
                released(before)
            released(one, found)
        asked = pairs if asked is None else asked.unionByName(pairs)
        still = links.where("t is not null").select("t", "key")
        still = written(left.unionByName(still) if left is not None and turn <= 0 else still)  # of known size, so that keys are made and left out where they are
        released(links, left)
        left = still
        if turn >= 0 and left.isEmpty():
            break
    return roots if roots is not None else nodes.select("node", F.col("node").alias("root")).limit(0)


def simhash_components(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `most`
    differing bits, the row's own included. Null and wordless texts have
    fingerprint zero, linked like any other. Repeated rows share a class; null
    ids count as no id (a component of nothing else has a null component_id).
    """
    found = written(fingerprints(docs.select("doc_id", "text"), words))
    classes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = linked_classes(found, most)
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (doc_id, text and more columns) with one row of each class of near copies, that with the smallest doc_id.

    Ids come before null; of rows that agree in id, one of the smallest text
    hash stays, and of rows that agree in both, one. Null texts and texts
    without words are copies of each other. All columns are kept.
    """
    k1, k2, m = within(docs.columns, "k1", "k2", "m")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(k1, F.xxhash64(text)).withColumn(k2, F.xxhash64(F.lit(7), F.col("doc_id").isNull(), "doc_id", text))
    found = written(set_fingerprints(keyed.select("doc_id", F.col(k1).alias("k1"), F.col(k2).alias("k2"), text.alias("text")), words, WIDTH))
    texts = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), text.alias("text"))
    nodes = found.groupBy("sk", "fp").agg(F.min(F.struct("k1", "k2")).alias("x")).select("sk", "fp", "x.*")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = near_classes(nodes, texts, words, similarity)
    classed = nodes.select("sk", "node").join(roots, "node", "left").select("sk", F.coalesce("root", "node").alias("root"))
    rooted = found.join(classed, "sk").select("doc_id", "k1", "k2", "root")
    rows = rooted.groupBy("root", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("m"))
    kept = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "m")).alias("x"))
    kept = kept.select(F.col("x.k1").alias(k1), F.col("x.k2").alias(k2), F.col("x.m").alias(m))
    out = keyed.join(kept, [k1, k2])
    return out.where(F.col(m) == 1).unionByName(out.where(F.col(m) > 1).dropDuplicates([k1, k2])).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
