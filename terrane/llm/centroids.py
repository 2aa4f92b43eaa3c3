"""Centroid clustering on bit planes.

A vector of 64 whole-numbered components is a pile of bit planes: plane a is
one number of 64 bits and has bit j of every component j that has bit a set.
The last plane is the sign and weighs less than nothing (two's complement). An
inner product is then a sum of popcounts, dot(v, c) = sum of wa * wb * popcount(Va & Cb)
over the planes of both, exact, and with the squares of both lengths it
gives squared distances. Sums over a cluster come from the same planes, by counts
of set bits. Planes are packed once and written; each round reads them, assigns
them and sums them in one pass, and a task gives a row a cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table, written

COMPONENTS, SCALE = 64, 256
CLUSTERS, ROUNDS = 40, 5
#: Vectors that are compared at once, and planes up to which no distance leaves 64 bits: 64 (2^28)^2 = 2^62.
ROWS, SAFE = 1024, 28


def planes_of(v: np.ndarray) -> np.ndarray:
    """(rows, planes) of uint64 for rows of 64 long components, sign last; as many planes as the largest of them needs."""
    most = int(np.maximum(v, ~v).max(initial=0)).bit_length() + 1
    out = np.empty((len(v), most), np.uint64)
    for a in range(most):
        out[:, a] = np.packbits(((v >> np.int64(a)) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def numbers_of(planes: np.ndarray) -> np.ndarray:
    """The components that were packed."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little").astype(np.int64)
    weights = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    weights[-1] = -weights[-1]
    return (bits * weights[None, :, None]).sum(1)


def products(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of each row of planes v with each of c, modulo 2^64. Pairs of planes of one weight are counted together."""
    out = np.zeros((len(v), len(c)), np.int64)
    for s in range(min(64, v.shape[1] + c.shape[1] - 1)):
        count = np.zeros(out.shape, np.int16)  # up to 64 pairs of up to 64 bits
        for a in range(max(0, s - c.shape[1] + 1), min(v.shape[1], s + 1)):
            hits = np.bitwise_count(v[:, a, None] & c[None, :, s - a])
            (np.subtract if (a == v.shape[1] - 1) != (s - a == c.shape[1] - 1) else np.add)(count, hits, out=count)
        out += count.astype(np.int64) << np.int64(s)
    return out


def squares(v: np.ndarray) -> np.ndarray:
    """Each row's inner product with itself, modulo 2^64."""
    out, last = np.zeros(len(v), np.int64), v.shape[1] - 1
    for a in range(last + 1):
        for b in range(a, min(last + 1, 64 - a)):
            hits = np.bitwise_count(v[:, a] & v[:, b]).astype(np.int64) << np.int64(a + b)
            out += (1 if a == b else 2) * (-hits if (a == last) != (b == last) else hits)
    return out


def nearest(v: np.ndarray, square: np.ndarray, c: np.ndarray, c_square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, ties to the smaller number."""
    label, gap = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for i in range(0, len(v), ROWS):
        part = slice(i, i + ROWS)
        if max(v.shape[1], c.shape[1]) <= SAFE:
            d = square[part, None] - 2 * products(v[part], c) + c_square
            label[part] = d.argmin(1)
            gap[part] = np.take_along_axis(d, label[part, None], 1)[:, 0]
            continue
        centres = numbers_of(c).astype(object)
        for k, row in enumerate(numbers_of(v[part]).astype(object), i):  # rare: numbers that need more than 64 bits on the way
            d = [int(((row - x) ** 2).sum()) for x in centres]
            label[k] = min(range(len(d)), key=d.__getitem__)
            if d[label[k]] >= 1 << 63:
                raise ArithmeticError("a squared distance doesn't fit a long")
            gap[k] = d[label[k]]
    return label, gap


def _floored(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which lists of a column hold COMPONENTS finite numbers, and floor(SCALE * x) of those."""
    flat, n = column.flatten(), np.array(column.value_lengths().fill_null(0))
    ends = np.cumsum(n)
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is not a number here
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    ok = (n == COMPONENTS) & (bad[ends] == bad[ends - n])
    v = np.floor(x[np.repeat(ok, n)].reshape(-1, COMPONENTS) * SCALE)
    if (np.abs(v) >= 2.0**63).any():
        raise ArithmeticError("a component doesn't fit a long")
    return ok, v.astype(np.int64)


def packed_planes(vectors: DataFrame) -> DataFrame:
    """vec_id, planes (binary, 8 bytes each) and square of the vectors (vec_id, embedding) that take part."""

    def run(batches):
        for batch in batches:
            ok, v = _floored(batch.column("embedding"))
            for i in range(0, len(v), ROWS):
                part = planes_of(v[i : i + ROWS])
                ids = batch.column("vec_id").filter(pa.array(ok)).slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([ids, pa.array([p.tobytes() for p in part], pa.binary()), pa.array(squares(part))], ["vec_id", "planes", "square"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, planes binary, square long")


def _read(batch: pa.RecordBatch) -> np.ndarray:
    """The batch's planes, shorter piles with their sign plane repeated (which leaves their numbers as they are)."""
    _, at, data = batch.column("planes").buffers()
    column = batch.column("planes")
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    words, start, n = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<u8"), (at[:-1] - at[0]) // 8, np.diff(at) // 8
    return words[start[:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)]


def _sums(centroids: np.ndarray):
    """Of packed vectors: (cluster, component, total) of the vectors that are nearest to each centroid, component -1 for their number."""
    c = planes_of(centroids)
    c_square, k = squares(c), len(centroids)

    def run(batches):
        total, size, room = np.zeros((k, COMPONENTS), np.int64), np.zeros(k, np.int64), 0

        def rows():
            some = np.flatnonzero(size)
            cluster = np.repeat(some, COMPONENTS + 1).astype(np.int32)
            component = np.tile(np.arange(-1, COMPONENTS, dtype=np.int32), len(some))
            return pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(component), pa.array(np.concatenate([size[some, None], total[some]], 1).ravel())], ["cluster", "component", "total"])

        for batch in batches:
            if not batch.num_rows:
                continue
            v = _read(batch)
            label, _ = nearest(v, batch.column("square").to_numpy(), c, c_square)
            more = len(v) << (v.shape[1] - 1)  # no component's sum grows by more
            if room + more >= 1 << 62:
                yield rows()
                total[:], size[:], room = 0, 0, 0
            room += more
            for i in range(0, len(v), ROWS):
                order = np.argsort(label[i : i + ROWS], kind="stable")
                names, first = np.unique(label[i : i + ROWS][order], return_index=True)
                bits = np.unpackbits(np.ascontiguousarray(v[i : i + ROWS][order]).view(np.uint8), axis=1, bitorder="little")
                counts = np.add.reduceat(bits, first, 0, np.int64).reshape(len(names), -1, COMPONENTS)
                weights = np.int64(1) << np.arange(v.shape[1], dtype=np.int64)
                weights[-1] = -weights[-1]
                total[names] += (counts * weights[None, :, None]).sum(1)
                size[names] += np.diff([*first, len(order)])
        if size.any():
            yield rows()

    return run


def moved(planes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored mean of the vectors nearest to each centroid; one that has none stays."""
    sums = planes.mapInArrow(_sums(centroids), "cluster int, component int, total long")
    rows = sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row a cluster and component
    found = {(r.cluster, r.component): int(r.total) for r in rows}
    return np.array([[found[k, j] // found[k, -1] for j in range(COMPONENTS)] if (k, -1) in found else old.tolist() for k, old in enumerate(centroids)], np.int64).reshape(-1, COMPONENTS)


def assigned(planes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of each packed vector."""
    c = planes_of(centroids)
    c_square = squares(c)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                label, gap = nearest(_read(batch), batch.column("square").to_numpy(), c, c_square)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label.astype(np.int32)), pa.array(gap)], ["vec_id", "cluster", "distance"])

    return planes.mapInArrow(run, f"vec_id {planes.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def starts(planes: DataFrame, clusters: int, salt: str = "2") -> np.ndarray:
    """Components of the vectors whose ids have the smallest hashes, in that order: `clusters` rows at most. A null id comes
    last; rows of one id go by their planes."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = planes.orderBy(by.asc_nulls_last(), "planes").limit(clusters).collect()  # a row a cluster
    return np.array([numbers_of(np.frombuffer(bytes(r.planes), "<u8").reshape(1, -1))[0] for r in rows], np.int64).reshape(-1, COMPONENTS)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector (vec_id, embedding) that takes part.

    Vectors of other than 64 components, null, or with a null or non-finite
    component take no part; the others count as floor(256 x). Repeated rows and
    null ids are vectors like others. Centroids are `clusters` x 64 numbers, all
    that driver and tasks hold of a round. Fewer vectors than clusters are a
    centroid each; no vectors give no rows. A component or distance that doesn't
    fit a long stops the query with an ArithmeticError.
    """
    planes = written(packed_planes(vectors))
    centroids = starts(planes, clusters)
    for _ in range(rounds):
        centroids = moved(planes, centroids)
    found = written(assigned(planes, centroids))
    released(planes)
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()  # a row a cluster
    whole = sum(r.cluster_inertia for r in inertia)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = vectors.sparkSession.createDataFrame([(r.cluster, r.cluster_inertia, whole, sha[r.cluster]) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings, with CLUSTERS centroids and ROUNDS rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(clusters: int, rounds: int) -> str:
    gap = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts: Sequence[str] = [
        """x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v FROM x ORDER BY sha256('2:' || vec_id) LIMIT {clusters})""",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, vec_id, any_value(v) AS v, min(struct_pack(d := d, k := cluster)) AS m
  FROM (SELECT x.r, x.vec_id, x.v, c.cluster, {gap} AS d FROM x, c{k} c) GROUP BY r, vec_id)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (
  SELECT cluster, list(floor(s::DOUBLE / n)::BIGINT ORDER BY j) AS v FROM (
    SELECT m.k AS cluster, j, sum(v[j]) AS s, count(*) AS n FROM a{k}, range(1, 65) t(j) GROUP BY 1, 2) GROUP BY cluster) n ON n.cluster = c.cluster)""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, m.k::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.cluster = m.k"""


OP13_SQL = _sql(CLUSTERS, ROUNDS)
