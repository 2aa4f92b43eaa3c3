"""Sums over all rows, seen from each row: blocks of near rows by blocks of near rows.

For weights without an end, or bandwidths that reach most of a table, every row
meets every other; that is the method. Two blocks meet as one row of arrays, and
give one partial sum a focal row, so that no table of pairs is made. Blocks that
lie wholly beyond where a weight is zero don't meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import kept
from .running import in_blocks

#: exp(-746) is zero in double precision, and so is the weight of what is farther.
VANISHES = 746.0
#: Parts that the blocks of others are dealt to.
PARTS = 4


def end_of(bandwidth: float, kernel: str) -> float:
    """The distance from which on a kernel's weight is zero in double precision."""
    return bandwidth * {"bisquare": 1.0, "gaussian": math.sqrt(2 * VANISHES), "exponential": VANISHES}[kernel]


def kernel_of(d2: np.ndarray, b2: float, kernel: str) -> np.ndarray:
    if kernel == "bisquare":
        return np.where(d2 < b2, (1 - d2 / b2) ** 2, 0.0)
    return np.exp(d2 * (-0.5 / b2)) if kernel == "gaussian" else np.exp(-np.sqrt(d2 / b2))


def summed(obs: DataFrame, columns: Sequence[str], work: Callable[[np.ndarray, np.ndarray], np.ndarray], names: Sequence[str], how: Sequence[str], reach: float = math.inf) -> DataFrame:
    """(i, names): work(d2, values) gives a row a focal row and a column a name, for the squared distances (focal by other) to a block of
    others and their columns (other by column); how says whether partial results are joined by sum, min or max."""
    rows = obs.select("id", "px", "py", *columns)
    n = rows.count()
    each = max(64, min(2048, math.ceil(8 * math.sqrt(n))))
    placed = in_blocks(rows.where(F.col("px").isNotNull() & F.col("py").isNotNull()), each, n)
    box = [f(c).alias(f"{name}{c}") for c in ("px", "py") for name, f in (("lo", F.min), ("hi", F.max))]
    every = F.sort_array(F.collect_list(F.struct("id", "px", "py", *columns)))
    packed = kept(placed.groupBy("block").agg(*box, every.alias("r")))
    count, place = packed.count(), ["px", "py"]
    side = lambda s, cs: packed.select(F.col("block").alias(f"{s}block"), *(F.col(f"{e}{c}").alias(f"{s}{e}{c}") for c in place for e in ("lo", "hi")), *(F.col(f"r.{c}").alias(f"{s}{c}") for c in cs))
    a = side("a_", ["id", *place]).repartition(max(1, min(count, 4096)), "a_block")
    b = side("b_", [*place, *columns]).withColumn("part", F.pmod(F.xxhash64("b_block"), F.lit(PARTS)))
    gap = lambda c: F.greatest(F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.col(f"b_lo{c}") - F.col(f"a_hi{c}"), F.lit(0.0))
    met = a.crossJoin(b)
    met = met.where(F.pow(gap("px"), 2) + F.pow(gap("py"), 2) <= reach * reach) if math.isfinite(reach) else met
    met = met.select("a_block", *(f"a_{c}" for c in ("id", *place)), *(f"b_{c}" for c in (*place, *columns)))
    kind = obs.schema["id"].dataType.simpleString()
    join = {"sum": np.add, "min": np.minimum, "max": np.maximum}

    def run(batches):
        held: dict = {}

        def given():
            for ids, total in held.values():
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in total.T)], ["i", *names])
            held.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                got = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                key, ids = batch.column("a_block")[r].as_py(), batch.column("a_id")[r].values
                if key not in held:
                    if len(held) >= 64:
                        yield from given()
                x, y, u, v = got("a_px"), got("a_py"), got("b_px"), got("b_py")
                values = np.stack([got(f"b_{c}") for c in columns], 1) if columns else np.zeros((len(u), 0))
                parts = []
                for s in range(0, len(x), 64):  # as much as a processor's cache holds
                    d2 = (x[s : s + 64, None] - u) ** 2
                    d2 += (y[s : s + 64, None] - v) ** 2
                    parts.append(work(d2, values))
                out = np.concatenate(parts)
                if key in held:
                    for c, h in enumerate(how):
                        held[key][1][:, c] = join[h](held[key][1][:, c], out[:, c])
                else:
                    held[key] = (ids, out)
        yield from given()

    parts = met.mapInArrow(run, f"i {kind}, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("i").agg(*({"sum": F.sum, "min": F.min, "max": F.max}[h](c).alias(c) for c, h in zip(names, how)))


def distances_of(obs: DataFrame) -> DataFrame:
    """(i, n, d_min, d_max, d_mean): of each row's distances to all rows their number, the least that is something, the greatest and the mean."""

    def work(d2, _):
        least, most = np.where(d2 > 0, d2, np.inf).min(1), d2.max(1)
        return np.stack([np.full(len(d2), float(d2.shape[1])), least, most, np.sqrt(d2).sum(1)], 1)

    out = summed(obs, [], work, ["n", "least", "most", "total"], ["sum", "min", "max", "sum"])
    return out.select("i", F.col("n").cast("long").alias("n"), F.when(F.col("least") < float("inf"), F.sqrt("least")).alias("d_min"), F.sqrt("most").alias("d_max"), (F.col("total") / F.col("n")).alias("d_mean"))


def weight_sums(obs: DataFrame, bandwidth: float, kernel: str) -> DataFrame:
    """(i, w): the sum of all rows' weights at each row."""
    b2 = bandwidth * bandwidth
    return summed(obs, [], lambda d2, _: kernel_of(d2, b2, kernel).sum(1, keepdims=True), ["w"], ["sum"], end_of(bandwidth, kernel))


def moment_sums(obs: DataFrame, p: int, bandwidths: Sequence[float], kernel: str) -> DataFrame:
    """(i, bandwidth, m_a_b, r_a, n_pos, w_own, f_*): the moments of each row's fits at some distances, as local.moments has them."""
    up, xs = np.triu_indices(p), [f"x{a}" for a in range(p)]
    names = [*(f"m_{a}_{b}" for a, b in zip(*up)), *(f"r_{a}" for a in range(p)), "n_pos"]
    bands = [float(b) for b in bandwidths]

    def work(d2, values):
        x, y = values[:, :p], values[:, p : p + 1]
        terms = np.concatenate([x[:, up[0]] * x[:, up[1]], x * y], 1)
        out = []
        for b in bands:
            w = kernel_of(d2, b * b, kernel)
            out += [w @ terms, (w > 0).sum(1, keepdims=True).astype(float)]
        return np.concatenate(out, 1)

    every = [f"{c}__{k}" for k in range(len(bands)) for c in names]
    sums = summed(obs, [*xs, "yy"], work, every, ["sum"] * len(every), end_of(max(bands), kernel))
    each = F.array(*(F.struct(F.lit(b).alias("bandwidth"), *(F.col(f"{c}__{k}").alias(c) for c in names)) for k, b in enumerate(bands)))
    focal = obs.select(F.col("id").alias("i"), *(F.col(c).alias(f"f_{c}") for c in xs), F.col("yy").alias("f_yy"))
    return sums.select("i", F.inline(each)).withColumn("n_pos", F.col("n_pos").cast("long")).withColumn("w_own", F.lit(1.0)).join(focal, "i")
