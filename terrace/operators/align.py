"""Similarity transforms between point sets: moments in Spark, a 3 x 3 problem on the driver."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.lineage import cut

AXES = "xyz"


@dataclass(frozen=True)
class Similarity:
    """``target = scale * rotation @ source + translation``."""

    scale: float
    rotation: np.ndarray
    translation: np.ndarray

    def apply(self, points: np.ndarray) -> np.ndarray:
        return self.scale * points @ self.rotation.T + self.translation

    def residual(self, df: DataFrame) -> DataFrame:
        """Adds ``residual``, the distance between target and transformed source, to ``(sx, .., tz)``."""
        total = F.lit(0.0)
        for i, a in enumerate(AXES):
            moved = F.lit(float(self.translation[i]))
            for j, b in enumerate(AXES):
                moved = moved + F.lit(float(self.scale * self.rotation[i, j])) * F.col(f"s{b}")
            total = total + (F.col(f"t{a}") - moved) * (F.col(f"t{a}") - moved)
        return df.withColumn("residual", F.sqrt(total))


def moments(df: DataFrame, weight: str | None = None) -> DataFrame:
    """One row of weighted sums of pairs ``(sx, sy, sz, tx, ty, tz)``: all that a fit needs, in one aggregate."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = [F.sum(w).alias("w"), F.count("*").alias("n")]
    sums += [F.sum(w * F.col(f"{p}{a}")).alias(f"{p}{a}") for p in "st" for a in AXES]
    sums += [F.sum(w * F.col(f"t{a}") * F.col(f"s{b}")).alias(f"t{a}s{b}") for a in AXES for b in AXES]
    sums += [F.sum(w * F.col(f"{p}{a}") * F.col(f"{p}{a}")).alias(f"{p}{a}{p}{a}") for p in "st" for a in AXES]
    return df.agg(*sums)


def _centred(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means of source and target, the covariance of target by source, and the source's variance; raises where no fit is possible."""
    w = float(row["w"] or 0)
    if (row["n"] or 0) < 3 or w <= 0:
        raise ValueError("at least three pairs are needed")
    ms, mt = (np.array([row[f"{p}{a}"] / w for a in AXES]) for p in "st")
    cov = np.array([[row[f"t{a}s{b}"] / w for b in AXES] for a in AXES]) - np.outer(mt, ms)
    var = sum(row[f"s{a}s{a}"] / w for a in AXES) - ms @ ms
    d = np.linalg.svd(cov, compute_uv=False)
    if "txtx" in row and sum(row[f"t{a}t{a}"] / w for a in AXES) - mt @ mt <= 1e-18:
        raise ValueError("the targets lie in one place")
    if var <= 1e-18 or d[1] <= 1e-9 * max(d[0], 1e-300):
        raise ValueError("the points lie on a line or in one place")
    return ms, mt, cov, float(var)


def _whole(scale: float, rotation: np.ndarray, ms: np.ndarray, mt: np.ndarray, scales: tuple[float, float]) -> Similarity:
    if not np.isfinite(scale) or not scales[0] <= scale <= scales[1]:
        raise ValueError(f"the scale {scale} is out of bounds")
    return Similarity(scale, rotation, mt - scale * rotation @ ms)


def fitted(row, scales: tuple[float, float] = (0.0, float("inf"))) -> Similarity:
    """The least-squares similarity of a row of ``moments``, by singular values; raises if points are degenerate or the scale is out of bounds."""
    ms, mt, cov, var = _centred(row)
    u, d, vt = np.linalg.svd(cov)
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    return _whole(float((d * sign).sum() / var), u @ np.diag(sign) @ vt, ms, mt, scales)


def horn(row, scales: tuple[float, float] = (0.0, float("inf"))) -> Similarity:
    """The same in closed form: the turn is the quaternion of the largest eigenvalue of a symmetric 4 x 4 matrix."""
    ms, mt, cov, var = _centred(row)
    s = cov.T  # source by target
    n = np.empty((4, 4))
    n[0, 0] = np.trace(s)
    n[0, 1:] = n[1:, 0] = [s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]]
    n[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    w, *v = np.linalg.eigh(n)[1][:, -1]
    v = np.array(v)
    skew = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    rotation = (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * skew
    return _whole(float((rotation * cov).sum() / var), rotation, ms, mt, scales)


def fit(df: DataFrame, weight: str | None = None) -> Similarity:
    return fitted(moments(df, weight).first())


def _draws(seed: int):
    """A 64-bit xorshift generator with a multiplied output."""
    state = seed or 1
    mask = (1 << 64) - 1
    while True:
        state ^= state >> 12
        state = (state ^ (state << 25)) & mask
        state ^= state >> 27
        yield (state * 2685821657736338717) & mask


def consensus(df: DataFrame, identity: str, tolerance: float, trials: int = 1024, seed: int = 42) -> Similarity:
    """The fit of three pairs that most pairs agree with; the least sum of errors, then the first trial, on ties.

    Trials draw from all pairs. The trials' pairs, three a trial, and a count a range are all that comes to the driver; scoring
    holds every pair against every trial in one pass.
    """
    # places in order of identity: a range's number above a row's place in it, fixed by the cut
    placed = cut(df.repartitionByRange(identity).sortWithinPartitions(identity).withColumn("_at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    ends = list(accumulate(r["n"] for r in ranges))
    count = ends[-1] if ends else 0
    if count < 3:
        raise ValueError("at least three pairs are needed")
    draw = _draws(seed)
    triples = []
    for _ in range(trials):
        picked: list[int] = []
        while len(picked) < 3:
            k = next(draw) % count
            if k not in picked:
                picked.append(k)
        triples.append([(ranges[i := bisect_right(ends, k)]["p"] << 33) + k - (ends[i] - ranges[i]["n"]) for k in picked])
    wanted = df.sparkSession.createDataFrame([(n,) for n in sorted({n for t in triples for n in t})], "_at long")
    rows = {r["_at"]: r for r in placed.join(F.broadcast(wanted), "_at").collect()}
    fits = []
    for k, names3 in enumerate(triples):
        s = np.array([[rows[n][f"s{a}"] for a in AXES] for n in names3])
        t = np.array([[rows[n][f"t{a}"] for a in AXES] for n in names3])
        row = {"w": 3.0, "n": 3} | {f"s{a}": s[:, i].sum() for i, a in enumerate(AXES)} | {f"t{a}": t[:, i].sum() for i, a in enumerate(AXES)}
        row |= {f"t{a}s{b}": (t[:, i] * s[:, j]).sum() for i, a in enumerate(AXES) for j, b in enumerate(AXES)}
        row |= {f"s{a}s{a}": (s[:, i] ** 2).sum() for i, a in enumerate(AXES)}
        try:
            fits.append((k, fitted(row)))
        except ValueError:
            continue
    if not fits:
        raise ValueError("no three pairs fix a transform")
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(k, [float(x) for x in (f.scale * f.rotation).ravel()], [float(x) for x in f.translation]) for k, f in fits], "k int, m array<double>, v array<double>"
    )
    total = F.lit(0.0)
    for i, a in enumerate(AXES):
        moved = F.col("v")[i]
        for j, b in enumerate(AXES):
            moved = moved + F.col("m")[3 * i + j] * F.col(f"s{b}")
        total = total + (F.col(f"t{a}") - moved) * (F.col(f"t{a}") - moved)
    scored = df.join(F.broadcast(table)).withColumn("_e", F.sqrt(total))
    agree = F.col("_e") <= tolerance
    scores = scored.groupBy("k").agg(F.count_if(agree).alias("n"), F.sum(F.when(agree, F.col("_e")).otherwise(0.0)).alias("e"))
    best = scores.orderBy(F.desc("n"), "e", "k").first()
    return dict(fits)[best["k"]]


def robust_fit(df: DataFrame, start: Similarity, tolerance: float, delta: float, rounds: int = 8) -> Similarity:
    """Refits the pairs within ``tolerance`` with weights min(1, delta / residual) until these pairs stay the same."""
    current, before = start, None
    for _ in range(rounds):
        seen = current.residual(df).where(F.col("residual") <= tolerance)
        weighted = seen.withColumn("_w", F.least(F.lit(1.0), F.lit(delta) / F.greatest(F.col("residual"), F.lit(1e-12))))
        row = moments(weighted, "_w").first()
        used = cut(seen.select(*(f"{p}{a}" for p in "st" for a in AXES)))
        current = fitted(row)
        # the pairs themselves are compared, as many times as each comes
        if before is not None and used.exceptAll(before).isEmpty() and before.exceptAll(used).isEmpty():
            break
        before = used
    return current


def robust_mean(df: DataFrame, by: list[str], value: str, delta: float, rounds: int = 3) -> DataFrame:
    """``(*by, mean)``: the mean under weights min(1, delta / |value - mean|), a fixed number of rounds from the plain mean."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    for _ in range(rounds):
        seen = df.join(mean, by).withColumn("_w", F.least(F.lit(1.0), F.lit(delta) / F.greatest(F.abs(F.col(value) - F.col("mean")), F.lit(1e-12))))
        mean = seen.groupBy(*by).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("mean"))
    return mean
