"""Nearest neighbours and the geometry metrics that build on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.lineage import cut

#: Most rows of a block; a task holds two blocks at a time.
MOST_HELD = 16_384
#: Left rows that are held against a whole block at a time, pairs that are measured at a time, and points of a leaf.
_STRIP, _CHUNK, _LEAF = 64, 65_536, 64
#: Most partitions of a side when two sides meet, whose tasks are their square.
_SIDE = 32


def neighbours(left: DataFrame, right: DataFrame, left_id: str, right_id: str, point: str, blocks: int = 4) -> DataFrame:
    """``(left_id, neighbour, distance)``: for every left row the nearest right row, the smallest id on ties.

    For points of many dimensions: each left row is held against every right row,
    block against block (see ``neighbours_both_ways``). The work is that of all
    pairs, however many they are. Rows whose point is null or has a null or
    non-finite coordinate have no neighbour and are none.
    """
    return _forward(_met(left, right, left_id, right_id, point, blocks, (True, False)), left_id)


def neighbours_both_ways(left: DataFrame, right: DataFrame, left_id: str, right_id: str, point: str, blocks: int = 4) -> tuple[DataFrame, DataFrame]:
    """``neighbours`` of the left rows and of the right rows, from one pass over all pairs.

    Each side is dealt out in ``blocks``, or in more so that none has more than
    ``MOST_HELD`` rows. A task takes one block of either side and returns one best
    row per row of them; pairs are never kept. Products of matrices rule out the
    pairs that can't be nearest by more than the products' error; the rest are
    measured coordinate by coordinate, so results are exact.
    """
    met = cut(_met(left, right, left_id, right_id, point, blocks, (True, True)))
    best = met.where("_way = 1").groupBy("_r").agg(F.min(F.struct("_d", "_l")).alias("_b"))
    return _forward(met.where("_way = 0"), left_id), best.select(F.col("_r").alias(right_id), F.col("_b._l").alias("neighbour"), F.col("_b._d").alias("distance"))


def _forward(met: DataFrame, left_id: str) -> DataFrame:
    best = met.groupBy("_l").agg(F.min(F.struct("_d", "_r")).alias("_b"))
    return best.select(F.col("_l").alias(left_id), F.col("_b._r").alias("neighbour"), F.col("_b._d").alias("distance"))


def _met(left: DataFrame, right: DataFrame, left_id: str, right_id: str, point: str, blocks: int, ways: tuple[bool, bool]) -> DataFrame:
    """``(_way, _l, _r, _d)``: per pair of blocks, the nearest right row of each left row (way 0) and the other way (way 1)."""
    x, y = (_packed(df, F.col(i), F.col(point), blocks, False) for df, i in ((left, left_id), (right, right_id)))
    x, y = _side(x, "_x"), _side(y, "_y")
    out = T.StructType([T.StructField("_way", T.IntegerType()), *_ids(x, y), T.StructField("_d", T.DoubleType())])

    def run(batches):
        for r in _rows(batches):
            (p, one), (q, two) = _distinct(_points(r, "_x")), _distinct(_points(r, "_y"))
            ids, others = r["_xi"].values, r["_yi"].values
            found = _dense(p[0], q[0], ways)
            for way, (back, first) in enumerate(((one, q[1]), (two, p[1]))):
                if ways[way]:
                    d, at = (v[back] for v in found[way])
                    near = first[at]
                    l, r_ = (ids, others.take(pa.array(near))) if way == 0 else (ids.take(pa.array(near)), others)  # noqa: E741
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), way, np.int32)), l, r_, pa.array(d)], names=out.names)

    return _beside(x, y).mapInArrow(run, out)


def _packed(df: DataFrame, identity: Column, point: Column, blocks: int, compact: bool) -> DataFrame:
    """Blocks ``(_b, _i, _p, _n, _low, _high)``: ids in order, points as doubles, their number of axes and their box.

    Compact blocks hold rows that lie together. Blocks are written down, so that
    numbers and rows stay as they are.
    """
    finite = F.forall("_p", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = df.select(identity.alias("_i"), point.cast("array<double>").alias("_p")).where(F.col("_p").isNotNull() & finite)
    most = MOST_HELD
    parts = max(blocks, -(-rows.count() // most))
    dealt = rows.repartitionByRange(parts, F.col("_p")[0]) if compact else rows.repartition(parts)
    box = T.ArrayType(T.DoubleType())
    out = T.StructType([T.StructField("_i", T.ArrayType(rows.schema["_i"].dataType)), T.StructField("_p", T.BinaryType()), T.StructField("_n", T.IntegerType()), T.StructField("_low", box), T.StructField("_high", box)])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, lists = table["_i"].combine_chunks(), table["_p"].combine_chunks()
        sizes = pc.unique(pc.list_value_length(lists)).to_pylist()
        if len(sizes) > 1 or not sizes[0]:
            raise ValueError(f"points of {sorted(sizes)} axes")
        p = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, sizes[0]) + 0.0
        runs = _leaves(p, most) if compact else np.split(np.arange(len(p)), range(most, len(p), most))
        for i in runs:
            own = ids.take(pa.array(i))
            order = pc.sort_indices(own, null_placement="at_start")
            q = p[i[order.to_numpy()]]
            own = pa.ListArray.from_arrays(pa.array([0, len(i)], pa.int32()), own.take(order))
            low, high = (pa.array([f(axis=0).tolist()], pa.list_(pa.float64())) for f in (q.min, q.max))
            yield pa.RecordBatch.from_arrays([own, pa.array([q.tobytes()], pa.binary()), pa.array([sizes[0]], pa.int32()), low, high], names=out.names)

    return cut(dealt.mapInArrow(run, out).withColumn("_b", F.monotonically_increasing_id()))


def _side(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select(*(F.col(c).alias(name + c[1:]) for c in blocks.columns))


def _beside(x: DataFrame, y: DataFrame, where: Column | None = None) -> DataFrame:
    """Blocks of ``x`` and ``y`` side by side, partition by partition: nothing is shuffled or broadcast."""
    return x.coalesce(_SIDE).join(y.coalesce(_SIDE).hint("shuffle_replicate_nl"), F.lit(True) if where is None else where)


def _ids(x: DataFrame, y: DataFrame) -> list[T.StructField]:
    return [T.StructField(n, df.schema[i].dataType.elementType) for n, df, i in (("_l", x, "_xi"), ("_r", y, "_yi"))]


def _rows(batches):
    """One dictionary of Arrow values per row."""
    for b in batches:
        for k in range(b.num_rows):
            yield {n: b.column(n)[k] for n in b.schema.names}


def _points(row: dict, side: str) -> np.ndarray:
    return np.frombuffer(row[f"{side}p"].as_buffer(), np.float64).reshape(-1, row[f"{side}n"].as_py())


def _distinct(p: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The different points and where each comes first, in this order, and which of them every row is."""
    rows = np.ascontiguousarray(p).view(np.dtype((np.void, p.shape[1] * 8))).ravel()
    _, first, back = np.unique(rows, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return (p[first[order]], first[order]), place[back]


def _keep(best: tuple[np.ndarray, np.ndarray], key: np.ndarray, d: np.ndarray, at: np.ndarray) -> None:
    """Puts the least ``(d, at)`` of each key into ``best`` where it is less than what is there."""
    order = np.lexsort((at, d, key))
    key, d, at = key[order], d[order], at[order]
    first = np.r_[True, key[1:] != key[:-1]]
    key, d, at = key[first], d[first], at[first]
    less = (d < best[0][key]) | ((d == best[0][key]) & (at < best[1][key]))
    best[0][key[less]], best[1][key[less]] = d[less], at[less]


def _dense(x: np.ndarray, y: np.ndarray, ways: tuple[bool, bool]) -> tuple:
    """Distance and place of the nearest row of ``y`` for each of ``x``, and of ``x`` for each of ``y``; smallest places on ties."""
    forward, backward = ((np.full(len(p), np.inf), np.full(len(p), len(q))) for p, q in ((x, y), (y, x)))
    with np.errstate(over="ignore", invalid="ignore"):
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        # twice what a product's square of a distance can be off by is half of this at most
        slack = 8 * (x.shape[1] + 2) * np.finfo(float).eps * (xx.max() + yy.max())
        least = np.full(len(y), np.inf)
        for s in range(0, len(x), _STRIP):
            t = x[s : s + _STRIP] @ y.T
            t *= -2
            t += xx[s : s + _STRIP, None]
            t += yy
            hit = np.full(t.shape, not np.isfinite(slack))
            if ways[0]:
                hit |= t <= t.min(axis=1, keepdims=True) + slack
            if ways[1]:
                np.minimum(least, t.min(axis=0), out=least)
                hit |= t <= least + slack
            near, far = np.nonzero(hit)
            near += s
            for c in range(0, len(near), _CHUNK):
                i, j = near[c : c + _CHUNK], far[c : c + _CHUNK]
                d = _distance(x[i], y[j])
                if ways[0]:
                    _keep(forward, i, d, j)
                if ways[1]:
                    _keep(backward, j, d, i)
    return forward, backward


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed over the axes in their order, as plain loops do."""
    d = 0.0
    for k in range(p.shape[-1]):
        step = p[..., k] - q[..., k]
        d = d + step * step
    return np.sqrt(d)


def _leaves(p: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows in parts of ``most`` at most that lie together: halves along the longest axis, and so on."""
    todo, out = [np.arange(len(p))], []
    while todo:
        i = todo.pop()
        if len(i) <= most:
            out.append(i)
            continue
        half = len(i) // 2
        i = i[np.argpartition(p[i, np.ptp(p[i], axis=0).argmax()], half)]
        todo += [i[half:], i[:half]]
    return out


def _boxes(p: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p[i].min(axis=0) for i in parts]), np.array([p[i].max(axis=0) for i in parts])


def _near(x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of the nearest row of ``y`` for each of ``x``, the smallest place on ties; infinity if none is within ``bound``.

    Leaves of ``x`` are held against those leaves of ``y`` whose boxes come near
    enough. A box is never farther than its points, in rounded numbers too.
    """
    best = (np.full(len(x), np.inf), np.full(len(x), len(y)))
    there, here = _leaves(y, _LEAF), _leaves(x, _LEAF)
    low, high = _boxes(y, there)
    for i in here:
        p = x[i]
        gap = np.maximum(np.maximum(low - p.max(axis=0), p.min(axis=0) - high), 0.0)
        gap = _distance(gap, np.zeros(x.shape[1]))
        home = y[there[np.argmin(_distance((low + high) / 2, p.mean(axis=0)))]]
        reach = np.minimum(bound[i], _distance(p[:, None], home[None]).min(axis=1))
        chosen = np.nonzero(gap <= reach.max())[0]
        if len(chosen):
            j = np.sort(np.concatenate([there[c] for c in chosen]))
            d = _distance(p[:, None], y[j][None])
            k = d.argmin(axis=1)
            d = d[np.arange(len(i)), k]
            best[0][i], best[1][i] = np.where(d <= bound[i], d, np.inf), j[k]
    return best


def cropped(points: DataFrame, reference: DataFrame, axes: list[str], pad: float) -> DataFrame:
    """The points within the reference's box, made wider by ``pad`` on all sides; none without a reference.

    The box is one row, whatever the input.
    """
    box = reference.agg(*(f(a).alias(f"_{n}_{a}") for a in axes for f, n in ((F.min, "low"), (F.max, "high"))))
    met = points.join(F.broadcast(box))
    for a in axes:
        met = met.where(F.col(a).between(F.col(f"_low_{a}") - pad, F.col(f"_high_{a}") + pad))
    return met.select(*points.columns)


def paired(points: DataFrame, group: str, identity: str, block: int = 2048) -> DataFrame:
    """Pairs of rows of one ``group``, the smaller ``identity`` first, the second row's columns ending in 2.

    Each group is dealt out in blocks of about ``block`` rows, and every two blocks
    meet in a place of their own, so a large group is spread over many tasks.
    """
    sizes = points.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    sized = points.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(identity), "_n").cast("int"))
    every = F.explode(F.expr("sequence(0, _n - 1)"))
    x = sized.select(*points.columns, F.col("_own").alias("_bx"), every.alias("_by"))
    y = sized.select(F.col(group).alias("_g"), *(F.col(c).alias(f"{c}2") for c in points.columns), every.alias("_cx"), F.col("_own").alias("_cy"))
    met = (F.col(group) == F.col("_g")) & (F.col("_bx") == F.col("_cx")) & (F.col("_by") == F.col("_cy"))
    return x.join(y, met & (F.col(identity) < F.col(f"{identity}2"))).drop("_g", "_bx", "_by", "_cx", "_cy")


def grid_neighbours(left: DataFrame, right: DataFrame, left_id: str, right_id: str, axes: list[str], cell: float, most_rings: int = 64) -> DataFrame:
    """The same for two or three coordinates and sides of any size, without all pairs.

    Both sides are put in blocks of rows that lie together. Each left block is
    first held against the block whose centre is nearest, and what it finds there
    bounds how far its rows' neighbours can be; then against the others that come
    as near as that. Blocks follow where points are dense, so ``cell`` and
    ``most_rings`` of the former grid change nothing and are only taken.
    """
    x, y = (_packed(df, F.col(i), F.array(*(F.col(a).cast("double") for a in axes)), 4, True) for df, i in ((left, left_id), (right, right_id)))
    k = range(len(axes))
    middle = [(F.col("_xlow")[i] + F.col("_xhigh")[i]) / 2 - (F.col("_ylow")[i] + F.col("_yhigh")[i]) / 2 for i in k]
    x, y = _side(x, "_x"), _side(y, "_y")
    home = _beside(x.select("_xb", "_xlow", "_xhigh"), y.select("_yb", "_ylow", "_yhigh")).groupBy("_xb").agg(F.min(F.struct(sum((m * m for m in middle), F.lit(0.0)).alias("d"), "_yb"))["_yb"].alias("_h"))
    at_home = x.join(home, "_xb").join(y, F.col("_h") == F.col("_yb"))
    columns = [c for c in at_home.columns if c in ("_xb", "_xi", "_xp", "_xn", "_xlow", "_xhigh", "_h")]
    found = T.StructType([*at_home.select(*columns).schema, T.StructField("_xd", T.BinaryType()), T.StructField("_reach", T.DoubleType()), T.StructField("_best", T.ArrayType(T.StructType([*_ids(x, y), T.StructField("_d", T.DoubleType())])))])

    def search(r, bound):
        (p, one), (q, _) = _distinct(_points(r, "_x")), _distinct(_points(r, "_y"))
        d, at = _near(p[0], q[0], bound[p[1]])
        some = np.nonzero(np.isfinite(d)[one])[0]
        near = q[1][at[one[some]]]
        return d[one], pa.StructArray.from_arrays([r["_xi"].values.take(pa.array(some)), r["_yi"].values.take(pa.array(near)), pa.array(d[one[some]])], names=["_l", "_r", "_d"])

    def first(batches):
        for r in _rows(batches):
            d, best = search(r, np.full(len(r["_xi"].values), np.inf))
            same = [pa.array([r[c].as_py()], r[c].type) if c != "_xi" else pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), r[c].values) for c in columns]
            best = pa.ListArray.from_arrays(pa.array([0, len(best)], pa.int32()), best)
            yield pa.RecordBatch.from_arrays([*same, pa.array([d.tobytes()], pa.binary()), pa.array([d.max()]), best], names=found.names)

    def others(batches):
        for r in _rows(batches):
            _, best = search(r, np.frombuffer(r["_xd"].as_buffer(), np.float64))
            yield pa.RecordBatch.from_arrays(best.flatten(), names=["_l", "_r", "_d"])

    homes = cut(at_home.mapInArrow(first, found))
    gaps = [F.greatest(F.col("_ylow")[i] - F.col("_xhigh")[i], F.col("_xlow")[i] - F.col("_yhigh")[i], F.lit(0.0)) for i in k]
    apart = F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))
    more = _beside(homes.drop("_best"), y, (F.col("_yb") != F.col("_h")) & (apart <= F.col("_reach"))).mapInArrow(others, T.StructType([*_ids(x, y), T.StructField("_d", T.DoubleType())]))
    return _forward(homes.select(F.inline("_best")).unionByName(more), left_id)


def geometry_metrics(forward: DataFrame, backward: DataFrame, tau: float) -> DataFrame:
    """One row of accuracy, completeness, Chamfer distance, precision, recall and F-score from distances both ways."""
    a = forward.agg(F.avg("distance").alias("accuracy"), F.avg((F.col("distance") <= tau).cast("double")).alias("precision"))
    b = backward.agg(F.avg("distance").alias("completeness"), F.avg((F.col("distance") <= tau).cast("double")).alias("recall"))
    both = a.join(F.broadcast(b))
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).otherwise(0.0)
    return both.select("accuracy", "completeness", ((F.col("accuracy") + F.col("completeness")) / 2).alias("chamfer"), "precision", "recall", f.alias("f_score"))
