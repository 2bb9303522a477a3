"""Ordered keyed folds: saturating means, admission and keyframe selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.numeric import finite


def ordered_rows(df: DataFrame, by: list[str], order: list[str], columns: dict[str, Column], out: str = "rows") -> DataFrame:
    """``(*by, rows)``: each key's rows as an array of structs in the given order.

    A fold that depends on order can't be pre-aggregated; its memory is one
    key's rows, of the columns that the fold needs alone.
    """
    fields = [F.col(c).alias(f"_o{k}") for k, c in enumerate(order)] + [v.alias(k) for k, v in columns.items()]
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}


def sequential(
    df: DataFrame, by: list[str], order: list[str], fields: dict[str, Column], keep: dict[str, Column], step: Callable[[object, tuple], tuple[object, tuple]], out: dict[str, str]
) -> DataFrame:
    """``(*by, *keep, *out)``: a row for each row, from a fold over each key's rows in order.

    ``step(state, fields)`` gives the next state and the values of ``out``; the
    first state is None. Rows are sorted by key and order and stream through a
    task that holds one state, whatever a key's number of rows.
    """
    columns = [*(F.col(c) for c in by), *(v.alias(f"_k{i}") for i, v in enumerate(keep.values())), *(v.alias(f"_f{i}") for i, v in enumerate(fields.values()))]
    rows = df.select(*columns, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *(f"_o{i}" for i in range(len(order))))
    kinds = [rows.schema[i].dataType.simpleString() for i in range(len(by) + len(keep))]
    names = [*by, *keep, *out]
    n, m, end = len(by), len(by) + len(keep), len(by) + len(keep) + len(fields)
    added_kinds = [_ARROW[kind] for kind in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made: list[tuple] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)
            values = zip(*(batch.column(i).to_pylist() for i in range(m, end)), strict=True)
            for k, v in zip(keys, values, strict=True):
                if k != key:
                    key, state = k, None
                state, one = step(state, v)
                made.append(one)
            added = [pa.array([x[i] for x in made], kind) for i, kind in enumerate(added_kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(m)), *added], names)

    schema = ", ".join(f"`{name}` {kind}" for name, kind in zip(names, [*kinds, *out.values()], strict=True))
    return dealt.mapInArrow(run, schema)


def saturating_step(most: float, kind: str = "double") -> Callable[[Column, Column], Column]:
    """One observation ``x (s, w)`` put into a state ``a (v, w, n)``, which is rounded to ``kind``."""

    def step(a: Column, x: Column) -> Column:
        grown = F.least(F.lit(float(most)), a["w"].cast("double") + x["w"])
        part = F.least(x["w"], grown)
        mean = (a["v"].cast("double") * (grown - part) + x["s"] * part) / grown
        return F.struct(mean.cast(kind).alias("v"), grown.cast(kind).alias("w"), (a["n"] + 1).alias("n"))

    return step


def usable(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Rows whose value and weight are finite and whose weight is positive."""
    return df.where(finite(F.col(value)) & finite(F.col(weight)) & (F.col(weight) > 0))


def saturating_mean(
    df: DataFrame,
    by: list[str],
    order: list[str],
    value: str,
    weight: str,
    most: float,
    single: bool = True,
) -> DataFrame:
    """``(*by, mean, weight, observations)``: a running mean whose weight stops growing at ``most``.

    Each observation s of weight w: W' = min(most, W + w), c = min(w, W'),
    v' = (v (W' - c) + s c) / W'. Once saturated, the result depends on order.
    ``single`` rounds the state to 32 bits after each step. Rows whose value or
    weight isn't finite, or whose weight isn't positive, are left out.
    """
    kind = "float" if single else "double"
    rows = ordered_rows(usable(df, value, weight), by, order, {"s": F.col(value).cast("double"), "w": F.col(weight).cast("double")})
    start = F.struct(F.lit(0.0).cast(kind).alias("v"), F.lit(0.0).cast(kind).alias("w"), F.lit(0).cast("long").alias("n"))
    folded = rows.select(*by, F.aggregate("rows", start, saturating_step(most, kind)).alias("_a"))
    return folded.select(*by, F.col("_a.v").alias("mean"), F.col("_a.w").alias("weight"), F.col("_a.n").alias("observations"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, most: float) -> DataFrame:
    """The same where nothing saturates: sums, combined before the shuffle; ``saturated`` marks keys where it isn't."""
    out = df.groupBy(*by).agg(F.sum(F.col(value) * F.col(weight)).alias("_vw"), F.sum(weight).alias("weight"), F.count("*").alias("observations"))
    return out.select(*by, (F.col("_vw") / F.nullif(F.col("weight"), F.lit(0.0))).alias("mean"), "weight", "observations", (F.col("weight") > most).alias("saturated"))


#: Verdicts by which a row is taken.
TAKEN = ("first-frame", "useful-motion", "stationary-refresh")


def verdict(last: tuple[float, float] | None, row: tuple, policy: dict[str, float]) -> str:
    """What an admission policy says of a row ``(at, position, pending, depth, clipped, sharpness)`` after the last one taken.

    Checks in this order: pending writes, depth, exposure, sharpness, first,
    rate, motion, stationary refresh; what passes none has too little motion.
    Null measures pass their check.
    """
    at, position, pending, depth, clipped, sharpness = row

    def above(x: float | None, limit: float) -> bool:
        return x is not None and x > limit

    def below(x: float | None, limit: float) -> bool:
        return x is not None and x < limit

    if above(pending, policy["pending"]):
        return "writer-pressure"
    if below(depth, policy["depth"]):
        return "unusable-depth"
    if above(clipped, policy["clipped"]):
        return "extreme-exposure"
    if below(sharpness, policy["sharpness"]):
        return "unusably-soft"
    if last is None:
        return "first-frame"
    elapsed = None if at is None else at - last[0]
    if below(elapsed, policy["interval"]):
        return "rate-limited"
    if position is not None and last[1] is not None and abs(position - last[1]) >= policy["motion"]:
        return "useful-motion"
    if elapsed is not None and elapsed >= policy["stationary"]:
        return "stationary-refresh"
    return "insufficient-motion"


def admission(
    df: DataFrame,
    by: list[str],
    order: list[str],
    at: Column,
    position: Column,
    pending: Column,
    depth: Column,
    clipped: Column,
    sharpness: Column,
    keep: dict[str, Column],
    policy: dict[str, float],
) -> DataFrame:
    """Each row's ``(accepted, reason)`` by a policy that compares with the last accepted row of its key: ``verdict``.

    ``position`` is a number; the size of its difference measures motion.
    """

    def step(last: tuple | None, row: tuple) -> tuple[object, tuple]:
        reason = verdict(last, row, policy)
        taken = reason in TAKEN
        return ((row[0], row[1]) if taken and row[0] is not None else last), (taken, reason)

    fields = {"t": at, "p": position, "q": pending, "d": depth, "c": clipped, "s": sharpness}
    return sequential(df, by, order, fields, keep, step, {"accepted": "boolean", "reason": "string"})


def keyframes(
    df: DataFrame,
    by: list[str],
    order: list[str],
    measure: Column,
    rejected: Column,
    keep: dict[str, Column],
    least_gap: int = 2,
    most_gap: int = 30,
    least_change: float = 0.015,
    most_change: float = 0.65,
) -> DataFrame:
    """Each row's ``(selected, reason, gap)``: chosen by how far it is from the last chosen row, not the last row.

    ``rejected`` is a reason to drop a row for itself, null if there is none.
    After ``most_gap`` rows a quarter of the change is enough. ``gap`` is the
    number of rows since the last chosen one; null before the first.
    """

    def step(state: tuple | None, row: tuple) -> tuple[object, tuple]:
        i, at, held = state or (0, None, None)
        value, reason = row
        gap = None if at is None else i - at
        change = None if value is None or held is None else abs(value - held)
        if reason is None:
            if gap is None:
                reason = "sequence-start"
            elif gap < least_gap:
                reason = "minimum-spacing"
            elif change is not None and change > most_change:
                reason = "appearance-discontinuity"
            elif change is not None and change < least_change * (0.25 if gap >= most_gap else 1):
                reason = "near-duplicate"
            else:
                reason = "maximum-gap" if gap >= most_gap else "useful-change"
            taken = reason in ("sequence-start", "maximum-gap", "useful-change")
        else:
            taken = False
        return ((i + 1, i, value) if taken else (i + 1, at, held)), (taken, reason, gap)

    return sequential(df, by, order, {"m": measure, "r": rejected.cast("string")}, keep, step, {"selected": "boolean", "reason": "string", "gap": "int"})


def composite(
    df: DataFrame,
    by: list[str],
    order: list[str],
    alpha: Column,
    colour: Column,
    depth: Column,
    identity: Column,
    least: float = 1 / 255,
    opaque: float = 0.999,
    most: float = 0.99,
) -> DataFrame:
    """``(*by, colour, opacity, depth, dominant)``: layers laid over each other, front to back.

    A layer of opacity a adds (1 - A) a of its colour; layers below ``least`` are
    skipped, and all once A is above ``opaque``. ``depth`` is that of the first
    layer that shows; ``dominant`` the first with the largest part.
    """
    rows = ordered_rows(df, by, order, {"a": F.least(F.lit(most), alpha), "c": colour, "z": depth, "i": identity})

    def step(s: Column, x: Column) -> Column:
        shows = (x["a"] >= least) & (s["o"] <= opaque)
        part = F.when(shows, (1 - s["o"]) * x["a"]).otherwise(0.0)
        best = part > s["b"]
        return F.struct(
            (s["c"] + part * x["c"]).alias("c"),
            (s["o"] + part).alias("o"),
            F.coalesce(s["z"], F.when(shows, x["z"])).alias("z"),
            F.when(best, part).otherwise(s["b"]).alias("b"),
            F.when(best, x["i"]).otherwise(s["i"]).alias("i"),
        )

    schema = rows.schema["rows"].dataType.elementType
    start = F.struct(
        F.lit(0.0).alias("c"), F.lit(0.0).alias("o"), F.lit(None).cast(schema["z"].dataType).alias("z"), F.lit(0.0).alias("b"), F.lit(None).cast(schema["i"].dataType).alias("i")
    )
    done = rows.select(*by, F.aggregate("rows", start, step).alias("_s"))
    return done.select(*by, F.col("_s.c").alias("colour"), F.col("_s.o").alias("opacity"), F.col("_s.z").alias("depth"), F.col("_s.i").alias("dominant"))
