"""Queries over the driver's tables, each binding one operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import quantile, splats
from terrace.functions.numeric import id_colour, nearest_cell, pearson_distance, radical_inverse, safe_path
from terrace.operators import align, bake, fold, graph, images, nearest, ranking, runs, scan, tables, temporal, tiles, voxels
from terrace.plans import gates

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function ``(read) -> DataFrame`` under its name, with its SQL if there is any."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from terrace.plans import capture  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from terrace.plans import capture  # noqa: F401  registers its queries

    return dict(_SQL)


def r6(x, name: str):
    return F.round(x, 6).alias(name)


def seconds(column: str = "ts"):
    return (F.unix_micros(F.col(column).cast("timestamp")) / 1e6)


_SECONDS = "(epoch_us(ts) / 1e6)"

# --- aggregation ---------------------------------------------------------------------------------


@query("""
select cast(floor(embedding[1] / 0.5) as bigint) as ca, cast(floor(embedding[2] / 0.5) as bigint) as cb, cast(floor(embedding[3] / 0.5) as bigint) as cc, count(*) as n,
  round(avg(embedding[1]::double), 6) as a, round(avg(embedding[2]::double), 6) as b, round(avg(embedding[3]::double), 6) as c
from embeddings group by all""")
def voxel_downsample(read):
    e = read("embeddings").select(*(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("abc")))
    out = voxels.downsampled(e, ["a", "b", "c"], 0.5, ["a", "b", "c"])
    return out.select("ca", "cb", "cc", "n", *(r6(F.col(n), n) for n in "abc"))


@query("""
with recursive o as (select user_id, value::double as s, (1 + event_id % 3)::double as w, row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (
  select user_id, 0::bigint as i, 0::float as v, 0::float as wt from o where i = 1
  union all
  select f.user_id, o.i, ((f.v::double * (least(20.0, f.wt::double + w) - least(w, least(20.0, f.wt::double + w))) + s * least(w, least(20.0, f.wt::double + w)))
    / least(20.0, f.wt::double + w))::float, least(20.0, f.wt::double + w)::float
  from f join o on o.user_id = f.user_id and o.i = f.i + 1)
select user_id, round(v::double, 4) as mean, wt::double as weight, i as observations from f qualify row_number() over (partition by user_id order by i desc) = 1""")
def tsdf_saturating_fold(read):
    e = read("events").withColumn("w", (1 + F.pmod("event_id", F.lit(3))).cast("double"))
    out = fold.saturating_mean(e, ["user_id"], ["ts", "event_id"], "value", "w", 20.0)
    return out.select("user_id", F.round(F.col("mean").cast("double"), 4).alias("mean"), F.col("weight").cast("double").alias("weight"), "observations")


@query("""
select l_partkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as mean, sum(l_quantity) as weight, count(*) as observations, sum(l_quantity) > 1000 as saturated
from lineitem group by l_partkey""")
def tsdf_weighted_mean_fast(read):
    out = fold.weighted_mean(read("lineitem"), ["l_partkey"], "l_extendedprice", "l_quantity", 1000)
    return out.select("l_partkey", F.round("mean", 4).alias("mean"), "weight", "observations", "saturated")


def _quantile(name: str, q: float, kind: str, place: str) -> None:
    sql = f"""
with s as (select l_returnflag, list(l_extendedprice order by l_extendedprice) as v, count(*) as n from lineitem group by 1),
p as (select *, {place} as spot from s)
select l_returnflag, round(v[floor(spot)::bigint + 1] + (v[ceil(spot)::bigint + 1] - v[floor(spot)::bigint + 1]) * (spot - floor(spot)), 6) as q from p"""

    def run(read):
        out = quantile.ranked(read("lineitem"), ["l_returnflag"], "l_extendedprice", q, kind, "q")
        return out.select("l_returnflag", r6(F.col("q"), "q"))

    run.__name__ = f"quantile_{name}"
    query(sql)(run)


_quantile("upper_median", 0.5, "upper_median", "floor(n / 2)")
_quantile("linear", 0.9, "linear", "0.9::double * (n - 1)")
_quantile("trunc", 0.95, "truncated", "least(n - 1, floor(0.95::double * (n - 1)))")
_quantile("ceil_rank", 0.95, "ceil_rank", "greatest(0, ceil(0.95::double * n) - 1)")
_quantile("round_index", 0.95, "rounded", "round_even((n - 1) * 0.95::double, 0)")


@query("""
with m as (select o_orderpriority, o_orderstatus, list(o_totalprice order by o_totalprice)[count(*) // 2 + 1] as m from orders group by 1, 2)
select o_orderpriority, round(list(m order by m)[count(*) // 2 + 1], 6) as median from m group by 1""")
def median_of_medians_gain(read):
    inner = quantile.ranked(read("orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", 0.5, "upper_median", "m")
    out = inner.groupBy("o_orderpriority").agg(quantile.exact(F.collect_list("m"), 0.5, "upper_median").alias("median"))
    return out.select("o_orderpriority", r6(F.col("median"), "median"))


@query("select p_brand, round(log2((max(p_retailprice) + 1e-6) / (min(p_retailprice) + 1e-6)), 6) as spread, min(p_size) as low, max(p_size) as high from part group by 1")
def exposure_spread(read):
    sizes = read("part").groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    return runs.stops(read("part"), ["p_brand"], "p_retailprice").join(sizes, "p_brand").select("p_brand", r6(F.col("spread"), "spread"), "low", "high")


@query("select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, round(sqrt(avg(value * value)), 6) as rmse, count(*) as n from events group by 1")
def mean_deviation_rmse(read):
    out = runs.spread(read("events"), ["event_type"], "value")
    return out.select("event_type", *(r6(F.col(c), c) for c in ("mean", "deviation", "rmse")), "n")


@query("select l_shipmode_gain as gain, n, blend from (select l_linestatus as l_shipmode_gain, count(*) as n, round(sum(l_extendedprice * l_discount * l_quantity) / sum(l_quantity), 6) as blend from lineitem group by 1)")
def weighted_blend(read):
    rows = read("lineitem").select(F.col("l_linestatus").alias("gain"), (F.col("l_extendedprice") * F.col("l_discount")).alias("colour"), "l_quantity")
    return fold.weighted_mean(rows, ["gain"], "colour", "l_quantity", 1e18).select("gain", F.col("observations").alias("n"), r6(F.col("mean"), "blend"))


@query("""
select case when value is null then 'missing' when value < 0 then 'negative' when value < 5 then 'small' else 'used' end as reason, count(*) as n from events group by 1""")
def skip_reasons(read):
    v = F.col("value")
    return runs.reasons(read("events"), {"missing": v.isNull(), "negative": v < 0, "small": v < 5})


@query("select (l_orderkey // 16) % 16 as digit, count(*) as n from lineitem group by 1")
def digit_histogram(read):
    return tiles.digit_counts(read("lineitem"), "l_orderkey", 1)


# --- neighbours and metrics ------------------------------------------------------------------------


def _labelled(read, odd: int) -> DataFrame:
    """All vectors, in two parts: those of even and those of odd labels."""
    return read("embeddings").where(F.col("label") % 2 == odd).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


_DISTANCES = """
with d as (select a.vec_id as x, b.vec_id as y, list_distance(a.embedding::double[], b.embedding::double[]) as d
  from embeddings a, embeddings b where a.label % 2 = 0 and b.label % 2 = 1),
f as (select x, min(d) as d from d group by x), g as (select y, min(d) as d from d group by y)"""


@query(_DISTANCES + """
select round((select avg(d) from f), 6) as accuracy, round((select avg(d) from g), 6) as completeness""")
def nn_accuracy_completeness(read):
    a, b = _labelled(read, 0), _labelled(read, 1)
    m = nearest.geometry_metrics(*nearest.neighbours_both_ways(a, b, "vec_id", "vec_id", "embedding"), 1.0)
    return m.select(r6(F.col("accuracy"), "accuracy"), r6(F.col("completeness"), "completeness"))


@query(_DISTANCES + """,
m as (select (select avg(d) from f) as a, (select avg(d) from g) as c, (select avg((d <= 9)::int) from f) as p, (select avg((d <= 9)::int) from g) as r)
select round((a + c) / 2, 6) as chamfer, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f_score from m""")
def chamfer_fscore(read):
    a, b = _labelled(read, 0), _labelled(read, 1)
    m = nearest.geometry_metrics(*nearest.neighbours_both_ways(a, b, "vec_id", "vec_id", "embedding"), 9.0)
    return m.select(*(r6(F.col(c), c) for c in ("chamfer", "precision", "recall", "f_score")))


@query("""
with p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
d as (select a.vec_id, b.vec_id as n, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from p a, p b where a.label < 5 and b.label >= 5)
select vec_id, n as neighbour, round(d, 6) as distance from d qualify row_number() over (partition by vec_id order by d, n) = 1""")
def nn_argmin_tie(read):
    p = read("embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))
    out = nearest.grid_neighbours(p.where("label < 5"), p.where("label >= 5"), "vec_id", "vec_id", ["x", "y", "z"], 0.25)
    return out.select("vec_id", "neighbour", r6(F.col("distance"), "distance"))


@query("""
select vec_id from embeddings where embedding[1] between (select quantile_cont(embedding[1], 0.0) from embeddings where label = 0) - 0.1 and (select max(embedding[1]) from embeddings where label = 0) + 0.1
 and embedding[2] between (select min(embedding[2]) from embeddings where label = 0) - 0.1 and (select max(embedding[2]) from embeddings where label = 0) + 0.1 and label <> 0""".replace("quantile_cont(embedding[1], 0.0)", "min(embedding[1])"))
def crop_box(read):
    e = read("embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return nearest.cropped(e.where("label <> 0"), e.where("label = 0"), ["x", "y"], 0.1).select("vec_id")


@query("""
with p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
a as (select a.label, degrees(acos(greatest(-1, least(1, (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x ** 2 + a.y ** 2 + a.z ** 2) * sqrt(b.x ** 2 + b.y ** 2 + b.z ** 2)))))) as d
  from p a, p b where a.label = b.label and a.vec_id < b.vec_id)
select label, round(max(d), 4) as degrees, count(*) as pairs from a group by label""")
def max_pair_angle(read):
    from terrace.functions.geometry import angle

    p = read("embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))
    d = F.degrees(angle(tuple(F.col(a) for a in "xyz"), tuple(F.col(f"{a}2") for a in "xyz")))
    return nearest.paired(p, "label", "vec_id").groupBy("label").agg(F.round(F.max(d), 4).alias("degrees"), F.count("*").alias("pairs"))


# --- joins on time ---------------------------------------------------------------------------------


@query(f"""
with l as (select event_id, user_id, {_SECONDS} as t from events where event_type = 'view'),
r as (select user_id, {_SECONDS} as t, min(event_id) as v from events where event_type = 'click' group by all),
e as (select l.event_id, l.user_id, l.t, r.t as et, r.v as ev from l asof left join r on l.user_id = r.user_id and l.t >= r.t),
b as (select e.*, r.t as lt, r.v as lv from e asof left join r on e.user_id = r.user_id and e.t <= r.t),
p as (select *, case when lt is not null and (et is null or lt - t <= t - et) then lt else et end as mt, case when lt is not null and (et is null or lt - t <= t - et) then lv else ev end as mv from b)
select event_id, case when abs(mt - t) <= 86400 then mv end as matched from p""")
def asof_nearest_tolerance(read):
    e = read("events").withColumn("t", seconds())
    left = e.where("event_type = 'view'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("user_id", "t", F.col("event_id").alias("v"))
    return temporal.nearest(left, right, ["user_id"], "t", "v", 86400.0).select("event_id", "matched")


@query(f"""
with l as (select event_id, user_id, {_SECONDS} as t from events where event_type = 'view'),
r as (select user_id, {_SECONDS} as t, max(value)::double as v from events where event_type = 'click' group by all),
e as (select l.*, r.t as et, r.v as ev from l asof left join r on l.user_id = r.user_id and l.t >= r.t),
b as (select e.*, r.t as lt, r.v as lv from e asof left join r on e.user_id = r.user_id and e.t <= r.t)
select event_id, round(case when et is null then lv when lt is null then ev when lt > et then ev + (lv - ev) * ((t - et) / (lt - et)) else ev end, 5) as value_at from b""")
def interp_lookup(read):
    e = read("events").withColumn("t", seconds())
    left = e.where("event_type = 'view'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("user_id", "t", "value")
    return temporal.interpolated(left, right, ["user_id"], "t", "value").select("event_id", F.round("value_at", 5).alias("value_at"))


@query("""
with s as (select user_id, event_id, ts, lag(event_id) over w as o, lag(ts) over w as t from events window w as (partition by user_id order by value, event_id))
select user_id, event_id, case when event_id <= o then 'ordinal-order' else 'time-order' end as code from s where event_id <= o or ts < t""")
def monotonic_check(read):
    from pyspark.sql import Window

    arrival = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    return temporal.out_of_order(read("events").withColumn("_arrival", arrival), ["user_id"], "event_id", "ts")


# --- ranking ---------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_extendedprice, r::int as rank from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as r from lineitem) where r <= 4")
def topk_per_group(read):
    out = ranking.top_per_group(read("lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey")], 4)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("select s_nationkey, s_name, s_acctbal from supplier qualify row_number() over (partition by s_nationkey order by floor(s_acctbal / 1000) desc, length(s_name) desc, s_suppkey) = 1")
def model_rank_argmax(read):
    return ranking.best(read("supplier"), ["s_nationkey"], [F.floor(F.col("s_acctbal") / 1000), F.length("s_name")], "s_suppkey", ["s_name", "s_acctbal"])


@query("""
with v as (select o_custkey, max(o_orderkey) filter (where o_orderstatus = 'F') as k from orders group by 1)
select v.o_custkey, v.k as o_orderkey, o.o_totalprice, (select count(*) from orders x where x.o_custkey = v.o_custkey and x.o_orderkey > v.k and x.o_orderstatus <> 'F') as rejected
from v join orders o on o.o_orderkey = v.k""")
def latest_valid(read):
    return ranking.latest_valid(read("orders"), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F", ["o_totalprice"])


_KINDS = {"Brand#11": 4, "Brand#12": 2, "Brand#13": 3, "Brand#1": 4, "Brand#2": 2}
_SLOTS = {"Brand#11": 1, "Brand#12": 6, "Brand#13": 2, "Brand#1": 1, "Brand#2": 6}


@query(f"""
with k as (select * from (values {', '.join(f"('{n}', {i}, {_KINDS[n]}, {_SLOTS[n]})" for i, n in enumerate(_KINDS))}) as t(p_brand, i, quota, need)),
f as (select p_partkey, p_brand, i, need, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r, quota from part join k using (p_brand))
select p_partkey, p_brand, r::int as rank, coalesce(sum(need) over (order by i, r rows between unbounded preceding and 1 preceding), 0)::bigint as base from f where r <= quota""")
def quota_allocation(read):
    out = ranking.quotas(read("part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], _KINDS, _SLOTS)
    return out.select("p_partkey", "p_brand", "rank", "base")


@query("select event_id, value from (select *, row_number() over (order by event_id) - 1 as n from events) where n >= 3 and (n - 3) % 7 = 0")
def stride_sample(read):
    return ranking.stride(read("events"), ["event_id"], 7, first=3).select("event_id", "value")


@query("select l_orderkey, n, least(50000, coalesce(sum(n) over (order by l_orderkey rows between unbounded preceding and 1 preceding), 0))::bigint as first, sum(n) over (order by l_orderkey rows unbounded preceding) > 50000 as overflowed from (select l_orderkey, count(*) as n from lineitem group by 1)")
def exclusive_scan_cap(read):
    counts = read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return scan.exclusive_scan(counts, ["l_orderkey"], "n", "first", 50_000)


@query("select l_suppkey, n, (sum(n) over (order by l_suppkey rows unbounded preceding) - n)::bigint as \"offset\" from (select l_suppkey, count(*) as n from lineitem group by 1)")
def csr_offsets(read):
    return scan.offsets_of(read("lineitem"), "l_suppkey")


@query("select key, first, first + n as last from (select user_id as key, count(*) as n, (sum(count(*)) over (order by user_id) - count(*))::bigint as first from events group by 1)")
def run_length_ranges(read):
    return scan.runs(read("events").withColumnRenamed("user_id", "key"), "key", ["event_id"])


@query("select r1, count(*) as n from (select round(value, 0)::bigint as r1 from events) group by 1")
def nearest_pixel_counts(read):
    return read("events").groupBy(nearest_cell(F.col("value")).alias("r1")).agg(F.count("*").alias("n"))


# --- tiles and layers --------------------------------------------------------------------------------

_SPLATS = "(select vec_id, 32 + embedding[1]::double * 8 as x, 32 + embedding[2]::double * 8 as y, 1 + abs(embedding[3]::double) * 4 as r, abs(embedding[4]::double) as z from embeddings)"


def _splats(read) -> DataFrame:
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    return read("embeddings").select("vec_id", (32 + e[0] * 8).alias("x"), (32 + e[1] * 8).alias("y"), (1 + F.abs(e[2]) * 4).alias("r"), F.abs(e[3]).alias("z"))


_TILED = f"""select vec_id, z, (ty * 8 + tx)::int as tile from (
  select *, unnest(range(greatest(0, floor((x - r) / 8)::int), least(7, floor((x + r) / 8)::int) + 1)) as tx from {_SPLATS}) as a,
  lateral (select unnest(range(greatest(0, floor((y - r) / 8)::int), least(7, floor((y + r) / 8)::int) + 1)) as ty) as b"""


def _tiled(read) -> DataFrame:
    return tiles.tiles(_splats(read), F.col("x"), F.col("y"), F.col("r"), 8, 8, 8.0).select("vec_id", "z", "tile")


@query(f"select tile, count(*) as n, min(vec_id) as first, max(vec_id) as last from ({_TILED}) group by 1")
def tile_overlap_explode(read):
    return _tiled(read).groupBy("tile").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query(f"select tile, vec_id, row_number() over (partition by tile order by z, vec_id)::int as place from ({_TILED})")
def tile_sort(read):
    return tiles.order_in_tiles(_tiled(read), "tile", ["z", "vec_id"]).select("tile", "vec_id", "place")


@query(f"select tile, first, first + n as last from (select tile, count(*) as n, (sum(count(*)) over (order by tile) - count(*))::bigint as first from ({_TILED}) group by 1)")
def tile_sort_ranges(read):
    return scan.runs(_tiled(read), "tile", ["z"])


@query("""
select cluster, list(vec_id order by vec_id) as items from (
  select vec_id, ((z * 4 + y) * 4 + x)::int as cluster from (select vec_id, embedding[1]::double * 2 + 2 as a, embedding[2]::double * 2 + 2 as b, embedding[3]::double * 2 + 2 as c from embeddings) as t,
    lateral (select unnest(range(greatest(0, floor(a - 0.5)::int), least(3, floor(a + 0.5)::int) + 1)) as x) as p,
    lateral (select unnest(range(greatest(0, floor(b - 0.5)::int), least(3, floor(b + 0.5)::int) + 1)) as y) as q,
    lateral (select unnest(range(greatest(0, floor(c - 0.5)::int), least(3, floor(c + 0.5)::int) + 1)) as z) as r) group by 1""")
def clustered_lists(read):
    at = [F.col("embedding")[k].cast("double") * 2 + 2 for k in range(3)]
    return tiles.lists_by_cell(tiles.clusters(read("embeddings"), [(a - 0.5, a + 0.5) for a in at], (4, 4, 4)), "cluster", "vec_id")


@query("""
with recursive o as (select user_id, event_id, value::double as c, least(0.99, abs(value % 10) / 20)::double as a, epoch_us(ts) as z, row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (
  select user_id, 0::bigint as i, 0::double as c, 0::double as o, null::bigint as z, 0::double as b, null::bigint as d from o where i = 1
  union all
  select f.user_id, o.i, f.c + p * o.c, f.o + p, coalesce(f.z, case when shows then o.z end), case when p > f.b then p else f.b end, case when p > f.b then o.event_id else f.d end
  from f join o on o.user_id = f.user_id and o.i = f.i + 1,
    lateral (select o.a >= 1 / 255 and f.o <= 0.999 as shows) as s, lateral (select case when shows then (1 - f.o) * o.a else 0 end as p) as q)
select user_id, round(c, 4) as colour, round(o, 5) as opacity, z as depth, d as dominant from f qualify row_number() over (partition by user_id order by i desc) = 1""")
def front_to_back_composite(read):
    e = read("events")
    out = fold.composite(
        e, ["user_id"], ["ts", "event_id"], F.abs(F.col("value") % 10) / 20, F.col("value").cast("double"), F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")
    )
    return out.select("user_id", F.round("colour", 4).alias("colour"), F.round("opacity", 5).alias("opacity"), "depth", "dominant")


# --- graphs ------------------------------------------------------------------------------------------


@query("select a.l_partkey as a, b.l_partkey as b, count(*) as n from (select distinct l_orderkey, l_partkey from lineitem) a join (select distinct l_orderkey, l_partkey from lineitem) b using (l_orderkey) where a.l_partkey < b.l_partkey group by 1, 2")
def cooccurrence_pairs(read):
    return graph.occurring_together(read("lineitem"), "l_orderkey", "l_partkey")


@query("select l_partkey, count(distinct l_suppkey) as length from lineitem group by 1 having count(distinct l_suppkey) >= 2")
def track_length_stats(read):
    return graph.track_lengths(read("lineitem"), "l_partkey", "l_suppkey")


@query("""
with recursive e as (select distinct o_custkey as u, 1000000000000 + (o_orderkey // 40) as v from orders),
s as (select u, v from e union select v, u from e),
r as (select u, u as m from s union select s.v, r.m from r join s on s.u = r.u where r.m < s.v)
select u::bigint as id, min(m)::bigint as component from r group by 1""")
def connected_components(read):
    """Customers and blocks of forty orders, over all orders."""
    e = read("orders").select(F.col("o_custkey").alias("a"), F.expr("1000000000000 + o_orderkey div 40").alias("b"))
    return graph.components(e)


_USES = """(select conv_id as graph, turn as pass, (length(text) % 5)::int as resource, case when role = 'user' then 'write' else 'read' end as mode from conversations
  union select conv_id, turn, ((length(text) // 5) % 5)::int, 'read' from conversations)"""


def _uses(read) -> DataFrame:
    c = read("conversations").select(F.col("conv_id").alias("graph"), F.col("turn").alias("pass"), F.length("text").alias("_n"), "role")
    first = c.select("graph", "pass", F.expr("_n % 5").alias("resource"), F.when(F.col("role") == "user", "write").otherwise("read").alias("mode"))
    return first.unionByName(c.select("graph", "pass", F.expr("(_n div 5) % 5").cast("int").alias("resource"), F.lit("read").alias("mode"))).distinct()


_EDGES = f"""
with u as (select distinct * from {_USES}),
k as (select graph, pass, resource, bool_or(mode = 'write') as w, bool_or(mode = 'read') as r from u group by all),
e as (
  select k.graph, k.pass, max(p.pass) as needs from k join k p on p.graph = k.graph and p.resource = k.resource and p.w and p.pass < k.pass group by k.graph, k.pass, k.resource
  union
  select k.graph, k.pass, p.pass from k join k p on p.graph = k.graph and p.resource = k.resource and p.r and not p.w and p.pass < k.pass
  where k.w and not exists (select 1 from k x where x.graph = k.graph and x.resource = k.resource and x.w and x.pass < k.pass and x.pass > p.pass))"""


@query(_EDGES + " select graph, pass, needs from e")
def dag_edges(read):
    return _edges(read)


def _edges(read) -> DataFrame:
    # resources of different graphs are told apart by a joint number; passes keep theirs
    uses = _uses(read).withColumn("resource", F.col("graph") * 5 + F.col("resource"))
    return graph.dependencies(uses.withColumn("pass", F.col("graph") * 1_000_000 + F.col("pass"))).select(
        F.expr("pass div 1000000").alias("graph"), F.expr("pass % 1000000").alias("pass"), F.expr("needs % 1000000").alias("needs")
    )


@query(_EDGES + f""",
last as (select graph, max(pass) as pass from u group by 1),
l as (select graph, pass from last)
select * from (with recursive r as (select graph, pass from l union select e.graph, e.needs from r join e on e.graph = r.graph and e.pass = r.pass) select graph, pass from r)""")
def dag_live(read):
    wide = F.col("graph") * 1_000_000
    edges = _edges(read).select((wide + F.col("pass")).alias("pass"), (wide + F.col("needs")).alias("needs"))
    start = _uses(read).groupBy("graph").agg(F.max("pass").alias("pass")).select((wide + F.col("pass")).alias("id"))
    return graph.reachable(edges, start).select(F.expr("id div 1000000").alias("graph"), F.expr("id % 1000000").alias("pass"))


@query(f"select graph, resource, min(pass) as first, max(pass) as last from {_USES} group by 1, 2")
def dag_lifetimes(read):
    uses = _uses(read)
    both = uses.select("graph", F.struct("graph", "resource").alias("resource"), F.struct("graph", "pass").alias("pass"))
    places = both.select("pass", F.col("pass.pass").alias("position")).distinct()
    out = graph.lifetimes(both.select("resource", "pass"), places)
    return out.select("resource.graph", "resource.resource", "first", "last")


@query("""
with recursive n as (select 0 as id, null::int as parent, 'root' as name union all select 100 + r_regionkey, 0, r_name from region union all select 1000 + n_nationkey, 100 + n_regionkey, n_name from nation),
p as (select id, 0 as depth, name as path from n where parent is null union all select n.id, depth + 1, path || '/' || name from n join p on n.parent = p.id)
select id, depth, path from p""")
def hierarchy_paths(read):
    regions = read("region").select((100 + F.col("r_regionkey")).alias("id"), F.lit(0).alias("parent"), F.col("r_name").alias("name"))
    nations = read("nation").select((1000 + F.col("n_nationkey")).alias("id"), (100 + F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    root = regions.limit(1).select(F.lit(0).alias("id"), F.lit(None).cast("int").alias("parent"), F.lit("root").alias("name"))
    return graph.paths(root.unionByName(regions).unionByName(nations))


_TRIANGLES = "(select l_partkey as a, l_suppkey + 100000000 as b, l_orderkey // 8 + 200000000 as c from lineitem)"


def _triangles(read) -> DataFrame:
    return read("lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100_000_000).alias("b"), F.expr("l_orderkey div 8 + 200000000").alias("c"))


@query(f"""
with t as (select * from {_TRIANGLES}), e as (select least(a, b) as u, greatest(a, b) as v from t union all select least(b, c), greatest(b, c) from t union all select least(c, a), greatest(c, a) from t),
n as (select u, v, count(*) as n from e group by 1, 2), x as (select count(*) as vertices from (select a from t union select b from t union select c from t))
select vertices, count(*) as edges, (select count(*) from t) as faces, count(*) filter (where n = 1) as boundary, count(*) filter (where n > 2) as non_manifold, vertices - count(*) + (select count(*) from t) as euler
from n, x group by vertices""")
def edge_topology(read):
    return graph.topology(_triangles(read))


# --- tables ------------------------------------------------------------------------------------------


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def fk_anti_check(read):
    return tables.missing(read("documents").select("doc_id", "lang"), read("labels"), ["doc_id"])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def foreign_rows(read):
    return tables.missing(read("customer").select("c_custkey"), read("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select n_nationkey, count(s_suppkey) as matches, case when count(s_suppkey) = 0 then 'no-group' when count(s_suppkey) > 1 then 'many-groups' end as code from nation left join supplier on n_nationkey = s_nationkey group by 1")
def exactly_one_group(read):
    return tables.matches(read("nation"), read("supplier").select("s_nationkey", "s_suppkey"), "n_nationkey", "s_nationkey", "s_suppkey")


@query("select user_id, event_type, count(*) as n from events group by 1, 2 having count(*) > 1")
def duplicate_keys(read):
    return tables.duplicates(read("events"), ["user_id", "event_type"])


@query("""
select o_custkey, o_orderkey, start, reaches from (select o_custkey, o_orderkey, o_orderkey % 1000 as start, max(o_orderkey % 1000 + 50) over (partition by o_custkey order by o_orderkey % 1000, o_orderkey % 1000 + 50, o_orderkey
  rows between unbounded preceding and 1 preceding) as reaches from orders) where start < reaches""")
def interval_overlap(read):
    ranges = read("orders").select("o_custkey", "o_orderkey", F.expr("o_orderkey % 1000").alias("start"), F.expr("o_orderkey % 1000 + 50").alias("end"))
    return tables.overlaps(ranges, ["o_custkey"], "start", "end", "o_orderkey")


_BLOCKS = "(select distinct floor(embedding[1] * 2 + 4)::bigint as bx, floor(embedding[2] * 2 + 4)::bigint as \"by\", floor(embedding[3] * 2 + 4)::bigint as bz from embeddings where label {})"


def _blocks(read, labels: str) -> DataFrame:
    return read("embeddings").where(f"label {labels}").select(*(F.floor(F.col("embedding")[k].cast("double") * 2 + 4).alias(a) for k, a in enumerate(("bx", "by", "bz")))).distinct()


@query(f"select distinct bx - dx as bx, \"by\" - dy as \"by\", bz - dz as bz from {_BLOCKS.format('< 3')}, (select unnest([0, 1]) as dx), (select unnest([0, 1]) as dy), (select unnest([0, 1]) as dz) where bx >= dx and \"by\" >= dy and bz >= dz")
def dirty_neighbours(read):
    return tiles.owners(_blocks(read, "< 3"))


@query("""
with o as (select o_custkey, sum(o_totalprice) as total, count(*) as n from orders where o_orderstatus = 'F' group by 1), n as (select o_custkey, sum(o_totalprice) as total, count(*) as n from orders where o_orderstatus = 'O' group by 1)
select coalesce(o.o_custkey, n.o_custkey) as o_custkey, round(coalesce(o.total, 0) + coalesce(n.total, 0), 2) as total, coalesce(n.n, o.n) as n from o full join n on o.o_custkey = n.o_custkey""")
def keyed_upsert(read):
    def part(status: str) -> DataFrame:
        return read("orders").where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))

    out = tables.upserted(part("F"), part("O"), ["o_custkey"], lambda c: F.col("old.total") + F.col("new.total") if c == "total" else F.col(f"new.{c}"))
    return out.select("o_custkey", F.round("total", 2).alias("total"), "n")


@query("""
select p_partkey, p_size from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)
union all select p_partkey, p_size + 100 from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45) and p_size > 25""")
def patch_upsert(read):
    old = read("part").select("p_partkey", "p_size")
    touched = read("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    new = old.where("p_size > 25").withColumn("p_size", F.col("p_size") + 100)
    return tables.patched(old, new, touched, ["p_partkey"])


@query("select n_name from nation where n_nationkey in (select c_nationkey from customer) intersect select n_name from nation where n_nationkey in (select s_nationkey from supplier)")
def name_intersect(read):
    n = read("nation")
    customers = n.join(read("customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    return tables.shared(customers, [n.join(read("supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")], "n_name")


@query("select distinct event_type as field from events where event_type not in ('view', 'click')")
def unknown_fields(read):
    fields = read("events").select(F.col("event_type").alias("field")).distinct()
    return fields.join(fields.where("field in ('view', 'click')"), "field", "left_anti")


# --- images ------------------------------------------------------------------------------------------

_PIXELS = "(select vec_id as image, (i % 8)::int as x, (i // 8)::int as y, (embedding[i + 1] * 100)::double as value from embeddings, range(64) as t(i))"


def _pixels(read) -> DataFrame:
    e = read("embeddings").select("vec_id", F.transform("embedding", lambda v: (v * F.lit(100).cast("float")).cast("double")).alias("v"))
    return images.pixels_of(e, "vec_id", "v", 8)


@query(f"select image, (x // 2)::int as cx, (y // 2)::int as cy, floor(round(sum(value), 6) / count(*))::bigint as value from {_PIXELS} group by 1, 2, 3")
def block_fingerprint(read):
    return images.fingerprint(_pixels(read).withColumn("value", F.col("value")), 8, 8, 4)


@query(f"""
with p as (select * from {_PIXELS}), r as (select c.image, 4 * c.value - w.value - e.value - n.value - s.value as r from p c join p w on w.image = c.image and w.x = c.x - 1 and w.y = c.y
  join p e on e.image = c.image and e.x = c.x + 1 and e.y = c.y join p n on n.image = c.image and n.x = c.x and n.y = c.y - 1 join p s on s.image = c.image and s.x = c.x and s.y = c.y + 1)
select image, round(avg(r * r), 2) as energy from r group by 1""")
def laplacian_energy(read):
    return images.laplacian_energy(_pixels(read)).select("image", F.round("energy", 2).alias("energy"))


@query(f"""
with p as (select image, x, y, case when value >= 0 then value end as value from {_PIXELS})
select p.image, p.x, p.y, round(coalesce(p.value, avg(q.value)), 5) as value from p left join p q on q.image = p.image and abs(q.x - p.x) + abs(q.y - p.y) = 1 group by p.image, p.x, p.y, p.value""")
def dilate_once(read):
    holes = _pixels(read).withColumn("value", F.when(F.col("value") >= 0, F.col("value")))
    return images.dilated(holes, 1).select("image", "x", "y", F.round("value", 5).alias("value"))


@query(f"""
with p as (select * from {_PIXELS})
select p.image, p.x, p.y, round(min(q.value), 5) as low, round(max(q.value), 5) as high from p join p q on q.image = p.image and abs(q.x - p.x) <= 1 and abs(q.y - p.y) <= 1 group by 1, 2, 3""")
def neighbourhood_minmax(read):
    return images.neighbourhood(_pixels(read)).select("image", "x", "y", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("""
with a as (select vec_id, embedding::double[] as e, lead(embedding::double[]) over (partition by label order by vec_id) as f from embeddings),
m as (select vec_id, list_sum(e) as se, list_sum(f) as sf, list_dot_product(e, e) as ee, list_dot_product(f, f) as ff, list_dot_product(e, f) as ef from a where f is not null)
select vec_id, round(0.5 * (1 - (ef - se * sf / 64) / sqrt((ee - se * se / 64) * (ff - sf * sf / 64))), 6) as distance from m""")
def pearson_appearance(read):
    from pyspark.sql import Window

    e = read("embeddings").withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("next is not null")
    return e.select("vec_id", r6(pearson_distance(F.col("embedding"), F.col("next"), 64), "distance"))


# --- sequences ---------------------------------------------------------------------------------------

_ADMIT = {"pending": 2, "depth": 0.2, "clipped": 0.95, "sharpness": 0.25, "interval": 3600.0, "motion": 20.0, "stationary": 86400.0}


@query(f"""
with recursive o as (select user_id, event_id, {_SECONDS} as t, value::double as p, event_id % 4 as q, (event_id % 11) / 10 as d, (event_id % 13) / 12 as c, (event_id % 7) / 6 as s,
  row_number() over (partition by user_id order by ts, event_id) as i from events),
f as (
  select user_id, 0::bigint as i, null::bigint as event_id, null::double as t, null::double as p, ''::varchar as reason from o where i = 1
  union all
  select f.user_id, o.i, o.event_id, case when r in ('first-frame', 'useful-motion', 'stationary-refresh') then o.t else f.t end, case when r in ('first-frame', 'useful-motion', 'stationary-refresh') then o.p else f.p end, r
  from f join o on o.user_id = f.user_id and o.i = f.i + 1, lateral (select case when o.q > 2 then 'writer-pressure' when o.d < 0.2 then 'unusable-depth' when o.c > 0.95 then 'extreme-exposure'
    when o.s < 0.25 then 'unusably-soft' when f.t is null then 'first-frame' when o.t - f.t < 3600 then 'rate-limited' when abs(o.p - f.p) >= 20 then 'useful-motion'
    when o.t - f.t >= 86400 then 'stationary-refresh' else 'insufficient-motion' end as r) as x)
select user_id, event_id, reason in ('first-frame', 'useful-motion', 'stationary-refresh') as accepted, reason from f where i > 0""")
def admission_policy(read):
    e = read("events")

    def part(n: int):
        return F.pmod("event_id", F.lit(n)) / (n - 1)

    return fold.admission(
        e, ["user_id"], ["ts", "event_id"], seconds(), F.col("value").cast("double"), F.pmod("event_id", F.lit(4)), part(11), part(13), part(7), {"event_id": F.col("event_id")}, _ADMIT
    )


@query("""
with recursive o as (select user_id, event_id, value::double as m, case when event_type = 'purchase' then 'relative-blur' when value < 1 then 'underexposed' end as r, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events),
f as (
  select user_id, -1::bigint as i, null::bigint as event_id, null::bigint as at, null::double as m, ''::varchar as reason from o where i = 0
  union all
  select f.user_id, o.i, o.event_id, case when x in ('sequence-start', 'maximum-gap', 'useful-change') then o.i else f.at end, case when x in ('sequence-start', 'maximum-gap', 'useful-change') then o.m else f.m end, x
  from f join o on o.user_id = f.user_id and o.i = f.i + 1, lateral (select case when o.r is not null then o.r when f.at is null then 'sequence-start' when o.i - f.at < 2 then 'minimum-spacing'
    when abs(o.m - f.m) > 60 then 'appearance-discontinuity' when abs(o.m - f.m) < case when o.i - f.at >= 5 then 2.5 else 10 end then 'near-duplicate' when o.i - f.at >= 5 then 'maximum-gap' else 'useful-change' end as x) as y)
select user_id, event_id, reason in ('sequence-start', 'maximum-gap', 'useful-change') as selected, reason from f where i >= 0""")
def keyframe_select(read):
    rejected = F.when(F.col("event_type") == "purchase", "relative-blur").when(F.col("value") < 1, "underexposed")
    out = fold.keyframes(read("events"), ["user_id"], ["ts", "event_id"], F.col("value").cast("double"), rejected, {"event_id": F.col("event_id")}, 2, 5, 10.0, 60.0)
    return out.drop("gap")


# --- fitting -----------------------------------------------------------------------------------------

_PAIRS = "(select a.vec_id, a.embedding[1]::double as sx, a.embedding[2]::double as sy, a.embedding[3]::double as sz, 2 * a.embedding[2]::double + 1 + a.embedding[4]::double * 0.01 as tx, -2 * a.embedding[1]::double + 3 as ty, 2 * a.embedding[3]::double - 1 as tz from embeddings a)"


def _pose_pairs(read) -> DataFrame:
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    return read("embeddings").select("vec_id", e[0].alias("sx"), e[1].alias("sy"), e[2].alias("sz"), (2 * e[1] + 1 + e[3] * 0.01).alias("tx"), (-2 * e[0] + 3).alias("ty"), (2 * e[2] - 1).alias("tz"))


@query("select count(*) as n, " + ", ".join(f"round(sum(t{a} * s{b}), 4) as t{a}s{b}" for a in "xyz" for b in "xyz") + f" from {_PAIRS}")
def similarity_moments(read):
    m = align.moments(_pose_pairs(read))
    return m.select("n", *(F.round(f"t{a}s{b}", 4).alias(f"t{a}s{b}") for a in "xyz" for b in "xyz"))


@query()
def similarity_fit(read):
    pairs = _pose_pairs(read)
    fit = align.robust_fit(pairs, align.fit(pairs), 0.1, 0.02)
    return fit.residual(pairs).select("vec_id", r6(F.col("residual"), "residual"))


@query("""
with m0 as (select l_suppkey, avg(l_extendedprice) as m from lineitem group by 1),
m1 as (select l_suppkey, sum(least(1, 5000 / greatest(abs(l_extendedprice - m), 1e-12)) * l_extendedprice) / sum(least(1, 5000 / greatest(abs(l_extendedprice - m), 1e-12))) as m from lineitem join m0 using (l_suppkey) group by 1),
m2 as (select l_suppkey, sum(least(1, 5000 / greatest(abs(l_extendedprice - m), 1e-12)) * l_extendedprice) / sum(least(1, 5000 / greatest(abs(l_extendedprice - m), 1e-12))) as m from lineitem join m1 using (l_suppkey) group by 1)
select l_suppkey, round(m, 3) as mean from m2""")
def huber_weighted_mean(read):
    return align.robust_mean(read("lineitem"), ["l_suppkey"], "l_extendedprice", 5000.0, 2).select("l_suppkey", F.round("mean", 3).alias("mean"))


# --- gates and records ---------------------------------------------------------------------------------


@query("""
select l_partkey, n, suppliers, concat_ws(',', case when n < 20 then 'tracked' end, case when suppliers < 4 then 'connected' end, case when price < 20000 then 'baseline' end) as failures
from (select l_partkey, count(*) as n, count(distinct l_suppkey) as suppliers, max(l_extendedprice) as price from lineitem group by 1)""")
def coverage_gate(read):
    m = read("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.max("l_extendedprice").alias("price"))
    rules = {"tracked": F.col("n") < 20, "connected": F.col("suppliers") < 4, "baseline": F.col("price") < 20000}
    return m.select("l_partkey", "n", "suppliers", gates.failures(rules).alias("failures"))


@query("""
select 'error' as severity, 'empty' as code, doc_id from documents where text is null or text = '' union all
select 'warning', 'count', doc_id from documents where n_chars <> length(text) union all
select 'warning', 'short', doc_id from documents where length(text) < 100""")
def quality_issues(read):
    rules = {
        "empty": ("error", F.col("text").isNull() | (F.col("text") == "")),
        "count": ("warning", F.col("n_chars") != F.length("text")),
        "short": ("warning", F.length("text") < 100),
    }
    return gates.issues(read("documents"), rules, ["doc_id"])


@query("""
select user_id, ['passed', 'skipped', 'failed'][1 + max(case event_type when 'purchase' then 2 when 'click' then 1 else 0 end)] as status, count(*) as steps, bool_or(event_type = 'purchase') as failed from events group by 1""")
def run_rollup(read):
    status = F.when(F.col("event_type") == "purchase", "failed").when(F.col("event_type") == "click", "skipped").otherwise("passed")
    return gates.rolled_up(read("events").withColumn("status", status), ["user_id"], "status", ("passed", "skipped", "failed"))


@query("select source, sha256(string_agg(doc_id::varchar || chr(0) || sha256(text) || chr(0), '' order by doc_id)) as fingerprint from documents group by 1")
def sha256_fingerprint(read):
    d = read("documents").withColumn("digest", F.sha2("text", 256))
    return gates.fingerprint(d, ["source"], "doc_id", ["doc_id", "digest"])


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_extract_string(props, '$.k') is not null")
def json_fields(read):
    return read("events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k is not null")


@query("select doc_id, (length(t) - length(replace(t, chr(10), '')))::bigint as records, length(t) - (case when contains(t, chr(10)) then length(t) - position(chr(10) in reverse(t)) + 1 else 0 end) as discarded from (select doc_id, text as t from documents)")
def ndjson_recovery(read):
    t = F.col("text")
    last = F.instr(F.reverse(t), F.lit("\n"))
    whole = F.when(last > 0, F.length(t) - last + 1).otherwise(0)
    return read("documents").select("doc_id", (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("records"), (F.length(t) - whole).cast("long").alias("discarded"))


@query("""
select conv_id, turn, k, a, b from (select conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') as w from conversations), lateral (select unnest(range(0, len(w) // 2)) as k), lateral (select w[2 * k + 1] as a, w[2 * k + 2] as b)""")
def parse_sfm_track(read):
    from terrace.sources.sfm import pairs_of

    return read("conversations").select("conv_id", "turn", F.posexplode(pairs_of(F.filter(F.split("text", " "), lambda w: w != ""))).alias("k", "_p")).select(
        "conv_id", "turn", F.col("k").cast("long").alias("k"), F.col("_p.a").alias("a"), F.col("_p.b").alias("b")
    )


@query("""
select page_id, path, path <> '' and not starts_with(path, '/') and not contains(path, '\\') and not list_bool_or(list_transform(string_split(path, '/'), lambda p: p in ('', '.', '..'))) as safe
from (select page_id, split_part(url, '://', 2) as path from pages)""")
def path_safety(read):
    return read("pages").select("page_id", F.split_part("url", F.lit("://"), F.lit(2)).alias("path")).select("page_id", "path", safe_path(F.col("path")).alias("safe"))


@query("""
select vec_id, xor(y >> 13, y)::bigint as colour from (select vec_id, ((xor(x >> 16, x) * 277803737) & 4294967295) as y from (select vec_id, ((vec_id * 747796405 + 2891336453) & 4294967295) as x from embeddings))""")
def id_colours(read):
    return read("embeddings").select("vec_id", id_colour(F.col("vec_id")).alias("colour"))


@query("select o_orderkey, round(" + " + ".join(f"((o_orderkey // {2**k}) % 2) / {2 ** (k + 1)}.0::double" for k in range(20)) + ", 6) as u from orders")
def low_discrepancy(read):
    return read("orders").select("o_orderkey", r6(radical_inverse(F.col("o_orderkey"), 2, 20), "u"))


@query("select vec_id, round((embedding[1]::double * 60 - 31.5) * z / 60, 6) as x, round((embedding[2]::double * 60 - 31.5) * z / 60, 6) as y, round(z, 6) as z from (select *, 1 + abs(embedding[3]::double) as z from embeddings)")
def pinhole_unproject(read):
    from terrace.functions.geometry import unproject

    e = [F.col("embedding")[k].cast("double") for k in range(3)]
    f, c = F.lit(60.0), F.lit(31.5)
    v = unproject(e[0] * 60, e[1] * 60, 1 + F.abs(e[2]), f, f, c, c)
    return read("embeddings").select("vec_id", *(r6(x, n) for x, n in zip(v, "xyz", strict=True)))


# --- baking and splats -----------------------------------------------------------------------------

#: Corners of screen triangles made of embeddings, in pixels and depths.
_CORNERS = {f"{a}{k}": (3 * k + i, 8.0 if a != "z" else 1.0, 16.0 if a != "z" else 2.0) for k in range(3) for i, a in enumerate("xyz")}
_SCREEN = 32


@query(f"""
with t as (select label as camera, {", ".join(f"embedding[{i + 1}]::double * {m} + {b} as {n}" for n, (i, m, b) in _CORNERS.items())} from embeddings),
u as (select *, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) as area from t where z0 > 1e-8 and z1 > 1e-8 and z2 > 1e-8),
p as (
  select *, unnest(generate_series(greatest(0, floor(least(x0, x1, x2))::bigint), least({_SCREEN - 1}, floor(greatest(x0, x1, x2))::bigint))) as px
  from (select *, unnest(generate_series(greatest(0, floor(least(y0, y1, y2))::bigint), least({_SCREEN - 1}, floor(greatest(y0, y1, y2))::bigint))) as py from u where abs(area) > 1e-12)),
w as (select *, ((x2 - x1) * (py + 0.5 - y1) - (px + 0.5 - x1) * (y2 - y1)) / area as wa, ((x0 - x2) * (py + 0.5 - y2) - (px + 0.5 - x2) * (y0 - y2)) / area as wb,
  ((x1 - x0) * (py + 0.5 - y0) - (px + 0.5 - x0) * (y1 - y0)) / area as wc from p)
select camera, px::integer as px, py::integer as py, round(min(1 / (wa / z0 + wb / z1 + wc / z2)), 6) as depth from w where wa >= 0 and wb >= 0 and wc >= 0 group by all""")
def depth_rasterise(read):
    t = read("embeddings").select(F.col("label").alias("camera"), *((F.col("embedding")[i].cast("double") * m + b).alias(n) for n, (i, m, b) in _CORNERS.items()))
    return bake.depth_map(t, ["camera"], _SCREEN, _SCREEN).select("camera", "px", "py", r6(F.col("depth"), "depth"))


@query("""
with s as (select l_partkey, l_suppkey, max(least(l_discount + 0.2, 1) * greatest(0.05, least(1, least(l_quantity, 51 - l_quantity) / 51 * 8)) / greatest((1 + l_tax) * (1 + l_tax), 1e-4)) as score from lineitem group by 1, 2)
select l_partkey, l_suppkey, round(score, 6) as score, rank::integer as rank from (select *, row_number() over (partition by l_partkey order by score desc, l_suppkey) as rank from s) where rank <= 4""")
def best_views(read):
    x, edge = F.col("l_quantity"), F.lit(51.0)
    score = bake.view_score(F.least(F.col("l_discount") + 0.2, F.lit(1.0)), x, x, 1 + F.col("l_tax"), edge, edge)
    s = read("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(score).alias("score"))
    return bake.best_views(s, "l_partkey", "l_suppkey", "score").select("l_partkey", "l_suppkey", r6(F.col("score"), "score"), "rank")


@query("""
with m as (select o_orderpriority as camera, list(ln(o_totalprice) order by o_totalprice)[count(*) // 2 + 1] as m from orders group by 1),
t as (select list(m order by m)[count(*) // 2 + 1] as t from m)
select camera, round(greatest(0.25, least(4, exp(t - m))), 6) as gain from m, t""")
def exposure_gains(read):
    o = read("orders").select(F.col("o_orderpriority").alias("camera"), F.col("o_totalprice").alias("l"))
    return bake.exposure_gains(o, "camera", "l", 4.0).select("camera", r6(F.col("gain"), "gain"))


@query("""
with n as (select count(*) as n, ceil(sqrt(count(*)))::bigint as c from part), g as (select c, least(4096 // c, 4096 // ((n + c - 1) // c)) as cell from n),
p as (select p_partkey, row_number() over (order by p_partkey) - 1 as k from part)
select p_partkey, ((k % c) * cell + 1)::bigint as tile_x, ((k // c) * cell + 1)::bigint as tile_y, (cell - 2)::integer as inner_size from p, g""")
def atlas_cells(read):
    p = scan.numbered(read("part"), ["p_partkey"], "k")
    return bake.atlas_cells(p, "k", read("part").count(), 4096, 1, least=None).select("p_partkey", F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y"), F.col("inner").alias("inner_size"))


@query("""
with d as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding as e from embeddings),
u as (select vec_id, e, x / sqrt(x * x + y * y + z * z) as x, y / sqrt(x * x + y * y + z * z) as y, z / sqrt(x * x + y * y + z * z) as z from d)
select vec_id, round(greatest(0, 0.5 + 0.28209479177387814::double * e[4] + 0.4886025119029199::double * (z * e[6] - y * e[5] - x * e[7])), 6) as colour from u""")
def splat_colour(read):
    e = [F.col("embedding")[k].cast("double") for k in range(7)]
    return read("embeddings").select("vec_id", r6(splats.colour(e[3:7], tuple(e[:3]), 1), "colour"))


#: Images on top of each other as a field of distances.
_FIELD = "(select x::bigint as x, y::bigint as y, image::bigint as z, value::double as d from " + _PIXELS + ")"
_AXES = "(values (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) as a(axis, dx, dy, dz)"


def _field(read):
    return _pixels(read).select("x", "y", F.col("image").alias("z"), F.col("value").alias("distance"))


@query(f"""
with g as (select * from {_FIELD}),
c as (select p.x as cx, p.y as cy, p.z as cz, q.x - p.x as i, q.y - p.y as j, q.z - p.z as k, q.d from g p join g q on q.x in (p.x, p.x + 1) and q.y in (p.y, p.y + 1) and q.z in (p.z, p.z + 1)),
w as (select cx, cy, cz from c group by all having count(*) = 8),
e as (
  select c.cx + c.i as x, c.cy + c.j as y, c.cz + c.k as z, dx, dy, dz, c.d as near, n.d as far
  from c join w using (cx, cy, cz) cross join {_AXES} join c n on n.cx = c.cx and n.cy = c.cy and n.cz = c.cz and n.i = c.i + dx and n.j = c.j + dy and n.k = c.k + dz)
select distinct concat_ws(',', x, y, z, x + dx, y + dy, z + dz) as id, round(x + near / (near - far) * dx, 6) as x, round(y + near / (near - far) * dy, 6) as y,
  round(z + near / (near - far) * dz, 6) as z from e where (near < 0) <> (far < 0)""")
def isosurface_vertices(read):
    vertices, _ = voxels.welded(voxels.surface(_field(read), (0.0, 0.0, 0.0), 1.0, resolved=False))
    return vertices.select("id", *(r6(F.col(a), a) for a in "xyz"))


@query(f"""
with g as (select * from {_FIELD}),
c as (select p.x as cx, p.y as cy, p.z as cz, q.x - p.x as i, q.y - p.y as j, q.z - p.z as k, q.d from g p join g q on q.x in (p.x, p.x + 1) and q.y in (p.y, p.y + 1) and q.z in (p.z, p.z + 1)),
w as (select cx, cy, cz from c group by all having count(*) = 8)
select concat_ws(',', cx, cy, cz) as cell, count(*) as triangles
from c join w using (cx, cy, cz) cross join {_AXES} join c n using (cx, cy, cz) where n.i = c.i + dx and n.j = c.j + dy and n.k = c.k + dz and (c.d < 0) <> (n.d < 0) group by cx, cy, cz""")
def isosurface_triangles(read):
    """A loop of n crossed edges is fanned into n triangles around its mean, so a cell has as many as crossed edges."""
    return voxels.surface(_field(read), (0.0, 0.0, 0.0), 1.0).groupBy("cell").agg(F.count("*").alias("triangles"))
