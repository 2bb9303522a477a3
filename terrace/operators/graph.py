"""Graphs: pairs that occur together, components, dependencies, lineage and mesh topology."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.lineage import cut
from terrace.operators.nearest import paired


def occurring_together(df: DataFrame, group: str, item: str) -> DataFrame:
    """``(a, b, n)`` with a < b: how many groups hold both items; groups of one item give none.

    Large groups are dealt out in blocks, of which every two meet in a place of their own.
    """
    items = df.select(group, item).distinct()
    pairs = paired(items, group, item).select(F.col(item).alias("a"), F.col(f"{item}2").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def track_lengths(df: DataFrame, point: str, image: str, least: int = 2) -> DataFrame:
    """``(point, length)``: distinct images of each point seen by at least ``least``."""
    return df.groupBy(point).agg(F.countDistinct(image).alias("length")).where(F.col("length") >= least)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """``(id, component)``: the smallest id reachable, by hooking to the smallest neighbour and halving paths.

    Every round joins edges with labels twice and is written to the checkpoint
    folder; rounds grow with the logarithm of the longest path. Raises if
    ``most_rounds`` don't suffice.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(seen, "u").select("u", F.least("label", "near").alias("label"))
        jump = lower.select(F.col("u").alias("label"), F.col("label").alias("far"))
        new = cut(lower.join(jump, "label", "left").select("u", F.least("label", F.coalesce("far", "label")).alias("label")))
        if new.join(labels.select("u", F.col("label").alias("old")), "u").where("label <> old").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("label").alias("component"))
        labels = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def dependencies(uses: DataFrame) -> DataFrame:
    """``(pass, needs)`` from uses ``(pass, resource, mode)`` in order of pass: what must have run before.

    A read needs the last writer before; a write needs the last writer and all
    who read since. Within one pass reads come first.
    """
    writes = uses.where("mode = 'write'").select("pass", "resource").distinct()
    all_uses = uses.select("pass", "resource", "mode").distinct()
    order = Window.partitionBy("resource").orderBy("pass")
    writer = F.when(F.col("mode") == "write", F.col("pass"))
    last = all_uses.withColumn("_w", F.max(writer).over(order.rangeBetween(Window.unboundedPreceding, -1)))
    after_writer = last.where("_w is not null").select("pass", F.col("_w").alias("needs"))
    next_write = last.withColumn("_next", F.min(writer).over(order.rangeBetween(1, Window.unboundedFollowing)))
    own = writes.withColumn("_own", F.lit(True))
    readers = next_write.where("mode = 'read'").join(own, ["pass", "resource"], "left")
    before_write = readers.where("_own is null and _next is not null").select(F.col("_next").alias("pass"), F.col("pass").alias("needs"))
    # a pass that also writes what it reads is the next writer itself; whoever writes next needs it as writer
    return after_writer.unionByName(before_write).distinct()


def live(edges: Iterable[tuple[int, int]], required: Iterable[int]) -> set[int]:
    """Passes that required ones need, themselves included. Graphs of passes are small: plain Python."""
    needs: dict[int, list[int]] = {}
    for p, q in edges:
        needs.setdefault(p, []).append(q)
    seen, todo = set(required), list(required)
    while todo:
        for q in needs.get(todo.pop(), ()):
            if q not in seen:
                seen.add(q)
                todo.append(q)
    return seen


def reachable(edges: DataFrame, start: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(id)``: what rows ``(id)`` of ``start`` reach over edges ``(pass, needs)``, themselves included."""
    seen = cut(start.select("id").distinct())
    front = seen
    for _ in range(most_rounds):
        front = cut(edges.join(front, edges["pass"] == front["id"]).select(F.col("needs").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    raise RuntimeError(f"edges reach farther than {most_rounds} steps")


def schedule(nodes: Iterable[int], edges: Iterable[tuple[int, int]]) -> list[int]:
    """An order in which every node follows what it needs: first come, first served from the smallest; raises on a cycle."""
    wanted = sorted(nodes)
    edges = sorted({(p, q) for p, q in edges})
    inside = set(wanted)
    waits = {n: 0 for n in wanted}
    frees: dict[int, list[int]] = {}
    for p, q in edges:
        if p in inside and q in inside:
            waits[p] += 1
            frees.setdefault(q, []).append(p)
    ready, out = deque(n for n in wanted if not waits[n]), []
    while ready:
        n = ready.popleft()
        out.append(n)
        for p in frees.get(n, ()):
            waits[p] -= 1
            if not waits[p]:
                ready.append(p)
    if len(out) != len(wanted):
        raise ValueError("the graph has a cycle")
    return out


def lifetimes(uses: DataFrame, positions: DataFrame) -> DataFrame:
    """``(resource, first, last)``: places in the order of live passes ``(pass, position)`` between which it is needed."""
    return uses.join(positions, "pass").groupBy("resource").agg(F.min("position").alias("first"), F.max("position").alias("last"))


def dot_text(nodes: Iterable[tuple[int, str]], edges: Iterable[tuple[int, int]]) -> str:
    """A graph in DOT."""
    lines = [f'  n{i} [label="{name}"];' for i, name in sorted(nodes)] + [f"  n{q} -> n{p};" for p, q in sorted(edges)]
    return "\n".join(["digraph passes {", *lines, "}"])


def paths(nodes: DataFrame, most_depth: int = 32) -> DataFrame:
    """``(id, depth, path)`` from ``(id, parent, name)``: names from the root down; raises on cycles and greater depth."""
    level = nodes.where("parent is null").select("id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    out, n = level, nodes.count()
    for depth in range(1, most_depth):
        level = nodes.join(level.select(F.col("id").alias("parent"), F.col("path").alias("_p")), "parent").select(
            "id", F.lit(depth).alias("depth"), F.concat_ws("/", "_p", "name").alias("path")
        )
        level = cut(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    if out.count() != n:
        raise ValueError("some nodes hang on no root: a cycle, a missing parent, or a tree deeper than allowed")
    return out


def edge_use(triangles: DataFrame) -> DataFrame:
    """``(u, v, n)``: undirected edges of triangles ``(a, b, c)`` and how many triangles use each."""
    ends = F.explode(F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    return triangles.select(ends.alias("_e")).groupBy("_e.u", "_e.v").agg(F.count("*").alias("n"))


def topology(triangles: DataFrame) -> DataFrame:
    """One row: vertices, edges, faces, boundary and non-manifold edges, Euler number."""
    edges = edge_use(triangles).agg(
        F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("non_manifold")
    )
    corners = triangles.select(F.explode(F.array("a", "b", "c")).alias("v")).agg(F.countDistinct("v").alias("vertices"))
    faces = triangles.agg(F.count("*").alias("faces"))
    one = edges.join(F.broadcast(corners)).join(F.broadcast(faces))
    return one.select("vertices", "edges", "faces", "boundary", "non_manifold", (F.col("vertices") - F.col("edges") + F.col("faces")).alias("euler"))
