"""Keys, references, overlaps and changes of keyed tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.numeric import safe_path


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other table doesn't have."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def matches(df: DataFrame, groups: DataFrame, key: str, group_key: str, group: str) -> DataFrame:
    """``(key, matches, code)``: how many groups each row belongs to; ``code`` unless it is exactly one."""
    found = df.select(key).join(groups.select(F.col(group_key).alias(key), group), key, "left").groupBy(key).agg(F.count(group).alias("matches"))
    code = F.when(F.col("matches") == 0, "no-group").when(F.col("matches") > 1, "many-groups")
    return found.withColumn("code", code)


def overlaps(df: DataFrame, by: list[str], start: str, end: str, identity: str) -> DataFrame:
    """Ranges that begin before one that begins no later has ended: ``(*by, identity, start, reaches)``."""
    order = Window.partitionBy(*by).orderBy(start, end, identity).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reaches", F.max(end).over(order)).where(F.col(start) < F.col("reaches")).select(*by, identity, start, "reaches")


def listed(df: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """The rows whose name a list has, however often: a semi join."""
    return df.join(names.select(name), name, "left_semi").select(*df.columns)


def shared(df: DataFrame, others: list[DataFrame], name: str) -> DataFrame:
    """The distinct names that ``df`` and all of the others have."""
    out = df.select(name)
    for other in others:
        out = out.intersect(other.select(name))
    return out


def list_problems(df: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """``(name, code)`` of the entries of a list that are no safe path, come twice, or name nothing in ``df``."""
    counted = names.groupBy(name).agg(F.count("*").alias("_n")).join(df.select(name).distinct().withColumn("_there", F.lit(True)), name, "left")
    code = F.when(~safe_path(F.col(name)), "path").when(F.col("_n") > 1, "duplicate").when(F.col("_there").isNull(), "missing")
    return counted.withColumn("code", code).where("code is not null").select(name, "code")


def budgets(df: DataFrame, limits: dict[str, tuple[Column, int]]) -> DataFrame:
    """``(budget, used, most, exceeded)``: a row for each budget ``name: (aggregate, most)``, all of one pass over ``df``."""
    used = df.agg(*(F.coalesce(x.cast("long"), F.lit(0).cast("long")).alias(name) for name, (x, _) in limits.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("budget"), F.col(name).alias("used"), F.lit(most).cast("long").alias("most")) for name, (_, most) in limits.items()))
    return used.select(F.inline(rows)).withColumn("exceeded", F.col("used") > F.col("most"))


def within(df: DataFrame, limits: dict[str, tuple[Column, int]]) -> DataFrame:
    """``df`` if it is within all of its budgets; a ValueError that names the first one exceeded, before anything is written."""
    bad = budgets(df, limits).where("exceeded").first()
    if bad is not None:
        raise ValueError(f"{bad['budget']} is {bad['used']}, above its budget of {bad['most']}")
    return df


def patched(old: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of touched keys replaced by those of ``new``, and gone where ``new`` has none."""
    return old.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(new.join(touched.select(*keys).distinct(), keys, "left_semi"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], merge: Callable[[str], Column] | None = None) -> DataFrame:
    """``old`` with rows of ``new`` put in by key; ``merge`` makes a column of ``old.c`` and ``new.c`` where both are."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("old"))
    b = new.select(*keys, F.struct(*values).alias("new"))
    both = a.join(b, keys, "full_outer")
    made = {c: merge(c) if merge else F.col(f"new.{c}") for c in values}
    return both.select(
        *keys,
        *(
            F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(made[c]).alias(c)
            for c in values
        ),
    )


class Versions:
    """A table kept as numbered versions in a folder, each published whole or not at all.

    A version is written under a name of its own and renamed once complete; a
    budget or a rule that fails before leaves the table as it was. Readers hold on
    to the version they opened.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path(".").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The newest version, -1 if there is none."""
        fs = self._fs()
        if not fs.exists(self._path(".")):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(self._path("."))]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.latest() if version is None else version:09d}")

    def publish(self, df: DataFrame, expected: int, most_rows: int | None = None) -> int:
        """Publishes after version ``expected``; raises if that isn't the newest or a budget is exceeded."""
        if self.latest() != expected:
            raise ValueError(f"version {expected} is stale; the newest is {self.latest()}")
        room = f"open-{uuid.uuid4().hex}"
        fs = self._fs()
        df.write.parquet(f"{self.folder}/{room}")
        rows = self.spark.read.parquet(f"{self.folder}/{room}").count()
        if most_rows is not None and rows > most_rows:
            fs.delete(self._path(room), True)
            raise ValueError(f"{rows} rows exceed the budget of {most_rows}")
        if not fs.rename(self._path(room), self._path(f"v{expected + 1:09d}")):
            fs.delete(self._path(room), True)
            raise ValueError(f"version {expected + 1} exists")
        return expected + 1
