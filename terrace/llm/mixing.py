"""Mixing sources to target weights by hierarchical budgets and seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.common import small, written

#: Hash ranges of a leaf; only the range in which its budget ends is put in order.
RANGE_DIGITS = 3
LEVELS = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    """Tokens of a text: its runs of anything but ASCII white space; 0 for null."""
    parts = F.size(F.split(text, "[\\x20\\x09-\\x0D]+"))
    empty_ends = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0) + F.when(text.rlike("[\\x20\\x09-\\x0D]\\z"), 1).otherwise(0)
    return F.when(text.isNull() | ~text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(0)).otherwise(parts - empty_ends).cast("long")


def weight_of(level: str, weights: Mapping[str, int], default: int) -> Column:
    """Whole-number weight of a node by its name; ``default`` for names not listed."""
    out = F.lit(default)
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def split_budget(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``quota``: each parent's ``budget`` over its children by ``weight``, none above its ``cap``.

    Children in ascending order of cap for weight fill up while their cap is at
    most their part of what is left; what they leave over goes to the others by
    weight, so a shortage stays among siblings. Whole tokens: the parts are cut
    down, and the tokens this leaves go to the largest remainders, then by name.
    A budget above the sum of caps must have been lowered by the caller.
    """
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("cap") / F.col("weight"), key)
    done = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    wide = "cast({} as decimal(38,0))".format
    out = (
        nodes.withColumn("_left", F.col("budget") - F.coalesce(F.sum("cap").over(done), F.lit(0)))
        .withColumn("_share", F.sum("weight").over(rest))
        .withColumn("_full", F.expr(f"{wide('cap')} * _share <= {wide('weight')} * _left"))
    )
    # the first child that doesn't fill up has what is left, and the weight it is shared by
    first = family.orderBy("_full", F.col("cap") / F.col("weight"), key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_left", F.first("_left").over(first)).withColumn("_share", F.first("_share").over(first))
    product = wide(f"{wide('weight')} * _left")
    out = out.withColumn("_part", F.expr(f"if(_full, cap, {product} div {wide('_share')})").cast("long")).withColumn(
        "_over", F.expr(f"if(_full, -1, cast({product} % {wide('_share')} as long))").cast("long")
    )
    out = out.withColumn("_spare", F.col("budget") - F.sum("_part").over(family)).withColumn(
        "_rank", F.row_number().over(family.orderBy(F.col("_over").desc(), key))
    )
    quota = F.col("_part") + F.when(~F.col("_full") & (F.col("_rank") <= F.col("_spare")), 1).otherwise(0)
    return out.withColumn("quota", quota.cast("long")).drop("_left", "_share", "_full", "_part", "_over", "_spare", "_rank")


def leaf_quotas(leaves: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """Budgets of all leaves ``(domain, lang, source, tokens, w_domain, w_lang, w_source)``: adds ``quota``.

    A node can give what its leaves of weight hold, ``max_epochs`` times over.
    The budget comes down the tree one level at a time: what a child lacks its
    siblings make up by weight, and only what a whole family lacks was shared
    out among the parent's siblings, one level above.
    """
    d, la, s = LEVELS
    able = leaves.where("w_domain > 0 and w_lang > 0 and w_source > 0 and tokens > 0").withColumn("cap", F.col("tokens") * max_epochs)
    langs = able.groupBy(d, la).agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("weight"))
    domains = able.groupBy(d).agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("weight"))
    everything = Window.partitionBy("_root")
    top = domains.withColumn("_root", F.lit(0)).withColumn("budget", F.least(F.lit(budget).cast("long"), F.sum("cap").over(everything)))
    by_domain = split_budget(top, ["_root"], d).select(d, F.col("quota").alias("budget"))
    by_lang = split_budget(langs.join(by_domain, d), [d], la).select(d, la, F.col("quota").alias("budget"))
    down = able.join(by_lang, [d, la]).withColumn("weight", F.col("w_source"))
    return split_budget(down, [d, la], s).select(d, la, s, "tokens", "quota")


def mixed(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[str, tuple[Mapping[str, int], int]],
    budget: int | None = None,
    budget_share: float | None = None,
    max_epochs: int = 2,
    seed: int = 0,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    row_col: str | None = None,
) -> DataFrame:
    """Documents to train on, so that domains, languages and sources get their weights in tokens.

    Columns: ``doc_id, domain, lang, source, epoch, order_key, n_tokens,
    take_tokens``. Each leaf's documents form a stream of epochs, each in an
    order of its own that the seed fixes (``order_key``, then id, then tokens);
    the leaf's quota takes a prefix of that stream. The document in which the
    quota ends is taken with ``take_tokens`` < ``n_tokens``; quotas are met to
    the token. ``weights`` has, for each level, whole-number weights among
    siblings and the weight of names not listed. The budget is a number of
    tokens or a share of all tokens in the table.

    Whole epochs need no order: only the documents whose key lies in the one
    hash range in which a quota ends are put in order, within leaf and range,
    so a leaf with a third of all rows is spread like any other. There, rows of
    one id and size are a group for each part of the table that holds some, and
    only the group in which the quota ends is put in order, so an id, or none,
    that a third of all rows share is spread as well.

    Null language or source is the name ``?``; null ids sort as the text ``?``.
    Documents without tokens go with whole epochs, and with a part of one if
    they come before its end. Repeated rows count each; long texts are counted
    whole. A weight of 0 takes nothing; a budget above what epochs allow is
    lowered to that. An empty table gives an empty result; other columns are
    ignored, but for ``row_col``: if named, that unique key of the input's rows
    comes last in the order and in the columns, which tells drawn rows of one id
    or none apart.
    """
    row = [row_col] if row_col else []
    tokens = n_words(F.col("text")) if tokens is None else tokens
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("?"))
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(domain, F.lit("?")).alias("domain"),
            F.coalesce(F.col("lang"), F.lit("?")).alias("lang"),
            F.coalesce(F.col("source"), F.lit("?")).alias("source"),
            tokens.cast("long").alias("n_tokens"),
            name.alias("_name"),
            F.shiftright(F.monotonically_increasing_id(), 33).alias("_part"),
            F.monotonically_increasing_id().alias("_origin"),
            *row,
        )
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    for level in LEVELS:
        listed, default = weights[level]
        leaves = leaves.withColumn(f"w_{level}", weight_of(level, listed, default))
    leaves = written(leaves)
    if budget is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        budget = int(total * budget_share)
    quotas = leaf_quotas(leaves, budget, max_epochs)
    plan = small(
        written(
            quotas.select(
                *LEVELS,
                F.expr("cast(quota div tokens as int)").alias("_whole"),
                F.expr("quota % tokens").alias("_rest"),
            )
        )
    )
    # every epoch in full, and one more of which the rest is taken
    which = F.explode(F.expr("filter(sequence(0, _whole), e -> e < _whole or _rest > 0)")).alias("epoch")
    epochs = rows.join(plan, list(LEVELS)).select("*", which)
    keyed = epochs.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("_name"))))
    keep = ["doc_id", *LEVELS, "epoch", "order_key", "n_tokens", *row]
    whole = keyed.where("epoch < _whole").select(*keep, F.col("n_tokens").alias("take_tokens"))
    partial = keyed.where("epoch = _whole").withColumn("_range", F.substring("order_key", 1, RANGE_DIGITS))
    ends = small(_range_of_end(partial))
    started = partial.join(ends, list(LEVELS))
    all_of = started.where(F.col("_range") < F.col("_end")).select(*keep, F.col("n_tokens").alias("take_tokens"))
    # in the range of the end, rows that tie are told apart by where they were written, so that many of one id are many groups
    tie = ["order_key", "n_tokens", "_part"]
    last = started.where(F.col("_range") == F.col("_end"))
    line = Window.partitionBy(*LEVELS).orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)
    ties = (
        last.groupBy(*LEVELS, *tie)
        .agg(F.sum("n_tokens").alias("_in"), F.max("_before").alias("_above"), F.max("_rest").alias("_most"))
        .withColumn("_first", F.col("_above") + F.sum("_in").over(line) - F.col("_in"))
        .where("_first < _most")
        .select(*LEVELS, *tie, "_first", (F.col("_first") + F.col("_in") <= F.col("_most")).alias("_fits"))
    )
    placed = last.join(small(written(ties)), [*LEVELS, *tie])
    inside = Window.partitionBy(*LEVELS, *tie).orderBy(*row, "_origin").rowsBetween(Window.unboundedPreceding, 0)
    fits = placed.where("_fits").select(*keep, F.col("n_tokens").alias("take_tokens"))
    ends = (
        placed.where("not _fits")
        .withColumn("_start", F.col("_first") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
        .where("_start < _rest")
        .select(*keep, F.least(F.col("n_tokens"), F.col("_rest") - F.col("_start")).alias("take_tokens"))
    )
    part_of = fits.unionByName(ends)
    out = whole.unionByName(all_of).unionByName(part_of)
    return out.select(*(c for c in out.columns if c not in row), *row)


def _range_of_end(partial: DataFrame) -> DataFrame:
    """``(*LEVELS, _end, _before)``: the hash range in which each leaf's rest ends, and the tokens of all ranges before.

    One digit after the other: each step puts in order the sixteen ranges of a
    leaf that the digits so far leave.
    """
    left = written(partial.groupBy(*LEVELS, "_range").agg(F.sum("n_tokens").alias("_in"), F.max("_rest").alias("_rest"))).withColumn("_before", F.lit(0).cast("long"))
    line = Window.partitionBy(*LEVELS).orderBy("_end").rowsBetween(Window.unboundedPreceding, 0)
    for digits in range(1, RANGE_DIGITS + 1):
        end = (
            left.groupBy(*LEVELS, F.substring("_range", 1, digits).alias("_end"))
            .agg(F.sum("_in").alias("_in"), F.max("_rest").alias("_rest"), F.max("_before").alias("_before"))
            .withColumn("_upto", F.col("_before") + F.sum("_in").over(line))
            .where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_in") < F.col("_rest")))
            .select(*LEVELS, "_end", (F.col("_upto") - F.col("_in")).alias("_before"))
        )
        end = written(end)  # a row a leaf
        if digits < RANGE_DIGITS:
            left = left.drop("_before").join(small(end), list(LEVELS)).where(F.col("_range").startswith(F.col("_end"))).drop("_end")
    return end


#: The query's tree: weights among siblings, and the weight of names not listed.
DOMAIN_RULES = (("web", "^src0$"), ("reference", "^src[1-9]$"))
OTHER_DOMAIN = "community"
WEIGHTS = {
    "domain": ({"web": 50, "reference": 30, "community": 20}, 1),
    "lang": ({"en": 55, "de": 15, "fr": 15, "es": 15}, 1),
    "source": ({}, 1),
}
SHARE, EPOCHS, SEED = 0.6, 2, 17


def domain_of(source: Column) -> Column:
    """The domain of a source by the first rule whose pattern fits."""
    out = F.lit(OTHER_DOMAIN)
    for name, pattern in reversed(DOMAIN_RULES):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return out


def production(docs: DataFrame, max_epochs: int = EPOCHS, share: float = SHARE, row_col: str | None = None) -> DataFrame:
    """``mixed`` with the parameters of the registered query."""
    return mixed(docs, domain_of(F.col("source")), WEIGHTS, budget_share=share, max_epochs=max_epochs, seed=SEED, row_col=row_col)


def oracle() -> str:
    """DuckDB SQL for ``production``."""

    def split(source: str, parent: str, key: str) -> str:
        order = f"partition by {parent} order by cap / weight, {key}"
        return f"""(select *, (part + case when not filled and rk <= spare then 1 else 0 end)::bigint as quota from (
  select *, budget - sum(part) over (partition by {parent}) as spare, row_number() over (partition by {parent} order by excess desc, {key}) as rk from (
  select *, case when filled then cap else (weight::hugeint * l) // s end as part, case when filled then -1 else (weight::hugeint * l) % s end as excess from (
  select *, first_value(lft) over f as l, first_value(shr) over f as s from (
  select *, cap::hugeint * shr <= weight::hugeint * lft as filled from (
  select *, budget - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0) as lft,
    sum(weight) over ({order} rows between current row and unbounded following) as shr from {source}))
  window f as (partition by {parent} order by filled, cap / weight, {key})))))"""

    def weight(level: str) -> str:
        listed, default = WEIGHTS[level]
        cases = " ".join(f"when {level} = '{n}' then {w}" for n, w in listed.items())
        return f"case {cases} else {default} end" if cases else str(default)

    domains = " ".join(f"when regexp_matches(source, '{p}') then '{n}'" for n, p in DOMAIN_RULES)
    return f"""
with rows as (
  select doc_id, case {domains} else '{OTHER_DOMAIN}' end as domain, coalesce(lang, '?') as lang, coalesce(source, '?') as source, coalesce(doc_id::varchar, '?') as name,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::bigint as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from rows group by all),
total as (select floor(sum(tokens)::double * {SHARE}::double)::bigint as budget from leaves),
able as (select *, tokens * {EPOCHS} as cap, {weight("domain")} as wd, {weight("lang")} as wl, {weight("source")} as ws from leaves where tokens > 0),
top as (select 0 as root, domain, sum(cap)::bigint as cap, max(wd)::bigint as weight from able where wd > 0 and wl > 0 and ws > 0 group by domain),
rooted as (select *, least((select budget from total), (select sum(cap) from top))::bigint as budget from top),
by_domain as (select domain, quota as budget from {split("rooted", "root", "domain")}),
langs as (select domain, lang, sum(cap)::bigint as cap, max(wl)::bigint as weight, any_value(budget) as budget from able join by_domain using (domain) group by domain, lang),
by_lang as (select domain, lang, quota as budget from {split("langs", "domain", "lang")}),
down as (select domain, lang, source, tokens, cap, ws::bigint as weight, budget from able join by_lang using (domain, lang)),
plan as (select domain, lang, source, quota // tokens as whole, quota % tokens as rest from {split("down", "domain, lang", "source")}),
epochs as (select rows.*, whole, rest, unnest(range(0, whole + (rest > 0)::int)) as epoch from rows join plan using (domain, lang, source)),
keyed as (select *, md5('{SEED}:' || epoch || ':' || name) as order_key from epochs),
placed as (select *, sum(n_tokens) over (partition by domain, lang, source, epoch order by order_key, doc_id, n_tokens rows unbounded preceding) - n_tokens as start from keyed)
select doc_id, domain, lang, source, epoch::int as epoch, order_key, n_tokens,
  (case when epoch < whole then n_tokens else least(n_tokens, rest - start) end)::bigint as take_tokens
from placed where epoch < whole or start < rest"""
