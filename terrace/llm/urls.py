"""URL filtering by explicit rules and an empirical-Bayes reputation of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import BROADCAST_ROWS, ascii_lower, spread_join, written

#: (rule, verdict); a rule is a host, then a path that starts with ``/``.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Suffixes of two names, under which the registered domain has three.
TWO_NAME_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za")
_ADDRESS = "^[0-9]+(?:\\.[0-9]+){3}$"
#: Pages of evidence that the level above is worth, where the data don't say.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 20.0
#: A host is blocked if its posterior rate of bad pages, less so many standard deviations, is above the rate of all pages.
DEVIATIONS = 0.5


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def bare_host(host: Column) -> Column:
    """A host without user, port and closing dots: the name that a reputation belongs to."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "\\.*(:[0-9]*)?$", "")


def suffix_of(name: Column, two_names: Sequence[str] = TWO_NAME_SUFFIXES) -> Column:
    """The public suffix, by the list of two-name suffixes, else the last name; an IPv4 address is its own."""
    two = "|".join(s.replace(".", "\\.") for s in two_names)
    return F.when(name.rlike(_ADDRESS), name).otherwise(F.regexp_extract(name, f"(?:^|\\.)({two}|[^.]*)$", 1))


def registered_of(name: Column, two_names: Sequence[str] = TWO_NAME_SUFFIXES) -> Column:
    """The registered domain: one name more than the suffix; the suffix itself if there is no more."""
    two = "|".join(s.replace(".", "\\.") for s in two_names)
    more = F.regexp_extract(name, f"(?:^|\\.)([^.]+\\.(?:{two}|[^.]*))$", 1)
    return F.when(name.rlike(_ADDRESS), name).otherwise(F.coalesce(F.nullif(more, F.lit("")), name))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits a host, its own or a parent's, and starts its path; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, verdict).otherwise(out)
    return out


def _rounded(x: Column) -> Column:
    """To 9 places, so that the order in which sums were made decides no verdict."""
    return F.round(x, 9)


def _prior(groups: DataFrame, over: list[str]) -> DataFrame:
    """Per parent: the strength of a beta prior from the spread of its children's rates.

    By moments: with children i of n_i pages and k_i bad ones, the rate m =
    sum k / sum n, and the variance of rates beyond the binomial one gives the
    strength m (1 - m) / variance - 1, kept within bounds; no spread beyond
    chance, or one child alone, gives the largest strength.
    """
    rate = F.sum("bad") / F.sum("pages")
    sums = groups.groupBy(*over).agg(
        F.sum("bad").cast("double").alias("_k"),
        F.sum("pages").cast("double").alias("_n"),
        F.sum(F.col("pages") * F.col("pages")).cast("double").alias("_nn"),
        _rounded(F.sum(F.col("bad") * F.col("bad") / F.col("pages"))).alias("_kk"),
        F.count("*").cast("double").alias("_c"),
    )
    m = F.col("_k") / F.col("_n")
    # weighted spread of rates: sum n_i (r_i - m)^2
    spread = F.col("_kk") - F.col("_k") * m
    within = m * (1 - m)
    extra = (spread - (F.col("_c") - 1) * within) / F.nullif(F.col("_n") - F.col("_nn") / F.col("_n"), F.lit(0.0))
    strength = F.when(extra > 1e-9, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), within / extra - 1))).otherwise(F.lit(MOST_STRENGTH))
    return sums.select(*over, _rounded(m).alias("_rate"), _rounded(strength).alias("_strength"))


def host_reputation(outcomes: DataFrame, two_names: Sequence[str] = TWO_NAME_SUFFIXES) -> DataFrame:
    """``(host, registered, suffix, pages, bad, mean, bound, base)`` from rows ``(host, bad)`` of labelled pages.

    The rate of bad pages of all labelled pages, ``base``, is the prior of a
    suffix, a suffix's posterior mean that of its registered domains, and theirs
    that of their hosts; at each level the strength comes from the spread among
    the children of one parent. ``bound`` is the host's posterior mean less
    ``DEVIATIONS`` standard deviations. Hosts are counted first, so one host
    with a third of all pages is one row here, and written down, since every
    level starts from them.
    """
    name = F.col("host")
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = written(hosts.withColumn("registered", registered_of(name, two_names)).withColumn("suffix", suffix_of(name, two_names)))
    domains = hosts.groupBy("registered", "suffix").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"))

    def posterior(rate: str) -> Column:
        return _rounded((F.col("bad") + F.col("_strength") * F.col(rate)) / (F.col("pages") + F.col("_strength")))

    top = _prior(suffixes, [])
    suffixes = suffixes.crossJoin(F.broadcast(top)).select("suffix", posterior("_rate").alias("_suffix_mean"), F.col("_rate").alias("base"))
    in_suffix = _prior(domains, ["suffix"]).drop("_rate")
    domains = domains.join(suffixes, "suffix").join(in_suffix, "suffix").select("registered", posterior("_suffix_mean").alias("_domain_mean"), "base")
    in_domain = _prior(hosts, ["registered"]).drop("_rate")
    mean = posterior("_domain_mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("pages") + F.col("_strength") + 1))
    return (
        hosts.join(domains, "registered")
        .join(in_domain, "registered")
        .withColumn("mean", mean)
        .withColumn("bound", _rounded(F.col("mean") - DEVIATIONS * deviation))
        .select("host", "registered", "suffix", "pages", "bad", "mean", "bound", "base")
    )


def label_key(path: Column) -> Column:
    """The document that a page shows: the number after the language in its path."""
    return F.try_to_number(F.nullif(F.regexp_extract(path, "^/[a-z]+/([0-9]{1,18})", 1), F.lit("")), F.lit("999999999999999999")).cast("long")


def judged_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    two_names: Sequence[str] = TWO_NAME_SUFFIXES,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bound)``, one row per row of ``pages``.

    The longest rule that fits decides; where none does, the host's reputation:
    pages whose document is labelled of poor quality or toxic are bad, others
    with a label good, and a host that is likely worse than pages at large, its
    posterior ``bound`` being above the rate of all, is blocked. A host without
    labelled pages has no verdict against it. Bounds join back by host, broadcast
    if there are few, else with the pages of large hosts spread.

    Null urls and those without ``://`` have an empty host and path, fit no rule
    and are allowed unless such pages themselves have a bad record. Repeated
    pages and null ids count each; long urls are read whole; repeated labels of a
    document count as one, bad if any is.
    Null labels are not labels. Empty tables of pages or labels give an empty
    result or rules only; other columns are ignored.
    """
    seen = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    ).withColumn("_name", bare_host(F.col("host")))
    known = (
        labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    )
    outcomes = seen.select(F.col("_name").alias("host"), label_key(F.col("path")).alias("_doc")).join(known, "_doc").select("host", "bad")
    bounds = written(host_reputation(outcomes, two_names).select(F.col("host").alias("_name"), "bound", "base"))
    if bounds.count() <= BROADCAST_ROWS:
        joined = seen.join(F.broadcast(bounds), "_name", "left")
    else:
        joined = spread_join(seen, bounds, "_name", "left", counts=seen.groupBy("_name").agg(F.count("*").alias("n")))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("bound") > F.col("base"), "block"), F.lit("allow"))
    return joined.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bound")


def oracle() -> str:
    """DuckDB SQL for ``judged_urls``."""
    two = "|".join(s.replace(".", "\\.") for s in TWO_NAME_SUFFIXES)
    cases = " ".join(
        f"when (host = '{d}' or ends_with(host, '.{d}')) and starts_with(path, '/{r}') then '{d}/{r}'"
        for d, r in (x[0].split("/", 1) for x in sorted(RULES, key=lambda r: -len(r[0])))
    )
    verdicts = " ".join(f"when rule = '{r}' then '{v}'" for r, v in RULES)

    def prior(source: str, over: str) -> str:
        group, by = (f"{over},", f"group by {over}") if over else ("", "")
        return f"""(select {group} round(m, 9) as rate, round(case when extra > 1e-9 then greatest({LEAST_STRENGTH}, least({MOST_STRENGTH},
          m * (1 - m) / extra - 1)) else {MOST_STRENGTH} end, 9) as strength from (
          select {group} k / n as m, (kk - k * (k / n) - (c - 1) * (k / n) * (1 - k / n)) / nullif(n - nn / n, 0) as extra from (
          select {group} sum(bad)::double as k, sum(pages)::double as n, sum(pages * pages)::double as nn,
            round(sum(bad * bad / pages::double), 9) as kk, count(*)::double as c from {source} {by})))"""

    def mean(rate: str) -> str:
        return f"round((bad + strength * {rate}) / (pages + strength), 9)"

    return f"""
with seen as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path from pages),
named as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.*(:[0-9]*)?$', '') as name from seen),
known as (
  select doc_id, max((coalesce(quality = 0, false) or coalesce(toxic = 1, false))::int) as bad from labels
  where doc_id is not null and (quality is not null or toxic is not null) group by doc_id),
outcomes as (
  select name as host, bad from named join known on doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1), '') as bigint)),
hosts as (
  select host, count(*) as pages, sum(bad)::bigint as bad,
    case when regexp_matches(host, '{_ADDRESS}') then host else regexp_extract(host, '(?:^|\\.)({two}|[^.]*)$', 1) end as suffix,
    case when regexp_matches(host, '{_ADDRESS}') then host
      else coalesce(nullif(regexp_extract(host, '(?:^|\\.)([^.]+\\.(?:{two}|[^.]*))$', 1), ''), host) end as registered
  from outcomes group by host),
domains as (select registered, suffix, sum(pages)::bigint as pages, sum(bad)::bigint as bad from hosts group by all),
suffixes as (select suffix, sum(pages)::bigint as pages, sum(bad)::bigint as bad from domains group by all),
suffix_means as (select suffix, rate as base, {mean('rate')} as suffix_mean from suffixes cross join {prior('suffixes', '')}),
domain_means as (
  select registered, base, {mean('suffix_mean')} as domain_mean
  from domains join suffix_means using (suffix) join {prior('domains', 'suffix')} using (suffix)),
host_means as (
  select host, base, pages, strength, {mean('domain_mean')} as mean
  from hosts join domain_means using (registered) join {prior('hosts', 'registered')} using (registered)),
bounds as (
  select host as name, base, round(mean - {DEVIATIONS} * sqrt(mean * (1 - mean) / (pages + strength + 1)), 9) as bound from host_means),
ruled as (select *, case {cases} end as rule from named left join bounds using (name))
select page_id, host, path, rule, case {verdicts} when bound > base then 'block' else 'allow' end as verdict, bound
from ruled"""
