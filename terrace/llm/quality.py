"""Quality rules: a text's own failures, and its host's record of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import BROADCAST_ROWS, let, spread_join, written

#: A document fails by itself with fewer words, or with more than so many in a hundred repeated.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Symbols per hundred word characters, duplicate lines, repeated words per hundred that count as softer failures.
MOST_SYMBOLS_PERCENT, MOST_DUP_LINES, SOFT_REPEATED_PERCENT = 10, 3, 30
#: A host is condemned if its shrunk rate of failing documents, less so many posterior deviations, is above all hosts' rate.
HOST_DEVIATIONS = 0.5
#: Bounds of the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 200.0

_WORD_GAP = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """The runs of anything but ASCII white space, as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _WORD_GAP), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that is found twice or more in the text.

    Windows are sorted by a 33-bit hash with their place below it, so windows
    that share a hash stand side by side; those windows alone, a superset of the
    repeated ones, are then sorted by their words, which decides.
    """
    bits = 31

    def coded(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        code = F.transform(
            places,
            lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
        )
        return F.sort_array(code)

    def maybe(codes: Column) -> Column:
        """Places of windows whose hash another has."""
        hashed = F.filter(
            codes,
            lambda c, i: (F.shiftright(c, bits) == F.shiftright(F.get(codes, i + 1), bits))
            | (F.shiftright(c, bits) == F.shiftright(F.get(codes, i - 1), bits)),
        )
        return F.transform(hashed, lambda c: c.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))

    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def sure(w: Column, places: Column) -> Column:
        """Ascending places of windows whose words another has."""
        pairs = F.array_sort(F.transform(places, lambda i: F.struct(window(w, i).alias("t"), i.alias("i"))))
        kept = let(
            pairs,
            lambda p: F.filter(p, lambda x, k: F.coalesce(x["t"] == F.get(p, k + 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(p, k - 1)["t"], F.lit(False))),
        )
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        """Words in windows at these places: each adds three, less what the one before has."""
        gaps = F.transform(places, lambda i, k: F.coalesce(F.least(F.lit(3), i - F.get(places, k - 1)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    counted = let(
        coded(words),
        lambda codes: let(
            maybe(codes),
            lambda places: F.when(F.size(places) < 2, F.lit(0).cast("long")).otherwise(let(sure(words, places), covered)),
        ),
    )
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the measures that rules use to ``docs``: one scan, no shuffle."""
    text = F.col(text_col)
    symbols = F.octet_length(F.coalesce(text, F.lit(""))) - F.octet_length(F.translate(F.coalesce(text, F.lit("")), "#*$%&|<>", ""))
    facts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.select(
        "*",
        facts.alias("_facts"),
        symbols.cast("long").alias("_n_symbols"),
        duplicate_lines(text).alias("_n_dup_lines"),
    )


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, soft_failed, host_rate)``.

    A document fails by itself (``base_failed``) with fewer than ``LEAST_WORDS``
    words or too many repeated ones, and softly (``soft_failed``) with too many
    symbols, duplicate lines or repeated words. Per host, the rate of documents
    with either failure is shrunk to the rate of all hosts by a beta prior whose
    strength comes from the spread of the hosts' rates. A host is condemned if it
    is likely worse than hosts at large: if its shrunk rate, less
    ``HOST_DEVIATIONS`` posterior deviations, is above the rate of all. Kept is a
    document that does not fail, and of condemned hosts only those that don't
    fail softly either: a host's record never condemns a clean document.

    Hosts are counted before the shuffle, so one with a third of all rows is one
    row per task; their verdicts join back by name, broadcast if there are few,
    else with the rows of large hosts spread.

    Null or wordless texts have zeroes everywhere and fail; long texts are
    measured whole. A null host is a host of its own. Repeated rows and ids count
    each; an empty table gives an empty result; other columns are ignored.
    """
    facts = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("_text")), "doc_id", "_text")
    rows = facts.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "host",
        F.col("_facts.n_words").alias("n_words"),
        F.col("_facts.word_chars").alias("word_chars"),
        F.col("_n_symbols").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_facts.n_repeat_words").alias("n_repeat_words"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    soft = (
        (100 * F.col("n_symbols") > MOST_SYMBOLS_PERCENT * F.col("word_chars"))
        | (F.col("n_dup_lines") > MOST_DUP_LINES)
        | (100 * F.col("n_repeat_words") > SOFT_REPEATED_PERCENT * F.col("n_words"))
    )
    # the measures cost a pass over all texts and are needed twice: for the hosts' rates and for the verdicts
    return with_host_verdicts(written(rows.withColumn("base_failed", base).withColumn("soft_failed", soft)))


def host_rates(rows: DataFrame) -> DataFrame:
    """``(host, n, host_rate, condemned)``: shrunk rates of failing documents and what they say of a host."""
    hosts = rows.groupBy("host").agg(
        F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("k")
    )
    sums = hosts.agg(
        F.sum("k").cast("double").alias("_k"),
        F.sum("n").cast("double").alias("_n"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("_nn"),
        F.round(F.sum(F.col("k") * F.col("k") / F.col("n")), 6).alias("_kk"),
        F.count("*").cast("double").alias("_c"),
    )
    m = F.col("_k") / F.col("_n")
    within = m * (1 - m)
    extra = (F.col("_kk") - F.col("_k") * m - (F.col("_c") - 1) * within) / F.nullif(F.col("_n") - F.col("_nn") / F.col("_n"), F.lit(0.0))
    strength = F.when(extra > 1e-9, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), within / extra - 1))).otherwise(F.lit(MOST_STRENGTH))
    prior = sums.select(m.alias("_m"), strength.alias("_strength"))
    rate = (F.col("k") + F.col("_strength") * F.col("_m")) / (F.col("n") + F.col("_strength"))
    deviation = F.sqrt(F.col("_r") * (1 - F.col("_r")) / (F.col("n") + F.col("_strength") + 1))
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("_r", rate)
    worse = F.round(F.col("_r") - HOST_DEVIATIONS * deviation - F.col("_m"), 9) > 0
    return shrunk.select("host", "n", F.round("_r", 6).alias("host_rate"), worse.alias("condemned"))


def with_host_verdicts(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))  # null hosts have a name to meet by, too
    rates = written(host_rates(rows)).select(name.alias("_name"), "n", "host_rate", "condemned")
    kept = ~F.col("base_failed") & ~(F.col("soft_failed") & F.col("condemned"))
    named = rows.withColumn("_name", name)
    facts = rates.select("_name", "host_rate", "condemned")
    joined = named.join(F.broadcast(facts), "_name") if rates.count() <= BROADCAST_ROWS else spread_join(named, facts, "_name", counts=rates.select("_name", "n"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host", "soft_failed", "host_rate"
    )


def oracle() -> str:
    """DuckDB SQL for ``judged``."""
    gap = "[\\x20\\x09-\\x0D]+"
    return f"""
with split as (
  select doc_id, source as host, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{gap}'), lambda w: w <> '') as w from documents),
numbered as (select row_number() over () as r, * from split),
windows as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t
  from (select r, w, unnest(range(1, len(w) - 1)) as i from numbered)),
twice as (select r, i from (select r, i, count(*) over (partition by r, t) as c from windows) where c > 1),
repeats as (select r, count(distinct j)::bigint as n from (select r, unnest([i, i + 1, i + 2]) as j from twice) group by r),
facts as (
  select doc_id, host, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from numbered)
  left join repeats using (r)),
ruled as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words as base_failed,
    100 * n_symbols > {MOST_SYMBOLS_PERCENT} * word_chars or n_dup_lines > {MOST_DUP_LINES}
      or 100 * n_repeat_words > {SOFT_REPEATED_PERCENT} * n_words as soft_failed from facts),
hosts as (select host, count(*) as n, sum((base_failed or soft_failed)::bigint)::bigint as k from ruled group by host),
sums as (
  select sum(k)::double as k, sum(n)::double as n, sum(n * n)::double as nn, round(sum(k * k / n::double), 6) as kk, count(*)::double as c from hosts),
prior as (
  select k / n as m, (kk - k * (k / n) - (c - 1) * (k / n) * (1 - k / n)) / nullif(n - nn / n, 0) as extra from sums),
strong as (
  select m, case when extra > 1e-9 then greatest({LEAST_STRENGTH}, least({MOST_STRENGTH}, m * (1 - m) / extra - 1)) else {MOST_STRENGTH} end as s from prior),
shrunk as (select host, n, m, s, (k + s * m) / (n + s) as r from hosts cross join strong),
rates as (select host, round(r, 6) as host_rate, round(r - {HOST_DEVIATIONS}::double * sqrt(r * (1 - r) / (n + s + 1)) - m, 9) > 0 as condemned from shrunk)
select ruled.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (soft_failed and condemned) as kept, ruled.host, soft_failed, host_rate
from ruled left join rates on ruled.host is not distinct from rates.host"""
