"""Secrets in texts: fixed patterns, and random strings told from identifiers by Markov models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import let

#: The patterns that always count, in the order in which their kinds sort.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=\\-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

#: Symbols of the models, and the shortest run of them that is scored.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SHORTEST = 16
_SYMBOL = "[A-Za-z0-9+/_=\\-]"
RUN = f"{_SYMBOL}{{{SHORTEST},}}"
#: A stretch of a run is a secret if the models' log-likelihood ratio is at least so much, in thousandths.
LEAST_RATIO = 12_000
#: The classifier's sample: so many labelled documents at most, and so many random strings.
SAMPLE_DOCUMENTS, SAMPLE_STRINGS = 2000, 2000
#: Share of each row of a model that goes to all symbols alike, so that unseen pairs count for little.
SMOOTHING = 0.05
#: Matches of a text whose places are added up together.
CHUNK = 512


def _places(gaps: Column, hits: Column) -> Column:
    """Where each match starts, from the lengths of the texts between matches and of the matches.

    Matches are taken in chunks of ``CHUNK``; the chunks' lengths give each its
    first place, so that the work does not grow with the square of the matches.
    """

    def chunked(steps: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.expr("int(0)") + F.floor((F.size(steps) - 1) / CHUNK).cast("int"))

        def run(array: Column, at: Column, length) -> Column:
            start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("starts"))
            step = lambda a, s: F.struct((a["at"] + length(s)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
            return F.aggregate(array, start, step, lambda a: a["starts"])

        def part(k: Column) -> Column:
            return F.slice(steps, k * CHUNK + 1, F.lit(CHUNK))

        totals = F.transform(chunks, lambda k: F.aggregate(part(k), F.lit(0), lambda a, s: a + s["g"] + s["h"]))
        offsets = let(totals, lambda t: run(t, F.lit(0), lambda n: n))
        # a match starts after the text before it
        ends = let(offsets, lambda o: F.flatten(F.transform(o, lambda at, k: run(part(k), at, lambda s: s["g"] + s["h"]))))
        return F.zip_with(ends, steps, lambda at, s: at + s["g"])

    return let(F.transform(hits, lambda h, i: F.struct(F.length(F.get(gaps, i)).alias("g"), F.length(h).alias("h"))), chunked)


def _found(text: Column, pattern: str, kind: int, keep=None, group: int = 0, gate: Column | None = None) -> Column:
    """``struct<spans: array<struct<start, kind, end>>, rest>`` of a pattern's leftmost non-overlapping matches.

    The texts between matches and the matches alternate, so their lengths add
    up to places. ``keep`` decides on a match from its ``group``; a match it drops
    has still used up its text. ``rest`` is the text with blanks for the spans.
    ``gate`` is a cheaper condition that texts with a match meet.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), values.alias("values"))

    def split(p: Column) -> Column:
        kept = (lambda i: keep(F.get(p["values"], i))) if keep else (lambda i: F.lit(True))
        spans = F.zip_with(_places(p["gaps"], p["hits"]), p["hits"], lambda at, h: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(h)).alias("end")))
        left = F.transform(p["hits"], lambda h, i: F.concat(F.get(p["gaps"], i), F.when(kept(i), F.repeat(F.lit(" "), F.length(h))).otherwise(h)))
        rest = F.concat(F.array_join(left, ""), F.element_at(p["gaps"], -1))
        return F.struct((F.filter(spans, lambda s, i: kept(i)) if keep else spans).alias("spans"), rest.alias("rest"))

    has = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(has, let(parts, split)).otherwise(F.struct(empty.alias("spans"), text.alias("rest")))


def based(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_base``, the spans of the fixed patterns by start, then kind, and ``_rest``, the text without them.

    Each pattern is matched on the whole text. What is left is made of the same
    matches of one pattern after another, of what those before have left.
    """
    t = F.col(text)
    kinds = (
        (ASSIGN, lambda value: F.length(value) >= 8, 2, lambda t: t.contains("=") | t.contains(":")),
        (ACCESS, None, 0, lambda t: t.contains("AKIA")),
        (HEX, None, 0, None),
    )
    for k, (pattern, keep, group, gate) in enumerate(kinds):
        rows = rows.withColumn(f"_k{k}", _found(t, pattern, k, keep, group, gate(t) if gate else None))
    rest = F.col("_k0.rest")
    for k in (1, 2):
        pattern, keep, group, gate = kinds[k]
        again = _found(rest, pattern, k, keep, group, gate(rest) if gate else None)["rest"]
        # without a span on the whole text there is none on less of it
        rest = F.when(F.size(f"_k{k}.spans") > 0, again).otherwise(rest)
    spans = F.array_sort(F.concat(*(F.col(f"_k{k}.spans") for k in range(3))))
    return rows.withColumn("_base", spans).withColumn("_rest", rest).drop("_k0", "_k1", "_k2")


def _best(run: Column, table: Column) -> Column:
    """``struct<s, f, i, best, start, stop>``: the stretch of a run whose pairs have the largest sum of ratios.

    Of stretches with one sum, the one that ends first, and of these the shortest.
    """
    n = len(ALPHABET)
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = let(
        F.filter(codes, lambda c: c >= 0),
        lambda k: F.transform(F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), lambda c, i: F.get(table, F.get(k, i) * n + c).cast("long")),
    )
    zero, none = F.lit(0), F.lit(0).cast("long")
    start = F.struct(none.alias("s"), zero.alias("f"), zero.alias("i"), none.alias("best"), zero.alias("start"), zero.alias("stop"))

    def step(a: Column, x: Column) -> Column:
        more = a["s"] > 0
        s, f = F.when(more, a["s"] + x).otherwise(x), F.when(more, a["f"]).otherwise(a["i"])
        up = s > a["best"]
        return F.struct(
            s.alias("s"), f.alias("f"), (a["i"] + 1).alias("i"), F.greatest(s, a["best"]).alias("best"),
            F.when(up, f).otherwise(a["start"]).alias("start"), F.when(up, a["i"] + 2).otherwise(a["stop"]).alias("stop"),
        )

    return F.aggregate(pairs, start, step)


def stretches(text: Column, odds: Column) -> Column:
    """Spans of the best stretch of each run of ``ALPHABET`` that reaches ``LEAST_RATIO``.

    The span goes on from the stretch, both ways, over the letters and digits of
    the run next to it, which belong to the same name or key; it has a letter.
    """
    # the look behind spares the tries inside words; runs are as long as can be with or without
    runs = _found(text, f"(?<!{_SYMBOL}){RUN}", 3)["spans"]

    def scored(s: Column) -> Column:
        return let(F.substring(text, s["start"] + 1, s["end"] - s["start"]), lambda v: F.struct(s["start"].alias("at"), v.alias("v"), _best(v, odds).alias("b")))

    def widened(r: Column) -> Column:
        v, b = r["v"], r["b"]
        start = b["start"] - F.length(F.regexp_extract(F.substring(v, F.lit(1), b["start"]), "(?<![A-Za-z0-9])[A-Za-z0-9]*\\z", 0))
        stop = b["stop"] + F.length(F.regexp_extract(F.substring(v, b["stop"] + 1, F.length(v)), "^[A-Za-z0-9]*", 0))
        return F.struct(r["at"].alias("at"), v.alias("v"), start.alias("start"), stop.alias("stop"))

    found = F.transform(F.filter(let(runs, lambda spans: F.transform(spans, scored)), lambda r: r["b"]["best"] >= LEAST_RATIO), widened)
    named = F.filter(found, lambda r: F.substring(r["v"], r["start"] + 1, r["stop"] - r["start"]).rlike("[A-Za-z]"))
    return F.transform(named, lambda r: F.struct((r["at"] + r["start"]).alias("start"), F.lit(3).alias("kind"), (r["at"] + r["stop"]).alias("end")))


def trained(docs: DataFrame, labels: DataFrame) -> list[int]:
    """Log-likelihood ratios, in thousandths, of each pair of symbols in random strings against identifiers.

    The sample are the ``SAMPLE_DOCUMENTS`` labelled documents with the smallest
    hash of their id. What the fixed patterns find in them is labelled random, and
    so are ``SAMPLE_STRINGS`` digests in Base64. Of the documents in the sample
    that ``labels`` calls good and not toxic, all else is labelled ordinary: their
    tokens, and their words joined in snake case, camel case, upper case and with
    a number, as identifiers are. Both models are pair counts, each row a distribution over
    what follows, smoothed by ``SMOOTHING``; without labels the rows of the
    ordinary one are even. What comes back has one number for each pair, whatever
    the input.
    """
    spark = docs.sparkSession
    marked = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)).alias("_good"))
    )
    # the sample is drawn from ids alone and has at most SAMPLE_DOCUMENTS rows, so it may be broadcast
    drawn = marked.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE_DOCUMENTS)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").select("text", F.col("_good"))
    plain = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    hits = F.concat(values, *(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (ACCESS, HEX)))
    found = sample.select(F.lit(1).alias("kind"), F.explode(hits).alias("s"))
    good = sample.where("_good").select(plain.alias("text"))
    tokens = good.select(F.lit(0).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(f"{_SYMBOL}{{4,}}"), F.lit(0))).alias("s"))
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    pairs = good.select(F.posexplode(let(words, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("a"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("b"))))).alias("i", "p"))
    a, b = F.col("p.a"), F.col("p.b")
    number = (F.col("i") % 100).cast("string")
    names = F.array(
        F.concat(F.lower(a), F.lit("_"), F.lower(b), F.lit("_"), number),
        F.concat(F.initcap(a), F.initcap(b)),
        F.concat(F.lower(a), F.lit("-"), number),
        F.concat(F.upper(a), F.lit("_"), F.upper(b)),
    )
    ordinary = tokens.unionByName(pairs.select(F.lit(0).alias("kind"), F.explode(names).alias("s")))
    digest = F.sha2(F.concat(F.lit("terrace"), F.col("id").cast("string")), 256)
    random = spark.range(SAMPLE_STRINGS).select(F.lit(1).alias("kind"), F.base64(F.unhex(digest)).alias("s"))
    steps = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))
    counts = (
        ordinary.unionByName(random.unionByName(found))
        .where(F.length("s") > 1)
        .select("kind", F.explode(steps).alias("pair"))
        .groupBy("kind", "pair")
        .agg(F.count("*").alias("n"))
        .where(F.col("pair").rlike(f"^{_SYMBOL}{{2}}$"))
        .collect()
    )
    return ratios({(r["kind"], r["pair"]): r["n"] for r in counts})


def ratios(counts: dict[tuple[int, str], int]) -> list[int]:
    """The table of ``trained`` from pair counts by kind (0: identifiers, 1: random)."""
    n = len(ALPHABET)
    rows = {(k, a): sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}

    def log(kind: int, a: str, b: str) -> float:
        seen = counts.get((kind, a + b), 0) / rows[kind, a] if rows[kind, a] else 1 / n
        return math.log((1 - SMOOTHING) * seen + SMOOTHING / n)

    return [round(1000 * (log(1, a, b) - log(0, a, b))) for a in ALPHABET for b in ALPHABET]


def secrets(docs: DataFrame, table: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov)``, one row per row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then
    kind. Beside the fixed patterns, each run of at least ``SHORTEST`` symbols of
    ``ALPHABET`` in what the patterns leave of the text is scored by both models:
    the stretch of the run with the largest log-likelihood ratio, with the letters
    and digits next to it, is a span of kind ``markov`` if the ratio is at least
    ``LEAST_RATIO`` and the span has a letter.
    Counts and ``base_sha256`` are of the patterns alone.

    Null texts are empty; an empty text has no span, and the digest of the empty
    string. Long texts are searched whole, in time that grows with their length
    and their number of matches. Repeated rows and null ids count each; an empty
    table gives an empty result; other columns are ignored. One scan, no shuffle;
    the model is ``len(ALPHABET) ** 2`` numbers, so it is part of the plan.
    """
    odds = F.expr(f"array({','.join(map(str, table))})")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    scored = based(rows, "_text").select("doc_id", "_base", F.array_sort(F.concat("_base", stretches(F.col("_rest"), odds))).alias("_all"))
    names = F.array(*(F.lit(k) for k in KINDS))

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("_all", lambda s: s["kind"] == kind)).cast("long")

    return scored.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"),
        listed(F.col("_all")).alias("spans"),
        count(3).alias("n_markov"),
    )


def production(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``secrets`` with a model trained from the labelled documents."""
    return secrets(docs, trained(docs, labels))


def oracle() -> str:
    """DuckDB SQL for ``production``."""
    assign, symbol = ASSIGN.replace("'", "''").replace("\\-", "-"), _SYMBOL.replace("\\-", "-")
    n = len(ALPHABET)

    def matched(name: str, source: str, pattern: str, group: int = 0) -> str:
        """Rows with matches: the texts between, the matches and their groups."""
        return f"""{name} as (
  select r, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as v, regexp_split_to_array(text, '{pattern}') as g
  from {source} where regexp_matches(text, '{pattern}'))"""

    def spans(name: str, kind: int, keep: str) -> str:
        before = "list_sum(list_transform(g[1:k], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0)::bigint"
        return f"""
  select r, start, {kind} as kind, start + length(m) as stop, m from (
    select r, unnest(m) as m, unnest(v) as v, unnest(list_transform(range(1, len(m) + 1), lambda k: {before})) as start from {name}) where {keep}"""

    def left(name: str, source: str, hits: str, keep: str) -> str:
        """The texts with blanks for the matches that are spans."""
        return f"""{name} as (
  select r, case when m is null then text else array_to_string(list_transform(range(1, len(m) + 1),
    lambda k: g[k] || case when {keep} then repeat(' ', length(m[k])) else m[k] end), '') || g[len(g)] end as text from {source} left join {hits} using (r))"""

    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    told = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop)"
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
marked as (select doc_id, max((coalesce(quality, 0) = 1 and coalesce(toxic, 1) = 0)::int) = 1 as good from labels where doc_id is not null group by doc_id),
drawn as (select * from marked order by md5(doc_id::varchar), doc_id limit {SAMPLE_DOCUMENTS}),
sample as (select text, good from documents join drawn using (doc_id) where text is not null),
found as (
  select unnest(list_filter(regexp_extract_all(text, '{assign}', 2), lambda v: length(v) >= 8) || regexp_extract_all(text, '{ACCESS}') || regexp_extract_all(text, '{HEX}')) as s
  from sample),
plain as (
  select regexp_replace(regexp_replace(regexp_replace(text, '{assign}', ' ', 'g'), '{ACCESS}', ' ', 'g'), '{HEX}', ' ', 'g') as text from sample where good),
listed as (select regexp_extract_all(text, '[A-Za-z]{{4,}}') as w from plain),
words as (select unnest(w) as a, unnest(list_transform(range(1, len(w) + 1), lambda i: coalesce(w[i + 1], ''))) as b, unnest(range(0, len(w))) % 100 as k from listed),
names as (
  select 0 as kind, unnest([lower(a) || '_' || lower(b) || '_' || k, upper(a[1]) || lower(a[2:]) || upper(b[1]) || lower(b[2:]), lower(a) || '-' || k, upper(a) || '_' || upper(b)]) as s from words
  union all select 0, unnest(regexp_extract_all(text, '{symbol}{{4,}}')) from plain
  union all select 1, s from found
  union all select 1, to_base64(unhex(sha256('terrace' || i))) from range({SAMPLE_STRINGS}) as t(i)),
pairs as (select kind, unnest(list_transform(range(1, length(s)), lambda i: s[i:i + 1])) as p from names),
counts as (select kind, p[1] as a, p[2] as b, count(*) as c from pairs where regexp_matches(p, '^{symbol}{{2}}$') group by all),
rows as (select kind, a, sum(c) as c from counts group by all),
symbols as (select unnest(range(1, {n + 1})) as i),
grid as (select x.i as i, y.i as j, '{ALPHABET}'[x.i] as a, '{ALPHABET}'[y.i] as b from symbols x, symbols y),
logs as (
  select i, j, k.kind, ln((1 - {SMOOTHING}) * (case when rows.c is null then 1 / {n}.0::double else coalesce(counts.c, 0) / rows.c end) + {SMOOTHING} / {n}.0::double) as l
  from grid cross join (select unnest([0, 1]) as kind) as k left join counts on counts.kind = k.kind and counts.a = grid.a and counts.b = grid.b
    left join rows on rows.kind = k.kind and rows.a = grid.a),
model as (select list(v order by i, j) as tab from (select i, j, round(1000 * sum(case when kind = 1 then l else -l end))::bigint as v from logs group by i, j)),
{matched("m0", "docs", assign, 2)},
{matched("m1", "docs", ACCESS)},
{matched("m2", "docs", HEX)},
base as ({spans("m0", 0, "length(v) >= 8")} union all {spans("m1", 1, "true")} union all {spans("m2", 2, "true")}),
{left("l0", "docs", "m0", "length(v[k]) >= 8")},
{matched("n1", "l0", ACCESS)},
{left("l1", "l0", "n1", "true")},
{matched("n2", "l1", HEX)},
{left("l2", "l1", "n2", "true")},
{matched("m3", "l2", RUN.replace(_SYMBOL, symbol))},
runs as (select row_number() over () as id, r, start, m from ({spans("m3", 3, "true")})),
steps as (
  select id, k, tab[(instr('{ALPHABET}', m[k]) - 1) * {n} + instr('{ALPHABET}', m[k + 1])] as x from (select id, m, unnest(range(1, length(m))) as k from runs), model),
sums as (select id, k, sum(x) over (partition by id order by k) as p from steps),
lows as (select id, k, p, least(0, coalesce(min(p) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0)) as low from sums),
best as (select id, k, p - low as score, low from lows qualify row_number() over (partition by id order by p - low desc, k) = 1),
stretch as (
  select id, k, score, greatest(case when low = 0 then 0 else -1 end, coalesce((select max(s.k) from sums s where s.id = best.id and s.k < best.k and s.p = low), -1)) as first from best),
widened as (
  select r, start, m, first - length(regexp_extract(m[1:first], '[A-Za-z0-9]*$')) as f, k + 1 + length(regexp_extract(m[k + 2:], '^[A-Za-z0-9]*')) as t
  from runs join stretch using (id) where score >= {LEAST_RATIO}),
scored as (select r, start + f as start, 3 as kind, start + t as stop from widened where regexp_matches(m[f + 1:t], '[A-Za-z]')),
every as (select r, start, kind, stop from base union all select * from scored),
joined as (
  select r, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex, count(*) filter (where kind = 3) as n_markov,
    {told} as spans, {told} filter (where kind < 3) as base_spans
  from every group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_markov, 0)::bigint as n_markov
from docs left join joined using (r)"""
