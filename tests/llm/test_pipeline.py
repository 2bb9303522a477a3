"""The pipeline's stages against plain Python, one after the other, over rows with every awkward thing."""

import hashlib
import random
from fractions import Fraction

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from terrace.llm import mixing
from tests.llm.test_operators import brute_hits, shingles, words

KIND = "doc_id long, text string, lang string, source string, n_chars long, `_row` string, `_kept` string, n_words string, component_id string"


def table(seed=21):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [say(rng.randint(51, 140)) for _ in range(70)]
    junk = " ".join(f"w{i}###" for i in range(60))
    texts += [texts[3] + " tail", texts[3] + " end", texts[4], "too short", "", None, " \n", say(9000), junk, junk + " more", say(60) + " " + " ".join(f"q{i}" for i in range(12))]
    rows = [[i, t, rng.choice(["en", "en", "de", None]), rng.choice(["src0", "src0", "src0", "src2", "src12", None]), 0] for i, t in enumerate(texts)]
    rows += [list(rows[5]), list(rows[5]), [6, say(80), "en", "src0", 0], [6, "short", "en", "src0", 0], [None, say(70), "en", "src0", 0], [None, say(70), None, None, 0]]
    rows += [[None, texts[9], "en", "src0", 0], [None, None, None, None, None]]
    return [tuple(r) + ("a", "b", "c", "d") for r in rows]


def failed(text):
    w = words(text)
    spots = {}
    for k in range(len(w) - 2):
        spots.setdefault(tuple(w[k : k + 3]), []).append(k)
    repeated = len({q for v in spots.values() if len(v) > 1 for k in v for q in range(k, k + 3)})
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    base = len(w) < 50 or 100 * repeated > 50 * len(w)
    return base, 100 * symbols > 10 * sum(map(len, w)) or len(lines) - len(set(lines)) > 3 or 100 * repeated > 30 * len(w)


def good(rows):
    hosts = {}
    for r in rows:
        n, k = hosts.get(r[3], (0, 0))
        hosts[r[3]] = (n + 1, k + any(failed(r[1])))
    total, bad = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    m = bad / total
    extra = (sum(k * k / n for n, k in hosts.values()) - bad * m - (len(hosts) - 1) * m * (1 - m)) / (total - sum(n * n for n, _ in hosts.values()) / total)
    s = min(200.0, max(2.0, m * (1 - m) / extra - 1)) if extra > 1e-9 else 200.0
    rate = {h: (k + s * m) / (n + s) for h, (n, k) in hosts.items()}
    worse = {h for h, (n, _) in hosts.items() if rate[h] - 0.5 * (rate[h] * (1 - rate[h]) / (n + s + 1)) ** 0.5 > m}
    return [r for r in rows if not failed(r[1])[0] and not (failed(r[1])[1] and r[3] in worse)]


def unlike(rows):
    """Groups of near-duplicate rows; of each, what may stay: its rows of the smallest id."""
    sets, group = [shingles(r[1], 5) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    out = []
    for g in sorted(set(group)):
        mine = [r for r, x in zip(rows, group) if x == g]
        low = min(((r[0] is None, r[0] or 0) for r in mine))
        out.append([r for r in mine if (r[0] is None, r[0] or 0) == low])
    return out


def shares(budget, kids):
    """Whole parts of a budget by weight, none above a child's cap: {name: (weight, cap)}."""
    order = sorted(kids, key=lambda c: (Fraction(kids[c][1], kids[c][0]), c))
    got, left = {}, budget
    while order:
        total = sum(kids[c][0] for c in order)
        if kids[order[0]][1] * total > kids[order[0]][0] * left:
            break
        got[order[0]] = kids[order[0]][1]
        left -= got[order.pop(0)]
    total = sum(kids[c][0] for c in order)
    for c in order:
        got[c] = kids[c][0] * left // total
    spare = budget - sum(got.values())
    for c in sorted(order, key=lambda c: (-(kids[c][0] * left % total), c))[:spare]:
        got[c] += 1
    return got


def drawn(rows):
    """What the mixture takes: each leaf's rows in the order of their hash until its quota is met."""
    domain = lambda s: "web" if s == "src0" else "reference" if s in {f"src{i}" for i in range(1, 10)} else "community"
    leaves = {}
    for r in rows:
        leaves.setdefault((domain(r[3]), r[2] or "?", r[3] or "?"), []).append(r)
    size = {k: sum(len(words(r[1])) for r in v) for k, v in leaves.items()}
    weight = lambda level, name: mixing.WEIGHTS[level][0].get(name, mixing.WEIGHTS[level][1])
    total = sum(size.values())
    top = {}
    for (d, _, _), n in size.items():
        top[d] = (weight("domain", d), top.get(d, (0, 0))[1] + n)
    out = []
    for d, b in shares(min(int(total * mixing.SHARE), total), top).items():
        langs = {}
        for (x, la, _), n in size.items():
            if x == d:
                langs[la] = (weight("lang", la), langs.get(la, (0, 0))[1] + n)
        for la, q in shares(b, langs).items():
            for s, quota in shares(q, {k[2]: (weight("source", k[2]), size[k]) for k in size if k[:2] == (d, la)}).items():
                mine = leaves[d, la, s]
                if quota == size[d, la, s]:
                    out += mine
                    continue
                at = 0
                for r in sorted(mine, key=lambda r: (hashlib.md5(f"{mixing.SEED}:0:{'?' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, len(words(r[1])))):
                    if at < quota:
                        out.append(r)
                    at += len(words(r[1]))
    return out


def test_stages_against_plain_python(spark, tmp_path):
    rows = table()
    passage = " ".join(f"q{i}" for i in range(12))
    items = [(1, passage), (None, rows[0][1]), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    listed = lambda xs: sorted(map(tuple, xs), key=repr)
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            got = listed(docs.collect())
        if name == "quality_rules":
            assert got == listed(good(left)) and len(got) < len(left)
        elif name == "near_duplicates":
            groups = unlike(left)
            assert len(got) == len(groups) and all(sum(r in got for r in set(g)) == 1 for g in groups)
        elif name == "decontamination":
            assert got == listed(r for r in left if not brute_hits(r[1], items)[1]) and len(got) < len(left)
        elif name == "mixture":
            want = drawn(left)
            assert sorted((str(r[0]), len(words(r[1]))) for r in got) == sorted((str(r[0]), len(words(r[1]))) for r in want)
            assert 0 < len(got) < len(left) and all(r in left for r in got)
        else:
            shards = sorted(((r.shard, r.slot, r.doc_id, r.size) for r in out.collect()), key=lambda r: r[:2])
            line = sorted(((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 8) for r in left))
            total, at, slots, want = sum(n for _, n in line), 0, {}, []
            assert sorted((-1 if i is None else i, n) for _, _, i, n in shards) == line
            for _, _, i, n in shards:
                s = min(p.SHARDS - 1, (2 * at + n) * p.SHARDS // (2 * total))
                want.append((s, slots.get(s, 0)))
                slots[s], at = slots.get(s, 0) + 1, at + n
            assert [r[:2] for r in shards] == want
        if k < 4:
            left = got
    assert p.run(spark, str(tmp_path)).count() == len(left)


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_no_documents(spark, tmp_path, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], KIND)
    assert p.STAGES[stage][1](spark, empty, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, None, None, None, None, "x", "x", "x", "x")], KIND).withColumn("_ROW_", F.lit(1)).drop("_row")
    out = p.STAGES[stage][1](spark, some, str(tmp_path))
    assert out.count() == (0 if stage == 0 else out.count()) and (stage == 4 or out.columns == some.columns)
