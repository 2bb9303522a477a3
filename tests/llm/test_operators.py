"""Training-data operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from terrace.llm import contamination, html, licenses, minhash, mixing, quality, secrets, sharding, tokens, urls
from terrace.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=80):
    """Rows with copies near and exact, nulls, blanks, ties, repeats and one long text."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "über", "delta,", "the", "of", "Éa", "x1"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(n // 2)]
    for t in texts[: n // 4]:
        w = t.split()
        for _ in range(1 + len(w) // 40):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append("  ".join(w).upper() if rng.random() < 0.2 else "\n".join([" ".join(w[:10]), " ".join(w[10:])]))
    texts += [texts[0]] * 3 + [None, "", " \t\n", "one", "ONE", "one two", " a b", " ".join(rng.choice(vocabulary) for _ in range(5000))]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src3", "src12", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "null id", "en", "src1", 7), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, DOCS).repartition(3).withColumn("component", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("size", F.lit(2))


def shingles(text, width):
    w = words(lower(text))
    return set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width):
    sets = [(i, shingles(t, width)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    rows, df = docs
    want = brute_components(rows, width)
    got = minhash.near_duplicates(df, width).collect()
    assert len(got) == len(rows)
    assert any(c != i for i, c in want.items())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.doc_id, r.component_id, r.kept) == (r.doc_id, want[r.doc_id], want[r.doc_id] == r.doc_id)
    sizes = {(i, len(shingles(t, width))) for i, t, *_ in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes


def test_near_duplicates_of_a_bucket_that_no_hub_resolves(spark):
    """Copies of one text, each edited in places of its own: the first is far from many of the others."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w, share = list(base), 0.02 if i % 3 else 0.09
        for k in rng.sample(range(200), int(200 * share) or 1):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w), "en", "src0", 0))
    want = brute_components(rows, 2)
    assert len(set(want.values())) > 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 2).collect()}
    assert got == want


def test_estimate_follows_similarity(spark):
    import numpy as np

    a, b = [f"s{i}" for i in range(400)], [f"s{i}" for i in range(40, 440)]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    sig = minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    x, y = sig.orderBy("doc_id").select(F.col("sig")).collect()
    both = spark.createDataFrame([(x[0], y[0])], "x array<long>, y array<long>")
    assert both.select(minhash.estimate(F.col("x"), F.col("y"))).first()[0] == pytest.approx(360 / 440, abs=0.15)
    assert np.bitwise_count(np.uint64(3)) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {k: 200 for k in range(200, 260)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(docs):
    rows, df = docs
    got = quality.judged(df).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        windows = {}
        for k in range(len(w) - 2):
            windows.setdefault(tuple(w[k : k + 3]), []).append(k)
        hit = {p for v in windows.values() if len(v) > 1 for k in v for p in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_of_hosts(spark):
    prose = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}###" for i in range(60))
    rows = [(i, junk, "en", "bad", 0) for i in range(40)] + [(100 + i, prose, "en", "bad", 0) for i in range(4)]
    rows += [(200 + i, prose, "en", f"good{i % 9}", 0) for i in range(90)] + [(300, junk, "en", "good1", 0)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[i].kept for i in range(40))
    assert all(got[100 + i].kept for i in range(4))
    assert got[300].kept and got[300].soft_failed


def test_shards(docs):
    rows, df = docs
    got = sharding.byte_shards(df, 7).collect()
    size = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    assert len(got) == len(rows) and {(r.doc_id, r.size, r.text_crc32) for r in got} == size
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert all(abs(sum(r.size for r in v) - total / 7) <= max(r.size for r in got) for v in by.values())
    line = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in line]
    assert ids == sorted(ids) and {r.law for r in got} == {"bytes"}


def water(budget, children):
    """Fill children {name: (weight, cap)} by weight; a plain loop in whole tokens up to rounding."""
    got, left, open_ = dict.fromkeys(children, 0.0), float(budget), {c for c, (w, cap) in children.items() if w and cap}
    while open_ and left > 1e-9:
        total = sum(children[c][0] for c in open_)
        full = {c for c in open_ if children[c][1] - got[c] <= left * children[c][0] / total}
        for c in full or open_:
            got[c] += (children[c][1] - got[c]) if full else left * children[c][0] / total
        left = budget - sum(got.values())
        open_ -= full
        if not full:
            break
    return got


def test_mixing_budgets(spark):
    rows, k = [], 0
    for domain, lang, source, n in [("a", "en", "s1", 5), ("a", "en", "s2", 50), ("a", "de", "s1", 30), ("b", "en", "s3", 200), ("b", "fr", "s4", 1), ("c", "en", "s9", 90)]:
        for _ in range(n):
            rows.append((k, " ".join(["t"] * (1 + k % 9)), lang, f"{domain}-{source}", 0))
            k += 1
    rows += [(None, None, None, None, None), (k, "", "en", "a-s1", 0)]
    df = spark.createDataFrame(rows, DOCS)
    domain = F.split_part("source", F.lit("-"), F.lit(1))
    weights = {"domain": ({"a": 60, "b": 40}, 0), "lang": ({"en": 3}, 1), "source": ({}, 1)}
    out = mixing.mixed(df, domain, weights, budget=1100, max_epochs=2, seed=3)
    got = out.collect()
    caps = {}
    for i, t, la, s, _ in rows:
        if s and s[0] in "ab":
            caps[(s[0], la, s)] = caps.get((s[0], la, s), 0) + 2 * len((t or "").split())
    sub = lambda *p: sum(v for key, v in caps.items() if key[: len(p)] == p)
    tops = water(min(1100, sum(caps.values())), {d: (w, sub(d)) for d, w in (("a", 60), ("b", 40))})
    taken = {}
    for r in got:
        taken[(r.domain, r.lang, r.source)] = taken.get((r.domain, r.lang, r.source), 0) + r.take_tokens
    for d, b in tops.items():
        langs = {key[1] for key in caps if key[0] == d}
        for la, q in water(b, {la: (3 if la == "en" else 1, sub(d, la)) for la in langs}).items():
            for s, v in water(q, {key[2]: (1, caps[key]) for key in caps if key[:2] == (d, la)}).items():
                assert taken.get((d, la, s), 0) == pytest.approx(v, abs=3)
    assert sum(r.take_tokens for r in got) == min(1100, sum(caps.values()))
    # each leaf's rows are a prefix of its epochs' seeded orders
    for leaf in taken:
        mine = [r for r in got if (r.domain, r.lang, r.source) == leaf]
        last = max(r.epoch for r in mine)
        held = [i for i, t, la, s, _ in rows if (la, s) == leaf[1:] and t is not None]
        order = sorted(held, key=lambda i: hashlib.md5(f"3:{last}:{i}".encode()).hexdigest())
        ids = sorted((r for r in mine if r.epoch == last), key=lambda r: r.order_key)
        assert [r.doc_id for r in ids] == order[: len(ids)]
        for e in range(last):
            assert sorted(r.doc_id for r in mine if r.epoch == e) == sorted(held)
    assert mixing.mixed(df, domain, weights, budget=1100, max_epochs=2, seed=3).exceptAll(out).count() == 0


def test_urls(spark):
    pages = [
        (1, "https://WWW.Example.org/es/1?x=1#y"),
        (2, "http://a.example.org/en/12"),
        (3, "http://example.org/en/2"),
        (4, "https://x.com/de/1"),
        (5, "https://x.com/fr/1"),
        (6, "https://org"),
        (7, None),
        (8, "no scheme"),
        (9, "http://example.net?q/1"),
        (10, "http://notorg/en/1"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judged_urls(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 10
    want = {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/de/", "block"), 5: ("com/fr/", "allow"), 6: (None, "allow")}
    for k, w in want.items():
        assert (got[k].rule, got[k].verdict) == w
    assert (got[1].host, got[1].path) == ("www.example.org", "/es/1")
    assert (got[7].host, got[7].path, got[8].host, got[9].host, got[9].path) == ("", "", "", "example.net", "")


def test_host_reputation(spark):
    pages, labels, k = [], [], 0
    for host, n, bad in [("spam.example.net", 30, 29), ("fine.example.net", 60, 1), ("ok.example.net", 50, 0), ("one.example.net", 1, 1)]:
        for i in range(n):
            pages.append((k, f"http://{host}/en/{k}"))
            labels.append((k, 0 if i < bad else 1, 0))
            k += 1
    pages.append((k, "http://spam.example.net/en/none"))
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = urls.judged_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r.verdict for r in got if r.host == "spam.example.net"} == {"block"}
    assert {r.verdict for r in got if r.host in ("fine.example.net", "ok.example.net")} == {"allow"}
    assert len(got) == len(pages)


ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_secrets(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    texts = [
        None,
        "",
        f'token = "{digest[:40]}" and é𝒳 Password:hunter2hunter2 secret=short password: token: abcdefghijk',
        f"{digest} AKIA{'A1' * 8} AKIAAKIA {digest}{digest}",
        "api_key=AKIA" + "B" * 20 + " apikey:' x API_KEY=\"deadbeef00\"",
        "key qZ7Rt0pLx9Wm3Kd8Vb2Nc6Ys1Hg4Jf5 here",
        "internationalization_of_everything_2 superlongidentifierName12 4465758382889437 SOME_UPPER_NAME_OF_DOCUMENTS",
        ("filler words " * 3000) + f"passwd={digest[:20]}",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    ordinary = [(100 + i, "the international organisation configures something interesting about documents and identifiers of user names") for i in range(30)]
    df = spark.createDataFrame(rows + ordinary, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in secrets.production(df, labels).collect()}
    assert len(got) == len(rows) + len(ordinary)
    for i, t in rows:
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in spans if not s.startswith("markov")] == want
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
    assert got[5].spans == "markov:4:35"
    assert got[6].n_markov == 0 and all(got[100 + i].spans == "" for i in range(30))


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for k in range(max(1, len(v) - 9)) if v and item is not None else ():
            window = v[k : k + 10]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    places.update(range(at, at + len(window)))
                    found.add(item)
    return len(w), len(places), sorted(map(str, found))


@pytest.mark.parametrize("bits", [24, 6])
def test_contamination(spark, docs, bits):
    """Against brute force; filters of very few bits hold everything and change nothing."""
    rows, df = docs
    items = [(1, rows[0][1]), (2, "one two"), (10, rows[5][1][:60]), (3, None), (4, "!!"), (None, "one"), (2, "ONE"), (5, " ".join(words(rows[9][1])[3:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("clash"))
    got = contamination.contaminated(df.withColumn("_row", F.lit(0)), bench, filter_bits=bits, count_bits=min(bits, 18)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *brute_hits(t, items)[:2], ",".join(brute_hits(t, items)[2])) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == want
    assert any(r.contaminated for r in got) and all(r.contaminated == (r.n_hit > 0) for r in got)
    assert all(r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in got)
    assert contamination.contaminated(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_by_a_shared_window(spark):
    """One passage in very many documents and items, windows that overlap, repeat, or lie at either end, and a long text."""
    passage = " ".join(f"q{i}" for i in range(14))
    texts = [f"{passage} tail"] * 9000 + [f"head {passage}", passage + " " + passage, " ".join(f"q{i}" for i in range(9)), "w " * 200_000 + passage, "q0 " + passage[3:].upper()]
    items = [(i, passage) for i in range(3)] + [(7, "tail"), (8, "q5 q6 q5")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in contamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all((got[i].n_words, got[i].n_hit, got[i]["items"]) == (15, 15, ["0", "1", "2", "7"]) for i in range(9000))
    assert [(got[9000 + i].n_words, got[9000 + i].n_hit) for i in range(5)] == [(15, 14), (28, 28), (9, 0), (200_014, 14), (14, 14)]


def test_licenses(spark):
    texts = [
        None,
        "",
        "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3. MIT license",
        "Licensed under CC BY-NC 4.0.",
        "released under the old mit license; licensed under the very apache license version 2",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.licenses(df).collect()}
    assert [got[i].labels for i in range(8)] == ["", "", "mit", "apache,apache-2.0", "gpl,gpl-3.0,mit", "cc-by-nc", "apache,mit", "isc"]
    assert [got[i].base_labels for i in range(8)] == ["", "", "mit", "apache", "gpl,mit", "", "apache,mit", ""]
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].n_words) == (2, 7, 12, 14)
    assert got[0].first_word is None and [got[i].score for i in (0, 2, 6)] == [0.0, 1.0, 0.5]


def test_automaton_regions():
    a = licenses.Automaton([("x", "a b <<optional>>c d<</optional>> <<any 2>> e <<optional>>z<</optional>>")])
    for text, want in [("a b e", True), ("q a b c d e", True), ("a b c e", True), ("a b x y z e", False), ("a b x y e", True), ("a b c d x y e", True), ("a x b e", False)]:
        assert bool(a.labels(licenses.words_of(text.encode()))) == want, text


def template_pattern(template):
    """A pattern over words with blanks between, by another reading of a template's marks."""
    out, first = "", True
    for piece in re.split(r"(<<optional>>|<</optional>>|<<any \d+>>)", template):
        if piece == "<<optional>>":
            out += "(?:"
        elif piece == "<</optional>>":
            out += ")?"
        elif piece.startswith("<<any"):
            out += "(?: [^ ]+){0,%s}" % piece[6:-2]
        else:
            out += "".join(f" {w}" for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", piece.lower()))
    return re.compile(out.replace("(?:)?", "") + "(?= )")


def test_licenses_against_patterns(spark):
    """Notices as templates have them, with parts left out, filled, or broken, in null, repeated and very long rows."""
    rng = random.Random(12)
    texts = [None, "", "x" * 100_000 + " MIT License", "mit license " * 30_000]
    for label, template in licenses.TEMPLATES:
        for _ in range(6):
            text = re.sub(r"<<optional>>((?:(?!<<optional>>).)*?)<</optional>>", lambda m: m[1] if rng.random() < 0.5 else " ", template)
            text = re.sub(r"<</?optional>>", " ", re.sub(r"<<any (\d+)>>", lambda m: " w" * rng.randint(0, int(m[1]) + 1) + " ", text))
            w = text.split(" ")
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = "broken"
            texts.append("Before. " + " ".join(x.capitalize() if rng.random() < 0.1 else x for x in w) + " After.")
    rows = [*enumerate(texts), (5, texts[5]), (None, "MIT License")]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    patterns = [(label, template_pattern(t)) for label, t in licenses.TEMPLATES]
    want, several = [], set()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        line = " " + " ".join(w) + " "
        spots = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        own = {label for label, p in patterns if len(line) < 90_000 and p.search(line)}
        several |= own
        want.append((str(i), len(w), len(spots), min((k for k, _ in spots), default=None), max((k for k, _ in spots), default=None), ",".join(sorted({x for _, x in spots} | own))))
    assert sorted(((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in got), key=repr) == sorted(want, key=repr)
    assert several == {label for label, _ in licenses.TEMPLATES}


def test_templates_that_are_refused():
    for bad in ("<<any 2>> a", "a <<any 2>>", "<<optional>>x<</optional>> <<any 1>> b", "a <<optional>>b", "a b<</optional>>", "<<optional>>a<</optional>>", ""):
        with pytest.raises(ValueError):
            licenses.Automaton([("x", bad)])


def test_html():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        '<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p>First  para,\n with <b>bold</b> text.<p>Second, para.<br>More.</p>'
        '<ul><li>One thing, and more words.</li><li>Two things, and more.</li></ul><aside>Side.</aside><form>Search <input></form><script>var x = "</p>";</script></article>'
        '<section id="comments"><p>Nice post, really.</p></section><footer>&copy; us</footer></body></html>'
    )
    want = ["Head & line", "First para, with bold text.", "Second, para. More.", "One thing, and more words.", "Two things, and more."]
    assert html.main_text(page) == "\n\n".join(want)
    assert html.main_text("") == "" and html.main_text("just words, here.") == "just words, here."
    assert html.main_text("<nav>a</nav><script>x") == ""
    assert html.main_text("<div><p>Long enough prose, with commas.</p><p>More prose, again.</p></div>").count("\n\n") == 1


def test_html_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<p>Some text, here.</p>"), (3, "v", "<p>Some text, here.</p>"), (4, "w", "<p>" + "word, " * 20000 + "</p>")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 0), (3, 16), (3, 16), (4, 20000 * 6 - 1)]


@pytest.mark.parametrize("buckets", [64, 1])
def test_rollup(spark, tmp_path, buckets):
    roll = tokens.Rollup(spark, str(tmp_path / "roll"), buckets)
    kind = "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long"
    put = lambda name, rows: roll.commit(name, spark.createDataFrame(rows, kind).withColumn("bucket", F.lit("clash")))
    first = [("insert", 1, "t", "s", "en", 10), ("insert", 2, "t", "s", "en", 5), ("insert", 3, "t", None, None, 7), ("insert", None, "t", "s", "en", 1), ("insert", 4, None, "s", "en", 9)]
    assert put("a", first)
    assert not put("a", [("insert", 9, "t", "s", "en", 1000)])
    assert put("b", [("revise", 1, "t", "s", "en", 4), ("delete", 2, "t", None, None, None), ("delete", 77, "t", None, None, None), ("insert", 1, "u", "s", "en", 3)])
    assert put("c", [])
    assert put("d", [("revise", 1, "u", "z", "de", 8), ("insert", 5, "t", "s", "en", None), ("insert", 6, "t", "s", "en", 2), ("insert", 6, "t", "s", "fr", 3)])
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert got == {("s", "en", "t"): (4, 7), ("s", "fr", "t"): (1, 3), (None, None, "t"): (1, 7), ("z", "de", "u"): (1, 8)}
    assert put("e", [("delete", 6, "t", None, None, None), ("revise", 6, "t", "s", "en", 50), ("delete", None, "t", None, None, 1), ("revise", 3, "t", "s", "en", 1)])
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert got == {("s", "en", "t"): (3, 5), ("z", "de", "u"): (1, 8)}
    assert sorted((r.doc_id, r.tokenizer, r.n_tokens) for r in roll.state().collect()) == [(1, "t", 4), (1, "u", 8), (3, "t", 1), (5, "t", 0)]
    assert roll.batches() == ["a", "b", "c", "d", "e"]


def slow_bpe(ranks, text):
    """Tokens of a text: pieces by the pattern, then the lowest-ranked pair merged until none is left."""
    import regex

    n = 0
    for piece in regex.findall(tokens.PIECES, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, k = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        n += len(parts)
    return n


def test_token_counts(spark, docs):
    """Every column of the totals against a loop over rows, repeated and null ids included."""
    import base64

    rows, df = docs
    path = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    got = {(r.tokenizer, r.source, r.lang): (r.n_docs, r.n_tokens) for r in tokens.production(df).collect()}
    want = {}
    for _, t, la, s, _ in rows:
        for name, k in (("words/1", len(words(t))), ("byte_bpe_50k/1", slow_bpe(ranks, t or ""))):
            n, m = want.get((name, s, la), (0, 0))
            want[(name, s, la)] = (n + 1, m + k)
    assert got == want
    assert tokens.production(df.limit(0)).count() == 0


def test_long_texts_count_as_whole():
    import base64

    path = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
    count = tokens.bpe_counter(path)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    assert count("hello world") == 2 and count("") == 0
    # pieces recur, so a long text counts a multiple of a short one and its first and last words
    for unit in ("alpha  ", "internationalization  ", "\tif x:\n\t\treturn  y\n", "中文", "a-b  \n "):
        few, more = slow_bpe(ranks, unit * 40), slow_bpe(ranks, unit * 41)
        if not unit.isalpha():
            assert count(unit * 20_000) == few + (20_000 - 40) * (more - few), unit
    assert count("x" * 200_000) <= 200_000
    for run in (" " * 5000, " \n" * 3000, "\t" * 1000):
        for text in (run, run + "word", "word" + run, "a" + run + "b" + run + "\n", "a" + run + "\xa0."):
            assert count(text) == slow_bpe(ranks, text), (run[:3], text[:3])
    assert count(" " * 2_000_000 + "x") > 0


@pytest.mark.parametrize("name", ["quality", "near", "shards", "mix", "secrets", "contaminated", "licenses"])
def test_empty_tables(spark, name):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {
        "quality": lambda: quality.judged(empty),
        "near": lambda: minhash.near_duplicates(empty),
        "shards": lambda: sharding.byte_shards(empty, 3),
        "mix": lambda: mixing.production(empty),
        "secrets": lambda: secrets.production(empty, labels),
        "contaminated": lambda: contamination.contaminated(empty, spark.createDataFrame([(1, "x")], "item_id long, text string")),
        "licenses": lambda: licenses.licenses(empty),
    }[name]()
    assert out.count() == 0


def test_pipeline(spark, tmp_path):
    """The stages against plain Python over the same rows."""
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(60, 120))]
        rows.append([i, " ".join(t), rng.choice(["en", "de"]), rng.choice(["src0", "src0", "src2", "src11"]), 0])
    passage = " ".join(f"q{i}" for i in range(20))
    rows += [[60 + i, rows[i][1] + " tail", *rows[i][2:]] for i in range(5)]
    rows += [[70, "too short", "en", "src0", 0], [71, None, "en", "src0", 0], [72, rows[40][1] + " " + passage, "en", "src0", 0]]
    spark.createDataFrame([tuple(r) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in out.collect()})
    assert ids[0] == {r[0] for r in rows} - {70, 71}
    near = brute_components([tuple(r) for r in rows if r[0] in ids[0]], 5)
    assert ids[1] == {i for i, c in near.items() if i == c}
    assert 60 not in ids[1]
    assert ids[2] == ids[1] - {72}
    assert ids[3] <= ids[2] and ids[3] and ids[4] == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[4])


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    """Rows that share an id, or have none, have a fate of their own in each stage."""
    import corpus_pipeline as p

    rng = random.Random(4)
    text = lambda n=80: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage = " ".join(f"q{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, pairs):
        df = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in pairs], DOCS)
        out = stage(spark, df.repartition(3), str(tmp_path))
        assert out.columns == df.columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    a, b, c, d = (text() for _ in range(4))
    short, leak = "too short", c + " " + passage
    assert left(p.good_quality, [(None, a), (None, short), (None, None), (1, b), (1, short)]) == sorted([(None, a), (1, b)], key=repr)
    assert left(p.no_benchmark, [(None, a), (None, leak), (1, b), (1, leak), (2, leak)]) == sorted([(None, a), (1, b)], key=repr)
    near = a + " tail"
    pairs = [(5, a), (5, a), (3, near), (None, a), (None, near), (None, b), (None, b), (7, c), (7, d), (7, d), (None, c)]
    assert left(p.one_of_each, pairs) == sorted([(3, near), (None, b), (7, c), (7, d)], key=repr)
    for name in (None, 4):
        drawn = left(p.target_mix, [(name, text(100)) for _ in range(50)])
        assert len(drawn) == len(set(drawn)) == 30


def test_html_names_alone_drop_no_article():
    story = "<p>A long story, with commas, and more of it.</p><p>Its second part, just as long, ends here.</p>"
    want = "A long story, with commas, and more of it.\n\nIts second part, just as long, ends here."
    for page in (
        f'<div class="content has-sidebar">{story}</div>',
        f'<main class="no-sidebar">{story}</main>',
        f'<article class="post no-comments">{story}</article>',
        f'<div class="sidebar"><article>{story}</article></div>',
        f'<div id="widget">{story}</div><p class=share>Like, share.</p>',
        f'<div title="Hidden costs">{story}</div>',
        f'<div data-id="share" data-class=\'ad\' alt="role=menu">{story}</div>',
        f"<div class=ad-free>{story}</div>",
        f'<article>{story}<p id="x" class="left site-footer">Our site, ever.</p><div class="share-buttons">Share, please.</div><p hidden="">Unseen, of course.</p></article>',
        f'<article>{story}</article><section id="comments"><article class="comment"><p>Nice, really.</p></article></section>',
    ):
        assert html.main_text(page) == want, page


def secret_model(spark):
    words_ = "the international organisation configures something interesting about documents and identifiers of user names"
    plain = [(100 + i, words_) for i in range(30)]
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    return plain, labels, secrets.trained(spark.createDataFrame(plain, "doc_id long, text string"), labels)


def test_secret_stretches(spark):
    """The best stretch of each run against all stretches; letters beyond ASCII end runs, and no shape is asked of keys."""
    key, path = "qZ7Rt0pLx9Wm3Kd8Vb2Nc6Ys1Hg4Jf5", "the/international/organisation/configures/something/interesting/"
    plain, _, table = secret_model(spark)
    n, short = len(secrets.ALPHABET), "7"
    while len(short) < 16:  # a likely random string of 16 symbols
        at = secrets.ALPHABET.index(short[-1]) * n
        short += max((x for x in secrets.ALPHABET if x not in short), key=lambda x: table[at + secrets.ALPHABET.index(x)])
    texts = [f"key “{key}”", f"中文{key}", short, "qZxRtkpLxQWmzKdJVbwNcXYsHgqJfB", path * 4 + key, "the international organisation über documents", None, key[:15]]
    texts += [f"token: {key} and {key}", f"secret=short {key}", "1593" * 8]
    df = spark.createDataFrame([*enumerate(texts), *plain, (None, key), (7, key), (7, key)], "doc_id long, text string")
    rows = secrets.secrets(df.withColumn("_base", F.lit("clash")).withColumn("_all", F.lit("clash")), table).collect()
    assert len(rows) == df.count() and sorted(r.spans for r in rows if r.doc_id in (None, 7) and r.spans) == ["markov:0:31"] * 3
    got = {r.doc_id: r.spans for r in rows if r.doc_id != 7}
    for i, text in enumerate(texts):
        if i == 7:
            continue
        want = []
        masked = re.sub("token: " + key, " " * (7 + len(key)), text or "")
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", masked):
            c = [secrets.ALPHABET.index(x) for x in m[0]]
            p = [0]
            for a, b in zip(c, c[1:]):
                p.append(p[-1] + table[a * n + b])
            score, _, s, e = max((p[e] - p[s], -e, s, e) for s in range(len(p)) for e in range(s + 1, len(p)))
            e += 1
            while s and m[0][s - 1].isalnum():
                s -= 1
            while e < len(m[0]) and m[0][e].isalnum():
                e += 1
            if score >= secrets.LEAST_RATIO and re.search("[A-Za-z]", m[0][s:e]):
                want.append((m.start() + s, m.start() + e))
        found = [tuple(map(int, x.split(":")[1:])) for x in got[i].split(",") if x.startswith("markov")]
        assert found == want, (text, found, want)
        assert found or i in (3, 5, 6, 10), text
    assert all(got[100 + i] == "" for i in range(30))


def test_secrets_in_very_many_places(spark):
    """Matches over several chunks stand where a plain search finds them, and their number costs no square of time."""
    import time

    _, _, table = secret_model(spark)
    rng = random.Random(6)
    one = "".join(f"{'é' * rng.randint(1, 3)} token={rng.getrandbits(40):010x} {rng.getrandbits(140):035x}\n" for _ in range(1300))
    many = "token=0123456789 " * 60_000
    df = spark.createDataFrame([(1, one), (2, many)], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in secrets.secrets(df, table).collect()}
    assert time.perf_counter() - start < 60
    assert [s for s in got[1].spans.split(",") if not s.startswith("markov")] == base_spans(one)
    assert got[2].n_assign == 60_000 and got[2].spans.endswith(f"assign:{17 * 59_999}:{17 * 60_000 - 1}")


def test_secret_model_without_labels(spark):
    """No labels leave the ordinary model even; labelled samples alone tell the two kinds apart."""
    plain, labels, table = secret_model(spark)
    docs = spark.createDataFrame([*plain, (1, "token=" + "zqzq" * 6)], "doc_id long, text string")
    none = secrets.trained(docs, labels.limit(0))
    at = lambda t, pair: t[secrets.ALPHABET.index(pair[0]) * len(secrets.ALPHABET) + secrets.ALPHABET.index(pair[1])]
    assert at(none, "th") == pytest.approx(0, abs=700) and at(table, "th") < -1500
    more = secrets.trained(docs, labels.unionByName(spark.createDataFrame([(1, 0, 1), (1, 0, None)], labels.schema)))
    assert at(more, "zq") > at(table, "zq") + 300
    assert secrets.production(docs.limit(0), labels).count() == 0


def test_hashes_keep_words_apart(spark):
    """Words that a polynomial over powers of two can't tell apart, long words, and equal sets in another order."""
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b] for b in thue), "".join("ba"[b] for b in thue))
    long = "x" * 300
    rows = [(1, one), (2, two), (3, long), (4, long[:-1] + "y"), (5, long[:100] + "z" + long[101:]), (6, "p q r p q"), (7, "q r p q r"), (8, "P  q\nr p q"), (8, one)]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (7, 1), (8, 1), (8, 1)]


def test_joins_spread_hot_keys(spark):
    from terrace.llm.common import spread_join, written

    rows = written(spark.range(3000).select(F.when(F.col("id") % 3 < 2, 7).when(F.col("id") % 2 == 0, F.col("id")).alias("k"), "id"))
    facts = spark.createDataFrame([(7, "hot"), (8, "cold"), (None, "none")], "k long, v string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(facts, "k", how).collect()), key=repr)
        got = spread_join(rows, facts, "k", how, part=100)
        assert sorted(map(tuple, got.select("k", "id", "v").collect()), key=repr) == want


def test_quality_through_hosts(spark, monkeypatch):
    """The posterior of hosts against plain Python, and other verdicts where it is taken away; null and repeated rows, no rows."""
    rng = random.Random(8)
    prose, junk = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60))
    share = {"a": 0.5, "b": 0.1, "c": 0.1, "d": 0.2, None: 0.1, "one": 1.0}
    rows = [(i, junk if rng.random() < share[h] else prose, "en", h, 0) for i, h in enumerate(["a", "b", "c", "d", None] * 30 + ["one"])]
    rows += [rows[0], (None, junk, "en", "a", 0), (None, None, None, None, None)]
    got = quality.judged(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("_name", F.lit("clash"))).collect()
    hosts = {}
    for _, t, _, h, _ in rows:
        n, k = hosts.get(h, (0, 0))
        hosts[h] = (n + 1, k + (t != prose))
    total, bad = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    m = bad / total
    spread = sum(k * k / n for n, k in hosts.values()) - bad * m - (len(hosts) - 1) * m * (1 - m)
    extra = spread / (total - sum(n * n for n, _ in hosts.values()) / total)
    strength = min(200.0, max(2.0, m * (1 - m) / extra - 1)) if extra > 1e-9 else 200.0
    condemned = set()
    for h, (n, k) in hosts.items():
        r = (k + strength * m) / (n + strength)
        if r - 0.5 * (r * (1 - r) / (n + strength + 1)) ** 0.5 > m:
            condemned.add(h)
    assert "a" in condemned and not {"b", "c"} & condemned
    assert len(got) == len(rows)
    assert all(r.kept == (not r.base_failed and not (r.soft_failed and r.host in condemned)) for r in got)
    assert any(r.kept != (not r.base_failed) for r in got)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    again = quality.judged(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_quality_verdicts_depend_on_hosts_of_like_rates(spark):
    """Among hosts that differ little, the worst of them lose what fails softly."""
    rng = random.Random(2)
    prose, junk = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60))
    rows = [(i, junk if rng.random() < 0.2 else prose, "en", f"h{i % 20}", 0) for i in range(1000)]
    got = quality.judged(spark.createDataFrame(rows, DOCS)).collect()
    gone = {r.host for r in got if not r.kept}
    assert 0 < len(gone) < 10 and all(r.kept for r in got if not r.soft_failed)


def test_reputation_of_awkward_pages(spark, monkeypatch):
    kind, marks = "page_id long, url string", "doc_id long, quality int, toxic int"
    empty, none = spark.createDataFrame([], kind), spark.createDataFrame([], marks)
    assert urls.judged_urls(empty, none).count() == 0
    pages = [(k, f"http://spam.net/en/{k}") for k in range(20)] + [(20 + k, f"http://h{k % 5}.fine.com/en/{20 + k}") for k in range(60)]
    pages += [(None, "http://spam.net/x"), (None, None), (3, "http://spam.net/en/3"), (90, "http://10.0.0.7/en/4"), (91, "http://" + "a" * 50_000 + ".net/en/1" + "x" * 50_000)]
    labels = [(k, int(k >= 20), 0) for k in range(80)] + [(3, 1, None), (3, 0, 0), (None, 0, 1), (25, None, None)]
    df, lab = spark.createDataFrame(pages, kind).withColumn("verdict", F.lit("clash")).withColumn("bad", F.lit(1)), spark.createDataFrame(labels, marks)
    got = urls.judged_urls(df, lab).collect()
    assert len(got) == len(pages)
    assert {r.verdict for r in got if r.host == "spam.net"} == {"block"}
    assert {r.verdict for r in got if r.host.endswith("fine.com")} == {"allow"}
    assert urls.judged_urls(df, none).where("verdict = 'block'").count() == 0
    one = spark.createDataFrame([("10.0.0.7",), ("a.b.co.uk",), ("x.y.zz",), ("zz",)], "h string")
    assert [tuple(r) for r in one.select(urls.suffix_of(F.col("h")), urls.registered_of(F.col("h"))).collect()] == [("10.0.0.7", "10.0.0.7"), ("co.uk", "b.co.uk"), ("zz", "y.zz"), ("zz", "zz")]
    assert one.select(urls.registered_of(F.col("h"), ["y.zz"])).collect()[2][0] == "x.y.zz"
    monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, urls.judged_urls(df, lab).collect())) == sorted(map(repr, got))


@pytest.mark.parametrize("name", ["near", "mix", "contaminated"])
def test_joins_beyond_broadcast(spark, docs, monkeypatch, name):
    """The same rows where no side is small enough to be broadcast."""
    from terrace.llm import common

    rows, df = docs
    items = spark.createDataFrame([(1, rows[0][1]), (2, "one two")], "item_id long, text string")
    make = {
        "near": lambda: minhash.near_duplicates(df),
        "mix": lambda: mixing.production(df),
        "contaminated": lambda: contamination.contaminated(df, items),
    }[name]
    want = sorted(map(repr, make().collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, make().collect())) == want


@pytest.mark.parametrize("most", [8192, 0])
def test_rows_by_number(spark, monkeypatch, most):
    from terrace.llm import common

    monkeypatch.setattr(common, "BROADCAST_BITMAPS", most)
    keyed = common.written(spark.range(0, 90_000, 1, 3).select(F.col("id").alias("v"), F.monotonically_increasing_id().alias("k"), F.lit("clash").alias("_bucket"), F.lit("clash").alias("_bits")))
    rows = keyed.where("v % 7 = 3 or v in (0, 32767, 32768, 89999)").select("k")
    got = common.having(keyed, "k", rows)
    assert got.columns == keyed.columns
    assert sorted(r.v for r in got.collect()) == sorted(v for v in range(90_000) if v % 7 == 3 or v in (0, 32767, 32768, 89999))
    assert common.having(keyed, "k", rows.limit(0)).count() == 0


def test_mixing_of_one_id(spark):
    """Many rows of one id or none, equal or not, are drawn to the token; other columns, even of names used inside, don't matter."""
    rows = [(None, "a b c", "en", "src0", 0)] * 300 + [(7, "a b", "en", "src0", 0)] * 300 + [(7, " ".join("x" * (k % 5 + 1)), "en", "src0", 0) for k in range(50)] + [(8, "w " * 30_000, "de", "src0", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    for name in ("_part", "_origin", "_name", "epoch", "take_tokens"):
        df = df.withColumn(name, F.lit("clash"))
    weights = {"domain": ({}, 1), "lang": ({}, 1), "source": ({}, 1)}
    for budget in (1, 100, 901, 1700, 2500):
        got = mixing.mixed(df, F.lit("d"), weights, budget=budget, max_epochs=1).collect()
        assert sum(r.take_tokens for r in got) == budget
        assert sum(r.take_tokens < r.n_tokens for r in got) <= 2 and all(0 <= r.take_tokens <= r.n_tokens for r in got)


def test_word_hashes_by_segments(monkeypatch):
    """Cuts of a long text change no word: those of one byte at a time, within words, in gaps and at the end."""
    import numpy as np

    from terrace.llm import hashing

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 9, 70, 300]))) for _ in range(200)).encode() + b"   "
    for raw in (text, b" ", b"   ", b"x ", b"x" * 500 + b" "):
        data = np.frombuffer(raw, np.uint8)
        gap = data == 32
        monkeypatch.setattr(hashing, "SEGMENT", 1 << 22)
        want = hashing.hashed_words(data, gap)
        for size in (1, 2, 7, 64, 1000):
            monkeypatch.setattr(hashing, "SEGMENT", size)
            assert all(np.array_equal(a, b) for a, b in zip(want, hashing.hashed_words(data, gap)))
        assert [raw[s:e] for s, e in zip(*want[:2])] == raw.split()
