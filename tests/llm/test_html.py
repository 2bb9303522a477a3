"""The main text of pages against path ratios counted another way, and through the ratios alone."""

import random
from html.parser import HTMLParser
from statistics import pstdev

from pyspark.sql import functions as F

from terrace.llm import html

GONE = {"nav", "footer", "aside", "form"}


class Paths(HTMLParser):
    """(path, text, characters in links, within a removed element) of each block of a page whose every element is closed."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.out = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)

    def handle_endtag(self, tag):
        assert self.stack.pop() == tag

    def handle_data(self, data):
        if data.strip() and self.stack and "script" not in self.stack:
            path = "/".join(t for t in self.stack if t not in ("a", "b"))
            self.out.append((path, data.strip(), len(data) if "a" in self.stack else 0, not GONE.isdisjoint(self.stack)))


def expected(page):
    """Texts of paths that pass, by plain loops; for pages of one level, without articles, whose content paths are next to each other."""
    found = Paths(page).out
    keys = list(dict.fromkeys((p, gone) for p, _, _, gone in found))
    length, marks = [], []
    for key in keys:
        mine = [(t, a) for p, t, a, gone in found if (p, gone) == key]
        length.append(sum(max(0, len(t) - a) for t, a in mine) / len(mine))
        marks.append(1 + sum(t.count(c) for t, _ in mine for c in ".,;:!?") / len(mine))
    fused = []
    for i in range(len(keys)):
        before, after = max(i - 1, 0), min(i + 1, len(keys) - 1)
        fused.append((length[before] + 2 * length[i] + length[after]) / 4 * (marks[before] + 2 * marks[i] + marks[after]) / 4)
    own = {k[0]: f for k, f in zip(keys, fused) if not k[1]}
    least = min(pstdev([min(f, max(own.values())) for f in fused]), max(own.values()))
    return {p for p, f in own.items() if f >= least}, found


def pages(n=60, seed=3):
    rng = random.Random(seed)
    for _ in range(n):
        say = lambda k: " ".join(rng.choice("lorem ipsum, dolor sit. amet; elit".split()) for _ in range(k)) + "."
        menu = "".join(f"<li><a>{say(2)}</a></li>" for _ in range(rng.randint(2, 9)))
        notes = "".join(f"<span><i>{say(rng.randint(1, 3))}</i></span>" for _ in range(rng.randint(0, 2)))
        prose = "".join(f"<p>{say(rng.randint(15, 80))}</p>" for _ in range(rng.randint(2, 8)))
        yield f"<html><body><nav><ul>{menu}</ul></nav><div><ul>{menu}</ul></div><section>{say(2)}</section><div>{prose}</div><footer>{say(4)}</footer>{notes}</body></html>"


def test_ratios_and_content_paths_follow_a_second_count():
    for page in pages():
        want, found = expected(page)
        blocks, _ = html.blocks_of(page)
        assert html.content_paths(html.fused_ratios(blocks)) == want
        prose = [t for p, t, _, gone in found if p.endswith("div/p")]
        assert html.main_text(page) == "\n\n".join(prose)


def test_the_ratios_decide(monkeypatch):
    """With the ratios of paths exchanged, other text comes out, of articles too."""
    story = "".join(f"<p>A long part {i}, with commas, and so on, to its end.</p>" for i in range(5))
    plain = list(pages())
    articles = [f"<body><nav><a>Home</a></nav><article><h1>Head</h1>{story}</article><footer>Us</footer></body>"] * 5
    before = [html.main_text(p) for p in plain + articles]
    assert before[-1].startswith("Head\n\nA long part 0,") and before[-1].count("\n\n") == 5
    real = html.fused_ratios

    def reversed_(blocks):
        ratios = real(blocks)
        up = sorted(ratios, key=ratios.get)
        return dict(zip(up, sorted(ratios.values(), reverse=True)))

    monkeypatch.setattr(html, "fused_ratios", reversed_)
    after = [html.main_text(p) for p in plain + articles]
    assert all(a != b for a, b in zip(before, after))


def test_pages_without_an_article():
    prose = [f"Paragraph {i} has words, commas, and an end." for i in range(4)]
    body = "".join(f"<p>{t}</p>" for t in prose)
    for page in (
        f"<body><div class=menu><a href=/>Home</a> <a href=/x>More</a></div><div>{body}</div><div><a href=/a>Next story</a></div></body>",
        f"<body><header><h2>Site</h2></header><div><div>{body}</div></div><ul><li><a href=/>One</a><li><a href=/>Two</a></ul></body>",
        f"<table><tr><td><a href=/>Home</a></td><td>{body}</td></tr></table>",
    ):
        assert html.main_text(page) == "\n\n".join(prose), page


def test_whole_articles():
    """Short blocks, lists and tables of an article stay, wherever they stand in it."""
    prose = "Enough words for a paragraph, with commas, and its end."
    page = (
        f"<header>Site</header><article><header><h1>Title</h1><p>By Ann</p></header><p>{prose}</p><ul><li>one</li><li>two</li></ul><p>{prose}</p>"
        f"<table><tr><td>1</td><td>2</td></tr></table><p>Ok.</p><nav><a href=/>Up</a></nav><div class=comments><p>{prose}{prose}{prose}</p></div></article>"
        f"<section class='comments'><p>{prose * 5}</p><p>{prose * 9}</p></section>"
    )
    assert html.main_text(page).split("\n\n") == ["Title", "By Ann", prose, "one", "two", prose, "1", "2", "Ok."]


def test_awkward_tables(spark):
    kind = "page_id long, url string, html string"
    assert html.extracted(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, None, None), (None, "u", "<p>A, b.</p>"), (1, "u", "\n "), (1, "u", "<p")]
    got = html.extracted(spark.createDataFrame(rows, kind).withColumn("n_chars", F.lit("clash"))).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("1", ""), ("None", ""), ("None", "A, b.")]


def test_names_of_what_surrounds_an_article():
    story = "<p>A long story, with commas, and more of it, so that it is one.</p><p>Its second part, just as long, ends here, at last.</p>"
    want = "A long story, with commas, and more of it, so that it is one.\n\nIts second part, just as long, ends here, at last."
    gone = "cookie-banner gdpr_banner site-header pageHeader header banner newsletter-signup cookieConsent sidebarRight commentsSection comment-thread ad-slot AD related-posts subscribe-form copyright share-tools"
    for name in gone.split():
        extra = f"<div class='{name}'><p>Words that surround, one by one, an article; as they do.</p></div>"
        for page in (f"<body>{extra}<div id=main>{story}</div></body>", f"<body><article>{story}</article>{extra}</body>"):
            assert html.main_text(page) == want, (name, page)
    for name in "article-header post-content has-sidebar main-content story-body entry no-ads adventure commentary headline".split():
        assert html.main_text(f"<article><div class='{name}'><h1>Title</h1>{story}</div></article>") == "Title\n\n" + want, name
