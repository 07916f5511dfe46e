import random
import time
from itertools import product

import pytest

from tesserae.llm import html_text


@pytest.fixture(scope="module")
def trees():
    return html_text.model()


def test_held_out_pages(trees):
    r = random.Random(4321)
    pages = [html_text.example_page(r) for _ in range(200)]
    got = html_text.extract([p for p, _ in pages], trees)
    assert sum(g == t for g, (_, t) in zip(got, pages)) >= 180


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body><nav><ul>
<li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now, it is good.</div>
<article><h1>A   title
of it</h1><p><b>Bold &amp; <i>sl</i>anted.<br>Next line &quot;x&quot;.<p>Second para with enough words to be one, as it is.</p>{more}</article>
<footer>&copy; example.org &middot; All of it is ours.</footer></body></html>"""


def test_whole_article_and_nothing_else(trees):
    long = "".join(f"<p>Sentence number {i} is here, and it is read.</p>" for i in range(3000))
    text = 'A title of it Bold & slanted. Next line "x". Second para with enough words to be one, as it is.'
    assert html_text.extract([PAGE.format(more="")], trees) == [text]
    want = " ".join([text, *(f"Sentence number {i} is here, and it is read." for i in range(3000))])
    assert html_text.extract([PAGE.format(more=long)], trees) == [want]


@pytest.mark.parametrize("cut", ["<p", "<p>Rest &am", "<!-- open", "<script>var", "</article", '<a href="x'])
def test_cut_off_pages(trees, cut):
    got = html_text.extract([PAGE.format(more="@@").split("@@")[0] + cut], trees)[0]
    assert got.startswith("A title of it") and "<" not in got and got.endswith("Rest &am" if "Rest" in cut else "as it is.")


def test_decoding_is_consistent(trees):
    r = random.Random(5)
    for _ in range(50):
        page = html_text.Page(html_text.example_page(r)[0])
        margins = [r.uniform(-3, 3) for _ in range(page.size)]
        kept = html_text.decode(page, margins)
        assert len(kept) == page.size
    page = html_text.Page("<article><p>abcdef</p><div class=ad>xyz</div></article>")
    assert html_text.decode(page, [5, 5, 5, 5]) == [True] * 4 and html_text.decode(page, [-5] * 4) == [False] * 4


def test_table(spark, trees):
    rows = [(1, None, 5), (2, "", 6), (3, PAGE.format(more=""), 7), (3, PAGE.format(more=""), 7), (None, "plain", 8)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, n_chars int")
    got = html_text.extract_column(df, trees=trees).orderBy("page_id", "n_chars").collect()
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""] and got[-1].text == got[-2].text != ""
    assert html_text.extract_column(df.limit(0), trees=trees).count() == 0
    with pytest.raises(ValueError):
        html_text.extract_column(df.withColumn("text", df.html))


def test_decoding_against_every_consistent_choice():
    """Small trees: the best of all choices of keep all, drop all and decide below, by enumeration."""
    import math

    r = random.Random(11)
    for _ in range(150):
        n = r.randint(1, 7)
        page = html_text.Page("")
        page.above = [-1] + [r.randrange(i) for i in range(1, n)]
        page.own = [r.choice([0, 3, 40]) for _ in range(n)]
        page.size = n
        margins = [r.uniform(-8, 8) for _ in range(n)]
        own = [max(-6.0, min(6.0, m)) * (0.25 + math.log1p(k)) for m, k in zip(margins, page.own)]
        best = (-math.inf, None)
        for choice in product("KDM", repeat=n):
            if any(choice[i] != choice[a] for i, a in enumerate(page.above) if a >= 0 and choice[a] != "M"):
                continue  # under a kept or dropped node nothing else is chosen
            if any(c == "M" and i and choice[page.above[i]] != "M" for i, c in enumerate(choice)):
                continue
            value = sum(o if c == "K" else -o if c == "D" else abs(o) - 0.5 for o, c in zip(own, choice))
            best = max(best, (value, tuple(c == "K" or c == "M" and o > 0 for o, c in zip(own, choice))))
        kept = html_text.decode(page, margins)
        chosen = best[1]
        assert tuple(kept) == chosen or abs(_value(page, own, kept) - best[0]) < 1e-9


def _value(page, own, kept):
    """The best value of a choice that keeps exactly ``kept``."""
    def below(i):
        children = [k for k in range(page.size) if page.above[k] == i]
        mixed = abs(own[i]) - 0.5 + sum(below(k) for k in children) if kept[i] == (own[i] > 0) else -1e9
        return max(mixed, whole(i, kept[i]))

    def whole(i, value):
        if kept[i] != value:
            return -1e9
        return (own[i] if value else -own[i]) + sum(whole(k, value) for k in range(page.size) if page.above[k] == i)

    return below(0)


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</span>" * 40_000, "<ul><li><ul>" + "<span>" * 40_000 + "<li></li>" * 40_000, "<p>" + "<b>" * 40_000 + "<div></div>" * 40_000, "<li><p>" * 40_000, '<a ">' * 40_000, "<a b='" * 40_000, "<script>" * 40_000, "<!--" * 40_000, "&amp" * 100_000])
def test_time_in_proportion(page):
    began = time.time()
    html_text.Page(page)
    assert time.time() - began < 8


ANNOTATED = [
    ("<body><div id=page><div class='site-head'><a href=/>Home</a> <a href=/n>News</a></div><div class=story-text><h2>Rain returns to the valley</h2><p>After nine dry weeks the rain came back on Sunday night.</p><p>Farmers said it was late, but not too late.</p></div><div class=rail><h4>Most read</h4><ol><li><a href=1>Cars</a><li><a href=2>Cats</a></ol></div></div>", "Rain returns to the valley After nine dry weeks the rain came back on Sunday night. Farmers said it was late, but not too late."),
    ("<html><nav class=top><a href=a>A</a><a href=b>B</a></nav><main><h1>How to prune roses</h1><ul><li>Wait for the last frost to pass.</li><li>Cut above a bud that looks outward.</li></ul><p>Feed them afterwards, and water well.</p></main><footer>Contact | Imprint</footer></html>", "How to prune roses Wait for the last frost to pass. Cut above a bud that looks outward. Feed them afterwards, and water well."),
    ("<div class='wrapper'><div class='cookie-banner'>We use cookies. <button>Accept</button></div><article class=post><h1>On bridges</h1><p>A bridge is a promise between two banks, and engineers keep it.</p><blockquote><p>It held, he said.</p></blockquote></article><section id=comments><h3>2 comments</h3><div class=comment>First!</div><div class=comment>I disagree with all of this, strongly.</div></section></div>", "On bridges A bridge is a promise between two banks, and engineers keep it. It held, he said."),
    ("<table><tr><td class=menu><a href=x>Start</a><br><a href=y>Archive</a></td><td class=content><p>The old mill was built in 1820 and burned down twice.</p><p>What stands today is the third one, with its wheel of oak.</p></td></tr></table>", "The old mill was built in 1820 and burned down twice. What stands today is the third one, with its wheel of oak."),
    ("<body><header><h1>Tea</h1></header><p>Tea is a drink made from leaves, and it is drunk hot.</p><p>It came to Europe in the seventeenth century by ship.</p><aside><p>Sponsored: buy our mugs today!</p></aside><form class=newsletter><label>Mail</label><input><button>Join</button></form></body>", "Tea is a drink made from leaves, and it is drunk hot. It came to Europe in the seventeenth century by ship."),
]


def test_pages_written_by_hand(trees):
    """Not from the generator: words found and words wrongly kept, over all of them."""
    found = wrong = total = 0
    for source, want in ANNOTATED:
        got, have = html_text.extract([source], trees)[0].split(), want.split()
        found += sum(w in got for w in have)
        total += len(have)
        wrong += sum(w not in have for w in got)
    assert found >= 0.7 * total and wrong <= 0.1 * total  # as the README states: articles without a box of their own suffer


_PROSE = [
    "The river rises in the northern hills and flows for ninety miles before it meets the sea, where a small harbour town has stood for centuries.",
    "Its upper course is steep and wooded; in spring, meltwater makes it dangerous to cross, and several bridges have been lost to floods.",
    "Farmers in the lower valley depend on it for irrigation. A treaty divides the water between the two provinces, though both complain about it.",
    "In recent years, scientists have measured falling levels of oxygen in the estuary, which they blame on fertiliser washed in from the fields.",
    "The council has promised to plant trees along the banks, to shade the water and to hold back the soil when heavy rain comes down.",
    "Whether that will be enough is disputed, but most people who live there agree that something had to be done.",
]
_P, _NAV = "".join(f"<p>{x}</p>" for x in _PROSE), '<nav><a href="/">Home</a> <a href="/a">About</a> <a href="/c">Contact</a></nav>'
_FOOT = '<footer><p>Copyright 2024 Example Ltd.</p><a href="/p">Privacy</a></footer>'
_H = "<h1>The river and the town</h1>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{_H}{_P}{_FOOT}</body></html>", f"<html><body>{_NAV}{_H}{_P}{_FOOT}</body></html>", f"<html><body><main>{_P}</main></body></html>", f"<html><body><main>{_H}{_P}</main></body></html>",
        f'<html><body><div class="topic-body">{_P}</div></body></html>', f"<html><body>{_NAV}<article>{_H}{_P}</article>{_FOOT}</body></html>", f"<html><body>{_NAV}<div>{_H}{_P}</div>{_FOOT}</body></html>",
        _P, _PROSE[0] + " " + " ".join(_PROSE[1:]), f"<html><body>{_NAV}{_H}{'<br><br>'.join(_PROSE)}{_FOOT}</body></html>", f"<html><body><table><tr><td>{_NAV}</td><td>{_H}{_P}</td></tr></table>{_FOOT}</body></html>",
        f'<html><body><div id="root"><div class="layout"><div class="col-8">{_H}{_P}</div><div class="col-4 sidebar"><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div></div></div>{_FOOT}</body></html>',
    ],
)
def test_articles_without_a_box_of_their_own(page):
    (got,) = html_text.extract([page], html_text.model())
    title = "The river and the town " if _H in page else ""
    assert got == title + " ".join(_PROSE)
