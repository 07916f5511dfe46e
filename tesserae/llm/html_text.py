"""Main text of web pages: boosted trees over DOM nodes, decoded hierarchically.

A page is parsed into element nodes (blocks, and inline elements that carry a
class, id or role).  Each node has features of its subtree (text and link
density, elements), attribute tokens of its own and of its ancestors, depth, and
statistics of its siblings.  Gradient-boosted trees, trained on pages that
:func:`example_page` generates with labels (a bounded, documented number, fixed
seed), give each node a log odds.  Decoding maximises the summed evidence over
trees of choices *keep all*, *drop all* or *decide below*; a node under a kept or
dropped one has no other choice, so no contradiction can come out.

Nothing is cut: every kept block of the whole page is returned.

Edge cases: a null or empty page, or one without kept text, gives an empty
string; unclosed tags, comments, scripts and cut-off tags at the end are read as
browsers do; character references are decoded once; a page takes time in
proportion to its length, however deep or broken its markup; other columns pass
through (``__page`` is refused); repeated rows give equal texts; an empty table
gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.boost import Boosted

#: Pages that the model is trained on.
EXAMPLES = 1200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|template|iframe|svg|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</([a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-z/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
_SENTENCE = re.compile(r"[.!?;:,](?=\s|\Z)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
#: An open <p> ends where one of these begins.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAGS = ("p", "h1 h2 h3 h4 h5 h6", "li", "ul ol menu dl", "nav", "aside", "header", "footer", "article", "main", "section", "div", "form fieldset label button input", "table tr td th tbody", "blockquote pre", "a", "span", "body html", "head")
_TAG_OF = {t: i for i, names in enumerate(_TAGS) for t in names.split()}
_GOOD = frozenset("article content main post entry body story text page prose copy paragraph headline".split())
#: Kinds of attribute tokens that stand for page furniture.
_BAD = [frozenset(x.split()) for x in (
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner",
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "sidebar aside widget rail related recommended recommend more trending popular",
    "footer foot bottom copyright legal", "header head masthead top logo topbar",
    "comment comments reply replies respond discussion disqus thread",
    "cookie cookies consent notice alert gdpr popup modal overlay message",
    "share social sharing follow subscribe newsletter signup login form search")]


class Page:
    """The nodes of a page, in page order, and its pieces of text."""

    __slots__ = ("above", "kind", "name", "own", "links", "puncts", "tokens", "pieces", "size")

    def __init__(self, source: str):
        self.above, self.name, self.tokens = [-1], ["body"], [""]
        self.own, self.links, self.puncts = [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = []  # open elements and their nodes
        many: dict[str, int] = {}  # open elements by name, so that none is looked for in vain
        blocks: list[int] = []  # where the stack holds blocks

        def shut_from(k: int) -> None:
            for t, _ in stack[k:]:
                many[t] -= 1
            del stack[k:]
            while blocks and blocks[-1] >= k:
                blocks.pop()

        node, anchors, at = 0, 0, 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()], node, anchors)
            at = m.end()
            start, end = m[3], m[2]
            if start:
                name = start.lower()
                if name in _VOID:
                    if name not in _INLINE:
                        self.pieces.append((node, " "))
                    continue
                shut = {"p"} if name in _ENDS_P else _ENDS.get(name)
                if shut and any(map(many.get, shut)):
                    for k in reversed(blocks):  # at most two of them: an open p ends where a block begins
                        if stack[k][0] in shut:
                            shut_from(k)
                            anchors = many.get("a", 0)
                            break
                        if stack[k][0] != "p":
                            break
                    node = stack[-1][1] if stack else 0
                found = " ".join(a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[4])) if "=" in m[4] else ""
                if name not in _INLINE or found:
                    self.above.append(node)
                    self.name.append(name)
                    self.tokens.append(found)
                    self.own.append(0)
                    self.links.append(0)
                    self.puncts.append(0)
                    node = len(self.name) - 1
                if name not in _INLINE:
                    self.pieces.append((node, " "))
                if not m[4].endswith("/"):
                    if name not in _INLINE:
                        blocks.append(len(stack))
                    stack.append((name, node))
                    many[name] = many.get(name, 0) + 1
                    anchors = many.get("a", 0)
                else:
                    node = stack[-1][1] if stack else 0
            elif end:
                name = end.lower()
                if many.get(name):
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    shut_from(k)
                    anchors = many.get("a", 0)
                    node = stack[-1][1] if stack else 0
                if name not in _INLINE:
                    self.pieces.append((node, " "))
        if at < len(source):
            self._text(source[at:], node, anchors)
        self.size = len(self.name)

    def _text(self, raw: str, node: int, anchors: int) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append((node, text))
        if n := len(text.strip()):
            self.own[node] += n
            self.puncts[node] += len(_SENTENCE.findall(text))
            if anchors:
                self.links[node] += n

    def text(self, kept) -> str:
        return " ".join("".join(t if t == " " or kept[i] else "" for i, t in self.pieces).split())


def _token_kinds(tokens: str) -> list[int]:
    words = {w.lower() for w in _WORD.findall(tokens)}
    return [len(words & _GOOD), *[int(bool(words & kind)) for kind in _BAD]]


_NO_TOKENS = [0] * (1 + len(_BAD))
N_FEATURES = 2 + len(_TAGS) + 2 * (1 + len(_BAD)) + 5 + 13


def features(page: Page):
    """A row of features for each node."""
    n, above = page.size, page.above
    chars, links, puncts, elements, children = page.own[:], page.links[:], page.puncts[:], [1] * n, [0] * n
    for i in range(n - 1, 0, -1):
        a = above[i]
        chars[a] += chars[i]
        links[a] += links[i]
        puncts[a] += puncts[i]
        elements[a] += elements[i]
        children[a] += 1
    total = max(1, chars[0])
    place, seen = [0] * n, [0] * n
    brothers: dict = {}
    before = [0] * n
    running = 0
    for i in range(n):
        before[i] = running
        running += page.own[i]
        if i:
            place[i] = seen[above[i]]
            seen[above[i]] += 1
            key = (above[i], page.name[i])
            brothers[key] = brothers.get(key, 0) + 1
    rows, inherited, inside, depth = [], [_NO_TOKENS] * n, [(0,) * 5] * n, [0] * n
    kinds: dict = {"": _NO_TOKENS}
    watch = ("nav", "aside", "footer", "form", "article")
    for i in range(n):
        a, name, tokens = above[i], page.name[i], page.tokens[i]
        if tokens not in kinds:
            kinds[tokens] = _token_kinds(tokens)
        own = kinds[tokens]
        if i:
            depth[i] = depth[a] + 1
            inherited[i] = inherited[a] if own is _NO_TOKENS else [max(x, y) for x, y in zip(own, inherited[a])]
            inside[i] = tuple(x or name == w for x, w in zip(inside[a], watch)) if name in watch else inside[a]
        else:
            inherited[i] = own
        tag = [0] * (2 + len(_TAGS))
        tag[_TAG_OF.get(name, len(_TAGS))] = 1
        tag[-1] = int(name == "header" and not inside[i][4])
        c, e, siblings = chars[i], elements[i], children[a] if i else 1
        rows.append([
            *tag, *own, *inherited[i], *inside[i],
            math.log1p(c), c / total, links[i] / max(1, c), c / e, math.log1p(e), puncts[i] / max(1, c) * 50, page.own[i] / max(1, c),
            depth[i], place[i] / max(1, siblings), math.log1p(siblings), brothers.get((a, name), 1) / max(1, siblings), c / max(1, chars[a]) if i else 1, before[i] / total,
        ])
    return rows


def decode(page: Page, margins) -> list[bool]:
    """Kept or not, for each node: the best consistent choice of keep / drop / decide below."""
    n = page.size
    own = [max(-6.0, min(6.0, m)) * (0.25 + math.log1p(k)) for m, k in zip(margins, page.own)]
    keep, drop, mixed = own[:], [-x for x in own], [abs(x) - 0.5 for x in own]
    for i in range(n - 1, 0, -1):
        a = page.above[i]
        keep[a] += keep[i]
        drop[a] += drop[i]
        mixed[a] += max(keep[i], drop[i], mixed[i])
    kept, forced = [False] * n, [False] * n
    for i in range(n):
        if i and forced[page.above[i]]:
            kept[i], forced[i] = kept[page.above[i]], True
        elif max(keep[i], drop[i]) >= mixed[i]:
            kept[i], forced[i] = keep[i] > drop[i], True
        else:
            kept[i] = own[i] > 0
    return kept


# -- training pages ------------------------------------------------------------


def _words(r: random.Random, low: int, high: int) -> str:
    syllables = "an be con der es fi gra hel in jo ka lor men no ou per qui ra st tion und ver wo ye zu".split()
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for i in range(0, len(words), r.randint(5, 12)):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += r.choice(".....!?,;")
    return " ".join(words) + r.choice([".", ".", "."])


def example_page(r: random.Random) -> tuple[str, str]:
    """A generated page and its main text."""
    article: list[str] = []
    names = lambda *x: r.choice(x)

    def links(k: int) -> str:
        return "".join(f'<a href="/{i}">{_words(r, 1, 3)[:-1]}</a>{names(" ", " | ", "")}' for i in range(k))

    def items(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_words(r, 1, 3)[:-1]}</a></li>' for i in range(k)) + "</ul>"

    def prose(low=4, high=70) -> str:
        return "\n".join(_words(r, low, high) for _ in range(r.randint(1, 2)))

    def attr(*tokens: str) -> str:
        return f' {names("class", "class", "id")}="{names(*tokens)}"'

    def ad() -> str:
        return f"<{(t := names('div', 'div', 'aside', 'section', 'p'))}{attr('ad', 'ads', 'advert', 'ad-slot', 'banner', 'sponsored', 'promo box')}>{prose(2, 30) if r.random() < 0.7 else links(2)}</{t}>"

    def notice() -> str:
        return f"<div{attr('cookie-notice', 'notice', 'consent-banner', 'alert', 'gdpr', 'cookie')}><p>{prose(4, 25)}</p>{names('', '<button>Ok</button>')}</div>"

    def form() -> str:
        return f"<form{names('', attr('search', 'newsletter', 'subscribe', 'login'))}><p>{prose(2, 14)}</p><label>{_words(r, 1, 3)}</label><input name=q><button>{_words(r, 1, 2)}</button></form>"

    def side() -> str:
        t = names("aside", "aside", "div", "section")
        body = names(items(r.randint(2, 8)), f"<h3>{_words(r, 1, 4)}</h3><p>{prose(4, 40)}</p>", f"<h4>{_words(r, 1, 3)}</h4>{items(4)}<p>{prose(3, 20)}</p>")
        return f"<{t}{attr('sidebar', 'widget', 'related', 'aside', 'side-bar right') if t != 'aside' or r.random() < 0.5 else ''}>{body}</{t}>"

    def comments() -> str:
        t, c = names("div", "section", "ol"), names("comment", "reply", "comment-body")
        return f"<{t}{attr('comments', 'comment-list', 'discussion', 'responses comments')}><h3>{_words(r, 1, 3)}</h3>" + "".join(f'<{names("div", "p", "article")} class="{c}">{prose(4, 50)}' + names("", "<br>") for _ in range(r.randint(1, 6))).replace("<article", "<div") + f"</{t}>"

    def head() -> str:
        if r.random() < 0.4:
            return f"<header><h2>{_words(r, 1, 4)}</h2>{names(items(r.randint(2, 6)), '<p>' + prose(3, 12) + '</p>')}</header>"
        return f"<div{attr('header', 'masthead', 'site-header', 'top')}>{links(3)}<p>{prose(2, 12)}</p></div>"

    def foot() -> str:
        t = names("footer", "footer", "div")
        return f"<{t}{'' if t == 'footer' else attr('footer', 'site-footer', 'copyright')}>{names('&copy; ', '')}{names('', 'example.org &middot; ')}{prose(2, 25)}{names('', links(3), items(4))}</{t}>"

    def nav() -> str:
        return names(f"<nav>{items(r.randint(2, 9))}</nav>", f"<nav>{links(5)}</nav>", f"<div{attr('nav', 'menu', 'breadcrumbs', 'navbar')}>{names(items(5), links(4))}</div>", f"<ul{attr('menu', 'nav')}>{items(4)[4:]}")

    def keep(tag: str, text: str, shut: bool = True) -> str:
        article.append(text)
        return f"<{tag}>{html.escape(text, quote=r.random() < 0.5)}{f'</{tag}>' if shut else ''}"

    parts = []
    title = _words(r, 3, 12)
    heading = keep("h1", title) if r.random() < 0.9 else ""
    parts.append(f"<header>{heading}</header>" if heading and r.random() < 0.1 else heading)
    loose = r.random() < 0.4
    for _ in range(r.choice([1, 1, 2, 4, 8, 14])):
        x = r.random()
        if x < 0.12:
            text = _words(r, 2, 14)
            article.append(text)
            parts.append(f"<p><b>{text}<br>" if loose else f"<h2>{text}</h2>")
        elif x < 0.17:
            parts.append("<ul>" + "".join(keep("li", _words(r, 3, 20)) for _ in range(r.randint(2, 5))) + "</ul>")
        elif x < 0.21:
            parts.append("<blockquote>" + keep("p", prose()) + "</blockquote>")
        elif x < 0.25:
            parts.append("<table>" + "".join("<tr>" + keep("td", _words(r, 1, 6)) + keep("td", _words(r, 1, 6)) + "</tr>" for _ in range(3)) + "</table>")
        elif x < 0.31:
            a, b, c = _words(r, 4, 20), _words(r, 1, 3), _words(r, 4, 20)
            article.append(f"{a} {b} {c}")
            parts.append(f'<p>{a} <a href="/x">{b}</a> {c}</p>')
        else:
            parts.append(keep("p", prose(1 if r.random() < 0.1 else 4), shut=not loose or r.random() < 0.7))
        if r.random() < 0.06:
            parts.append(r.choice([ad, notice, form, side])())
    if r.random() < 0.06:  # paragraphs parted by line ends alone
        more = [_words(r, 8, 70) for _ in range(r.randint(2, 7))]
        article += more
        parts += [names("<br><br>", "<br>", "<br />\n<br />").join(more)]
    token = f"{_words(r, 1, 1)[:-1].lower()}{names('', '-body', '-text', '-8', '_inner', 'Wrap')}"
    box = r.choice([("article", ""), ("article", ""), ("article", attr("post", "story")), ("main", ""), ("main", ""), ("div", attr("content", "post-body", "article", "entry-content", "main")), ("section", attr("story", "content")), ("div", ""), ("div", attr(token)), ("div", ' role="main"'), ("td", ""), None, None, None])
    core = "".join(parts) + r.choice(["", "", "", comments()])
    if box:
        core = f"<{box[0]}{box[1]}>{core}</{box[0]}>"
        if box[0] == "td":
            core = f"<table><tr>{names('', f'<td>{items(3)}</td>', f'<td>{links(4)}</td>')}{core}</tr></table>"
    for _ in range(r.choice([0, 0, 0, 0, 1, 2])):
        core = f"<div{names('', attr('wrapper', 'container', 'page', 'row', token))}>{core}{side() if r.random() < 0.3 else ''}</div>"
    bare = r.random() < 0.2  # little or nothing around the article
    front = [f() for f in (head, nav, ad, notice, side, form) if r.random() < (0.05 if bare else 0.4)]
    r.shuffle(front)
    back = [f() for f in (comments, side, ad, form, nav) if r.random() < (0.05 if bare else 0.3)]
    r.shuffle(back)
    if r.random() < (0.3 if bare else 0.8):
        back.append(foot())
    page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{''.join(front)}{core}{''.join(back)}"
    if bare and r.random() < 0.2:
        page = page[page.index("<body>") + 6 :]
    return page + names("</body></html>", "</body></html>", ""), " ".join(" ".join(article).split())


def _labels(page: Page, source_text: str) -> list[float]:
    """1 for nodes whose own text, or whose subtree's, is of the article: found by reading the text along."""
    wanted, at = source_text.replace(" ", ""), 0
    own = [None] * page.size
    for i, t in page.pieces:
        t = "".join(t.split())
        if t:
            hit = wanted.startswith(t, at)
            if hit:
                at += len(t)
            own[i] = hit if own[i] is None else own[i] or hit
    good, all_ = [0.0] * page.size, [0.0] * page.size
    for i in range(page.size - 1, -1, -1):
        if own[i] is not None:
            good[i] += page.own[i] * own[i]
            all_[i] += page.own[i]
        if i:
            good[page.above[i]] += good[i]
            all_[page.above[i]] += all_[i]
    return [float(g > 0.6 * a) if own[i] is None else float(own[i]) for i, (g, a) in enumerate(zip(good, all_))]


@cache
def model(examples: int = EXAMPLES, seed: int = 17) -> Boosted:
    """The trees, trained on ``examples`` generated pages; the same ones for the same arguments."""
    import numpy as np

    r = random.Random(seed)
    x, y, w = [], [], []
    for _ in range(examples):
        source, text = example_page(r)
        page = Page(source)
        x += features(page)
        y += _labels(page, text)
        w += [0.3 + math.log1p(k) for k in page.own]
    return Boosted(trees=60, depth=5).fit(np.array(x, "f8"), np.array(y), np.array(w) / 3)


def extract(sources: list[str | None], trees: Boosted) -> list[str]:
    """Main texts of whole pages."""
    import numpy as np

    pages = [Page(s or "") for s in sources]
    rows = [row for p in pages for row in features(p)]
    margins = trees.margin(np.array(rows, "f8")).tolist() if rows else []
    out, at = [], 0
    for p in pages:
        out.append(p.text(decode(p, margins[at : at + p.size])))
        at += p.size
    return out


def extract_column(df: DataFrame, page: str = "html", to: str = "text", trees: Boosted | None = None) -> DataFrame:
    """``df`` with ``to`` (the main text of ``page``) in place of ``page``."""
    if clash := ({to, "__page"} - {page}) & set(df.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    trees = trees or model()
    rest = [c for c in df.columns if c != page]
    narrow = df.select(*rest, df[page].alias("__page"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                texts = extract(some.column(some.num_columns - 1).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string())], names=[*rest, to])

    have = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in rest]
    return narrow.mapInArrow(run, ", ".join([*have, f"`{to}` string"]))
