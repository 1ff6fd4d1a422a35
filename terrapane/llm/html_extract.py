"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes with hierarchical decoding.

Each element of a page gets features (subtree text, link and tag density, attribute tokens, tag kind, depth, sibling
statistics) and a probability that its subtree holds main text.  Decoding keeps or drops whole subtrees: a dynamic
programme over the tree takes the most likely choice in which nothing below a dropped element is kept, so ancestor and descendant
decisions never contradict.  The trees are grown from labelled pages; ``labelled_pages`` makes a reproducible set of them.

Text of kept elements becomes blocks: block-level tags end a block, white space becomes one space, blocks are joined
by a newline in page order, character references are decoded.

Defined cases: null or empty html, or a page without main text: an empty string; unclosed and misnested tags are repaired
by implied ends; plain text without tags is main text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .words import slices

_OPEN = re.compile(r"<(?:/?[A-Za-z]|[!?])")
_NAME = re.compile(r"[^\s/>]++")
_MARK = re.compile(r"""["'>]""")
_ATTR = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "math", "xmp", "noembed", "noframes")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul".split())
_IN_P = BLOCK - set("body html legend li dd dt option optgroup tbody td tfoot th thead tr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
GOOD = ("article", "content", "entry", "post", "story", "main", "body", "text", "page", "prose", "blog", "news")
BAD = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc skip", "head": "header masthead topbar banner logo brand hero", "foot": "footer copyright legal colophon bottom", "side": "sidebar aside widget rail related recommended more trending popular tags",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp", "note": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe signup toast", "form": "form search login register input", "talk": "comment comments reply replies discussion disqus respond", "share": "share sharing social follow like tweet print email",
}
BAD_WORD = {w: k for k, words in enumerate(BAD.values()) for w in words.split()}
KINDS = ("p", "h", "li", "list", "a", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "inline", "table", "quote", "top")
_KIND = {"p": 0, **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 1), "li": 2, "dt": 2, "dd": 2, "ul": 3, "ol": 3, "dl": 3, "menu": 9, "a": 4, "div": 5, "section": 6, "article": 7, "main": 8, "nav": 9, "header": 10, "footer": 11, "aside": 12, "dialog": 12, "form": 13, "fieldset": 13, "button": 13, "select": 13, "label": 13, "option": 13, "table": 15, "tbody": 15, "thead": 15, "tr": 15, "td": 15, "th": 15, "blockquote": 16, "pre": 16, "figure": 16, "figcaption": 16, "html": 17, "body": 17}


def tag_end(source: str, at: int, loose: bool) -> int:
    """The place of the ``>`` that ends a tag, -1 for none: the first one outside of quotes, or (loose) the first one."""
    while not loose and (m := _MARK.search(source, at)):
        if m[0] == ">":
            return m.start()
        at = source.find(m[0], m.end()) + 1
        if not at:
            break
    return source.find(">", at) if loose else -1


def markup(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag, comment and declaration, in order; end tags have a name with ``/``, the last two none.

    Linear in any source: once a quote inside a tag is never closed, all further tags end at their first ``>``.
    A caller may send the place where to go on.
    """
    at, last, loose = 0, source.rfind(">"), False
    while m := _OPEN.search(source, at):
        start = m.start()
        if start > last and not source.startswith("<!--", start):
            start = source.find("<!--", start)
            if start < 0:
                return
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            yield start, at, "", ""
            continue
        if m[0] in ("<!", "<?"):
            at = source.find(">", start) + 1
            yield start, at, "", ""
            continue
        name = _NAME.match(source, m.end() - 1)
        end = tag_end(source, name.end(), loose)
        if end < 0:
            loose, end = True, source.find(">", name.end())
        at = end + 1
        went = yield start, at, ("/" if len(m[0]) > 2 else "") + name[0].lower(), source[name.end() : end]
        if went is not None:
            at = went
            yield start, at, "", ""


def attribute_classes(attrs: str) -> tuple[int, int]:
    return short_attribute_classes(attrs) if len(attrs) < 512 else short_attribute_classes.__wrapped__(attrs)


@lru_cache(maxsize=4096)
def short_attribute_classes(attrs: str) -> tuple[int, int]:
    """(bits of the BAD classes, 1 if a GOOD word) among the words of class, id, role, itemprop and aria-label."""
    bad = good = 0
    for a in _ATTR.findall(attrs):
        for w in _SPLIT.split(a.strip("\"'")):
            w = w.lower()
            if w in BAD_WORD:
                bad |= 1 << BAD_WORD[w]
            elif w in GOOD:
                good = 1
    return bad, good


class Stack:
    """The open elements, with the places of those of each tag and of all blocks, so that no end tag has to walk down."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.of, self.blocks = [0], ["#page"], {}, []

    def push(self, node: int, tag: str) -> None:
        self.of.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def innermost(self, tags) -> int:
        return max((x[-1] for t in tags if (x := self.of.get(t))), default=0)

    def cut(self, k: int) -> None:
        """Ends the elements from place k on."""
        for tag in self.tags[k:]:
            self.of[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
        del self.nodes[k:], self.tags[k:]

    def end(self, tag: str) -> None:
        """An end tag: it ends its innermost element, an inline one only if no block was opened since."""
        k = self.innermost((tag,))
        if k and (tag in BLOCK or not self.blocks or k > self.blocks[-1]):
            self.cut(k)

    def imply(self, tags, scope) -> None:
        """Ends the innermost open elements of these tags, unless one of the scope is between."""
        while (k := self.innermost(tags)) > self.innermost(scope):
            self.cut(k)


class Page:
    """Elements in page order (``tag``, ``parent``, ``attrs``) and the texts: (element, decoded text, starts a block).

    Every page has one html and one body element, as HTML's rules for its tree say: they are there before any tag, their tags only bring attributes, and their
    end tags end nothing.  A slash before ``>`` means nothing outside svg and math.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.texts = ["#page", "html", "body"], [-1, 0, 1], [""] * 3, []
        stack, at, fresh = Stack(), 0, True
        stack.push(1, "html")
        stack.push(2, "body")
        found = markup(source)
        for start, after, tag, attrs in found:
            if start > at:
                self._text(source[at:start], stack.nodes[-1], fresh)
                fresh = False
            at = after
            if not tag:
                continue
            if tag.lstrip("/") in BLOCK:
                fresh = True
            if tag == "br" or tag == "/br":
                self._text(" ", stack.nodes[-1], fresh)
            elif tag in ("html", "body"):
                self.attrs[1 + (tag == "body")] += attrs
            elif tag[0] == "/":
                if tag not in ("/html", "/body"):
                    stack.end(tag[1:])
            elif tag in _RAW:
                if not attrs.endswith("/") or tag not in ("svg", "math"):
                    end = _RAW[tag].search(source, at)
                    at = source.find(">", end.end()) + 1 if end else 0
                    at = at or len(source)
                    found.send(at)
            elif tag != "head" and tag not in VOID:
                if tag in _IN_P:
                    stack.imply(("p",), ("table", "td", "button"))
                elif tag in CLOSES:
                    stack.imply(CLOSES[tag], _SCOPE[tag])
                self.tag.append(tag)
                self.parent.append(stack.nodes[-1])
                self.attrs.append(attrs)
                stack.push(len(self.tag) - 1, tag)
        if at < len(source):
            self._text(source[at:], stack.nodes[-1], fresh)

    def _text(self, s: str, node: int, fresh: bool) -> None:
        self.texts.append((node, html.unescape(s) if "&" in s else s, fresh))

    def features(self) -> np.ndarray:
        n, parent = len(self.tag), self.parent
        own, link, stops, words, kids = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        depth, place, good, kind = [0] * n, [0] * n, [0] * n, [17] * n
        bad, above, in_link = [0] * n, [0] * n, [False] * n  # sets of BAD classes and of ancestors' kinds as bits
        same: dict[tuple[int, int], int] = {}
        for i in range(1, n):
            p, t = parent[i], self.tag[i]
            kids[p] += 1
            place[i], depth[i] = kids[p], depth[p] + 1
            in_link[i] = in_link[p] or t == "a"
            k = kind[i] = _KIND.get(t, 14)
            same[p, k] = same.get((p, k), 0) + 1
            above[i] = above[p] | 1 << kind[p] | bad[p] << 32
            if "=" in self.attrs[i]:
                bad[i], good[i] = attribute_classes(self.attrs[i])
        for node, s, _ in self.texts:
            k = len(s)
            own[node] += k
            words[node] += s.count(" ") + 1
            stops[node] += s.count(".") + s.count(",") + s.count("!") + s.count("?")
            if in_link[node]:
                link[node] += k
        sums = np.array([own, link, stops, words, [1] * n, [o if k == 0 else 0 for o, k in zip(own, kind, strict=True)]], float)
        sums[4, 0] = 1
        flat = sums.T.tolist()
        for i in range(n - 1, 0, -1):
            a, b = flat[parent[i]], flat[i]
            a[0] += b[0]
            a[1] += b[1]
            a[2] += b[2]
            a[3] += b[3]
            a[4] += b[4]
            a[5] += b[5]
        total, links, marks, spaces, tags, para = np.array(flat).T
        size, up = np.maximum(total, 1), np.maximum(np.array(parent), 0)
        twins, kid, kinds = np.array([0, *(same[parent[i], kind[i]] for i in range(1, n))]), np.array(kids), np.array(kind)
        cols = [np.log1p(total), np.log1p(sums[0]), links / size, tags / np.sqrt(size), marks / size * 100, spaces / size, total / max(total[0], 1), total / np.maximum(total[up], 1), np.array(depth), np.array(place) / np.maximum(kid[up], 1), kid, twins, kid[up], np.array(good), np.log1p(para), para / size]
        over = np.array(above)
        bits = lambda v, k: (v[:, None] >> np.arange(k)) & 1
        return np.concatenate([np.stack(cols, axis=1), bits(np.array(bad), len(BAD)), bits(over >> 32, len(BAD)), kinds[:, None] == np.arange(len(KINDS)), bits(over >> 6, 8)], axis=1)

    def decode(self, log_odds: np.ndarray) -> list[bool]:
        """The most likely choice that keeps nothing below a dropped element."""
        n = len(self.tag)
        yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
        keep, drop = yes.tolist(), no.tolist()
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
        out = [True] * n
        for i in range(1, n):
            out[i] = out[self.parent[i]] and keep[i] >= drop[i]
        return out

    def blocks(self, kept: list[bool]) -> str:
        out: list[list[str]] = []
        fresh = True
        for node, s, begins in self.texts:
            fresh = fresh or begins
            if kept[node]:
                if fresh or not out:
                    out.append([])
                    fresh = False
                out[-1].append(s)
            else:
                fresh = True
        return "\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def labelled_pages(n: int = 600, seed: int = 3) -> list[str]:
    """Pages as annotators label them (data-y="1" main text, "0" other), made from varied layouts by a seeded generator."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouyéä") + r.choice(("", "", "n", "r", "s", "l")) for _ in range(r.randint(1, 4)))
    sentence = lambda a=4, b=18: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + r.choice((".", ".", ".", "?", "!", ""))
    para = lambda a=1, b=5: " ".join(sentence() for _ in range(r.randint(a, b)))
    cls = lambda *names: r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"', f' class="site-{r.choice(names)}"'))
    links = lambda a=3, b=9: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(a, b)))

    def other(kind: str) -> str:
        body = {
            "menu": lambda: r.choice((f'<nav data-y="0"><ul>{links()}</ul></nav>', f'<div{cls("nav", "menu", "navbar", "breadcrumb")} data-y="0"><ul>{links()}</ul></div>', f'<ul{cls("menu", "tabs", "nav")} data-y="0">{links()}</ul>')),
            "head": lambda: r.choice((f'<header data-y="0"><a href="/">{word()}</a><p>{sentence(2, 6)}</p></header>', f'<header data-y="0">{para(1, 2)}</header>', f'<div{cls("header", "masthead", "topbar", "banner")} data-y="0">{sentence(2, 8)}</div>')),
            "foot": lambda: r.choice((f'<footer data-y="0">{r.choice(("Copyright", "&copy; 20" + str(r.randint(10, 30)), "(c)", word()))} {word()}{r.choice((" | ", ", ", " - ", " &bull; ", ". "))}{sentence(2, 24)}</footer>', f'<footer data-y="0">{para(1, 2)}</footer>', f'<footer data-y="0"><p>{para(1, 2)}</p></footer>', f'<div{cls("footer", "copyright", "legal")} data-y="0"><p>{sentence(3, 12)}</p><ul>{links(2, 5)}</ul></div>')),
            "side": lambda: r.choice((f'<aside data-y="0"><h3>{word()}</h3><ul>{links()}</ul></aside>', f'<div{cls("sidebar", "widget", "related", "trending")} data-y="0"><h4>{sentence(1, 3)}</h4><p>{para(1, 2)}</p></div>', f'<aside data-y="0"><p>{para(1, 3)}</p></aside>')),
            "ad": lambda: f'<div{cls("ad", "ads", "advert", "promo", "sponsored", "advertisement")} data-y="0">{r.choice((para(1, 2), f"<p>{para(1, 2)}</p>", sentence()))}</div>',
            "note": lambda: f'<{(t := r.choice(("div", "section", "dialog")))}{cls("cookie", "consent", "notice", "newsletter", "popup", "alert")} data-y="0"><p>{para(1, 2)}</p>{r.choice(("", "<button>ok</button>"))}</{t}>',
            "form": lambda: f'<form data-y="0"{r.choice(("", " action=/s"))}><label>{sentence(1, 4)}</label><input name="q"><button>{word()}</button>{r.choice(("", f"<p>{sentence()}</p>", "<select><option>a<option>b</select>"))}</form>',
            "talk": lambda: f'<{(t := r.choice(("section", "div", "ol")))}{cls("comments", "comment", "discussion", "replies")} data-y="0">' + "".join(r.choice((f'<div class="comment"><b>{word()}</b><p>{para(1, 3)}</p></div>', f"<p>{para(1, 2)}</p>", f"<li>{para(1, 2)}</li>")) for _ in range(r.randint(1, 5))) + f"</{t}>",
            "share": lambda: f'<div{cls("share", "social", "follow")} data-y="0"><a href="/x">{word()}</a> <a href="/y">{word()}</a></div>',
        }[kind]()
        return body

    def page() -> str:
        top, end, inner = r.sample(("menu", "head", "ad", "note", "form", "side"), r.randint(1, 4)), r.sample(("foot", "side", "talk", "ad", "note", "form", "menu"), r.randint(1, 4)), r.choices((None, "ad", "share", "side", "talk", "note", "form"), (12, 2, 1, 1, 1, 1, 1))[0]
        if "foot" not in end and r.random() < 0.7:
            end.append("foot")
        if "menu" not in top and r.random() < 0.5:
            top.insert(0, "menu")
        if r.random() < 0.25:
            end = ["foot"]
        close = r.random() < 0.8
        parts = [f"<h{r.choice('112')}>{sentence(2, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 1, 1, 2, 2, 3, 5, 8, 14))):
            parts.append(r.choices((f"<p>{para()}{'</p>' if close else ''}", f"<p><{(b := r.choice(('b', 'i', 'em', 'span')))}>{sentence()}{r.choice(('<br>', f'</{b}>', '<br><br>'))}{r.choice(('<p>', '</p><p>'))}{para()}</p>", f"<h2>{sentence(1, 6)}</h2><p>{para()}</p>", f"<blockquote>{para(1, 3)}</blockquote>", f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(r.randint(2, 5)))}</ul>", f"<div>{para()}</div>", f'<p>{para(1, 2)} <a href="/{word()}">{word()}</a> {para(1, 2)}</p>', f"<p>{word()}</p>", f"<pre>{para(1, 2)}</pre>", f"<table><tr><td>{word()}<td>{sentence(1, 5)}</table>"), (12, 3, 3, 1, 1, 2, 3, 1, 1, 1))[0])
        bare = r.random() < 0.1  # no element around the article
        if bare:
            parts = [re.sub(r"<(p|h1|h2|blockquote|ul|div|pre|table)>", r'<\1 data-y="1">', x) for x in parts]
        if inner:
            parts.insert(r.randint(1, len(parts)), other(inner))
        mixed = f' id="{r.choice([w for v in BAD.values() for w in v.split()])}-{r.choice(("wrapper", "wrap", "area", "page"))}" class="{r.choice(GOOD)}-{r.choice(GOOD)}"'
        tag, attr = r.choice((("div", mixed), ("article", ""), ("article", ""), ("article", cls("post", "entry")), ("main", ""), ("div", cls("content", "article", "post", "story", "entry")), ("section", cls("content", "main")), ("div", "")))
        body = "".join(parts) if bare else f'<{tag}{attr} data-y="1">{"".join(parts)}</{tag}>'
        if r.random() < 0.3:
            wrap = r.choice(("div", "main", "section"))
            body = f"<{wrap}{r.choice(('', cls('container', 'wrapper', 'page'), cls('container', 'wrapper', 'page'), mixed))}>{body}{other('side') if r.random() < 0.4 else ''}</{wrap}>"
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{sentence(2, 6)}</title>{r.choice(("", "<style>.x {{ color: red }}</style>"))}</head>'
        return head + "<body>" + "".join(map(other, top)) + body + "".join(map(other, end)) + r.choice(("</body></html>", "</body></html>", ""))

    return [page() for _ in range(n)]


def node_labels(page: Page) -> np.ndarray:
    """1 for elements in or above main text, by the data-y marks."""
    n = len(page.tag)
    mark, out = [-1] * n, np.zeros(n)
    for i in range(1, n):
        m = re.search(r'data-y="([01])"', page.attrs[i])
        mark[i] = int(m[1]) if m else mark[page.parent[i]]
    for i in range(n - 1, -1, -1):
        out[i] = max(out[i], mark[i] == 1)
        if i:
            out[page.parent[i]] = max(out[page.parent[i]], out[i])
    return out


def train(pages: list[str] | None = None) -> BoostedTrees:
    """The trees of labelled pages (default: labelled_pages())."""
    made = [Page(p) for p in (pages if pages is not None else labelled_pages())]
    x, y = np.concatenate([p.features()[1:] for p in made]), np.concatenate([node_labels(p)[1:] for p in made])
    return BoostedTrees(x, y)


@lru_cache(maxsize=1)
def default_model() -> BoostedTrees:
    """The trees of labelled_pages(), grown once in a process."""
    return train()


def extract(sources: list[str], model: BoostedTrees) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    odds = model.log_odds(np.concatenate([p.features() for p in pages]))
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        mine = np.append(30.0, odds[at + 1 : at + n])
        if n == 3:  # no tags: plain text
            mine[:] = 30.0
        out.append(p.blocks(p.decode(mine)))
        at += n
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(train(labelled) if labelled is not None else default_model())
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                body = extract(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(body, pa.string()), pa.array(map(len, body), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
