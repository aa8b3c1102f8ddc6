"""Main text of web pages by a graphical model on the DOM tree.

Every element and every run of text below one block element is a node: content, page frame, or the ground between them that
body and wrappers are.  A node's own evidence is its tag, the words of its class, id and role, and for texts their length, share of
links and end; a table for each kind of node says which state follows which state of the parent.  Messages go up from the leaves
and down again (sum-product, exact on a tree), and texts whose marginal probability of being content is above one half are kept.
All tables are counted on labelled pages.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import shipped, table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|(?P<text>[^<]+|<)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
UNFINISHED = re.compile(r"<(?=[a-zA-Z/!?])")
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# How elements of HTML behave.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
UNSEEN = ("svg", "math", "object", "audio", "video", "canvas", "select", "datalist")
UNSEEN_TAG = re.compile(rf"<(/?)({'|'.join(UNSEEN)})(?=[\s/>])[^>]*>", re.IGNORECASE)
#: Tags that leave an open head open; any other opening tag ends it.
IN_HEAD = ("html", "head", "base", "basefont", "bgsound", "link", "meta", *RAW)
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "ins", "legend", "li",
    "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
KINDS = {
    "box": ("div", "section", "center", "html", "body", "details", "dialog", "ins", "hgroup"),
    "main": ("article", "main"),
    "frame": ("nav", "aside", "footer", "header", "form", "menu", "dir", "search", "fieldset", "button", "address"),
    "list": ("ul", "ol", "dl"),
    "item": ("li", "dd", "dt", "option"),
    "table": ("table", "tbody", "thead", "tfoot", "tr"),
    "cell": ("td", "th", "caption"),
    "head": ("h1", "h2", "h3", "h4", "h5", "h6", "summary", "legend"),
    "text": ("p", "pre", "blockquote", "figure", "figcaption"),
}
KIND = {tag: kind for kind, tags in KINDS.items() for tag in tags}
#: An opening tag ends an open element of the second group, up to one of the third.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
GROUND, CONTENT, FRAME = range(3)
#: Most evidence that one feature may give between two states, as a factor.
MOST = 500.0


@dataclass
class Node:
    parent: int
    tag: str
    hints: tuple[str, ...] = ()
    text: str = ""
    linked: int = 0
    label: int | None = None


@dataclass
class Page:
    """Nodes in page order: a parent comes before its children.  Texts are nodes with the tag `#text`."""

    nodes: list[Node] = field(default_factory=list)

    def texts(self) -> Iterator[tuple[int, Node]]:
        return ((i, n) for i, n in enumerate(self.nodes) if n.tag == "#text")


def closed_at(html: str) -> dict[int, int]:
    """Ends of the unseen elements that are closed, by the end of their opening tag."""
    ends, waiting = {}, defaultdict(list)
    for match in UNSEEN_TAG.finditer(html):
        tag = match[2].lower()
        if not match[1]:
            if not match[0].endswith("/>"):
                waiting[tag].append(match.end())
        elif waiting[tag]:
            ends[waiting[tag].pop()] = match.end()
    return ends


def parse(html: str) -> Page:
    """The block tree of a page in one pass; broken markup never fails.

    Texts between two block tags are one run, its white space turned into single blanks; `br` counts as white space.  Missing
    end tags are implied as far as they bound blocks, unmatched ones are ignored, raw elements end at their end tag or the end.
    A head ends at the first tag or text that it may not hold.  Another unseen element that is never closed ends where a block
    begins, or where the block around it closes.
    """
    page = Page([Node(-1, "#root")])
    nodes, stack, opened = page.nodes, [0], Counter()
    run, links, linked, head, hidden, ends = [], 0, 0, False, False, None
    at, size, last = 0, len(html), html.rfind(">")

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            nodes.append(Node(stack[-1], "#text", (), text, min(linked, len(text))))
        linked = 0

    def pop_to(tag: str) -> None:
        while len(stack) > 1:
            last = nodes[stack.pop()].tag
            opened[last] -= 1
            if last == tag:
                return

    while at < size:
        start, match = at, TOKEN.match(html, at) if at <= last else None
        at = match.end() if match else size
        text = match["text"] if match else UNFINISHED.split(html[start:], maxsplit=1)[0]
        if text is not None:
            head = head and text.isspace()
            if head:
                continue
            if not hidden:
                text = entities.unescape(text) if "&" in text else text
                run.append(text)
                if links:
                    linked += len(text.strip())
            continue
        tag = match["tag"] or match["tag2"]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), bool(match["close"] or match["close2"]), match["attrs"] or match["attrs2"] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>|\\Z", re.IGNORECASE).search(html, at)
                at = end.end()
            continue
        if tag == "head":
            head = not closing
            continue
        head = head and (tag in IN_HEAD if not closing else tag not in ("body", "html"))
        if head:
            continue
        if tag in UNSEEN:
            if not closing and not attrs.endswith("/"):
                ends = closed_at(html) if ends is None else ends
                at, hidden = ends.get(at, at), hidden or at not in ends
            continue
        if hidden and tag in KIND and tag != "option":
            hidden = closing and not opened[tag]
        if hidden:
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in ("br", "hr", "img"):
            run.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in KIND or tag in VOID:
            continue
        flush()
        if closing:
            if opened[tag]:
                pop_to(tag)
            links = 0 if tag != "a" else links
            continue
        if opened["p"] and tag not in ("button", "ins"):
            pop_to("p")
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            while nodes[stack[-1]].tag not in bounds and any(opened[t] for t in ended):
                near = next((nodes[i].tag for i in reversed(stack) if nodes[i].tag in ended or nodes[i].tag in bounds), "")
                if near not in ended:
                    break
                pop_to(near)
        if KIND[tag] == "head" and KIND.get(nodes[stack[-1]].tag) == "head":
            pop_to(nodes[stack[-1]].tag)
        hints, label = [], None
        for name, *values in ATTRIBUTE.findall(attrs) if attrs else ():
            value = next((v for v in values if v), "")
            if name.lower() == "data-y":
                label = int(value)
            else:
                hints += [w.lower() for w in HINT.findall(entities.unescape(value))]
        nodes.append(Node(stack[-1], tag, tuple(dict.fromkeys(hints)), "", 0, label))
        stack.append(len(nodes) - 1)
        opened[tag] += 1
    flush()
    return page


# ------------------------------------------------------------------------------------------------ model


def features(node: Node) -> list[str]:
    if node.tag != "#text":
        return [f"tag {node.tag}", *(f"hint {h}" for h in node.hints)] if node.hints else [f"tag {node.tag}", f"plain {kind(node)}"]
    n = len(node.text)
    share = 10 * node.linked // n
    words = "short" if n < 25 else "middle" if n < 100 else "long"
    links = "all" if share >= 8 else "some" if share >= 3 else "few"
    return [f"text {words}, {links} links, {'end' if node.text[-1] in '.!?…»”' else 'no end'}{', ©' if '©' in node.text[:80] else ''}"]


def kind(node: Node) -> str:
    return "#text" if node.tag == "#text" else KIND.get(node.tag, "box")


Triple = tuple[float, float, float]


@dataclass
class Model:
    """Per feature the likelihood of each state, and per kind of node the chance of each state below each state of the parent."""

    evidence: dict[str, Triple]
    follow: dict[str, tuple[Triple, Triple, Triple]]
    root: Triple = (0.9, 0.05, 0.05)


def train(pages: list[str]) -> Model:
    """Count features and parent-child states on pages whose elements say `data-y="1"` for content and `"0"` for frame.

    Children inherit the state; what is above all marks is ground, and texts on the ground are frame.
    """
    seen, totals = defaultdict(lambda: [0.0] * 3), defaultdict(lambda: [1.0] * 3)
    edges = defaultdict(lambda: [[1.0, 0.5, 0.5], [0.01, 1.0, 0.05], [0.01, 0.01, 1.0]])
    for html in pages:
        page, states = parse(html), []
        for node in page.nodes:
            above = states[node.parent] if node.parent >= 0 else GROUND
            own = above if node.label is None else CONTENT if node.label else FRAME
            own = FRAME if node.tag == "#text" and own == GROUND else own
            states.append(own)
            if node.parent < 0:
                continue
            totals["text" if node.tag == "#text" else "element"][own] += 1
            for name in features(node):
                seen[name][own] += 1
            edges[kind(node)][above][own] += 1
    evidence = {}
    for name, counts in seen.items():
        group = totals["text" if name.startswith("text ") else "element"]
        rates = [(n + 0.5) / (all_ + 1) for n, all_ in zip(counts, group)]
        if group is totals["text"]:
            rates[GROUND] = min(rates)
        evidence[name] = tuple(max(r, max(rates) / MOST) / max(rates) for r in rates)
    return Model(evidence, {k: tuple(tuple(x / sum(row) for x in row) for row in rows) for k, rows in edges.items()})


def marginals(model: Model, page: Page) -> list[float]:
    """Probability of content of every node: one pass of messages up the tree, one down."""
    nodes, plain = page.nodes, ((0.9, 0.05, 0.05), (0.02, 0.96, 0.02), (0.01, 0.01, 0.98))
    tables = [model.follow.get(kind(node), plain) for node in nodes]
    below: list[Triple] = []  # own evidence and all messages from below, scaled
    for i, node in enumerate(nodes):
        a, b, c = 1.0, 1.0, 1.0
        for name in features(node) if i else ():
            x, y, z = model.evidence.get(name, (1.0, 1.0, 1.0))
            a, b, c = a * x, b * y, c * z
        total = a + b + c
        below.append((a / total, b / total, c / total))
    sent: list[Triple] = [(1.0, 1.0, 1.0)] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        a, b, c = below[i]
        (p, q, r), (s, t, u), (v, w, x) = tables[i]
        up = (p * a + q * b + r * c, s * a + t * b + u * c, v * a + w * b + x * c)
        sent[i] = up
        d, e, f = below[nodes[i].parent]
        d, e, f = max(d * up[0], 1e-200), max(e * up[1], 1e-200), max(f * up[2], 1e-200)
        total = d + e + f
        below[nodes[i].parent] = (d / total, e / total, f / total)
    belief: list[Triple] = []
    for i, node in enumerate(nodes):
        if i:
            d, e, f = belief[node.parent]
            d, e, f = d / sent[i][0], e / sent[i][1], f / sent[i][2]  # the parent without this child
            (p, q, r), (s, t, u), (v, w, x) = tables[i]
            come = (d * p + e * s + f * v, d * q + e * t + f * w, d * r + e * u + f * x)
        else:
            come = model.root
        a, b, c = (max(x * y, 1e-200) for x, y in zip(below[i], come))
        total = a + b + c
        belief.append((a / total, b / total, c / total))
    return [b[CONTENT] for b in belief]


def extract(model: Model, html: str | None) -> str:
    """Content texts of a page in order, one a line; empty if there is none."""
    if not html:
        return ""
    page = parse(html)
    share = marginals(model, page)
    return "\n".join(node.text for i, node in page.texts() if share[i] > 0.5)


# ------------------------------------------------------------------------------------------------ labelled pages

# Names that pages give to their parts.
CONTENT_NAMES = (
    "article", "article-body", "articleBody", "content", "main-content", "post", "post-content", "entry", "entry-content", "story", "story-body",
    "text", "body-text", "page-content", "blog-post", "news-text", "main",
)
FRAME_NAMES = (
    "nav", "navbar", "menu", "main-menu", "breadcrumb", "breadcrumbs", "header", "site-header", "masthead", "top-bar", "topbar", "logo", "footer", "site-footer", "copyright",
    "legal", "imprint", "sidebar", "side-bar", "widget", "rail", "ad", "ads", "adsbygoogle", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "cookie",
    "cookie-notice", "consent", "gdpr", "notice", "alert", "warning", "disclaimer", "paywall", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search",
    "search-form", "contact-form", "share", "social", "follow", "related", "recommended", "more-stories", "read-next", "teaser", "trending", "popular", "tags", "tagcloud", "pagination",
    "pager", "toolbar", "skip-link", "toc", "navigation", "complementary", "contentinfo",
)
COMMENT_NAMES = ("comments", "comment", "comment-list", "comment-body", "commentlist", "reader-comments", "responses", "respond", "reply", "replies", "discussion", "disqus", "disqus_thread", "feedback", "guestbook", "user-comments")


class Writer:
    """Pages of many layouts whose parts carry their label."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.rng.choice("bdfgklmnprst") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 25) -> str:
        return self.words(low, high).capitalize() + self.rng.choice("....!?")

    def prose(self) -> str:
        rng = self.rng
        text = " ".join(self.sentence() for _ in range(rng.choice((1, 1, 2, 3, 6))))
        if rng.random() < 0.1:
            text = self.words(1, 4)
        if rng.random() < 0.15:
            text += f' <a href="/x">{self.words(1, 3)}</a> {self.words(2, 6)}.'
        return text

    def links(self) -> str:
        rng = self.rng
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(rng.randint(2, 8))]
        return rng.choice(("<ul>{}</ul>".format("".join(f"<li>{x}</li>" for x in items)), " | ".join(items), "".join(f"<p>{x}</p>" for x in items), "".join(f"<div>{x}</div>" for x in items)))

    def controls(self) -> str:
        return f'<label>{self.words(1, 2)}</label><input name="q"><button type="submit">{self.words(1, 2)}</button>'

    def frame(self, name: str | None = None) -> str:
        rng = self.rng
        tag = rng.choice(("nav", "header", "footer", "aside", "form", "div", "div", "div", "div", "section", "ul"))
        name = name or (rng.choice(FRAME_NAMES) if tag in ("div", "section", "ul") or rng.random() < 0.4 else None)
        inside = rng.choice((self.links, self.links, self.controls, self.prose, lambda: f"<p>{self.prose()}</p>", lambda: f"© 2024 {self.words(1, 4)}", lambda: f"<h3>{self.words(1, 4)}</h3>{self.links()}"))()
        if tag == "ul":
            inside = "".join(f'<li><a href="/">{self.words(1, 3)}</a></li>' for _ in range(4))
        mark = f' {rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f'<{tag}{mark} data-y="0">{inside}</{tag}>'

    def comments(self) -> str:
        rng = self.rng
        one = lambda: f'<{(t := rng.choice(("div", "li", "article")))} class="{rng.choice(COMMENT_NAMES)}"><b>{self.words(1, 2)}</b><p>{self.prose()}</p></{t}>'
        tag = rng.choice(("div", "section", "ol"))
        return f'<{tag} {rng.choice(("id", "class"))}="{rng.choice(COMMENT_NAMES)}" data-y="0"><h3>{self.words(1, 3)}</h3>{"".join(one() for _ in range(rng.randint(1, 4)))}</{tag}>'

    def article(self) -> str:
        rng, parts = self.rng, []
        if rng.random() < 0.8:
            parts.append(f"<h1>{self.words(2, 10).capitalize()}</h1>")
        for _ in range(rng.randint(1, 9)):
            roll = rng.random()
            if roll < 0.66:
                parts.append(rng.choice(("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<p><span>{}</span></p>")).format(self.prose()))
            elif roll < 0.72:
                parts.append("<{0}>{1}</{0}>".format(rng.choice(("h2", "h3", "h4")), self.words(1, 6)))
            elif roll < 0.83:
                tag, item = rng.choice(("ul", "ul", "ol")), rng.choice((self.prose, lambda: self.words(1, 6)))
                parts.append("<{0}>{1}</{0}>".format(tag, "".join(f"<li>{item()}</li>" for _ in range(rng.randint(2, 5)))))
            elif roll < 0.87:
                parts.append(f"<blockquote><p>{self.prose()}</p></blockquote>")
            elif roll < 0.90:
                parts.append(f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 3)}</td></tr></table>")
            elif roll < 0.93:
                parts.append(f"<figure><img src=x><figcaption>{self.prose()}</figcaption></figure>")
            else:
                parts.append(self.frame())
        inner = "".join(parts)
        shape = rng.random()
        name = rng.choice(CONTENT_NAMES)
        if shape < 0.4:
            return f'<article data-y="1">{inner}</article>'
        if shape < 0.5:
            return f'<main data-y="1">{inner}</main>'
        if shape < 0.6:
            return f'<main data-y="1"><article class="{name}">{inner}</article></main>'
        if shape < 0.85:
            return f'<div {rng.choice(("class", "id"))}="{name}" data-y="1">{inner}</div>'
        if shape < 0.93:
            return f'<div data-y="1">{inner}</div>'
        return "".join(f'<p data-y="1">{self.prose()}</p>' for _ in range(rng.randint(2, 8)))

    def page(self) -> str:
        rng = self.rng
        before = "".join(self.frame() for _ in range(rng.randint(0, 4)))
        after = "".join(self.frame() for _ in range(rng.randint(0, 4))) + (self.comments() if rng.random() < 0.35 else "")
        if rng.random() < 0.2:
            after += f'<p data-y="0">{rng.choice((f"© 2024 {self.words(1, 4)}", self.links(), self.words(2, 8)))}</p>'
        body = before + self.article() + after
        if rng.random() < 0.1:
            cells = [f'<td class="{rng.choice(FRAME_NAMES)}" data-y="0">{self.links()}</td>', f'<td data-y="1"><h1>{self.words(2, 6)}</h1><p>{self.prose()}</p><p>{self.prose()}</p></td>']
            body = f"<table><tr>{cells[0]}{cells[1]}</tr></table>"
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(("wrapper", "container", "page", "layout", "row", "col", "inner"))}">{body}</div>'
        return f"<html><head><title>x</title></head><body>{body}</body></html>"


def labelled_pages(n: int = 1500, seed: int = 11) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(n)]


# ------------------------------------------------------------------------------------------------ Spark


def main_texts(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row: the main text of the whole page, empty for null and empty pages.

    Repeated rows are taken as they are; other columns are left out; an empty table gives an empty result.
    """
    spark = shipped(pages.sparkSession)
    shared = spark.sparkContext.broadcast(model or train(labelled_pages()))
    kind_of = pages.schema["page_id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [extract(own, html) for html in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {kind_of}, url string, text string, n_chars bigint"
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(build, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Main texts of all pages."""
    return main_texts(table(spark, folder, "pages"))
