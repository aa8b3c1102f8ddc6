"""Stored pages to text, links and form flags.

HTML needs a parser, so this is one of the three places with Python: `mapInArrow`, each page alone, no shuffle; a worker
holds the parsed pages of `BATCH_PAGES` only, whatever the size of the Arrow batches.  Everything after the parse is Spark expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import fixed_values as fx
from jobweave.functions import text

LINK_TYPE = "array<struct<position:int,url:string,text:string,href:string>>"
PAGE_TYPE = (
    "page_id bigint, url string, title string, text string, main_text string, main_status string, "
    f"has_form boolean, has_application_form boolean, links {LINK_TYPE}"
)
#: Pages that a worker parses and hands on at a time.
BATCH_PAGES = 100
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MAIN_TAGS = ("main", "article", "div", "body")
MAIN_DIV = re.compile(fx.MAIN_DIV_CLASS, re.I)


class _Strings:
    """Texts of an element, joined where only notes lie between them, empty ones left out."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def stripped(self) -> list[str]:
        return [t for t in (p.strip() for p in self.parts) if t]


class _Region:
    """Is the reader outside the skipped elements?"""

    def __init__(self, skipped: Iterable[str]) -> None:
        self.skipped, self.depth = frozenset(skipped), 0

    def opens(self, tag: str) -> bool:
        if self.depth or tag in self.skipped:
            self.depth += 1
        return not self.depth

    def closes(self) -> bool:
        shown = not self.depth
        self.depth -= not shown
        return shown


class _Reader(HTMLParser):
    """One pass over a page that fills its texts, links, forms, title and main element as their tags close.

    An element ends with its own end tag or with that of an element around it; a link also ends where the next one
    begins, and a form within a form is part of the outer one.
    """

    def __init__(self, url: str, skip: Iterable[str], main_skip: Iterable[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.shown, self.main_shown = url, _Region(skip), _Region(main_skip)
        self.text, self.links, self.forms, self.title = _Strings(), [], [], None
        self._open: list[str] = []
        self._counts: Counter[str] = Counter()
        self._link: tuple[str, _Strings, int] | None = None
        self._form: tuple[list[str], int] | None = None
        self._title: tuple[_Strings, int] | None = None
        self._mains: dict[str, tuple[_Strings, int | None]] = {}
        self._run: list[str] = []

    def read(self, html: str) -> _Reader:
        self.feed(html)
        self.close()
        self._pop_to(0)
        return self

    def handle_starttag(self, tag, attrs):
        self._flush()
        level, given = len(self._open), {name: value or "" for name, value in attrs}
        if self.shown.opens(tag):
            if tag == "a":
                self._end_link()
                self._link = (given["href"], _Strings(), level) if "href" in given else None
            if tag == "title" and self.title is None:
                self.title = ""
                self._title = (_Strings(), level)
            if tag == "form" and self._form is None:
                self._form = ([], level)
            if self._form:
                self._form[0].extend([tag, *(f'{k}="{v}"' for k, v in given.items())])
        if self.main_shown.opens(tag) and tag in MAIN_TAGS and tag not in self._mains:
            # A class list matches if any one class does, or the whole attribute does.
            if tag != "div" or MAIN_DIV.search(given.get("class", "")):
                self._mains[tag] = (_Strings(), level)
        self._open.append(tag)
        self._counts[tag] += 1
        if tag in VOID:
            self._pop_to(level)

    def handle_endtag(self, tag):
        if self._counts[tag]:
            self._flush()
            size = len(self._open) - 1
            while self._open[size] != tag:
                size -= 1
            self._pop_to(size)

    def handle_data(self, data):
        self._run.append(data)

    def handle_comment(self, data):
        self._flush()

    def _flush(self) -> None:
        """Hand a run of text to all elements that hold it."""
        if not self._run:
            return
        data = "".join(self._run)
        self._run.clear()
        if not self.shown.depth:
            self.text.parts.append(data)
            if self._link:
                self._link[1].parts.append(data)
            if self._title:
                self._title[0].parts.append(data)
            if self._form:
                self._form[0].append(data)
        if not self.main_shown.depth:
            for strings, level in self._mains.values():
                if level is not None:
                    strings.parts.append(data)

    def _pop_to(self, size: int) -> None:
        self._flush()
        while len(self._open) > size:
            self._counts[self._open.pop()] -= 1
            level = len(self._open)
            if self.shown.closes():
                if self._link and self._link[2] == level:
                    self._end_link()
                if self._title and self._title[1] == level:
                    self.title = "".join(self._title[0].parts)
                    self._title = None
                if self._form and self._form[1] == level:
                    self.forms.append(" ".join(self._form[0]).lower())
                    self._form = None
            self.main_shown.closes()
            for tag, (strings, begun) in self._mains.items():
                if begun == level:
                    self._mains[tag] = (strings, None)

    def _end_link(self) -> None:
        if self._link is None:
            return
        href, strings, _ = self._link
        self._link = None
        try:
            full = urljoin(self.url, href)
        except ValueError:
            return
        if full and full != self.url:
            label = "".join(strings.stripped())
            self.links.append({"position": len(self.links) + 1, "url": full, "text": label, "href": href})

    def main_text(self, limit: int | None) -> tuple[str | None, str]:
        found = next((self._mains[tag][0] for tag in MAIN_TAGS if tag in self._mains), None)
        if found is None:
            return None, "missing_main_container"
        body = re.sub(r"\n{3,}", "\n\n", "\n".join(found.stripped()))
        if limit is not None and len(body) > limit:
            body = body[:limit] + fx.TRUNCATED_SUFFIX
        return body.strip(), "success"


def read_pages(
    pages: DataFrame,
    skip_tags: Iterable[str] = fx.TEXT_SKIP_TAGS,
    main_skip_tags: Iterable[str] = fx.MAIN_SKIP_TAGS,
    form_words: Iterable[str] = fx.FORM_WORDS,
    text_chars: int | None = None,
    main_chars: int | None = None,
) -> DataFrame:
    """(page_id, url, html) to text, main text, links and form flags, one row per page.

    Whole texts; `text_chars` and `main_chars` cut them, the latter with a mark.
    """
    skip, main_skip, form_words = set(skip_tags), set(main_skip_tags), tuple(form_words)

    def read(page_id, url, html):
        page = _Reader(url or "", skip, main_skip).read(html or "")
        main, status = page.main_text(main_chars)
        return {
            "page_id": page_id,
            "url": url,
            "title": page.title or "",
            "text": " ".join(" ".join(page.text.stripped()).split())[:text_chars],
            "main_text": main,
            "main_status": status,
            "has_form": bool(page.forms),
            "has_application_form": any(w in f for f in page.forms for w in form_words),
            "links": page.links,
        }

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_PAGES):
                columns = batch.slice(low, BATCH_PAGES).to_pydict()
                rows = [read(*row) for row in zip(columns["page_id"], columns["url"], columns["html"])]
                yield pa.RecordBatch.from_pylist(rows, schema=page_schema())

    return pages.select("page_id", "url", "html").mapInArrow(read_batches, PAGE_TYPE)


def page_schema() -> pa.Schema:
    """`PAGE_TYPE` for Arrow."""
    link = pa.struct([("position", pa.int32()), ("url", pa.string()), ("text", pa.string()), ("href", pa.string())])
    texts = [(c, pa.string()) for c in ("url", "title", "text", "main_text", "main_status")]
    flags = [(c, pa.bool_()) for c in ("has_form", "has_application_form")]
    return pa.schema([("page_id", pa.int64()), *texts, *flags, ("links", pa.list_(link))])


def page_text(pages: DataFrame, **options) -> DataFrame:
    return read_pages(pages, **options).select("page_id", "url", "title", "text")


def page_main_text(pages: DataFrame, **options) -> DataFrame:
    return read_pages(pages, **options).select("page_id", "main_text", "main_status")


def page_forms(pages: DataFrame, **options) -> DataFrame:
    return read_pages(pages, **options).select("page_id", "has_form", "has_application_form")


def page_links(pages: DataFrame, **options) -> DataFrame:
    """One row per link of a page, in page order."""
    read = read_pages(pages, **options).select("page_id", F.col("url").alias("page_url"), "links")
    return read.select("page_id", "page_url", F.inline("links"))


def is_job_link(href: Column, label: Column, words: Iterable[str] = fx.JOB_LINK_WORDS) -> Column:
    return text.any_of(F.concat(text.value_or_blank(href), F.lit(" "), text.value_or_blank(label)), words)


def link_caps(
    read: DataFrame, words: Iterable[str] = fx.JOB_LINK_WORDS, job_links: int | None = None, all_links: int | None = None
) -> DataFrame:
    """Job links and links of each page, the first ones only where a limit is given: the page's own array, no shuffle."""
    words = tuple(words)
    jobs = F.filter("links", lambda x: is_job_link(x["href"], x["text"], words))
    first = lambda links, n: links if n is None else F.slice(links, 1, n)
    return read.withColumns({"job_links": first(jobs, job_links), "all_links": first(F.col("links"), all_links)})
