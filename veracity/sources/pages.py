"""Raw web pages -> article text.

Fetching is out of scope (no network); extraction runs over a table of
stored pages.  HTML structure cannot be read with Spark expressions, so the
per-page parse is a small stdlib ``html.parser`` helper run by
``mapInArrow`` (one page of an Arrow batch at a time, one parser per row, no
shuffle).  Everything around it — url checks, host names, routing, the report — is built-in
expressions and aggregations.

Extraction rule: the first ``<article>``, else the first ``<div>`` whose
class list contains ``article``; its text is the text of each of its
``<p>`` elements joined by one space (an open ``<p>`` is closed by the next
``<p>`` or by the end of its container, as HTML parsing does); its title is
the text of its first ``<h1>``, else "No title available".  Script and style
contents are not text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.functions.text import bare_host

# Outcome texts of the extraction.
NO_TITLE = "No title available"
INVALID_URL = "Invalid URL format"
NO_CONTENT = "Failed to extract content"
EMPTY_INPUT = "Input text cannot be empty"
DIRECT_TITLE = "Direct Text Analysis"
DIRECT_SOURCE = "Direct Input"

EXTRACT_SCHEMA = "page_id long, url string, text string, host string, title string, error string"
# What a task holds as Python strings: one page, and results up to either of these.
PAGES_AT_ONCE = 64
CHARS_AT_ONCE = 1 << 20

_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form",
             "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
             "section", "table", "ul"}


class _Container:
    """Text collected from one candidate container element."""

    def __init__(self, tag: str) -> None:
        self.tag = tag
        self.depth = 1
        self.paragraphs: list[list[str]] = []
        self.in_p = False
        self.h1: list[str] | None = None
        self.in_h1 = False
        self.done = False


class _ArticleParser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.article: _Container | None = None
        self.div: _Container | None = None
        self.skip = 0  # inside <script>/<style>

    def _active(self) -> list[_Container]:
        return [c for c in (self.article, self.div) if c is not None and not c.done]

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        for c in self._active():
            if tag == c.tag:
                c.depth += 1
            if tag in _CLOSES_P and c.in_p:
                c.in_p = False
            if tag == "p":
                c.paragraphs.append([])
                c.in_p = True
            if tag == "h1" and c.h1 is None:
                c.h1, c.in_h1 = [], True
        if tag == "article" and self.article is None:
            self.article = _Container("article")
        if tag == "div" and self.div is None:
            classes = (dict(attrs).get("class") or "").split()
            if "article" in classes:
                self.div = _Container("div")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
        for c in self._active():
            if tag in _CLOSES_P:  # the end of a block (or of the <p>) ends the paragraph
                c.in_p = False
            if tag == "h1":
                c.in_h1 = False
            if tag == c.tag:
                c.depth -= 1
                if c.depth == 0:
                    c.done, c.in_p, c.in_h1 = True, False, False

    def handle_data(self, data):
        if self.skip:
            return
        for c in self._active():
            if c.in_p:
                c.paragraphs[-1].append(data)
            if c.in_h1:
                c.h1.append(data)


def extract_one(url: str | None, html: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(text, host, title, error) of one stored page."""
    try:
        parsed = urlparse(url or "")
        if not (parsed.scheme and parsed.netloc):
            return None, None, None, INVALID_URL
        host = parsed.netloc.replace("www.", "")
        p = _ArticleParser()
        p.feed(html or "")
        p.close()
        box = p.article or p.div
        if box is None:
            return None, host, NO_TITLE, NO_CONTENT
        text = " ".join("".join(parts) for parts in box.paragraphs)
        title = "".join(box.h1) if box.h1 is not None else NO_TITLE
        return text, host, title, None
    except Exception as exc:  # noqa: BLE001 - the reference reports any failure as text
        return None, None, None, str(exc)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = [(name, pa.string()) for name in ("url", "text", "host", "title", "error")]
    schema = pa.schema([("page_id", pa.int64()), *text])
    for batch in batches:
        rows, held = [], 0
        for at in range(batch.num_rows):
            page_id, url, html = (c[at].as_py() for c in batch.columns)
            rows.append((page_id, url, *extract_one(url, html)))
            del html
            held += sum(len(v) for v in rows[-1][1:] if v)
            if len(rows) == PAGES_AT_ONCE or held >= CHARS_AT_ONCE or at + 1 == batch.num_rows:
                out = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                rows, held = [], 0
                yield pa.RecordBatch.from_arrays(out, schema=schema)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, host, title, error for every stored page."""
    from veracity.session import ship_package
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(_extract_batches, EXTRACT_SCHEMA)


def page_extraction_report(extracted: DataFrame) -> DataFrame:
    """Per host: pages, failures and the mean extracted text length."""
    host = F.coalesce(F.col("host"), bare_host("url"))
    return (extracted.withColumn("_host", host)
            .groupBy(F.col("_host").alias("host"))
            .agg(F.count(F.lit(1)).alias("pages"),
                 F.count_if(F.col("error").isNotNull()).alias("failures"),
                 F.avg(F.length("text")).alias("mean_text_length")))


# Python str.strip() whitespace, as explicit code points (Java regex syntax).
STRIP_CLASS = ("[\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029"
               "\\u202F\\u205F\\u3000]")


def strip_ws(c) -> F.Column:
    return F.regexp_replace(c, f"^{STRIP_CLASS}+|{STRIP_CLASS}+$", "")


def route_input(df: DataFrame, col: str = "input_text") -> DataFrame:
    """Trimmed input -> kind ``empty`` (error), ``url`` (to extract)
    or ``text`` (scored directly as "Direct Text Analysis")."""
    t = strip_ws(F.col(col))
    is_url = t.startswith("http://") | t.startswith("https://")
    kind = F.when(t.isNull() | (t == ""), "empty").when(is_url, "url").otherwise("text")
    return df.select(
        "*", t.alias("input"), kind.alias("kind"),
        F.when(kind == "empty", F.lit(EMPTY_INPUT)).alias("error"),
        F.when(kind == "text", F.lit(DIRECT_TITLE)).alias("title"),
        F.when(kind == "text", F.lit(DIRECT_SOURCE)).alias("source"))
