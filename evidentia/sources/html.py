"""HTML pages: metadata, links and cleaned text."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

#: Elements whose text is no text of the page, besides V.DROPPED_TAGS.
_SILENT = frozenset(("template", "rt", "rp"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SCHEMA = (
    "lang string, title string, author string, published string, updated string, site string, canonical string, hrefs array<string>, links array<string>, text string, "
    "work_tags map<string,array<string>>, subjects array<string>, source_types array<string>"
)


class _Page(HTMLParser):
    """One pass over a page: texts in order, where content elements begin and end among them, and what metadata says."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[tuple[str, str], str | None] = {}
        self.hrefs: list[str] = []
        self.lang = self.canonical = self.title = None
        self.open: list[str] = []
        self.classes: list[frozenset[str]] = []
        self.dropped = 0
        self.texts: list[str] = []
        self.contents: dict[str, list[list[int]]] = {tag: [] for tag in V.CONTENT_TAGS}
        self.now: list[list[int]] = []
        self.work: dict[str, list[str]] = {field: [] for field in V.WORK_TAG_FIELDS}
        self.said: list[str] | None = None
        self.data: list[str] = []
        self.subjects: list[str] = []

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = self.lang or own.get("lang")
        elif tag == "meta":
            for attr in ("property", "name"):
                if attr in own:
                    self.meta.setdefault((attr, own[attr]), own.get("content", "").strip() or None)
            if own.get("name") in V.SUBJECT_META_NAMES and own.get("content"):
                self.subjects.append(own["content"])
        elif tag == "link" and "canonical" in own.get("rel", "").split():
            self.canonical = self.canonical or own.get("href", "").strip() or None
        elif tag == "a" and "href" in own:
            self.hrefs.append(own["href"])
        if tag in _VOID:
            return
        self.open.append(tag)
        self.classes.append(frozenset(own.get("class", "").split()))
        self.dropped += tag in V.DROPPED_TAGS or tag in _SILENT
        if tag in self.contents and not self.dropped:
            place = [len(self.texts), -1]
            self.contents[tag].append(place)
            self.now.append(place)
        if tag == "script" and own.get("type") == "application/ld+json":
            self.data.append("")
        if tag == "a" and "tag" in self.classes[-1]:
            self.said = []

    def _close(self):
        tag, _ = self.open.pop(), self.classes.pop()
        if tag in self.contents and not self.dropped and self.now:
            self.now.pop()[1] = len(self.texts)
        self.dropped -= tag in V.DROPPED_TAGS or tag in _SILENT
        if tag == "a" and self.said is not None:
            value = " ".join(x for x in (t.strip() for t in self.said) if x)
            self.said = None
            for field, kind in V.WORK_TAG_FIELDS.items():
                if value and value not in self.work[field] and any(t == "dd" and {kind, "tags"} <= c for t, c in zip(self.open, self.classes, strict=True)):
                    self.work[field].append(value)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open[-1] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        inside = self.open[-1] if self.open else ""
        if inside == "title" and self.title is None:
            self.title = data.strip()
        if inside == "script" and self.data and self.data[-1] == "":
            self.data[-1] = data
        if self.said is not None:
            self.said.append(data)
        if not self.dropped:
            self.texts.append(data)

    def finish(self):
        self.close()
        while self.open:
            self._close()

    def content(self) -> list[str]:
        """Texts of the content element with most text, the first of equal ones in order of tags; of the whole page, if it has none."""
        sizes = [0]
        for t in self.texts:
            sizes.append(sizes[-1] + len(t.strip()))
        places = [p for tag in V.CONTENT_TAGS for p in self.contents[tag]]
        if not places:
            return self.texts
        a, b = max(places, key=lambda p: sizes[p[1]] - sizes[p[0]])
        return self.texts[a:b]


def declared(documents: list[str], subjects: list[str]) -> tuple[list[str], list[str]]:
    """Subjects and types that JSON-LD documents and subject fields declare; of nested nodes only those of a graph count. What is no JSON is skipped."""
    found: dict[str, None] = {}
    types: list[str] = []

    def add(value):
        if isinstance(value, str):
            found.update(dict.fromkeys(x for x in map(str.strip, value.split(",")) if x))
        elif isinstance(value, list):
            for x in value:
                add(x)
        elif isinstance(value, dict):
            add(value.get("name"))

    todo = []
    for text in documents:
        try:
            todo.append(json.loads(text))
        except (ValueError, RecursionError):
            continue
    while todo:
        node = todo.pop(0)
        if isinstance(node, list):
            todo = [*node, *todo]
        elif isinstance(node, dict):
            kind = node.get("@type")
            types += [kind] if isinstance(kind, str) else [str(x) for x in kind if str(x).strip()] if isinstance(kind, list) else []
            add(node.get("about"))
            add(node.get("keywords"))
            todo.insert(0, node.get("@graph"))
    for value in subjects:
        add(value)
    return list(found), types


def parse(html: str | None, base: str = "") -> dict:
    """Fields of SCHEMA. Of several sources of a field the page's own graph comes first; links are absolute, of http, without fragment, each once; the text
    has a line for each piece of text of the largest content element."""
    page = _Page()
    page.feed(html or "")
    page.finish()
    lines = [x for piece in page.content() for line in piece.splitlines() if (x := line.strip())]
    first = lambda *names: next((page.meta[n] for n in names if page.meta.get(n)), None)
    links: dict[str, None] = {}
    for href in page.hrefs:
        href = href.strip()
        if not href or href.startswith(("#", "mailto:", "tel:", "javascript:")):
            continue
        try:
            link = urlparse(urljoin(base, href))
        except ValueError:
            continue
        if link.scheme in ("http", "https") and link.netloc:
            links[link._replace(fragment="").geturl()] = None
    host = (urlparse(base).hostname or "") if "://" in base else ""
    subjects, types = ([], []) if host in V.WORK_TAG_HOSTS else declared(page.data, page.subjects)
    try:
        canonical = page.canonical and urljoin(base, page.canonical)
    except ValueError:
        canonical = None
    return {
        "lang": page.lang,
        "title": first(("property", "og:title"), ("name", "twitter:title")) or page.title or None,
        "author": first(("name", "author"), ("property", "article:author")),
        "published": first(("property", "article:published_time"), ("name", "date"), ("name", "datePublished")),
        "updated": first(("property", "article:modified_time"), ("name", "last-modified"), ("name", "dateModified")),
        "site": first(("property", "og:site_name")),
        "canonical": canonical,
        "hrefs": page.hrefs,
        "links": list(links),
        "text": "\n".join(lines),
        "work_tags": page.work if host in V.WORK_TAG_HOSTS else {},
        "subjects": subjects,
        "source_types": types,
    }


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, fields of SCHEMA) of pages (page_id, url, html)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for rows in batches:
            made = pd.DataFrame([parse(h, u or "") for u, h in zip(rows["url"], rows["html"], strict=True)], columns=names)
            yield made.assign(page_id=rows["page_id"].to_numpy())[["page_id", *names]]

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, {SCHEMA}")


def facets(host: Column, work_tags: Column, metadata: Column) -> Column:
    """Struct (adapter, namespace, facets): what a page is about, by the first adapter that fits, never by its prose.

    work_tags: lists by field, of sites that tag works. metadata: lists by container and field (a map of maps). A host alone is the repository. facets are
    distinct structs (kind, value), values in lower case.
    """
    facet = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    some = lambda values: F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v != "")
    each = lambda kind, values: F.transform(some(values), lambda v: facet(F.lit(kind), v))
    fixed = F.array(*[facet(F.lit(k), F.lit(v)) for k, v in (("repository", "ao3"), ("source_type", "fanfiction"), ("canon_status", "fanwork"))])
    tagged = [each(kind, work_tags[field]) for field, kind in zip(V.WORK_TAG_FIELDS, ("fandom", "character", "relationship", "tag"), strict=True)]
    listed = []
    for container in ("structured", "catalog", "book", "schema_org"):
        own = metadata[container]
        listed += [each(kind, own[field]) for field, kind in V.FACET_FIELDS.items()]
        types = F.when(F.size(some(own["source_type"])) > 0, some(own["source_type"])).otherwise(some(own["type"]))
        listed.append(F.transform(types, lambda v: facet(F.lit("source_type"), v)))
    known = F.exists(F.array(*map(F.lit, ("structured", "catalog", "book", "schema_org"))), lambda c: F.coalesce(F.map_contains_key(metadata, c), F.lit(False)))
    made = lambda adapter, namespace, rows: F.struct(F.lit(adapter).alias("adapter"), F.lit(namespace).cast("string").alias("namespace"), F.array_distinct(rows).alias("facets"))
    plain = F.when(host != "", F.array(facet(F.lit("repository"), F.lower(host)))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    return F.when(F.lower(host).isin(*V.WORK_TAG_HOSTS), made("ao3", "fanwork", F.concat(fixed, *tagged))).when(known, made("structured-metadata", None, F.concat(*listed))).otherwise(made("generic-web", None, plain))
