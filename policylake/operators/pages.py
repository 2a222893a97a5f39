"""Stored web pages: links, sections, lists and what they say about target topics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake import vocab
from policylake.functions import score as S
from policylake.functions.text import basename, strip, url_path
from policylake.operators.lifecycle import first_n_per_key
from policylake.session import computed_once

HEADERS = ("h1", "h2", "h3", "h4")
HIDDEN = ("script", "style")
VOID = ("br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr")
PARTS = ("struct<title:string,text:string,"
         "links:array<struct<text:string,href:string,url:string>>,"
         "sections:array<struct<header:string,content:string>>,"
         "items:array<string>,paragraphs:array<string>>")


class _Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "_Element | None"):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _Tree(HTMLParser):
    """Element tree as written: an end tag closes the nearest open element of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Element(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(_Element(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _walk(node: _Element):
    stack = [node]
    while stack:
        current = stack.pop()
        yield current
        if isinstance(current, _Element):
            stack.extend(reversed(current.children))


def _elements(node: _Element, *tags: str) -> list[_Element]:
    return [n for n in _walk(node) if isinstance(n, _Element) and n.tag in tags and n is not node]


def _strings(node: _Element) -> list[str]:
    """Text below a node; scripts and styles count only when asked for themselves."""
    out, stack = [], [node]
    while stack:
        current = stack.pop()
        if isinstance(current, str):
            out.append(current)
        elif current is node or current.tag not in HIDDEN:
            stack.extend(reversed(current.children))
    return out


def _text(node: _Element) -> str:
    return "".join(s.strip() for s in _strings(node))


def _section(header: _Element) -> dict:
    siblings = [n for n in header.parent.children if isinstance(n, _Element)]
    content = []
    for node in siblings[siblings.index(header) + 1:]:
        if node.tag in HEADERS:
            break
        if text := _text(node):
            content.append(text)
    return {"header": _text(header), "content": " ".join(content)}


def parse_page(html: str, base: str) -> dict:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    root = tree.root
    titles = _elements(root, "title")
    sections = [_section(h) for h in _elements(root, *HEADERS)]

    def absolute(href: str) -> str:
        try:
            return urljoin(base or "", href)
        except ValueError:
            return href

    return {
        "title": "".join(_strings(titles[0])) if titles else "",
        "text": "".join(_strings(root)),
        "links": [{"text": _text(a), "href": a.attrs["href"], "url": absolute(a.attrs["href"])}
                  for a in _elements(root, "a") if a.attrs.get("href") is not None],
        "sections": [s for s in sections if s["header"]],
        "items": [_text(li) for ul in _elements(root, "ul") for li in _elements(ul, "li")],
        "paragraphs": [_text(p) for p in _elements(root, "p")],
    }


def page_parts(html: Column, base_url: Column) -> Column:
    """Struct of title, text, links, sections, list items and paragraphs of a page."""

    @F.pandas_udf(PARTS)
    def parse(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(h, b) for h, b in zip(pages, bases)],
                            columns=["title", "text", "links", "sections", "items", "paragraphs"])

    return parse(html, base_url)


def parsed_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with their parts instead of their markup; each page is parsed once."""
    return computed_once(pages, "page", page_parts(F.col(html), F.col(url))).drop(html)


def page_links(parsed: DataFrame, keep_unnamed: bool = False) -> DataFrame:
    """One row per link: position, text, href, absolute url, type, relevance, file name."""
    rest = [c for c in parsed.columns if c != "page"]
    rows = parsed.select(*rest, F.posexplode("page.links").alias("position", "link")).select(
        *rest, "position", F.col("link.text").alias("text"), F.col("link.href").alias("href"),
        F.col("link.url").alias("link_url"))
    if not keep_unnamed:
        rows = rows.where("text != ''")
    text, href = F.col("text"), F.col("href")
    named = basename(url_path(href))
    return rows.withColumns({
        "link_type": S.link_type(text, href),
        "relevant": S.page_link_relevant(text, href),
        "is_pdf": S.is_pdf_url(href),
        "filename": F.when(named != "", named).otherwise(
            F.concat(F.lit("document_"), F.col("position").cast("string"), F.lit(".pdf"))),
    })


def page_sections(parsed: DataFrame, relevance=S.keyword_relevance) -> DataFrame:
    """One row per header section with its relevance and its rank on the page."""
    rest = [c for c in parsed.columns if c != "page"]
    scored = F.transform("page.sections", lambda s, i: F.struct(
        (-relevance(F.concat_ws(" ", s["header"], s["content"]))).alias("order"), i.alias("position"),
        s["header"].alias("header"), s["content"].alias("content")))
    rows = parsed.select(*rest, F.posexplode(F.array_sort(scored)).alias("rank", "s"))
    return rows.select(*rest, "rank", F.col("s.position").alias("position"), F.col("s.header").alias("header"),
                       F.col("s.content").alias("content"), (-F.col("s.order")).alias("relevance_score"))


def page_downloads(parsed: DataFrame) -> DataFrame:
    """One row per downloadable link with its type and relevance."""
    rest = [c for c in parsed.columns if c != "page"]
    rows = parsed.select(*rest, F.posexplode("page.links").alias("position", "link")).where(
        S.is_download(F.col("link.href")))
    return rows.select(*rest, "position", F.col("link.text").alias("text"), F.col("link.href").alias("href"),
                       S.download_type(F.col("link.href")).alias("type"),
                       S.keyword_relevance(F.col("link.text")).alias("relevance_score"))


def page_rules(parsed: DataFrame, section_type: Column | str,
               indicators: Mapping[str, Sequence[str]] = vocab.RULE_INDICATORS) -> DataFrame:
    """List items and paragraphs that read like rules of a section type."""
    rest = [c for c in parsed.columns if c != "page"]
    texts = F.concat(
        F.transform("page.items", lambda t: F.struct(F.lit("list_item").alias("type"), t.alias("content"),
                                                     F.lit("ul").alias("source"))),
        F.transform("page.paragraphs", lambda t: F.struct(F.lit("paragraph").alias("type"), t.alias("content"),
                                                          F.lit("p").alias("source"))))
    rows = parsed.select(*rest, F.posexplode(texts).alias("position", "r")).select(
        *rest, "position", "r.type", "r.content", "r.source")
    if isinstance(section_type, str):
        return rows.where(S.is_rule_content(F.col("content"), section_type, indicators=indicators))
    return rows.where(S.any_of(
        section_type.eqNullSafe(name) & S.is_rule_content(F.col("content"), name, indicators=indicators)
        for name in indicators))


def target_sections(parsed: DataFrame, targets: Mapping[str, Sequence[str]] = vocab.TARGET_SECTIONS,
                    link_terms: Sequence[str] = vocab.PAGE_LINK_TERMS) -> DataFrame:
    """(page, section_type, kind, position, label): sections, relevant links and documents naming a target."""
    rest = [c for c in parsed.columns if c != "page"]
    parts = F.concat(
        F.transform("page.sections", lambda s, i: F.struct(
            F.lit("section").alias("kind"), i.alias("position"), s["header"].alias("label"),
            F.concat_ws(" ", s["header"], s["content"]).alias("body"), F.lit("").alias("href"))),
        F.transform("page.links", lambda x, i: F.struct(
            F.lit("link").alias("kind"), i.alias("position"), x["text"].alias("label"),
            x["text"].alias("body"), x["href"].alias("href"))),
        F.transform("page.links", lambda x, i: F.struct(
            F.lit("document").alias("kind"), i.alias("position"), x["text"].alias("label"),
            x["text"].alias("body"), x["href"].alias("href"))))
    rows = parsed.select(*rest, F.explode(parts).alias("p")).select(*rest, "p.*")
    usable = rows.where(
        (F.col("kind") == "section")
        | ((F.col("kind") == "link") & (F.col("label") != "") & S.page_link_relevant(F.col("label"), F.col("href"), link_terms))
        | ((F.col("kind") == "document") & S.is_download(F.col("href"))))
    low = F.lower("body")
    hits = F.array_compact(F.array(*[
        F.when(S.contains_any(low, [t.lower() for t in terms]), F.lit(name)) for name, terms in targets.items()]))
    return usable.withColumn("section_type", F.explode(hits)).select(
        *rest, "section_type", "kind", "position", "label", "href")


def detailed_pages(targets: DataFrame, links: DataFrame, pages: DataFrame, per_type: int | None = None,
                   page_id: str = "page_id",
                   indicators: Mapping[str, Sequence[str]] = vocab.RULE_INDICATORS) -> DataFrame:
    """Rules of the stored pages behind the matched links, or the first ``per_type`` of each page and section type."""
    chosen = targets.where("kind = 'link'")
    if per_type is not None:
        chosen = first_n_per_key(chosen, [page_id, "section_type"], [F.asc("position")], per_type)
    linked = chosen.join(links.select(page_id, "position", "link_url"), [page_id, "position"]).select(
        page_id, "section_type", "link_url")
    stored = pages.withColumnRenamed("url", "link_url").withColumnRenamed(page_id, "target_page_id")
    return page_rules(linked.join(stored, "link_url"), F.col("section_type"), indicators)


def relevant_documents(links: DataFrame, direct: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Relevant documents, or the ``limit`` best by relevance; direct addresses enter with a fixed score."""
    score = S.document_relevance(F.col("text"), F.col("filename"))
    found = links.withColumn("relevance_score", score).where("relevance_score > 0").select(
        "url", "text", "filename", "relevance_score")
    if direct is not None:
        found = found.unionByName(direct.select(
            "url", F.lit("Direct PDF").alias("text"), basename(url_path(F.col("url"))).alias("filename"),
            F.lit(vocab.DIRECT_DOCUMENT_SCORE).alias("relevance_score")))
    if limit is None:
        return found
    return found.orderBy(F.desc("relevance_score"), "url", "text").limit(limit)


def host(url: Column) -> Column:
    """Network location of a URL."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def domain_allowed(url: Column, domains: Column, strict_suffix: bool = False) -> Column:
    """Any allowed domain occurs in the host; ``strict_suffix`` wants the host or a subdomain."""
    if strict_suffix:
        return F.exists(domains, lambda d: (host(url) == d) | host(url).endswith(F.concat(F.lit("."), d)))
    return F.exists(domains, lambda d: host(url).contains(d))


def page_text(parsed: DataFrame) -> DataFrame:
    rest = [c for c in parsed.columns if c != "page"]
    return parsed.select(*rest, F.col("page.title").alias("title"), strip(F.col("page.text")).alias("text"))
