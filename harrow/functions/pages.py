"""Pages: which are no news pages, what is their article, how much they look like news."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harrow.functions.normalize import ColumnOrName, text
from harrow.functions.structs import struct_of

# Hosts, paths, query keys, element names and limits.
WIKI_HOST = r"(?i)(^|\.)(wikipedia|wikimedia|wiktionary|wikiquote|wikibooks|wikisource)\.org$"
EXCLUDED_PATHS = (
    "arama", "search", "kategori", "category", "categories", "etiket", "tag", "tags", "yazar", "author", "authors", "arsiv", "arşiv", "archive", "login", "signin", "signup",
    "uyelik", "üyelik", "hakkimizda", "hakkımızda", "about", "iletisim", "iletişim", "contact", "gizlilik", "privacy", "kullanim-kosullari", "kullanım-koşulları", "terms",
)
CATEGORY_ROOTS = ("gundem", "gündem", "dunya", "dünya", "ekonomi", "spor", "magazin", "teknoloji", "saglik", "sağlık", "kultur-sanat", "kültür-sanat", "politika", "yerel", "haberler", "news")
SEARCH_KEYS = ("q", "s", "search", "query", "keyword", "ara", "arama")
NEWS_TYPES = frozenset({"newsarticle", "reportagenewsarticle", "analysisnewsarticle", "backgroundnewsarticle", "opinionnewsarticle", "reviewnewsarticle"})
ARTICLE_TYPES = frozenset({"article", "blogposting"})
BODY_CLASSES = (
    "article-body", "article-content", "article-detail", "article-text", "news-content", "news-detail", "news-body", "haber-icerik", "haber-içerik", "haber-detay", "haber-metni", "post-content", "entry-content", "detail-content",
)
LEAD_CLASSES = ("spot", "article-spot", "news-spot", "lead", "summary", "article-summary", "haber-spot", "detail-spot")
LEAST_PARAGRAPH, LEAST_PARAGRAPHS, MOST_PARAGRAPHS, MOST_CHARACTERS, LEAST_CHARACTERS, LEAST_SCORE, MOST_SCRIPTS = 40, 3, 200, 75_000, 600, 7, 40

_UNWANTED = frozenset({"nav", "footer", "aside", "header", "form", "button"})
_UNWANTED_CLASS = re.compile(r"(?i)(?:^|[\s_-])(?:nav|menu|footer|header|sidebar|related|comment|share|social|advert|ads?|banner|cookie|newsletter|breadcrumb|tags?)(?:$|[\s_-])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


def exclusion(url: ColumnOrName) -> Column:
    """Why an address is no news page, the first reason; null if it may be one."""
    u = F.trim(text(url))
    host, path = F.lower(F.try_parse_url(u, F.lit("HOST"))), F.coalesce(F.try_url_decode(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("/"))), F.lit("/"))
    query = F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda p: F.lower(F.split(p, "=")[0]))
    excluded = path.rlike(r"(?iU)/(?:" + "|".join(EXCLUDED_PATHS) + r")(?:/|$)") | path.rlike(r"(?iU)^/(?:" + "|".join(CATEGORY_ROOTS) + r")/?$")
    return (
        F.when(host.isNull(), "unreadable_address").when(~F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")), F.lit("")).isin("http", "https"), "unsupported_scheme")
        .when(host.rlike(WIKI_HOST), "wiki_page").when(path.isin("", "/"), "home_page").when(F.exists(keys, lambda k: k.isin(*SEARCH_KEYS)), "search_results").when(excluded, "list_page")
    )


def path_depth(url: ColumnOrName) -> Column:
    """Parts of an address's path."""
    return F.size(F.filter(F.split(F.coalesce(F.try_parse_url(F.trim(text(url)), F.lit("PATH")), F.lit("")), "/"), lambda p: p != ""))


def _clean(s: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[​-‍﻿]", "", s)).strip()


def _ld_facts(value: object, facts: dict[str, bool]) -> None:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += v
        elif isinstance(v, dict):
            kinds = v.get("@type")
            for kind in kinds if isinstance(kinds, list) else [kinds]:
                name = str(kind or "").strip().lower().rsplit("/", 1)[-1]
                facts["has_news_article"] |= name in NEWS_TYPES
                facts["has_generic_article"] |= name in ARTICLE_TYPES
            facts["has_article_body"] |= len(_clean(str(v.get("articleBody") or ""))) >= 100
            facts["has_published_date"] |= bool(v.get("datePublished") or v.get("dateCreated") or v.get("uploadDate"))
            facts["has_author"] |= bool(v.get("author") or v.get("creator"))
            todo += list(v.values())


_PLACES = ("article", "main")


class _Page(HTMLParser):
    """Texts of the elements that matter, each with the elements around it.

    An element knows the nearest root around it, which knows the next, and gives its text away when it ends: lists of
    all roots and copies of texts in each would grow with the square of the depth.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.meta: dict[str, str] = {}
        self.scripts: list[str] = []
        self.texts: list[dict] = []
        self.roots: list[dict] = []
        self.seen = {"article": False, "article_body": False, "time": False, "author": False}
        self.title = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "")
        if tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, _clean(a["content"]))
            return
        self.seen["article"] |= tag == "article"
        self.seen["article_body"] |= a.get("itemprop") == "articleBody"
        self.seen["time"] |= tag == "time" and "datetime" in a or a.get("itemprop") == "datePublished"
        self.seen["author"] |= a.get("itemprop") == "author" or a.get("rel") == "author" or bool(re.search(r"(?i)\bauthor\b|\byazar\b", classes))
        if tag in _VOID:
            return
        if tag == "p":
            while self.stack and self.stack[-1]["tag"] == "p":
                self._close()
        up = self.stack[-1] if self.stack else {"tag": "", "hidden": False, "unwanted": False, "root": False, "above": None, "in": frozenset()}
        names = set(classes.split())
        node = {
            "tag": tag, "text": [], "script": tag == "script" and a.get("type") == "application/ld+json",
            "hidden": up["hidden"] or "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", ""))),
            "unwanted": up["unwanted"] or tag in _UNWANTED or bool(_UNWANTED_CLASS.search(classes)),
            "root": a.get("itemprop") == "articleBody" or tag in _PLACES or a.get("role") == "main" or bool(names & set(BODY_CLASSES)),
            "lead": bool(names & set(LEAD_CLASSES)) or a.get("itemprop") == "description", "size": 0, "above": up if up["root"] else up["above"], "in": up["in"] | {up["tag"]} if up["tag"] in _PLACES else up["in"],
        }
        if node["root"]:
            self.roots.append(node)
        self.stack.append(node)

    def _close(self) -> None:
        node = self.stack.pop()
        value = "".join(node.pop("text"))
        if node["script"]:
            self.scripts.append(value)
        elif node["tag"] == "title" and not self.title:
            self.title = _clean(value)
        if node["tag"] in ("script", "style", "noscript", "template"):
            return
        if node["tag"] in ("p", "h1") or node["lead"]:
            self.texts.append(node | {"value": _clean(value)})
        if node["tag"] == "p" and not node["hidden"] and not node["unwanted"]:
            n = len(_clean(value))
            if n >= LEAST_PARAGRAPH:
                for root in _roots(node):
                    root["size"] += n
        if self.stack:
            self.stack[-1]["text"].append(value)

    def handle_endtag(self, tag: str) -> None:
        if any(n["tag"] == tag for n in self.stack):
            while self.stack:
                last = self.stack[-1]["tag"] == tag
                self._close()
                if last:
                    return

    def handle_data(self, data: str) -> None:
        if self.stack:
            self.stack[-1]["text"].append(data)

    def finish(self) -> None:
        while self.stack:
            self._close()


def _roots(node: dict) -> Iterator[dict]:
    """The roots around an element, the nearest first."""
    while node := node["above"]:
        yield node


PAGE_SCHEMA = (
    "title string, description string, paragraphs array<string>, text string, has_news_article boolean, has_generic_article boolean, has_article_body boolean, has_published_date boolean, has_author boolean, "
    "has_article_element boolean, has_heading boolean, og_type string"
)
_FIELDS = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]


def page_facts(html: str | None) -> tuple:
    """An article's parts and a page's news signals."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.finish()
    heads = [t for t in page.texts if t["tag"] == "h1"]
    inside = [[t["value"] for t in heads if tag in t["in"]] for tag in _PLACES]
    names = [*(x[0] for x in inside if x), *(t["value"] for t in heads[:1]), page.meta.get("og:title", ""), page.meta.get("twitter:title", ""), page.title]
    title = next((n for n in names if 10 <= len(n) <= 500), "")
    leads = [page.meta.get(m, "") for m in ("og:description", "description", "twitter:description")][:3]
    leads = [next((x for x in leads if x), "")] + [t["value"] for t in page.texts if t["lead"] and not t["hidden"]]
    description = next((x for x in leads if 30 <= len(x) <= 2000 and x != title), "")

    def collected(root: dict | None) -> list[str]:
        out, seen, total = [], set(), 0
        for t in page.texts:
            if t["tag"] != "p" or t["hidden"] or t["unwanted"] or (root is not None and not any(r is root for r in _roots(t))):
                continue
            value = t["value"]
            if len(value) < LEAST_PARAGRAPH or value.lower() in seen:
                continue
            if total + len(value) > MOST_CHARACTERS or len(out) >= MOST_PARAGRAPHS:
                break
            seen.add(value.lower())
            out.append(value)
            total += len(value)
        return out

    root = max((r for r in page.roots if r["size"]), key=lambda r: r["size"], default=None)
    paragraphs = collected(root)
    if len(paragraphs) < LEAST_PARAGRAPHS or sum(map(len, paragraphs)) < 500:
        paragraphs = collected(None)
    parts, seen = [], set()
    for part in (title, description, *paragraphs):
        if part and part.lower() not in seen:
            seen.add(part.lower())
            parts.append(part)
    facts = dict.fromkeys(("has_news_article", "has_generic_article", "has_article_body", "has_published_date", "has_author"), False)
    for script in page.scripts[:MOST_SCRIPTS]:
        try:
            _ld_facts(json.loads(script or "{}"), facts)
        except (ValueError, RecursionError):
            continue
    facts["has_article_body"] |= page.seen["article_body"]
    facts["has_published_date"] |= page.seen["time"] or "article:published_time" in page.meta
    facts["has_author"] |= page.seen["author"] or "author" in page.meta or "article:author" in page.meta
    heading = bool(heads) and len(heads[0]["value"]) >= 10
    return title, description, paragraphs, "\n\n".join(parts)[:MOST_CHARACTERS], *facts.values(), page.seen["article"], heading, page.meta.get("og:type", "").lower()


#: Pages of a batch that are parsed and given back at once; a batch's answers together may be as large as its pages.
PAGES_AT_ONCE = 64


def facts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """:func:`page_facts` of each page, few at once; the batch itself stays Arrow's."""
    kind = to_arrow_type(struct_of(PAGE_SCHEMA))
    for pages in batches:
        for i in range(0, len(pages), PAGES_AT_ONCE):
            yield pa.array([dict(zip(_FIELDS, page_facts(h), strict=True)) for h in (x.as_py() for x in pages.slice(i, PAGES_AT_ONCE))], kind)


page_udf = F.arrow_udf(facts_of, struct_of(PAGE_SCHEMA))


def detected_articles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the article, its score, whether it is taken for news, and the first reason if not."""
    why = exclusion(url)
    read = pages.withColumns({"_why": why, "depth": path_depth(url)}).withColumn("page", page_udf(F.col(html)))
    c = {f: F.col(f"page.{f}") for f in _FIELDS}
    n, size = F.size(c["paragraphs"]), F.length(c["text"])

    def points(cond: Column, value: int) -> Column:
        return F.when(cond, value).otherwise(0)

    score = (
        points(c["has_news_article"], 5) + points(c["og_type"] == "article", 3) + points(c["has_article_body"], 3) + points(c["has_generic_article"], 1) + points(c["has_article_element"], 1)
        + points(c["has_published_date"], 2) + points(c["has_author"], 1) + points(c["has_heading"], 1) + F.when(n >= 6, 2).when(n >= LEAST_PARAGRAPHS, 1).otherwise(0)
        + F.when(size >= 1500, 2).when(size >= LEAST_CHARACTERS, 1).otherwise(0) + points(F.col("depth") >= 2, 1)
    )
    strong = c["has_news_article"] | c["has_article_body"] | ((c["og_type"] == "article") & c["has_published_date"]) | (c["has_article_element"] & c["has_published_date"] & (F.col("depth") >= 2))
    reason = (
        F.when(F.col("_why").isNotNull(), F.col("_why")).when(c["title"] == "", "no_title").when(n < LEAST_PARAGRAPHS, "too_few_paragraphs").when(size < LEAST_CHARACTERS, "too_short")
        .when(~strong, "no_strong_signal").when(score < LEAST_SCORE, "low_score")
    )
    out = read.withColumns({"score": F.when(F.col("_why").isNull(), score).otherwise(0), "reason": reason, "ok": reason.isNull(), "paragraph_count": n, "character_count": size})
    return out.drop("_why", "depth")
