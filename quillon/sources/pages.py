"""Signals of web pages.

What a tokenizer is needed for is a vectorised function over the HTML; the rest
are expressions. Pages are a table that has landed; probes for robots.txt and
sitemap.xml are joined from a table of (host, path, status).

Text of script and style elements counts as text of the body, as in the DOM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.skew import even_join
from quillon.schemas import PAGE_SIGNALS

# Words that call to action, words of testimonials, and what a scan never measures.
CTA_WORDS = ["reserva", "reservar", "book", "contacta", "contactar", "llama", "call", "pide cita", "comprar", "presupuesto"]
TESTIMONIAL_WORDS = ["testimonio", "opinion", "opinión", "reseña", "review", "lo que dicen"]
UNAVAILABLE = ["mobile_rendering_screenshot", "full_site_broken_link_crawl", "field_core_web_vitals"]
NOT_CALLED, CALL_FAILED = "lighthouse_performance_score", "pagespeed_lighthouse_score"

#: Elements that may stand before the body.
HEAD = frozenset(("html", "head", "title", "meta", "link", "style", "script", "base", "noscript", "template"))

WHITE = re.compile(r"[\s\xa0\ufeff]+")


class _Signals(HTMLParser):
    """Counts as it goes; memory grows with the text of the page only."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.origin = url, _origin(url)
        self.n = dict.fromkeys(("img", "no_alt", "internal", "external", "h1", "h2"), 0)
        self.flags = dict.fromkeys(("schema", "tel", "whatsapp", "form"), False)
        self.meta = self.canonical = self.viewport = None
        self.title: list[str] | None = None
        self.in_title = self.in_body = False
        self.head: str | None = None
        self.body: list[str] = []
        self.open: list[tuple[str, list[str]]] = []
        self.calls: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.in_title:  # within a title markup is text
            self.title.append(self.get_starttag_text() or "")
            return
        a: dict[str, str] = {}
        for k, v in attrs:  # the first of repeated attributes counts
            a.setdefault(k, v or "")
        if not self.in_body and tag not in HEAD:
            self.in_body = True
        elif not self.in_body and tag in ("title", "style", "script"):
            self.head = tag
        if tag == "img":
            self.n["img"] += 1
            self.n["no_alt"] += not WHITE.sub("", a.get("alt", ""))
        elif tag in ("h1", "h2"):
            self.n[tag] += 1
        elif tag == "form":
            self.flags["form"] = True
        elif tag == "script":
            self.flags["schema"] |= a.get("type") == "application/ld+json"
        elif tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif tag == "meta" and a.get("name") == "description" and self.meta is None:
            self.meta = a.get("content", "")
        elif tag == "meta" and a.get("name") == "viewport" and self.viewport is None:
            self.viewport = a.get("content", "")
        elif tag == "link" and a.get("rel") == "canonical" and self.canonical is None:
            self.canonical = a.get("href", "")
        elif tag == "a" and "href" in a:
            self._link(a["href"])
            self.open.append((tag, []))
        elif tag == "button":
            self.open.append((tag, []))

    def _link(self, href: str) -> None:
        self.flags["tel"] |= href.startswith("tel:")
        self.flags["whatsapp"] |= "wa.me" in href or "api.whatsapp.com" in href
        if href.startswith(("#", "mailto:", "tel:")):
            return
        try:
            origin = _origin(urljoin(self.url, href.strip()))
        except ValueError:
            return
        self.n["internal" if origin is not None and origin == self.origin else "external"] += 1

    def handle_comment(self, data):
        if self.in_title:
            self.title.append(f"<!--{data}-->")

    def handle_endtag(self, tag):
        if self.in_title and tag != "title":
            self.title.append(f"</{tag}>")
            return
        if tag == self.head:
            self.head = None
        if tag == "title":
            self.in_title = False
        elif tag in ("a", "button"):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    self.calls.append("".join(self.open.pop(i)[1]))
                    break

    def handle_data(self, data):
        # Text outside the elements of the head begins the body, also where no tag says so.
        self.in_body = self.in_body or (self.head is None and bool(data.strip(" \t\n\r\f")))
        if self.in_title:
            self.title.append(data)
        if self.in_body:
            self.body.append(data)
        for _, parts in self.open:
            parts.append(data)

    def row(self) -> dict:
        text = WHITE.sub(" ", "".join(self.body)).strip(" ")
        calls = [*self.calls, *("".join(parts) for _, parts in self.open)]
        strip = lambda s: s.strip(" \t\n\r\x0b\x0c\xa0\ufeff")
        title = strip("".join(self.title)) if self.title else None
        meta = strip(self.meta) if self.meta else None
        lower = text.lower()
        return {
            "image_count": self.n["img"], "images_missing_alt": self.n["no_alt"], "internal_link_count": self.n["internal"], "external_link_count": self.n["external"],
            "word_count_estimate": len(text.split(" ")) if text else 0, "title": title or None, "title_length": _units(title), "meta_description": meta or None,
            "meta_description_length": _units(meta), "canonical_present": bool(self.canonical), "has_viewport_meta": bool(self.viewport),
            "schema_markup_present": self.flags["schema"], "h1_count": self.n["h1"], "h2_count": self.n["h2"], "has_phone_link": self.flags["tel"],
            "has_whatsapp_link": self.flags["whatsapp"], "has_contact_form": self.flags["form"],
            "cta_mentions_count": sum(any(w in c.lower() for w in CTA_WORDS) for c in calls), "has_testimonials_section": any(w in lower for w in TESTIMONIAL_WORDS),
        }


def _units(s: str | None) -> int:
    """Length in UTF-16 units."""
    return len(s.encode("utf-16-le", "surrogatepass")) // 2 if s else 0


def _origin(url: str) -> str | None:
    """Scheme, host and port unless default; none for addresses that have no origin."""
    u = urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname:
        return None
    port = u.port if u.port != {"http": 80, "https": 443}[u.scheme] else None
    return f"{u.scheme}://{u.hostname}" + (f":{port}" if port else "")


def signals_of(html: str | None, url: str | None) -> dict:
    p = _Signals(url or "")
    p.feed(html or "")
    p.close()
    return p.row()


def signals(html: Column, url: Column) -> Column:
    names = PAGE_SIGNALS.names

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, urls in parts:
            yield pd.DataFrame([signals_of(h, u) for h, u in zip(pages, urls, strict=True)], columns=names)

    return F.pandas_udf(run, PAGE_SIGNALS)(html, url)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def https(url: Column) -> Column:
    return F.lower(url).startswith("https:")


def scan(pages: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """A scan for each page: status, signals as columns, and what could not be measured.

    ``pages`` has page_id, url, html; optionally http_status, server_response_time_ms,
    lighthouse_performance_score, page_speed_failed and error. A page with an error,
    or without HTML, is a failed scan without signals. A host with very many pages
    is dealt over several tasks in proportion, each with the host's probes.
    """
    cols = set(pages.columns)
    optional = lambda c, kind: (F.col(c) if c in cols else F.lit(None)).cast(kind).alias(c)
    rows = pages.select("page_id", "url", "html", optional("http_status", "int"), optional("server_response_time_ms", "int"), optional("lighthouse_performance_score", "int"), optional("page_speed_failed", "boolean"), optional("error", "string"))
    failed = F.col("error").isNotNull() | F.col("html").isNull()
    rows = rows.withColumn("status", F.when(failed, "failed").otherwise("completed"))
    rows = rows.withColumn("robots_txt_present", F.lit(False)).withColumn("sitemap_present", F.lit(False))
    if probes is not None:
        ok = probes.where(F.col("status").between(200, 399))
        found = ok.groupBy(F.col("host").alias("__host")).agg(F.bool_or(F.col("path") == "/robots.txt").alias("__robots"), F.bool_or(F.col("path") == "/sitemap.xml").alias("__sitemap"))
        # Pages are dealt before their signals are computed, so that the pages of one host are parsed beside each other.
        rows = even_join(rows, found, origin(F.col("url")), "__host")
        rows = rows.withColumn("robots_txt_present", F.coalesce("__robots", F.lit(False))).withColumn("sitemap_present", F.coalesce("__sitemap", F.lit(False)))
    rows = rows.withColumn("s", signals(F.col("html"), F.col("url")))
    done = lambda c: F.when(F.col("status") == "completed", c)
    unscored = (F.col("status") == "completed") & F.col("lighthouse_performance_score").isNull()
    tried = F.coalesce("page_speed_failed", F.lit(False))
    missing = F.array_compact(F.array(*map(F.lit, UNAVAILABLE), F.when(unscored & tried, F.lit(CALL_FAILED)).when(unscored, F.lit(NOT_CALLED))))
    return rows.select(
        "page_id", "url", "status", F.coalesce("error", F.when(F.col("html").isNull(), "No se pudo acceder a la web")).alias("error"),
        done(https(F.col("url"))).alias("https"), done(F.col("http_status")).alias("http_status"), done(F.octet_length("html")).alias("html_size_bytes"),
        done(F.col("robots_txt_present")).alias("robots_txt_present"), done(F.col("sitemap_present")).alias("sitemap_present"),
        done(F.col("server_response_time_ms")).alias("server_response_time_ms"), done(F.col("lighthouse_performance_score")).alias("lighthouse_performance_score"),
        *[done(F.col(f"s.{n}")).alias(n) for n in PAGE_SIGNALS.names], done(F.col("s.has_viewport_meta")).alias("has_responsive_meta"), missing.alias("unavailable_metrics"),
    )


def pagespeed(answer: Column) -> Column:
    """Score (0 where it is no number) and vitals of a stored answer of the page speed service."""
    j = F.try_parse_json(answer)
    score = F.try_variant_get(j, "$.lighthouseResult.categories.performance.score", "double")
    audit = lambda name: F.try_variant_get(j, f'$.lighthouseResult.audits["{name}"].numericValue', "double")
    return F.struct(
        F.coalesce(F.round(score * 100), F.lit(0.0)).cast("int").alias("performance_score"), audit("largest-contentful-paint").alias("largest_contentful_paint_ms"),
        audit("total-blocking-time").alias("total_blocking_time_ms"), audit("cumulative-layout-shift").alias("cumulative_layout_shift"),
    )


def with_answers(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages with what stored answers of the page speed service say: ``answers`` has page_id and answer, null where the call failed.

    A page without a row was not asked about. Of several answers to a page the greatest counts.
    """
    one = answers.where("page_id is not null").groupBy(F.col("page_id").alias("__page")).agg(F.max("answer").alias("__answer"))
    rows = pages.join(one, F.col("page_id") == F.col("__page"), "left")
    score = F.when(F.col("__answer").isNotNull(), pagespeed(F.col("__answer"))["performance_score"])
    return rows.select(*pages.columns, score.alias("lighthouse_performance_score"), (F.col("__page").isNotNull() & F.col("__answer").isNull()).alias("page_speed_failed"))
