"""Stored pages as a source: messages, link cards, block-page classes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions.text import first_phrase, html_clean_text, squeeze


def message_blocks(pages: DataFrame, marker: str, text_block: str, keep_repeats: bool = False) -> DataFrame:
    """page_id, pos, id, text: the page is cut at each match of ``marker`` (group 1 is the message id); the first match of
    ``text_block`` (group 1) in a block is its text, without tags. Blocks of an id seen before in the page are no markers
    (unless keep_repeats); empty texts are dropped."""
    rest = F.regexp_replace("html", marker, "\x01$1\x02")
    blocks = F.slice(F.split(rest, "\x01"), 2, 1 << 30)
    cut = pages.select("page_id", F.posexplode(blocks).alias("pos", "block"))
    cut = cut.select("page_id", "pos", F.substring_index("block", "\x02", 1).alias("id"), F.expr("substring(block, locate('\x02', block) + 1)").alias("block"))
    if not keep_repeats:
        # A repeated marker is no marker: its block stays with the one before.
        first = F.row_number().over(Window.partitionBy("page_id", "id").orderBy("pos")) == 1
        cut = cut.withColumn("first", first)
        run = F.sum(F.col("first").cast("int")).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        cut = cut.withColumn("run", run).groupBy("page_id", "run")
        cut = cut.agg(F.min("pos").alias("pos"), F.min_by("id", "pos").alias("id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "").alias("block"))
    text = html_clean_text(F.regexp_extract("block", f"(?s){text_block}", 1))
    return cut.select("page_id", "pos", "id", text.alias("text")).filter("text <> ''")


def page_class(html: Column, link: str, markers: Sequence[str] = L.BLOCK_PAGE_MARKERS, status: Column | None = None, links_win: bool = False) -> Column:
    """``status``, ``marker:<phrase>`` or ``ok``: scripts and styles are dropped, the visible text is searched in the order of the list."""
    visible = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    text = squeeze(F.lower(F.regexp_replace(visible, "<[^>]+>", " ")))
    hit = first_phrase(text, markers)
    blocked = hit.isNotNull() & (F.regexp_count(html, F.lit(link)) == 0) if links_win else hit.isNotNull()
    by_text = F.when(blocked, F.concat(F.lit("marker:"), hit)).otherwise(F.lit("ok"))
    return by_text if status is None else F.when(status.isin(403, 429), F.lit("status")).otherwise(by_text)


#: Hosts and paths of the seven card sources; price asks for the nearest ancestor with a price.
PRICE_HINT = "تومان|تومن|توافقی|تماس بگیرید"
CARD_SOURCES = (
    {"name": "divar", "hosts": ["divar.ir"], "paths": ["(?i)^/v/[^/]+/[^/]+/?$"]},
    {"name": "bama", "hosts": ["bama.ir"], "paths": ["(?i)^/car/detail-[^/?#]+/?$"]},
    {"name": "khodro45", "hosts": ["khodro45.com"], "paths": ["(?i)^/used-car/[^/?#]+/[0-9A-Za-z_-]+/?$", "(?i)^/cars?/[^/?#]+/[0-9A-Za-z_-]+/?$"]},
    {"name": "formula", "hosts": ["formula.ir"], "paths": ["(?i)^/car/detail-[^/?#]+/?$"], "price": PRICE_HINT},
    {"name": "sheypoor", "hosts": ["sheypoor.com", "www.sheypoor.com"], "paths": [r"(?i)^/v/.+\.html/?$"], "price": PRICE_HINT},
    {"name": "karnameh", "hosts": ["karnameh.com"], "paths": ["(?i)^/used-cars/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}/?$"]},
    {"name": "hamrah_mechanic", "hosts": ["hamrah-mechanic.com", "www.hamrah-mechanic.com"], "paths": ["(?i)^/cars-for-sale/[^/]+/[^/]+/[0-9]+/?$"]},
)
#: The cards of a search page: below /v/ at least two parts, the last of which is the id.
SEARCH_CARD = {"name": "search", "paths": [r"/v/(?:[^/]+/)+[A-Za-z0-9_-]+/?$"]}


def message_repeats(pages: DataFrame, marker: str) -> DataFrame:
    """page_id, id, repeats: how often a message id occurs again in its page after the first time."""
    ids = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(marker), F.lit(1))).alias("id"))
    return ids.groupBy("page_id", "id").agg((F.count("*") - 1).alias("repeats")).filter("repeats > 0")


class _Cards(HTMLParser):
    """Anchors with their text parts, and the text parts of each of their ancestors."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, list[str]]] = []
        self.anchors: list[tuple[str, list[str], list[list[str]]]] = []
        self.muted = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.muted += tag in ("script", "style")
        node = (tag, [])
        if tag == "a" and (href := dict(attrs).get("href")):
            self.anchors.append((href, node[1], [n[1] for n in reversed(self.open)]))
        self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.muted -= sum(n[0] in ("script", "style") for n in self.open[k:])
                del self.open[k:]
                return

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not self.muted:
            for _, parts in self.open:
                parts.append(text)


def _join(base: str, href: str) -> tuple[str, str, str]:
    """(scheme, host, path) of a link; relative ones take the page's."""
    u, b = urlsplit(href), urlsplit(base or "")
    path = u.path if u.path.startswith("/") or u.netloc else f"{b.path.rpartition('/')[0]}/{u.path}"
    return (u.scheme or b.scheme or "https").lower(), (u.netloc or b.netloc).lower(), path.rstrip("/") or "/"


def page_cards(pages: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """page_id, pos, rule, url, ad_id, title, text of the cards in stored pages (page_id, url, html).

    A rule has ``name``, ``hosts`` (None: any; else the host or a subdomain of it), ``paths`` (regular expressions), and may have
    ``price`` (a regular expression: the text is that of the nearest of at most 7 ancestors with a match and 15 to 1800 characters)
    and ``skip`` (a regular expression of parts that are no title). Canonical URLs count once per page and rule; the last part
    of the path is the id; cards without a title are dropped. The rules travel with the task; pages are parsed where they lie.
    """
    compiled = [(r["name"], r.get("hosts"), [re.compile(p) for p in r["paths"]], re.compile(r["price"]) if r.get("price") else None, re.compile(r["skip"]) if r.get("skip") else None) for r in rules]

    def cards(page_id: int, base: str, html: str) -> Iterator[tuple]:
        parser = _Cards()
        parser.feed(html or "")
        seen = set()
        for pos, (href, parts, above) in enumerate(parser.anchors):
            scheme, host, path = _join(base, href)
            for name, hosts, paths, price, skip in compiled:
                if hosts and not any(host == h or host.endswith("." + h) for h in hosts) or not any(p.search(path) for p in paths):
                    continue
                url = f"{scheme}://{host}{path}"
                if (name, url) in seen:
                    continue
                unique = list(dict.fromkeys(parts))
                text = " ".join(unique)
                if price:
                    near = (" ".join(dict.fromkeys(x)) for x in [parts, *above[:7]])
                    text = next((t for t in near if 15 <= len(t) <= 1800 and price.search(t)), "")
                title = next((p for p in unique if not (skip and skip.search(p))), "")
                if title and text:
                    seen.add((name, url))
                    yield page_id, pos, name, url, path.rpartition("/")[2], title, text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [c for r in frame.itertuples(index=False) for c in cards(r.page_id, r.url, r.html)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "rule", "url", "ad_id", "title", "text"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, pos int, rule string, url string, ad_id string, title string, text string")
