"""Page facts against a plain parser that walks the page once, and pages with every layer and fault."""

import json
import re
from html.parser import HTMLParser

from quarry.operators import pages
from quarry.plans.registry import Tables

ROOT = "/root/testdata/sf0.001"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.meta, self.micro, self.chunks, self.title, self.place = [], {}, {}, [], "", None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "script":
            self.place = "ld" if a.get("type") == "application/ld+json" else "code"
            self.blocks += [""] if self.place == "ld" else []
        elif tag in ("style", "title"):
            self.place = tag
        elif tag == "meta":
            key = a.get("property") or a.get("name") or a.get("itemprop")
            if key and a.get("content"):
                self.meta.setdefault(key.lower(), a["content"])
        if tag != "meta" and a.get("itemprop"):
            v = a.get("content") or a.get("href") or a.get("src")
            if v:
                self.micro.setdefault(a["itemprop"].lower(), v)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.place = None

    def handle_data(self, data):
        if self.place == "ld":
            self.blocks[-1] += data
        elif self.place == "title":
            self.title += data
        elif self.place is None and data.strip():
            self.chunks.append(data.strip())


def nodes(x):
    if isinstance(x, list):
        return [n for i in x for n in nodes(i)]
    return [x] + [n for k in ("@graph", "mainEntity", "itemListElement") if k in x for n in nodes(x[k])] if isinstance(x, dict) else []


def facts(html):
    p = Plain()
    p.feed(html or "")
    p.close()
    for block in p.blocks:
        try:
            found = nodes(json.loads(block))
        except json.JSONDecodeError:
            continue
        for n in found:
            kinds = n.get("@type", "")
            offers = n.get("offers", [])
            offer = next((o for o in (offers if isinstance(offers, list) else [offers]) if {"price", "lowPrice"} & set(o)), None)
            if "product" in str(kinds).lower() and offer and n.get("name"):
                return "json_ld", n["name"], str(offer.get("price") or offer.get("lowPrice"))
    title = p.meta.get("og:title") or p.micro.get("name") or p.title.strip()
    price = p.meta.get("product:price:amount") or p.meta.get("og:price:amount") or p.micro.get("price")
    if title and price:
        return "opengraph", title, price
    for chunk in p.chunks:
        low = chunk.replace("İ", "i").replace("I", "i").replace("Ü", "u").replace("ü", "u").lower()
        if any(w in low for w in pages.NO_PRICE):
            continue
        m = re.search(pages.PRICE, chunk)
        if m and p.title.strip() and (m[1] or m[2] or "").strip():
            return "heuristic", p.title.strip(), (m[1] or m[2]).strip()
    return "none", None, None


def test_pages_equal_a_plain_parser(spark):
    rows = pages.shop_pages(Tables(spark, ROOT)).cache()
    found = {r.page_id: (r.layer, r.title, r.price_text) for r in pages.page_facts(rows).collect()}
    expected = {r.page_id: facts(r.html) for r in rows.collect()}
    assert found == expected
    assert {layer for layer, _, _ in found.values()} == {"json_ld", "opengraph", "heuristic", "none"}


def test_single_pages(spark):
    html = {
        "list": '<script type="application/ld+json">[{"@type":"Product","name":"A","brand":"B","image":"i.png","offers":{"lowPrice":5,"availability":"x/SoldOut"}}]</script>',
        "no_price": '<title>T</title><script type="application/ld+json">{"@type":"Product","name":"A"}</script>',
        "nested": '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"mainEntity":{"@type":"product","name":"C","price":"7"}}]}</script>',
        "entities": "<meta name='og:title' content='a &amp; b'><meta property=og:price:amount content=9>",
        "comment": '<!-- <meta property="og:price:amount" content="9"> --><title>x</title>',
        "style": "<title>x</title><style>p{content:'9 TL'}</style>",
        "empty": "",
        "null": None,
    }
    rows = spark.createDataFrame(list(html.items()), "page_id string, html string")
    found = {r.page_id: (r.layer, r.title, r.price_text, r.in_stock) for r in pages.page_facts(rows).collect()}
    assert found == {
        "list": ("json_ld", "A", "5", False),
        "no_price": ("none", None, None, None),
        "nested": ("json_ld", "C", "7", None),
        "entities": ("opengraph", "a & b", "9", None),
        "comment": ("none", None, None, None),
        "style": ("none", None, None, None),
        "empty": ("none", None, None, None),
        "null": ("none", None, None, None),
    }
