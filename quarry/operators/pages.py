"""Product facts of web pages: linked data first, then meta tags and microdata, then the first text that looks like a price.

Pages are taken apart by column expressions, so no page leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query

# Words of availability (the first list is asked first), and of amounts that are no price.
OUT_OF_STOCK = ("outofstock", "out_of_stock", "out of stock", "soldout", "discontinued", "backorder", "0", "false")
IN_STOCK = ("instock", "in_stock", "in stock", "limitedavailability", "presale", "1", "true")
NO_PRICE = ("kargo", "uzeri", "taksit", "kupon", "bedava")
# Fixed value: an amount next to a currency.
PRICE = r"(?i)(?:₺|\bTL\b|\bTRY\b)\s*([0-9][0-9.,\s]*)|([0-9][0-9.,]*)\s*(?:₺|\bTL\b|\bTRY\b)"
#: Keys of linked data under which further nodes stand, and how deep they are followed.
NESTED, LEVELS = ("@graph", "mainEntity", "itemListElement"), 3

FIELDS = ("title", "price_text", "currency", "image_url", "brand", "gtin", "mpn", "sku", "category")


def unescaped(c: Column) -> Column:
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(letter))
    return c


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in double, single or no quotes; null if it is absent or empty."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    return F.nullif(unescaped(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")), F.lit(""))


def items(node: Column) -> Column:
    """The objects of a JSON text: an array's, or the one object."""
    lists = F.from_json(node, "array<string>")
    return F.coalesce(F.when(node.startswith("["), lists).when(node.startswith("{"), F.array(node)), F.array().cast("array<string>"))


def value(node: Column, key: str) -> Column:
    """A property as text: of an object its name, value or address, of an array its first item's."""
    raw = F.get_json_object(node, f"$['{key}']")
    first = F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(raw)
    inner = F.coalesce(*[F.get_json_object(first, f"$['{k}']") for k in ("name", "@value", "url")])
    return F.nullif(F.trim(F.when(first.startswith("{"), inner).otherwise(first)), F.lit(""))


def picture(node: Column) -> Column:
    """An image's address: text, the first of several, or an object's address (never its name)."""
    raw = F.get_json_object(node, "$.image")
    first = F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(raw)
    inner = F.coalesce(*[F.get_json_object(first, f"$['{k}']") for k in ("url", "contentUrl", "@id")])
    return F.nullif(F.trim(F.when(first.startswith("{"), inner).otherwise(first)), F.lit(""))


def in_stock(availability: Column) -> Column:
    last = F.element_at(F.split(F.lower(availability), "/"), -1)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(last, w))
    return F.when(availability.isNull() | (availability == ""), None).when(has(OUT_OF_STOCK), False).when(has(IN_STOCK), True)


def linked_product(node: Column) -> Column:
    """What a linked-data node says of a product; null if it is none or lacks title or price."""
    kind = F.lower(F.coalesce(F.get_json_object(node, "$['@type']"), F.get_json_object(node, "$.type"), F.lit("")))
    priced = lambda o: F.coalesce(*[F.get_json_object(o, f"$.{k}") for k in ("price", "lowPrice", "highPrice")]).isNotNull()
    offers = F.concat(items(F.get_json_object(node, "$.offers")), F.array(node))
    offer = F.get(F.filter(offers, priced), F.lit(0))
    price = F.coalesce(value(offer, "price"), value(offer, "lowPrice"))
    gtin = F.coalesce(*[value(node, k) for k in ("gtin13", "gtin", "gtin12", "gtin14", "gtin8")])
    parts = (value(node, "name"), price, value(offer, "priceCurrency"), picture(node), value(node, "brand"), gtin, value(node, "mpn"), value(node, "sku"), value(node, "category"))
    product = F.struct(*[c.alias(n) for n, c in zip(FIELDS, parts, strict=True)], in_stock(value(offer, "availability")).alias("in_stock"))
    return F.when(kind.rlike('(^|")product("|$)') & parts[0].isNotNull() & price.isNotNull(), product)


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, the FIELDS, in_stock and layer (json_ld, opengraph, heuristic or none) of pages (page_id, html)."""
    comments = F.regexp_replace(F.coalesce("html", F.lit("")), "(?s)<!--.*?-->", " ")
    rows = pages.select("page_id", comments.alias("html"))
    blocks = F.regexp_extract_all("html", F.lit(r"""(?is)<script\s[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    rows = rows.withColumns({"blocks": blocks, "plain": F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " ")})
    nodes = F.flatten(F.transform(F.filter("blocks", lambda b: F.try_parse_json(b).isNotNull()), lambda b: items(F.trim(b))))
    rows = rows.withColumns({"level": nodes, "nodes": nodes})
    for _ in range(LEVELS):
        below = F.flatten(F.transform("level", lambda n: F.flatten(F.array(*[items(F.get_json_object(n, f"$['{k}']")) for k in NESTED]))))
        rows = rows.withColumn("level", below).withColumn("nodes", F.concat("nodes", "level"))
    rows = rows.withColumn("linked", F.get(F.array_compact(F.transform("nodes", linked_product)), F.lit(0)))

    tags = lambda pattern: F.regexp_extract_all("plain", F.lit(pattern), F.lit(0))
    meta_key = lambda m: F.lower(F.coalesce(attribute(m, "property"), attribute(m, "name"), attribute(m, "itemprop")))
    micro_value = lambda m: F.coalesce(attribute(m, "content"), attribute(m, "href"), attribute(m, "src"))
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    filled = lambda pairs: F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    rows = rows.withColumns(
        {
            "meta": filled(F.transform(tags(r"(?is)<meta\s[^>]*>"), lambda m: pair(meta_key(m), attribute(m, "content")))),
            "micro": filled(F.transform(tags(r"(?is)<(?!meta\b)[a-z][^>]*\sitemprop\s*=[^>]*>"), lambda m: pair(F.lower(attribute(m, "itemprop")), micro_value(m)))),
            "title": F.nullif(F.trim(unescaped(F.regexp_extract("plain", r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit("")),
            "body": F.regexp_replace("plain", r"(?is)<title[^>]*>.*?</title>", " "),
        }
    )
    first = lambda pairs, key: F.get(F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["v"]), F.lit(0))
    meta, micro = (lambda k: first("meta", k)), (lambda k: first("micro", k))
    tagged = (
        F.coalesce(meta("og:title"), micro("name"), F.col("title")),
        F.coalesce(meta("product:price:amount"), meta("og:price:amount"), micro("price")),
        F.coalesce(meta("product:price:currency"), meta("og:price:currency")),
        F.coalesce(meta("og:image"), micro("image")),
        F.coalesce(meta("product:brand"), micro("brand")),
        F.coalesce(micro("gtin13"), micro("gtin")),
        micro("mpn"),
        micro("sku"),
        F.lit(None).cast("string"),
    )
    known = F.struct(*[c.alias(n) for n, c in zip(FIELDS, tagged, strict=True)], in_stock(F.coalesce(meta("product:availability"), micro("availability"))).alias("in_stock"))
    rows = rows.withColumn("tagged", known)
    # Turkish lower case without marks, as far as the words asked for need it.
    folded = lambda c: F.lower(F.translate(c, "İIıÜüŞşÖöÇçĞğ", "iiiuussooccgg"))
    chunks = F.transform(F.split("body", r"<[^>]*>"), lambda c: F.trim(unescaped(c)))
    fair = F.filter(chunks, lambda c: ~F.exists(F.array(*map(F.lit, NO_PRICE)), lambda w: F.contains(folded(c), w)))
    price = lambda c: F.nullif(F.trim(F.concat(F.regexp_extract(c, PRICE, 1), F.regexp_extract(c, PRICE, 2))), F.lit(""))
    rows = rows.withColumn("seen", F.get(F.array_compact(F.transform(fair, price)), F.lit(0)))
    none = F.lit(None).cast("string")
    guessed = (F.col("title"), F.col("seen"), F.lit("TRY"), meta("og:image"), none, none, none, none, none)
    guess = F.struct(*[c.alias(n) for n, c in zip(FIELDS, guessed, strict=True)], F.lit(None).cast("boolean").alias("in_stock"))
    by_tags = F.col("tagged.title").isNotNull() & F.col("tagged.price_text").isNotNull()
    by_text = F.col("title").isNotNull() & F.col("seen").isNotNull()
    layer = F.when(F.col("linked").isNotNull(), "json_ld").when(by_tags, "opengraph").when(by_text, "heuristic").otherwise("none")
    found = F.when(F.col("linked").isNotNull(), F.col("linked")).when(by_tags, F.col("tagged")).when(by_text, guess)
    return rows.select("page_id", layer.alias("layer"), found.alias("f")).select("page_id", "layer", "f.*")


def shop_pages(t: Tables) -> DataFrame:
    """All pages, five of six of them with facts of a product put in: linked data of three shapes, tags, microdata, a price in the text."""
    n = F.col("page_id")
    name, price = F.concat(F.lit("Item "), n), F.concat(n % 900 + 10, F.lit(".90"))
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script></head>"))
    one = script(F.concat(F.lit('{"@type": "Product", "name": "'), name, F.lit('", "brand": {"name": "Acme"}, "gtin13": "'), F.lpad(n.cast("string"), 13, "0"), F.lit('", "offers": {"price": "'), price, F.lit('", "priceCurrency": "TRY", "availability": "https://schema.org/InStock"}}')))
    graph = script(F.concat(F.lit('{"@graph": [{"@type": "WebPage", "name": "x"}, {"@type": ["Thing", "Product"], "name": "'), name, F.lit('", "image": [{"url": "/i.png", "name": "pic"}], "offers": [{"lowPrice": '), price, F.lit(', "availability": "OutOfStock"}]}]}')))
    broken = F.concat(F.lit('<script type="application/ld+json">{"@type": "Product", </script><meta property="og:title" content="'), name, F.lit('"><meta content="'), price, F.lit("\" property='product:price:amount'></head>"))
    micro = F.concat(F.lit('</head><span itemprop="name" content="'), name, F.lit('"></span><link itemprop=availability href="http://schema.org/SoldOut"><meta itemprop="x" content="y"><data itemprop="price" content="'), price, F.lit('"></data>'))
    text = F.concat(F.lit("</head><p>500 TL ve ÜZERİ kargo bedava</p><p>Only "), price, F.lit(" TL!</p>"))
    head = F.when(n % 6 == 0, one).when(n % 6 == 1, graph).when(n % 6 == 2, broken).when(n % 6 == 3, micro).when(n % 6 == 4, text).otherwise("</head>")
    return t.pages.select("page_id", F.replace("html", F.lit("</head>"), head).alias("html"))


@query("src_html_product")
def src_html_product(t: Tables) -> DataFrame:
    """The product facts of every page."""
    return page_facts(shop_pages(t))
