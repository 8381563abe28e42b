"""What stored pages and links say: canonical URLs, titles, prices, structured data."""

from __future__ import annotations

import json
import re
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import vocabulary as V


def canonical_url(url: Column) -> Column:
    """Without query, fragment and slashes at the end."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#][\s\S]*$", ""), "/+$", "")


def candidate_key(url: Column, name: Column) -> Column:
    """Candidates with the same key are one: the canonical URL, or the name where there is none."""
    return F.coalesce(F.nullif(canonical_url(url), F.lit("")), F.lower(name))


def slug(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(F.lower(url), r"[?][\s\S]*$", ""), r"([^/]*)/*$", 1), r"\.html?$", "")


def is_product_page(url: Column) -> Column:
    """No listing by its path, nor by a plural category as its last part."""
    listing = reduce(lambda a, b: a | b, (F.contains(F.lower(url), F.lit(p)) for p in V.LISTING_PARTS))
    return ~listing & ~slug(url).rlike(V.LISTING_SLUG)


def name_from_slug(url: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(slug(url), "[-_]+", " "), r"\s+", " "))


def image_url(raw: Column, media: str, prefix: str, old: tuple[str, ...] = ()) -> Column:
    """A picture's address at the ``media`` host: hosts in ``old`` are replaced by it, its paths and bare ones get the ``prefix`` unless they have it; addresses at other hosts stay, empty ones stay empty."""
    full = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^//", "https://")
    moved = F.regexp_replace(full, "(?i)^https?://(" + "|".join(re.escape(h) for h in old) + ")(?=/|$)", media) if old else full
    path = F.regexp_replace(F.when(F.startswith(moved, F.lit(media)), F.substring(moved, F.lit(len(media) + 1), F.length(moved))).otherwise(moved), "^/+", "")
    placed = F.concat(F.lit(media + "/"), F.when(F.startswith(path, F.lit(prefix)), path).otherwise(F.concat(F.lit(prefix + "/"), path)))
    foreign = moved.rlike("(?i)^https?://") & ~F.startswith(moved, F.lit(media))
    return F.when(full == "", "").when(foreign, moved).otherwise(placed)


def is_missing_page(html: Column) -> Column:
    """A page that is served but says there is no product."""
    return F.coalesce(html.rlike(r"(?i)<title>\s*Product Not Found\s*</title>"), F.lit(False))


def sibling_urls(url: Column) -> Column:
    """The address, and for one that ends in .htm or .html those where a moved product may be, in order."""
    stem, tail = F.regexp_extract(url, r"(?is)^(.*?)(\.html?)(\?.*)?$", 1), F.regexp_extract(url, r"(?is)^(.*?)(\.html?)(\?.*)?$", 2)
    rest = F.regexp_extract(url, r"(?is)^(.*?)(\.html?)(\?.*)?$", 3)
    return F.when(tail != "", F.array(url, *(F.concat(stem, F.lit(s), tail, rest) for s in ("-1", "-2", "-3")))).otherwise(F.array(url))


def sitemap_urls(xml: Column) -> Column:
    """Product pages of a sitemap, in order, once each."""
    found = F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: F.endswith(u, F.lit(".html")) & ~F.contains(u, F.lit("/c/")) & ~F.contains(u, F.lit("/brands/"))))


def plain_text(html: Column) -> Column:
    """Markup away: breaks are spaces, ends of blocks are full stops."""
    steps = ((r"(?i)<br\s*/?>", " "), (r"(?i)</(p|li|div|h[1-6])>", ". "), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), (r"\s+", " "))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, html))


def amount(text: Column) -> Column:
    """The positive number at the start of a price, or 0."""
    lead = F.regexp_extract(F.regexp_replace(text, r"[₹$,\s]", ""), r"^\d+(?:\.\d+)?", 0).try_cast("double")
    return F.coalesce(lead, F.lit(0.0))


def first_of_range(text: Column) -> Column:
    return amount(F.split(F.regexp_replace(text, r"(?i)rs\.?|inr", ""), "-")[0])


def discount(price: Column, mrp: Column) -> Column:
    return F.when((mrp > price) & (price > 0), F.floor((mrp - price) / mrp * 100 + 0.5)).otherwise(0).cast("int")


def currency(declared: Column, text: Column) -> Column:
    """As declared, else as the text shows it, else INR."""
    shown = F.when(text.rlike("₹|\\bRs\\b|\\bINR\\b"), "INR").when(text.rlike("€|\\bEUR\\b"), "EUR").when(text.rlike("£|\\bGBP\\b"), "GBP").when(text.rlike("\\b(AED|CAD|AUD|SGD)\\b"), "FOREIGN")
    return F.coalesce(F.upper(F.nullif(declared, F.lit(""))), shown, F.lit("INR"))


def title_name(html: Column) -> Column:
    """The name by the open-graph title, the title up to a bar or dash, or the first heading."""
    og = F.regexp_extract(html, r"(?i)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)", 1)
    title = F.trim(F.split(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "[|–—]")[0])
    head = plain_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (og, title, head)))


VARIANT = T.StructType().add("name", T.StringType()).add("sku", T.StringType()).add("price", T.DoubleType()).add("in_stock", T.BooleanType())
PRODUCT = (
    T.StructType().add("name", T.StringType()).add("description", T.StringType()).add("sku", T.StringType()).add("brand", T.StringType()).add("price", T.DoubleType()).add("mrp", T.DoubleType())
    .add("currency", T.StringType()).add("in_stock", T.BooleanType()).add("image", T.StringType()).add("variants", T.ArrayType(VARIANT))
)


def _get(node, *keys):
    """The first filled value of the keys, whatever their case."""
    low = {k.lower(): v for k, v in node.items()} if isinstance(node, dict) else {}
    return next((low[k.lower()] for k in keys if low.get(k.lower()) not in (None, "")), None)


def _price(value) -> float:
    found = re.match(r"\d+(?:\.\d+)?", re.sub(r"[₹$,\s]", "", str(value if value is not None else "")))
    return float(found[0]) if found else 0.0


def _listed(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _offer(offers) -> tuple[float, float, str, bool | None]:
    for offer in _listed(offers):
        spec = next(iter(_listed(_get(offer, "priceSpecification"))), None)
        price = _price(_get(offer, "price", "lowPrice")) or _price(_get(spec, "price", "minPrice", "lowPrice"))
        if price > 0:
            stock = _get(offer, "availability")
            return price, max(price, _price(_get(offer, "highPrice"))), str(_get(offer, "priceCurrency") or "").upper(), None if stock is None else bool(re.search("/?InStock", str(stock), re.I))
    return 0.0, 0.0, "", None


def _image(value) -> str | None:
    for x in _listed(value):
        found = x if isinstance(x, str) else _image(_get(x, "url", "contentUrl", "@id")) if isinstance(x, dict) else None
        if found:
            return found
    return None


def _nodes(value):
    """Objects in the order of the document, graphs and lists opened."""
    stack = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += node[::-1]
        elif isinstance(node, dict):
            yield node
            stack += [node[k] for k in ("hasVariant", "@graph") if isinstance(node.get(k), (list, dict))]


def _loaded(text: str):
    """JSON, if need be without comments, trailing commas and control characters."""
    for repair in (lambda t: t, lambda t: re.sub(r",\s*([}\]])", r"\1", re.sub(r"[\x00-\x1f]", " ", re.sub(r"(?m)^\s*//.*$", "", re.sub(r"(?s)/\*.*?\*/", "", t))))):
        try:
            return json.loads(repair(text))
        except ValueError:
            continue
    return None


def _blocks(html: str | None):
    for block in re.findall(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>", html or ""):
        yield _loaded(block)


def _variants(node) -> list[dict]:
    kin = []
    for v in _listed(_get(node, "hasVariant")):
        p, m, _, s = _offer(_get(v, "offers"))
        if _get(v, "name") and p > 0:
            kin.append({"name": unescape(str(_get(v, "name"))), "sku": None if _get(v, "sku") is None else str(_get(v, "sku")), "price": p, "mrp": m, "in_stock": s})
    return kin


def structured_variants(html: str | None) -> list[dict]:
    """Variants of the first node of a page's JSON-LD that has any, whatever its type."""
    for block in _blocks(html):
        for node in _nodes(block):
            if kin := _variants(node):
                return kin
    return []


def described_product(html: str | None) -> dict | None:
    """The first named Product of a page's JSON-LD."""
    for block in _blocks(html):
        for node in _nodes(block):
            if any(str(k).rsplit("/", 1)[-1] == "Product" for k in _listed(node.get("@type"))) and _get(node, "name"):
                price, mrp, money, stock = _offer(_get(node, "offers"))
                label = _get(node, "brand")
                kin = [{k: v[k] for k in ("name", "sku", "price", "in_stock")} for v in _variants(node)]
                text = lambda k: None if _get(node, k) is None else unescape(str(_get(node, k)))  # noqa: B023, E731
                return {"name": text("name"), "description": text("description"), "sku": text("sku"), "brand": str(_get(label, "name") or "") if isinstance(label, dict) else label and str(label), "price": price, "mrp": mrp, "currency": money, "in_stock": stock, "image": _image(_get(node, "image")), "variants": kin}
    return None


@F.pandas_udf(PRODUCT)
def structured_product(html: pd.Series) -> pd.DataFrame:
    """The product that a page's JSON-LD describes; a row of nulls without one."""
    names = ["name", "description", "sku", "brand", "price", "mrp", "currency", "in_stock", "image", "variants"]
    return pd.DataFrame([described_product(h) or dict.fromkeys(names) for h in html], columns=names)
