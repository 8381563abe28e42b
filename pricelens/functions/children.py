"""The children of a product page, one row each: a table function over a page's own formats.

The formats are tried in a fixed order, and the first with two children or more wins: the
attribute of a variations form, a product document in JSON, the options of a configurable
product, structured data with variants. A table of variants and a streamed payload belong to
shops of their own and are asked for by name. What depends on a child's name only (pieces,
unit price, composition) is added by Column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

from . import flight, pages
from .attributes import pack_size, unit_price
from .markup import Page, number_within
from .specs import parse_spec

CHILD = "format string, position int, name string, content string, sku string, price double, mrp double, in_stock boolean, image string"
#: Formats in the order in which they are tried.
ORDER = ("form", "document", "options", "structured")


def _number(value: Any) -> float:
    try:
        return max(0.0, float(value))
    except (TypeError, ValueError):
        return 0.0


def _kin(name: str, price: float, mrp: float, sku: Any = "", **more) -> dict:
    return {"name": name, "sku": str(sku or ""), "price": price, "mrp": mrp} | more


def _loaded(text: str | None) -> Any:
    try:
        return json.loads(text or "", strict=False)
    except ValueError:
        return None


def from_form(html: str) -> Iterator[dict]:
    """Variations in an attribute of the form: named by their filled options."""
    if "data-product_variations" not in html:
        return
    own = Page(html).first(attr=("data-product_variations", None))
    found = _loaded(own.attrs["data-product_variations"]) if own else None
    for v in found if isinstance(found, list) else []:
        options = v.get("attributes") if isinstance(v, dict) else None
        name = " ".join(str(x) for x in options.values() if x).strip() if isinstance(options, dict) else ""
        price = _number(v.get("display_price")) if isinstance(v, dict) else 0.0
        if name and price:
            yield _kin(name, price, _number(v.get("display_regular_price")) or price, v.get("sku"))


def from_document(text: str) -> Iterator[dict]:
    """A page that is a JSON document of a product with two variants or more; an old price counts if it is higher."""
    data = _loaded(text) if text.lstrip()[:1] == "{" else None
    product = data.get("product") or data if isinstance(data, dict) else {}
    found = product.get("variants") if isinstance(product, dict) else None
    for v in found if isinstance(found, list) and len(found) > 1 else []:
        name, price = (str(v.get("title") or "").strip(), _number(v.get("price"))) if isinstance(v, dict) else ("", 0.0)
        if name and price:
            yield _kin(name, price, max(price, _number(v.get("compare_at_price"))), v.get("sku"))


def _braced(text: str, begin: int) -> str:
    """The object that starts at ``begin``, to the brace that ends it; strings may hold braces."""
    try:
        _, end = json.JSONDecoder(strict=False).raw_decode(text, begin)
    except ValueError:
        return ""
    return text[begin:end]


def from_options(html: str) -> Iterator[dict]:
    """Options of a configurable product, each with the price of its first product; of equal labels the first."""
    at = html.find('"jsonConfig"')
    begin = html.find("{", at) if at >= 0 else -1
    own = _loaded(_braced(html, begin)) if begin >= 0 else None
    if not isinstance(own, dict):
        return
    prices, groups, seen = own.get("optionPrices"), own.get("attributes"), set()
    for group in groups.values() if isinstance(groups, dict) else []:
        for option in (group.get("options") or []) if isinstance(group, dict) else []:
            label = str(option.get("label") or "").strip() if isinstance(option, dict) else ""
            products = option.get("products") if label else None
            cost = prices.get(str(products[0])) if isinstance(products, list) and products and isinstance(prices, dict) else None
            amount = lambda k: _number((cost.get(k) or {}).get("amount")) if isinstance(cost, dict) and isinstance(cost.get(k) or {}, dict) else 0.0  # noqa: B023, E731
            if label and amount("finalPrice") and label.lower() not in seen:
                seen.add(label.lower())
                yield _kin(label, amount("finalPrice"), amount("oldPrice") or amount("finalPrice"))


def from_structured(html: str) -> Iterator[dict]:
    """Variants of structured data; of the first node that has any."""
    for v in pages.structured_variants(html):
        yield _kin(v["name"], v["price"], max(v["price"], v["mrp"]), v["sku"], in_stock=v["in_stock"])


def from_table(html: str) -> Iterator[dict]:
    """Rows of a table of variants: the name's cell, what the package holds, the special price before any other; of equal names the first."""
    page, seen = Page(html), set()
    for cell in page.all(tag="td", attr=("data-th", "Variant Name")):
        row = next((up for up in cell.within() if up.tag in ("tr", "tbody")), None)
        inside = lambda own, top: any(up is top for up in own.within())
        text = lambda found: next((x.text for x in found if x.text), "")
        name = text(x for x in page.all(cls="product-item-name") if inside(x, cell)) or cell.text
        if not name or name in seen or row is None:
            continue
        content = text(x for x in page.all(cls="product-item-name") if inside(x, row) and any(up.attrs.get("data-th") == "Package Content" for up in x.within()))
        cost = lambda *cls: number_within(text(x for x in page.all(cls="price", inside=cls) if inside(x, row)))  # noqa: B023, E731
        price = cost(".special-price") or cost()
        if price:
            seen.add(name)
            yield _kin(name, price, cost(".old-price") or price, content=content)


def rendered_price(html: str) -> float:
    """The price that a page of that kind shows, which wins over its structured data; 0 without one."""
    page = Page(html)
    own = page.first(attr=("data-price-amount", None), inside=(".product-info-price",))
    bulk = page.first(attr=("data-final-price", None))
    return _number(own.attrs["data-price-amount"] if own else 0) or _number(bulk.attrs["data-final-price"] if bulk else 0)


READERS = {"form": from_form, "document": from_document, "options": from_options, "structured": from_structured, "table": from_table}


@udtf(returnType=CHILD, useArrow=False)
class ChildRows:
    """``format``, place and fields of each child of a page. ``wanted``: a format's name, ``payload`` (with the product's name), or null for the first in order that has two or more."""

    def eval(self, html: str, wanted: str, name: str):
        if wanted == "payload":
            found = flight.children(html, name)
        elif wanted is not None:
            found = list(READERS[wanted](html or ""))
        else:
            for wanted in ORDER:
                if len(found := list(READERS[wanted](html or ""))) > 1:
                    break
            else:
                return
        for position, v in enumerate(found):
            yield wanted, position, v["name"], v.get("content", ""), v["sku"], v["price"], v["mrp"], v.get("in_stock"), v.get("image", "")


def with_children(listed: DataFrame, html: str = "html", name: str | None = None, wanted: str | None = None) -> DataFrame:
    """A row for each child of each page: the columns of ``listed`` without ``html``, the child's as in :data:`CHILD`, and its pieces, unit price and composition.

    Pages without children, empty and null ones, have no row. Columns of ``listed`` with a
    child's names are replaced, but for ``name``, the column that names the page's product,
    which comes back as ``parent`` (null without one).
    """
    names = [x.split()[0] for x in CHILD.split(", ")] + ["pack_size", "unit_price", "spec"]
    parent = F.col(name) if name else F.lit(None).cast("string")
    base = listed.withColumn("parent", parent).drop(*(c for c in names if c != html))
    rows = base.lateralJoin(ChildRows(F.col(html).outer(), F.lit(wanted).cast("string"), F.col("parent").outer()))
    pieces = pack_size(F.col("name"))
    stated = F.trim(F.concat_ws(" ", "name", "content"))
    return rows.drop(html).withColumns({"pack_size": pieces, "unit_price": unit_price(F.col("price"), pieces), "spec": parse_spec(stated)})


def headline_price(rendered: Column, structured: Column, prices: Column) -> Column:
    """The price of a grouped page: as shown, else by structured data, else its cheapest child's."""
    known = lambda c: F.when(c > 0, c)
    return F.coalesce(known(rendered), known(structured), F.array_min(F.filter(prices, lambda p: p > 0)))
