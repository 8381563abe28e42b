"""Elements of a page by their place: a tag-stack reader, and what page records ask of it.

One pass over the markup keeps the stack of open elements; each element knows its attributes,
the one it stands in, and the text below it. Names of classes and attributes that shops use
stand together here as fixed values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without content, which are never on the stack.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same kind ends.
CLOSED_BY_KIND = frozenset(("li", "tr", "td", "th", "option", "p"))

# Where pages state a price, its currency, a picture or a description.
PRICE_METAS = (("property", "product:price:amount"), ("property", "og:price:amount"), ("itemprop", "price"))
CURRENCY_METAS = (("property", "product:price:currency"), ("property", "og:price:currency"))
DESCRIPTION_METAS = (("property", "og:description"), ("name", "description"))
# Blocks of a marketplace's product card, in the order in which they are asked for a price.
CARD_TITLE = "productTitle"
CARD_PRICES = (("corePrice_feature_div", "a-price", "a-offscreen"), ("corePriceDisplay_desktop_feature_div", "a-price", "a-offscreen"), ("corePrice_feature_div", None, "a-offscreen"), ("price_inside_buybox", None, None), ("priceblock_ourprice", None, None), ("priceblock_dealprice", None, None), (None, "a-price", "a-offscreen"))
CARD_LIST_PRICES = (("corePrice_feature_div", "a-text-price", "a-offscreen"), (None, "basisPrice", "a-offscreen"))
CARD_IMAGES = ("landingImage", "imgBlkFront")
CARD_POINTS = "feature-bullets"


class Element:
    __slots__ = ("tag", "attrs", "parent", "pieces")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.pieces = tag, attrs, parent, []

    def within(self) -> Iterator[Element]:
        """The elements that it stands in, from the nearest on."""
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    @property
    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(self.pieces)).strip()


class Page(HTMLParser):
    """The elements of a page in the order in which they open."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self._stack: list[Element] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY_KIND and self._stack and self._stack[-1].tag == tag:
            self._stack.pop()
        own = Element(tag, {k: v or "" for k, v in attrs}, self._stack[-1] if self._stack else None)
        self.elements.append(own)
        if tag == "br":
            self.handle_data(" ")
        if tag not in VOID:
            self._stack.append(own)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self._stack) - 1, -1, -1):
            if self._stack[depth].tag == tag:
                del self._stack[depth:]
                break

    def handle_data(self, data):
        for own in self._stack:
            own.pieces.append(data)

    def unknown_decl(self, data):
        pass

    def all(self, tag: str | None = None, id: str | None = None, cls: str | None = None, attr: tuple[str, str | None] | None = None, inside: tuple = ()) -> Iterator[Element]:
        """Elements by tag, id, class and attribute (any value: None) that stand in elements as ``inside`` says: ids begin with ``#``, classes with a point."""
        for own in self.elements:
            if (tag and own.tag != tag) or (id and own.attrs.get("id") != id) or (cls and not own.has_class(cls)):
                continue
            if attr and (attr[0] not in own.attrs or (attr[1] is not None and own.attrs[attr[0]] != attr[1])):
                continue
            if all(any(up.attrs.get("id") == w[1:] if w[0] == "#" else up.has_class(w[1:]) for up in own.within()) for w in inside):
                yield own

    def first(self, **what) -> Element | None:
        return next(self.all(**what), None)

    def meta(self, key: str, value: str) -> str:
        own = self.first(tag="meta", attr=(key, value))
        return own.attrs.get("content", "").strip() if own else ""


def number(text: str | None) -> float:
    """The positive number at the start of a price, or 0."""
    found = re.match(r"\d+(?:\.\d+)?", re.sub(r"[₹$,\s]", "", text or ""))
    return float(found[0]) if found else 0.0


def loose_number(text: str | None) -> float:
    """The digits and points of a price in words, or 0."""
    found = re.match(r"\d*\.?\d+", re.sub(r"[^0-9.]", "", text or ""))
    return float(found[0]) if found else 0.0


def number_within(text: str | None) -> float:
    """The first number of a price in words, to two places, or 0."""
    found = re.search(r"\d+(?:\.\d{1,2})?", re.sub(r"(?i)[₹$,\s]|rs\.?", "", text or ""))
    return float(found[0]) if found else 0.0


def stated_price(page: Page) -> float:
    """By the price metas, else by microdata; never from running text."""
    for key, value in PRICE_METAS:
        if price := number(page.meta(key, value)):
            return price
    own = page.first(attr=("itemprop", "price"))
    return number(own.attrs.get("content") or own.text) if own else 0.0


def stated_currency(page: Page) -> str:
    for key, value in CURRENCY_METAS:
        if code := page.meta(key, value):
            return code.upper()
    own = page.first(attr=("itemprop", "priceCurrency"))
    return own.attrs.get("content", "").upper() if own else ""


def card(html: str | None) -> dict | None:
    """The product of a marketplace's card: a title and a positive price in rupees, or nothing; a price that only another currency's sign marks doesn't count."""
    page = Page(html)
    title = page.first(id=CARD_TITLE)

    def spot(place) -> str:
        inside, block, leaf = place
        if not block and not leaf:
            own = page.first(id=inside)
        else:
            own = page.first(cls=leaf, inside=tuple(x for x in (inside and f"#{inside}", block and f".{block}") if x))
        return own.text if own else ""

    said = next((t for t in map(spot, CARD_PRICES) if t), "")
    price = loose_number(said)
    if title is None or not title.text or not price or (re.search("[$€£]", said) and not re.search(r"₹|\bRs\.?\b|\bINR\b", said, re.I)):
        return None
    image = ""
    for name in CARD_IMAGES:
        own = page.first(id=name)
        if own and own.attrs.get("data-a-dynamic-image") and not image:
            try:
                image = next(iter(json.loads(own.attrs["data-a-dynamic-image"])), "")
            except (ValueError, TypeError):
                pass
    if not image and (own := page.first(id=CARD_IMAGES[0])):
        image = own.attrs.get("src", "")
    full = loose_number(next((t for t in map(spot, CARD_LIST_PRICES) if t), ""))
    points = ". ".join(t for t in (x.text for x in page.all(tag="li", inside=(f"#{CARD_POINTS}",))) if t)[:500]
    return {"name": title.text, "description": points, "sku": None, "brand": None, "price": price, "mrp": max(full, price), "currency": "INR", "in_stock": True, "image": image}
