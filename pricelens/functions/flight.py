"""A page's streamed component payload as a graph of references, and the child products in it.

The payload comes in chunks that make one text of ``id:value`` rows; a value names other rows
by ``$id``. References are followed as deep as they go: to rows that are references
themselves, lists of them, and objects whose fields are; a row that leads back to itself has
no value, nor has one that isn't there.
"""

from __future__ import annotations

import json
import re
from typing import Any

from . import vocabulary as V

_CHUNK = re.compile(r'self\.__next_f\.push\(\[1,"((?:[^"\\]|\\.)*)"\]\)')
_ROW = re.compile(r"(?:^|\n)([0-9a-f]+):")
_REF = re.compile(r"\$([0-9a-f]+)\Z")


class Graph:
    """The rows of a payload by id; of equal ids the last."""

    def __init__(self, html: str | None):
        text = ""
        for chunk in _CHUNK.findall(html or ""):
            try:
                text += json.loads(f'"{chunk}"', strict=False)
            except ValueError:
                continue  # a broken chunk takes nothing else with it
        marks = list(_ROW.finditer(text))
        self.rows: dict[str, Any] = {}
        for mark, end in zip(marks, [*(m.start() for m in marks[1:]), len(text)], strict=False):
            try:
                self.rows[mark[1]] = json.loads(text[mark.end() : end], strict=False)
            except ValueError:
                self.rows.pop(mark[1], None)

    def resolve(self, value: Any, seen: frozenset[str] = frozenset()) -> Any:
        """What a value is once references to whole rows are followed; None where they end nowhere or in a circle."""
        while isinstance(value, str) and (ref := _REF.match(value)):
            if ref[1] in seen or ref[1] not in self.rows:
                return None
            seen |= {ref[1]}
            value = self.rows[ref[1]]
        return value

    def objects(self):
        """Every object that stands in a row itself, rows in their order, outer ones first."""
        for row in self.rows.values():
            stack = [row]
            while stack:
                node = stack.pop()
                if isinstance(node, dict):
                    yield node
                    stack += list(node.values())[::-1]
                elif isinstance(node, list):
                    stack += node[::-1]

    def listed(self, value: Any) -> list:
        """The resolved elements of a resolved list."""
        found = self.resolve(value)
        return [self.resolve(x) for x in found] if isinstance(found, list) else []


def _amount(value: Any) -> float:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else 0.0


def _child(graph: Graph, node: Any) -> dict | None:
    if not isinstance(node, dict) or not isinstance(node.get("name"), str) or not node["name"]:
        return None
    pricing = graph.resolve(node.get("pricing"))
    pricing = pricing if isinstance(pricing, dict) else {}
    full = _amount(graph.resolve(pricing.get("price")))
    price = _amount(graph.resolve(pricing.get("selling_price"))) or full
    if price <= 0:
        return None
    media = next((m for m in graph.listed(node.get("media")) if isinstance(m, dict)), {})
    stock, sku, file = (graph.resolve(x) for x in (node.get("is_in_stock"), node.get("sku"), media.get("file")))
    return {"name": node["name"], "sku": sku if isinstance(sku, str) else "", "price": price, "mrp": full or price, "in_stock": stock is not False, "image": file if isinstance(file, str) else ""}


def core_words(name: str) -> set[str]:
    """Words of two characters or more, hyphens inside, that are no filling words."""
    return {w for w in re.split("[^a-z0-9-]+", name.lower()) if len(w) > 1} - set(V.CORE_STOP)


def children(html: str | None, name: str | None) -> list[dict]:
    """The child products of the page about ``name``, in order, one for each SKU (or name): those that the product of that name lists, else the first list, else products that share the brand and another word of the name."""
    graph, name = Graph(html), name or ""
    lists = [(node, found) for node in graph.objects() if "child_products" in node and (found := [x for x in graph.listed(node["child_products"]) if x is not None])]
    own = [found for node, found in lists if str(node.get("name", "")).lower() == name.lower()]
    if lists:
        made = [_child(graph, x) for x in (own or [lists[0][1]])[0]]
    else:
        brand = next(iter(re.findall("[a-z0-9]+", name.lower())), "")
        wanted = {w for w in core_words(name) if re.fullmatch("[a-z]{3,}", w) and w != brand}
        made = []
        for node in graph.objects():
            kin = _child(graph, node) if "sku" in node and _REF.match(str(node.get("pricing"))) else None
            if kin and kin["name"].lower() != name.lower():
                has = core_words(kin["name"])
                made.append(kin if (not brand or brand in has) and (not wanted or wanted & has) else None)
    once: dict[str, dict] = {}
    for kin in made:
        if kin:
            once.setdefault(kin["sku"] or kin["name"], kin)
    return list(once.values())
