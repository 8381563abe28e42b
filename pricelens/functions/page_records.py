"""One record a product page: structured data first, then metas and microdata, then title and heading."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import pages, vocabulary as V
from .attributes import pack_size, unit_price
from .markup import CARD_TITLE, DESCRIPTION_METAS, Page, card, stated_currency, stated_price
from .specs import parse_spec

READ = T.StructType([T.StructField(f, T.DoubleType() if f in ("price", "meta_price", "mrp") else T.BooleanType() if f == "in_stock" else T.ArrayType(T.StringType()) if f == "titles" else T.StringType()) for f in "layout name titles description meta_description sku brand price meta_price mrp currency in_stock image".split()])


def _read(html: str | None, cards: bool) -> dict:
    blank = dict.fromkeys(READ.fieldNames()) | {"titles": [], "price": 0.0, "meta_price": 0.0, "mrp": 0.0}
    if not html:
        return blank
    if cards:
        found = card(html) if CARD_TITLE in html else None
        return blank | {"layout": "card"} | (found or {})
    own = pages.described_product(html)
    page = Page(html)
    text = lambda tag: next((t for t in (x.text for x in page.all(tag=tag)) if t), "")
    titles = [page.meta("property", "og:title"), re.split("[|–—]", text("title"))[0].strip(), text("h1")]
    told = next((t for t in (page.meta(*m) for m in DESCRIPTION_METAS) if t), "")
    merged = blank | {"layout": "structured" if own else "markup"} | {k: v for k, v in (own or {}).items() if k in blank}
    return merged | {"titles": titles, "meta_description": told, "meta_price": stated_price(page), "currency": merged["currency"] or stated_currency(page), "image": merged["image"] or page.meta("property", "og:image")}


@F.pandas_udf(READ)
def read_page(html: pd.Series, cards: pd.Series) -> pd.DataFrame:
    """What a page states by each of its means; ``cards`` marks pages of marketplaces, which only have their product card."""
    return pd.DataFrame([_read(h, bool(c)) for h, c in zip(html, cards, strict=True)], columns=READ.fieldNames())


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def is_foreign(currency: Column) -> Column:
    """A currency is stated, and it isn't the rupee; its prices don't compare."""
    return F.coalesce((currency != "") & ~currency.rlike(V.HOME_CURRENCY), F.lit(False))


def page_records(listed: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The columns of ``listed`` without ``html``, with ``record``: a struct of name, description, sku, brand, price, mrp, discount, currency, in_stock, image, host, pack_size, unit_price, spec and ``status``.

    ``status`` says whether the price counts: ``priced``, ``unpriced`` (no structured price;
    running text is never asked for one), ``foreign`` (another currency) or ``nameless``,
    where the other fields are null. Pages served with "not found" in their title are
    ``missing``. Null and empty pages are nameless. Each page is read once.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z]+://([^/?#:]*)", 1)), r"^www\.", "")
    read = listed.withColumn("_host", host).withColumn("_p", read_page(F.col(html), F.col("_host").rlike(V.CARD_HOSTS)))
    p = F.col("_p")
    name = _filled(pages.plain_text(p["name"]), F.get(F.filter(p["titles"], lambda t: t != ""), F.lit(0)))
    price = F.coalesce(*(F.nullif(p[c], F.lit(0.0)) for c in ("price", "meta_price")), F.lit(0.0))
    read = read.withColumns({"_name": name, "_price": price, "_told": F.coalesce(_filled(pages.plain_text(p["description"]), p["meta_description"]), F.lit("")), "_money": pages.currency(p["currency"], F.col(html)), "_missing": pages.is_missing_page(F.col(html))})
    mrp = F.coalesce(F.nullif(p["mrp"], F.lit(0.0)), F.col("_price"))
    pieces = pack_size(F.col("_name"), F.col("_told"), F.col(url))
    status = F.when(F.col("_missing"), "missing").when(F.col("_name").isNull(), "nameless").when(is_foreign(F.col("_money")), "foreign").when(F.col("_price") > 0, "priced").otherwise("unpriced")
    fields = {
        "name": F.col("_name"), "description": F.col("_told"), "sku": p["sku"], "brand": p["brand"], "price": F.col("_price"), "mrp": mrp, "discount": pages.discount(F.col("_price"), mrp), "currency": F.col("_money"),
        "in_stock": F.coalesce(p["in_stock"], F.lit(True)), "image": p["image"], "host": F.col("_host"), "pack_size": pieces, "unit_price": unit_price(F.col("_price"), pieces), "spec": parse_spec(F.concat_ws(" ", "_name", F.substring("_told", 1, 300))),
    }
    there = F.col("_name").isNotNull() & ~F.col("_missing")
    record = F.struct(status.alias("status"), *(F.when(there, c).alias(k) for k, c in fields.items()))
    return read.withColumn("record", record).drop("_host", "_p", "_name", "_price", "_told", "_money", "_missing", html)
