"""What shops' search answers say of a product: one record whatever the shop's shape, by Column expressions over variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .attributes import pack_size, unit_price
from .names import let
from .specs import parse_spec, sized

#: Hits of an answer that count.
HITS = 10
# Where each kind of answer has its list of products.
PLACES = {"catalogue": "$.hits.products", "store": "$", "next": "$.props.pageProps.results"}
# Codes and signs of the home currency in a store's answer.
HOME_CODES, HOME_SIGNS = ("INR",), ("₹", "Rs", "Rs.")


def _text(v: Column, *paths: str) -> Column:
    """The first filled text of the paths, or an empty one."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths), F.lit(""))


def _number(v: Column, *paths: str) -> Column:
    """The first number of the paths that isn't 0, or 0."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, p, "double"), F.lit(0.0)) for p in paths), F.lit(0.0))


def _rounded(c: Column) -> Column:
    return F.floor(c + 0.5)


def off(mrp: Column, price: Column, stated: Column | None = None, either: bool = False) -> Column:
    """Per cent off: as stated, else by the prices (``either`` way if they differ), else 0."""
    lower = (mrp != price) if either else (mrp > price)
    own = F.when((mrp > 0) & (price > 0) & lower, _rounded((mrp - price) / mrp * 100)).otherwise(0)
    return (own if stated is None else F.when(stated != 0, _rounded(stated)).otherwise(own)).cast("int")


def decoded(text: Column) -> Column:
    """Decimal character references and the four named ones."""
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 4, "0")), "UTF-16BE")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,5});"), F.lit(1)))
    numbers = F.aggregate(F.filter(found, lambda n: n.cast("int") < 65536), text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), letter(n)))
    for name, sign in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        numbers = F.replace(numbers, F.lit(f"&{name};"), F.lit(sign))
    return numbers


def true_spec(children: Column, name: Column, packaging: Column, description: Column) -> Column:
    """The composition by the first child that isn't of the Extra line (``children``: names in one string, parted by commas behind parentheses), where that states a size; else by the other texts."""
    parts = F.split(F.trim(children), r"\)\s*,\s*")
    whole = F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(F.trim(p), F.lit(")"))).otherwise(F.trim(p)))
    main = F.coalesce(F.get(F.filter(whole, lambda p: ~F.lower(p).rlike(r"\bextra\b")), F.lit(0)), F.get(whole, F.lit(0)))
    of_child = parse_spec(F.when(F.trim(children) != "", main))
    return let(F.struct(of_child.alias("own"), parse_spec(F.concat_ws(" ", name, packaging, description)).alias("all")), lambda s: F.when((F.trim(children) != "") & sized(s["own"]), s["own"]).otherwise(s["all"]))


def catalogue_hit(v: Column) -> dict[str, Column]:
    """A hit of the own catalogue's search."""
    name, price = F.trim(_text(v, "$.name")), _number(v, "$.price.INR.default", "$.prices.minimalPrice.amount.value")
    mrp = F.coalesce(F.nullif(_number(v, "$.price.INR.default_original_formated", "$.prices.regularPrice.amount.value"), F.lit(0.0)), price)
    listed = F.array_join(F.filter(F.try_variant_get(v, "$.packaging_contents", "array<string>"), lambda x: x != ""), ", ")
    packaging = F.coalesce(F.nullif(listed, F.lit("")), F.when(F.try_variant_get(v, "$.packaging_contents", "array<string>").isNull(), F.nullif(_text(v, "$.packaging_contents"), F.lit(""))), _text(v, "$.manufacturer"))
    key = _text(v, "$.url_key")
    return {
        "name": name, "url": F.coalesce(F.nullif(_text(v, "$.url"), F.lit("")), key), "image": _text(v, "$.image_url", "$.thumbnail_url"), "price": price, "mrp": mrp, "discount": off(mrp, price, _number(v, "$.discount_percentage"), either=True), "packaging": packaging,
        "in_stock": F.coalesce(F.try_variant_get(v, "$.in_stock", "int") == 1, F.lit(False)), "description": _text(v, "$.short_description"), "sku": F.nullif(_text(v, "$.sku"), F.lit("")),
        "spec": true_spec(_text(v, "$.child_names"), name, packaging, _text(v, "$.full_description", "$.short_description")), "home": F.lit(True),
    }


def store_hit(v: Column, minor: Column) -> dict[str, Column]:
    """A hit of a store whose prices are whole minor units; ``minor`` is how many digits these are."""
    whole = lambda *paths: F.coalesce(F.nullif(F.regexp_extract(_text(v, *paths), r"^\s*(\d+)", 1), F.lit("")).cast("double"), F.lit(0.0))
    by = F.when(minor > 0, F.pow(F.lit(10.0), minor)).otherwise(1.0)
    price = _rounded(whole("$.prices.sale_price", "$.prices.price") / by).cast("double")
    full = _rounded(whole("$.prices.regular_price") / by).cast("double")
    mrp = F.coalesce(F.nullif(full, F.lit(0.0)), price)
    home = F.upper(_text(v, "$.prices.currency_code")).isin(*HOME_CODES) | _text(v, "$.prices.currency_symbol").isin(*HOME_SIGNS)
    name = decoded(F.trim(_text(v, "$.name")))
    stock = F.coalesce(F.try_variant_get(v, "$.is_in_stock", "boolean"), F.lit(True)) & (_text(v, "$.stock_status") != "outofstock")
    return {"name": name, "url": _text(v, "$.permalink"), "image": _text(v, "$.images[0].src", "$.images[0].thumbnail"), "price": price, "mrp": mrp, "discount": off(mrp, price), "packaging": F.lit(""), "in_stock": stock, "description": F.lit(""), "sku": F.lit(None).cast("string"), "spec": parse_spec(name), "home": home & (price > 0)}


def next_hit(v: Column) -> dict[str, Column]:
    """A hit in the data of a page's own script."""
    name, price = F.trim(_text(v, "$.title")), _number(v, "$.special_price_final", "$.regular_price_final")
    mrp = F.coalesce(F.nullif(_number(v, "$.mrp_final", "$.regular_price_final"), F.lit(0.0)), price)
    slug = _text(v, "$.slug")
    told = _text(v, "$.generic_name.name", "$.generic_name")
    told = F.when(F.startswith(told, F.lit("{")), "").otherwise(told)
    return {"name": name, "url": slug, "image": _text(v, "$.image"), "price": price, "mrp": mrp, "discount": off(mrp, price, _number(v, "$.discount_percentage")), "packaging": _text(v, "$.brand.name"), "in_stock": F.coalesce(F.size(F.try_variant_get(v, "$.in_stock_skus", "array<string>")) > 0, F.lit(False)), "description": told, "sku": F.lit(None).cast("string"), "spec": parse_spec(name), "home": F.lit(True)}


def shop_hits(spark: SparkSession, answers: DataFrame, kind: str, base: str = "") -> DataFrame:
    """A row for each hit of each answer, the first :data:`HITS` of its list: the columns of ``answers`` without ``body``, ``position`` and the record's fields.

    ``kind``: ``catalogue``, ``store`` or ``next`` (a page with its data in a script). Hits
    without a name are left out, and of stores those in another currency or without a price;
    the digits of a store's minor unit are its first product's. Bodies that can't be parsed,
    null and empty ones, give nothing. ``base`` goes before links that have no host.
    """
    body = F.regexp_extract("body", r'(?is)<script[^>]+id="?__NEXT_DATA__"?[^>]*>(.*?)</script>', 1) if kind == "next" else F.col("body")
    own = answers.withColumn("_list", F.try_variant_get(F.try_parse_json(body), PLACES[kind], "variant")).drop("body").where("_list IS NOT NULL AND schema_of_variant(_list) LIKE 'ARRAY<%'")
    own = own.withColumn("_minor", F.coalesce(F.try_variant_get("_list", "$[0].prices.currency_minor_unit", "int"), F.lit(0)))
    each = own.lateralJoin(spark.tvf.variant_explode(F.col("_list").outer())).where(F.col("pos") < HITS)
    v = F.col("value")
    fields = catalogue_hit(v) if kind == "catalogue" else store_hit(v, F.col("_minor")) if kind == "store" else next_hit(v)
    fields["url"] = F.when((fields["url"] == "") | fields["url"].rlike("(?i)^https?://"), fields["url"]).otherwise(F.concat(F.lit(base), fields["url"]))
    kept = [c for c in answers.columns if c != "body" and c not in fields and c != "position"]
    out = each.select(*kept, F.col("pos").alias("position"), *(c.alias(f) for f, c in fields.items())).where("home AND name <> ''").drop("home")
    pieces = pack_size(F.col("name"), F.col("description"), F.col("url"))
    return out.withColumn("pack_size", pieces).withColumn("unit_price", unit_price(F.col("price"), F.col("pack_size")))
