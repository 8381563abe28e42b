"""A product's merchants by what web searches answered, each with one verified cell or a note."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import vocabulary as V
from ..functions.names import merchant_key
from ..functions.pages import canonical_url, is_product_page
from ..tables import checkpointed
from .merchants import best_verified, known_seller, merchant_list, ordered_links, remembered, unverified_note
from .pairs import select_variant, structured_match, triage

#: Pages of a merchant that are compared.
LOOKED_INTO = 4
#: Where each kind of answer has its list, and the fields that stand for merchant, link, title and price, the first filled one counting.
SHAPES = {
    "organic": ("organic_results", {"merchant": (), "url": ("link",), "title": ("title",), "price": ()}),
    "shopping": ("shopping_results", {"merchant": ("source",), "url": (), "title": ("title",), "price": ("extracted_price",)}),
    "stores": ("product_results.stores", {"merchant": ("name",), "url": ("link", "direct_link"), "title": (), "price": ("extracted_price",)}),
}


def merged_answers(spark: SparkSession, answers: DataFrame, by: list[str]) -> DataFrame:
    """One row for each entry of each answer, whatever its shape: ``by``, ``kind``, ``position``, ``merchant`` (an organic link's host), ``url``, ``title``, ``price``.

    ``answers`` has ``by``, ``kind`` (see :data:`SHAPES`; others are left out) and ``body``, JSON
    that is parsed once into a variant. Bodies that aren't JSON, lists that are missing or no
    lists, and entries that are no objects give nothing.
    """
    parsed = answers.withColumn("_v", F.try_parse_json("body"))
    out = None
    for kind, (place, fields) in SHAPES.items():
        own = parsed.where(F.col("kind") == kind).select(*by, "kind", F.try_variant_get("_v", f"$.{place}", "variant").alias("_list")).where("_list IS NOT NULL AND schema_of_variant(_list) LIKE 'ARRAY<%'")
        each = own.lateralJoin(spark.tvf.variant_explode(F.col("_list").outer())).where("schema_of_variant(value) LIKE 'OBJECT<%'")
        text = lambda keys: F.coalesce(*(F.nullif(F.trim(F.try_variant_get("value", f"$.{k}", "string")), F.lit("")) for k in keys), F.lit(None).cast("string"))
        price = F.coalesce(*(F.try_variant_get("value", f"$.{k}", "double") for k in fields["price"]), F.lit(None).cast("double"))
        rows = each.select(*by, "kind", F.col("pos").alias("position"), *(text(fields[f]).alias(f) for f in ("merchant", "url", "title")), price.alias("price"))
        out = rows if out is None else out.unionByName(rows)
    host = F.nullif(F.regexp_extract(F.lower("url"), r"^https?://(?:www\.)?([^/?#:]+)", 1), F.lit(""))
    return out.withColumn("merchant", F.coalesce("merchant", host))


def _cells(pairs: DataFrame) -> DataFrame:
    """Pairs with pages that could be read, compared: ``state`` rejected, possible or confirmed, ``score``, and the chosen child's name and price."""
    chosen = select_variant(pairs.withColumns({"s_id": F.struct("search_id", "key"), "c_id": F.col("c_url"), "variants": F.col("c_variants")}).drop("c_variants")).drop("s_id", "c_id", "variants")
    known = checkpointed(structured_match(chosen))
    tried = triage(known.select("s_name", "c_name").distinct()).select("s_name", "c_name", F.col("score").alias("_triage"))
    known = known.join(tried, ["s_name", "c_name"], "left")
    state = F.when(F.col("outcome") == "rejected", "rejected").when(F.col("outcome") == "confirmed", "confirmed").otherwise("possible")
    return known.withColumns({"state": state, "score": F.greatest(F.coalesce("_triage", F.lit(0.0)), F.coalesce("cosine", F.lit(0.0)))})


def merchant_cells(spark: SparkSession, searches: DataFrame, answers: DataFrame, pages: DataFrame, memory: DataFrame, base: DataFrame, domains: dict[str, str], own: str | None = None, limit: int = 10) -> DataFrame:
    """A row for each search and merchant: ``place``, ``merchant``, ``seller`` (of ``domains``), ``route``, ``url``, ``name``, ``price``, ``verdict``, ``score``, ``price_difference``, ``note``.

    ``searches`` has ``search_id`` (unique) and the rich record's fields, ``answers`` is as for
    :func:`merged_answers` (by ``search_id``), ``pages`` has ``url`` (unique, without query) and
    a record with variants, ``memory`` what people said (``search_id``, ``seller``, ``label``,
    ``url``), ``base`` the merchants that are always listed. Merchants come in the order of the
    shopping answers, up to ``limit``, without the shop ``own``. A merchant's pages are the
    remembered one, else the store's own link and the organic links of its host, those first
    whose address shares most words with the search. The best verified page gives the cell:
    a confirmed one, else the best possible one within the hard price band, at 0.70 or more.
    Without one there is no price, only a note why.
    """
    merged = checkpointed(merged_answers(spark, answers, ["search_id"]).withColumn("key", merchant_key(F.col("merchant"))).where("key <> ''"))
    shopping = merged.where("kind = 'shopping'")
    if own is not None:
        shopping = shopping.where(~F.coalesce(known_seller(F.col("merchant"), domains) == own, F.lit(False)))
    card = shopping.groupBy("search_id", "key").agg(F.min(F.struct("position", "title", "price")).alias("_card"))
    listed = merchant_list(shopping.select("search_id", "merchant", "position"), base, ["search_id"], limit).join(card, ["search_id", "key"], "left")
    listed = listed.withColumn("seller", F.coalesce(known_seller(F.col("merchant"), domains), "key"))
    listed = checkpointed(remembered(listed, memory, ["search_id", "seller"]).withColumnRenamed("url", "_known"))

    wanted = searches.select("search_id", F.col("name").alias("_asked"))
    links = merged.where(merged["kind"].isin("organic", "stores") & F.startswith("url", F.lit("http")) & is_product_page(F.col("url")))
    links = links.join(listed.where("route <> 'none' AND found").select("search_id", "key"), ["search_id", "key"], "left_semi").join(wanted, "search_id")
    # a store's own link goes before organic ones
    links = links.withColumns({"_own": F.col("kind") == "stores", "position": F.col("position") + F.when(F.col("kind") == "stores", 0).otherwise(1_000_000)})
    tried = ordered_links(links, ["search_id", "key", "_own"], "_asked").select("search_id", "key", "url", (F.col("place") + F.when(F.col("_own"), 0).otherwise(1_000_000)).alias("place"))
    known = listed.where("route = 'reuse'").select("search_id", "key", F.col("_known").alias("url"), F.lit(0).alias("place"))
    tried = tried.unionByName(known).groupBy("search_id", "key", canonical_url(F.col("url")).alias("url")).agg(F.min("place").alias("place"))
    tried = tried.withColumn("position", F.row_number().over(Window.partitionBy("search_id", "key").orderBy("place", "url"))).where(F.col("position") <= LOOKED_INTO)

    record = ("name", "description", "packaging", "price", "unit_price", "pack_size", "spec")
    asked = searches.select("search_id", *(F.col(c).alias(f"s_{c}") for c in record))
    offered = pages.select("url", *(F.col(c).alias(f"c_{c}") for c in (*record, "variants")))
    read = tried.join(offered, "url").join(asked, "search_id").withColumnRenamed("url", "c_url")
    done = checkpointed(_cells(read).select("search_id", "key", "position", F.col("state").alias("verdict"), "score", F.col("c_url").alias("url"), F.col("c_name").alias("name"), F.col("c_price").alias("price"), "pack_note"))
    best = best_verified(done.where("verdict <> 'rejected'"), ["search_id", "key"])
    seen = done.groupBy("search_id", "key").agg(F.count("*").alias("_read"))

    both = listed.join(best, ["search_id", "key"], "left").join(seen, ["search_id", "key"], "left").join(searches.select("search_id", F.col("price").alias("_own"), F.col("name").alias("s_name")), "search_id")
    # a card's own title may already tell another product
    titles = checkpointed(both.where("verdict IS NULL AND _read IS NULL AND found AND _card.title IS NOT NULL").select("s_name", F.col("_card.title").alias("c_name")).distinct())
    told = triage(titles, with_text=False).select("s_name", F.col("c_name").alias("_title"), F.col("gate").isNotNull().alias("_other"))
    both = both.withColumn("_title", F.col("_card.title")).join(told, ["s_name", "_title"], "left")
    far = (F.col("verdict") == "possible") & (F.col("_own") > 0) & (F.col("price") > 0) & (F.greatest("_own", "price") > V.HARD_BAND * F.least("_own", "price"))
    kept = F.col("verdict").isNotNull() & ~F.coalesce(far, F.lit(False))
    note = (
        F.when(kept, F.col("pack_note")).when(F.col("route") == "none", "confirmed: not sold here").when(~F.col("found") & (F.col("route") != "reuse"), "not listed").when(F.coalesce(far, F.lit(False)), "different product by its price")
        .when(F.col("_read") > 0, "different product on this site").otherwise(unverified_note(F.col("_own"), F.col("_card.price"), F.coalesce("_other", F.lit(False))))
    )
    shown = lambda c: F.when(kept, F.col(c))
    difference = F.floor((F.col("_own") - shown("price")) * 100 + 0.5) / 100
    out = both.select("search_id", "place", "merchant", "seller", "route", *(shown(c).alias(c) for c in ("url", "name", "price", "verdict")), F.when(kept, F.greatest("score", F.lit(V.SHOWN_SCORE))).alias("score"), F.when(F.col("_own") > 0, difference).alias("price_difference"), note.alias("note"))
    return out
