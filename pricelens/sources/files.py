"""Reading uploaded name lists and catalogues, and writing results, through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import normalize
from ..functions.pages import name_from_slug, sitemap_urls
from ..functions.similarity import embed

# Headers that mark a column, the first that is there counts.
NAME_HEADERS = ("product name", "name", "product", "title")
SKU_HEADERS = ("sku", "code", "item code", "product code")
BRAND_HEADERS = ("brand", "manufacturer")


def _pick(columns: list[str], headers: tuple[str, ...]) -> str | None:
    found = [c for c in columns if c.strip().lstrip("﻿").lower() in headers]
    return found[0] if found else None


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Product names (``name``) of a CSV file: the column whose header says so, or the only column, whose first row then counts too. Blank names are left out."""
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    column = _pick(table.columns, NAME_HEADERS)
    if column is None:
        table = spark.read.csv(path, header=False, multiLine=True, escape='"')
        if len(table.columns) > 1:
            raise ValueError("no column of names")
        column = table.columns[0]
    name = F.trim(F.regexp_replace(F.col(f"`{column}`"), "^﻿", ""))
    return table.select(name.alias("name")).where("name <> ''")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue CSV with ``name``, ``sku``, ``brand`` (else the first word), ``normalized`` and a vector of the name."""
    table = spark.read.csv(path, header=True, multiLine=True, escape='"')
    name, sku, brand = (_pick(table.columns, h) for h in (NAME_HEADERS, SKU_HEADERS, BRAND_HEADERS))
    if name is None:
        raise ValueError("no column of names")
    text = lambda c: F.trim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")
    out = table.select(text(name).alias("name"), text(sku).alias("sku"), F.lower(text(brand)).alias("brand")).where("name <> ''")
    return out.withColumns({"brand": F.coalesce(F.nullif("brand", F.lit("")), F.lower(F.split("name", r"\s+")[0])), "normalized": F.lower(normalize(F.col("name")))}).withColumn("vector", embed(F.col("normalized")))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Product pages listed in XML sitemaps, with the name their link spells."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(sitemap_urls(F.col("value"))).alias("url")).distinct().withColumn("name", name_from_slug(F.col("url")))


def sample_products(products: DataFrame, n: int, seed: int, key: str = "sku") -> DataFrame:
    """``n`` active products, each key once, in the order of a seeded hash: a sampling operator."""
    good = products.where((F.col("status") == 1) & (F.coalesce(key, F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    return good.dropDuplicates([key]).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.write.mode("overwrite").json(path)


def save_items(store: DataFrame, items: DataFrame) -> DataFrame:
    """The store with the items of a run in place of those of the same run and index."""
    from ..operators.registry import upsert

    return upsert(store, items, ["run_id", "idx"])
