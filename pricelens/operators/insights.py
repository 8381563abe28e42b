"""Price position, review accuracy, evaluation and price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V


def cents(value: Column) -> Column:
    """Rounded to two places, halves up."""
    return F.floor(value * 100 + 0.5) / 100


def shown(offers: DataFrame, hidden: DataFrame | None = None, kept: DataFrame | None = None, key: list[str] = ["product", "seller"]) -> DataFrame:  # noqa: B006
    """Offers that count: a positive price, a score of 0.7 or more, not hidden; ``kept`` marks those that people vouch for."""
    out = offers.where((F.col("price") > 0) & (F.coalesce("score", F.lit(0.0)) >= V.SHOWN_SCORE))
    if hidden is not None:
        out = out.join(hidden.select(*key).distinct(), key, "left_anti")
    if kept is None:
        return out.withColumn("kept", F.lit(False))
    return out.join(kept.select(*key).distinct().withColumn("kept", F.lit(True)), key, "left").fillna({"kept": False})


def price_positions(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Each product (``product``, ``own``) with the range of its ``offers`` (``product``, ``price``, ``kept``), its ``bucket``, ``cut``, ``headroom`` and ``review``.

    A margin of 25 counts as the same price. ``review`` marks an unvouched offer at twice or
    half the price. Products without a price of their own are left out.
    """
    priced = products.where(F.col("own") > 0)
    gap = F.greatest("price", "own") / F.least("price", "own")
    joined = offers.join(priced, "product").groupBy("product").agg(F.count("*").alias("n_offers"), F.min("price").alias("least"), F.max("price").alias("most"), F.max((gap >= V.EXTREME_GAP) & ~F.col("kept")).alias("review"))
    out = priced.join(joined, "product", "left")
    bucket = F.when(F.col("n_offers").isNull(), "monopoly").when(F.col("least") < F.col("own") - V.MARGIN, "overpriced").when(F.col("most") > F.col("own") + V.MARGIN, "cheapest").otherwise("parity")
    out = out.withColumn("bucket", bucket)
    return out.select(
        "product", "own", F.coalesce("n_offers", F.lit(0)).cast("long").alias("n_offers"), "least", "most", "bucket",
        F.when(F.col("bucket") == "overpriced", cents(F.col("own") - F.col("least"))).alias("cut"), F.when(F.col("bucket") == "cheapest", cents(F.col("least") - F.col("own"))).alias("headroom"), F.coalesce("review", F.lit(False)).alias("review"),
    )


def position_kpis(positions: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts by bucket, and what cuts and raises would come to; products to review don't count for money."""
    count = lambda b: F.count_if(F.col("bucket") == b).alias(b)
    whole = lambda c: F.coalesce(F.sum(F.when(~F.col("review"), F.floor(F.col(c) + 0.5))), F.lit(0)).cast("long")
    return positions.groupBy(*by).agg(F.count("*").alias("analysed"), *map(count, ("overpriced", "cheapest", "parity", "monopoly")), F.count_if("review").alias("flagged"), whole("cut").alias("undercut"), whole("headroom").alias("raise_room"))


def review_accuracy(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Right ones of all reviews per group and over all (null group), in percent to one place; null without reviews."""
    out = reviews.rollup(*by).agg(F.count("correct").alias("total"), F.coalesce(F.sum("correct"), F.lit(0)).cast("long").alias("right"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.floor(F.col("right") * 1000 / F.col("total") + 0.5) / 10))


def evaluate(truth: DataFrame, found: DataFrame, key: list[str], by: str) -> DataFrame:
    """Precision and recall of ``found`` against ``truth`` per group and over all; no answer counts as none, an empty denominator as 0."""
    both = truth.join(found, key, "left").withColumn("hit", F.coalesce("found", F.lit(0)))
    tp, fp, fn = (F.count_if(c).alias(n) for n, c in (("tp", (F.col("truth") == 1) & (F.col("hit") == 1)), ("fp", (F.col("truth") == 0) & (F.col("hit") == 1)), ("fn", (F.col("truth") == 1) & (F.col("hit") == 0))))
    share = lambda a, b: F.coalesce(F.floor(F.try_divide(F.col(a), F.col(a) + F.col(b)) * 1e6 + 0.5) / 1e6, F.lit(0.0))
    return both.rollup(by).agg(tp, fp, fn).withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def price_history(prices: DataFrame, by: list[str], at: str) -> DataFrame:
    """For each group and time the sellers' prices as a map."""
    return prices.groupBy(*by, at).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("seller", "price")))).alias("prices"))


def review_flags(rows: DataFrame) -> DataFrame:
    """``flags``: what a person should look at in a shown match; none for those people have confirmed."""
    gap = F.try_divide(F.greatest("own", "price"), F.least("own", "price"))
    flags = F.array_compact(F.array(F.when(F.col("verdict") == "possible", "not an exact name match"), F.when(F.col("spec") == "different-size", "different pack/size"), F.when(F.col("cosine") < 0.6, "low similarity"), F.when(gap >= V.EXTREME_GAP, "price gap")))
    return rows.withColumn("flags", F.when(F.col("matched_by") == "confirmed", F.array().cast("array<string>")).otherwise(flags))
