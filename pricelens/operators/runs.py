"""Stored runs, their items and people's reviews of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import checkpointed, parts


def with_runs(items: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Items with their run's columns; items of unknown runs, and runs without items, are left out."""
    return items.join(runs, key)


def with_review_summary(runs: DataFrame, reviews: DataFrame, key: str = "run_id", correct: str = "correct") -> DataFrame:
    """Every run with ``reviews``, ``right`` and ``accuracy`` (percent to one place; null without reviews). Reviews are summed before they meet the runs."""
    summed = reviews.groupBy(key).agg(F.count(correct).alias("reviews"), F.coalesce(F.sum(F.col(correct).cast("int")), F.lit(0)).cast("long").alias("right"))
    out = runs.join(summed, key, "left").fillna(0, ["reviews", "right"])
    return out.withColumn("accuracy", F.when(F.col("reviews") > 0, F.floor(F.col("right") * 1000 / F.col("reviews") + 0.5) / 10))


def batch_summary(reviews: DataFrame, by: list[str], correct: str = "correct", learned: str = "learned") -> DataFrame:
    """Of each batch of reviews ``total``, ``right``, ``needs_fix``, ``accuracy`` and how many links were ``learned``."""
    right = F.coalesce(F.sum(F.col(correct).cast("int")), F.lit(0)).cast("long")
    out = reviews.groupBy(*by).agg(F.count("*").alias("total"), right.alias("right"), F.coalesce(F.sum(learned), F.lit(0)).cast("long").alias("learned"))
    return out.withColumns({"needs_fix": F.col("total") - F.col("right"), "accuracy": F.floor(F.col("right") * 1000 / F.col("total") + 0.5) / 10})


def verdict_counts(cells: DataFrame, by: list[str], verdict: str = "verdict", names: tuple[str, ...] = ("confirmed", "possible", "variant")) -> DataFrame:
    """How many cells of each group have each verdict, and ``none`` for those without any of them."""
    known = F.coalesce(F.col(verdict).isin(*names), F.lit(False))
    return cells.groupBy(*by).agg(*(F.count_if(F.col(verdict) == n).alias(n) for n in names), F.count_if(~known).alias("none"))


def kept_runs(runs: DataFrame, now: Column, days: int, started: str = "started_at") -> DataFrame:
    """Runs that started no more than ``days`` before ``now``, by time and not by text; runs without a start stay."""
    old = F.col(started) < now - F.make_dt_interval(F.lit(days))
    return runs.where(~F.coalesce(old, F.lit(False)))


def learned_links(reviews: DataFrame) -> DataFrame:
    """What right reviews teach: ``product``, ``seller``, ``url``, ``name`` of each offer shown with a link and a price and without a note; the last of a product and seller stays.

    ``reviews`` has ``product``, ``correct``, ``reviewed_at`` and ``offers`` (an array of ``seller``, ``url``, ``name``, ``price``, ``note``).
    """
    offer = reviews.where("correct and product <> ''").select("product", "reviewed_at", F.explode("offers").alias("o"))
    fit = offer.where("o.seller is not null and o.seller <> '' and o.url <> '' and o.price is not null and coalesce(o.note, '') = ''")
    last = fit.groupBy("product", F.col("o.seller").alias("seller")).agg(F.max(F.struct("reviewed_at", "o.url", "o.name")).alias("last"))
    return last.select("product", "seller", "last.url", "last.name")


def sets_by_key(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The distinct values of each key, ascending. The sets are those of one key: not for keys with very many values."""
    return rows.groupBy(*key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def drill_down(positions: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Price positions with their ``place`` in their bucket: overpriced by cut, cheapest by headroom, monopolies by price, the greatest first, equal ones by product; parity by product alone.

    Buckets are few and large, so rows are dealt by range and ranked range by range; what
    stands in the ranges before is added. The dealt rows are written once, since both read them.
    """
    most = F.when(F.col("bucket") == "overpriced", F.col("cut")).when(F.col("bucket") == "cheapest", F.col("headroom")).when(F.col("bucket") == "monopoly", F.col("own"))
    order = [F.desc_nulls_last("_most"), F.col("product")]
    dealt = positions.withColumn("_most", most).repartitionByRange(parts(positions), *by, "bucket", *order)
    dealt = checkpointed(dealt.withColumn("_range", F.spark_partition_id()))
    group = [*by, "bucket"]
    sizes = dealt.groupBy(*group, "_range").count()
    before = sizes.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_range").alias("_r"), (F.sum("count").over(Window.partitionBy(*group).orderBy("_range")) - F.col("count")).alias("_before"))
    ranked = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(before, same).select(*positions.columns, (F.col("_before") + F.col("_place")).alias("place"))
