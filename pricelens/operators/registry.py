"""The match registry: upserts that respect decisions, as joins to a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..tables import checkpointed


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key; rows of ``new`` without a key are left out. Both have the same columns, ``new`` one row a key."""
    rest = [c for c in old.columns if c not in key]
    fresh = new.dropna(subset=key).select(*key, F.struct(*rest).alias("_new"))
    both = old.select(*key, F.struct(*rest).alias("_old")).join(fresh, key, "full_outer")
    return both.select(*key, F.coalesce("_new", "_old").alias("_row")).select(*key, "_row.*").select(*old.columns)


def merge_links(old: DataFrame, new: DataFrame, key: list[str], kept: tuple[str, ...] = ("human_verified", "killed"), filled: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`upsert`, but links with a ``kept`` status stay as they are, and the columns ``filled`` keep their old value where the new one is null."""
    rest = [c for c in old.columns if c not in key]
    both = old.select(*key, *(F.col(c).alias(f"o_{c}") for c in rest), F.lit(True).alias("_had")).join(new.dropna(subset=key).select(*key, *(F.col(c).alias(f"n_{c}") for c in rest), F.lit(True).alias("_has")), key, "full_outer")
    stays = F.coalesce(F.col("o_status").isin(*kept), F.lit(False)) | F.col("_has").isNull()
    return both.select(*key, *(F.when(stays, F.col(f"o_{c}")).otherwise(F.coalesce(f"n_{c}", f"o_{c}") if c in filled else F.col(f"n_{c}")).alias(c) for c in rest)).select(*old.columns)


def without(rows: DataFrame, banned: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't banned."""
    return rows.join(banned.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregated before the shuffle, so long histories don't meet in one task."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_last"))
    return last.select(*key, *(F.col("_last")[c].alias(c) for c in rest)).select(*rows.columns)


def ranked_links(links: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Links in the order of trust: verified by people, then confirmed, variant, possible, then confidence."""
    rank = F.when(F.col("verdict") == "confirmed", 3).when(F.col("verdict") == "variant", 2).when(F.col("verdict") == "possible", 1).otherwise(0)
    order = Window.partitionBy(*by).orderBy((F.col("status") == "human_verified").desc(), rank.desc(), F.col("confidence").desc(), tie)
    return links.withColumn("place", F.row_number().over(order))


def differences(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Two runs side by side: ``left``, ``right`` or ``both``, with both values."""
    both = left.select(*key, F.col(value).alias("left_value"), F.lit(1).alias("_l")).join(right.select(*key, F.col(value).alias("right_value"), F.lit(1).alias("_r")), key, "full_outer")
    return both.select(*key, "left_value", "right_value", F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both").alias("side"))


def filled_to(fixed: DataFrame, pool: DataFrame, key: str, size: int) -> DataFrame:
    """The fixed list, then as many of the pool as make ``size``, in the order of a hash of the key; ``source`` tells which."""
    more = pool.join(fixed.select(key), key, "left_anti").orderBy(F.xxhash64(key), key).limit(max(0, size - fixed.count()))
    return fixed.select(key, F.lit("watchlist").alias("source")).unionByName(more.select(key, F.lit("fill").alias("source")))


def ancestor(spark, runs: DataFrame) -> DataFrame:
    """For each run (``run_id``, ``source_run_id``, ``special``) the nearest source that isn't special: ``run_id``, ``ancestor``.

    Jumps double in length each round, so a chain of any length is followed in the logarithm of
    its length. Runs without a source, with an unknown one, or whose special sources lead
    around in a circle have no row. ``run_id`` is unique.
    """
    jump = checkpointed(runs.select("run_id", F.when(F.coalesce("special", F.lit(False)), F.col("source_run_id")).otherwise(F.col("run_id")).alias("to")).where("to is not null"))
    for _ in range(max(1, jump.count()).bit_length()):
        longer = jump.join(jump.select(F.col("run_id").alias("to"), F.col("to").alias("next")), "to").select("run_id", F.col("to").alias("was"), F.col("next").alias("to"))
        longer = checkpointed(longer)
        moved = longer.where("was <> to").limit(1).count()
        jump = longer.drop("was")
        if not moved:
            break
    ends = runs.where(~F.coalesce("special", F.lit(False))).select(F.col("run_id").alias("to"))
    found = runs.select("run_id", F.col("source_run_id").alias("at")).join(jump.select(F.col("run_id").alias("at"), "to"), "at").join(ends, "to")
    return found.select("run_id", F.col("to").alias("ancestor"))
