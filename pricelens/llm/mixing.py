"""Mixing sources to target weights with Pfair windows and earliest deadline first.

A source with weight ``w`` owns block ``j`` from slot ``floor(j / w)`` (its release) to slot
``ceil((j + 1) / w)`` (its deadline). Weights are whole units of one round of slots, so the
schedule repeats: one round is computed, blocks are placed by joining to it. In each slot the
released block with the earliest deadline goes, which keeps every source within one block of
its target share as long as all sources have blocks left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from ..tables import table

#: Slots in one round of the schedule; weights are rounded to this many units.
ROUND = 1000
#: Sources whose counts may come to the driver; more is an error, not a cut.
MAX_SOURCES = 100_000
#: Rows that one sort task ranks at most, about; larger sources are dealt into more buckets. As many buckets make a run, so that sums over buckets have two levels.
BUCKET_ROWS = 1_000


def units(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Whole units that sum to ``slots``: at least 1 each, the rest by largest remainder (ties by name)."""
    total, spare = sum(weights.values()), slots - len(weights)
    if spare < 0 or (weights and (total <= 0 or min(weights.values()) < 0)):
        raise ValueError("weights must be positive, and a round must have a slot for every source")
    exact = {s: w / total * spare for s, w in weights.items()}
    got = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: slots - sum(got.values())]:
        got[s] += 1
    return got


def round_schedule(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """``(source, block in the round, slot)`` of one round, by earliest deadline first among the released blocks (ties by name)."""
    slots = sum(parts.values())
    waiting = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // parts[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * slots // parts[s], s, j + 1))
    return out


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | float = 0.5, source: str = "source", key: str = "doc_id", block_rows: int = 16) -> DataFrame:
    """``docs`` with ``block`` (of its source), ``slot``, ``seat`` (in the block) and ``on_target``; ``(slot, seat)`` is the mixed order.

    ``weights``: a target per source (each positive), or an exponent: then a source's weight
    is its number of rows to that power. Rows of a source are shuffled by a hash of ``key``,
    then of the row, and cut into blocks of ``block_rows``. Every row comes back once: when a
    source runs out, its slots stay empty and the others go on in proportion, and ``on_target``
    is false from the first empty slot on. Null is a source of its own; sources without a given
    weight get the least given. Columns with a result's name are replaced; repeated rows are
    ranked one after another; an empty table gives an empty result.
    """
    docs = docs.drop("block", "slot", "seat", "on_target")
    hashed = F.xxhash64(*(F.col(c) for c in docs.columns))
    keyed = docs.withColumns({"_s": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")), "_h": F.xxhash64(F.col(key).cast("string"))})
    sizes = {r[0]: r[1] for r in keyed.groupBy("_s").count().limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if isinstance(weights, dict):
        given = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        target = {s: given.get(s, min(given.values())) for s in sizes}
    else:
        target = {s: float(n) ** weights for s, n in sizes.items()}
    slots = max(ROUND, 4 * len(sizes))
    parts = units(target, slots) if sizes else {}
    plan = round_schedule(parts)
    at = {(s, j): slot for s, j, slot in plan}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    end = min((b // parts[s] * slots + at[s, b % parts[s]] for s, b in blocks.items()), default=0)

    buckets = max(1, -(-max(sizes.values(), default=0) // BUCKET_ROWS))
    keyed = keyed.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    counts = keyed.groupBy("_s", "_b").count().withColumn("_run", F.floor(F.col("_b") / BUCKET_ROWS))
    before = lambda *by: F.sum("count").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("count")
    runs = counts.groupBy("_s", "_run").agg(F.sum("count").alias("count")).select("_s", "_run", before("_s", "_run").alias("_runs_before"))
    offsets = counts.withColumn("_in_run", before("_s", "_run", "_b")).join(runs, ["_s", "_run"]).select("_s", "_b", (F.col("_runs_before") + F.col("_in_run")).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", hashed)))
    index = F.col("_before") + F.col("_rank") - 1
    spark = docs.sparkSession
    schedule = spark.createDataFrame([(s, j, slot, parts[s]) for s, j, slot in plan], "_s string, _j long, _slot long, _units long")
    own = spark.createDataFrame(list(parts.items()), "_s string, _units long")
    placed = ranked.join(offsets, ["_s", "_b"]).join(F.broadcast(own), "_s")  # both tables have a row per slot of a round at most
    placed = placed.withColumns({"block": F.floor(index / block_rows), "seat": (index % block_rows).cast("long")}).withColumn("_j", F.col("block") % F.col("_units"))
    placed = placed.join(F.broadcast(schedule.drop("_units")), ["_s", "_j"])
    slot = F.floor(F.col("block") / F.col("_units")) * slots + F.col("_slot")
    return placed.select(*docs.columns, "block", slot.alias("slot"), "seat", (slot < end).alias("on_target"))


def op7_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
