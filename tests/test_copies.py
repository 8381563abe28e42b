"""Queries on pairs of names over a catalogue of copies: the pairs that are worked on don't grow with the copies, the rows do."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pricelens.operators import pairs
from pricelens.plans import queries as plans
from tests.compare import rows

COPIES, APART = 9, 1_000_000


@pytest.fixture(scope="module")
def copied(spark, sf, tmp_path_factory):
    """A folder whose parts are those of ``sf``, each with eight copies."""
    folder = str(tmp_path_factory.mktemp("copies"))
    part = spark.read.parquet(f"{sf}/part.parquet").withColumn("p_brand", F.concat(F.lit("Brand#"), (F.col("p_partkey") % 5).cast("string")))
    part.write.parquet(f"{folder}/one/part.parquet")
    more = part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    more.withColumn("p_partkey", F.col("p_partkey") + F.col("i") * APART).drop("i").write.parquet(f"{folder}/many/part.parquet")
    return folder


def expected(spark, folder, name):
    if name in plans.SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/many/part.parquet/*.parquet'")
        return con.sql(plans.SQL[name]).df()
    if name == "match_rank":
        done = pairs.triage(plans._pairs(spark, f"{folder}/many"))
        best = pairs.top_with_rescue(done, ["s_search_id"], [F.desc(F.floor(F.coalesce("score", F.lit(0.0)) * 1e6)), F.col("c_candidate_id")], "c_candidate_id")
        return best.select(F.col("s_search_id").alias("search_id"), F.col("c_candidate_id").alias("candidate_id"), "gate", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "verdict", "rank", "rescued").toPandas()
    one = plans.QUERIES[name](spark, f"{folder}/one")
    return one.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("candidate_id", F.col("candidate_id") + F.col("i") * APART).drop("i").toPandas()


@pytest.mark.parametrize("name", ["structured_verdicts", "match_rank", "pair_features", "topk_per_search", "gate_contrast", "fuzz_token_set", "weighted_jaccard_pairs"])
def test_pairs_worked_on_do_not_grow_with_copies(spark, copied, name, monkeypatch):
    made, block = [], pairs.block
    theirs = expected(spark, copied, name)
    monkeypatch.setattr(plans.pairs, "block", lambda *a, **b: made.append(block(*a, **b)) or made[-1])
    ours = plans.QUERIES[name](spark, f"{copied}/many").toPandas()
    plans.QUERIES[name](spark, f"{copied}/one")
    assert len(ours) > 0 and rows(ours) == rows(theirs)
    assert made[0].count() == made[1].count() > 0


def test_search_queries_are_made_once_a_name(spark, copied, monkeypatch):
    made, written = [], plans.checkpointed
    monkeypatch.setattr(plans, "checkpointed", lambda df: made.append(written(df)) or made[-1])
    many = plans.QUERIES["listing_queries"](spark, f"{copied}/many")
    one = plans.QUERIES["listing_queries"](spark, f"{copied}/one").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    assert rows(many.toPandas()) == rows(one.withColumn("p_partkey", F.col("p_partkey") + F.col("i") * APART).drop("i").toPandas())
    assert made[0].count() == made[1].count() == plans.listings(spark, f"{copied}/one").select("name").distinct().count()


def test_children_are_chosen_row_by_row_with_names_compared_once(spark, monkeypatch):
    from pricelens.functions.specs import parse_spec

    made, written = [], pairs.checkpointed
    monkeypatch.setattr(pairs, "checkpointed", lambda df: made.append(written(df)) or made[-1])
    kin = [[("Acme beta", 5.0 + i), ("Acme gamma", 7.0), ("Default Title", 1.0)] for i in range(20)]
    rows_ = [(1, i % 2, f"Acme item {'beta' if i % 4 < 2 else 'gamma'}", 6.0, "Acme item", 9.0, k) for i, k in enumerate(kin)]
    frame = spark.createDataFrame(rows_, "s_id int, c_id int, s_name string, s_price double, c_name string, c_price double, kin array<struct<name:string,price:double>>")
    none = parse_spec(F.lit(""))
    frame = frame.withColumns({"s_spec": none, "c_spec": none, "variants": F.transform("kin", lambda v: F.struct(v["name"].alias("name"), v["price"].alias("price"), none.alias("spec")))})
    got = sorted((r.c_name, r.c_price, r.pinned) for r in pairs.select_variant(frame).collect())
    assert got == sorted(("Acme beta", 5.0 + i, True) if i % 4 < 2 else ("Acme gamma", 7.0, True) for i in range(20))
    assert made[0].count() == 2
