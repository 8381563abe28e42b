"""Queries whose rows come out of a stream's sink or state, and what web searches answered."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.specs import parse_spec
from ..operators import merchant_compare
from ..sources import result_sink
from ..streaming import events as E, progress
from ..tables import shared_folder, table
from .queries import query


@query("""WITH a AS (SELECT user_id AS run_id, event_id % 7 AS idx, event_type, floor(value * 100 + 0.5)::BIGINT AS cents, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY lpad(event_id::VARCHAR, 12, '0') DESC) AS r FROM (SELECT * FROM events WHERE event_id IS NOT NULL))
SELECT run_id, idx, event_type, cents, count(*) OVER (PARTITION BY run_id) AS done_count FROM a WHERE r = 1 AND run_id IS NOT NULL""")
def streamed_results(spark, sf):
    """Events as results of items that are done again and again: the last of each, and each run's count."""
    at = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    events = E.source(spark, f"{sf}/events.parquet").where("event_id IS NOT NULL")
    results = events.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 7).alias("idx"), "event_type", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("finished_at"))
    result_sink.stream_results(results, f"{at}/rows", f"{at}/log").awaitTermination()
    written = result_sink.arrivals(spark, f"{at}/rows")
    return result_sink.saved_items(written).join(result_sink.done_counts(written), "run_id").select("run_id", "idx", "event_type", "cents", "done_count")


_ITEMS = """item AS (SELECT l_orderkey, l_linenumber, arg_max(l_returnflag <> 'R', (l_shipdate, l_returnflag <> 'R')) AS ok, max(l_shipdate::TIMESTAMP) AS ship FROM lineitem GROUP BY ALL),
run AS (SELECT l_orderkey, count(*) AS done, count(*) FILTER (WHERE NOT ok) AS failed, max(ship) AS last_at FROM item GROUP BY l_orderkey)"""


@query(f"""WITH {_ITEMS}, r AS (SELECT *, done + CASE WHEN l_orderkey % 2 = 1 THEN 1 ELSE 0 END AS expected FROM run)
SELECT l_orderkey::VARCHAR AS run_id, CASE WHEN done >= expected THEN 'complete' ELSE 'timed out' END AS outcome, expected, done, failed, last_at FROM r WHERE done >= expected OR last_at + INTERVAL 31 DAY <= (SELECT max(ship) FROM item)""")
def run_progress(spark, sf):
    """Order lines as items of runs, returned ones failed; odd orders wait for a line that never comes. The batch form; the stream is held against it by the tests."""
    lines = table(spark, sf, "lineitem")
    expected = lines.groupBy("l_orderkey").agg((F.countDistinct("l_linenumber") + F.col("l_orderkey") % 2).alias("expected"))
    items = lines.join(expected, "l_orderkey").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("idx"), (F.col("l_returnflag") != "R").alias("ok"), "expected", F.col("l_shipdate").cast("timestamp").alias("at"))
    return progress.run_progress_batch(items)


_DOMAINS = {"alpha-tools.example.com": "alpha", "beta.example.in": "beta"}


def _answers(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Searches for a tenth of the parts' names, the answers of three kinds to each, and pages of the merchants found."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("search_id"), F.concat(F.lit("Brand "), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(" "), "p_name", F.lit(" "), F.lower("p_type")).alias("name"), F.col("p_retailprice").alias("price"))
    record = {"description": F.lit("as listed"), "packaging": F.lit("single"), "unit_price": F.col("price"), "pack_size": F.lit(1), "spec": parse_spec(F.lit(""))}
    searches = p.withColumns(record)
    k = F.col("search_id").cast("string")
    say = lambda **fields: F.struct(*(c.alias(f) for f, c in fields.items()))
    shop = lambda source, price: say(source=F.lit(source), title=F.col("name"), extracted_price=price)
    shopping = F.to_json(F.struct(F.array(shop("Gamma Store", F.col("price")), shop("Alpha-Tools.example.com", F.col("price")), shop("gammastore", F.col("price")), shop("Own Shop", F.col("price")), shop("Delta", F.col("price") * 20), shop("", F.col("price")), shop("Epsilon.com", F.col("price"))).alias("shopping_results")))
    link = lambda host: F.concat(F.lit(f"https://{host}/p/"), k)
    organic = F.to_json(F.struct(F.array(say(link=F.concat(link("www.alpha-tools.example.com"), F.lit("?x=1")), title=F.col("name")), say(link=link("alpha-tools.example.com"), title=F.col("name")), say(link=F.lit("ftp://x"), title=F.lit("x")), say(link=link("epsilon.com"), title=F.lit("x"))).alias("organic_results")))
    stores = F.to_json(F.struct(F.struct(F.array(say(name=F.lit("Gamma Store"), link=link("gamma.example.org"), extracted_price=F.col("price"))).alias("stores")).alias("product_results")))
    bodies = {"shopping": shopping, "organic": organic, "stores": stores, "other": F.lit("[1]")}
    answers = p.select("search_id", F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), body.alias("body")) for kind, body in bodies.items()), F.struct(F.lit("organic").alias("kind"), F.lit("not json").alias("body")))).alias("a")).select("search_id", "a.*")
    kin = F.expr("CAST(array() AS array<struct<name:string,price:double,spec:struct<powder_g:double,liquid_g:double,liquid_ml:double,capsules:double,pieces:double,is_extra:boolean,size_tier:string,kit_tier:string,torque:string>>>)")
    page = searches.select(F.explode(F.array(F.struct(link("www.alpha-tools.example.com").alias("url"), F.col("name").alias("n"), (F.col("price") - 5).alias("q")), F.struct(link("gamma.example.org").alias("url"), F.concat(F.lit("Zzz "), F.lit("other thing")).alias("n"), F.col("price").alias("q")))).alias("x"), *record)
    pages = page.select("x.url", F.col("x.n").alias("name"), "description", "packaging", F.col("x.q").alias("price"), F.col("x.q").alias("unit_price"), "pack_size", "spec", kin.alias("variants"))
    return searches, answers, pages


@query("""WITH p AS (SELECT p_partkey AS search_id, 'Brand ' || regexp_extract(p_brand, '(\\d+)', 1) || ' ' || p_name || ' ' || lower(p_type) AS name, p_retailprice AS price FROM part),
m AS (SELECT unnest([{place: 1, merchant: 'Gamma Store', seller: 'gammastore'}, {place: 2, merchant: 'Alpha-Tools.example.com', seller: 'alpha'}, {place: 3, merchant: 'Delta', seller: 'delta'}, {place: 4, merchant: 'Epsilon.com', seller: 'epsilon'}, {place: 5, merchant: 'beta.example.in', seller: 'beta'}], recursive := true)),
c AS (SELECT *, CASE WHEN seller = 'beta' AND search_id % 4 = 1 THEN 'none' WHEN seller = 'gammastore' AND search_id % 4 = 2 THEN 'reuse' ELSE 'discover' END AS route FROM p CROSS JOIN m),
d AS (SELECT *, seller = 'alpha' OR route = 'reuse' AS shown FROM c)
SELECT search_id, place, merchant, seller, route, CASE WHEN shown THEN name END AS name, CASE WHEN shown THEN price - 5 END AS price, CASE WHEN shown THEN 'https://www.alpha-tools.example.com/p/' || search_id END AS url, CASE WHEN shown THEN 'confirmed' END AS verdict,
  CASE WHEN shown THEN floor((price - (price - 5)) * 100 + 0.5) / 100 END AS price_difference,
  CASE WHEN shown THEN NULL WHEN route = 'none' THEN 'confirmed: not sold here' WHEN seller = 'beta' THEN 'not listed' WHEN seller = 'gammastore' THEN 'different product on this site' WHEN seller = 'delta' THEN 'different product by its price' ELSE 'page not verified' END AS note FROM d""")
def merchant_cells(spark, sf):
    """Merchants by three shapes of answers: a confirmed page, another product's page, a card far off, a page that can't be read, and a merchant that isn't listed or is remembered."""
    searches, answers, pages = _answers(spark, sf)
    k = F.col("search_id")
    memory = searches.where(k % 4 == 1).select("search_id", F.lit("beta").alias("seller"), F.lit("no_match").alias("label"), F.lit("").alias("url"))
    memory = memory.unionByName(searches.where(k % 4 == 2).select("search_id", F.lit("gammastore").alias("seller"), F.lit("correct").alias("label"), F.concat(F.lit("https://www.alpha-tools.example.com/p/"), k.cast("string")).alias("url")))
    base = spark.createDataFrame([("beta.example.in", 1), ("Alpha-Tools.example.com", 2)], "merchant string, base_position int")
    cells = merchant_compare.merchant_cells(spark, searches, answers, pages, memory, base, _DOMAINS | {"ownshop.example": "own"}, "own")
    return cells.select("search_id", F.col("place").cast("int").alias("place"), "merchant", "seller", "route", "name", "price", "url", "verdict", "price_difference", "note")
