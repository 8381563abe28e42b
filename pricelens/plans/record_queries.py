"""Queries on runs, reviews, merchants and discovery over the given tables, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import attributes as A, gates as G, names as N, pages as P, specs as C
from ..operators import discovery, merchants, pairs, registry, runs
from ..streaming import events as E
from ..tables import table
from .queries import LISTINGS, _POSITIONS, _anchors, listings, pricing_buckets, query


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def run_items(spark, sf):
    """Order lines as items of their orders."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return runs.with_runs(items, table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey")


@query("SELECT o_orderkey, coalesce(n, 0)::BIGINT AS reviews, coalesce(r, 0)::BIGINT AS \"right\", CASE WHEN n > 0 THEN floor(r * 1000 / n + 0.5) / 10 END AS accuracy FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS r FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def run_summaries(spark, sf):
    """Every order with what its open lines say."""
    said = table(spark, sf, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "N").alias("correct"))
    return runs.with_review_summary(table(spark, sf, "orders").select("o_orderkey"), said, "o_orderkey")


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE toxic = 0) AS \"right\", sum(quality)::BIGINT AS learned, count(*) FILTER (WHERE toxic = 1) AS needs_fix, floor(count(*) FILTER (WHERE toxic = 0) * 1000 / count(*) + 0.5) / 10 AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY source")
def batch_accuracy(spark, sf):
    said = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return runs.batch_summary(said.select("source", (F.col("toxic") == 0).alias("correct"), F.col("quality").alias("learned")), ["source"])


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS confirmed, count(*) FILTER (WHERE l_returnflag = 'N') AS possible, 0::BIGINT AS variant, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS none FROM lineitem GROUP BY l_suppkey")
def verdict_counts(spark, sf):
    verdict = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "N", "possible")
    return runs.verdict_counts(table(spark, sf, "lineitem").select("l_suppkey", verdict.alias("verdict")), ["l_suppkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 1000 DAY")
def kept_runs(spark, sf):
    """Orders of the thousand days before a day."""
    return runs.kept_runs(table(spark, sf, "orders"), F.lit("1998-06-01").cast("timestamp_ntz"), 1000, "o_orderdate").select("o_orderkey")


@query(f"WITH {_POSITIONS} SELECT product, bucket, row_number() OVER (PARTITION BY bucket ORDER BY CASE bucket WHEN 'overpriced' THEN cut WHEN 'cheapest' THEN headroom WHEN 'monopoly' THEN own END DESC NULLS LAST, product) AS place FROM positions")
def drill_down(spark, sf):
    return runs.drill_down(pricing_buckets(spark, sf)).select("product", "bucket", F.col("place").cast("long").alias("place"))


@query("WITH o AS (SELECT o_custkey, o_orderdate, l_suppkey, l_partkey, l_linenumber, l_extendedprice, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P') SELECT o_custkey::VARCHAR AS product, l_suppkey::VARCHAR AS seller, arg_max(l_partkey::VARCHAR, (o_orderdate, l_partkey::VARCHAR, l_linenumber::VARCHAR)) AS url, arg_max(l_linenumber::VARCHAR, (o_orderdate, l_partkey::VARCHAR, l_linenumber::VARCHAR)) AS name FROM o WHERE l_returnflag <> 'R' GROUP BY ALL")
def learned_links(spark, sf):
    """Orders as reviews: the sellers of their lines are learned where the order stands and the line has no note."""
    text = lambda c: F.col(c).cast("string")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(text("l_suppkey").alias("seller"), text("l_partkey").alias("url"), text("l_linenumber").alias("name"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_returnflag") == "R", "no").alias("note"))).alias("offers"))
    said = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(text("o_custkey").alias("product"), (F.col("o_orderstatus") != "P").alias("correct"), F.col("o_orderdate").alias("reviewed_at"), "offers")
    return runs.learned_links(said)


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), '/') AS sellers FROM lineitem GROUP BY l_partkey")
def sellers_by_part(spark, sf):
    return runs.sets_by_key(table(spark, sf, "lineitem"), ["l_partkey"], "l_suppkey").select("l_partkey", F.array_join("values", "/").alias("sellers"))


def _hosts(spark, sf) -> DataFrame:
    """Each page's host, as written."""
    return table(spark, sf, "pages").select("page_id", "url", F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]+://([^/?#]*)", 1).alias("host"))


_KEY = r"regexp_replace(regexp_replace(split_part(regexp_replace(lower(trim({})), '^https?://', ''), '/', 1), '\.(com|in|co|net|org|shop|store|biz|io)(\.[a-z]{{2}})?$', ''), '[^a-z0-9]', '', 'g')"
_HOSTS = "host AS (SELECT page_id, url, regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)"


@query(f"WITH {_HOSTS}, h AS (SELECT *, {_KEY.format('host')} AS k FROM host), m AS (SELECT k, min(host) AS merchant FROM h WHERE page_id % 2 = 0 GROUP BY k) SELECT merchant, coalesce(page_id, -1) AS page_id FROM m LEFT JOIN (SELECT page_id, k FROM h WHERE page_id % 2 = 1 AND k <> '') r USING (k)")
def merchant_hosts(spark, sf):
    """Merchants by the hosts of even pages, with the odd pages that may be theirs."""
    hosts = _hosts(spark, sf)
    named = hosts.where("page_id % 2 = 0").groupBy(N.merchant_key(F.col("host")).alias("k")).agg(F.min("host").alias("merchant")).select("merchant")
    return merchants.with_hosts(named, hosts.where("page_id % 2 = 1").select("page_id", "host")).select("merchant", F.coalesce("page_id", F.lit(-1)).alias("page_id"))


_DOMAINS = {"example.com": "first", "site1.org": "second", "example.net": "third"}


@query(f"WITH {_HOSTS}, h AS (SELECT page_id, {_KEY.format('host')} AS k FROM host) SELECT page_id, CASE WHEN k = '' THEN NULL WHEN contains(k, 'example') OR contains('example', k) THEN 'first' WHEN contains(k, 'site1') OR contains('site1', k) THEN 'second' END AS seller FROM h")
def known_sellers(spark, sf):
    return _hosts(spark, sf).select("page_id", merchants.known_seller(F.col("host"), _DOMAINS).alias("seller"))


@query("WITH m AS (SELECT l_orderkey, max(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) AS s, min(l_partkey)::VARCHAR AS u FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, CASE s WHEN 2 THEN 'reuse' WHEN 1 THEN 'none' ELSE 'discover' END AS route, CASE s WHEN 2 THEN u END AS url FROM orders LEFT JOIN m ON l_orderkey = o_orderkey AND o_orderkey % 3 > 0")
def confirmed_memory(spark, sf):
    """Orders looked up in a memory that their lines make for two of three."""
    label = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 1).otherwise(0)
    known = table(spark, sf, "lineitem").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(label).alias("s"), F.min("l_partkey").cast("string").alias("url"))
    memory = known.select("o_orderkey", F.when(F.col("s") == 2, "correct").when(F.col("s") == 1, "no_match").otherwise("other").alias("label"), "url")
    return merchants.remembered(table(spark, sf, "orders").select("o_orderkey"), memory, ["o_orderkey"])


@query("SELECT l_partkey, l_suppkey, position FROM (SELECT *, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS position FROM lineitem WHERE l_returnflag <> 'R') QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'A' DESC, l_quantity DESC, position) = 1")
def best_verified(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag <> 'R'")
    rows = lines.select("l_partkey", "l_suppkey", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")).alias("position"), F.when(F.col("l_returnflag") == "A", "confirmed").otherwise("possible").alias("verdict"), F.col("l_quantity").alias("score"))
    return merchants.best_verified(rows, ["l_partkey"]).select("l_partkey", "l_suppkey", "position")


@query("SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS place FROM lineitem QUALIFY place <= 8")
def ranked_candidates(spark, sf):
    """The eight best lines of each part by a score."""
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return merchants.ranked(rows, ["l_partkey"], F.col("l_quantity"), "position", 8).select("l_partkey", "l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("WITH s AS (SELECT DISTINCT l_partkey FROM lineitem), f AS (SELECT l_partkey, 's' || l_suppkey AS key, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY p, key) AS pos FROM f), c AS (SELECT l_partkey, key, true AS found, 0 AS turn, pos FROM r WHERE pos <= 3), b AS (SELECT l_partkey, key, x.pos FROM s, (VALUES ('s1', 1), ('s2', 2)) x(key, pos)), a AS (SELECT b.l_partkey, b.key, r.key IS NOT NULL AS found, 1 AS turn, b.pos FROM b ANTI JOIN c USING (l_partkey, key) LEFT JOIN r USING (l_partkey, key)) SELECT l_partkey, key, found, row_number() OVER (PARTITION BY l_partkey ORDER BY turn, pos, key) AS place FROM (FROM c UNION ALL FROM a)")
def merchant_list(spark, sf):
    """The first three sellers of each part, and two that are always listed."""
    seen = table(spark, sf, "lineitem").select("l_partkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit(".com")).alias("merchant"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    base = spark.createDataFrame([("S1.com", 1), ("S2.com", 2)], "merchant string, base_position int")
    return merchants.merchant_list(seen, base, ["l_partkey"], 3).select("l_partkey", "key", "found", F.col("place").cast("long").alias("place"))


@query(r"WITH h AS (SELECT page_id, page_id // 10 AS search, regexp_replace(url, '[?].*$', '', 's') AS bare FROM pages WHERE url IS NOT NULL), f AS (SELECT search, bare, min(page_id) AS position FROM h GROUP BY ALL), w AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(regexp_replace(regexp_extract(lower(bare), '([^/]*)/*$', 1), '\.html?$', ''), '[a-z0-9]+')), ['en', 'index', '7', '42'])) AS shared FROM f) SELECT search, bare AS url, position, shared, row_number() OVER (PARTITION BY search ORDER BY shared DESC, position) AS place FROM w")
def ordered_links(spark, sf):
    """Pages in tens, as links of a search for some words."""
    links = table(spark, sf, "pages").where("url is not null").select(F.floor(F.col("page_id") / 10).alias("search"), "url", F.col("page_id").alias("position"), F.lit("En index 7 42").alias("name"))
    return merchants.ordered_links(links, ["search"], "name").select("search", "url", "position", F.col("shared").cast("long").alias("shared"), F.col("place").cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'different product by its title' WHEN p_retailprice > 0 AND l_extendedprice > 0 AND greatest(p_retailprice, l_extendedprice) > 8 * least(p_retailprice, l_extendedprice) THEN 'different product by its price' ELSE 'page not verified' END AS note FROM lineitem JOIN part ON l_partkey = p_partkey")
def unverified_notes(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", merchants.unverified_note(F.col("p_retailprice"), F.col("l_extendedprice"), F.col("l_returnflag") == "R").alias("note"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND p_size > 0 THEN floor(l_extendedprice / l_quantity * p_size * 100 + 0.5) / 100 ELSE l_extendedprice END AS equivalent FROM lineitem JOIN part ON l_partkey = p_partkey")
def equivalent_prices(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", A.equivalent_price(F.col("l_extendedprice"), F.col("l_quantity"), F.col("p_size")).alias("equivalent"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '\.html?(\?.*)?$', 'i') THEN 4 ELSE 1 END AS n, CASE WHEN regexp_matches(url, '\.html?(\?.*)?$', 'i') THEN regexp_replace(url, '(\.html?)(\?.*)?$', '-3\1\2', 'i') ELSE url END AS last FROM pages WHERE url IS NOT NULL")
def sibling_pages(spark, sf):
    """Where else a page may be, as many as there are and the last."""
    found = table(spark, sf, "pages").where("url is not null").select("page_id", P.sibling_urls(F.col("url")).alias("s"))
    return found.select("page_id", F.size("s").alias("n"), F.element_at("s", -1).alias("last"))


@query(f"WITH {LISTINGS}, n AS (SELECT p_partkey, p_name || ' ' || p_size AS code FROM listing) SELECT p_partkey, len(code) <= 24 AND regexp_matches(code, '\\d') AND NOT regexp_matches(code, '\\b(pack|set|sheets?|of|coarse|medium|fine|regular|assorted|cm|mm|ml|mg|kg|gm?|microns?|inch|inches|oz)\\b', 'i') AS code FROM n")
def code_like_names(spark, sf):
    return listings(spark, sf).select("p_partkey", N.looks_like_code(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("code"))


def _records(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Searches from the catalogue's anchors, and every part as a candidate of one of four sellers."""
    fields = lambda name, price: {"description": F.lit(""), "packaging": F.lit(""), "pack_size": A.pack_size(name), "unit_price": A.unit_price(price, A.pack_size(name)), "spec": C.parse_spec(name)}
    searches = _anchors(spark, sf).drop("short", "members").withColumns(fields(F.col("name"), F.col("price")))
    card = listings(spark, sf).select("p_brand", "p_type", F.concat(F.lit("seller"), (F.col("p_partkey") % 4).cast("string")).alias("seller"), F.col("p_partkey").cast("string").alias("url"), F.col("p_partkey").alias("position"), "name", "price")
    card = card.withColumns(fields(F.col("name"), F.col("price"))).withColumn("variants", F.array(F.struct(F.col("name").alias("name"), F.lit(0.0).alias("price"), F.col("spec").alias("spec"))))
    return searches, card


@query()
def discover_cells(spark, sf):
    """Every anchor at four sellers, from the pool to one cell each: half of the candidates have a page, some are killed, some judged."""
    searches, cards = _records(spark, sf)
    pages = cards.where("position % 2 = 0").drop("p_brand", "p_type", "seller", "position").withColumns({"canonical": F.col("url"), "description": F.concat(F.lit("The "), F.col("name"))})
    asked = searches.select("search_id", "p_brand", "p_type").join(cards.select("p_brand", "p_type", "url", "position"), ["p_brand", "p_type"])
    killed = asked.where("position % 7 = 0").select("search_id", "url")
    judged = asked.where("position % 3 = 0").select("search_id", "url", (F.col("position") % 2 == 0).alias("same_product"), (F.col("position") % 4 == 0).alias("same_variant"), F.lit(0.8).alias("sure"))
    return discovery.discover(searches, cards, pages, killed, judged, ["p_brand", "p_type"]).select("search_id", "seller", "url", "verdict", (F.floor(F.col("confidence") * 1e6 + 0.5) / 1e6).alias("confidence"), "matched_by")


@query("WITH p AS (SELECT l_partkey, l_suppkey, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS now FROM lineitem GROUP BY ALL) SELECT DISTINCT o.l_partkey, o.l_suppkey, now FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') o JOIN p USING (l_partkey, l_suppkey) WHERE now > 20000")
def refreshed_prices(spark, sf):
    """Links that were confirmed, with the latest price where it counts."""
    key = F.concat_ws("/", "l_partkey", "l_suppkey").alias("url")
    lines = table(spark, sf, "lineitem")
    links = lines.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey", key).distinct()
    last = registry.latest(lines.select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    pages = last.select(key, F.when(F.col("l_extendedprice") > 20000, F.col("l_extendedprice")).otherwise(0.0).alias("price"))
    return discovery.refreshed(links, pages)[0].select("l_partkey", "l_suppkey", "now")


_GATED = "g AS (SELECT l_orderkey, l_linenumber, (['curette', 'pliers', 'mirror', 'liquid', 'powder', 'kit'])[l_suppkey % 6 + 1] AS st, (['plier', 'files', 'gel', 'liquid', 'tips', 'widget'])[p_size % 6 + 1] AS ft, (l_suppkey % 9 + 120) AS sn, (p_size % 9 + 120) AS fn, split_part(p_name, ' ', 1) AS word FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _gated(spark, sf) -> DataFrame:
    """Order lines as pairs of names whose types and numbers come from the seller and the part."""
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (F.col(at) % len(values) + 1).cast("int"))
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = {"st": of(("curette", "pliers", "mirror", "liquid", "powder", "kit"), "l_suppkey"), "ft": of(("plier", "files", "gel", "liquid", "tips", "widget"), "p_size"), "sn": (F.col("l_suppkey") % 9 + 120).cast("string"), "fn": (F.col("p_size") % 9 + 120).cast("string")}
    return rows.withColumns(kinds).select("l_orderkey", "l_linenumber", *(F.concat_ws(" ", F.lit("Acme"), F.split("p_name", " ")[0], f"{s}t", F.lit("no"), f"{s}n").alias(s) for s in ("s", "f")))


@query(f"WITH {_GATED} SELECT l_orderkey, l_linenumber, (st IN ('curette', 'pliers', 'mirror') AND ft IN ('plier', 'files') AND rtrim(st, 's') <> rtrim(ft, 's')) OR (st IN ('liquid', 'powder') AND ft IN ('gel', 'liquid') AND st <> ft) OR (st = 'kit' AND ft = 'tips') AS clash FROM g")
def gate_types(spark, sf):
    """Pairs whose product types exclude each other, plurals being the same type."""
    rows = _gated(spark, sf)
    return rows.select("l_orderkey", "l_linenumber", G.types_clash(N.words(F.col("s")), N.words(F.col("f"))).alias("clash"))


@query(f"WITH {_GATED} SELECT l_orderkey, l_linenumber, CASE WHEN sn <> fn THEN sn || ' vs ' || fn END AS clash FROM g")
def gate_numbers(spark, sf):
    """Pairs whose numbers have nothing in common."""
    return _gated(spark, sf).select("l_orderkey", "l_linenumber", G.number_clash(*(F.array_sort(A.serials(F.col(c))) for c in ("s", "f"))).alias("clash"))


@query("WITH p AS (SELECT DISTINCT l_suppkey, p_partkey, p_retailprice AS score, p_size % 3 > 0 AS fit, split_part(p_name, ' ', 2) = 'widget' AS shared FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, p_partkey) AS rank FROM p WHERE fit QUALIFY rank <= 5), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, p_partkey) AS rank FROM (SELECT * FROM p ANTI JOIN b USING (l_suppkey, p_partkey)) WHERE shared QUALIFY rank <= 2) SELECT l_suppkey, p_partkey, rank, false AS rescued FROM b UNION ALL SELECT l_suppkey, p_partkey, rank, true FROM r")
def rescue_union(spark, sf):
    """The five best parts of each supplier that fit, and of the others two that share a specific word."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    offered = rows.select("l_suppkey", "p_partkey", F.col("p_retailprice").alias("score"), F.when(F.col("p_size") % 3 > 0, "possible").otherwise("rejected").alias("verdict"), F.lit("Acme widget").alias("s_name"), F.col("p_name").alias("c_name")).distinct()
    best = pairs.top_with_rescue(offered, ["l_suppkey"], [F.desc("score"), F.col("p_partkey")], "p_partkey")
    return best.select("l_suppkey", "p_partkey", F.col("rank").cast("long").alias("rank"), "rescued")


@query(r"WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_retailprice AS listed, list_filter([(p_retailprice, 'alpha', 0), (l_extendedprice, 'beta', 1), (p_size * 10.0, 'Default Title', 2), (p_size - 25.0, 'gamma', 3)], lambda v: v[1] > 0 AND v[2] <> 'Default Title') AS v, (['beta', 'gamma', 'none'])[l_suppkey % 3 + 1] AS said FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN len(v) >= 2 AND len(list_filter(v, lambda x: x[2] = said)) > 0 THEN 'Acme ' || said ELSE 'Acme item' END AS name, CASE WHEN len(v) >= 2 AND len(list_filter(v, lambda x: x[2] = said)) > 0 THEN list_filter(v, lambda x: x[2] = said)[1][1] ELSE listed END AS price FROM c")
def variant_select(spark, sf):
    """Order lines as listings with several children, one of which the search may name."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    none = C.parse_spec(F.lit(""))
    child = lambda price, name: F.struct(F.lit(name).alias("name"), price.cast("double").alias("price"), none.alias("spec"))
    children = F.array(child(F.col("p_retailprice"), "Acme alpha"), child(F.col("l_extendedprice"), "Acme beta"), child(F.col("p_size") * 10, "Default Title"), child(F.col("p_size") - 25, "Acme gamma"))
    said = F.element_at(F.array(*map(F.lit, ("beta", "gamma", "none"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    listed = rows.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("s_id"), F.lit(0).alias("c_id"), F.concat(F.lit("Acme item "), said).alias("s_name"), F.col("l_extendedprice").alias("s_price"), F.lit("Acme item").alias("c_name"), F.col("p_retailprice").alias("c_price"), children.alias("variants"), none.alias("s_spec"), none.alias("c_spec"))
    return pairs.select_variant(listed).select("s_id.*", F.col("c_name").alias("name"), F.col("c_price").alias("price"))


@query()
def watchlist_fill(spark, sf):
    """The suppliers of one nation, filled up to fifty by a stable random order."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return registry.filled_to(s.where("s_nationkey = 1").select("s_suppkey"), s.select("s_suppkey"), "s_suppkey", 50)


@query("SELECT event_id, CASE WHEN m > p AND p > 0 THEN floor((m - p) / m * 100 + 0.5)::INTEGER ELSE 0 END AS discount FROM (SELECT event_id, value AS p, (user_id % 100)::DOUBLE AS m FROM events)")
def discounts(spark, sf):
    """Events as offers: what their value is below a list price."""
    return table(spark, sf, "events").select("event_id", P.discount(F.col("value"), (F.col("user_id") % 100).cast("double")).alias("discount"))


@query(r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '/+$', ''), ''), 'page ' || page_id) AS key FROM pages")
def candidate_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.candidate_key(F.col("url"), F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("key"))


@query("WITH w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - x * INTERVAL 6 HOUR AS start FROM events, range(0, 4) r(x)) SELECT start::TIMESTAMP AS start, user_id, count(*) AS n FROM w GROUP BY ALL")
def stream_sliding(spark, sf):
    """Complete mode: every window of a day that there is."""
    return E.finished(E.sliding_counts(E.source(spark, f"{sf}/events.parquet")), "complete")


@query("SELECT event_id, floor((value / q - 50.0 / r) * 100 + 0.5) / 100 AS difference FROM (SELECT event_id, value, user_id % 7 + 2 AS q, user_id % 5 + 2 AS r FROM events WHERE value > 0) WHERE q <> r")
def unit_differences(spark, sf):
    """Events as offers of packs: the difference of what a piece costs, where the packs differ."""
    e = table(spark, sf, "events").where("value > 0").withColumns({"q": F.col("user_id") % 7 + 2, "r": F.col("user_id") % 5 + 2})
    spec = lambda n: C.parse_spec(F.concat(F.col(n).cast("string"), F.lit(" capsules")))
    none = F.lit(None).cast("double")
    return e.where("q <> r").select("event_id", C.unit_difference(spec("q"), spec("r"), F.col("value"), F.lit(50.0), none, none).alias("difference"))
