"""Discovery, runs and merchants on small stated cases."""

import pytest
from pyspark.sql import functions as F

from pricelens.functions import names as N, pages as P, similarity as S, specs as C
from pricelens.operators import discovery, merchants, runs, vectors

FIELDS = "name string, description string, packaging string, price double, unit_price double, pack_size int"


def records(spark, rows, keys):
    """Rows of keys and :data:`FIELDS`, with compositions and no variants."""
    frame = spark.createDataFrame(rows, f"{keys}, {FIELDS}")
    child = F.struct(F.lit("").alias("name"), F.lit(0.0).alias("price"), C.parse_spec(F.lit("")).alias("spec"))
    return frame.withColumns({"spec": C.parse_spec(F.col("name")), "variants": F.array(child)})


@pytest.fixture
def found(spark):
    """One product in packs of fifty; four candidates of two sellers, of which one is killed and one has no price."""
    searches = records(spark, [("s", "Acme Tofflemire Matrix Bands", "Steel matrix bands for molars", "", 2297.0, 45.94, 50)], "search_id string").drop("variants")
    cards = records(spark, [
        ("a", "u1", 1, "Acme Tofflemire Matrix Bands", "", "", 2236.0, 223.6, 10), ("a", "u2", 2, "Acme Matrix Band Retainer", "", "", 900.0, 900.0, 1), ("a", "u3", 3, "Acme Tofflemire Matrix Bands", "", "", 0.0, 0.0, 1),
        ("b", "u4", 1, "Acme Tofflemire Matrix Bands Killed", "", "", 2100.0, 42.0, 50), ("b", "u5", 2, "Other Gloves Large", "", "", 100.0, 100.0, 1),
    ], "seller string, url string, position int")
    pages = records(spark, [("u1", "u1", "Acme Tofflemire Matrix Bands", "Steel matrix bands for molars", "", 2236.0, 223.6, 10)], "url string, canonical string")
    killed = spark.createDataFrame([("s", "u4")], "search_id string, url string")
    said = spark.createDataFrame([], "search_id string, url string, same_product boolean, same_variant boolean, sure double")
    return searches, cards, pages, killed, said


def test_discover(found):
    got = {(r.search_id, r.seller): r for r in discovery.discover(*found, []).collect()}
    assert set(got) == {("s", "a")}
    cell = got["s", "a"]
    assert cell.url == "u1" and cell.pack_note == "50/pack vs 10/pack" and cell.verdict in ("confirmed", "possible") and cell.matched_by == "rules" and cell.price == 2236.0


def test_discover_asks_the_judge_and_respects_canonical_kills(spark, found):
    searches, cards, pages, killed, said = found
    thin = pages.limit(0)
    judge = spark.createDataFrame([("s", "u1", True, False, 0.6)], said.schema)
    got = discovery.discover(searches, cards, thin, killed, judge, []).collect()
    assert [(r.url, r.verdict, r.matched_by, r.confidence) for r in got if r.url == "u1"] in ([("u1", "variant", "judge", 0.6)], [("u1", "possible", "rules", got[0].confidence)])
    moved = pages.withColumn("canonical", F.lit("u9"))
    assert not [r for r in discovery.discover(searches, cards, moved, killed.union(spark.createDataFrame([("s", "u9")], killed.schema)), said, []).collect() if r.url in ("u1", "u9")]
    assert discovery.discover(searches.limit(0), cards, pages, killed, said, []).count() == 0


def test_self_match_and_input(spark):
    rows = [("s", "Acme Root ZX Mini", "Acme Root ZX Mini", 0.80, 1), ("s", "Acme Root ZX Mini", "Acme Root ZX Mini Refurbished Combo", 0.85, 0), ("t", "x", "y", None, 0)]
    got = discovery.best_self_match(spark.createDataFrame(rows, "search_id string, s_name string, c_name string, score double, position int")).collect()
    assert [r.search_id for r in got] == ["s"]
    frame = spark.createDataFrame([("Acme Suture 2-0 Silk", "Acme Suture 2-0"), ("Acme Suture 2-0 Silk", "Acme Suture 5-0"), ("Acme Probe", "Acme Mirror"), ("Acme Wire Upper 016", "Acme Wire Lower 016")], "a string, b string")
    assert [r.v for r in frame.select(discovery.carries_input(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, True, False]


def test_runs(spark):
    runs_ = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-03-01 00:00:00"), (3, None)], "run_id int, at string").withColumn("started_at", F.col("at").cast("timestamp"))
    reviews = spark.createDataFrame([(1, True), (1, False), (1, None), (9, True)], "run_id int, correct boolean")
    assert {(r.run_id, r.reviews, r.right, r.accuracy) for r in runs.with_review_summary(runs_, reviews).collect()} == {(1, 2, 1, 50.0), (2, 0, 0, None), (3, 0, 0, None)}
    now = F.lit("2024-03-31 00:00:00").cast("timestamp")
    assert sorted(r.run_id for r in runs.kept_runs(runs_, now, 30).collect()) == [2, 3]
    text = "product string, correct boolean, reviewed_at int, offers array<struct<seller:string,url:string,name:string,price:double,note:string>>"
    said = [("p", True, 1, [("a", "u1", "n", 1.0, None), ("b", "u2", "n", None, None), ("c", "u3", "n", 1.0, "why")]), ("p", True, 2, [("a", "u4", "m", 2.0, "")]), ("q", False, 1, [("a", "u5", "n", 1.0, None)]), ("", True, 1, [("a", "u", "n", 1.0, None)]), ("r", True, 1, None)]
    assert {tuple(r) for r in runs.learned_links(spark.createDataFrame(said, text)).collect()} == {("p", "a", "u4", "m")}


def test_merchants(spark):
    names = spark.createDataFrame([("Acme Store",), ("www",), ("https://acmestore.co.in/x",), ("",), (None,)], "merchant string")
    got = [r.v for r in names.select(merchants.known_seller(F.col("merchant"), {"acmestore.com": "acme", "other.in": "other"}).alias("v")).collect()]
    assert got == ["acme", None, "acme", None, None]
    seen = spark.createDataFrame([("s", "B.com", 1), ("s", "A.com", 2), ("s", "b.com", 3), ("s", "C.com", 4), ("s", " ", 5)], "s string, merchant string, position int")
    base = spark.createDataFrame([("c.com", 1), ("d.com", 2)], "merchant string, base_position int")
    assert [(r.key, r.found, r.place) for r in merchants.merchant_list(seen, base, ["s"], 2).orderBy("place").collect()] == [("b", True, 1), ("a", True, 2), ("c", True, 3), ("d", False, 4)]
    links = spark.createDataFrame([("s", "http://a/x-probe?u=1", 2, "Acme Probe"), ("s", "http://a/x-probe?u=2", 1, "Acme Probe"), ("s", "http://a/acme-probe.html", 3, "Acme Probe"), ("s", "http://a/z", 0, "Acme Probe")], "s string, url string, position int, name string")
    assert [(r.url, r.shared) for r in merchants.ordered_links(links, ["s"], "name").orderBy("place").collect()] == [("http://a/acme-probe.html", 2), ("http://a/x-probe", 1), ("http://a/z", 0)]


def test_small_functions(spark):
    one = lambda make, x: spark.createDataFrame([(x,)], "x string").select(make(F.col("x")).alias("v")).first()["v"]
    assert [one(N.looks_like_code, x) for x in ("5527/002/E", "KGF 9", "11.5cm", "Pack of 300 sheets", "11.5 cm", "plain", "", None, "1" * 25)] == [True, True, True, False, False, False, False, False, False]
    image = lambda x: one(lambda c: P.image_url(c, "https://m.example.org", "media/p", ("img1.example.org",)), x)
    assert [image(x) for x in (None, "", "/a.png", "media/p/a.png", "//x.org/a.png", "http://img1.example.org/b.png", "https://m.example.org/media/p/c.png")] == ["", "", "https://m.example.org/media/p/a.png", "https://m.example.org/media/p/a.png", "https://x.org/a.png", "https://m.example.org/media/p/b.png", "https://m.example.org/media/p/c.png"]
    assert one(P.sibling_urls, "http://a/b.html?x=1") == ["http://a/b.html?x=1", "http://a/b-1.html?x=1", "http://a/b-2.html?x=1", "http://a/b-3.html?x=1"] and one(P.sibling_urls, "http://a/b") == ["http://a/b"]
    assert one(P.is_missing_page, "<title> Product not found </title>") is True and one(P.is_missing_page, None) is False
    said = spark.range(1).select(S.reasons(F.lit(0.5), F.lit(1.0), F.lit(0.25), F.lit(None).cast("double"), F.lit(0.3), F.lit(0.8)).alias("v")).first()["v"]
    assert said == ["cosine=0.500", "brand=1", "pack=0.25", "token=0.30", "fuzz=0.80"]


def test_nearest_is_exact_in_blocks(spark, monkeypatch):
    """Small blocks and chunks, ties, nulls and fewer vectors than wanted give what all pairs give."""
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "CHUNK", 5)
    rows = [(i, [float(i % 4), float(i % 3), 1.0]) for i in range(40)] + [(None, [1.0, 1.0, 1.0]), (99, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in vectors.nearest(frame.where("vec_id % 5 = 0"), frame, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbour_id, r.similarity))
    known = [(i, v) for i, v in rows if i is not None and v is not None]
    for q, v in known:
        if q % 5 == 0:
            want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in known if i != q)[:7]
            assert [(n, s) for _, n, s in sorted(got[q])] == [(i, -s) for s, i in want]
    assert set(got) == {i for i, _ in known if i % 5 == 0}
    assert vectors.nearest(frame.limit(0), frame, 3).count() == 0 and vectors.nearest(frame.where("vec_id = 0"), frame.limit(0), 3).count() == 0


def test_names_of_groups_and_codes_in_parentheses(spark):
    one = lambda make, x: spark.createDataFrame([(x,)], "x string").select(make(F.col("x")).alias("v")).first()["v"]
    assert [one(N.base_name, x) for x in ("Acme Bur Set of 12", "Acme Strip 10mm Small", "Acme Root-Pin Premium with Ratchet", "Acme Tip AX12")] == ["Acme Bur", "Acme Strip", "Acme RootPin", "Acme Tip"]
    assert [one(N.paren_code, x) for x in ("Probe (A) (KGF  9)", "Probe", "Probe ( )", None)] == ["kgf 9", None, None, None]


def test_files_of_items_and_samples(spark, tmp_path):
    from pricelens.sources import files

    rows = [(1, "a", "A"), (1, "a", "A"), (0, "b", "B"), (1, "", "C"), (1, "d", None), (1, "e", "E"), (1, "f", "F")]
    frame = spark.createDataFrame(rows, "status int, sku string, name string")
    picked = [r.sku for r in files.sample_products(frame, 2, 7).collect()]
    assert len(picked) == 2 and set(picked) < {"a", "e", "f"} and picked == [r.sku for r in files.sample_products(frame, 2, 7).collect()]
    assert len(files.sample_products(frame, 9, 7).collect()) == 3
    old = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "run_id int, idx int, note string")
    new = spark.createDataFrame([(1, 1, "z"), (2, 0, "w"), (None, 0, "v")], old.schema)
    assert sorted(tuple(r) for r in files.save_items(old, new).collect()) == [(1, 0, "x"), (1, 1, "z"), (2, 0, "w")]
    files.write_results(old, f"{tmp_path}/out")
    assert sorted(r.note for r in spark.read.json(f"{tmp_path}/out").collect()) == ["x", "y"]
