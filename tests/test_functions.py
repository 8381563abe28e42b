"""Functions on names, pairs, compositions and pages: small stated cases."""

import json

import pytest
from pyspark.sql import functions as F

from pricelens.functions import attributes as A, gates as G, names as N, pages as P, similarity as S, specs as C
from pricelens.functions.search_queries import search_queries
from pricelens.operators import insights, pairs, registry
from pricelens.sources import files


def value(spark, make, *texts):
    """The expression's value for one row of strings."""
    row = spark.createDataFrame([tuple(texts)], ", ".join(f"_{i} string" for i in range(len(texts))))
    return row.select(make(*(F.col(f"_{i}") for i in range(len(texts)))).alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [
    ("Filtek Z350 XT - SKU: ABC123", "Filtek Z350 XT"), ("Tray (code: X-12/3)", "Tray"), ("Wire [MPN#998a]", "Wire"), ("Burs - Pack of 10", "Burs"), ("Gloves 100 pcs", "Gloves"), ("Mask - buy online", "Mask"),
    ("i-Scan  Pro", "iScan Pro"), ("Retractor - SDH101G", "Retractor - SDH101G"), ("", ""),
])
def test_normalize(spark, raw, want):
    assert value(spark, N.normalize, raw) == want


@pytest.mark.parametrize("raw, want", [("Retractor â€“ 50mm", "Retractor – 50mm"), ("40Âµ", "40µ"), ("plain", "plain"), ("Ünïcode", "Ünïcode"), (None, None)])
def test_mojibake(spark, raw, want):
    assert value(spark, N.fix_mojibake, raw) == want


def test_tokens(spark):
    assert value(spark, N.tokens, "150 MM x 200 m, No. 7 mtr9") == ["150mm", "x", "200m", "no", "7", "mtr9"]
    assert value(spark, N.distinguishing, "The Blue Dental Probe kit 15g") == ["probe", "15g"]
    assert value(spark, N.specific, "Excavator 1234567 probe") == ["excavator"]
    assert [value(spark, lambda c: N.stem(c), w) for w in ("tips", "gas", "glass", "reel")] == ["tip", "gas", "glass", "reel"]


@pytest.mark.parametrize("raw, want", [("LM-SlimLift X", "lm"), ("3M Filtek", "3m"), ("J Morita ZX", "morita"), ("D Speed film", "d"), ("Kids-e-Crown A1", "kidsecrown"), ("", "")])
def test_brand(spark, raw, want):
    assert value(spark, N.brand, raw) == want


def test_attributes(spark):
    a = value(spark, A.attributes, "Acme Composite A2 putty 37% size 25 Pack of 5 (Blue) .017 x .025 upper niti 0.018")
    assert (a.brand, a.shade, a.viscosity, a.concentration, a.iso_size, a.pack_count, a.colors, a.dimension, a.wire_form, a.material, a.slot) == ("acme", "a2", "putty", 37.0, 25, 5, ["blue"], "017x025", "upper", "niti", "018")
    assert value(spark, A.model_codes, "Silk 2-0 17 x 25 70 microns 3.5 oz 5/16 UDS E V2 DL-300") == ["dl-300", "2-0", "17x25", "70u", "3.5oz", "5/16", "ml_e", "v2"]
    assert [value(spark, A.attributes, n).tip_number for n in ("Excavator #6", "Excavator -1 EXC", "Excavator 3", "Pack of 3", "Code TR-13")] == [6, 1, 3, None, None]
    rich = value(spark, lambda n, d: A.rich_attributes(n, d, F.lit("")), "Composite", "shade A3 only, for A3 teeth")
    assert rich.shade == "a3" and value(spark, lambda n, d: A.rich_attributes(n, d, F.lit("")), "Composite", "A1, A2").shade is None


@pytest.mark.parametrize("raw, want", [("Burs pack of 12", 12), ("Scaler (8 tips free)", 1), ("Reel 150 mm x 200 m", 1), ("Brush x 10", 10), ("Net Quantity: 4 N", 4), ("plain", 1), ("pack of 1 with 6 blades", 6)])
def test_pack_size(spark, raw, want):
    assert value(spark, A.pack_size, raw) == want


PAIRS = [
    ("Acme Excavator -1 EXC32L", "Acme Excavator - 6 EXC32L", "tip number mismatch"), ("Acme Die Stone Brown", "Acme Die Stone Yellow", "colour mismatch"), ("Acme Flow Composite A2", "Acme Flow Composite A3", "shade mismatch"), ("Acme Composite A2", "Acme Composite A3", "no shared distinctive token"),
    ("Acme Forceps Small", "Other Forceps Small", "brand mismatch"), ("Acme Intraoral Mixing Tip", "Acme Extraoral Mixing Tip", "variant mismatch: intraoral vs extraoral"), ("Acme Curette Gracey", "Acme Probe Gracey", "incompatible product types"),
    ("Acme Tray Adeziv", "Acme Eazy Tray", "no shared distinctive token"), ("Acme Scanner DL-300", "Acme Scanner DL-500", "model code mismatch"), ("Acme Suture 2-0 Silk", "Acme Suture 5-0 Silk", "model code mismatch"),
    ("Morita Apex Locator", "Generic Apex Locator Cable For J-Morita", "brand mismatch"), ("Acme Gel Etchant 37%", "Acme Gel Etchant 35%", "concentration mismatch"),
    ("Acme Filtek Composite", "Acme Filtek Composite Syringe", None), ("Oracraft Mirror Handle", "Ora Craft Mirror Handle", None), ("3M ESPE Ketac Molar", "Ketac Molar", None), ("Acme Refill", "Acme Refills", None),
]


def test_gates(spark):
    frame = spark.createDataFrame(PAIRS, "s string, f string, want string")
    got = G.prepared(frame, "s", "f").select("s", "f", "want", G.gate_reason(F.col("s"), F.col("f")).alias("got")).collect()
    assert [(r.s, r.f) for r in got if not (r.got is None if r.want is None else (r.got or "").startswith(r.want))] == []


def test_similarity(spark):
    assert S.token_set_ratio("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat") == pytest.approx(0.92307692)
    assert S.token_set_ratio("a b", "b a") == 1 and S.token_set_ratio("", "x") == 0 and S.token_set_ratio("abc", "abc def") == 1
    assert value(spark, S.weighted_overlap, "Wizdent dental kit", "wizdent kit") == pytest.approx(1.1 / 1.2)
    assert value(spark, S.weighted_overlap, "", "x") == 0
    same = value(spark, lambda a, b: S.sparse_dot(S.embed(a), S.embed(b)), "Composite resin", "composite RESIN")
    assert same == pytest.approx(1) and value(spark, lambda a, b: S.sparse_dot(S.embed(a), S.embed(b)), "Composite resin", "steel wire") < 0.5
    assert [value(spark, lambda c: S.verdict(c.cast("double")), x) for x in ("0.75", "0.62", "0.45", "0.44")] == ["confirmed", "possible", "variant", "rejected"]


def test_specs(spark):
    a = value(spark, C.parse_spec, "Cement Extra 15 g Powder + 13.1 g (10.5mL) Liquid, pack of 2")
    assert (a.powder_g, a.liquid_g, a.liquid_ml, a.pieces, a.is_extra) == (15.0, 13.1, 10.5, 2.0, True)
    compare = lambda x, y: value(spark, lambda p, q: C.compare_specs(C.parse_spec(p), C.parse_spec(q)), x, y)
    assert compare("15 g powder", "15.2 g powder") == "exact" and compare("15 g powder", "5 g powder") == "different-size" and compare("15 g powder", "30 g powder") == "same-tier"
    assert compare("Extra 15 g powder", "15 g powder") == "different-formulation" and compare("x", "15 g powder") == "unknown"
    assert value(spark, lambda c: C.describe(C.parse_spec(c)), "premium 5 g powder") == "premium + 5g powder" and value(spark, lambda c: C.base_quantity(C.parse_spec(c))["unit"], "30 capsules") == "capsule"


def test_pages(spark):
    assert value(spark, P.canonical_url, "http://a/b/?x#y") == "http://a/b" and value(spark, P.plain_text, "<p>A&nbsp;b</p><br/>c") == "A b. c"
    assert [value(spark, P.amount, x) for x in ("₹1,234.50", "free", "-5")] == [1234.5, 0.0, 0.0] and value(spark, P.first_of_range, "Rs. 120 - 300") == 120
    assert value(spark, P.is_product_page, "https://a.in/uv-cabinets") is False and value(spark, P.is_product_page, "https://a.in/probe-7.html") is True
    node = {"@graph": [{"@type": ["Thing"]}, {"@type": "http://schema.org/Product", "Name": "Probe &amp; tip", "image": [{"url": "i.png"}], "offers": [{"lowprice": 0}, {"lowPrice": "1,250", "highprice": 1500, "priceCurrency": "inr", "availability": "http://schema.org/InStock"}], "hasVariant": [{"name": "a", "offers": {"price": 3}}, {"name": "b"}]}]}
    html = f"<script type='application/ld+json'>/* c */ {json.dumps(node)[:-1]},}}</script>"
    p = value(spark, P.structured_product, html)
    assert (p.name, p.price, p.mrp, p.currency, p.in_stock, p.image, [v.name for v in p.variants]) == ("Probe & tip", 1250.0, 1500.0, "INR", True, "i.png", ["a"])
    assert value(spark, P.structured_product, None).name is None


def test_search_queries(spark):
    got = value(spark, search_queries, "GDC Gracey Curette AFX51A (S5083) Pack of 5")
    assert got[0] == "GDC Gracey curette" or got[0].startswith("GDC Gracey") and len({q.lower() for q in got}) == len(got)
    assert value(spark, search_queries, "") == []
    assert value(spark, search_queries, "GDC Stainless Steel Explorer Probe 17")[0] == "GDC Probe explorer"
    assert value(spark, search_queries, "Acme Probe AB-1234 (XY-99)")[:7] == ["Acme AB probe", "Acme probe", "Acme AB", "Acme AB-1234", "AB-1234", "Acme XY-99", "XY-99"]
    assert value(spark, lambda n, d: search_queries(n, packaging=d), "Acme Zorb", "box of forceps")[0] == "Acme Zorb forceps"
    assert value(spark, lambda n, m: search_queries(n, maker=m), "12", "Maker Inc") == ["Maker"]


def test_registry(spark):
    old = spark.createDataFrame([(1, "human_verified", "confirmed", "x"), (2, "active", "possible", "y"), (3, "killed", "possible", None)], "k int, status string, verdict string, note string")
    new = spark.createDataFrame([(1, "active", "rejected", "n"), (2, "active", "confirmed", None), (3, "active", "confirmed", "n"), (4, "active", "variant", None), (None, "active", "variant", None)], old.schema)
    got = {r.k: (r.status, r.verdict, r.note) for r in registry.merge_links(old, new, ["k"], filled=("note",)).collect()}
    assert got == {1: ("human_verified", "confirmed", "x"), 2: ("active", "confirmed", "y"), 3: ("killed", "possible", None), 4: ("active", "variant", None)}
    assert {r.k: r.verdict for r in registry.upsert(old, new, ["k"]).collect()} == {1: "rejected", 2: "confirmed", 3: "confirmed", 4: "variant"}
    runs = spark.createDataFrame([(1, False, None), (2, True, 1), (3, True, 2), (4, True, 5), (5, True, 4)], "run_id int, special boolean, source_run_id int")
    assert {(r.run_id, r.ancestor) for r in registry.ancestor(spark, runs).collect()} == {(2, 1), (3, 1)}


def test_positions(spark):
    own = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0), (4, 100.0), (5, 0.0)], "product int, own double")
    offers = spark.createDataFrame([(1, 74.0, False), (1, 500.0, True), (2, 126.0, False), (3, 125.0, False), (3, 75.0, False)], "product int, price double, kept boolean")
    got = {r["product"]: r for r in insights.price_positions(own, offers).collect()}
    assert {k: r["bucket"] for k, r in got.items()} == {1: "overpriced", 2: "cheapest", 3: "parity", 4: "monopoly"}
    assert got[1]["cut"] == 26 and got[2]["headroom"] == 26 and not got[1]["review"]


def test_variant_choice(spark):
    text = "s_id int, c_id int, s_name string, s_price double, c_name string, c_price double, variants array<struct<name:string,price:double,text:string>>"
    rows = [(1, 1, "Acme Wire 016 x 022 Upper", 100.0, "Acme Wires", 90.0, [("016 x 022 Lower", 99.0, ""), ("016 x 022 Upper", 120.0, ""), ("Default Title", 5.0, "")]), (2, 2, "Acme Wire", 100.0, "Acme Wire", 90.0, [("Red", 1.0, ""), ("Blue", 2.0, "")]), (3, 3, "Acme", 1.0, "Acme", 1.0, None)]
    frame = spark.createDataFrame(rows, text).withColumn("s_spec", C.parse_spec(F.lit(""))).withColumn("c_spec", C.parse_spec(F.lit("")))
    frame = frame.withColumn("variants", F.transform("variants", lambda v: F.struct(v["name"].alias("name"), v["price"].alias("price"), C.parse_spec(v["text"]).alias("spec"))))
    got = {r.s_id: (r.c_name, r.c_price, r.pinned) for r in pairs.select_variant(frame).collect()}
    assert got == {1: ("016 x 022 Upper", 120.0, True), 2: ("Acme Wire", 90.0, False), 3: ("Acme", 1.0, False)}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Sku,Product Name\n1,Probe\n2,\n3,\"Tray, big\"\n")
    (tmp_path / "b.csv").write_text("Probe\nTray\n")
    assert sorted(r.name for r in files.read_names(spark, str(tmp_path / "a.csv")).collect()) == ["Probe", "Tray, big"]
    assert sorted(r.name for r in files.read_names(spark, str(tmp_path / "b.csv")).collect()) == ["Probe", "Tray"]
    assert {r.brand for r in files.read_catalogue(spark, str(tmp_path / "a.csv")).collect()} == {"probe", "tray,"}
    (tmp_path / "s.xml").write_text("<loc>http://a/x-probe_7.html</loc><loc>http://a/c/y.html</loc><loc>http://a/z</loc>")
    assert [tuple(r) for r in files.read_sitemaps(spark, str(tmp_path / "s.xml")).collect()] == [("http://a/x-probe_7.html", "x probe 7")]


def test_ancestors_of_any_depth(spark):
    """A chain of forty special runs leads to the ordinary one at its end; a circle and an unknown source lead nowhere."""
    rows = [(0, False, None), *((i, True, i - 1) for i in range(1, 41)), (50, True, 51), (51, True, 50), (60, True, 99), (70, False, 40)]
    runs = spark.createDataFrame(rows, "run_id int, special boolean, source_run_id int")
    assert {(r.run_id, r.ancestor) for r in registry.ancestor(spark, runs).collect()} == {*((i, 0) for i in range(1, 41)), (70, 0)}
    assert registry.ancestor(spark, runs.limit(0)).count() == 0


def test_searches_without_tokens_keep_all(spark):
    found = spark.createDataFrame([("a", "Probe"), ("a", "Mirror"), ("b", "Probe"), ("b", "Mirror"), ("c", "Probe")], "g string, name string")
    asked = spark.createDataFrame([("a", "the new"), ("b", "Acme Probe"), ("b", "the")], "g string, name string")
    assert sorted(tuple(r) for r in pairs.prefilter(found, asked, ["g"]).collect()) == [("a", "Mirror"), ("a", "Probe"), ("b", "Probe")]
    assert pairs.prefilter(found.drop("g"), asked.where("g = 'a'").drop("g"), []).count() == 2
    left, right = asked.withColumn("search_id", F.monotonically_increasing_id()), found.withColumn("candidate_id", F.monotonically_increasing_id())
    met = sorted((r.s_name, r.c_name) for r in pairs.block(left, right, ["g"]).collect())
    assert met == [("Acme Probe", "Probe"), ("the", "Mirror"), ("the", "Probe"), ("the new", "Mirror"), ("the new", "Probe")]


@pytest.mark.parametrize("name", ["Émail Diamant Paste", "Ünique Brush Soft", "Ören Tray"])
def test_brands_of_any_alphabet_fit_themselves(spark, name):
    frame = G.prepared(spark.createDataFrame([(name, name)], "s string, f string"), "s", "f")
    assert frame.select(G.gate_reason(F.col("s"), F.col("f")).alias("v")).first()["v"] is None


@pytest.mark.parametrize("raw, want", [("Acme Tray   big", "Acme Tray big"), ("Retractor â€“ 50mm", "Retractor – 50mm"), ("Müller â€“  x", "Müller â€“ x")])
def test_normal_form_of_odd_text(spark, raw, want):
    assert value(spark, N.normalize, raw) == want


def test_best_cell_takes_verdict_then_confidence_then_place(spark):
    rows = [("p", "possible", 0.9, 1, "x"), ("p", "confirmed", 0.5, 2, "y"), ("p", "confirmed", 0.7, 4, "z"), ("p", "confirmed", 0.7, 3, "w"), ("q", "rejected", None, 1, "v")]
    got = pairs.best_cell(spark.createDataFrame(rows, "k string, verdict string, confidence double, position int, note string"), ["k"], "position")
    assert {r.k: r.note for r in got.collect()} == {"p": "w", "q": "v"}
