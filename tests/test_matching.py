"""Anchor resolution, child choice, merchants and the ranking of matches, on planted cases and against plain Python."""

import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pricelens.functions import names as N, vocabulary as V
from pricelens.functions.specs import parse_spec
from pricelens.operators import anchors, merchant_compare, pairs
from pricelens.plans import queries as Q

KIN = "array<struct<name:string,price:double,mrp:double,pack_size:int,unit_price:double,image:string,in_stock:boolean,sku:string>>"


def kin(*names):
    return [(n, 100.0 + i, None, 1, 100.0 + i, None, True, str(i)) for i, n in enumerate(names)]


def with_specs(frame):
    return frame.withColumn("variants", F.transform("variants", lambda v: F.struct(*(v[f].alias(f) for f in ("name", "price", "mrp", "pack_size", "unit_price", "image", "in_stock", "sku")), parse_spec(v["name"]).alias("spec"))))


def test_pick_child(spark):
    cases = [
        (1, "Acme Fine Forceps - Angled 45 (041D)", "Acme Forceps (AC 041)", ["Acme Tooth Forceps - Angled (041D)", "Acme Fine Forceps - Angled 45 (041D)", "Acme Forceps (042D)"], "code", 1),
        (2, "Acme Screw 1.4mm (Pack of 5)", "Acme Screw 1.4mm (Pack of 5)", ["Acme Screw 1.4mm x 3mm (SD-030) - Pack of 5", "Acme Screw 1.4mm x 4mm (SD-040) - Pack of 5"], None, None),
        (3, "Acme Stone Green - SDH101G", "Acme Stones For Polishing", ["Acme Stone Green - SDH081G", "Acme Stone Green - SDH101G"], "words", 1),
        (4, "Acme Points 2% #80", "Acme Points 2%", ["Acme Points 2% #45-80", "Acme Points 2% #80"], "ratio", 1),
        (5, "Acme Kit Premium", "Acme Kit", ["Acme Kit Basic", "Acme Kit Premium", "Acme Kit Premium Torque"], "configuration", 1),
        (6, "Acme Kit Deluxe", "Acme Kit", ["Acme Kit Basic", "Acme Kit Premium"], None, None),
        (7, "Acme Cement Extra", "Acme Cement", ["Acme Cement 15 g", "Acme Cement Extra 15 g"], "configuration", 1),
        (8, "Acme Cement", "Acme Cement", ["Acme Cement 15 g", "Acme Cement 30 g"], None, None),
        (9, "Acme Tube blue", "Acme Tube", ["Acme Tube red", "Acme Tube green"], None, None),
        (10, "Acme Tube blue", "Acme Tube", ["Acme blue Tube", "Acme Tube blue"], None, None),
        (11, "Acme Tube", None, [], None, None), (12, "Acme Tube", "x", None, None, None),
    ]
    frame = with_specs(spark.createDataFrame([(i, n, p, v if v is None else kin(*v)) for i, n, p, v, _, _ in cases], f"id int, name string, parent string, variants {KIN}"))
    got = {r.id: (r.chosen_by, None if r.child is None else r.child.name) for r in anchors.pick_child(frame).collect()}
    assert got == {i: (step, None if at is None else v[at]) for i, _, _, v, step, at in cases}


def test_resolve_anchors(spark):
    hit = "id int, position int, url string, name string, price double"
    asked = spark.createDataFrame([(1, "Acme Probe (PX 11)"), (2, "Acme Screening Probe Long - PCP11"), (3, "Bolt Mirror"), (4, "Acme Retractor Size 12"), (5, "Acme Loupe"), (6, "Other Brand (PX 11)"), (7, "Acme Gauge (GA 77)")], "id int, name string")
    hits = spark.createDataFrame([
        (1, 0, "u1", "Acme Probe Set", 10.0), (1, 1, "u2", "Acme Probe Single", 11.0), (2, 0, "u2", "Acme Probe Single", 11.0), (2, 1, "u3", "Acme Periodontal Probes", 12.0), (3, 0, "u1", "Acme Probe Set", 10.0),
        (4, 0, "u4", "Acme Retractor", 13.0), (5, 0, "u5", "Acme Loupe", 14.0), (5, 1, "u6", "Acme Loupe", 15.0), (6, 0, "u1", "Acme Probe Set", 10.0), (7, 0, "u7", "Acme Gauge (GA 77)", 9.0), (7, 1, "u8", None, 9.0),
    ], hit).withColumn("spec", parse_spec(F.col("name")))
    page = "url string, name string, price double, mrp double, pack_size int, unit_price double, image string, in_stock boolean, sku string, description string, packaging string, variants " + KIN
    rows = [("u1", "Acme Probe Set", *kin("Acme Probe (PX 10)", "Acme Probe (PX 11)")), ("u2", "Acme Probe Single",), ("u3", "Acme Periodontal Probes", *kin("Acme Screening Probe Long - PCP11", "Acme Screening Probe Long - PCP12")), ("u4", "Acme Retractor", *kin("Acme Retractor Size 10", "Acme Retractor Size 12")), ("u7", "Acme Gauge (GA 77)")]
    pages = with_specs(spark.createDataFrame([(u, n, 50.0, 60.0, 2, 25.0, "i", True, "s", "", "", list(v)) for u, n, *v in rows], page)).withColumn("spec", parse_spec(F.col("name")))
    got = {r.id: (r.step, r.name, r.price, r.url) for r in anchors.resolve_anchors(asked, hits, pages).collect()}
    assert got == {
        1: ("code", "Acme Probe (PX 11)", 101.0, "u1"), 2: ("child name", "Acme Screening Probe Long - PCP11", 100.0, "u3"), 3: (None, None, None, None), 4: ("child name", "Acme Retractor Size 12", 101.0, "u4"), 5: ("card", "Acme Loupe", 14.0, "u5"),
        6: (None, None, None, None), 7: ("code", "Acme Gauge (GA 77)", 50.0, "u7"),
    }
    assert anchors.resolve_anchors(asked.limit(0), hits, pages).count() == 0 and anchors.resolve_anchors(asked, hits.limit(0), pages).where("step is not null").count() == 0


def test_asked_queries_and_pool(spark):
    said = lambda t: spark.createDataFrame([(t,)], "t string").select(anchors.asked_queries(F.col("t")).alias("q")).first().q
    assert said("Acme Bur Set of 12") == ["Acme Bur Set of 12", "Acme Bur"] and said("Acme Bur") == ["Acme Bur"] and said("ab") == []
    hits = spark.createDataFrame([(1, 1, 0, "a", "late"), (1, 0, 5, "a", "first"), (1, 0, 1, "b", "b"), (1, 2, 0, "", "none"), (1, 2, 1, None, "none"), (2, 0, 0, "a", "other")], "s int, query int, position int, url string, note string")
    assert sorted((r.s, r.position, r.url, r.note) for r in anchors.pooled(hits, ["s"]).collect()) == [(1, 0, "b", "b"), (1, 1, "a", "first"), (2, 0, "a", "other")]


def test_answers_of_any_shape(spark):
    rows = [(1, "organic", '{"organic_results":[{"link":"https://www.A.in/x","title":"t"},7,{"title":"u"}]}'), (1, "shopping", '{"shopping_results":[{"source":" B ","extracted_price":5},{"source":"","extracted_price":"6"}]}'), (1, "stores", '{"product_results":{"stores":[{"name":"C","direct_link":"http://c.in/1"}]}}'),
            (2, "organic", "no json"), (2, "shopping", '{"shopping_results":{}}'), (2, "stores", None), (2, "odd", "{}"), (3, "stores", "[]")]
    got = merchant_compare.merged_answers(spark, spark.createDataFrame(rows, "s int, kind string, body string"), ["s"]).collect()
    assert sorted(((r.kind, r.position, r.merchant, r.url, r.price) for r in got), key=str) == sorted([("organic", 0, "a.in", "https://www.A.in/x", None), ("organic", 2, None, None, None), ("shopping", 0, "B", None, 5.0), ("shopping", 1, None, None, 6.0), ("stores", 0, "C", "http://c.in/1", None)], key=str)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def brute_fuzz(a, b):
    x, y = set(a.split()), set(b.split())
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not left or not right):
        return 1.0
    forms = [f"{shared} {left}".strip(), f"{shared} {right}".strip()]
    ratio = lambda p, q: 1 - (len(p) + len(q) - 2 * lcs(p, q)) / (len(p) + len(q))
    best = ratio(*forms)
    return max([best, *((ratio(shared, f) for f in forms) if shared else [])])


def brute_cells(name):
    low = f" {name.lower()} "
    units = "|".join(sorted(V.UNITS, key=len, reverse=True))
    tokens = re.findall("[a-z0-9]+", re.sub(rf"(?<![a-z0-9])([0-9]+)[^a-z0-9]+({units})(?![a-z0-9])", r"\1\2", name.lower()))
    cells = {}
    for t in tokens + [low[i : i + 3] for i in range(max(len(low) - 2, 1))]:
        k = xxhash.xxh64(t, seed=42).intdigest()
        k = (k - 2**64 if k >= 2**63 else k) % 384
        cells[k] = cells.get(k, 0) + 1
    norm = sum(v * v for v in cells.values()) ** 0.5
    return {k: v / norm for k, v in cells.items()}, set(tokens)


def test_match_rank_against_plain_python(spark, sf):
    named = Q._pairs(spark, sf).select(F.col("s_search_id").alias("s"), F.col("c_candidate_id").alias("c"), "s_name", "c_name", N.normalize(F.col("s_name")).alias("sn"), N.normalize(F.col("c_name")).alias("cn")).collect()
    gates = {(r.search_id, r.candidate_id): r.gate for r in Q.pair_features(spark, sf).collect()}
    assert len(named) == len(gates) > 200
    scored = {}
    for r in named:
        if gates[r.s, r.c] is not None:
            continue
        (va, ta), (vb, tb) = brute_cells(r.sn), brute_cells(r.cn)
        weight = lambda s: sum(1 if t in V.STOPWORDS else 10 for t in s)
        parts = {"cosine": sum(x * vb.get(k, 0.0) for k, x in va.items()), "token": weight(ta & tb) / weight(ta | tb), "fuzz": brute_fuzz(r.sn, r.cn), "brand": 1.0, "pack": 1.0, "attr": 1.0}
        scored[r.s, r.c] = sum(V.WEIGHTS[k] * v for k, v in parts.items())
    by = {}
    for (s, c), v in scored.items():
        by.setdefault(s, []).append((-int(v * 1e6 + 1e-7), c))
    got = {(r.search_id, r.candidate_id): r for r in Q.match_rank(spark, sf).collect()}
    for (s, c), r in got.items():
        assert r.gate == gates[s, c]
        if r.gate is None:
            assert r.score == pytest.approx(scored[s, c], abs=2e-6)
            assert r.verdict == ("confirmed" if scored[s, c] >= V.CONFIRMED else "possible" if scored[s, c] >= V.POSSIBLE else "variant" if scored[s, c] >= V.VARIANT else "rejected")
    for s, rows in by.items():
        good = [c for _, c in sorted(rows) if scored[s, c] >= V.VARIANT][: V.TOP]
        assert {c for (q, c), r in got.items() if q == s and not r.rescued} == set(good)


def test_traits_of_descriptions(spark):
    """The brand that only a description names, and one that the item merely fits."""
    rows = [("Acme Tip Scaler", "Scaler Tip", "by Acme, for all units", None), ("Acme Tip Scaler", "Scaler Tip", "good quality tip suitable for acme units", "brand mismatch"), ("Acme Tip Scaler", "Scaler Tip", None, "brand mismatch"), ("Dental Probe", "Dental Probe x", "", None)]
    frame = spark.createDataFrame(rows, "s_name string, c_name string, c_description string, want string").withColumns({f"{a}_{b}": F.lit(v) for a in "sc" for b, v in (("packaging", ""), ("price", 5.0), ("unit_price", 5.0), ("pack_size", 1))} | {"s_description": F.lit("d")}).withColumns({"s_spec": parse_spec(F.lit("")), "c_spec": parse_spec(F.lit(""))})
    for r in pairs.structured_match(frame).collect():
        assert (r.reason or "").startswith(r.want or "") and ((r.reason or "").startswith("brand mismatch") == (r.want is not None))


def test_compare_searches_for_what_the_name_asks(spark):
    """A resolved product that carries the name's code is the search; one of another code gives way to the name, without an own price."""
    asked = spark.createDataFrame([(1, "Acme Suture Reel DL-300"), (2, "Acme Suture Reel DL-400")], "id int, name string")
    fields = "id int, step string, url string, name string, price double, mrp double, pack_size int, unit_price double, image string, in_stock boolean, sku string, description string, packaging string"
    found = spark.createDataFrame([(i, "listing", "own", "Acme Suture Reel DL-300", 2297.0, None, 50, 45.94, None, True, "s", "fine reel", "box") for i in (1, 2)], fields).withColumn("spec", parse_spec(F.lit("")))
    kin_ = F.expr("CAST(array() AS array<struct<name:string,price:double,spec:struct<powder_g:double,liquid_g:double,liquid_ml:double,capsules:double,pieces:double,is_extra:boolean,size_tier:string,kit_tier:string,torque:string>>>)")
    rich = lambda frame: frame.withColumns({"description": F.lit("fine reel"), "packaging": F.lit("box"), "unit_price": F.col("price") / F.col("pack_size"), "spec": parse_spec(F.lit("")), "variants": kin_})
    cards = rich(spark.createDataFrame([("x", "u3", 0, "Acme Suture Reel DL-300", 2236.0, 10), ("x", "u4", 1, "Acme Suture Reel DL-400", 2500.0, 50)], "seller string, url string, position int, name string, price double, pack_size int"))
    pages = cards.drop("seller", "position").withColumn("canonical", F.col("url"))
    killed = spark.createDataFrame([], "search_id int, url string")
    judged = spark.createDataFrame([], "search_id int, url string, same_product boolean, same_variant boolean, sure double")
    got = {r.search_id: r for r in anchors.compare(asked, found, cards, pages, killed, judged).collect()}
    assert (got[1].anchored, got[1].url, got[1].price_difference, got[1].pack_note) == (True, "u3", 61.0, "50/pack vs 10/pack")
    assert got[1].unit_difference == pytest.approx(45.94 - 223.6, abs=0.006)
    assert (got[2].anchored, got[2].url, got[2].own_price, got[2].price_difference) == (False, "u4", None, None)
