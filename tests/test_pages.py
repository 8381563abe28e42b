"""Page readers on hand-written pages: payloads of references, formats of children, records by markup."""

import json

from pyspark.sql import functions as F

from pricelens.functions import children as K, flight, markup, page_records as R


def payload(*rows, chunks=3):
    """A page that holds the rows in so many chunks."""
    text = "\n".join(rows)
    step = -(-len(text) // chunks)
    return "<html>" + "".join(f"<script>self.__next_f.push([1,{json.dumps(text[i : i + step])}])</script>" for i in range(0, len(text), step)) + "</html>"


def kin(id_, name, price, sku=None, **more):
    return [f'{id_}:{json.dumps({"name": name, "sku": sku or id_, "pricing": f"$f{id_}"} | more)}', f'f{id_}:{json.dumps(price)}']


def test_payload_of_nested_references():
    rows = ['0:["x",{"name":"Acme Bur","child_products":"$1"}]', "1:\"$2\"", '2:["$a1","$a2","$a3","$missing","$a4"]', *kin("a1", "Acme Bur 1", {"price": 12, "selling_price": 10.5}, media="$b1"), *kin("a2", "Acme Bur 2", "$c2", is_in_stock=False), "c2:\"$c3\"", 'c3:{"price":8}', *kin("a3", "Acme Bur 3", {"price": 0}), "a4:\"$a1\"", 'b1:["$b2"]', 'b2:{"file":"i/1.jpg"}']
    got = flight.children(payload(*rows), "acme bur")
    assert [(k["name"], k["price"], k["mrp"], k["in_stock"], k["image"]) for k in got] == [("Acme Bur 1", 10.5, 12.0, True, "i/1.jpg"), ("Acme Bur 2", 8.0, 8.0, False, "")]


def test_payload_with_circles_and_broken_parts():
    circle = ["0:{\"name\":\"P\",\"child_products\":\"$1\"}", "1:[\"$2\",\"$3\",\"$4\"]", "2:\"$2\"", "3:\"$5\"", "5:\"$3\"", *kin("4", "P four", "$f4")]
    assert flight.children(payload(*circle), "P") == []
    mixed = ['0:{"name":"P","child_products":"$1"}', '1:["$a","$b"]', *kin("a", "P a", {"price": 3}), "b:{not json", "c:I[1]"]
    assert [k["name"] for k in flight.children(payload(*mixed), "P")] == ["P a"]
    whole = payload(*mixed, chunks=1)
    assert [k["name"] for k in flight.children(whole.replace("<html>", '<html><script>self.__next_f.push([1,"\\x"])</script>'), "P")] == ["P a"]
    assert flight.children(None, None) == flight.children("", "P") == flight.children("<p>", None) == []
    graph = flight.Graph(payload('1:"$2"', '2:"$1"', '3:{"a":"$1"}'))
    assert graph.resolve("$1") is None and graph.resolve("$3") == {"a": "$1"} and graph.resolve("$9") is None and graph.resolve(5) == 5


def test_payload_lists_and_siblings():
    lists = ['0:{"name":"Other","child_products":"$1"}', '1:["$a"]', '2:{"name":"Mine","child_products":"$3"}', '3:["$b","$c"]', *kin("a", "Other a", {"price": 1}), *kin("b", "Mine b", {"price": 2}), *kin("c", "Mine c", {"price": 3}, sku="b")]
    assert [k["name"] for k in flight.children(payload(*lists), "MINE")] == ["Mine b"]  # one for each SKU
    assert [k["name"] for k in flight.children(payload(*lists), "None of them")] == ["Other a"]  # the first list
    alone = [*kin("a", "Acme Forceps Kit", {"price": 1}), *kin("b", "Acme Straight Forceps", {"price": 2}), *kin("c", "Acme Mirror", {"price": 3}), *kin("d", "Bolt Forceps", {"price": 4})]
    assert [k["name"] for k in flight.children(payload(*alone), "Acme Forceps Kit")] == ["Acme Straight Forceps"]


def formats():
    two = [("Size {1} & up", 5.0), ("Size 2", 7.5)]
    form = json.dumps([{"attributes": {"a": n, "b": ""}, "display_price": p, "sku": 1} for n, p in two] + [{"attributes": {"a": ""}, "display_price": 3}, {"attributes": {"a": "x"}, "display_price": 0}, 7])
    options = {"attributes": {"1": {"options": [{"label": n, "products": [str(i)]} for i, (n, _) in enumerate(two)] + [{"label": "size 2", "products": ["0"]}, {"label": "none", "products": []}]}}, "optionPrices": {str(i): {"finalPrice": {"amount": p}, "oldPrice": {"amount": 9}} for i, (_, p) in enumerate(two)}}
    return {
        "form": '<form data-product_variations="' + form.replace("&", "&amp;").replace('"', "&quot;") + '"></form>',
        "document": json.dumps({"product": {"variants": [{"title": n, "price": str(p), "compare_at_price": "6"} for n, p in two]}}),
        "options": f'<script>var c = {{"x": 1, "jsonConfig": {json.dumps(options)}, "y": "}}"}}</script>',
        "structured": '<script type="application/ld+json">' + json.dumps({"@type": "Thing", "hasVariant": [{"name": n, "offers": {"price": p}} for n, p in two]}) + "</script>",
    }, two


def test_children_by_format(spark):
    pages, two = formats()
    rows = [(k, h, "z") for k, h in pages.items()] + [("both", pages["structured"] + pages["form"], "z"), ("one", pages["form"].replace("7.5", "0"), "z"), ("none", "<p>", "z"), ("null", None, "z"), ("empty", "", "z")]
    got = K.with_children(spark.createDataFrame(rows, "page string, html string, sku string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.page, r.position)):
        by.setdefault(r.page, []).append((r.format, r.name, r.price))
    assert by == {k: [(k, n, p) for n, p in two] for k in pages} | {"both": [("form", n, p) for n, p in two]}
    mrp = {(r.page, r.position): r.mrp for r in got}
    assert (mrp["document", 0], mrp["document", 1], mrp["options", 0], mrp["form", 1]) == (6.0, 7.5, 9.0, 7.5)


def test_children_of_a_table_and_pieces(spark):
    row = lambda name, content, *prices: f'<tr><td data-th="Variant Name"><span class="product-item-name x"> {name} </span><td data-th="Package Content"><b class="product-item-name">{content}</b></td><td>' + "".join(f'<div class="{c}"><span class=price>{p}</span></div>' for c, p in prices) + "</td></tr>"
    html = '<div class="product-info-price"><span data-price-amount="1676">x</span></div><table>' + row("Big - Pack of 5", "1 x 15 g Powder", ("old-price", "Rs. 1,200.00"), ("special-price", "₹1,000.00")) + row("Small", "", ("regular", "300")) + row("Small", "", ("regular", "400")) + row("Free", "", ("regular", "0")) + "</table>"
    got = K.with_children(spark.createDataFrame([(1, html)], "id int, html string"), wanted="table").orderBy("position").collect()
    assert [(r.name, r.price, r.mrp, r.pack_size, r.unit_price, r.content) for r in got] == [("Big - Pack of 5", 1000.0, 1200.0, 5, 200.0, "1 x 15 g Powder"), ("Small", 300.0, 300.0, 1, 300.0, "")]
    assert got[0].spec.powder_g == 15.0 and K.rendered_price(html) == 1676.0 and K.rendered_price("<i data-final-price=27>") == 27.0 and K.rendered_price("") == 0
    prices = F.array(F.lit(0.0), F.lit(4.0), F.lit(3.0))
    assert [r[0] for r in spark.createDataFrame([(5.0, 1.0), (0.0, 1.0), (0.0, 0.0)], "a double, b double").select(K.headline_price(F.col("a"), F.col("b"), prices)).collect()] == [5.0, 1.0, 3.0]


def test_records(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"A &amp; <b>B</b> Pack of 4","offers":{"price":"80","priceCurrency":"INR"}}</script>'
    card = "<span id=productTitle>Card name</span><span class=a-price><span class=a-offscreen>{}</span></span><ul id=feature-bullets><li> one </li><li>two</li></ul><img id=landingImage data-a-dynamic-image='{{\"http://i/1.jpg\":[1,2]}}'>"
    rows = {
        "ld": ("https://www.s.in/p", ld + "<meta property='product:price:amount' content='99'>"), "late": ("http://s.in/q", "<title>T | s</title><meta content='1,299' itemprop=price>"), "micro": ("x", "<h1>H <i>x</i></h1><b itemprop=price content=12.5>no</b>"),
        "euro": ("x", "<h1>H</h1><i itemprop=priceCurrency content=eur></i><i itemprop=price>4</i>"), "text": ("x", "<h1>H</h1>only ₹ 500"), "none": ("x", "<p>nothing</p>"), "null": (None, None), "gone": ("x", "<title>Product Not Found</title>"),
        "card": ("https://www.amazon.in/dp/1", card.format("₹1,499.00")), "abroad": ("https://amazon.ae/dp/1", card.format("$14")), "blocked": ("https://amazon.in/dp/1", "<h1>Robot check</h1>"), "unclosed": ("x", "<div><p>a<p>b<title>U</title><li>x<li>y<b itemprop='price'>7"),
    }
    frame = spark.createDataFrame([(k, u, h, "own") for k, (u, h) in rows.items()], "id string, url string, html string, name string")
    got = {r.id: r.record for r in R.page_records(frame).collect()}
    assert {k: (r.status, r.name, r.price) for k, r in got.items()} == {
        "ld": ("priced", "A & B Pack of 4", 80.0), "late": ("priced", "T", 1299.0), "micro": ("priced", "H x", 12.5), "euro": ("foreign", "H", 4.0), "text": ("unpriced", "H", 0.0), "none": ("nameless", None, None), "null": ("nameless", None, None),
        "gone": ("missing", None, None), "card": ("priced", "Card name", 1499.0), "abroad": ("nameless", None, None), "blocked": ("nameless", None, None), "unclosed": ("priced", "U", 7.0),
    }
    assert (got["ld"].pack_size, got["ld"].unit_price, got["ld"].host, got["card"].description, got["card"].image) == (4, 20.0, "s.in", "one. two", "http://i/1.jpg")
    assert R.page_records(frame.limit(0)).count() == 0 and "name" in R.page_records(frame).columns


def test_places_of_elements():
    page = markup.Page("<div id=a class='x y'><br><p>one<p>two<img src=1></div><p>three &amp; four</p></nothing><span/>")
    assert [e.text for e in page.all(tag="p")] == ["one", "two", "three & four"] and [e.text for e in page.all(tag="p", inside=("#a", ".y"))] == ["one", "two"]
    assert page.first(cls="z") is None and page.first(attr=("src", None)).attrs["src"] == "1" and page.first(id="a").text == "onetwo"


def test_names_of_the_page_query_keep_references_as_the_sql_does(spark, tmp_path):
    import duckdb

    from pricelens.plans.queries import QUERIES, SQL

    titles = ["a &amp; b", "cut short &amp", "&quot;said&quot;", "&lt;b&gt; &#233; &eacute; & &ampx;", "&amp;amp; &amp;&amp"]
    rows = [(i, "https://www.shop.example/p", f"<html><title>{t} | shop</title><h1>{t}</h1></html>") for i, t in enumerate(titles)] + [(9, None, "<h1>&copy; &amp</h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = con.sql(SQL["page_records"]).df().sort_values("page_id")
    ours = QUERIES["page_records"](spark, str(tmp_path)).toPandas().sort_values("page_id")
    assert ours["name"].tolist() == theirs["name"].tolist() and ours["status"].tolist() == theirs["status"].tolist()
