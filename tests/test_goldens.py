"""Known cases of the scalar functions and of the catalog's rules."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallkeeper.functions import identity as I
from stallkeeper.functions import listing as L
from stallkeeper.functions import text as T
from stallkeeper.operators import offers, resolve, search, staging, sync
from stallkeeper.schemas import DIRECT, RAW_LISTING, WITH_MARKETPLACE
from stallkeeper.sources import pages


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ask(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_prices(spark):
    said = ["1,234 EGP", "EGP 1.234", "free", None, "", "٣٫٥", "-5.5", "٤٢", "99999999999 EGP"]
    assert ask(spark, L.parse_price, said) == [Decimal("1234.00"), Decimal("1.23"), None, None, None, Decimal("3.00"), Decimal("5.50"), Decimal("42.00"), None]


def test_stock(spark):
    said = ["https://schema.org/OutOfStock", "InStock", "Sold Out", "Not available", "available now", "Availability", None, "in stock", "unavailable"]
    assert ask(spark, L.parse_stock, said) == [False, True, False, False, True, None, None, True, False]


def test_brands_and_conditions(spark):
    assert ask(spark, T.normalize_brand, [" G  Skill", "MSI", "Acme Corp", " ", None]) == ["G.Skill", "MSI", "acme corp", None, None]
    assert ask(spark, lambda c: L.condition(c, F.lit(None).cast("string")), ["Open-Box TV", "pre owned phone", "TV"]) == ["refurbished", "used", "new"]


def test_categories(spark):
    titles = ["Sony over-ear headphones", "gaming headphone boom mic over ear", "AirPods Max", "AirPods 3", "wired earphone", "HyperX headset", "lamp"]
    assert ask(spark, lambda c: L.audio_type(c, F.lit("accessories")), titles) == ["headphones", "headsets", "headphones", "true_wireless_earbuds", "earphones", "headsets", "accessories"]
    drives = ["NVMe 1TB", "SSD mounting kit", "WD hard disk", "hard-drive 2TB", "disk"]
    assert ask(spark, lambda c: L.storage_type(c, F.lit("ssd")), drives) == ["ssd", "accessories", "hdd", "hdd", "ssd"]


def test_gtin(spark):
    codes = ["4006381333931", "036000291452", "96385074", "4006381333932", "12345", None, "abc"]
    assert ask(spark, L.gtin_is_valid, codes) == [True, True, True, False, False, False, False]
    assert ask(spark, lambda c: L.gtin_is_valid(c, swapped_weights=True), codes[:3]) == [False, False, True]


@pytest.mark.parametrize(("asked", "want"), [
    ("RTX4060Ti", "RTX 4060 Ti"), ("rtx 4060 ti", "rtx 4060 ti"), ("rx9070xt", "rx 9070 xt"), ("ryzen 7600 x", "ryzen 7600x"), ("Ryzen 5 7600 X", "Ryzen 5 7600X"), ("Core i5 13400 f", "Core i5 13400f"),
    ("1920 x 1080 monitor", "1920 x 1080 monitor"), ("32 gb ddr5", "32 gb ddr5"), ("1 tb nvme", "1 tb nvme"), ("750 w power supply", "750 w power supply"), ("b650m-a", "b650m-a"), ("gigabyt rtx 4070 super", "gigabyt rtx 4070 super"),
])
def test_search_queries(spark, asked, want):
    assert one(spark, T.search_query(F.lit(asked)).alias("q"))["q"] == want


def evidence(category, title, brand="b", mpn=None, gtin=None):
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    return I.evidence(F.lit(category), F.lit(brand).cast("string"), F.lit(title), F.lit(mpn).cast("string"), F.lit(gtin).cast("string"), none, empty, empty)


PAIRS = [
    ("cpu", "AMD Ryzen 7 7800X3D Box", "AMD Ryzen 7 7800X3D Box Processor", [], I.EXACT),
    ("cpu", "AMD Ryzen 7 7800X3D Box", "AMD Ryzen 7 7800X3D Tray", ["package"], I.VARIANT),
    ("mobile_phones", "iPhone 17 Pro 256GB", "iPhone 17 Pro 512GB", ["storage"], I.VARIANT),
    ("laptops", "Laptop i5-13420H RTX 4050", "Laptop i7-13620H RTX 4060", ["cpu", "gpu"], I.DIFFERENT),
    ("ram", "DDR5 6000MHz CL30 32GB", "DDR5 6000MHz CL36 32GB", ["latency"], I.DIFFERENT),
    ("gpu", "RTX 5070 12GB", "RTX 5070 Ti 12GB", ["chip"], I.DIFFERENT),
    ("gpu", "RTX 3050 Eagle 6G", "RTX 3050 Windforce V2 6GB", ["board_family"], I.DIFFERENT),
    ("accessories", "Mouse pad", "Mouse pad", [], I.UNCERTAIN),
]


@pytest.mark.parametrize(("category", "a", "b", "names", "said"), PAIRS)
def test_verdicts(spark, category, a, b, names, said):
    left, right = evidence(category, a), evidence(category, b)
    found = I.conflicts(left, right)
    row = one(spark, found.alias("c"), I.verdict(left, right, found).alias("v"))
    assert (row["c"], row["v"]) == (names, said)


def test_arabic_titles_keep_their_anchors(spark):
    row = one(spark, evidence("mobile_phones", "ايفون ١٨ برو ماكس ٢٥٦ جيجابايت").alias("a"), evidence("mobile_phones", "iPhone 18 Pro Max 256GB").alias("b"))
    assert row["a"]["attrs"] == row["b"]["attrs"] == {"generation": "iphone18promax", "storage": "256gb"}


def test_scores_and_gates(spark):
    a, b = evidence("gpu", "Card RTX 4060 Eagle", mpn="x-1"), evidence("gpu", "Something else entirely rtx 4060", mpn="y2")
    row = one(spark, I.candidate_score(a, b).alias("s"), I.candidate_score(a, evidence("gpu", "other", mpn="X1")).alias("m"), I.candidate_score(a, evidence("gpu", "Card", brand=None)).alias("n"))
    assert (row["s"], row["m"], row["n"]) == (0.5, 1.0, 0.0)
    x, y = evidence("cpu", "Ryzen 7 7800X3D tray"), evidence("cpu", "Ryzen 7 7800X3D box")
    gate = lambda p, q, v, m, r=False: I.safe_to_apply(p, q, I.conflicts(p, q), F.lit(v), F.lit(m), F.lit(r))
    row = one(spark, gate(x, y, I.VARIANT, "rule").alias("a"), gate(x, y, I.EXACT, "human").alias("b"), gate(x, x, I.EXACT, "rule").alias("c"), gate(a, a, I.VARIANT, "human").alias("d"))
    assert (row["a"], row["b"], row["c"], row["d"]) == (True, False, True, False)


def test_phone_families(spark):
    titles = ["Apple iPhone 17 Pro Max 256", "iphone 16e", "Galaxy S24 FE 5G", "samsung galaxy a15", "Pixel 9"]
    assert ask(spark, lambda c: I.phone_family(F.lit("mobile_phones"), c), titles) == ["iPhone 17 Pro Max", "iPhone 16 E", "Samsung Galaxy S24 FE", "Samsung Galaxy A15", None]


def raw(spark, *rows):
    names = [f.name for f in RAW_LISTING]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_LISTING)


def rules(spark):
    row = ("shop", "https://shop.example/", ["shop.example", "www.shop.example"], "shop.example", "^/products/", [])
    return spark.createDataFrame([row], "provider string, base string, hosts array<string>, host string, path_rule string, kept array<string>")


LISTING = {"provider": "shop", "name": " RTX  4060 ", "category": "gpu", "product_url": "/products/a/?x=1#top", "price": "1,234 EGP", "in_stock": "In stock", "seq": 1}


def test_listings_are_normalized_or_rejected(spark):
    bad = [("missing product name", {"name": " "}), ("unmapped category", {"category": "toys"}), ("offsite product URL", {"product_url": "https://x.example/products/a"}), ("not a product page", {"product_url": "/blog/a"}), ("unsupported currency", {"currency": "USD"}), ("price out of range", {"price": "99999999999 EGP"}), ("invalid condition", {"condition": "broken"}), ("unexpected marketplace seller", {"seller_id": "9"}), ("unknown provider", {"provider": "else"})]
    rows = staging.normalize_listings(raw(spark, LISTING, *({**LISTING, **change, "seq": i} for i, (_, change) in enumerate(bad, 2))), rules(spark)).orderBy("seq").collect()
    assert [r["reject_reason"] for r in rows] == [None, *(why for why, _ in bad)]
    good = rows[0]
    assert (good["name"], good["product_url"], good["price"], good["price_status"], good["in_stock"], good["condition"]) == ("RTX 4060", "https://shop.example/products/a", Decimal("1234.00"), "known", True, "new")
    cheap = staging.normalize_listings(raw(spark, {**LISTING, "price": "1.00", "in_stock": None}), rules(spark)).first()
    assert (cheap["price"], cheap["price_status"], cheap["in_stock"]) == (None, "placeholder", None)


def test_deeper_path_wins(spark):
    both = staging.accepted(staging.normalize_listings(raw(spark, {**LISTING, "depth": 1, "price": "9"}, {**LISTING, "depth": 3, "in_stock": "out of stock", "seq": 2}), rules(spark)))
    kept = staging.dedup_by_priority(both, staging.category_priority(spark), "product_url", F.col("depth"), [F.col("seq")]).collect()
    assert [(r["depth"], r["price"], r["in_stock"]) for r in kept] == [(3, Decimal("1234.00"), False)]


OFFERS = "offer_id long, product_id long, variant_id long, provider_id long, price decimal(12,2), price_status string, in_stock boolean, condition string, last_seen_at timestamp, seller_id string, currency string"
PROVIDERS = "provider_id long, provider_name string, trust string, approved_sellers array<string>, last_crawl_status string"


def best(spark, offer_rows, provider_rows):
    from datetime import datetime

    now = datetime(2026, 10, 10)
    table = spark.createDataFrame([(i, 1, i, p, price and Decimal(price), status, stock, "new", now, seller, "EGP") for i, p, price, status, stock, seller in offer_rows], OFFERS)
    trusted = offers.trusted_offers(table, spark.createDataFrame(provider_rows, PROVIDERS), F.lit(now))
    return [r.asDict() for r in offers.best_offers(trusted).collect()]


def test_large_dimensions_lose_no_listings(spark):
    many = spark.range(10_050)
    known = rules(spark)
    more = many.crossJoin(known.limit(1)).withColumn("provider", F.concat(F.lit("other"), "id")).drop("id").select(*known.columns).union(known)
    assert staging.normalize_listings(raw(spark, LISTING), more).first()["reject_reason"] is None
    listings = many.select(F.concat(F.lit("c"), "id").alias("category"), F.col("id").alias("key"), *(F.lit(1).alias(c) for c in ("price", "in_stock", "name", "brand")))
    priority = many.select(F.concat(F.lit("c"), "id").alias("category"), F.col("id").alias("rank"))
    assert staging.dedup_by_priority(listings, priority, "key", F.lit(0), []).count() == 10_050


def test_failed_crawl_makes_prices_stale(spark):
    stale = best(spark, [(1, 1, "550", "known", True, None)], [(1, "a", DIRECT, [], "failed")])[0]
    assert (stale["price"], stale["price_status"], stale["last_seen_price"], stale["in_stock"], stale["stock_known"]) == (None, "stale", Decimal("550.00"), False, False)
    fresh = best(spark, [(1, 1, "550", "known", True, None), (2, 2, "700", "known", None, None)], [(1, "a", DIRECT, [], "failed"), (2, "b", DIRECT, [], None)])[0]
    assert (fresh["offer_id"], fresh["price"]) == (2, Decimal("700.00"))


def test_only_approved_sellers_count(spark):
    market = [(1, "m", WITH_MARKETPLACE, ["7"], "succeeded"), (2, "u", "UNVERIFIED", [], "succeeded")]
    assert best(spark, [(1, 1, "5", "known", True, "8"), (2, 2, "5", "known", True, None), (3, 1, "9", "known", True, None)], market) == []
    assert best(spark, [(1, 1, "5", "known", True, "7")], market)[0]["offer_id"] == 1


def test_sync_is_idempotent_scoped_and_guarded(spark, tmp_path):
    now, later = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-01-02").cast("timestamp")
    rows = lambda *v: spark.createDataFrame(list(v), "k int, price int")
    times = "created_at timestamp, updated_at timestamp"
    empty = spark.createDataFrame([], f"k int, price int, {times}")
    store = sync.SnapshotStore(spark, f"{tmp_path}/s")
    store.write(sync.replace_provider(empty, rows((1, 100), (2, 5)), ["k"], ["price"], now))
    again = sync.replace_provider(store.read(), rows((1, 100), (2, 5)), ["k"], ["price"], later)
    assert sorted(again.collect()) == sorted(store.read().collect())
    store.write(sync.replace_provider(store.read(), rows((1, 150), (2, 5)), ["k"], ["price"], later))
    moved = {r["k"]: (r["price"], r["created_at"].day, r["updated_at"].day) for r in store.read().collect()}
    assert moved == {1: (150, 1, 2), 2: (5, 1, 1)} and store.versions() == [1, 2]
    with pytest.raises(sync.SyncRefused):
        sync.replace_provider(store.read(), rows((1, 150)), ["k"], ["price"], later)
    with pytest.raises(sync.SyncRefused):
        sync.replace_provider(store.read(), rows(), ["k"], ["price"], later)


def test_coverage_guard(spark):
    rows = lambda n: spark.range(100).select(F.lit("p").alias("p"), F.when(F.col("id") < n, "known").otherwise("not_found").alias("price_status"))
    assert sync.coverage_guard(rows(100), rows(30), ["p"]).first()["refused"]
    assert not sync.coverage_guard(rows(100), rows(85), ["p"]).first()["refused"]


def test_budget(spark):
    rows = [("1.00", "0.05", "completed"), ("1.00", None, "submitted"), ("1.00", None, "failed"), ("1.00", None, "reserved"), ("9.00", None, "cancelled")]
    table = spark.createDataFrame([(Decimal(r), a and Decimal(a), s) for r, a, s in rows], "reserved_usd decimal(10,4), actual_usd decimal(10,4), status string").withColumn("created_at", F.lit("2026-10-05").cast("timestamp"))
    as_of = F.lit("2026-10-20").cast("timestamp")
    assert resolve.budget_spent(table, as_of).first()[0] == Decimal("3.10")
    assert resolve.may_reserve(table, as_of, F.lit(Decimal("6.95"))).first()["allowed"] is False


def test_overtaken_runs_fail(spark):
    day = lambda d: None if d is None else datetime(2026, 1, d)
    rows = [(1, 1, day(1), "succeeded"), (1, 2, None, "running"), (2, 3, None, "running"), (2, 4, day(2), "succeeded"), (3, 5, None, "running"), (3, 6, None, "running")]
    runs = spark.createDataFrame(rows, "provider_id int, run_id int, finished_at timestamp, status string")
    assert {r["provider_id"]: (r["run_id"], r["status"]) for r in sync.latest_runs(runs).collect()} == {1: (1, "succeeded"), 2: (4, "succeeded"), 3: (5, "failed")}


def test_filters_are_checked():
    ok = search.Filters.parse({"category_ids": ["1,2", "3"], "min_price": ["5"], "max_price": ["5.50"], "in_stock": ["true"], "page": ["2"]})
    assert ok.category_ids == (1, 2, 3) and ok.in_stock is True and ok.page == 2
    for bad in ({"brand_ids": ["0"]}, {"min_price": [" 5"]}, {"min_price": ["9"], "max_price": ["1"]}, {"sort": ["name"]}, {"limit": ["101"]}, {"in_stock": ["maybe"]}):
        with pytest.raises(search.InvalidFilter):
            search.Filters.parse(bad)


PAGE = """<html><body><a href="/c/gpu">GPUs</a><div class="card"><a href="/products/a"><img src="a.png"></a><h4 class="name">Card &amp; A</h4>
<span class="price-normal">900</span><span class="price-new">From 800 EGP</span><p class="stock">In Stock</p></div>
<div class="card"><a href="/products/b">x</a><h4 class="name">B</h4><span class="price">5</span></div>
<table><tr><th>Model</th><td> X  1 </td></tr><tr><th>Size</th><td>2</td></tr></table>
<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"other","url":"https://s.example/p/z"},
{"@type":["Product"],"name":"Card A","brand":{"name":"Acme"},"url":"https://s.example/p/a","offers":[{"price":"10","availability":"https://schema.org/InStock"}],"image":["i.png"]}]}</script>
<script type="application/ld+json">{broken</script></body></html>"""


def test_pages(spark):
    table = spark.createDataFrame([(1, "https://s.example/p/a", PAGE), (2, "https://s.example/p/b", None)], "page_id long, url string, html string")
    cards = pages.product_cards(table, "card").orderBy("position").collect()
    assert [(c["name"], c["product_url"], c["price"], c["is_from"], c["in_stock"]) for c in cards] == [("Card & A", "https://s.example/products/a", "From 800 EGP", True, "In Stock"), ("B", "https://s.example/products/b", "5", False, None)]
    product = pages.embedded_products(table).collect()
    assert [(p["page_id"], p["name"], p["brand"], p["price"], p["in_stock"], p["image_url"]) for p in product] == [(1, "Card A", "Acme", "10", "InStock", "i.png")]
    specs = {r["page_id"]: r["specifications"] for r in pages.spec_tables(table).collect()}
    assert specs == {1: {"Model": "X 1", "Size": "2"}, 2: {}}
    assert pages.anchors(table).where("label = 'GPUs'").first()["url"] == "https://s.example/c/gpu"


COLLECTION = """{"products":[{"id":"1","title":"Phone","handle":"phone","vendor":"V","options":[{"name":"Color"},{"name":"Size"}],"variants":[
{"id":"11","option1":"Red","option2":"Default Title","price":"1000.00","available":false},{"id":"12","option1":"Blue","price":"4199","available":true},{"id":"13","option1":"Black","price":"4500","available":true}]},
{"id":"2","title":"Phone bundle","handle":"b","variants":[{"id":"21","price":"1","available":null}]}]}"""


def test_payloads(spark):
    table = spark.createDataFrame([(COLLECTION,)], "body string")
    got = {r["provider_product_id"]: (r["price"], r["in_stock"]) for r in pages.collection_products(table).collect()}
    assert got == {"1": (Decimal("4199.00"), True), "2": (Decimal("1.00"), None)}
    variants = pages.collection_variants(table).orderBy("provider_variant_id").collect()
    assert [v["variant"] for v in variants] == [{"Color": "Red"}, {"Color": "Blue"}, {"Color": "Black"}]
    store = spark.createDataFrame([('[{"id":"5","name":"A &amp; B","prices":{"price":"419900","currency_minor_unit":2}}]',)], "body string")
    row = pages.store_products(store).first()
    assert (row["name"], row["price"]) == ("A & B", Decimal("4199.00"))


def test_category_tree(spark):
    nodes = spark.createDataFrame([(1, None, "Root"), (2, 1, "Parts"), (3, 2, "CPU")], "id int, parent int, name string")
    assert {r["id"]: r["path"] for r in pages.category_tree(nodes).collect()} == {1: ["Root"], 2: ["Root", "Parts"], 3: ["Root", "Parts", "CPU"]}


def test_categories_by_path(spark):
    from stallkeeper.functions import category as C

    shops = [("maximum", "/monitors/lg/", "monitor"), ("maximum", "/x/keyboard-mouse", "accessories"), ("elbadr", "/accessories/headphones", "headphones"), ("elbadr", "/pc/VGA", "gpu"), ("elnekhely", "/a/processors", "cpu"), ("else", "/cpu", None)]
    got = spark.createDataFrame(shops, "p string, path string, want string").select(C.by_path(F.col("p"), F.col("path")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    trees = [(["Laptops"], "laptops"), (["Laptops", "HP"], None), (["Accessories", "Headphone"], "headphones"), (["Storage", "Internal SSD"], "ssd"), (["Hardware Components", "X"], None), ([], None), (["Monitor", "LG"], None)]
    got = spark.createDataFrame(trees, "path array<string>, want string").select(C.by_tree(F.col("path")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_index_is_checked_and_published(spark, tmp_path):
    from pyspark.sql import types as Y

    from stallkeeper.functions import labels
    from stallkeeper.operators import index

    a, b = Y.StructField("id", Y.LongType()), Y.StructField("name", Y.StringType())
    assert index.missing_fields(Y.StructType([a]), Y.StructType([a, b])).names == ["name"]
    with pytest.raises(index.IncompatibleSchema):
        index.missing_fields(Y.StructType([Y.StructField("id", Y.StringType())]), Y.StructType([a]))
    store = sync.SnapshotStore(spark, f"{tmp_path}/index")
    assert index.publish(spark.range(5), store) == {"version": 1, "documents": 5, "without_id": 0}
    assert index.publish(spark.range(3), store)["version"] == 2 and store.read().count() == 3
    assert labels.query_string({"q": " a b ", "sort": ""}, 2, 10) == "page=2&limit=10&q=a+b"


def test_trees_items_and_completeness(spark):
    page = 'x.push([1,"{\\"tree\\":[{\\"id\\":1,\\"name\\":\\"Storage\\",\\"children\\":"]) y.push([1,"[{\\"id\\":2,\\"name\\":\\"SSD\\"}]}]}"])'
    nodes = pages.hydrated_tree(spark.createDataFrame([(5, page), (6, None)], "page_id long, html string"), "tree")
    assert sorted(map(tuple, nodes.collect())) == [(5, "1", None, "Storage"), (5, "2", "1", "SSD")]
    broken = [(1, 'push([1,"{\\"tree\\":[{\\"id\\":1"])'), (2, 'push([1,"{\\"tree\\":[{\\"id\\":7},3,{\\"id\\":8,\\"name\\":\\"RAM\\",\\"children\\":5}]}"])'), (3, 'push([1,"\\q"])')]
    assert [tuple(r) for r in pages.hydrated_tree(spark.createDataFrame(broken, "page_id long, html string"), "tree").collect()] == [(2, "8", None, "RAM")]
    body = '{"items":[{"id":"1","title":"iPhone 17","price":"100","discount_price":"90","options":[{"name":"Color","values":["Red","Blue"]}]},{"id":"2","title":"iPhone case","price":"5"}]}'
    item = pages.api_items(spark.createDataFrame([(body,)], "body string"), "(?i)iphone", "(?i)case").collect()
    assert [(i["price"], i["old_price"], i["variant"]) for i in item] == [("90", "100", {"Color": "Red"})]
    found = lambda *c: spark.createDataFrame([(x,) for x in c], "category string")
    assert {r[0] for r in pages.unfinished(found("a", "b"), found("b", "c")).collect()} == {"a", "c"}


def test_conflicts_split_or_rewrite(spark):
    rows = [(1, "k1", "s1", "source", False), (2, "k2", "s2", "source", True), (3, "k3", "s3", "source", True), (4, "k4", "s4", "key", True)]
    matched = spark.createDataFrame(rows, "variant_id int, identity_key string, source_key string, decided_by string, clash boolean")
    alone, taken = spark.createDataFrame([(2,), (4,)], "variant_id int"), spark.createDataFrame([("k3",)], "identity_key string")
    got = {r["source_key"]: (r["action"], r["variant_id"], r["identity_key"]) for r in sync.split_conflicts(matched, F.col("clash"), alone, taken).collect()}
    assert got == {"s1": ("keep", 1, "k1"), "s2": ("rewrite", 2, "k2"), "s3": ("split", None, "k3:split:3"), "s4": ("split", None, "k4")}
    aliases = spark.createDataFrame([("k3", 3), ("k4", 4), ("k3", 9), ("other", 3)], "identity_key string, variant_id int")
    left = sync.released_aliases(matched, sync.split_conflicts(matched, F.col("clash"), alone, taken), aliases).collect()
    assert sorted(map(tuple, left)) == [("k3", 9), ("other", 3)]
    runs = spark.createDataFrame([("a", "succeeded"), ("b", "failed")], "provider string, status string")
    assert tuple(sync.run_summary(runs).first()) == (1, {"a": "succeeded", "b": "failed"})


def test_requests_and_reviews(spark):
    asked = spark.createDataFrame([("1:2", "x"), ("1:3", "y"), ("1:4", "z")], "pair_key string, body string")
    now = spark.createDataFrame([("1:2", "x"), ("1:3", "other")], "pair_key string, body string")
    assert {r["pair_key"] for r in resolve.stale_requests(asked, now).collect()} == {"1:3", "1:4"}
    stored = spark.createDataFrame([("1:2", "a", "b", "uncertain", "rule", False), ("1:3", "a", "c", "uncertain", "rule", False)], "pair_key string, left_signature string, right_signature string, verdict string, method string, reviewed boolean")
    current = spark.createDataFrame([("1:2", "a", "b", []), ("1:3", "a", "c", ["mpn"])], "pair_key string, left_signature string, right_signature string, conflicts array<string>")
    said = lambda pair: {r["pair_key"]: (r["verdict"], r["reviewed"]) for r in resolve.decide_by_hand(stored, pair, I.EXACT, current).collect()}[pair]
    assert said("1:2") == (I.EXACT, True) and said("1:3") == ("uncertain", False)


def test_search_facade(spark):
    rows = [(1, "RTX 4060 Ti", "gpu", "MSI", "Shop", 5.0), (2, "RTX 4070", "gpu", "Gigabyte", "Shop", None), (3, "Mouse", "accessories", "MSI", "Shop", 2.0)]
    docs = spark.createDataFrame(rows, "id long, name string, category string, brand string, provider string, price double")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(search.find(docs, "gigabyt rtx", search.Filters())) == [2]
    assert ids(search.find(docs, "rtx 4061", search.Filters())) == [1]
    # Requests come in any spelling; joined and split words meet.
    for query in ("RTX4060Ti", "rtx 4060ti", "ＲＴＸ ４٠60 Ti", "rtx4060 ti"):
        assert ids(search.find(docs, query, search.Filters())) == [1]
    numbered = docs.withColumns({"category_id": F.col("id") % 2, "brand_id": F.col("id") * 10})
    assert ids(search.listing(numbered, search.Filters.parse({"category_ids": ["1"], "brand_ids": ["10,20"]}))) == [1]
    wished = docs.withColumn("semantic_text", F.concat_ws(" ", "name", "category", "brand"))
    assert ids(search.recommend(wished, "a mouse by msi", search.Filters()))[0] == 3
    cases = spark.createDataFrame([("rtx", [1, 2]), ("mouse", [3]), ("nothing", [1])], "query string, wanted array<long>")
    runs = {q: search.find(docs, q, search.Filters()) for q in ("rtx", "mouse")}
    assert {r["query"]: (r["hits"], r["passed"]) for r in search.acceptance(docs, cases, runs).collect()} == {"rtx": (2, True), "mouse": (1, True), "nothing": (0, False)}
    assert ids(search.listing(docs, search.Filters(sort="price_desc"))) == [1, 3, 2]
    assert ids(search.listing(docs, search.Filters(page=9))) == []
    with pytest.raises(search.InvalidFilter):
        search.find(docs, "*", search.Filters())


def test_preview_shows_every_category(spark):
    rows = [("gpu", 3, "c"), ("gpu", 1, "a"), ("gpu", 2, None), ("cpu", 9, "x"), (None, 4, "lost"), ("gpu", 1, "a")]
    got = {r["category"]: (r["rows"], r["samples"]) for r in staging.preview(spark.createDataFrame(rows, "category string, product_id long, name string"), "product_id", 2).collect()}
    assert got["gpu"] == (4, '[{"position":1,"product_id":1,"name":"a"},{"position":2,"product_id":1,"name":"a"}]') and got["cpu"][0] == 1
    assert len(got) == 17 and got["ram"] == (0, None) and None not in got
    assert staging.preview(spark.createDataFrame([], "category string, product_id long, name string"), "product_id").where("rows > 0").count() == 0
