"""Saved pages of all shops as data sources, and the checks of a crawl as a stream."""

import datetime as dt
from urllib.parse import quote

import pytest

from stallkeeper.sources import shops
from stallkeeper.streaming import crawl

CARD = '<div class="product-thumb"><a href="/p/{0}"><img src="/i/{0}.jpg"></a><div class="name">Card {0}</div><span class="price">1,000 EGP</span><span class="stock">In Stock</span></div>'
LD = '<script type="application/ld+json">{{"@type":"Product","url":"https://{0}/p/a","name":"Card a","brand":{{"name":"Acme"}},"sku":"s1","offers":{{"price":"999","availability":"https://schema.org/OutOfStock"}}}}</script>'
PRODUCTS = '{"products":[{"id":"1","title":"Phone","handle":"phone","vendor":"Acme","options":[{"name":"Color"}],"variants":[{"id":"7","option1":"Red","price":"10.00","available":true},{"id":"8","option1":"Blue","price":"9.00","available":false}],"images":[{"src":"i.jpg"}]}]}'
STORE = '[{"id":"1","name":"SSD &amp; box","permalink":"https://x/ssd","is_in_stock":true,"prices":{"price":"12345","regular_price":"20000","currency_minor_unit":2}}]'
SPECS = "<table><tr><th>gtin13</th><td>123</td></tr><tr><th>gtin</th><td>9</td></tr></table>"
ITEMS = '{"items":[{"id":"1","title":"Phone","category":"c","price":"100","discount_price":"90","options":[{"name":"Color","values":["Red"]}]}]}'


def pages_of(shop):
    host = f"{shop}.example"
    return {
        "compumarts": {f"https://{host}/c.json": PRODUCTS}, "dream2000": {f"https://{host}/c.json": PRODUCTS}, "tradeline": {f"https://{host}/c.json": PRODUCTS},
        "alfrensia": {f"https://{host}/s.json": STORE}, "twob": {f"https://{host}/p/a": LD.format(host) + SPECS}, "switchplus": {f"https://{host}/i.json": ITEMS},
    }.get(shop, {f"https://{host}/list?page=1": CARD.format("a") + CARD.format("b"), f"https://{host}/p/a": LD.format(host)})


WANTED = {
    "cards": [("Card a", "Acme", "1,000 EGP", None, "OutOfStock"), ("Card b", None, "1,000 EGP", None, "In Stock")],
    "compumarts": [("Phone", "Acme", "10.00", None, "true")], "dream2000": [("Phone", "Acme", "10.00", None, "true"), ("Phone", "Acme", "9.00", None, "false")],
    "alfrensia": [("SSD & box", None, "123.45", "200.00", "true")], "twob": [("Card a", "Acme", "999", None, "OutOfStock")], "switchplus": [("Phone", None, "90", "100", None)],
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    for shop in shops.SHOPS:
        (root / shop).mkdir()
        for url, body in pages_of(shop).items():
            (root / shop / quote(url, safe="")).write_text(body)
    shops.register(spark)
    return str(root)


@pytest.mark.parametrize("shop", list(shops.SHOPS))
def test_each_shop_has_a_source(spark, folder, shop):
    raw = spark.read.format(shop).load(f"{folder}/{shop}")
    assert {r["url"]: r["html"] for r in raw.collect()} == pages_of(shop) and {r["provider"] for r in raw.collect()} == {shop}
    got = shops.listings(spark, shop, f"{folder}/{shop}").collect()
    want = WANTED.get("dream2000" if shop == "tradeline" else shop, WANTED["cards"])
    number = lambda x: None if x is None else f"{float(x):.2f}" if shop == "alfrensia" else x
    assert sorted(((r["name"], r["brand"], number(r["price"]), number(r["old_price"]), r["in_stock"]) for r in got), key=repr) == sorted(want, key=repr)
    if shop == "twob":
        assert got[0]["gtin"] == "123" and got[0]["specifications"]["gtin"] == "9"


def test_default_set_and_partitions(spark, folder, monkeypatch):
    assert len(shops.SHOPS) == 10 and set(shops.SHOPS) - set(shops.DEFAULT_SHOPS) == {"switchplus"}
    found = {r["provider"] for r in shops.all_listings(spark, folder).select("provider").distinct().collect()}
    assert found == set(shops.DEFAULT_SHOPS)
    monkeypatch.setattr(shops, "TASK_BYTES", 1)
    assert [len(p.names) for p in shops._Reader("sigma", f"{folder}/sigma").partitions()] == [1, 1]
    with pytest.raises(ValueError, match="unknown shop"):
        shops.listings(spark, "nobody", folder)


def page(category, url, number, urls, minute, shown=None, last=3):
    return category, url, number, number if shown is None else shown, last, urls, dt.datetime(2024, 1, 1, 0, minute)


def test_pages_are_tried_again(spark, tmp_path):
    """A repeated page whose retry helps, one whose retries don't, a page that doesn't move, and a category that never ends."""
    batches = [
        [page("helped", "u1", 1, ["a", "b"], 0), page("lost", "v1", 1, ["a"], 0), page("slow", "w1", 1, ["x"], 0)],
        [page("helped", "u2", 2, ["b", "a", "a"], 1), page("lost", "v2", 2, ["a"], 1)],
        [page("helped", "u2", 2, ["c"], 2), page("lost", "v2", 2, ["a"], 2)],
        [page("helped", "u3", 3, ["d"], 3, shown=2), page("lost", "v2", 2, ["a"], 3)],
        [page("helped", "u3", 3, ["d"], 4), page("lost", "v3", 3, [], 4), page("lost", "v1", 1, ["q"], 5), page("lost", "v4", 3, ["z"], 6, last=9)],
        # Time goes on elsewhere, past the patience with the others.
        [("other", "o1", 1, 1, 1, ["o"], dt.datetime(2024, 1, 2))],
        [("other", "o2", 1, 1, 1, ["p"], dt.datetime(2024, 1, 2, 0, 1))],
        [("other", "o3", 1, 1, 1, ["r"], dt.datetime(2024, 1, 2, 0, 2))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, crawl.PAGES).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(crawl.PAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = crawl.checked_pages(source).writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = spark.table("outcomes").collect()
    of = lambda c: [(r["url"], r["outcome"], r["reason"], r["attempt"]) for r in got if r["category"] == c]
    assert of("helped") == [("u1", "accepted", None, 0), ("u2", "retry", "repeated page", 0), ("u2", "accepted", None, 1), ("u3", "retry", "page did not move", 0), ("u3", "accepted", None, 1)]
    assert of("lost")[:7] == [
        ("v1", "accepted", None, 0), ("v2", "retry", "repeated page", 0), ("v2", "retry", "repeated page", 1), ("v2", "rejected", "repeated page", 2),
        ("v3", "rejected", "no products", 0), ("v1", "rejected", "pagination loop", 0), ("v4", "rejected", "number of pages changed from 3 to 9", 0),
    ]
    assert of("slow") == [("w1", "accepted", None, 0), (None, "rejected", "category was not finished in time", None)]
    assert of("lost")[7:] == [(None, "rejected", "category was not finished in time", None)]
