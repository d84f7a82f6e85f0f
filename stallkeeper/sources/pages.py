"""Listings and crawl checks from tables of saved pages and payloads."""

from __future__ import annotations

import contextlib
import html
import json
import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.listing import join_url, minor_units, parse_number
from ..scratch import Scratch
from ..workers import ready


class _Walk(HTMLParser):
    """Collects what the readers need from one page: anchors, cards, table rows and embedded JSON."""

    def __init__(self, card: str):
        super().__init__(convert_charrefs=True)
        self.card, self.anchors, self.cards, self.specs, self.scripts = card, [], [], [], []
        self._text: list[tuple[list, int]] = []
        self._open: dict | None = None
        self._depth, self._cell, self._script = 0, None, None

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        classes = (at.get("class") or "").split()
        if tag == "a" and at.get("href"):
            self.anchors.append([at["href"], ""])
        if tag == "script" and at.get("type") == "application/ld+json":
            self._script = []
        if tag in ("th", "td"):
            self._cell = [tag, []]
        if self._open is None and self.card in classes:
            self._open, self._depth = {"name": "", "url": None, "price": "", "new_price": "", "image": None, "stock": "", "brand": ""}, 0
        if self._open is not None:
            if tag not in ("img", "br", "input", "meta", "link", "hr"):
                self._depth += 1
            if tag == "a" and at.get("href") and self._open["url"] is None:
                self._open["url"] = at["href"]
            if tag == "img" and at.get("src") and self._open["image"] is None:
                self._open["image"] = at["src"]
            self._field = next((f for f, names in {"name": ("name", "title"), "new_price": ("price-new", "special-price"), "price": ("price", "price-normal"), "stock": ("stock",), "brand": ("brand",)}.items() if set(names) & set(classes)), None)

    def handle_endtag(self, tag):
        if tag == "script" and self._script is not None:
            self.scripts.append("".join(self._script))
            self._script = None
        if tag in ("th", "td") and self._cell:
            self.specs.append((self._cell[0], " ".join("".join(self._cell[1]).split())))
            self._cell = None
        if self._open is not None:
            self._depth -= 1
            self._field = None
            if self._depth <= 0:
                self.cards.append(self._open)
                self._open = None

    def handle_data(self, data):
        if self._script is not None:
            self._script.append(data)
            return
        if self._cell:
            self._cell[1].append(data)
        if self.anchors and self.lasttag == "a":
            self.anchors[-1][1] += data
        if self._open is not None and getattr(self, "_field", None):
            self._open[self._field] += data


def _walk(page: str | None, card: str) -> _Walk:
    walk = _Walk(card)
    walk.feed(page or "")
    walk.close()
    return walk


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, position, url, label) of all links, resolved against their page."""
    ready(pages.sparkSession)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, n, base, href, " ".join(text.split())) for i, base, page in frame.itertuples(index=False) for n, (href, text) in enumerate(_walk(page, "").anchors)]
            yield pd.DataFrame(found, columns=["page_id", "position", "base", "href", "label"])

    raw = pages.select("page_id", "url", "html").mapInPandas(rows, "page_id long, position int, base string, href string, label string")
    return raw.select("page_id", "position", join_url(F.col("base"), F.col("href")).alias("url"), "label")


def product_cards(pages: DataFrame, card: str) -> DataFrame:
    """One row for each element of class ``card``; a new price beats the normal one and a leading "from" is told apart."""
    ready(pages.sparkSession)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, n, base, *(c[k] for k in ("name", "url", "price", "new_price", "image", "stock", "brand"))) for i, base, page in frame.itertuples(index=False) for n, c in enumerate(_walk(page, card).cards)]
            yield pd.DataFrame(found, columns=["page_id", "position", "base", "name", "href", "price", "new_price", "image", "stock", "brand"])

    schema = "page_id long, position int, base string, name string, href string, price string, new_price string, image string, stock string, brand string"
    raw = pages.select("page_id", "url", "html").mapInPandas(rows, schema)
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    price = F.coalesce(clean("new_price"), clean("price"))
    return raw.select(
        "page_id", "position", clean("name").alias("name"), join_url(F.col("base"), F.col("href")).alias("product_url"), price.alias("price"),
        F.coalesce(price.rlike("(?i)^from\\b"), F.lit(False)).alias("is_from"), join_url(F.col("base"), F.col("image")).alias("image_url"), clean("stock").alias("in_stock"), clean("brand").alias("brand"),
    )


def embedded_products(pages: DataFrame) -> DataFrame:
    """The JSON-LD product that describes each page: name, brand, first price, stock and image; pages without one have no row.

    Of several, the one whose url, @id or offer url ends as the page's own is taken, then the first.
    """
    ready(pages.sparkSession)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, base, n, s) for i, base, page in frame.itertuples(index=False) for n, s in enumerate(_walk(page, "").scripts)]
            yield pd.DataFrame(found, columns=["page_id", "url", "script", "body"])

    raw = pages.select("page_id", "url", "html").mapInPandas(rows, "page_id long, url string, script int, body string")
    node = F.try_parse_json("body")
    listed = raw.select("page_id", "url", "script", node.alias("node")).where("node IS NOT NULL")
    text = lambda v, p: F.try_variant_get(v, p, "string")
    many = F.coalesce(F.try_variant_get("node", "$['@graph']", "array<variant>"), F.try_variant_get("node", "$", "array<variant>"), F.array("node"))
    each = listed.select("page_id", "url", "script", F.posexplode(many).alias("place", "p"))
    offer = lambda p: F.coalesce(text("p", f"$.offers.{p}"), text("p", f"$.offers[0].{p}"))
    kind = F.coalesce(text("p", "$['@type']"), F.array_join(F.try_variant_get("p", "$['@type']", "array<string>"), ","))
    tail = lambda c: F.element_at(F.split(F.regexp_replace(c, r"[/?#]+$", ""), "/"), -1)
    own = F.exists(F.array_compact(F.array(text("p", "$.url"), text("p", "$['@id']"), offer("url"))), lambda u: tail(u) == tail(F.col("url")))
    stock = offer("availability")
    fields = each.where(F.concat(F.lit(","), kind, F.lit(",")).contains("Product")).select(
        "page_id", "script", "place", own.alias("own"), text("p", "$.name").alias("name"), F.coalesce(text("p", "$.brand.name"), text("p", "$.brand")).alias("brand"),
        F.coalesce(offer("price"), offer("lowPrice")).alias("price"), F.regexp_replace(stock, "^.*/", "").alias("in_stock"), F.coalesce(text("p", "$.image[0]"), text("p", "$.image")).alias("image_url"), text("p", "$.sku").alias("sku"),
    )
    first = Window.partitionBy("page_id").orderBy(F.desc("own"), "script", "place")
    return fields.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "script", "place", "own")


def spec_tables(pages: DataFrame) -> DataFrame:
    """(page_id, specifications): a map from each th to the td after it; of equal names the last holds."""
    ready(pages.sparkSession)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for i, page in frame.itertuples(index=False):
                cells = _walk(page, "").specs
                found.append((i, {a[1]: b[1] for a, b in zip(cells, cells[1:], strict=False) if a[0] == "th" and b[0] == "td"}))
            yield pd.DataFrame(found, columns=["page_id", "specifications"])

    return pages.select("page_id", "html").mapInPandas(rows, "page_id long, specifications map<string,string>")


def detail_over_listing(listing: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Detail pages override stock and fill in what the listing lacks."""
    joined = listing.alias("l").join(detail.alias("d"), key, "left")
    filled = [F.coalesce(f"l.{c}", f"d.{c}").alias(c) for c in ("brand", "price", "image_url")]
    rest = [F.col(f"l.{c}") for c in listing.columns if c not in ("brand", "price", "image_url", "in_stock", key)]
    return joined.select(key, *rest, *filled, F.coalesce("d.in_stock", "l.in_stock").alias("in_stock"))


def price_disagreements(listing: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    number = lambda c: parse_number(F.col(c)).cast("decimal(12,2)")
    both = listing.select(key, number("price").alias("listed")).join(detail.select(key, number("price").alias("detailed")), key)
    return both.where(F.col("listed").isNotNull() & F.col("detailed").isNotNull() & (F.col("listed") != F.col("detailed")))


def page_signatures(cards: DataFrame) -> DataFrame:
    """Each page's distinct product URLs as one digest, with whether another page of its category has the same."""
    urls = cards.groupBy("category", "page_id").agg(F.array_sort(F.collect_set("product_url")).alias("urls"))
    signed = urls.select("category", "page_id", F.size("urls").alias("products"), F.sha2(F.array_join("urls", "\n"), 256).alias("signature"))
    seen = signed.groupBy("category", "signature").agg(F.count(F.lit(1)).alias("pages"))
    return signed.join(seen, ["category", "signature"]).withColumn("repeated", F.col("pages") > 1)


def page_numbers(html_: Column) -> tuple[Column, Column]:
    """(last page number that links name, number in a "(N Pages)" summary)."""
    linked = F.array_max(F.transform(F.regexp_extract_all(html_, F.lit(r"[?&;]page=(\d+)"), F.lit(1)), lambda n: n.cast("int")))
    summed = F.nullif(F.regexp_extract(html_, r"\((\d+) Pages?\)", 1), F.lit("")).cast("int")
    return linked, summed


def explicit_empty(html_: Column, notice: str = "There are no products to list in this category.") -> Column:
    return F.coalesce(html_.contains(f">{notice}<"), F.lit(False))


def category_seeds(links: DataFrame) -> DataFrame:
    """The shortest way (depth, url) to each category."""
    return links.groupBy("category").agg(F.min(F.struct("depth", "url")).alias("seed")).select("category", "seed.depth", "seed.url")


def missing_categories(seeds: DataFrame, required: list[str]) -> list[str]:
    """Required categories that no seed leads to; the required list bounds what is collected."""
    found = {r[0] for r in seeds.where(F.col("category").isin(required)).select("category").distinct().collect()}
    return sorted(set(required) - found)


VARIANT = "struct<id:string,title:string,option1:string,option2:string,option3:string,sku:string,price:string,compare_at_price:string,available:boolean>"
COLLECTION = f"struct<id:string,title:string,handle:string,vendor:string,options:array<struct<name:string>>,variants:array<{VARIANT}>,images:array<struct<src:string>>>"


def collection_products(payloads: DataFrame) -> DataFrame:
    """Products of collection payloads (column ``body``): tri-state stock and the least price of available variants, else of all."""
    each = payloads.select(F.explode(F.from_json("body", f"struct<products:array<{COLLECTION}>>")["products"]).alias("p"))
    variants = F.col("p.variants")
    available = F.transform(variants, lambda v: v["available"])
    stock = F.when(F.exists(available, lambda a: F.coalesce(a, F.lit(False))), True).when((F.size(available) > 0) & F.forall(available, lambda a: F.coalesce(~a, F.lit(False))), False)
    prices = lambda vs: F.array_min(F.transform(vs, lambda v: parse_number(v["price"]).cast("decimal(12,2)")))
    best = F.coalesce(prices(F.filter(variants, lambda v: F.coalesce(v["available"], F.lit(False)))), prices(variants))
    return each.select(F.col("p.id").alias("provider_product_id"), F.col("p.title").alias("name"), F.col("p.vendor").alias("brand"), F.concat(F.lit("/products/"), "p.handle").alias("product_url"), best.alias("price"), stock.alias("in_stock"), F.try_element_at("p.images", F.lit(1))["src"].alias("image_url"))


def collection_variants(payloads: DataFrame, excluded: str = "(?i)\\b(gift card|bundle)\\b") -> DataFrame:
    """One row for each variant, with its options by name; titles that match ``excluded`` are left out."""
    each = payloads.select(F.explode(F.from_json("body", f"struct<products:array<{COLLECTION}>>")["products"]).alias("p")).where(~F.col("p.title").rlike(excluded))
    v = each.select("p", F.explode("p.variants").alias("v"))
    names = F.transform(F.coalesce("p.options", F.array().cast("array<struct<name:string>>")), lambda o: o["name"])
    values = F.array("v.option1", "v.option2", "v.option3")
    pairs = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("key"), F.get(values, i).alias("value"))), lambda e: e["value"].isNotNull() & (e["value"] != "Default Title"))
    return v.select(
        F.col("p.id").alias("provider_product_id"), F.col("v.id").alias("provider_variant_id"), F.col("p.title").alias("name"), F.col("p.vendor").alias("brand"), F.concat(F.lit("/products/"), "p.handle").alias("product_url"),
        F.col("v.price").alias("price"), F.col("v.compare_at_price").alias("old_price"), F.col("v.available").cast("string").alias("in_stock"), F.col("v.sku").alias("sku"), F.map_from_entries(pairs).alias("variant"),
    )


STORE = "struct<id:string,name:string,permalink:string,sku:string,is_in_stock:boolean,prices:struct<price:string,regular_price:string,currency_minor_unit:int>,images:array<struct<src:string>>,brands:array<struct<name:string>>>"


def store_products(payloads: DataFrame) -> DataFrame:
    """Products of store payloads (a JSON array in ``body``) with prices in minor units."""
    ready(payloads.sparkSession)
    each = payloads.select(F.explode(F.from_json("body", f"array<{STORE}>")).alias("p"))
    money = lambda c: minor_units(F.col(f"p.prices.{c}"), F.col("p.prices.currency_minor_unit"))
    return each.select(F.col("p.id").alias("provider_product_id"), unescape(F.col("p.name")).alias("name"), F.col("p.permalink").alias("product_url"), money("price").alias("price"), money("regular_price").alias("old_price"), F.col("p.is_in_stock").alias("in_stock"), "p.sku", F.try_element_at("p.images", F.lit(1))["src"].alias("image_url"), F.try_element_at("p.brands", F.lit(1))["name"].alias("brand"))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return text.map(lambda x: None if x is None else html.unescape(x))


def category_tree(nodes: DataFrame, depth: int = 1000, scratch: Scratch | None = None) -> DataFrame:
    """(id, path) of a category tree (id, parent, name) from the roots, whose parent is null.

    A node under several parents has a path for each. A node that is its own ancestor is not
    entered again, so a cycle below a root ends, and one that no root leads to is not seen. A
    null name is an empty one. ``depth`` is a bound on levels beyond which the query fails.

    Where no id is repeated, each node holds the end of its path, and ends double in length
    until they begin at a root; otherwise levels are read one after the other.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "tree")
    # A node without an id can be a root, but nobody's child.
    named = scratch.put("nodes", nodes.where("id IS NOT NULL OR parent IS NULL").select("id", "parent", F.coalesce("name", F.lit("")).alias("name")))
    repeated = named.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
    return _by_levels(named, depth, scratch) if not repeated.isEmpty() else _by_doubling(named, depth, scratch)


def _by_doubling(nodes: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Paths where each id is one node: an end that hasn't begun at a root gets that of the node above it in front."""
    ends, whole, size = nodes.select("id", F.col("parent").alias("top"), F.array("name").alias("path")), [], 1
    while True:
        whole.append(ends.where("top IS NULL"))
        rest, done = ends.where("top IS NOT NULL"), reduce(DataFrame.union, whole)
        # Ends of the full depth that hang on a path are too long; what hangs on none never comes to a root.
        above = (done if size >= depth else done.union(rest)).select(F.col("id").alias("_id"), F.col("top").alias("_top"), F.col("path").alias("_path"))
        # The tables are small as files and large as rows, so they aren't to be broadcast.
        longer = rest.join(above.hint("merge"), F.col("top") == F.col("_id")).select("id", F.col("_top").alias("top"), F.concat("_path", "path").alias("path"))
        if size >= depth:
            if not longer.isEmpty():
                raise ValueError(f"a category tree of more than {depth} levels")
            break
        ends, size = scratch.put(f"ends-{size}", longer), 2 * size
        if ends.isEmpty():
            break
    if size > depth and not done.where(F.size("path") > depth).isEmpty():
        raise ValueError(f"a category tree of more than {depth} levels")
    return done.select("id", "path")


def _by_levels(nodes: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Paths where a node may have several parents, each level from the one above."""
    level, levels = nodes.where("parent IS NULL").select("id", F.array("name").alias("path"), F.array("id").alias("seen")), []
    while True:
        level = scratch.put(f"level-{len(levels)}", level)
        if level.isEmpty():
            break
        if len(levels) == depth:
            raise ValueError(f"a category tree of more than {depth} levels")
        levels.append(level)
        below = level.select(F.col("id").alias("parent"), F.col("path").alias("_path"), F.col("seen").alias("_seen"))
        below = nodes.join(below.hint("merge"), "parent").where(~F.array_contains("_seen", F.col("id")))
        level = below.select("id", F.concat("_path", F.array("name")).alias("path"), F.concat("_seen", F.array("id")).alias("seen"))
    return reduce(DataFrame.union, levels or [level]).select("id", "path")


#: A script's push of one piece: a string literal.
PUSHED = re.compile(r'push\(\[1,\s*("(?:[^"\\]|\\.)*")\]\)')


def _nodes(page: str, key: str) -> Iterator[tuple[str | None, dict]]:
    """Each node of a page's tree with its parent's id; a piece, tree or node that can't be read is passed over, with what hangs below it."""
    pieces = []
    for piece in PUSHED.findall(page):
        with contextlib.suppress(ValueError):
            pieces.append(json.loads(piece))
    text = "".join(pieces)
    at = text.find(f'"{key}":')
    if at < 0:
        return
    try:
        tree, _ = json.JSONDecoder().raw_decode(text[at + len(key) + 3 :].lstrip())
    except ValueError:
        return
    level = [(None, node) for node in tree] if isinstance(tree, list) else []
    while level:
        level = [(parent, n) for parent, n in level if isinstance(n, dict) and n.get("id") is not None and isinstance(n.get("name"), str)]
        yield from level
        level = [(str(n["id"]), child) for _, n in level for child in (n["children"] if isinstance(n.get("children"), list) else [])]


def hydrated_tree(pages: DataFrame, key: str) -> DataFrame:
    """(page_id, id, parent, name) of the category tree that a page's scripts push in pieces under a JSON key.

    The pieces are string literals; put together they hold nodes with id, name and children.
    What can't be read gives no row; other pages and nodes are not touched by it.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple] = []
            for page_id, page in frame.itertuples(index=False):
                for parent, node in _nodes(page or "", key):
                    found.append((page_id, str(node["id"]), parent, node["name"]))
            yield pd.DataFrame(found, columns=["page_id", "id", "parent", "name"])

    ready(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(rows, "page_id long, id string, parent string, name string")


def unfinished(discovered: DataFrame, finished: DataFrame, key: str = "category") -> DataFrame:
    """Categories that were found and not crawled to their end, or the other way round."""
    a, b = discovered.select(key).distinct(), finished.select(key).distinct()
    return a.exceptAll(b).union(b.exceptAll(a))


ITEM = "struct<id:string,title:string,category:string,price:string,discount_price:string,options:array<struct<name:string,values:array<string>>>,in_stock:boolean>"


def api_items(payloads: DataFrame, wanted: str, unwanted: str) -> DataFrame:
    """Items of a detail API (``body``) whose title fits: a discount is the price and the price the old one; an option's first value holds."""
    each = payloads.select(F.explode(F.from_json("body", f"struct<items:array<{ITEM}>>")["items"]).alias("i")).where(F.col("i.title").rlike(wanted) & ~F.col("i.title").rlike(unwanted))
    options = F.map_from_entries(F.transform(F.coalesce("i.options", F.array().cast("array<struct<name:string,values:array<string>>>")), lambda o: F.struct(o["name"].alias("key"), F.get(o["values"], F.lit(0)).alias("value"))))
    cut = parse_number(F.col("i.discount_price")).isNotNull()
    return each.select(
        F.col("i.id").alias("provider_product_id"), F.col("i.title").alias("name"), F.col("i.category").alias("category"), F.when(cut, F.col("i.discount_price")).otherwise(F.col("i.price")).alias("price"),
        F.when(cut, F.col("i.price")).alias("old_price"), F.col("i.in_stock").cast("string").alias("in_stock"), options.alias("variant"),
    )


#: Readers by name; a new source is one function from payloads or pages to raw listings.
READERS = {"collection": collection_products, "collection-variants": collection_variants, "store": store_products, "embedded": embedded_products}
