"""Saved pages and payloads of each shop as a Spark data source, and the listings that its reader finds in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..workers import ready
from . import pages as P

#: Bytes of files that one task reads; a larger file is read alone.
TASK_BYTES = 32 << 20


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    """Files named by their URL in percent encoding, each a page or payload as it came."""

    def __init__(self, shop: str, path: str):
        if not path:
            raise ValueError("load() needs the folder of saved pages")
        self.shop, self.path = shop, path

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._open()
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        groups: list[list[str]] = [[]]
        size = 0
        for f in sorted(found, key=lambda f: f.path):
            if groups[-1] and size + f.size > TASK_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._open()
        for name in partition.names:
            with system.open_input_stream(name) as file:
                body = file.read().decode("utf-8", "replace")
            url = unquote(name.rsplit("/", 1)[-1])
            columns = [pa.array([self.shop]), pa.array([crc32(url.encode())], pa.int64()), pa.array([url]), pa.array([body])]
            yield pa.RecordBatch.from_arrays(columns, ["provider", "page_id", "url", "html"])


class SavedPages(DataSource):
    """provider, page_id, url and html (whatever the body is) of all files in a folder."""

    shop = ""

    @classmethod
    def name(cls) -> str:
        return cls.shop

    def schema(self) -> str:
        return "provider string, page_id long, url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.shop, self.options.get("path", ""))


def _payloads(reader: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda found: reader(found.select(F.col("html").alias("body")))


def _cards(found: DataFrame) -> DataFrame:
    """Cards of listing pages; a page that describes one product fills in what its card lacks and overrides its stock."""
    listed = P.product_cards(found, "product-thumb").select("product_url", "name", "brand", "price", "in_stock", "image_url")
    detail = P.embedded_products(found).join(found.select("page_id", F.col("url").alias("product_url")), "page_id").select("product_url", "brand", "price", "in_stock", "image_url")
    return P.detail_over_listing(listed, detail, "product_url")


def _described(found: DataFrame) -> DataFrame:
    """The product that each page describes, with the specifications of its table; the widest GTIN in them is the product's."""
    specs = P.spec_tables(found)
    joined = P.embedded_products(found).join(specs, "page_id").join(found.select("page_id", F.col("url").alias("product_url")), "page_id")
    gtin = F.coalesce(*(F.element_at("specifications", k) for k in ("gtin14", "gtin13", "gtin12", "gtin8", "gtin")))
    return joined.select("product_url", "name", "brand", "price", "in_stock", "image_url", "sku", "specifications", gtin.alias("gtin"))


# The shops and what their pages are; the last one is asked for by name only, as its stock and access are not settled.
SHOPS = {
    "sigma": _cards, "elnekhely": _cards, "elbadr": _cards, "alfrensia": _payloads(P.store_products), "maximum": _cards,
    "compumarts": _payloads(P.collection_products), "dream2000": _payloads(P.collection_variants), "tradeline": _payloads(P.collection_variants),
    "twob": _described, "switchplus": _payloads(lambda found: P.api_items(found, ".", "(?!)")),
}
DEFAULT_SHOPS = tuple(name for name in SHOPS if name != "switchplus")
LISTING = "provider string, name string, brand string, product_url string, price string, old_price string, in_stock string, image_url string, sku string, gtin string, provider_product_id string, provider_variant_id string, variant map<string,string>, specifications map<string,string>"


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format(shop).load(folder)`` known for every shop."""
    ready(spark)
    for shop in SHOPS:
        spark.dataSource.register(type(f"Saved_{shop}", (SavedPages,), {"shop": shop}))


def listings(spark: SparkSession, shop: str, folder: str) -> DataFrame:
    """What a shop's reader finds in its saved pages, in the columns of LISTING; what it doesn't say is null."""
    if shop not in SHOPS:
        raise ValueError(f"unknown shop {shop!r}; there are {', '.join(SHOPS)}")
    found = SHOPS[shop](spark.read.format(shop).load(folder))
    kinds = dict(c.split() for c in LISTING.split(", "))
    return found.select(*(F.lit(shop).alias(c) if c == "provider" else F.col(c).cast(t).alias(c) if c in found.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()))


def all_listings(spark: SparkSession, folder: str, shops: tuple[str, ...] = DEFAULT_SHOPS) -> DataFrame:
    """The listings of several shops, by default of all that need not be asked for, each from its folder below ``folder``."""
    each = [listings(spark, shop, f"{folder}/{shop}") for shop in shops]
    found = each[0]
    for other in each[1:]:
        found = found.union(other)
    return found
