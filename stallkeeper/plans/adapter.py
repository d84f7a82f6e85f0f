"""Catalog tables as views of the supplied star schema; the same mapping as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DIRECT, WITH_MARKETPLACE

#: The horizon fits the tables' dates.
AS_OF, DAYS = "2001-06-01 00:00:00", 900

SQL = f"""
providers AS (
  SELECT s_suppkey AS provider_id, s_name AS provider_name,
    CASE WHEN s_suppkey % 5 < 3 THEN '{DIRECT}' WHEN s_suppkey % 5 = 3 THEN '{WITH_MARKETPLACE}' ELSE 'UNVERIFIED' END AS trust,
    CASE WHEN s_suppkey % 10 = 0 THEN 'failed' WHEN s_suppkey % 10 = 1 THEN NULL ELSE 'succeeded' END AS last_crawl_status
  FROM supplier
), offers AS (
  SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS offer_id, l_partkey AS product_id,
    l_partkey * 10 + l_linenumber AS variant_id, l_suppkey AS provider_id,
    CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price,
    CASE WHEN l_discount = 0 THEN 'placeholder' ELSE 'known' END AS price_status,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS in_stock,
    CASE l_linestatus WHEN 'O' THEN 'new' ELSE 'used' END AS condition,
    l_shipdate AS last_seen_at, l_suppkey % 3 AS seller_id, 'EGP' AS currency, l_extendedprice AS tie,
    'https://shop' || l_suppkey || '.example/p/' || l_partkey AS url, CASE WHEN l_linenumber % 3 > 0 THEN 'https://img.example/' || l_partkey || '-' || l_linenumber || '.jpg' END AS image_url
  FROM lineitem
), trusted AS (
  SELECT o.*, p.provider_name,
    p.last_crawl_status IS DISTINCT FROM 'failed' AND last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AS is_current
  FROM offers o JOIN providers p USING (provider_id)
  WHERE trust = '{DIRECT}' OR (trust = '{WITH_MARKETPLACE}' AND seller_id IN (0, 1))
), products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand, CAST(ascii(p_type) * 100 + length(p_type) AS BIGINT) AS category_id, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS brand_id,
    make_timestamp((694224000 + CAST(p_size AS BIGINT) * 86400) * 1000000) AS created_at, make_timestamp((902000000 + CAST(p_partkey % 1000 AS BIGINT) * 3600) * 1000000) AS updated_at FROM part
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY is_current DESC,
      (coalesce(in_stock, false) AND price_status = 'known' AND condition = 'new') DESC,
      (price_status = 'known' AND condition = 'new') DESC, (price_status = 'known') DESC,
      CASE WHEN is_current THEN price END ASC NULLS LAST, last_seen_at DESC NULLS LAST, price ASC NULLS LAST, offer_id, tie) AS rn
  FROM trusted
), best AS (
  SELECT product_id, offer_id, variant_id, provider_id, provider_name, condition, currency, last_seen_at,
    CASE WHEN is_current THEN price END AS price,
    CASE WHEN is_current THEN price_status WHEN price_status = 'known' THEN 'stale' ELSE 'not_found' END AS price_status,
    CASE WHEN NOT is_current AND price_status = 'known' THEN price END AS last_seen_price,
    is_current AND coalesce(in_stock, false) AS in_stock, is_current AND in_stock IS NOT NULL AS stock_known, url, image_url
  FROM ranked WHERE rn = 1
), model AS (
  SELECT p.product_id, p.name, p.category, p.brand, p.category_id, p.brand_id, p.created_at, p.updated_at, b.* EXCLUDE (product_id), o.provider_ids, o.offer_count, v.variant_count
  FROM products p JOIN best b USING (product_id)
  JOIN (SELECT product_id, list_sort(list(DISTINCT provider_id) FILTER (is_current)) AS provider_ids, count(*) FILTER (is_current) AS offer_count FROM trusted GROUP BY 1) o USING (product_id)
  LEFT JOIN (SELECT product_id, count(DISTINCT variant_id) AS variant_count FROM offers GROUP BY 1) v USING (product_id)
)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        key.alias("provider_id"), F.col("s_name").alias("provider_name"),
        F.when(key % 5 < 3, DIRECT).when(key % 5 == 3, WITH_MARKETPLACE).otherwise("UNVERIFIED").alias("trust"),
        F.array(F.lit(0).cast("long"), F.lit(1).cast("long")).alias("approved_sellers"),
        F.when(key % 10 == 0, "failed").when(key % 10 != 1, "succeeded").alias("last_crawl_status"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("l_discount") != 0
    flag = F.col("l_returnflag")
    return _table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber").alias("offer_id"), F.col("l_partkey").alias("product_id"),
        F.expr("l_partkey * 10 + l_linenumber").alias("variant_id"), F.col("l_suppkey").alias("provider_id"),
        F.when(known, F.col("l_extendedprice").cast("decimal(12,2)")).alias("price"), F.when(known, "known").otherwise("placeholder").alias("price_status"),
        F.when(flag == "A", True).when(flag == "R", False).alias("in_stock"), F.when(F.col("l_linestatus") == "O", "new").otherwise("used").alias("condition"),
        F.col("l_shipdate").alias("last_seen_at"), (F.col("l_suppkey") % 3).alias("seller_id"), F.lit("EGP").alias("currency"), F.col("l_extendedprice").alias("tie"),
        F.concat(F.lit("https://shop"), "l_suppkey", F.lit(".example/p/"), "l_partkey").alias("url"),
        F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("https://img.example/"), "l_partkey", F.lit("-"), "l_linenumber", F.lit(".jpg"))).alias("image_url"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    category_id, brand_id = F.ascii("p_type") * 100 + F.length("p_type"), F.regexp_extract("p_brand", "[0-9]+", 0)
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        category_id.cast("long").alias("category_id"), F.nullif(brand_id, F.lit("")).cast("long").alias("brand_id"),
        F.timestamp_seconds(F.col("p_size") * 86400 + 694224000).alias("created_at"), F.timestamp_seconds(F.col("p_partkey") % 1000 * 3600 + 902000000).alias("updated_at"),
    )


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.offers import trusted_offers

    return trusted_offers(offers(spark, sf_dir), providers(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), DAYS)


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.offers import read_model

    variants = offers(spark, sf_dir).select("product_id", "variant_id").distinct()
    return read_model(products(spark, sf_dir), variants, trusted(spark, sf_dir), [F.col("tie")])
