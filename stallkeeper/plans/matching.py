"""Queries over titles, pages and payload texts: normalizing, matching, decisions and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import listing as L
from ..functions import text as T
from ..operators import repair as P
from ..operators import resolve as R
from ..scratch import Scratch
from ..sources import pages as W
from .common import query, table

# Listings from parts: the code in the title stands for a model number.
LISTED = """listed AS (
  SELECT p_partkey AS variant_id, p_partkey AS product_id, p_type AS category, lower(replace(p_brand, '#', ' ')) AS brand, p_name || ' gx' || (10 + p_size % 10) AS title, p_retailprice, 'gx' || (10 + p_size % 10) AS code,
    p_size AS provider, CAST(p_partkey % 400 AS VARCHAR) AS mpn FROM part
), tokened AS (SELECT *, list_sort(list_distinct(list_filter(string_split(title, ' '), lambda w: length(w) >= 3 AND NOT list_contains(['red', 'blue', 'new'], w)))) AS tokens FROM listed)"""
PAIRED = f"""{LISTED}, keyed AS (SELECT *, category || brand || 'w' || code AS block, true AS capped FROM tokened UNION ALL SELECT *, category || brand || 'm' || mpn, false FROM tokened),
sized AS (SELECT *, count(*) OVER (PARTITION BY block) AS size FROM keyed), held AS (SELECT * FROM sized WHERE NOT capped OR size <= 100),
pairs AS (SELECT DISTINCT a.variant_id AS "left", b.variant_id AS "right" FROM held a JOIN held b ON a.block = b.block AND a.variant_id <> b.variant_id AND a.provider <> b.provider),
scored AS (SELECT "left", "right", CASE WHEN a.mpn = b.mpn THEN 1.0 ELSE greatest(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))), CASE WHEN a.code = b.code THEN 0.5 ELSE 0 END) END AS score, a.mpn <> b.mpn AS apart
  FROM pairs JOIN tokened a ON a.variant_id = "left" JOIN tokened b ON b.variant_id = "right")"""


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" gx"), F.col("p_size") % 10 + 10)
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    mpn = (F.col("p_partkey") % 400).cast("string")
    e = I.evidence(F.col("p_type"), F.col("p_brand"), title, mpn, none, none, empty, empty)
    # Patterns are looked for once a row, in more tasks than there are files.
    parts = table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return Scratch(spark, "listings").put("listings", parts.select(F.col("p_partkey").alias("variant_id"), F.col("p_partkey").alias("product_id"), F.array("p_size").alias("provider_ids"), e.alias("e")))


@query(f'WITH {PAIRED} SELECT "left", "right" FROM pairs')
def blocking_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return R.candidate_pairs(_listings(spark, sf), categories=None)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    listings = _listings(spark, sf)
    return R.score_pairs(R.candidate_pairs(listings, categories=None), listings)


@query(f'WITH {PAIRED} SELECT "left", "right", round(score, 6) AS score FROM scored')
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).withColumn("score", F.round("score", 6))


@query(f"""WITH {PAIRED}, r AS (SELECT *, row_number() OVER (PARTITION BY "left" ORDER BY score DESC, "right") AS rn FROM scored)
SELECT DISTINCT least("left", "right") || ':' || greatest("left", "right") AS pair_key, least("left", "right") AS "left", greatest("left", "right") AS "right", round(score, 6) AS score FROM r WHERE rn <= 4 AND score >= 0.45""")
def top4_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_candidates(_scored(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {PAIRED} SELECT "left", "right", CASE WHEN apart THEN 'mpn' ELSE '' END AS conflicts, CASE WHEN apart THEN 'different_product' ELSE 'same_exact_variant' END AS verdict FROM scored""")
def pair_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    listings = _listings(spark, sf)
    return R.pair_verdicts(R.candidate_pairs(listings, categories=None), listings).withColumn("conflicts", F.array_join("conflicts", ","))


# Pairs of titles by kind with what they settle (category, left, right, conflicts, verdict).
CASES = (
    ("gpu", "Card RTX 4060 Eagle", "RTX 4060 Eagle card", "", "same_exact_variant"),
    ("gpu", "Card RTX 4060 Eagle", "Card RTX 4060 Windforce", "board_family", "different_product"),
    ("mobile_phones", "iPhone 18 Pro 256GB", "ＩＰＨＯＮＥ 18 Pro 512GB", "storage", "same_product_different_variant"),
    ("cpu", "Ryzen 7 7800X3D tray", "Ryzen 7 7800X3D boxed", "package", "same_product_different_variant"),
    ("gpu", "Card RTX 4060 Eagle", "Card RTX 4060 Eagle", "", "uncertain"),
    ("mobile_phones", "ايفون ١٨ برو ٢٥٦ جيجابايت", "iPhone 17 Pro 256GB", "generation", "different_product"),
)
_CASE = lambda i: " ".join(f"WHEN {k} THEN '{c[i]}'" for k, c in enumerate(CASES))


@query(f'SELECT p_partkey AS "left", p_partkey + 10000000 AS "right", CASE p_size % 6 {_CASE(3)} END AS conflicts, CASE p_size % 6 {_CASE(4)} END AS verdict FROM part')
def verdict_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every verdict, from titles in all spellings."""
    kind = F.col("p_size") % len(CASES)
    of = lambda i: F.get(F.array(*(F.lit(c[i]) for c in CASES)), kind.cast("int"))
    empty = F.lit(None).cast("map<string,string>")
    mpn = F.when(kind == 0, F.col("p_partkey").cast("string"))

    def side(name: str, title: int, shift: int, brand: Column) -> DataFrame:
        rows = table(spark, sf, "part").select(
            (F.col("p_partkey") + shift).alias("variant_id"), of(0).alias("category"), brand.alias("brand"), of(title).alias("title"), mpn.alias("mpn"), F.lit(None).cast("string").alias("gtin"),
            F.lit(None).cast("string").alias("model_number"), empty.alias("options"), empty.alias("specifications"), F.lit(None).cast("array<string>").alias("aliases"),
        )
        return rows

    shift = 10_000_000
    listings = R.with_evidence(side("left", 1, 0, F.lit("b")).union(side("right", 2, shift, F.when(kind != 4, F.lit("B")))))
    pairs = table(spark, sf, "part").select(F.col("p_partkey").alias("left"), (F.col("p_partkey") + shift).alias("right"))
    return R.pair_verdicts(pairs, listings.drop("others")).withColumn("conflicts", F.array_join("conflicts", ","))


@query("""WITH p AS (SELECT p_partkey AS i FROM part), e AS (SELECT i AS a, i + 1 AS b FROM p WHERE i % 2 = 0 AND i + 1 IN (SELECT i FROM p))
SELECT a AS "left", b AS "right", 1.0 AS score FROM e UNION ALL SELECT b, a, 1.0 FROM e""")
def alias_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Listings from the catalog's tables whose main titles share no word meet by an alias."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.concat(F.lit("Model gx"), F.floor(F.col("p_partkey") / 2) + 1000).alias("code"))
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    products = parts.select(F.col("i").alias("product_id"), F.lit("gpu").alias("category"), F.lit("b").alias("brand"), F.col("code").alias("name"), none.alias("model_number"), empty.alias("specifications"))
    variants = parts.select(F.col("i").alias("variant_id"), F.col("i").alias("product_id"), none.alias("mpn"), none.alias("gtin"), empty.alias("options"))
    offer = lambda n, title: parts.select(F.col("i").alias("variant_id"), (F.col("i") * 10 + n).alias("offer_id"), (F.col("i") % 2).alias("provider_id"), title.alias("title"))
    # Of even ones the first title is Arabic and the name an alias.
    offers = offer(1, F.when(F.col("i") % 2 == 0, "بطاقة رسومات")).union(offer(2, none))
    listings = R.listings_of(products, variants, offers)
    return R.score_pairs(R.candidate_pairs(listings), listings)


@query("SELECT l_partkey AS variant_id, min(l_orderkey) AS offer_id FROM lineitem GROUP BY 1")
def first_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_evidence(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("variant_id"), F.col("l_orderkey").alias("offer_id")))


TITLES = "SELECT o_custkey AS variant_id, o_orderkey AS offer_id, o_orderpriority || o_orderstatus AS title FROM orders"


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("variant_id"), F.col("o_orderkey").alias("offer_id"), F.concat("o_orderpriority", "o_orderstatus").alias("title"))


@query(f"""WITH t AS ({TITLES}), m AS (SELECT variant_id, arg_min(title, offer_id) AS main FROM t GROUP BY 1), o AS (SELECT DISTINCT t.variant_id, title FROM t JOIN m ON m.variant_id = t.variant_id AND main <> title),
r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY length(title) DESC, title) AS rn FROM o)
SELECT variant_id, string_agg(title, '|' ORDER BY rn) AS aliases FROM r WHERE rn <= 8 GROUP BY 1""")
def alias_titles(spark: SparkSession, sf: str) -> DataFrame:
    titles = _titles(spark, sf)
    return R.alias_titles(titles, R.first_evidence(titles)).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"SELECT variant_id, title FROM (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY length(title) DESC, offer_id) AS rn FROM ({TITLES})) WHERE rn = 1")
def longest_names(spark: SparkSession, sf: str) -> DataFrame:
    return P.longest_names(_titles(spark, sf))


DECIDED = """d AS (SELECT conv_id || ':' || turn AS pair_key, md5(role) AS left_signature, md5(CAST(length(text) % 7 AS VARCHAR)) AS right_signature, CASE WHEN length(text) % 3 = 0 THEN 'same_exact_variant' ELSE 'different_product' END AS verdict, turn AS created_at FROM conversations)"""


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("text")
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_key"), F.md5("role").alias("left_signature"), F.md5((size % 7).cast("string")).alias("right_signature"),
        F.lit(1).alias("rule_version"), F.when(size % 3 == 0, "same_exact_variant").otherwise("different_product").alias("verdict"), F.col("turn").alias("created_at"),
    )


MERGE_LIMIT = 300
QUEUE = """q AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS pair_key, p_partkey % 997 AS l, (p_partkey * 31 + 7) % 983 AS r, CASE p_size % 3 WHEN 0 THEN 'group' WHEN 1 THEN 'merge' END AS kind, p_size % 7 = 0 AS reviewed, p_partkey % 50 AS created_at FROM part),
d AS (SELECT *, row_number() OVER (ORDER BY reviewed DESC, created_at, pair_key) AS rn FROM q WHERE kind IS NOT NULL)"""


@query(f"""WITH RECURSIVE {QUEUE}, fold(k, n, product, alive, pair_key, action, goes, keeps, from_product, to_product) USING KEY (k) AS (
  SELECT 'c', CAST(0 AS BIGINT), CAST(0 AS BIGINT), true, '', '', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION
  SELECT x.k, x.n, x.product, x.alive, x.pair_key, x.action, x.goes, x.keeps, x.from_product, x.to_product FROM (
    SELECT unnest(list_filter([
        {{'k': 'c', 'n': rn, 'product': made + CASE WHEN action IN ('merge', 'group') THEN 1 ELSE 0 END, 'alive': true, 'pair_key': '', 'action': '', 'goes': NULL::BIGINT, 'keeps': NULL::BIGINT, 'from_product': NULL::BIGINT, 'to_product': NULL::BIGINT}},
        CASE WHEN action <> '' THEN {{'k': 's' || rn, 'n': rn, 'product': 0::BIGINT, 'alive': true, 'pair_key': pair_key, 'action': action, 'goes': CASE WHEN action <> 'applied' THEN goes END, 'keeps': CASE WHEN action <> 'applied' THEN l + r - goes END, 'from_product': CASE WHEN action <> 'applied' THEN greatest(a, b) END, 'to_product': CASE WHEN action <> 'applied' THEN least(a, b) END}} END,
        CASE WHEN action IN ('merge', 'group') THEN {{'k': 'v' || goes, 'n': rn, 'product': least(a, b), 'alive': action = 'group', 'pair_key': '', 'action': '', 'goes': NULL::BIGINT, 'keeps': NULL::BIGINT, 'from_product': NULL::BIGINT, 'to_product': NULL::BIGINT}} END], lambda z: z IS NOT NULL)) AS x
    FROM (SELECT *, CASE WHEN NOT live THEN '' WHEN a = b THEN 'applied' ELSE kind END AS action, CASE WHEN a < b THEN r ELSE l END AS goes FROM (
      SELECT d.*, c.product AS made, coalesce(va.product, d.l // 3) AS a, coalesce(vb.product, d.r // 3) AS b, coalesce(va.alive, true) AND coalesce(vb.alive, true) AS live
      FROM d JOIN fold c ON c.k = 'c' AND d.rn = c.n + 1 AND c.product < {MERGE_LIMIT} LEFT JOIN recurring.fold va ON va.k = 'v' || d.l LEFT JOIN recurring.fold vb ON vb.k = 'v' || d.r))))
SELECT pair_key, action, goes AS variant_id, keeps AS into_variant, from_product AS product_id, to_product AS into_product FROM fold WHERE k LIKE 's%'""")
def merge_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The first merges of a queue whose decisions build on one another."""
    from ..operators import merges as M
    from ..scratch import Scratch

    n = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 3 == 0, I.VARIANT).when(F.col("p_size") % 3 == 1, I.EXACT).otherwise(I.DIFFERENT)
    decisions = table(spark, sf, "part").select(
        F.lpad(n.cast("string"), 8, "0").alias("pair_key"), (n % 997).alias("left"), ((n * 31 + 7) % 983).alias("right"), kind.alias("verdict"), (F.col("p_size") % 7 == 0).alias("reviewed"), (n % 50).alias("created_at")
    )
    ids = decisions.select(F.explode(F.array("left", "right")).alias("variant_id")).distinct()
    variants = ids.select("variant_id", F.floor(F.col("variant_id") / 3).alias("product_id"))
    return M.merge_steps(decisions, variants, Scratch(spark, "merges"), MERGE_LIMIT).drop("place")


@query(f"""WITH {DECIDED}, stored AS (SELECT * FROM d WHERE created_at < 3), latest AS (
  SELECT least(left_signature, right_signature) AS s, greatest(left_signature, right_signature) AS g, arg_max(verdict, created_at || '|' || lpad(pair_key, 20, ' ')) AS v FROM stored GROUP BY 1, 2)
SELECT d.pair_key, coalesce(o.verdict, CASE WHEN v IS NOT NULL THEN 'shared' END) AS verdict, CASE WHEN o.pair_key IS NOT NULL THEN 'exact' WHEN v IS NOT NULL THEN 'signature' ELSE 'none' END AS reused
FROM d LEFT JOIN stored o ON o.pair_key = d.pair_key LEFT JOIN latest ON s = least(d.left_signature, d.right_signature) AND g = greatest(d.left_signature, d.right_signature)""")
def decision_reuse(spark: SparkSession, sf: str) -> DataFrame:
    all_ = _decisions(spark, sf)
    found = R.reuse_decisions(all_.drop("verdict", "created_at", "rule_version"), all_.where("created_at < 3"))
    return found.select("pair_key", F.when(F.col("reused") == "signature", "shared").otherwise(F.col("verdict")).alias("verdict"), "reused")


@query("""SELECT CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 AND a > 0 THEN least(r, greatest(a * 2, r * 0.05)) ELSE r END), 0) AS DOUBLE) AS spent
FROM (SELECT *, CAST(o_totalprice AS DECIMAL(12,4)) AS r, CAST(o_orderkey % 1000 AS DECIMAL(12,4)) AS a FROM orders) WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderstatus IN ('F', 'O')""")
def budget_spent(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    batches = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("created_at"), F.when(status == "F", "completed").when(status == "O", "submitted").otherwise("cancelled").alias("status"),
        F.col("o_totalprice").cast("decimal(12,4)").alias("reserved_usd"),
        F.when(F.col("o_totalprice") > 1000, (F.col("o_orderkey") % 1000).cast("decimal(12,4)")).alias("actual_usd"),
    )
    return R.budget_spent(batches, F.lit("1997-06-20").cast("timestamp")).select(F.col("spent").cast("double").alias("spent"))


@query("""WITH p AS (SELECT conv_id || ':' || turn AS pair_key, length(text) AS score FROM conversations) SELECT pair_key, score FROM p ORDER BY score DESC, pair_key LIMIT 200""")
def priority_fill(spark: SparkSession, sf: str) -> DataFrame:
    return R.fill_budget(table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("pair_key"), F.length("text").alias("score")), 200)


@query("""SELECT '{"custom_id":"' || conv_id || ':' || turn || '","body":{"role":"' || role || '","size":' || length(text) || '}}' AS "value" FROM conversations""")
def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("pair_key"), F.struct("role", F.length("text").alias("size")).alias("body"))
    return R.request_lines(rows, F.col("body"))


@query("SELECT l_partkey AS product_id, count(DISTINCT l_linenumber) AS variants FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1")
def overbroad_products(spark: SparkSession, sf: str) -> DataFrame:
    return P.overbroad_products(_variants(spark, sf))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), F.expr("l_partkey * 10 + l_linenumber").alias("variant_id")).distinct()


@query("""WITH v AS (SELECT DISTINCT l_partkey AS product_id, l_partkey * 10 + l_linenumber AS variant_id FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY variant_id) AS place FROM v)
SELECT variant_id, product_id AS old_product_id, 1000000 + row_number() OVER (ORDER BY product_id, variant_id) - 1 AS new_product_id FROM r WHERE place > 1""")
def gpu_split(spark: SparkSession, sf: str) -> DataFrame:
    variants = _variants(spark, sf)
    return P.split_products(variants, P.overbroad_products(variants), 1_000_000)


@query("SELECT p_partkey AS product_id, p_name AS title, CASE WHEN p_type = 'ECONOMY' AND regexp_matches(p_name, 'ring|bolt') AND NOT regexp_matches(p_name, 'red') THEN 'hdd' ELSE p_type END AS category FROM part")
def storage_recategorize(spark: SparkSession, sf: str) -> DataFrame:
    products = table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    return P.recategorize(products, products, F.col("title"), "ring|bolt", "red", F.col("category") == "ECONOMY", "hdd")


@query("SELECT c_custkey, nullif(regexp_extract(c_name, '(?i)customer#0+([1-9][0-9]*)', 1), '') AS family FROM customer")
def family_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", P.family_name(F.col("c_name"), "customer#0+([1-9][0-9]*)").alias("family"))


# Texts and scalars.

@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents),
k AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(t, ' '), lambda w: length(w) >= 3 AND NOT list_contains(['new','original','with','for','the','and','gaming','wireless','black','white','blue','red','silver','egp','warranty','years','year','gb','tb','hz','inch','ssd','ram'], w)))) AS tokens FROM n)
SELECT doc_id, len(tokens) AS n_tokens, md5(coalesce(array_to_string(tokens, ' '), '')) AS digest FROM k""")
def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "documents").select("doc_id", T.title_tokens(T.normalized(T.fold(F.col("text")))).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'MSI' WHEN p_size % 4 = 1 THEN 'G.Skill' WHEN p_size % 4 = 2 THEN NULL ELSE lower(p_brand) END AS brand FROM part")
def brand_normalize(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_size") % 4
    raw = F.when(kind == 0, "  mSi ").when(kind == 1, "G   Skill").when(kind == 2, "  ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit("\n")))
    return table(spark, sf, "part").select("p_partkey", T.normalize_brand(raw).alias("brand"))


@query(r"""SELECT c_custkey, CAST(nullif(regexp_extract(replace('EGP ' || CAST(c_custkey * 7 AS VARCHAR) || ',000.' || CAST(c_custkey % 1000 AS VARCHAR) || ' only', ',', ''), '\d+(?:\.\d{1,2})?', 0), '') AS DOUBLE) AS price FROM customer""")
def parse_price(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("EGP "), (F.col("c_custkey") * 7).cast("string"), F.lit(",000."), (F.col("c_custkey") % 1000).cast("string"), F.lit(" only"))
    return table(spark, sf, "customer").select("c_custkey", L.parse_price(text).cast("double").alias("price"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 2 THEN c_acctbal END AS price, CASE WHEN c_acctbal <= 2 THEN 'placeholder' ELSE 'known' END AS status FROM customer")
def price_states(spark: SparkSession, sf: str) -> DataFrame:
    price, status = L.price_state(F.col("c_acctbal"), F.lit("price_on_request"))
    return table(spark, sf, "customer").select("c_custkey", price.alias("price"), status.alias("status"))


STOCK = {"view": "In Stock", "error": "Currently OUT OF STOCK", "click": "not available, soon in stock", "purchase": "https://schema.org/InStock", "signup": "Availability: ask"}


@query("SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'purchase' THEN true WHEN 'error' THEN false WHEN 'click' THEN false END AS in_stock FROM events")
def parse_stock(spark: SparkSession, sf: str) -> DataFrame:
    said = F.create_map(*(F.lit(x) for pair in STOCK.items() for x in pair))
    return table(spark, sf, "events").select("event_id", L.parse_stock(F.element_at(said, F.col("event_type"))).alias("in_stock"))


CLASSED = ("renewed {} headset", "{} nvme drive", "used {} hard drive", "{} true wireless buds", "{} mounting kit")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'refurbished' WHEN 2 THEN 'used' ELSE 'new' END AS condition,
CASE p_size % 5 WHEN 0 THEN 'headsets' WHEN 3 THEN 'true_wireless_earbuds' ELSE 'headphones' END AS audio, CASE p_size % 5 WHEN 1 THEN 'ssd' WHEN 2 THEN 'hdd' WHEN 4 THEN 'accessories' ELSE 'hdd' END AS drive FROM part""")
def listing_classes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_size") % 5
    title: Column = F.lit(None).cast("string")
    for i, t in enumerate(CLASSED):
        before, after = t.split("{}")
        title = F.when(kind == i, F.concat(F.lit(before), F.lit("item "), "p_partkey", F.lit(after))).otherwise(title)
    rows = table(spark, sf, "part").select("p_partkey", title.alias("t"))
    return rows.select("p_partkey", L.condition(F.col("t"), F.lit(None).cast("string")).alias("condition"), L.audio_type(F.col("t"), F.lit("headphones")).alias("audio"), L.storage_type(F.col("t"), F.lit("hdd")).alias("drive"))


@query("""WITH g AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 37 % 100000000 AS VARCHAR), 8, '0') AS t FROM orders), d AS (SELECT *, list_transform(string_split(t, ''), lambda c: CAST(c AS INT)) AS n FROM g)
SELECT o_orderkey, t AS gtin, (10 - (3 * (n[7] + n[5] + n[3] + n[1]) + n[6] + n[4] + n[2]) % 10) % 10 = n[8] AS valid, (10 - (n[7] + n[5] + n[3] + n[1] + 3 * (n[6] + n[4] + n[2])) % 10) % 10 = n[8] AS valid_swapped FROM d""")
def gtin_check(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lpad((F.col("o_orderkey") * 37 % 100000000).cast("string"), 8, "0")
    return table(spark, sf, "orders").select("o_orderkey", text.alias("gtin"), L.gtin_is_valid(text).alias("valid"), L.gtin_is_valid(text, swapped_weights=True).alias("valid_swapped"))


@query(r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path FROM pages),
p AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS whole FROM u)
SELECT page_id, CASE WHEN why IS NULL THEN 'https://' || host || whole END AS canonical, why AS reason FROM (
  SELECT *, CASE WHEN host LIKE '%spam%' THEN 'offsite product URL' WHEN NOT regexp_matches(whole, '^/(en|fr)/') THEN 'not a product page' END AS why FROM p)""")
def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    host = L.url_part(F.col("url"), "HOST")
    hosts = F.array(F.when(~host.contains("spam"), host))
    url, why = L.canonical_url(F.col("url"), hosts, host, F.lit("^/(en|fr)/"), F.array().cast("array<string>"))
    return table(spark, sf, "pages").select("page_id", url.alias("canonical"), why.alias("reason"))


SIGNED = r"""WITH c AS (SELECT DISTINCT regexp_extract(url, '://[^/]+/([a-z]+)', 1) AS category, length(html) % 40 AS page_id, regexp_extract(url, '://([^/]+)/', 1) AS product_url FROM pages),
s AS (SELECT category, page_id, count(*) AS products, sha256(string_agg(product_url, chr(10) ORDER BY product_url)) AS signature FROM c GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY category, signature) AS pages, count(*) OVER (PARTITION BY category, signature) > 1 AS repeated FROM s"""


@query(SIGNED)
def page_signatures(spark: SparkSession, sf: str) -> DataFrame:
    cards = table(spark, sf, "pages").select(F.regexp_extract("url", "://[^/]+/([a-z]+)", 1).alias("category"), (F.length("html") % 40).alias("page_id"), F.regexp_extract("url", "://([^/]+)/", 1).alias("product_url"))
    return W.page_signatures(cards)


@query(r"SELECT page_id, CAST(nullif(regexp_extract(url, '[?&;]page=(\d+)', 1), '') AS INT) AS last_page, contains(html, '>There are no products to list in this category.<') AS is_empty FROM pages")
def page_numbers(spark: SparkSession, sf: str) -> DataFrame:
    last, _ = W.page_numbers(F.col("url"))
    return table(spark, sf, "pages").select("page_id", last.alias("last_page"), W.explicit_empty(F.col("html")).alias("is_empty"))


@query("""SELECT CAST(count(*) FILTER (turn > 0 AND role = 'user') * 5 AS BIGINT) AS input_tokens, CAST(count(*) FILTER (turn > 0 AND role = 'user') * 2 AS BIGINT) AS output_tokens, count(*) FILTER (turn > 0 AND role = 'user') AS answers FROM conversations""")
def answer_totals(spark: SparkSession, sf: str) -> DataFrame:
    return R.answer_totals(_replayed(spark, sf))


@query(r"""WITH a AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS host, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ls FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS position, host || hs[i] AS url, trim(ls[i]) AS label FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM a)""")
def page_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return W.anchors(table(spark, sf, "pages"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) / pow(10, o_orderkey % 3) AS price FROM orders")
def minor_units(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", L.minor_units(F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 3).cast("int")).cast("double").alias("price"))


@query("SELECT doc_id, round((strlen(text) + 1000) * 0.0000005 + 3000 * 0.000002, 9) AS cost FROM documents")
def reserve_costs(spark: SparkSession, sf: str) -> DataFrame:
    cost = R.reserve_cost(F.col("text"), 3000, "0.0000005", "0.000002")
    return table(spark, sf, "documents").select("doc_id", F.round(cost.cast("double"), 9).alias("cost"))


@query("""WITH p AS (SELECT conv_id || ':' || turn AS pair_key, length(text) % 50 AS score, CAST((strlen(text) + 1000) * 0.0000005 AS DECIMAL(38,10)) AS cost FROM conversations),
s AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, pair_key ROWS UNBOUNDED PRECEDING) AS spent FROM p) SELECT pair_key, score, CAST(cost AS DOUBLE) AS cost, CAST(spent AS DOUBLE) AS spent FROM s WHERE spent <= 0.5""")
def budget_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The requests, best first, that half a dollar pays for."""
    from ..scratch import Scratch

    cost = R.reserve_cost(F.col("text"), 0, "0.0000005", "0").cast("decimal(38,10)")
    pairs = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("pair_key"), (F.length("text") % 50).alias("score"), cost.alias("cost"))
    found = R.fill_by_cost(pairs, F.lit("0.5").cast("decimal(12,4)"), Scratch(spark, "fill"))
    return found.withColumns({c: F.col(c).cast("double") for c in ("cost", "spent")})


@query("""SELECT CAST(sum(strlen(text)) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens, round(CAST((sum(strlen(text)) * 0.0000001 + sum(turn) * 0.0000005) / 2 AS DOUBLE), 9) AS cost_usd, CAST(NULL AS DOUBLE) AS actual_usd FROM conversations WHERE role = 'user'""")
def answer_cost(spark: SparkSession, sf: str) -> DataFrame:
    """What answers of these sizes cost; some are missing, so nothing replaces the reservation."""
    turns = table(spark, sf, "conversations").select(F.when(F.col("role") == "user", "answered").otherwise("malformed").alias("answer"), F.octet_length("text").cast("long").alias("input_tokens"), F.col("turn").cast("long").alias("output_tokens"))
    found = R.answer_cost(turns, "0.0000001", "0.0000005")
    return found.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in ("cost_usd", "actual_usd")})


TREE = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 40 > 0 THEN o_orderkey - 1 - o_orderkey % 3 END AS parent, o_orderstatus AS name FROM orders"


@query(f"""WITH RECURSIVE n AS ({TREE}), t(id, path) AS (SELECT id, [name] FROM n WHERE parent IS NULL UNION ALL SELECT n.id, list_append(t.path, n.name) FROM t JOIN n ON n.parent = t.id)
SELECT id, array_to_string(path, '/') AS path, len(path) AS depth FROM t""")
def category_paths(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    nodes = table(spark, sf, "orders").select(key.alias("id"), F.when(key % 40 > 0, key - 1 - key % 3).alias("parent"), F.col("o_orderstatus").alias("name"))
    return W.category_tree(nodes).select("id", F.array_join("path", "/").alias("path"), F.size("path").cast("long").alias("depth"))


@query("""SELECT conv_id || ':' || turn AS pair_key, CASE WHEN turn = 0 THEN 'uncertain' WHEN role = 'user' THEN 'different_product' ELSE 'uncertain' END AS verdict, CASE WHEN turn = 0 THEN 'unanswered' WHEN role = 'user' THEN 'answered' ELSE 'malformed' END AS answer FROM conversations""")
def verdict_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf).select("pair_key", "verdict", "answer")


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("pair_key"), "turn", "role")
    good = F.lit('{"status":"completed","output":[{"content":[{"type":"output_text","text":"{\\"verdict\\":\\"different_product\\"}"}]}],"input_tokens":5,"output_tokens":2}')
    answers = turns.where("turn > 0").select(F.col("pair_key").alias("custom_id"), F.when(F.col("role") == "user", good).otherwise("{broken").alias("response"))
    return R.collect_answers(turns.select("pair_key"), answers)
