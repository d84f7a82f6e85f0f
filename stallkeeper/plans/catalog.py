"""Queries over the read model: offers, facets, search, and the snapshot algebra of a sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import offers as O
from ..operators import search as S
from ..operators import staging as G
from ..operators import sync as Y
from ..schemas import DIRECT
from . import adapter as A
from .common import plain, query, table

BEST = "product_id, offer_id, variant_id, provider_id, provider_name, condition, currency, epoch(last_seen_at)::BIGINT AS last_seen_at, price::DOUBLE AS price, price_status, last_seen_price::DOUBLE AS last_seen_price, in_stock, stock_known, url, image_url"
DOCS = f"""WITH {A.SQL}, docs AS (
  SELECT product_id AS id, name, category, brand, provider_id, provider_name, provider_ids, variant_count, offer_count, price::DOUBLE AS price,
    last_seen_price::DOUBLE AS last_seen_price, price_status, CASE WHEN stock_known THEN in_stock END AS in_stock, condition, epoch(last_seen_at)::BIGINT AS last_seen_at,
    concat_ws(chr(10), name, 'Category: ' || category, 'Brand: ' || brand) AS semantic_text, category_id, brand_id, currency, variant_id AS product_variant_id, url AS canonical_product_url, image_url, epoch(created_at)::BIGINT AS created_at, epoch(updated_at)::BIGINT AS updated_at FROM model)"""


@query(f"WITH {A.SQL} SELECT {BEST} FROM best")
def best_offer_per_product(spark: SparkSession, sf: str) -> DataFrame:
    return plain(O.best_offers(A.trusted(spark, sf), [F.col("tie")]))


@query(f"WITH {A.SQL} SELECT name, category, brand, category_id, brand_id, coalesce(array_to_string(provider_ids, ','), '') AS provider_ids, offer_count, variant_count, epoch(created_at)::BIGINT AS created_at, epoch(updated_at)::BIGINT AS updated_at, {BEST} FROM model")
def read_model(spark: SparkSession, sf: str) -> DataFrame:
    return plain(A.model(spark, sf))


@query(f"WITH {A.SQL} SELECT offer_id, is_current, provider_name, price::DOUBLE AS price, price_status, in_stock, condition FROM trusted")
def trusted_current_offers(spark: SparkSession, sf: str) -> DataFrame:
    return plain(A.trusted(spark, sf).select("offer_id", "is_current", "provider_name", "price", "price_status", "in_stock", "condition"))


SHOWN = "ORDER BY is_current DESC, (coalesce(in_stock, false) AND price_status = 'known' AND condition = 'new') DESC, price ASC NULLS LAST, offer_id, tie"


@query(f"WITH {A.SQL} SELECT product_id, offer_id, price::DOUBLE AS price, row_number() OVER (PARTITION BY product_id {SHOWN}) AS position FROM trusted")
def offers_for_product(spark: SparkSession, sf: str) -> DataFrame:
    return plain(O.offers_of(A.trusted(spark, sf), tie_break=[F.col("tie")]).select("product_id", "offer_id", "price", "position"))


@query(f"""WITH {A.SQL}, shown AS (SELECT *, row_number() OVER (PARTITION BY product_id {SHOWN}) AS position FROM trusted), wish AS (
  SELECT *, CASE WHEN is_current AND coalesce(in_stock, false) AND price_status = 'known' AND condition = 'new' THEN 0 WHEN is_current AND price_status = 'known' AND condition = 'new' THEN 1
    WHEN is_current AND price_status = 'known' THEN 2 WHEN price_status = 'known' THEN 3 END AS w FROM shown), r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY w, position) AS rn FROM wish WHERE w IS NOT NULL)
SELECT product_id, variant_id, offer_id, position FROM r WHERE rn = 1""")
def displayed_offers(spark: SparkSession, sf: str) -> DataFrame:
    shown = O.offers_of(A.trusted(spark, sf), tie_break=[F.col("tie")])
    return O.displayed_offer(shown).select("product_id", "variant_id", "offer_id", "position")


@query(f"WITH {A.SQL} SELECT provider_id, provider_name FROM providers WHERE trust <> 'UNVERIFIED'")
def facet_providers(spark: SparkSession, sf: str) -> DataFrame:
    return O.facet_providers(A.providers(spark, sf))


@query("SELECT DISTINCT p_type AS category FROM part ORDER BY 1")
def facet_categories(spark: SparkSession, sf: str) -> DataFrame:
    return A.products(spark, sf).select("category").distinct().orderBy("category")


@query("SELECT DISTINCT p_brand AS brand FROM part ORDER BY 1")
def facet_brands(spark: SparkSession, sf: str) -> DataFrame:
    return A.products(spark, sf).select("brand").distinct().orderBy("brand")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return O.search_document(A.model(spark, sf))


@query(f"{DOCS} SELECT * EXCLUDE (provider_ids), coalesce(array_to_string(provider_ids, ','), '') AS provider_ids FROM docs")
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_docs(spark, sf))


FILTERED = S.Filters(categories=("ECONOMY", "PROMO", "SMALL"), providers=(1, 2, 6, 7, 8), min_price=900.0, max_price=60000.0, in_stock=True)
FILTER_SQL = "category IN ('ECONOMY', 'PROMO', 'SMALL') AND list_has_any(coalesce(provider_ids, []), [1, 2, 6, 7, 8]) AND price >= 900 AND price <= 60000 AND in_stock"


@query(f"{DOCS} SELECT id, name, price FROM docs WHERE {FILTER_SQL}")
def search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(S.matches(FILTERED)).select("id", "name", "price")


BY_IDS = {"category_ids": ["6907,8005"], "brand_ids": ["2", "17", "4"]}


@query(f"{DOCS} SELECT id, category, brand FROM docs WHERE category_id IN (6907, 8005) AND brand_id IN (2, 17, 4)")
def search_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(S.matches(S.Filters.parse(BY_IDS))).select("id", "category", "brand")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 3 < 2 ORDER BY 1 LIMIT 100")
def search_model_number(spark: SparkSession, sf: str) -> DataFrame:
    """A compact model number finds its spelled-out forms."""
    kind, none = F.col("p_size") % 3, F.lit("")
    name = F.when(kind == 0, "Card RTX 4060 Ti").when(kind == 1, "card rtx 4060ti").otherwise("Card RTX 4070 Super")
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), none.alias("category"), none.alias("brand"), none.alias("provider"))
    return S.find(docs, "RTX4060Ti", S.Filters(limit=100)).select("id")


@query(f"{DOCS} SELECT id, price, row_number() OVER (ORDER BY price ASC NULLS LAST, id) AS position FROM docs ORDER BY price ASC NULLS LAST, id LIMIT 100")
def search_price_asc(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(S.page_of(_docs(spark, sf), S.Filters(sort="price_asc", limit=100)), "price_asc")


@query(f"{DOCS} SELECT id, price, row_number() OVER (ORDER BY price DESC NULLS LAST, id) AS position FROM docs ORDER BY price DESC NULLS LAST, id LIMIT 100")
def search_price_desc(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(S.page_of(_docs(spark, sf), S.Filters(sort="price_desc", limit=100)), "price_desc")


def _numbered(page: DataFrame, sort: str) -> DataFrame:
    """A page's rows with their places; a page is a hundred rows at most."""
    from pyspark.sql import Window

    return page.select("id", "price", F.row_number().over(Window.orderBy(*S.order_of(sort, False))).alias("position"))


@query(f"{DOCS} SELECT id, name FROM docs ORDER BY id LIMIT 10 OFFSET 20")
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    return S.page_of(_docs(spark, sf), S.Filters(page=3)).select("id", "name")


@query(f"{DOCS} SELECT count(*) AS found, 1 AS page, 10 AS \"limit\", CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages FROM docs WHERE {FILTER_SQL}")
def page_meta(spark: SparkSession, sf: str) -> DataFrame:
    return S.page_meta(_docs(spark, sf).where(S.matches(FILTERED)), FILTERED)


@query(f"{DOCS} SELECT id, name FROM docs WHERE id > 500 ORDER BY id LIMIT 500")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return S.keyset_page(_docs(spark, sf).select("id", "name"), 500, 500)


WORDS = "string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g')), ' ')"


def _lexical_sql(parts: list[tuple[str, int]], weights: dict[str, int], extra: str = "") -> str:
    fields = {"name": "name", "category": "category", "brand": "brand", "provider": "provider_name"}
    hit = lambda f, p, t: f"len(list_filter(w_{f}, lambda w: starts_with(w, '{p}')" + (f" OR levenshtein(w, '{p}') <= {t}" if t else "") + ")) > 0"
    cols = ", ".join(f"{WORDS.format(fields[f])} AS w_{f}" for f in weights)
    score = ", ".join("(" + " + ".join(f"({hit(f, p, t)})::INT" for p, t in parts) + f") * {w}" for f, w in weights.items())
    test = " AND ".join("(" + " OR ".join(hit(f, p, t) for f in weights) + ")" for p, t in parts)
    return f"SELECT id, name, greatest({score}) AS score FROM (SELECT *, {cols} FROM docs) WHERE {test}{extra}"


LEXICAL = [("smal", 1), ("rinng", 1), ("economy", 2)]


@query(f"{DOCS} {_lexical_sql(LEXICAL, S.LEXICAL_WEIGHTS)}")
def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("provider", F.col("provider_name"))
    return S.lexical(docs, "smal rinng economy").select("id", "name", "score")


@query(f"{DOCS}, strict AS ({_lexical_sql([('brand', 1), ('77', 0)], S.LEXICAL_WEIGHTS)}), loose AS ({_lexical_sql([('brand', 1), ('77', 1)], S.LEXICAL_WEIGHTS)}) SELECT * FROM strict UNION ALL SELECT * FROM loose WHERE NOT EXISTS (SELECT 1 FROM strict)")
def digit_fallback(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).withColumn("provider", F.col("provider_name"))
    return S.with_digit_fallback(docs, "brand 77").select("id", "name", "score")


FOUND = {"name": 8, "category": 4, "brand": 2}
ASKED = ("thintion en", "ciónad es", "worthlss pathetic", "onbl eea", "licensetext", "src7 pathetc")


def _request_sql(request: str) -> str:
    parts = request.split()
    joined = lambda i: [a + b for a, b in zip(parts, parts[1:], strict=False)][max(i - 1, 0) : i + 1]

    def hit(f: str, i: int) -> str:
        typos = S._typos(parts[i], False)
        near = f" OR levenshtein(w, '{parts[i]}') <= {typos}" if typos else ""
        along = "".join(f" OR list_contains(w_{f}, '{j}')" for j in joined(i))
        return f"(len(list_filter(w_{f}, lambda w: starts_with(w, '{parts[i]}'){near})) > 0 OR list_contains(list_transform(range(1, len(w_{f})), lambda k: w_{f}[k] || w_{f}[k + 1]), '{parts[i]}'){along})"

    score = ", ".join("(" + " + ".join(f"{hit(f, i)}::INT" for i in range(len(parts))) + f") * {w}" for f, w in FOUND.items())
    test = " AND ".join("(" + " OR ".join(hit(f, i) for f in FOUND) + ")" for i in range(len(parts)))
    return f"SELECT '{request}' AS request, id, greatest({score}) AS score FROM w WHERE {test}"


ANY_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}]+')"


@query(f"WITH w AS (SELECT doc_id AS id, {ANY_WORDS.format('text')} AS w_name, {ANY_WORDS.format('lang')} AS w_category, {ANY_WORDS.format('source')} AS w_brand FROM documents) " + " UNION ALL ".join(_request_sql(r) for r in ASKED))
def lexical_index(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with typos, beginnings and joined words, answered from the published index of all texts."""
    from functools import reduce

    from ..operators import lexicon as N
    from ..operators.catalog import CatalogStore
    from ..scratch import Scratch

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.col("lang").alias("category"), F.col("source").alias("brand"))
    store = CatalogStore(spark, f"{Scratch(spark, 'lexicon').root}/index")
    N.publish(docs, store, list(FOUND))
    postings, pieces = store.read("postings"), store.read("pieces")
    return reduce(DataFrame.union, (N.search(postings, pieces, r, FOUND).select(F.lit(r).alias("request"), "id", "score") for r in ASKED))


SCRIPTS = ("بطاقة رسومات ٤٠٦٠", "Видеокарта {} Ноутбук", "café {} naïve", "显卡 {}")


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'بطاقة رسومات' WHEN 1 THEN 'ноутбуки' ELSE 'naive' END AS request FROM part WHERE p_size % 4 < 3")
def search_arabic(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in Arabic, Cyrillic and accented Latin find their titles, with a typo where words are long enough."""
    kind, none = F.col("p_size") % 4, F.lit("")
    title = F.element_at(F.array(*(F.concat(F.lit(t.split("{}")[0]), "p_partkey", F.lit(t.split("{}")[-1] if "{}" in t else "")) for t in SCRIPTS)), (kind + 1).cast("int"))
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), title.alias("name"), none.alias("category"), none.alias("brand"), none.alias("provider"))
    asked = ("بطاقة رسومات", "ноутбуки", "naive")
    found = [S.find_all(docs, r, S.Filters()).select("id", F.lit(r).alias("request")) for r in asked]
    return found[0].union(found[1]).union(found[2])


COSINE = "list_sum(list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qe), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], qe) DESC, vec_id LIMIT 50""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = [float(x) for x in vectors.where("vec_id = 7").first()["embedding"]]
    return S.vector_top(vectors, asked, 50).withColumn("similarity", F.round("similarity", 6))


@query(f"""{DOCS}, lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS a FROM ({_lexical_sql([('red', 0)], {'name': 6, 'brand': 2}, '')}) ORDER BY a LIMIT 100),
q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 7),
near AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], qe) DESC, vec_id) AS b FROM embeddings, q QUALIFY b <= 50),
own AS (SELECT near.* FROM near JOIN docs USING (id))
SELECT coalesce(lex.id, own.id) AS id, a AS lexical_rank, b AS vector_rank, round(coalesce(0.65 / a, 0) + coalesce(0.35 / b, 0), 6) AS score FROM lex FULL JOIN own ON lex.id = own.id""")
def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    vectors = table(spark, sf, "embeddings")
    asked = [float(x) for x in vectors.where("vec_id = 7").first()["embedding"]]
    top = S.vector_top(vectors, asked, 50)
    near = top.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")).alias("rank"))
    # Names alone: the semantic text repeats them here and would only double the score.
    docs = _docs(spark, sf).drop("semantic_text").withColumn("semantic_text", F.lit(""))
    return S.hybrid(docs, "red", near, S.Filters()).withColumn("score", F.round("score", 6))


# Staging and sync.

STAGED = "SELECT l_partkey AS product_id, l_linenumber AS depth, p_type AS category, p_name AS name, p_brand AS brand, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END AS price, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS in_stock, l_orderkey AS seq, l_suppkey AS supplier FROM lineitem JOIN part ON l_partkey = p_partkey"
RANKS = ("SMALL", "ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD")
RANK_SQL = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(RANKS))


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_name", "p_brand")
    return table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("depth"), F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("price"), F.when(flag == "A", True).when(flag == "R", False).alias("in_stock"), F.col("l_orderkey").alias("seq"), F.col("l_suppkey").alias("supplier"),
    )


def _priority(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(RANKS)], "category string, rank int")


@query(f"""WITH s AS ({STAGED}), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY depth DESC, CASE category {RANK_SQL} END, price IS NULL, in_stock IS NULL, name, coalesce(brand, ''), price, seq, supplier) AS rn FROM s)
SELECT product_id, depth, category, name, brand, price, in_stock, seq FROM r WHERE rn = 1""")
def stage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    ties = [F.col("price").asc_nulls_last(), F.col("seq"), F.col("supplier")]
    return G.dedup_by_priority(_staged(spark, sf), _priority(spark), "product_id", F.col("depth"), ties).drop("supplier")


@query("SELECT category, product_id, position FROM (SELECT p_type AS category, p_partkey AS product_id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS position FROM part) WHERE position <= 5")
def stage_sample_per_category(spark: SparkSession, sf: str) -> DataFrame:
    return G.sample_per_category(A.products(spark, sf), "product_id", 5).select("category", "product_id", "position")


@query("SELECT p_type AS category, count(*) AS products FROM part GROUP BY 1 ORDER BY 1")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.products(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("products")).orderBy("category")


@query(f"SELECT p_partkey AS product_id, p_type AS category, CASE p_type {RANK_SQL} END AS rank FROM part")
def category_priority_join(spark: SparkSession, sf: str) -> DataFrame:
    return A.products(spark, sf).join(_priority(spark), "category").select("product_id", "category", "rank")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    return G.last_write_wins(table(spark, sf, "events"), "user_id", F.col("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


SIDES = """prior AS (SELECT o_orderkey AS k, o_orderpriority AS grp, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '1-URGENT'),
staged AS (SELECT o_orderkey AS k, o_orderpriority AS grp, o_custkey AS cust, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price, o_orderstatus AS status FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice > 100000))"""
ACTIONS = f"""{SIDES}, actions AS (SELECT coalesce(p.k, s.k) AS k, coalesce(p.grp, s.grp) AS grp, p.price AS old_price, s.price AS new_price,
  CASE WHEN p.k IS NULL THEN 'insert' WHEN s.k IS NULL THEN 'delete' WHEN p.price IS NOT DISTINCT FROM s.price AND p.status IS NOT DISTINCT FROM s.status AND p.cust IS NOT DISTINCT FROM s.cust THEN 'keep' ELSE 'update' END AS action
  FROM prior p FULL JOIN staged s ON p.k = s.k AND p.grp = s.grp)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    staged = orders.where(~((F.col("grp") == "5-LOW") & (F.col("price") > 100000))).withColumn("price", F.when(F.col("status") != "F", F.col("price")))
    return orders.where("grp <> '1-URGENT'"), staged


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    return Y.changes(*_sides(spark, sf), ["k", "grp"], ["cust", "price", "status"])


@query(f"WITH {ACTIONS} SELECT k, grp, action, old_price, new_price FROM actions")
def sync_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _actions(spark, sf).select("k", "grp", "action", F.col("old.price").alias("old_price"), F.col("new.price").alias("new_price"))


@query(f"WITH {ACTIONS} SELECT count(*) FILTER (action <> 'delete') AS staged, count(*) FILTER (action IN ('insert', 'update')) AS upserted, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action <> 'insert') AS previous FROM actions")
def sync_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Y.sync_counts(_actions(spark, sf))


@query(f"WITH {SIDES} SELECT k, grp FROM prior WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.k = prior.k)")
def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    prior, staged = _sides(spark, sf)
    return Y.stale_rows(prior, staged, ["k"]).select("k", "grp")


@query(f"""WITH {ACTIONS}, c AS (SELECT grp, count(*) FILTER (action <> 'insert') AS existing, count(*) FILTER (action = 'delete') AS to_delete, count(*) FILTER (action <> 'delete') AS staged FROM actions GROUP BY 1)
SELECT *, staged = 0 OR (existing > 0 AND to_delete / existing > 0.35) AS refused FROM c""")
def deletion_guard(spark: SparkSession, sf: str) -> DataFrame:
    return Y.deletion_guard(_actions(spark, sf), ["grp"])


COVERED = "SELECT provider_id, price_status, last_seen_at < TIMESTAMP '1998-01-01' AS old FROM offers"


@query(f"""WITH {A.SQL}, c AS ({COVERED}), a AS (SELECT provider_id, count(*) AS prior_total, avg((price_status = 'known')::INT) AS prior_share FROM c WHERE old GROUP BY 1),
b AS (SELECT provider_id, count(*) AS staged_total, avg((price_status = 'known')::INT) AS staged_share FROM c WHERE NOT old GROUP BY 1)
SELECT provider_id, prior_total, round(prior_share, 9) AS prior_share, staged_total, round(staged_share, 9) AS staged_share,
  prior_total >= 100 AND staged_total >= 100 AND prior_share > 0.5 AND prior_share - staged_share > 0.2 AND staged_share < prior_share * 0.7 AS refused FROM a JOIN b USING (provider_id)""")
def price_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.offers(spark, sf)
    old = F.col("last_seen_at") < F.lit("1998-01-01").cast("timestamp")
    guard = Y.coverage_guard(rows.where(old), rows.where(~old), ["provider_id"])
    return guard.withColumns({c: F.round(c, 9) for c in ("prior_share", "staged_share")})


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def orphan_variants(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return Y.orphans(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("""WITH staged AS (SELECT o_orderkey AS offer_id, o_custkey % 5 AS provider_id, o_custkey % 3 AS seller_id FROM orders)
SELECT offer_id, provider_id, seller_id, CASE WHEN provider_id = 4 THEN 'provider not approved' ELSE 'seller not approved' END AS reason
FROM staged WHERE provider_id = 4 OR (provider_id = 3 AND seller_id = 2)""")
def trust_gate(spark: SparkSession, sf: str) -> DataFrame:
    staged = table(spark, sf, "orders").select(F.col("o_orderkey").alias("offer_id"), (F.col("o_custkey") % 5).alias("provider_id"), (F.col("o_custkey") % 3).alias("seller_id"))
    return Y.untrusted_rows(staged, A.providers(spark, sf)).select("offer_id", "provider_id", "seller_id", "reason")


@query("SELECT user_id AS provider_id, event_id AS run_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('error', 'purchase')) WHERE rn = 1")
def latest_crawl_status(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").alias("provider_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status")
    )
    return Y.latest_runs(runs).drop("finished_at")


PAIRS = """pairs AS (
  SELECT a.p_partkey AS listing_id, b.p_partkey AS variant_id FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand
  UNION SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON a.p_retailprice = b.p_retailprice)"""


def _identifiers(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias(key), F.col("p_retailprice").alias("gtin"), F.col("p_name").alias("mpn"), F.col("p_brand").alias("brand"))


@query(f"WITH {PAIRS} SELECT listing_id, variant_id FROM pairs")
def identifier_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return Y.identifier_candidates(_identifiers(spark, sf, "listing_id"), _identifiers(spark, sf, "variant_id"))


# Listings of four shops over the parts: identifiers in any case, blank ones and missing ones, models in the titles.
LISTINGS = """l AS (
  SELECT p_partkey AS rank, 's' || p_partkey AS source_key, CASE WHEN p_size % 5 = 0 THEN 'k' || p_partkey % 97 ELSE 'u' || p_partkey END AS identity_key, 'p' || p_partkey % 50 AS parent_key,
    CASE p_partkey % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'mobile_phones' ELSE 'gpu' END AS category, CASE WHEN p_size % 11 > 0 THEN CASE p_size % 2 WHEN 0 THEN 'Acme' ELSE 'ACME' END END AS brand,
    CASE p_partkey % 3 WHEN 0 THEN 'Ryzen 7 700' || p_partkey % 7 || 'X' WHEN 1 THEN 'iPhone 1' || p_partkey % 7 || ' 256GB' ELSE 'RTX 40' || p_partkey % 7 || '0' END AS title,
    CASE p_size % 4 WHEN 0 THEN '' WHEN 2 THEN 'M' || p_partkey % 23 WHEN 3 THEN 'm' || p_partkey % 23 END AS mpn, CASE p_size % 6 WHEN 0 THEN 'G' || p_partkey % 31 WHEN 1 THEN '' END AS gtin,
    p_partkey % 3 AS kind, p_partkey % 7 AS code FROM part)"""


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size")
    mod = lambda m: (n % m).cast("string")
    kind = lambda *a: F.when(n % 3 == 0, a[0]).when(n % 3 == 1, a[1]).otherwise(a[2])
    empty = F.lit(None).cast("map<string,string>")
    return table(spark, sf, "part").select(
        n.alias("rank"), F.concat(F.lit("s"), n).alias("source_key"), F.when(size % 5 == 0, F.concat(F.lit("k"), mod(97))).otherwise(F.concat(F.lit("u"), n)).alias("identity_key"), F.concat(F.lit("p"), mod(50)).alias("parent_key"),
        kind(F.lit("cpu"), F.lit("mobile_phones"), F.lit("gpu")).alias("category"), F.when(size % 11 > 0, F.when(size % 2 == 0, "Acme").otherwise("ACME")).alias("brand"),
        kind(F.concat(F.lit("Ryzen 7 700"), mod(7), F.lit("X")), F.concat(F.lit("iPhone 1"), mod(7), F.lit(" 256GB")), F.concat(F.lit("RTX 40"), mod(7), F.lit("0"))).alias("title"),
        F.when(size % 4 == 0, "").when(size % 4 == 2, F.concat(F.lit("M"), mod(23))).when(size % 4 == 3, F.concat(F.lit("m"), mod(23))).alias("mpn"), F.when(size % 6 == 0, F.concat(F.lit("G"), mod(31))).when(size % 6 == 1, "").alias("gtin"),
        F.lit(None).cast("string").alias("model_number"), empty.alias("options"), empty.alias("specifications"),
    )


def _clash(a: str, b: str, brand: str = "brand") -> str:
    return f"({a}.kind <> {b}.kind OR coalesce(lower({a}.{brand}) <> lower({b}.brand), false) OR coalesce(lower(nullif({a}.mpn, '')) <> lower(nullif({b}.mpn, '')), false) OR coalesce(nullif({a}.gtin, '') <> nullif({b}.gtin, ''), false) OR {a}.code <> {b}.code)"


def _meets(a: str, b: str, brand: str = "brand") -> str:
    return f"coalesce(nullif({a}.gtin, '') = {b}.gtin OR (lower(nullif({a}.mpn, '')) = lower({b}.mpn) AND lower({a}.{brand}) = lower({b}.brand)), false)"


@query(f"""WITH {LISTINGS} SELECT a.rank AS listing_id, min(b.rank) AS variant_id FROM l a JOIN l b ON b.rank % 7 < 2 AND {_meets('b', 'a')} AND NOT {_clash('b', 'a')} GROUP BY 1 HAVING count(*) = 1""")
def single_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Listings whose identifiers leave one stored variant that nothing speaks against."""
    from ..operators.resolve import with_evidence
    from ..scratch import Scratch

    told = with_evidence(_batch(spark, sf).withColumn("aliases", F.lit(None).cast("array<string>"))).select(F.col("rank").alias("listing_id"), "gtin", "mpn", "brand", "e")
    listings = Scratch(spark, "single").put("listings", told)
    variants = listings.withColumnRenamed("listing_id", "variant_id").where("variant_id % 7 < 2")
    return Y.single_compatible(listings, variants)


FIRST_NEW = 1_000_000_000


FOLD = f"""WITH RECURSIVE {LISTINGS}, n AS (SELECT *, CASE WHEN kind = 2 THEN source_key ELSE concat_ws('|', parent_key, kind, coalesce(lower(brand), ''), code) END AS gk FROM l),
fold(rank, leads, variant, product, k, kind, pb, mpn, gtin, code, gk) USING KEY (rank) AS (
  SELECT CAST(-1 AS BIGINT), false, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), '', CAST(-1 AS BIGINT), '', '', '', CAST(-1 AS BIGINT), ''
  UNION
  SELECT rank, leads, CASE WHEN leads THEN rank ELSE chosen END, CASE WHEN NOT leads THEN has.product WHEN lent IS NOT NULL THEN lent.product ELSE rank END,
    CASE WHEN leads AND has IS NOT NULL THEN identity_key || ':split:' || ({FIRST_NEW} + chosen) ELSE identity_key END, kind, CASE WHEN NOT leads THEN has.pb WHEN lent IS NOT NULL THEN lent.pb ELSE brand END, mpn, gtin, code, gk
  FROM (
    SELECT *, has IS NULL OR has.clash AS leads FROM (
      SELECT s.*, coalesce(min(f.rank) FILTER (f.leads AND f.k = s.identity_key), CASE WHEN count(*) FILTER (f.leads AND {_meets('f', 's', 'pb')} AND NOT {_clash('f', 's', 'pb')}) = 1 THEN min(f.rank) FILTER (f.leads AND {_meets('f', 's', 'pb')} AND NOT {_clash('f', 's', 'pb')}) END) AS chosen,
        coalesce(arg_min({{'product': f.product, 'pb': f.pb, 'clash': {_clash('f', 's', 'pb')}}}, f.rank) FILTER (f.leads AND f.k = s.identity_key),
          CASE WHEN count(*) FILTER (f.leads AND {_meets('f', 's', 'pb')} AND NOT {_clash('f', 's', 'pb')}) = 1 THEN arg_min({{'product': f.product, 'pb': f.pb, 'clash': false}}, f.rank) FILTER (f.leads AND {_meets('f', 's', 'pb')} AND NOT {_clash('f', 's', 'pb')}) END) AS has,
        arg_min({{'product': f.product, 'pb': f.pb}}, f.rank) FILTER (f.gk = s.gk) AS lent
      FROM (SELECT n.* FROM n JOIN fold w ON n.rank = w.rank + 1) s, recurring.fold f GROUP BY ALL)))
SELECT rank, leads, variant + {FIRST_NEW} AS variant_id, product + {FIRST_NEW} AS product_id, k AS identity_key FROM fold WHERE rank >= 0"""


@query(FOLD)
def batch_identities(spark: SparkSession, sf: str) -> DataFrame:
    """A first batch: all its variants and products are its own."""
    from ..operators.identities import assign_batch
    from ..scratch import Scratch

    staged = _batch(spark, sf)
    stored = staged.limit(0).select(F.col("rank").alias("variant_id"), F.col("rank").alias("product_id"), "identity_key", "category", "brand", "title", "mpn", "gtin", "model_number", "options", "specifications")
    found = assign_batch(staged, stored, stored.select("identity_key", "variant_id"), stored.select(F.col("identity_key").alias("source_key"), "variant_id"), stored.select("variant_id"), FIRST_NEW, Scratch(spark, "batch"))
    return found.select("rank", F.col("action").isin("create", "split").alias("leads"), "variant_id", "product_id", "identity_key")


@query(f"""SELECT product_id - {FIRST_NEW} + 1 AS product_id, min(p_type) AS kind, count(DISTINCT variant_id) AS variants, count(*) AS offers, count(*) FILTER (known) AS known
FROM (SELECT f.*, 'cat' || rank % 3 AS p_type, rank % 4 > 0 AS known FROM ({FOLD}) f) GROUP BY 1""")
def catalog_sync(spark: SparkSession, sf: str) -> DataFrame:
    """The products of a catalog after one provider's first sync, counted from the version it published."""
    from ..operators import catalog as C
    from ..scratch import Scratch

    scratch = Scratch(spark, "sync")
    store, none = C.CatalogStore(spark, f"{scratch.root}/catalog"), F.lit(None).cast("string")
    store.commit(C.empty_catalog(spark) | {"providers": spark.createDataFrame([(1, DIRECT, [])], C.PROVIDERS)})
    known = F.col("rank") % 4 > 0
    staged = _batch(spark, sf).select(
        "*", F.concat(F.lit("https://shop.example/"), "rank").alias("url"), none.alias("seller_id"), F.when(known, F.col("rank") + 1).cast("decimal(12,2)").alias("price"), F.when(known, "known").otherwise("placeholder").alias("price_status"),
        F.lit(True).alias("in_stock"), F.lit("new").alias("condition"), F.lit("EGP").alias("currency"), none.alias("image_url"),
    )
    C.synchronize(store, 1, staged, F.lit("2024-01-01 00:00:00").cast("timestamp"), scratch)
    offers = store.read("offers").join(store.read("variants").select("variant_id", "product_id").hint("merge"), "variant_id").join(store.read("products").hint("merge"), "product_id")
    kind = F.concat(F.lit("cat"), F.when(F.col("category") == "cpu", "0").when(F.col("category") == "mobile_phones", "1").otherwise("2"))
    return offers.groupBy("product_id").agg(F.min(kind).alias("kind"), F.count_distinct("variant_id").alias("variants"), F.count(F.lit(1)).alias("offers"), F.count_if(F.col("price_status") == "known").alias("known"))


@query("""SELECT p_partkey AS offer_id, 'legacy:' || p_partkey % 5 || ':https://s/' || p_partkey AS identity_key, p_name AS title, CASE WHEN p_size > 9 THEN CAST(p_retailprice AS DECIMAL(12,2))::DOUBLE END AS price,
CASE WHEN p_size > 9 THEN 'known' ELSE 'not_found' END AS price_status, p_type AS category FROM part""")
def backfilled_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Flat products as a catalog: each one's offer with its variant and product."""
    from ..operators.catalog import backfill

    n, time = F.col("p_partkey"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    flat = table(spark, sf, "part").select(
        n.alias("product_id"), (n % 5).alias("provider_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 9, F.col("p_retailprice")).otherwise(0.0).alias("price"),
        F.lit("EGP").alias("currency"), F.lit(True).alias("in_stock"), F.concat(F.lit("https://s/"), n).alias("url"), F.lit(None).cast("string").alias("image_url"), time.alias("created_at"), time.alias("updated_at"),
    )
    made = backfill(flat)
    joined = made["offers"].join(made["variants"], "variant_id").join(made["products"], "product_id")
    return joined.select("offer_id", "identity_key", "title", F.col("price").cast("double").alias("price"), "price_status", "category")


@query("SELECT DISTINCT p_brand AS brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)")
def new_brands(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_size")
    return Y.new_brands(parts.select("brand"), parts.where("p_size = 7").select("brand").distinct())


@query("""WITH r AS (SELECT *, event_type = 'view' AS running, max(event_id) OVER (PARTITION BY user_id) AS newest FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN running THEN NULL ELSE ts END DESC NULLS LAST, event_id DESC) AS rn FROM r WHERE NOT running OR event_id < newest)
SELECT user_id AS provider_id, event_id AS run_id, CASE WHEN running OR event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status FROM e WHERE rn = 1""")
def abandoned_crawls(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    runs = table(spark, sf, "events").select(
        F.col("user_id").alias("provider_id"), F.col("event_id").alias("run_id"), F.when(kind != "view", F.col("ts")).alias("finished_at"), F.when(kind == "error", "failed").when(kind == "view", "running").otherwise("succeeded").alias("status"),
    )
    return Y.latest_runs(runs).drop("finished_at")


@query("""SELECT c_name AS identity_key, coalesce(s.s_suppkey, n.k) AS variant_id FROM customer
LEFT JOIN supplier s ON replace(c_name, 'Customer', 'Supplier') = s_name LEFT JOIN (SELECT c_nationkey AS nk, max(c_custkey) AS k FROM customer GROUP BY 1) n ON n.nk = c_nationkey AND n.k = c_custkey""")
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    variants = table(spark, sf, "supplier").select(F.regexp_replace("s_name", "Supplier", "Customer").alias("identity_key"), F.col("s_suppkey").alias("variant_id"))
    aliases = customers.groupBy("c_nationkey").agg(F.max_by("c_name", "c_custkey").alias("identity_key"), F.max("c_custkey").alias("variant_id")).drop("c_nationkey")
    return Y.resolve_identity_keys(customers.select(F.col("c_name").alias("identity_key")), variants, aliases)


@query("""WITH s AS (SELECT p_partkey AS source_key, p_brand, p_type, p_name, CASE WHEN p_size > 25 THEN p_partkey + 100000 END AS product_id FROM part),
d AS (SELECT p_brand, p_type, p_name, arg_min(product_id, source_key) FILTER (product_id IS NOT NULL) AS donor, min(source_key) AS family_lead FROM s GROUP BY ALL)
SELECT source_key, coalesce(product_id, donor) AS family_product_id, family_lead FROM s JOIN d USING (p_brand, p_type, p_name)""")
def family_grouping(spark: SparkSession, sf: str) -> DataFrame:
    staged = table(spark, sf, "part").select(F.col("p_partkey").alias("source_key"), "p_brand", "p_type", "p_name", F.when(F.col("p_size") > 25, F.col("p_partkey") + 100000).alias("product_id"))
    return Y.group_families(staged, ["p_brand", "p_type", "p_name"], F.col("source_key")).select("source_key", "family_product_id", "family_lead")


@query(f"""{DOCS} SELECT id, CASE WHEN price_status = 'stale' THEN 'Last seen at ' || provider_name WHEN len(coalesce(provider_ids, [])) > 1 THEN len(provider_ids) || ' verified retailers' ELSE provider_name END AS store,
  CASE WHEN price_status = 'stale' THEN 'Price unverified' WHEN in_stock THEN 'In stock' WHEN NOT in_stock THEN 'Out of stock' ELSE 'Stock unknown' END AS stock,
  CASE WHEN price_status = 'stale' THEN 'Last seen price · not verified now' WHEN price_status <> 'known' THEN 'Price unavailable' WHEN variant_count > 1 THEN 'From · lowest available configuration' WHEN condition <> 'new' THEN condition || ' listed price'
    WHEN in_stock THEN 'Lowest in-stock price' WHEN NOT in_stock THEN 'Listed price · out of stock' ELSE 'Listed price · stock unconfirmed' END AS price_note,
  coalesce(printf('%.2f EGP', CASE WHEN price_status = 'stale' THEN last_seen_price ELSE price END), 'Price not found') AS shown FROM docs""")
def card_labels(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import labels as B

    docs = _docs(spark, sf)
    price = F.when(F.col("price_status") == "stale", F.col("last_seen_price")).otherwise(F.col("price"))
    return docs.select("id", B.card_store().alias("store"), B.card_stock().alias("stock"), B.card_price_note().alias("price_note"), B.shown_price(price, F.lit("EGP")).alias("shown"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Red · 64GB' WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE 'Variant ' || p_partkey END AS label FROM part""")
def variant_labels(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import labels as B

    kind = F.col("p_size") % 4
    options = F.when(kind == 0, F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("Red"), F.lit(""), F.lit("64GB"))))
    title = F.when(kind == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" - | "), "p_type"))
    label = B.variant_label(options, title, F.col("p_name"), F.when(kind == 2, F.col("p_brand")), F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", label.alias("label"))


@query("SELECT CAST(key AS BIGINT) AS id, action FROM (SELECT coalesce(o_custkey, c_custkey) AS key, CASE WHEN o_custkey IS NULL THEN 'add' WHEN c_custkey IS NULL THEN 'prune' ELSE 'write' END AS action FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey)")
def index_changes(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import index as X

    indexed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    docs = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return X.index_changes(indexed, docs)
