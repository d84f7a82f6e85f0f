"""The inverted index, the index that takes changes, reindexing, filters as typed, costs and trees."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stallkeeper.functions.text import request_words
from stallkeeper.operators import index, lexicon, offers, resolve, search
from stallkeeper.operators.catalog import CatalogStore
from stallkeeper.scratch import Scratch
from stallkeeper.sources import pages

WEIGHTS = {"name": 8, "brand": 2}


def edited(draw, word):
    i = draw.randrange(len(word) + 1)
    return draw.choice([word[:i] + draw.choice("abx") + word[i:], word[:i] + word[i + 1 :], word[: max(i - 1, 0)] + draw.choice("abx") + word[i:]])


def test_words_within_typos_share_a_piece():
    """Over all edits of random words: what Spark's pieces are is repeated here in Python."""
    draw = random.Random(3)
    own = lambda w: {"short"} if len(w) < 3 else {f"{len(w)}:{i}:{w[len(w) * i // 3 : len(w) * (i + 1) // 3]}" for i in range(3)}
    for _ in range(3000):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 12)))
        for typos in (1, 2):
            other = word
            for _ in range(typos):
                other = edited(draw, other)
            assert own(other) & set(lexicon.pieces_near(word, typos)), (word, other, typos)


def test_pieces_in_spark(spark):
    got = {r["w"]: set(r["p"]) for r in spark.createDataFrame([("ab",), ("abc",), ("ciónado",), ("",)], "w string").select("w", lexicon.pieces_of(F.col("w")).alias("p")).collect()}
    assert got == {"ab": {"short"}, "": {"short"}, "abc": {"3:0:a", "3:1:b", "3:2:c"}, "ciónado": {"7:0:ci", "7:1:ón", "7:2:ado"}}


def test_index_answers_like_the_scan(spark, monkeypatch):
    draw = random.Random(7)
    words = ["graphic", "graphics", "card", "cards", "rtx", "4060", "4070", "ti", "boards", "بطاقة", "رسومات", "naïve", "super", "board"]
    title = lambda: " ".join(draw.choice(words) + draw.choice(["", "", "-", ","]) for _ in range(draw.randint(0, 6)))
    docs = spark.createDataFrame([(i, title() if i % 9 else None, draw.choice([*words, ""])) for i in range(150)] + [(200, "graph ics card", "b"), (200, "graph ics card", "b")], "id long, name string, brand string")
    store = CatalogStore(spark, Scratch(spark, "t").root)
    lexicon.publish(docs, store, ["name", "brand"])
    postings, pieces = store.read("postings"), store.read("pieces")
    monkeypatch.setattr(lexicon, "BLOCK", 2)  # so that three words take two numbers
    for query in ("graphcs card", "rtx 4061", "boa rds", "بطاقه", "rtx4060", "naive s c"):
        for loose in (False, True):
            want = {(r["id"], r["score"]) for r in search.lexical(docs, query.strip(), WEIGHTS, loose).select("id", "score").collect()}
            got = [(r["id"], r["score"]) for r in lexicon.search(postings, pieces, query, WEIGHTS, loose).collect()]
            assert set(got) == want and len(got) == len(set(got)), query
    spark.conf.set("spark.sql.maxMetadataStringLength", 3000)
    plan = lexicon.search(postings, pieces, "graphcs card", WEIGHTS)._jdf.queryExecution().toString()
    assert "StringStartsWith(word,graphcs)" in plan and "In(piece" in plan.replace("(piece IN", "In(piece")
    assert {r["id"] for r in lexicon.with_digit_fallback(postings, pieces, "4061", WEIGHTS).collect()} == {r["id"] for r in search.with_digit_fallback(docs.withColumns({"category": F.lit(""), "provider": F.lit("")}), "4061").collect()}


def test_request_words_in_any_script():
    assert request_words(" بطاقة رسومات! ") == "بطاقة رسومات" and request_words("Ноутбук_Pro") == "ноутбук pro" and request_words("café") == "café"
    assert request_words("RTX4060Ti") == "rtx 4060 ti" and request_words("显卡 ４０６０") == "显卡 4060" and request_words("?!") == ""


def test_requests_as_typed(spark):
    parse = search.Filters.parse
    assert parse({"page": ["0"], "limit": ["0"]}) == parse({}) == parse({"page": [""]}) and parse({"page_size": ["7"], "limit": ["9"]}).limit == 7
    assert parse({"min_price": ["1e3"], "max_price": ["0x1p11"]}).max_price == 2048 and parse({"min_price": [".5"]}).min_price == 0.5 and parse({"max_price": ["-0"]}).max_price == 0
    assert parse({"in_stock": ["T"]}).in_stock is True and parse({"in_stock": ["0"]}).in_stock is False
    for bad in ({"page": ["abc"]}, {"limit": ["x"]}, {"page": ["-1"]}, {"limit": ["101"]}, {"page": ["99999999999"]}, {"page": ["2147483647"]}, {"min_price": ["nan"]}, {"min_price": ["1e999"]}, {"min_price": ["-1"]}, {"max_price": [" 1"]}, {"max_price": ["1_0"]}, {"in_stock": ["yes"]}, {"category_ids": ["²"]}, {"brand_ids": ["9" * 30]}, {"provider_ids": ["1,x"]}):
        with pytest.raises(search.InvalidFilter):
            parse(bad)


def test_recommendations_have_pages(spark):
    rows = [(i, f"quiet cooler {i}", "cooling", "b", "p", float(i), f"quiet cooler {i}") for i in range(8)] + [(9, "loud fan", "cooling", "b", "p", 1.0, "loud fan")]
    docs = spark.createDataFrame(rows, "id long, name string, category string, brand string, provider string, price double, semantic_text string")
    f = search.Filters(limit=3, page=2, sort="price_desc")
    found = search.recommend_all(docs, "quiet cooler", f)
    assert search.page_meta(found, f).first()["found"] == 9 and [r["id"] for r in search.recommend(docs, "quiet cooler", f).collect()] == [4, 3, 2]
    assert search.find(docs, "؟!", search.Filters()).count() == 0 == search.recommend(docs, "…", search.Filters()).count()
    for empty in ("", "  "):
        with pytest.raises(search.InvalidFilter):
            search.recommend(docs, empty, search.Filters())


#: The acceptance cases: query, category, term that the best hit must name, whether by meaning too, price and stock.
CASES = (
    ("RX 9070", "gpu", "9070", False, None, None), ("GPU for 1440p gaming", "gpu", "", True, 35000.0, True), ("2TB NVMe gaming SSD", "ssd", "2TB", True, None, None),
    ("quiet AM5 CPU cooler", "cooling", "", True, None, None), ("750 watt gaming PSU", "power_supply", "750", True, None, None), ("CPU for Docker and programming", "cpu", "", True, None, None),
)


def test_acceptance_cases(spark):
    names = {"gpu": ["Sapphire RX 9070 XT", "MSI RTX 4060 gaming 1440p"], "ssd": ["Kingston 2TB NVMe SSD", "Addlink 1TB SATA SSD"], "cooling": ["Quiet AM5 CPU cooler", "AIO 360mm"], "power_supply": ["750W watt gaming PSU", "Corsair 550 PSU"], "cpu": ["Ryzen 9 CPU for programming", "Core i5 CPU"]}
    rows = [(10 * c + i, n, k, "b", "p", 900.0 + 40_000 * (i % 2), i % 2 == 0, c + 1) for c, (k, ns) in enumerate(names.items()) for i, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "id long, name string, category string, brand string, provider string, price double, in_stock boolean, category_id long").withColumn("semantic_text", offers.semantic_text())
    runs, wanted = {}, []
    for query, category, term, by_meaning, price, stock in CASES:
        f = search.Filters(categories=(category,), max_price=price, in_stock=stock)
        runs[query] = (search.recommend if by_meaning else search.find)(docs, query, f)
        best = runs[query].first()
        assert best is not None and best["category"] == category and term.lower() in best["name"].lower(), query
        wanted.append((query, [best["id"]]))
    assert {r["passed"] for r in search.acceptance(docs, spark.createDataFrame(wanted, "query string, wanted array<long>"), runs).collect()} == {True}


def test_documents_for_readers(spark):
    row = spark.sql("select 1L id, ' A ' name, 'gpu' category, ' ' brand, 5L category_id, 6L brand_id, 2L provider_id, 'p' provider_name, array(2L) provider_ids, 1L variant_count, 1L offer_count, 9.5D price, null last_seen_price, 'known' price_status, 'EGP' currency, 7L product_variant_id, true in_stock, 'new' condition, 60L last_seen_at, 'u' canonical_product_url, null image_url, 61L created_at, 62L updated_at")
    assert row.select(offers.semantic_text()).first()[0] == "A\nCategory: gpu"
    got = offers.api_product(row).first().asDict(True)
    assert got["category"] == {"id": 5, "slug": "gpu"} and got["brand"] == {"id": 6, "name": " "} and (got["currency"], got["product_variant_id"], got["canonical_product_url"]) == ("EGP", 7, "u") and got["updated_at"].second == 2


def test_deltas_write_what_changed(spark):
    store = CatalogStore(spark, Scratch(spark, "t").root)
    live = index.DeltaIndex(store, every=3)
    docs = lambda rows: spark.createDataFrame(rows, "id long, name string, tags array<string>")
    first = [(i, f"n{i}", ["a", None]) for i in range(300)]
    assert live.refresh(docs(first)) == {"added": 300, "changed": 0, "pruned": 0}
    second = [*first[3:], (3, "other", None), (1000, None, [])]
    second.remove((3, "n3", ["a", None]))
    assert live.refresh(docs(second)) == {"added": 1, "changed": 1, "pruned": 3}
    assert store.read("delta-000001").count() == 5  # of 300
    same = lambda rows: sorted(map(tuple, live.read().collect()), key=repr) == sorted(((i, n, t) for i, n, t in rows), key=repr)
    assert same(second)
    assert live.refresh(docs(first)) == {"added": 3, "changed": 1, "pruned": 1} and same(first)
    assert live.refresh(docs(second))["pruned"] == 3 and same(second)
    assert live._tables() == ["base"] and live.refresh(docs(second)) == {"added": 0, "changed": 0, "pruned": 0}


def test_a_crash_before_the_manifest_prunes_nothing(spark, monkeypatch):
    store = CatalogStore(spark, Scratch(spark, "t").root)
    live = index.DeltaIndex(store)
    live.refresh(spark.range(5))
    monkeypatch.setattr(spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        live.refresh(spark.range(2))
    monkeypatch.undo()
    assert live.read().count() == 5 and live.refresh(spark.range(2)) == {"added": 0, "changed": 0, "pruned": 3} and live.read().count() == 2


def test_reindexing(spark):
    embedded = index.Field("embedding", "array<float>", optional=True, embedded_from=("semantic_text",), model="m")
    wanted = [index.Field("category", "string"), index.Field("provider", "string"), index.Field("semantic_text", "string", optional=True), embedded, index.Field("offer_count", "bigint", optional=True)]
    old = [index.Field("category", "string", indexed=False), index.Field("provider", "string", indexed=False)]
    plan = index.reindex_plan(old, wanted)
    assert [(what, f.name) for what, f in plan] == [("drop", "category"), ("add", "category"), ("drop", "provider"), ("add", "provider"), ("add", "semantic_text"), ("add", "embedding"), ("add", "offer_count")]
    root = Scratch(spark, "t").root
    index.with_fields(spark.createDataFrame([("gpu", "p")], "category string, provider string"), old).write.parquet(f"{root}/a")
    rows = spark.read.parquet(f"{root}/a")
    assert [f.indexed for f in index.fields_of(rows.schema)] == [False, False] and index.reindex_plan(index.fields_of(rows.schema), wanted) == plan
    index.reindexed(rows, plan).write.parquet(f"{root}/b")
    again = spark.read.parquet(f"{root}/b")
    assert index.reindex_plan(index.fields_of(again.schema), wanted) == [] and again.first()[:2] == ("gpu", "p")
    for bad in ([old[0]], [index.Field("category", "bigint"), old[1]], [*old, index.Field("embedding", "array<float>", embedded_from=("name",), model="m")], [*old, index.Field("embedding", "array<float>", embedded_from=("semantic_text",), model="other")]):
        with pytest.raises(index.IncompatibleSchema):
            index.reindex_plan(bad, wanted)


def test_costs_fill_the_budget_in_order(spark):
    draw = random.Random(2)
    rows = [(f"{i:03}", draw.randint(0, 5), None if i == 7 else Decimal(draw.randint(0, 30)) / 100) for i in range(200)]
    pairs = spark.createDataFrame(rows, "pair_key string, score int, cost decimal(12,4)").repartition(5)
    want, spent = [], Decimal(0)
    for key, _, cost in sorted(rows, key=lambda r: (-r[1], r[0])):
        spent += cost or 0
        if spent > 11:
            break
        want.append((key, spent))
    got = resolve.fill_by_cost(pairs, F.lit(Decimal(11)), Scratch(spark, "t")).collect()
    assert sorted((r["pair_key"], r["spent"]) for r in got) == sorted(want) and 20 < len(want) < 200
    assert resolve.fill_by_cost(pairs.limit(0), F.lit(Decimal(11)), Scratch(spark, "t")).count() == 0


def test_cost_is_known_only_if_all_answered(spark):
    answers = lambda *a: spark.createDataFrame([(x, 100, 10) for x in a], "answer string, input_tokens long, output_tokens long")
    rates = ("0.0000001", "0.0000005")
    full = resolve.answer_cost(answers("answered", "answered"), *rates).first()
    assert full["actual_usd"] == full["cost_usd"] == Decimal("0.0000150") and full["input_tokens"] == 200
    assert resolve.answer_cost(answers("answered", "unanswered"), *rates).first()[1:] == (10, Decimal("0.0000075"), None)
    assert resolve.answer_cost(answers(), *rates).first()["actual_usd"] is None


def test_trees_end(spark):
    nodes = [(0, None, "root")] + [(i, i - 1, f"n{i}") for i in range(1, 51)] + [(60, 50, None), (61, 60, "c"), (60, 61, "again"), (70, 71, "x"), (71, 70, "y"), (61, 5, "twice")]
    got = [(r["id"], len(r["path"])) for r in pages.category_tree(spark.createDataFrame(nodes, "id long, parent long, name string")).collect()]
    # Two ways lead to 61 and from each of them on to 60; what only a cycle leads to is not seen.
    assert sorted(got) == sorted([(i, i + 1) for i in range(51)] + [(60, 52), (61, 53), (61, 7), (60, 8)])
    assert pages.category_tree(spark.createDataFrame([], "id long, parent long, name string")).count() == 0


def test_trees_of_many_rows(spark):
    """More rows than a recursive query may make, paths of many lengths, a cycle, and trees that are too deep for their bound."""
    make = lambda rows: spark.createDataFrame(rows, "id long, parent long, name string")
    rows = [(i, i - 1 - i % 3 if i % 40 else None, f"n{i}") for i in range(3, 900)] + [(1000, 1001, "x"), (1001, 1000, "y"), (1002, 1001, "z"), (None, None, "r"), (None, 40, "s")]
    parents, want = {i: (p, n) for i, p, n in rows if i is not None and i < 1000}, {}
    for i in sorted(parents):
        p, n = parents[i]
        if p is None or p in want:
            want[i] = ([] if p is None else want[p]) + [n]
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        got = [(r["id"], r["path"]) for r in pages.category_tree(make(rows)).collect()]
    finally:
        spark.conf.set(limit, before)
    assert len(got) == len(want) + 1 and dict(got) == want | {None: ["r"]}
    deepest = max(map(len, want.values()))
    assert pages.category_tree(make(rows), deepest).count() == len(got)
    for depth in (deepest - 1, 8, 5):
        with pytest.raises(ValueError, match="levels"):
            pages.category_tree(make(rows), depth)
    assert pages.category_tree(make([(1000, 1001, "x"), (1001, 1000, "y")]), 5).count() == 0


def test_candidate_pairs_are_made_in_several_tasks(spark):
    from stallkeeper.plans.matching import _listings

    pairs = resolve.candidate_pairs(_listings(spark, "/root/testdata/sf0.001"), categories=None)
    assert pairs.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_postings_move_once(spark, tmp_path):
    """Repeated words, neighbours and ids give one posting each, and a version's postings come from one exchange."""
    written = {}

    class Seen(CatalogStore):
        def commit(self, tables, *rest):
            written.update({n: t._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for n, t in tables.items()})
            return super().commit(tables, *rest)

    docs = spark.createDataFrame([(1, "a b a b c"), (1, "b a"), (2, "a b"), (3, None)], "id long, name string")
    store = Seen(spark, f"{tmp_path}/index")
    lexicon.publish(docs, store, ["name"])
    built = lexicon.build(docs, ["name"])
    for name in ("postings", "pieces"):
        got = sorted(map(tuple, store.read(name).collect()))
        assert got == sorted(map(tuple, built[name].collect())) and len(got) == len(set(got))
    assert store.read("postings").where("NOT joined").count() == 5
    assert written["postings"].count("Exchange ") == 1


def test_texts_are_read_for_their_words_once(spark, tmp_path):
    """What is sorted into ranges, and read for their bounds before, is words as written; distinct ids need no telling apart."""
    from stallkeeper.functions.text import fold, search_words

    written = {}

    class Seen(CatalogStore):
        def commit(self, tables, *rest):
            written.update({n: t._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for n, t in tables.items()})
            return super().commit(tables, *rest)

    texts = ["RTX ٤٠٦٠ برو ماكس", "Ünïcode ۴۰ a a b", None, "", "plain words, plain-words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    store = Seen(spark, f"{tmp_path}/index")
    lexicon.publish(docs, store, ["name"])
    assert not [n for n, plan in written.items() if "regexp_replace" in plan or "lower(" in plan]
    assert "Aggregate" not in written["postings"]
    want = {(r["id"], w) for r in docs.select("id", search_words(fold(F.col("name"))).alias("ws")).collect() for w in r["ws"]}
    assert {(r["id"], r["word"]) for r in store.read("postings").where("NOT joined").collect()} == want
    assert not [p for p in tmp_path.glob("index/_aside*")]
