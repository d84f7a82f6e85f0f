"""Identities within a batch against a fold in reading order."""

import random

import pytest
from pyspark.sql import functions as F

from stallkeeper.functions.identity import CRITICAL
from stallkeeper.operators import identities, resolve, sync
from stallkeeper.scratch import Scratch

NEW = 1000
SCHEMA = "rank long, source_key string, identity_key string, parent_key string, category string, brand string, title string, mpn string, gtin string, model_number string, options map<string,string>, specifications map<string,string>"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
OF_PRODUCT = ("category", "brand", "model_number", "specifications")


def offers(seed, n):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        kind = draw.choice(["cpu", "mobile_phones", "gpu"])
        title = {"cpu": f"Ryzen 7 70{draw.randint(0, 2)}0X {draw.choice(['tray', 'box', ''])}", "mobile_phones": f"iPhone 1{draw.randint(0, 2)} {draw.choice(['128GB', '256GB'])}", "gpu": f"RTX 40{draw.randint(6, 7)}0 {draw.choice(['Eagle', 'Windforce'])}"}[kind]
        specs = draw.choice([None, None, {"Model": "abc"}, {"Generation": f"iphone 1{draw.randint(0, 2)}"}])
        out.append((i, f"s{i}", f"k{draw.randint(0, n // 2)}", f"p{draw.randint(0, 6)}", kind, draw.choice(["Acme", "ACME", "acme", None, "Other"]), title, draw.choice(["", None, "M1", "m1", "M2", "M3"]), draw.choice(["", None, None, "G1", "G2"]), draw.choice([None, None, "X1", "X2"]), draw.choice([None, {"Color": "red"}]), specs))
    return out


def clash(a, b):
    differ = lambda x, y: x is not None and y is not None and x != y
    if a["category"] != b["category"] or differ(a["brand"], b["brand"]):
        return True
    return any(differ(a[f], b[f]) for f in ("mpn", "gtin", "model_number")) or any(differ(a["attrs"].get(f), b["attrs"].get(f)) for f in CRITICAL.get(a["category"], []))


def evidence(spark, nodes):
    """Of every node's title under every node's product."""
    rows = spark.createDataFrame([(i, j, *(nodes[j if c in OF_PRODUCT else i][NAMES.index(c)] for c in identities.EVIDENCE)) for i in range(len(nodes)) for j in range(len(nodes)) if i == j or nodes[i][4] == nodes[j][4]],
                                 "i int, j int, category string, brand string, title string, mpn string, gtin string, model_number string, options map<string,string>, specifications map<string,string>")
    found = resolve.with_evidence(rows.withColumn("aliases", F.lit(None).cast("array<string>"))).select("i", "j", "e").collect()
    return {(r["i"], r["j"]): r["e"].asDict() for r in found}


def fold(staged, stored, aliases, on_record, alone, ev):
    """What reading the offers one after the other does; nodes are staged offers, then stored variants."""
    blank = lambda x: (x or "").strip() or None
    node = {v[0]: len(staged) + i for i, v in enumerate(stored)}
    rows = {**dict(enumerate(staged)), **{node[v[0]]: (None, None, v[2], None, *v[3:]) for v in stored}}
    field = lambda i, c: rows[i][NAMES.index(c)]
    variants = {v[0]: {"product": v[1], "key": v[2], "title": node[v[0]], "root": node[v[0]]} for v in stored}
    held, groups, lone, answers = dict(aliases), {}, set(alone), []
    roots = {v["product"]: v["root"] for v in variants.values()}
    for i, row in enumerate(staged):
        own = ev[i, i]
        family = {"mobile_phones": own["attrs"].get("generation"), "cpu": own["attrs"].get("cpu_model")}.get(row[4])
        group = (row[3], row[4], (row[5] or "").lower(), family) if family else ("own", row[1])
        of = lambda v: ev[variants[v]["title"], variants[v]["root"]]  # noqa: B023, E731
        source = on_record.get(row[1])
        chosen, how = source, "source"
        if chosen is None:
            chosen, how = next((v for v in sorted(variants) if variants[v]["key"] == row[2]), None), "key"
        if chosen is None:
            chosen, how = held.get(row[2]), "alias"
        if chosen is None:
            def meets(v):
                t, p = variants[v]["title"], variants[v]["root"]
                mpn, brand = blank(field(t, "mpn")), blank(field(p, "brand"))
                same = blank(row[7]) and mpn and blank(row[5]) and brand and (mpn.lower(), brand.lower()) == (row[7].lower(), row[5].lower())
                return (blank(row[8]) and blank(row[8]) == blank(field(t, "gtin"))) or same
            fit = [v for v in variants if meets(v) and not clash(of(v), own)]
            chosen, how = (fit[0], "identifier") if len(fit) == 1 else (None, "new")
        key, action = row[2], "keep"
        if chosen is not None and clash(of(chosen), own):
            if source is not None and chosen in lone:
                taken = any(v != chosen and x["key"] == key for v, x in variants.items())
                key = variants[chosen]["key"] if taken else key
                variants[chosen] |= {"title": i, "root": i, "key": key}
                roots[variants[chosen]["product"]] = i
                action = "rewrite"
            else:
                if any(x["key"] == key for x in variants.values()):
                    key = f"{key}:split:{chosen}"
                chosen, action = None, "split"
        if chosen is None:
            action = "create" if action == "keep" else action
            chosen = NEW + i
            product = groups.setdefault(group, NEW + i)
            roots.setdefault(product, i)
            lone -= {v for v, x in variants.items() if x["product"] == product}
            variants[chosen] = {"product": product, "key": key, "title": i, "root": roots[product]}
        else:
            groups.setdefault(group, variants[chosen]["product"])
            if action == "keep" and source is None:
                lone.discard(chosen)
        answers.append((i, chosen, variants[chosen]["product"], key if action != "keep" else row[2], action, how))
    return answers


def run(spark, staged, stored, aliases, on_record, alone):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rest = SCHEMA.split(", ", 4)[4]
    got = identities.assign_batch(
        frame(staged, SCHEMA), frame(stored, "variant_id long, product_id long, identity_key string, " + rest), frame(list(aliases.items()), "identity_key string, variant_id long"),
        frame(list(on_record.items()), "source_key string, variant_id long"), frame([(v,) for v in alone], "variant_id long"), NEW, Scratch(spark, "test"),
    ).collect()
    return sorted((r["rank"], r["variant_id"], r["product_id"], r["identity_key"], r["action"], r["decided_by"]) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_equals_the_fold(spark, seed):
    """First without anything stored, then beside stored variants, aliases and offers on record, some of them alone."""
    staged = offers(seed, 60)
    stored, aliases, on_record, alone = [], {}, {}, []
    if seed == 2:
        for i, v in enumerate(offers(9, 14)):
            stored.append((100 + i, 200 + i // 2 if i < 4 else 200 + i, f"stored{i}" if i % 3 else staged[30 + i][2], *v[4:]))
        aliases = {staged[40][2]: 105, staged[45][2]: 106}
        on_record = {"s3": 108, "s7": 109, "s20": 101, "s33": 110, "s50": 111, "s59": 112}
        alone = [108, 109, 110, 111, 112]
    nodes = staged + [(None, None, v[2], None, *v[3:]) for v in stored]
    want = fold(staged, stored, aliases, on_record, alone, evidence(spark, nodes))
    assert {a[4] for a in want} >= ({"keep", "create", "split"} if seed == 1 else {"keep", "create", "split", "rewrite"})
    assert run(spark, staged, stored, aliases, on_record, alone) == want


def test_blank_identifiers_match_nothing(spark):
    rows = [(1, "", "", "b"), (2, " ", None, "b"), (3, "g", "MX", "Brand"), (4, None, "mx", "BRAND"), (5, "g", "", None), (6, None, "mx", "")]
    side = lambda k: spark.createDataFrame(rows, f"{k} long, gtin string, mpn string, brand string")
    got = {tuple(r) for r in sync.identifier_candidates(side("listing_id"), side("variant_id")).collect()}
    assert got == {(3, 3), (4, 4), (3, 4), (4, 3), (5, 5), (3, 5), (5, 3)}


def test_pairs_of_repeated_ids_come_once_and_in_several_tasks(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.choice(["g1", "g2", " ", None]), rng.choice(["m", "M", "n", None]), rng.choice(["b", "B", "c"])) for _ in range(90)]
    keys = lambda r: ({("g", r[1])} if (r[1] or "").strip() else set()) | ({("m", r[2].lower(), r[3].lower())} if r[2] else set())
    want = {(a[0], b[0]) for a in rows[:60] for b in rows[30:] if keys(a) & keys(b)}
    side = lambda k, some: spark.createDataFrame(some, f"{k} long, gtin string, mpn string, brand string")
    found = sync.identifier_candidates(side("listing_id", rows[:60]), side("variant_id", rows[30:]))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert found.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_single_candidates_by_class_meet_no_more_than_classes(spark):
    """4,000 equal listings against 4,000 equal variants, which as pairs are 16 million rows; beside them, any mix by brute force."""
    rng = random.Random(6)
    some = lambda n, at: [(at + i, rng.choice(["g1", "g2", "g3", "", None]), rng.choice(["m1", "M1", "m2", None]), rng.choice(["b", "B", "c"]), "gpu", f"RTX 40{rng.randrange(3)}0") for i in range(n)]
    schema = "long, gtin string, mpn string, brand string, category string, title string"
    none, empty = F.lit(None), F.lit(None).cast("map<string,string>")
    more = {"model_number": none.cast("string"), "options": empty, "specifications": empty, "aliases": none.cast("array<string>")}
    told = lambda rows, key: resolve.with_evidence(spark.createDataFrame(rows, f"{key} {schema}").withColumns(more))
    a, b = told(some(80, 0), "listing_id").cache(), told(some(20, 500), "variant_id").cache()
    want = sync.single_candidate(sync.compatible(sync.identifier_candidates(a, b), a, b))
    got = sync.single_compatible(a, b)
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    many = told([(i, "g9", None, "b", "gpu", "RTX 4090") for i in range(4000)], "listing_id").cache()
    assert sync.single_compatible(many, many.withColumnRenamed("listing_id", "variant_id")).count() == 0
    one = many.withColumnRenamed("listing_id", "variant_id").where("variant_id = 7")
    assert sync.single_compatible(many, one).where("variant_id = 7").count() == 4000


def test_batches_are_never_broadcast(spark, tmp_path):
    """Tables that are small as files may be large as rows, which the driver would have to hold."""
    plans = []

    class Seen(Scratch):
        def put(self, name, rows):
            plans.append((name, rows._jdf.queryExecution().executedPlan().toString()))
            return super().put(name, rows)

    rows = spark.createDataFrame([(i, f"s{i}", f"k{i % 2}", None, "gpu", "B", f"RTX 40{i}0", None, None, None, None, None) for i in range(4)], SCHEMA)
    stored = rows.limit(0).select(F.col("rank").alias("variant_id"), F.col("rank").alias("product_id"), "identity_key", *identities.EVIDENCE)
    none = stored.select("identity_key", "variant_id")
    scratch = Seen(spark, "seen")
    found = identities.assign_batch(rows, stored, none, none.withColumnRenamed("identity_key", "source_key"), none.select("variant_id"), NEW, scratch)
    plans.append(("found", found._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 6 and not [name for name, plan in plans if "Broadcast" in plan]
    scratch.close()


def batch(spark, rows, rounds):
    """A first batch of gpu offers (gtin, brand, title, mpn) in order, within so many rounds."""
    staged = spark.createDataFrame([(i, f"s{i}", f"k{i}", None, "gpu", brand, title, mpn, gtin, None, None, None) for i, (gtin, brand, title, mpn) in enumerate(rows)], SCHEMA)
    stored = staged.limit(0).select(F.col("rank").alias("variant_id"), F.col("rank").alias("product_id"), "identity_key", *identities.EVIDENCE)
    none = stored.select("identity_key", "variant_id")
    scratch = Scratch(spark, "rounds")
    found = identities.assign_batch(staged, stored, none, none.withColumnRenamed("identity_key", "source_key"), none.select("variant_id"), NEW, scratch, rounds)
    got = [r["variant_id"] - NEW for r in found.orderBy("rank").collect()]
    scratch.close()
    return got


def test_rounds_do_not_grow_with_equal_offers(spark):
    """Many offers of two chips under one gtin: each chip's first creates its variant, and a round is not spent on each of the others."""
    assert batch(spark, [("G1", "B", f"RTX 40{6 + i % 2}0", None) for i in range(40)], 6) == [i % 2 for i in range(40)]


def test_rounds_do_not_grow_with_profiles_that_find_each_other(spark, monkeypatch):
    """Offers with and without a gtin in turns, all of one variant: neither is led by the other's wrong guesses for long."""
    monkeypatch.setattr(identities, "PATIENCE", 2)
    assert batch(spark, [(None if i % 2 == 0 else "G1", "B", "RTX 4060", "M1") for i in range(24)], 9) == [0] * 24


def test_classes_of_evidence_tell_which_field_is_missing(spark):
    from stallkeeper.functions.identity import evidence_class

    rows = spark.createDataFrame([("x1", None), (None, "x1")], "mpn string, gtin string")
    none = F.lit(None).cast("string")
    e = F.struct(F.lit("gpu").alias("category"), none.alias("brand"), "mpn", "gtin", none.alias("model_number"), F.create_map(F.lit("a"), F.lit("b")).alias("attrs"))
    assert rows.select(evidence_class(e).alias("n")).distinct().count() == 2
