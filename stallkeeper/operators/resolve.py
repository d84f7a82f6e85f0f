"""Finding listings of the same product: blocking, scoring, verdicts, decisions and merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import EXACT, REVIEWER, VARIANT, attributes, candidate_score, conflicts, evidence, pair_key, retitled, verdict
from ..functions.text import fold_all, normalized, title_tokens
from ..schemas import ALIAS_TITLES, BLOCK_CAP, MATCHED, RULE_VERSION, SCORE_FLOOR, TOP_CANDIDATES
from ..scratch import Scratch
from ..workers import ready

# The budget rule for adjudication costs.
COST_MARGIN, COST_FLOOR, MONTHLY_BUDGET = "2", "0.05", "10"


def first_evidence(offers: DataFrame) -> DataFrame:
    """Each variant's first offer by id; found by aggregation, so offers are folded before they move."""
    rest = [c for c in offers.columns if c != "variant_id"]
    first = offers.groupBy("variant_id").agg(F.min_by(F.struct(*rest), F.struct("offer_id", *(c for c in rest if c != "offer_id"))).alias("_first"))
    return first.select(*(F.col(c) if c == "variant_id" else F.col(f"_first.{c}").alias(c) for c in offers.columns))


def alias_titles(titles: DataFrame, main: DataFrame, most: int = ALIAS_TITLES) -> DataFrame:
    """Up to eight other titles of each variant, longest first; only those are collected."""
    others = titles.select("variant_id", "title").distinct().join(main.select("variant_id", "title"), ["variant_id", "title"], "left_anti")
    order = Window.partitionBy("variant_id").orderBy(F.length("title").desc(), "title")
    ranked = others.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    return ranked.groupBy("variant_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "title"))).alias("found")).select("variant_id", F.transform("found", lambda f: f["title"]).alias("aliases"))


def listings_of(products: DataFrame, variants: DataFrame, offers: DataFrame) -> DataFrame:
    """Listings to match, one for each variant that an offer counts for: variant_id, product_id, provider_ids, title, ``e`` and ``others``.

    ``products`` has product_id, category, brand, name, model_number and specifications,
    ``variants`` variant_id, product_id, mpn, gtin and options, ``offers`` (trusted and
    current ones) variant_id, offer_id, provider_id and title, which may be null and then is
    the product's name. The first offer by id gives the main title; up to eight other titles,
    longest first, are aliases. ``e`` is the evidence under the main title, ``others`` has
    attributes and tokens under each alias.
    """
    named = products.select("product_id", F.col("name").alias("_name"))
    titled = offers.join(variants.select("variant_id", "product_id"), "variant_id").join(named, "product_id").select("variant_id", "offer_id", "provider_id", F.coalesce("title", "_name").alias("title"))
    main = first_evidence(titled.select("variant_id", "offer_id", "title"))
    sellers = titled.groupBy("variant_id").agg(F.array_sort(F.collect_set("provider_id")).alias("provider_ids"))
    rows = main.join(sellers, "variant_id").join(alias_titles(titled, main), "variant_id", "left").join(variants, "variant_id").join(products, "product_id")
    return with_evidence(rows)


def with_evidence(rows: DataFrame) -> DataFrame:
    """Adds ``e`` and ``others`` to rows of category, brand, title, mpn, gtin, model_number, options, specifications and aliases.

    All texts of a row are folded together, once, before any pattern looks at them.
    """
    ready(rows.sparkSession)
    texts, maps = ("brand", "title", "mpn", "gtin", "model_number"), ("options", "specifications")
    none = F.array().cast("array<string>")
    parts = [F.array(*texts), *(part for m in maps for part in (F.coalesce(F.map_keys(m), none), F.coalesce(F.map_values(m), none))), F.coalesce("aliases", none)]
    sizes = [F.size(p) for p in parts]
    begins = [F.lit(1)]
    for n in sizes[:-1]:
        begins.append(begins[-1] + n)
    # In a column of its own, as Python functions can't stand inside array expressions.
    folded = rows.withColumn("_all", fold_all(F.concat(*parts)))
    own = [F.slice("_all", b, n) for b, n in zip(begins, sizes, strict=True)]
    text = {name: F.get(own[0], i) for i, name in enumerate(texts)}
    options, specs = (F.map_from_arrays(own[i], own[i + 1]) for i in (1, 3))
    folded = folded.select(*rows.columns, F.struct(*(c.alias(n) for n, c in text.items()), options.alias("options"), specs.alias("specs"), own[5].alias("aliases")).alias("_f"))
    f = F.col("_f")
    e = evidence(F.col("category"), f["brand"], f["title"], f["mpn"], f["gtin"], f["model_number"], f["options"], f["specs"])
    others = F.transform(f["aliases"], lambda t: F.struct(attributes(F.col("category"), t, f["options"], f["specs"]).alias("attrs"), title_tokens(normalized(t)).alias("tokens")))
    return folded.select(*rows.columns, e.alias("e"), others.alias("others"))


TITLES = "array<struct<attrs:map<string,string>,tokens:array<string>>>"


def _titles(listings: DataFrame) -> Column:
    """Attributes and tokens under the main title, then under each alias if listings have ``others``."""
    main = F.array(F.struct(F.col("e.attrs").alias("attrs"), F.col("e.tokens").alias("tokens"))).cast(TITLES)
    return F.concat(main, F.coalesce(F.col("others").cast(TITLES), F.array().cast(TITLES))) if "others" in listings.columns else main


def block_keys(listings: DataFrame, categories: tuple[str, ...] | None = MATCHED) -> DataFrame:
    """Rows (block, capped, variant_id) of every listing with a brand in one of the categories: identifiers, and models and title words with a digit under any of its titles.

    ``listings`` has variant_id, evidence ``e`` (see ``functions.identity.evidence``) and may have ``others``.
    """
    e, titles = F.col("e"), _titles(listings)
    models = F.flatten(F.transform(titles, lambda t: F.array(*(F.concat(F.lit(f"{f}="), F.element_at(t["attrs"], F.lit(f))) for f in ("cpu_model", "generation", "chip")))))
    ids = F.array(F.concat(F.lit("gtin="), e["gtin"]), F.concat(F.lit("mpn="), e["mpn"]))
    words = F.transform(F.filter(F.flatten(F.transform(titles, lambda t: t["tokens"])), lambda t: (F.length(t) >= 4) & t.rlike("[0-9]")), lambda t: F.concat(F.lit("word="), t))
    tagged = lambda keys, capped: F.transform(F.array_compact(keys), lambda k: F.struct(k.alias("key"), F.lit(capped).alias("capped")))
    keys = F.explode(F.array_distinct(F.concat(tagged(ids, False), tagged(models, True), tagged(words, True))))
    matched = e["brand"].isNotNull() & (F.lit(True) if categories is None else e["category"].isin(*categories))
    found = listings.where(matched).select("variant_id", e["category"].alias("category"), e["brand"].alias("brand"), keys.alias("k"))
    return found.select(F.concat_ws("\u0001", "category", "brand", "k.key").alias("block"), F.col("k.capped").alias("capped"), "variant_id")


def within_cap(blocks: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """Blocks but those of words and models that are too common to say anything. Counted before the join, so no task holds a block."""
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    return blocks.join(sizes.where(F.col("size") > 1), "block").where(~F.col("capped") | (F.col("size") <= cap)).select("block", "variant_id")


def candidate_pairs(listings: DataFrame, cap: int = BLOCK_CAP, categories: tuple[str, ...] | None = MATCHED) -> DataFrame:
    """Ordered pairs (left, right) that share a block, of different products and with no provider in common."""
    carried = listings.select(F.struct("variant_id", "product_id", "provider_ids").alias("variant_id"), *(c for c in ("e", "others") if c in listings.columns))
    blocks = within_cap(block_keys(carried, categories), cap)
    left, right = (blocks.select("block", F.col("variant_id").alias(n)) for n in ("a", "b"))
    # Product and providers come along with the block, so pairs that can't be are never made.
    apart = (F.col("a.product_id") != F.col("b.product_id")) & ~F.arrays_overlap("a.provider_ids", "b.provider_ids")
    # Few bytes of blocks make many pairs: both sides are dealt to a fixed number of tasks, and so are the pairs, which are told apart there and not before.
    n = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = left.repartition(n, "block").join(right.repartition(n, "block").hint("merge"), "block").where(apart)
    return made.select(F.col("a.variant_id").alias("left"), F.col("b.variant_id").alias("right")).repartition(n, "left", "right").distinct()


def top_candidates(scored: DataFrame, k: int = TOP_CANDIDATES, floor: float = SCORE_FLOOR) -> DataFrame:
    """Each listing's best k, then those above the floor, each unordered pair once."""
    order = Window.partitionBy("left").orderBy(F.desc("score"), "right")
    best = scored.withColumn("_rank", F.row_number().over(order)).where((F.col("_rank") <= k) & (F.col("score") >= floor))
    low, high = F.least("left", "right"), F.greatest("left", "right")
    return best.select(pair_key(F.col("left"), F.col("right")).alias("pair_key"), low.alias("left"), high.alias("right"), "score").groupBy("pair_key", "left", "right").agg(F.max("score").alias("score"))


def _with_evidence(pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """Pairs with both sides' evidence (a, b) and that under each of their titles (every_a, every_b)."""
    side = lambda n, e: listings.select(F.col("variant_id").alias(n), F.col("e").alias(e), _titles(listings).alias(f"every_{e}"))
    # Evidence is wide, and pairs are many: neither is to be broadcast or gathered in a few tasks.
    n = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = pairs.repartition(n, "left").join(side("left", "a").repartition(n, "left").hint("merge"), "left")
    return told.repartition(n, "right").join(side("right", "b").repartition(n, "right").hint("merge"), "right")


def _over_titles(of: Callable[[Column, Column], Column]) -> Column:
    """What ``of`` says of each pair of the two sides' titles, as an array."""
    a, b = F.col("a"), F.col("b")
    return F.flatten(F.transform("every_a", lambda x: F.transform("every_b", lambda y: of(retitled(a, x), retitled(b, y)))))


def score_pairs(pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """The best score over all pairs of titles, aliases included."""
    scored = _with_evidence(pairs, listings)
    score = F.array_max(_over_titles(candidate_score)) if "others" in listings.columns else candidate_score(F.col("a"), F.col("b"))
    return scored.select("left", "right", score.alias("score"))


def pair_verdicts(pairs: DataFrame, listings: DataFrame) -> DataFrame:
    """What the main titles' evidence settles; exact matches of which some pair of titles conflicts are uncertain."""
    both = _with_evidence(pairs, listings).withColumn("conflicts", conflicts(F.col("a"), F.col("b")))
    both = both.withColumn("verdict", verdict(F.col("a"), F.col("b"), F.col("conflicts")))
    if "others" in listings.columns:
        both = downgrade_alias_conflicts(both, F.exists(_over_titles(lambda a, b: F.size(conflicts(a, b))), lambda n: n > 0))
    return both.select(*pairs.columns, "conflicts", "verdict")


def downgrade_alias_conflicts(verdicts: DataFrame, alias_conflict: Column) -> DataFrame:
    """Exact matches of which some pair of alias titles conflicts are uncertain."""
    return verdicts.withColumn("verdict", F.when((F.col("verdict") == EXACT) & alias_conflict, "uncertain").otherwise(F.col("verdict")))


def reuse_decisions(pairs: DataFrame, decisions: DataFrame, version: int = RULE_VERSION) -> DataFrame:
    """Pairs with the stored decision that still holds: of the same pair with both signatures, else the latest one on equal signatures."""
    live = decisions.where(F.col("rule_version") == version)
    sides = lambda: F.array_sort(F.array("left_signature", "right_signature"))
    own = live.select("pair_key", "left_signature", "right_signature", F.col("verdict").alias("own"))
    latest = live.groupBy(sides().alias("sides")).agg(F.max_by("verdict", F.struct("created_at", "pair_key")).alias("other"))
    found = pairs.join(own, ["pair_key", "left_signature", "right_signature"], "left").withColumn("sides", sides()).join(latest, "sides", "left")
    how = F.when(F.col("own").isNotNull(), "exact").when(F.col("other").isNotNull(), "signature").otherwise("none")
    return found.withColumn("verdict", F.coalesce("own", "other")).withColumn("reused", how).drop("own", "other", "sides")


def upsert_decisions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored decisions with new ones; one whose signatures and version are unchanged keeps its review."""
    same = ["left_signature", "right_signature", "rule_version"]
    changed = new.join(stored.select("pair_key", *same), ["pair_key", *same], "left_anti")
    rest = stored.join(changed.select("pair_key"), "pair_key", "left_anti")
    return rest.unionByName(changed.withColumn("reviewed", F.lit(False)).withColumn("applied_at", F.lit(None).cast("timestamp")))


def budget_spent(batches: DataFrame, as_of: Column) -> DataFrame:
    """What this month's batches hold of the budget: measured ones at twice their cost within bounds, others in full."""
    reserved, actual = F.col("reserved_usd"), F.col("actual_usd")
    dec = lambda v: F.lit(v).cast("decimal(4,2)")
    measured = (F.col("status") == "completed") & (actual > 0)
    held = F.when(measured, F.least(reserved, F.greatest(actual * dec(COST_MARGIN), reserved * dec(COST_FLOOR)))).otherwise(reserved)
    live = batches.where((F.col("created_at") >= F.date_trunc("month", as_of)) & F.col("status").isin("reserved", "submitted", "completed", "failed"))
    return live.agg(F.coalesce(F.sum(held.cast("decimal(14,6)")), F.lit(0).cast("decimal(24,6)")).alias("spent"))


def may_reserve(batches: DataFrame, as_of: Column, cost: Column, budget: str = MONTHLY_BUDGET) -> DataFrame:
    return budget_spent(batches, as_of).withColumn("allowed", F.col("spent") + cost <= F.lit(budget).cast("decimal(12,4)"))


def reserve_cost(body: Column, output_tokens: int, input_rate: str, output_rate: str) -> Column:
    rate = lambda r: F.lit(r).cast("decimal(12,10)")
    return (F.octet_length(body) + 1000).cast("decimal(12,0)") * rate(input_rate) + F.lit(output_tokens).cast("decimal(12,0)") * rate(output_rate)


def review_queue(decisions: DataFrame, current: DataFrame, limit: int) -> DataFrame:
    """The first pending decisions, cut to the limit before stale ones go."""
    pending = decisions.where(F.col("applied_at").isNull() & ~F.col("reviewed") & F.col("verdict").isin(EXACT, VARIANT, "uncertain"))
    first = pending.orderBy("created_at", "pair_key").limit(limit)
    return first.join(current, ["pair_key", "left_signature", "right_signature"], "left_semi")


def fill_budget(pairs: DataFrame, limit: int) -> DataFrame:
    """Pairs to ask about, best first; keys order as text."""
    return pairs.orderBy(F.desc("score"), "pair_key").limit(limit)


def fill_by_cost(pairs: DataFrame, left: Column, scratch: Scratch) -> DataFrame:
    """The pairs, best first, whose costs together stay within what is left of the budget, with their running sum ``spent``.

    ``pairs`` has pair_key, score and a decimal ``cost`` that is not negative; a null cost
    counts as none. The first pair that doesn't fit ends the list. Pairs are sorted into
    ranges; sums of whole ranges give each range its start, so no task sees all pairs.
    """
    best_first = [F.desc("score"), F.asc("pair_key")]
    cost = F.coalesce(F.col("cost"), F.lit(0)).cast("decimal(38,10)")
    ranged = scratch.put("ranged", pairs.withColumn("_cost", cost).repartitionByRange(*best_first).withColumn("_range", F.spark_partition_id()))
    whole = ranged.groupBy("_range").agg(F.sum("_cost").cast("decimal(38,10)").alias("sum"))
    # As many rows as there are ranges.
    starts = whole.select("_range", F.coalesce(F.sum("sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,10)").alias("_start"))
    open_ = ranged.join(F.broadcast(starts.where(F.col("_start") <= left)), "_range")
    within = Window.partitionBy("_range").orderBy(*best_first).rowsBetween(Window.unboundedPreceding, 0)
    summed = open_.withColumn("spent", (F.col("_start") + F.sum("_cost").over(within)).cast("decimal(38,10)"))
    return summed.where(F.col("spent") <= left).select(*pairs.columns, "spent")


def request_lines(pairs: DataFrame, body: Column) -> DataFrame:
    """One JSON line for each pair."""
    return pairs.select(F.to_json(F.struct(F.col("pair_key").alias("custom_id"), body.alias("body"))).alias("value"))


ANSWER = "struct<status:string,output:array<struct<content:array<struct<type:string,text:string>>>>,input_tokens:bigint,output_tokens:bigint>"


def collect_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with what was answered: malformed, unfinished and missing answers count as uncertain.

    ``answers`` has custom_id and the response as JSON text; of several the greatest text holds.
    """
    last = answers.groupBy("custom_id").agg(F.max("response").alias("response")).withColumnRenamed("custom_id", "pair_key")
    read = F.from_json("response", ANSWER)
    parts = F.filter(F.flatten(F.transform(read["output"], lambda o: o["content"])), lambda c: c["type"] == "output_text")
    text = F.when(read["status"] == "completed", F.array_join(F.transform(parts, lambda c: c["text"]), ""))
    said = F.get_json_object(text, "$.verdict")
    known = F.when(said.isin(EXACT, VARIANT, "different_product", "uncertain"), said)
    how = F.when(F.col("response").isNull(), "unanswered").when(known.isNull(), "malformed").otherwise("answered")
    joined = requests.join(last, "pair_key", "left")
    return joined.select(*requests.columns, F.coalesce(known, F.lit("uncertain")).alias("verdict"), how.alias("answer"), read["input_tokens"].alias("input_tokens"), read["output_tokens"].alias("output_tokens"))


def answer_totals(collected: DataFrame) -> DataFrame:
    """What the collected answers used in all: input_tokens, output_tokens and answers."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return collected.agg(total("input_tokens"), total("output_tokens"), F.count_if(F.col("answer") == "answered").alias("answers"))


def answer_cost(collected: DataFrame, input_rate: str, output_rate: str, share: str = "0.5") -> DataFrame:
    """What the answers cost: input_tokens, output_tokens, ``cost_usd`` and ``actual_usd``, which is null unless all were answered.

    A batch costs ``share`` of the plain rates. With an answer missing its tokens may be
    missing too, so the batch keeps its whole reservation.
    """
    rate = lambda r: F.lit(r).cast("decimal(12,10)")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("answer") == "answered", F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).alias(c)
    sums = collected.agg(total("input_tokens"), total("output_tokens"), F.coalesce(F.every(F.col("answer") == "answered"), F.lit(False)).alias("_all"))
    tokens = lambda c: F.col(c).cast("decimal(20,0)")
    cost = ((tokens("input_tokens") * rate(input_rate) + tokens("output_tokens") * rate(output_rate)) * F.lit(share).cast("decimal(4,2)")).cast("decimal(30,10)")
    return sums.select("input_tokens", "output_tokens", cost.alias("cost_usd"), F.when(F.col("_all") & (cost > 0), cost).alias("actual_usd"))


def stale_requests(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Submitted requests that no longer equal what the current evidence would ask (both: pair_key, body)."""
    now = current.select("pair_key", F.col("body").alias("_now"))
    return requests.join(now, "pair_key", "left").where(~F.col("body").eqNullSafe(F.col("_now"))).drop("_now")


def decide_by_hand(decisions: DataFrame, pair: str, said: str, current: DataFrame) -> DataFrame:
    """Decisions with a reviewer's word on a pair whose evidence is still current; an exact match must be free of conflicts.

    ``current`` has pair_key, both signatures and conflicts. A stale pair keeps its decision.
    """
    live = current.where((F.col("pair_key") == pair) & (F.lit(said != EXACT) | (F.size("conflicts") == 0))).select("pair_key", "left_signature", "right_signature", F.lit(True).alias("_live"))
    joined = decisions.join(live, ["pair_key", "left_signature", "right_signature"], "left")
    hit = F.coalesce("_live", F.lit(False))
    return joined.withColumn("verdict", F.when(hit, said).otherwise(F.col("verdict"))).withColumn("method", F.when(hit, REVIEWER).otherwise(F.col("method"))).withColumn("reviewed", F.col("reviewed") | hit).drop("_live")
