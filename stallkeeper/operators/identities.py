"""Which variant and product each offer of a batch belongs to, as if the batch were read in order.

An offer may join a variant that an earlier offer of the same batch creates, so every answer
depends on those before it. A guess of all answers is put in, and each offer's answer is
worked out from the guesses of earlier ones, until nothing changes. Since answers depend on
earlier offers alone, what stays unchanged is what reading in order gives, whatever the first
guess. Offers of equal evidence and identifiers (a profile) are answered together in each
round, as what they create for one another needs no guess: the first that finds other than
one variant creates one, and so does every offer from the next that finds a second. After
some rounds, what a profile creates after an answer changed in another that it may find is
held back from the next guess, as it may follow from what was wrong; else two such profiles
could answer each other's wrong guesses, one offer a round. So rounds follow chains of
different profiles, not of offers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import conflicts, evidence_class
from ..scratch import Scratch
from .resolve import with_evidence

EVIDENCE = ("category", "brand", "title", "mpn", "gtin", "model_number", "options", "specifications")
MAPS = ("options", "specifications")
NEVER = (1 << 63) - 1
#: Rounds before what may follow from a wrong guess is held back; most batches end before.
PATIENCE = 8


def _filled(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _keys() -> list[Column]:
    """What offers are looked up by besides their identity: the gtin, and mpn and brand in any case; blanks are none."""
    mpn, brand = F.lower(_filled("mpn")), F.lower(_filled("brand"))
    return [F.concat(F.lit("g"), _filled("gtin")), F.when(mpn.isNotNull() & brand.isNotNull(), F.concat(F.lit("m"), mpn, F.lit("\u0001"), brand))]


def _number(*parts: Column) -> Column:
    """A number that equal values share, nulls told from the rest."""
    return F.xxhash64(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def _profiled(rows: DataFrame) -> DataFrame:
    """Adds what rows are looked up by (_keys) and the number of all with the same keys and evidence (_profile)."""
    keyed = rows.withColumn("_keys", F.array_compact(F.array(*_keys())))
    return keyed.withColumn("_profile", F.xxhash64(evidence_class(F.col("e")), "_keys"))


def _evidence(inputs: DataFrame) -> DataFrame:
    """For each ``_in`` the evidence ``e``, the attributes of title and options alone (_said) and those of the specifications alone (_given), which override them."""
    none, empty = F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")
    kinds = F.when(F.coalesce(F.size("specifications"), F.lit(0)) > 0, F.array(F.lit("said"), F.lit("given"))).otherwise(F.array(F.lit("said")))
    each = inputs.select("_in", *EVIDENCE, F.explode(kinds).alias("_of"), none.alias("aliases"))
    said = F.col("_of") == "said"
    each = each.withColumns({"specifications": F.when(~said, F.col("specifications")).otherwise(empty), "options": F.when(said, F.col("options")).otherwise(empty), "title": F.when(said, F.col("title"))})
    of = lambda name, c: F.max_by(F.when(F.col("_of") == name, c), F.col("_of") == name).alias(name)
    names, attrs = ("category", "brand", "mpn", "gtin", "model_number"), F.map_entries("e.attrs")
    found = with_evidence(each).groupBy("_in").agg(of("said", F.struct(*(f"e.{c}" for c in names), attrs.alias("attrs"))), of("given", attrs))
    found = found.select("_in", "said", F.map_from_entries("said.attrs").alias("_said"), F.coalesce(F.map_from_entries("given"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("_given"))
    whole = F.struct(*(F.col(f"said.{c}").alias(c) for c in names), _overridden("_said", "_given").alias("attrs"))
    return found.select("_in", whole.alias("e"), "_said", "_given")


def _overridden(said: str, given: str) -> Column:
    return F.map_concat(F.map_filter(said, lambda k, _: ~F.array_contains(F.map_keys(given), k)), given)


def _family() -> Column:
    """What new variants under one parent id share a product by: a phone's or processor's family; else null."""
    family = F.nullif(F.when(F.col("category") == "mobile_phones", F.element_at("e.attrs", "generation")).when(F.col("category") == "cpu", F.element_at("e.attrs", "cpu_model")), F.lit(""))
    return F.when(family.isNotNull(), F.concat_ws("\u0001", "category", F.lower(F.coalesce("brand", F.lit(""))), family))


def assign_batch(staged: DataFrame, stored: DataFrame, aliases: DataFrame, on_record: DataFrame, alone: DataFrame, first_new: int, scratch: Scratch, rounds: int = 1000) -> DataFrame:
    """Each staged offer with variant_id, product_id, identity_key, action, decided_by and, if it split off, left_variant_id.

    ``staged``: rank (distinct; the order of reading), source_key, identity_key, parent_key and
    the evidence columns. ``stored``: variant_id, product_id, identity_key and the evidence
    columns, as they are before the batch. ``aliases``: identity_key, variant_id.
    ``on_record``: source_key, variant_id of this provider's offers. ``alone``: variant_id of
    variants with one offer, no alias and no sibling (see ``sync.isolated``). Stored ids are
    below ``first_new``; a new variant or product has ``first_new`` plus the rank of the offer
    that creates it.

    An offer keeps the variant on record, else takes that of its identity key, of an alias, or
    the only one with an equal identifier and no conflict. Where its evidence conflicts, a
    variant alone with it is rewritten; from any other it splits off, under a key that names
    the variant if its own is taken. New variants of a family share the product of the family's
    first offer. ``action`` is keep, rewrite, split or create.

    Blank identifiers match nothing. Equal evidence is worked out once, and which profiles
    agree is, too; two variants a profile are enough to tell one from several. An identifier
    on many listings of a category that all conflict costs the pairs of their profiles. Ranks
    must be neither null nor repeated; an empty batch gives no rows.
    """
    # These tables are small as files and large as rows, so none is broadcast; small files are dealt to many tasks before patterns are looked for.
    tasks = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = lambda name, df: scratch.put(name, df).hint("merge")
    numbered = lambda df: df.withColumn("_in", _number(*map(F.col, EVIDENCE)))
    staged = staged.hint("merge")
    new, old = numbered(staged), numbered(stored.hint("merge"))
    inputs = lambda df: df.select("_in", *(F.map_entries(c).alias(c) if c in MAPS else c for c in EVIDENCE))
    distinct = put("inputs", inputs(new).unionByName(inputs(old)).distinct().repartition(tasks, "_in").withColumns({c: F.map_from_entries(c) for c in MAPS}))
    told = _evidence(distinct).join(distinct.select("_in", "category", "brand", "mpn", "gtin"), "_in")
    lends = _number(F.lower(_filled("brand")), F.col("e.category"), F.col("e.brand"), F.col("e.model_number"), F.array_sort(F.map_entries("_given")))
    told = put("told", _profiled(told).withColumns({"_lend": lends, "_family": _family(), "_keyed": F.size("_keys") > 0}))
    of = told.select("_in", "e", "_profile", "_lend", "_keyed")

    record = on_record.select("source_key", F.col("variant_id").alias("_source")).join(alone.select(F.col("variant_id").alias("_source"), F.lit(True).alias("_alone")).distinct().hint("merge"), "_source", "left")
    rows = new.select("rank", "source_key", "identity_key", "parent_key", "_in").join(record.hint("merge"), "source_key", "left")
    named = rows.groupBy("identity_key").agg(F.min("rank").alias("_least"), F.count(F.lit(1)).alias("_n"))
    for more in (aliases.groupBy("identity_key").agg(F.min("variant_id").alias("_alias")), named, old.select("identity_key", F.lit(True).alias("_stored")).distinct()):
        rows = rows.join(more.hint("merge"), "identity_key", "left")
    rows = rows.join(told.select(*of.columns, "_family").hint("merge"), "_in")
    own, family = F.concat_ws("\u0001", F.lit("own"), "source_key"), F.concat_ws("\u0001", F.lit("family"), "parent_key", "_family")
    # A key that nothing else may have needs no look-up.
    many = F.coalesce((F.col("_n") > 1) | F.col("_stored").isNotNull() | F.col("identity_key").contains(":split:"), F.lit(False))
    rows = put("rows", rows.withColumns({"_group": F.when(F.col("_family").isNull(), own).otherwise(family), "_many": many}).drop("source_key", "parent_key", "_family", "_n", "_stored"))
    rows = rows.join(rows.groupBy("_group").agg(F.min("rank").alias("_first")).hint("merge"), "_group").drop("_group")
    old = old.select("variant_id", "product_id", "identity_key", "_in").join(of.hint("merge"), "_in")
    kept = old.groupBy("product_id").agg(F.min_by(F.struct(F.col("_in").alias("_pin"), F.col("_lend").alias("_plend")), "variant_id").alias("x")).select("product_id", "x.*")
    old = put("stored", old.join(kept.hint("merge"), "product_id").select("variant_id", "product_id", "identity_key", "e", "_profile", "_keyed", "_pin", "_plend", F.lit(-1).cast("long").alias("since")))

    # The first guess: only offers without an identifier create variants, the first of each identity.
    alone_here = F.col("_source").isNull() & F.col("_alias").isNull() & ~F.col("_keyed")
    leads = alone_here & (~F.col("_many") | (F.col("_least") == F.col("rank")))
    mine = lambda r: F.lit(first_new) + F.col(r)
    state = put("state-0", rows.select(
        *FIXED[:-1], (~alone_here | F.col("_many")).alias("_open"), F.when(leads, mine("rank")).otherwise(F.coalesce("_source", F.lit(first_new - 1))).alias("variant_id"), mine("_first").alias("product_id"), F.col("_in").alias("_pin"), F.col("_lend").alias("_plend"),
        leads.alias("leads"), F.lit(False).alias("rewrites"), F.lit(False).alias("asked"), F.lit(False).alias("_moved"), F.col("identity_key").alias("key"), F.lit("new").alias("decided_by"), F.lit(None).cast("long").alias("leaves"),
    ))
    profiles = put("profiles", told.where("_keyed").groupBy("_profile").agg(F.any_value(F.struct("_keys", "e")).alias("x")).select("_profile", "x.*"))
    askers = put("askers", profiles.join(state.where("_source IS NULL AND _alias IS NULL AND _keyed").select("_profile").distinct().hint("merge"), "_profile", "left_semi"))
    agree = put("agree", _agree(askers, profiles))
    seen, moved = None, False
    for n in range(1, rounds + 1):
        versions = put(f"versions-{n}", _versions(state, old, told, first_new))
        state = put(f"state-{n}", _round(state, versions, old, profiles, askers, agree, first_new, n > PATIENCE))
        scratch.drop(f"state-{n - 1}")
        scratch.drop(f"versions-{n}")
        now = state.agg(F.bit_xor(F.xxhash64("rank", "variant_id", "product_id", "_pin", "leads", "rewrites", "asked", "key")).alias("x"), F.coalesce(F.max("_moved"), F.lit(False)).alias("moved")).first()
        # What a round with nothing held back leaves as it was is right.
        if now["x"] == seen and not (moved and n > PATIENCE):
            break
        seen, moved = now["x"], now["moved"]
    else:
        raise RuntimeError(f"answers still change after {rounds} rounds")
    action = F.when(F.col("rewrites"), "rewrite").when(~F.col("leads"), "keep").when(F.col("decided_by") == "new", "create").otherwise("split")
    found = state.select("rank", "variant_id", "product_id", F.col("key").alias("identity_key"), action.alias("action"), "decided_by", F.col("leaves").alias("left_variant_id"))
    return staged.drop("identity_key").join(found.hint("merge"), "rank")


#: What doesn't change of an offer from round to round; ``_open`` ones may be answered by what others create.
FIXED = ("rank", "identity_key", "_source", "_alias", "_alone", "_first", "_in", "e", "_profile", "_lend", "_keyed", "_many", "_open")


def _agree(askers: DataFrame, offered: DataFrame) -> DataFrame:
    """Pairs (_profile, _theirs) that share a key and that nothing speaks against; only one category's meet, as a different one conflicts in any case."""
    tasks = int(askers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(df: DataFrame, name: str, e: str) -> DataFrame:
        category = F.coalesce(F.concat(F.lit("c"), F.col("e.category")), F.lit(""))
        return df.select(F.col("_profile").alias(name), F.col("e").alias(e), category.alias("_category"), F.explode("_keys").alias("k")).repartition(tasks, "k", "_category")

    meet = side(askers, "_profile", "a").join(side(offered, "_theirs", "b").hint("merge"), ["k", "_category"])
    return meet.where(F.size(conflicts(F.col("a"), F.col("b"))) == 0).select("_profile", "_theirs").distinct()


def _versions(state: DataFrame, old: DataFrame, told: DataFrame, first_new: int) -> DataFrame:
    """All variants with the ranks between which their evidence holds: stored, rewritten and created ones.

    ``_by`` is the profile of the offer that asked for it and found other than one, if the
    variant has that profile; ``_lent`` has the keys of those that an earlier product lent
    other evidence.
    """
    none, never = F.lit(None).cast("long"), F.lit(NEVER)
    columns = ["variant_id", "product_id", "identity_key", "e", "_profile", "_keyed", "_pin", "_plend", "since", "until", "_by", "_named", "_lent"]
    more = {"_by": none, "_named": F.lit(True), "_lent": F.lit(None).cast("array<string>")}
    rewritten = state.where("rewrites").select(F.col("variant_id").alias("_v"), F.col("rank").alias("_at"))
    stored = old.join(rewritten.hint("merge"), F.col("variant_id") == F.col("_v"), "left").withColumns({"until": F.coalesce("_at", never), **more})
    mine = state.withColumnRenamed("identity_key", "_asked_key").withColumns({"identity_key": F.col("key"), "since": F.col("rank"), "until": never, **more})
    anew = mine.where("rewrites")
    created = mine.where("leads").withColumn("_named", F.col("_many") | (F.col("key") != F.col("_asked_key")))
    own = created.where("_lend = _plend").withColumn("_by", F.when(F.col("asked"), F.col("_profile")))
    # A variant that shares an earlier product is seen under that product's category, brand, model and specifications.
    product = told.select(F.col("_in").alias("_pin"), F.col("brand"), F.col("e").alias("_p"), F.col("_given").alias("_specs"))
    lent = created.where("_lend <> _plend").join(told.select("_in", "mpn", "gtin", "_said").hint("merge"), "_in").join(product.hint("merge"), "_pin")
    e = F.struct(*(F.col(f"{'_p' if c in ('category', 'brand', 'model_number') else 'e'}.{c}").alias(c) for c in ("category", "brand", "mpn", "gtin", "model_number")), _overridden("_said", "_specs").alias("attrs"))
    lent = _profiled(lent.withColumn("e", e)).withColumns({"_keyed": F.size("_keys") > 0, "_lent": F.col("_keys")})
    return stored.select(*columns).unionByName(anew.select(*columns)).unionByName(own.select(*columns)).unionByName(lent.select(*columns))


def _candidates(versions: DataFrame, state: DataFrame, profiles: DataFrame, askers: DataFrame, agree: DataFrame, hold: bool) -> DataFrame:
    """For each profile (_at) the variants that its offers find (_out): of lasting ones the first two, which tell one from several, and all that end; but for those that its own offers create."""
    extra = versions.where("_lent IS NOT NULL AND _keyed").groupBy("_profile").agg(F.any_value(F.struct(F.col("_lent").alias("_keys"), "e")).alias("x")).select("_profile", "x.*")
    agree = agree.union(_agree(askers, extra.join(profiles.select("_profile").hint("merge"), "_profile", "left_anti")))
    offered = versions.where("_keyed").select(F.col("_profile").alias("_theirs"), "_by", "variant_id", "since", "until")
    first = lambda rows, *by: rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("since", "variant_id"))).where("_place <= 2").drop("_place")
    meet = lambda rows: agree.join(rows.hint("merge"), "_theirs").where("NOT _by <=> _profile").select(F.col("_profile").alias("_at"), "variant_id", "since", "until")
    two = first(offered.where(f"until = {NEVER}"), "_theirs", "_by")
    if hold:
        moved = state.where("_moved").groupBy(F.col("_profile").alias("_theirs")).agg(F.min("rank").alias("_sure"))
        sure = agree.where("_profile <> _theirs").join(moved.hint("merge"), "_theirs").groupBy(F.col("_profile").alias("_theirs")).agg(F.min("_sure").alias("_sure"))
        two = two.join(sure.hint("merge"), "_theirs", "left").where("_by IS NULL OR _sure IS NULL OR since <= _sure").drop("_sure")
    lasting = first(meet(two), "_at")
    return lasting.union(meet(offered.where(f"until < {NEVER}"))).groupBy("_at").agg(F.collect_list(F.struct("variant_id", "since", "until")).alias("_out"))


def _round(state: DataFrame, versions: DataFrame, old: DataFrame, profiles: DataFrame, askers: DataFrame, agree: DataFrame, first_new: int, hold: bool) -> DataFrame:
    """Every offer's answer, given the answers of those before it."""
    rank, new = F.col("rank"), lambda r: F.lit(first_new) + F.col(r)
    holds = lambda v: (v["since"] < rank) & (rank <= v["until"])
    of_guess = [F.col("leads").alias("_leads"), (F.col("leads") & F.col("asked")).alias("_created"), "_plend"]

    # Of the lasting variants of a key the first tells which comes first for each later offer.
    v = F.struct("since", "variant_id", "until")
    named = versions.where("_named").groupBy("identity_key").agg(F.min(F.when(F.col("until") == NEVER, v)).alias("_f"), F.collect_list(F.when(F.col("until") < NEVER, v)).alias("_ends"))
    known = state.where("_open").select(*FIXED, *of_guess).join(named.hint("merge"), "identity_key", "left")
    among = F.array_compact(F.concat(F.coalesce("_ends", F.array().cast("array<struct<since:bigint,variant_id:bigint,until:bigint>>")), F.array("_f")))
    known = known.withColumn("_key", F.array_min(F.filter(among, holds))["variant_id"]).drop("_f", "_ends")

    # Identifiers: offers of a profile in order, with what others create and what they create themselves.
    asked = F.col("_source").isNull() & F.col("_key").isNull() & F.col("_alias").isNull() & F.col("_keyed")
    known = known.withColumn("asked", asked).withColumn("_at", F.when(F.col("asked"), F.col("_profile")).otherwise(rank))
    known = known.join(_candidates(versions, state, profiles, askers, agree, hold).hint("merge"), "_at", "left")
    known = known.withColumn("_out", F.filter(F.coalesce("_out", F.array().cast("array<struct<variant_id:bigint,since:bigint,until:bigint>>")), holds)).withColumn("_c", F.size("_out"))
    # Whether a variant that it creates is found by its profile: yes, unless an earlier product lends other evidence.
    plain = F.col("asked") & ~(F.col("_leads") & (F.col("_plend") != F.col("_lend")))
    before = Window.partitionBy("_at").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("_one", F.min(F.when(plain & (F.col("_c") != 1), rank)).over(before))
    known = known.withColumn("_two", F.min(F.when(plain & F.col("_one").isNotNull() & (F.col("_c") >= 1), rank)).over(before))
    single = F.col("asked") & (F.col("_c") + F.col("_one").isNotNull().cast("int") + F.col("_two").isNotNull().cast("int") == 1)
    known = known.withColumn("_match", F.when(single, F.coalesce(new("_one"), F.get("_out", 0)["variant_id"]))).drop("_out", "_c", "_one", "_two", "_at")

    how = F.when(F.col("_source").isNotNull(), "source").when(F.col("_key").isNotNull(), "key").when(F.col("_alias").isNotNull(), "alias").when(F.col("_match").isNotNull(), "identifier").otherwise("new")
    # Offers that find none are dealt out by a number that no variant has.
    told = known.withColumns({"_chosen": F.coalesce("_source", "_key", "_alias", "_match", -1 - rank), "_how": how})
    their = versions.select(F.col("variant_id").alias("_v"), F.col("product_id").alias("_product"), F.col("e").alias("_theirs"), "since", "until", F.col("identity_key").alias("_current"), F.col("_pin").alias("_vpin"), F.col("_plend").alias("_vplend"))
    told = told.join(their.hint("merge"), (F.col("_chosen") == F.col("_v")) & (F.col("since") < rank) & (rank <= F.col("until")), "left")
    # A variant is alone no more if an earlier offer joined it or made a sibling of it; only stored ones may be alone.
    joined = state.where(f"NOT leads AND variant_id < {first_new}").groupBy("variant_id").agg(F.min("rank").alias("_joined"))
    siblings = state.where(f"leads AND product_id < {first_new}").groupBy("product_id").agg(F.min("rank").alias("_sibling"))
    disturbed = old.select("variant_id", "product_id").join(siblings.hint("merge"), "product_id", "left").join(joined.hint("merge"), "variant_id", "left").select(F.col("variant_id").alias("_chosen"), F.least("_joined", "_sibling").alias("_disturbed"))
    told = told.join(disturbed.hint("merge"), "_chosen", "left")
    # An identifier's match has no conflict, and may be known before there is a version of it.
    by_identifier = F.col("_how") == "identifier"
    missing = ~by_identifier & F.col("_v").isNull()
    conflict = ~by_identifier & F.coalesce(F.size(conflicts(F.col("_theirs"), F.col("e"))) > 0, F.lit(False))
    rewrites = conflict & F.col("_source").isNotNull() & F.coalesce("_alone", F.lit(False)) & (F.coalesce("_disturbed", F.lit(NEVER)) >= rank)
    # A record or an alias may name a variant that there isn't.
    told = told.withColumns({"_missing": missing, "_conflict": conflict, "rewrites": rewrites}).withColumn("leads", F.col("_missing") | (F.col("_conflict") & ~F.col("rewrites")))
    taken = F.col("_key").isNotNull()
    split = F.when(F.col("_conflict") & ~F.col("rewrites") & taken, F.concat(F.col("identity_key"), F.lit(":split:"), F.col("_chosen").cast("string")))
    key = F.when(F.col("leads"), F.coalesce(split, F.col("identity_key"))).when(F.col("rewrites") & taken & (F.col("_key") != F.col("_chosen")), F.col("_current")).otherwise(F.col("identity_key"))
    remade = lambda c, own: F.when(F.col("rewrites"), F.col(own)).otherwise(F.coalesce(c, own))
    answer = told.select(
        *FIXED, "_chosen", F.coalesce("_product", "_chosen").alias("_product"), remade("_vpin", "_in").alias("_vpin"), remade("_vplend", "_lend").alias("_vplend"), "leads", "rewrites", "asked", ((F.col("leads") & F.col("asked")) != F.col("_created")).alias("_moved"), key.alias("key"),
        F.when(F.col("_missing"), "new").otherwise(F.col("_how")).alias("decided_by"), F.when(F.col("leads") & ~F.col("_missing"), F.col("_chosen")).alias("leaves"),
    )
    none = F.lit(None).cast("long")
    settled = state.where("NOT _open").select(*FIXED, none.alias("_chosen"), none.alias("_product"), none.alias("_vpin"), none.alias("_vplend"), "leads", "rewrites", "asked", F.lit(False).alias("_moved"), "key", "decided_by", "leaves")
    # The family's first offer has the product of all that its family creates.
    firsts = state.where("rank = _first").select("_first", F.col("product_id").alias("_fproduct"), F.col("_pin").alias("_fpin"), F.col("_plend").alias("_fplend"))
    told = answer.union(settled).join(firsts.hint("merge"), "_first", "left")
    mine = lambda theirs, lent, own: F.when(~F.col("leads"), F.col(theirs)).when(F.col("_first") < rank, F.col(lent)).otherwise(own)
    return told.select(
        *FIXED, F.when(F.col("leads"), new("rank")).otherwise(F.col("_chosen")).alias("variant_id"), mine("_product", "_fproduct", new("rank")).alias("product_id"), mine("_vpin", "_fpin", F.col("_in")).alias("_pin"),
        mine("_vplend", "_fplend", F.col("_lend")).alias("_plend"), "leads", "rewrites", "asked", "_moved", "key", "decided_by", "leaves",
    )
