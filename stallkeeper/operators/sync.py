"""Snapshot algebra of a provider's sync: what to insert, update, keep and delete, behind guards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import conflicts, evidence_class
from ..schemas import (
    COVERAGE_DROP, COVERAGE_PRIOR, COVERAGE_RELATIVE, COVERAGE_ROWS, DELETE_FRACTION, DIRECT, LEAST_PRODUCTS, WITH_MARKETPLACE,
)


class SyncRefused(ValueError):
    """A guard found the new snapshot implausible; nothing was written."""


def changes(prior: DataFrame, staged: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Prior and staged rows side by side with ``action``: insert, update, keep or delete.

    Rows are equal if all compared columns are, nulls included. One full join on the keys,
    which are unique on both sides.
    """
    packed = lambda df, name: df.select(*keys, F.struct(*compared).alias(name))
    both = packed(prior, "old").join(packed(staged, "new"), keys, "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return both.withColumn("action", action)


def stale_rows(prior: DataFrame, staged: DataFrame, keys: list[str], migrated: Column | None = None) -> DataFrame:
    """Prior rows that are staged no more, but for those that only changed their key."""
    gone = prior.join(staged.select(*keys).distinct(), keys, "left_anti")
    return gone if migrated is None else gone.where(~migrated)


def sync_counts(actions: DataFrame) -> DataFrame:
    count = lambda *a: F.count_if(F.col("action").isin(*a))
    return actions.agg(
        count("insert", "update", "keep").alias("staged"), count("insert", "update").alias("upserted"), count("delete").alias("deleted"),
        count("update", "keep", "delete").alias("previous"),
    )


def deletion_guard(actions: DataFrame, by: list[str], fraction: float = DELETE_FRACTION) -> DataFrame:
    """For each group whether the sync may go on: something is staged and no more than the fraction of prior rows goes."""
    counts = actions.groupBy(*by).agg(
        F.count_if(F.col("action") != "insert").alias("existing"), F.count_if(F.col("action") == "delete").alias("to_delete"), F.count_if(F.col("action") != "delete").alias("staged")
    )
    refused = (F.col("staged") == 0) | ((F.col("existing") > 0) & (F.col("to_delete") / F.col("existing") > fraction))
    return counts.withColumn("refused", refused)


def price_coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("price_status") == "known", F.lit(False))).alias("known"))


def coverage_guard(prior: DataFrame, staged: DataFrame, by: list[str]) -> DataFrame:
    """For each group whether the share of known prices fell too far."""
    old = price_coverage(prior, by).select(*by, F.col("total").alias("prior_total"), (F.col("known") / F.col("total")).alias("prior_share"))
    new = price_coverage(staged, by).select(*by, F.col("total").alias("staged_total"), (F.col("known") / F.col("total")).alias("staged_share"))
    enough = (F.col("prior_total") >= COVERAGE_ROWS) & (F.col("staged_total") >= COVERAGE_ROWS) & (F.col("prior_share") > COVERAGE_PRIOR)
    fell = (F.col("prior_share") - F.col("staged_share") > COVERAGE_DROP) & (F.col("staged_share") < F.col("prior_share") * (1 - COVERAGE_RELATIVE))
    return old.join(new, by).withColumn("refused", enough & fell)


def check_completeness(found: int, errors: int, least: int = LEAST_PRODUCTS) -> None:
    if errors or found < least:
        raise SyncRefused(f"incomplete crawl: {found} products, {errors} errors")


def untrusted_rows(staged: DataFrame, providers: DataFrame) -> DataFrame:
    """Staged rows that the trust gate refuses, with the reason."""
    joined = staged.join(providers.select("provider_id", "trust", "approved_sellers"), "provider_id", "left")
    seller = F.coalesce(F.array_contains("approved_sellers", F.col("seller_id")), F.lit(False))
    why = (
        F.when(F.col("trust").isNull(), "unknown provider").when(~F.col("trust").isin(DIRECT, WITH_MARKETPLACE), "provider not approved")
        .when((F.col("trust") == WITH_MARKETPLACE) & (F.size("approved_sellers") == 0), "no approved sellers").when((F.col("trust") == WITH_MARKETPLACE) & ~seller, "seller not approved")
    )
    return joined.withColumn("reason", why).where("reason IS NOT NULL").drop("trust", "approved_sellers")


class SnapshotStore:
    """Versions of a table as folders; a reader sees a version only once it is whole, and old ones stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("snapshot="))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/snapshot={found[-1] if version is None else version}")

    def write(self, rows: DataFrame) -> int:
        """Publishes the next version by a rename, so ``rows`` may read the current one."""
        version = (self.versions() or [0])[-1] + 1
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        if not self._fs.rename(self._at(staged), self._at(f"{self.path}/snapshot={version}")):
            raise OSError(f"snapshot {version} could not be published")
        return version


def replace_provider(prior: DataFrame, staged: DataFrame, keys: list[str], compared: list[str], now: Column, fraction: float = DELETE_FRACTION) -> DataFrame:
    """The next snapshot of one provider's rows: created_at stays, updated_at moves only with a change.

    ``prior`` has created_at and updated_at besides. Raises SyncRefused if the deletion guard
    objects; counts are taken in one aggregation.
    """
    actions = changes(prior, staged, keys, compared)
    if (guard := deletion_guard(actions, []).first()) is None or guard["refused"]:
        raise SyncRefused("nothing is staged, or too many rows would go")
    times = prior.select(*keys, "created_at", "updated_at")
    kept = actions.where("action <> 'delete'").join(times, keys, "left")
    same = F.col("action") == "keep"
    return kept.select(*keys, "new.*", F.coalesce("created_at", now).alias("created_at"), F.when(same, F.col("updated_at")).otherwise(now).alias("updated_at"))


def _folded(rows: DataFrame, key: str) -> DataFrame:
    """Each id with its distinct gtins (_gs) and pairs of mpn and brand (_ms) in the form they are compared in; blanks are none."""
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    mpn, brand = F.lower(filled("mpn")), F.lower(filled("brand"))
    return rows.groupBy(F.col(key).alias("id")).agg(F.collect_set(filled("gtin")).alias("_gs"), F.collect_set(F.when(mpn.isNotNull() & brand.isNotNull(), F.struct(mpn.alias("mpn"), brand.alias("brand")))).alias("_ms"))


def identifier_candidates(listings: DataFrame, variants: DataFrame) -> DataFrame:
    """Pairs that agree in gtin, or in mpn and brand in any case: two equal-key joins in place of an OR. Blanks agree with nothing.

    A pair comes from the least identifier that both sides have, gtins first, so pairs are
    distinct as they are made and none is held or moved. Identifiers are dealt to a fixed
    number of tasks, as few bytes of them can make many pairs.
    """
    n = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [_folded(listings, "listing_id"), _folded(variants, "variant_id")]
    a, b = F.col("a._gs"), F.col("b._gs")
    one = (F.size(a) < 2) & (F.size(b) < 2)
    # Where each side has one value at most, comparing those two is enough.
    joint = lambda c: F.array_min(F.array_intersect(f"a.{c}", f"b.{c}"))
    first = {"_gs": one | (F.col("a.k") == joint("_gs")), "_ms": ((F.size("a._ms") < 2) & (F.size("b._ms") < 2)) | (F.col("a.k") == joint("_ms"))}
    other = F.when(one, F.coalesce(F.get(a, 0) != F.get(b, 0), F.lit(True))).otherwise(~F.arrays_overlap(a, b))
    pairs = []
    for keys, test in (("_gs", first["_gs"]), ("_ms", first["_ms"] & other)):
        # Not broadcast: one side's tasks would be as few as its files.
        x, y = (s.select("id", "_gs", "_ms", F.explode(keys).alias("k")).repartition(n, "k").alias(name) for s, name in zip(sides, "ab", strict=True))
        pairs.append(x.join(y.hint("merge"), F.col("a.k") == F.col("b.k")).where(test).select(F.col("a.id").alias("listing_id"), F.col("b.id").alias("variant_id")))
    return pairs[0].union(pairs[1])


def compatible(pairs: DataFrame, listings: DataFrame, variants: DataFrame) -> DataFrame:
    """Pairs whose evidence ``e`` doesn't conflict; an identifier only narrows the choice."""
    sides = pairs.join(listings.select("listing_id", F.col("e").alias("_a")), "listing_id").join(variants.select("variant_id", F.col("e").alias("_b")), "variant_id")
    return sides.where(F.size(conflicts(F.col("_a"), F.col("_b"))) == 0).select(*pairs.columns)


def single_candidate(pairs: DataFrame) -> DataFrame:
    """Listings with exactly one candidate left."""
    return pairs.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"), F.min("variant_id").alias("variant_id")).where("n = 1").drop("n")


def single_compatible(listings: DataFrame, variants: DataFrame) -> DataFrame:
    """Listings with exactly one variant of an equal identifier that nothing speaks against, which is ``single_candidate`` of all ``compatible`` pairs.

    Rows of one class, that is with the same identifiers and evidence, have the same answer,
    so classes are paired and variants only counted. ``listings`` and ``variants`` have
    distinct ids, gtin, mpn, brand and evidence ``e``.
    """
    kind = F.xxhash64(*(F.lower(F.trim(F.col(c).cast("string"))) for c in ("mpn", "brand")), F.trim(F.col("gtin").cast("string")), evidence_class(F.col("e")))
    told = ["gtin", "mpn", "brand", "e"]

    def classes(rows: DataFrame, key: str) -> DataFrame:
        found = rows.groupBy(kind.alias("_kind")).agg(F.any_value(F.struct(*told)).alias("x"), F.count(F.lit(1)).alias("_n"), F.min(key).alias("_least"))
        return found.select(F.col("_kind").alias(key), *(f"x.{c}" for c in told), "_n", "_least")

    asked, offered = classes(listings, "listing_id"), classes(variants, "variant_id")
    agree = compatible(identifier_candidates(asked, offered), asked, offered).join(offered.select("variant_id", "_n", "_least"), "variant_id")
    single = agree.groupBy(F.col("listing_id").alias("_kind")).agg(F.sum("_n").alias("_n"), F.min("_least").alias("variant_id")).where("_n = 1")
    return listings.select("listing_id", kind.alias("_kind")).join(single.hint("merge"), "_kind").select("listing_id", "variant_id")


def resolve_identity_keys(keys: DataFrame, variants: DataFrame, aliases: DataFrame) -> DataFrame:
    """The variant of each key: its own first, else one that it is an alias of."""
    known = variants.select("identity_key", "variant_id", F.lit(0).alias("p")).union(aliases.select("identity_key", "variant_id", F.lit(1).alias("p")))
    first = known.groupBy("identity_key").agg(F.min(F.struct("p", "variant_id")).alias("best"))
    return keys.join(first, "identity_key", "left").select(*keys.columns, "best.variant_id")


def assign_variant(staged: DataFrame, offers: DataFrame, by_key: DataFrame, by_identifier: DataFrame) -> DataFrame:
    """The variant of each staged offer and what decided: the offer on record, its key, or one compatible identifier match."""
    source = offers.select("provider_id", "source_key", F.col("variant_id").alias("_source"))
    key = by_key.select("listing_id", F.col("variant_id").alias("_key"))
    match = by_identifier.select("listing_id", F.col("variant_id").alias("_match"))
    joined = staged.join(source, ["provider_id", "source_key"], "left").join(key, "listing_id", "left").join(match, "listing_id", "left")
    how = F.when(F.col("_source").isNotNull(), "source").when(F.col("_key").isNotNull(), "key").when(F.col("_match").isNotNull(), "identifier").otherwise("new")
    return joined.withColumn("variant_id", F.coalesce("_source", "_key", "_match")).withColumn("decided_by", how).drop("_source", "_key", "_match")


def group_families(staged: DataFrame, group: list[str], order: Column) -> DataFrame:
    """Offers without a variant share the product of their group: the first matched one's in scan order, else a new one."""
    scan = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donor = F.first("product_id", ignorenulls=True).over(scan)
    return staged.withColumn("family_product_id", F.coalesce("product_id", donor)).withColumn("family_lead", F.first("source_key").over(scan))


def isolated(variants: DataFrame, offers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Variants that may be reclassified in place: alone in their product, with one offer and no alias."""
    in_product = variants.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("product_id")
    one_offer = offers.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("variant_id")
    return variants.join(in_product, "product_id", "left_semi").join(one_offer, "variant_id", "left_semi").join(aliases, "variant_id", "left_anti")


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_anti")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each provider's last crawl that has an end: a finished one, or an unfinished one that a later run overtook, which counts as failed.

    Runs are in order of ``run_id``; the newest run of a provider may still go on and then says nothing.
    """
    rest = [c for c in runs.columns if c not in ("provider_id", "status")]
    newest = runs.groupBy("provider_id").agg(F.max("run_id").alias("_newest"))
    ended = runs.join(newest, "provider_id").where(F.col("finished_at").isNotNull() | (F.col("run_id") < F.col("_newest")))
    status = F.when(F.col("finished_at").isNull(), "failed").otherwise(F.col("status")).alias("status")
    key = F.struct("finished_at", "run_id")
    last = ended.groupBy("provider_id").agg(F.max_by(F.struct(status, *rest), key).alias("_last"))
    return last.select(*(F.col(c) if c == "provider_id" else F.col(f"_last.{c}").alias(c) for c in runs.columns))


def new_brands(staged: DataFrame, brands: DataFrame) -> DataFrame:
    """Brands that staged rows name and that are not on record, each once."""
    return staged.where("brand IS NOT NULL").select("brand").distinct().join(brands.select("brand"), "brand", "left_anti")


def split_conflicts(matched: DataFrame, conflict: Column, alone: DataFrame, taken: DataFrame) -> DataFrame:
    """Matched offers whose evidence conflicts with their variant: rewritten in place if the variant is isolated and
    theirs, else given a variant of their own, whose key names the variant they left if it is taken.

    ``identity_key`` may be an alias of the variant that is left; see ``released_aliases``.
    """
    marked = matched.join(alone.select("variant_id", F.lit(True).alias("_alone")), "variant_id", "left").join(taken.select("identity_key", F.lit(True).alias("_taken")).distinct(), "identity_key", "left")
    mine = F.coalesce(F.col("_alone"), F.lit(False)) & (F.col("decided_by") == "source")
    action = F.when(~F.coalesce(conflict, F.lit(False)), "keep").when(mine, "rewrite").otherwise("split")
    key = F.when((action == "split") & F.col("_taken"), F.concat_ws(":", "identity_key", F.lit("split"), F.col("variant_id").cast("string"))).otherwise(F.col("identity_key"))
    moved = F.when(action != "split", F.col("variant_id"))
    return marked.withColumn("action", action).withColumn("_key", key).withColumn("left_variant_id", F.when(action == "split", F.col("variant_id"))).withColumn("variant_id", moved).drop("_alone", "_taken", "identity_key").withColumnRenamed("_key", "identity_key")


def released_aliases(matched: DataFrame, split: DataFrame, aliases: DataFrame) -> DataFrame:
    """The aliases that stay: an offer that splits off takes its key away from the variant it leaves."""
    left = split.where("action = 'split'").select("source_key", F.col("left_variant_id").alias("variant_id"))
    gone = matched.select("source_key", "identity_key").join(left, "source_key").select("identity_key", "variant_id")
    return aliases.join(gone, ["identity_key", "variant_id"], "left_anti")


def run_summary(runs: DataFrame) -> DataFrame:
    """Whether all providers' runs succeeded, and each one's outcome; there is a row for each provider."""
    outcome = F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "status"))))
    return runs.agg(F.when(F.coalesce(F.every(F.col("status") == "succeeded"), F.lit(False)), 0).otherwise(1).alias("exit_code"), outcome.alias("outcomes"))
