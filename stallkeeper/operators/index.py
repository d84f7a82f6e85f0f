"""The search index as a published table: its schema, its sink and what has to go."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .catalog import CatalogStore
from .sync import SnapshotStore


class IncompatibleSchema(ValueError):
    """A field of the index has another type."""


def missing_fields(present: StructType, wanted: StructType) -> StructType:
    """Fields that the index lacks; raises where a field's type differs."""
    have = {f.name: f.dataType for f in present}
    wrong = [f.name for f in wanted if f.name in have and have[f.name] != f.dataType]
    if wrong:
        raise IncompatibleSchema(f"fields with another type: {', '.join(wrong)}")
    return StructType([f for f in wanted if f.name not in have])


@dataclass(frozen=True)
class Field:
    """A field of the index: its type as DDL, whether it is searched, and what it is embedded from."""

    name: str
    type: str
    indexed: bool = True
    optional: bool = False
    embedded_from: tuple[str, ...] = ()
    model: str = ""


def fields_of(schema: StructType) -> list[Field]:
    """The fields that a snapshot's schema was written with; what it doesn't say is searched and not embedded."""
    said = lambda f: f.metadata.get("index", {})
    return [Field(f.name, f.dataType.simpleString(), said(f).get("indexed", True), f.nullable, tuple(said(f).get("embedded_from", ())), said(f).get("model", "")) for f in schema]


def with_fields(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Rows whose schema carries what the fields say, for Parquet to keep."""
    known = {f.name: {"index": {"indexed": f.indexed, "embedded_from": list(f.embedded_from), "model": f.model}} for f in fields}
    return rows.select(*(F.col(c).alias(c, metadata=known.get(c, {})) for c in rows.columns))


def reindex_plan(present: list[Field], wanted: list[Field]) -> list[tuple[str, Field]]:
    """Drops and adds, in order, that make the index hold the wanted fields.

    A field that is there but not searched is dropped and added again; a missing one is added
    if it may be empty. A missing one that may not, another type, or another source or model
    of an embedding can't be made by a reindex and raise IncompatibleSchema.
    """
    have, plan = {f.name: f for f in present}, []
    same_type = lambda a, b: _parse_datatype_string(a) == _parse_datatype_string(b)
    for field in wanted:
        old = have.get(field.name)
        if old is None:
            if not field.optional:
                raise IncompatibleSchema(f"missing field {field.name}")
            plan.append(("add", field))
        elif not same_type(old.type, field.type) or (field.embedded_from and (old.embedded_from, old.model) != (field.embedded_from, field.model)):
            raise IncompatibleSchema(f"incompatible field {field.name}")
        elif field.indexed and not old.indexed:
            plan += [("drop", replace(field, indexed=False)), ("add", field)]
    return plan


def reindexed(rows: DataFrame, plan: list[tuple[str, Field]]) -> DataFrame:
    """The rows with the plan's fields: those that were missing are null, the others keep their values under their new marks."""
    adds = {f.name: f for what, f in plan if what == "add"}
    for f in adds.values():
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.type))
    return with_fields(rows, [adds.get(f.name, f) for f in fields_of(rows.schema)])


def index_changes(indexed: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """For each id whether it is added, written again or pruned."""
    old, new = indexed.select(key, F.lit(True).alias("_old")), documents.select(key, F.lit(True).alias("_new"))
    action = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "prune").otherwise("write")
    return old.join(new, key, "full").select(key, action.alias("action"))


def publish(documents: DataFrame, store: SnapshotStore, key: str = "id") -> dict[str, int]:
    """Writes all documents as the next version and counts them on the way; the old version stays until the new one is whole, so ids that are gone vanish only then."""
    seen = Observation()
    watched = documents.observe(seen, F.count(F.lit(1)).alias("documents"), F.count_if(F.col(key).isNull()).alias("without_id"))
    version = store.write(watched)
    return {"version": version, **seen.get}


class DeltaIndex:
    """An index that takes changes: a base, and what refreshes have changed since.

    A refresh compares the digests of documents and writes those that are new or differ, and
    tombstones of ids that are gone; the version's manifest lists the deltas, so a refresh is
    seen whole or not at all. Reading merges the base with its deltas, of which a later one
    holds; after ``every`` deltas they are folded into the next base.
    """

    def __init__(self, store: CatalogStore, key: str = "id", every: int = 20):
        self.store, self.key, self.every = store, key, every

    def _tables(self) -> list[str]:
        found = self.store.versions()
        names = self.store.manifest(found[-1]) if found else {}
        return sorted(n for n in names if n == "base" or n.startswith("delta-"))

    def _state(self) -> DataFrame | None:
        """Every id's last word, tombstones included, with its digest."""
        names = self._tables()
        if not names:
            return None
        each = [self.store.read(n).withColumn("_turn", F.lit(i)) for i, n in enumerate(names)]
        rows = each[0]
        for other in each[1:]:
            rows = rows.unionByName(other, allowMissingColumns=True)
        if len(each) == 1:
            return rows.drop("_turn")
        rest = [c for c in rows.columns if c not in (self.key, "_turn")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_turn").alias("x"))
        return last.select(self.key, *(F.col(f"x.{c}").alias(c) for c in rest))

    def read(self) -> DataFrame:
        return self._state().where("NOT _gone").drop("_gone", "_digest")

    def refresh(self, documents: DataFrame) -> dict[str, int]:
        """Takes over the documents (ids distinct, not null) and counts what was added, changed and pruned; what is equal isn't written."""
        columns = [c for c in documents.columns if c != self.key]
        digest = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
        fresh = documents.withColumn("_digest", digest).withColumn("_gone", F.lit(False))
        state = self._state()
        if state is None:
            self.store.commit({"base": fresh})
            return {"added": fresh.count(), "changed": 0, "pruned": 0}
        known = state.select(self.key, F.col("_digest").alias("_old"), F.col("_gone").alias("_was_gone"))
        # A document that was gone is new again.
        both = fresh.join(known, self.key, "full").withColumn("_what", F.when(F.col("_digest").isNull(), F.when(~F.col("_was_gone"), "pruned")).when(F.coalesce("_was_gone", F.lit(True)), "added").when(F.col("_digest") != F.col("_old"), "changed"))
        tombstones = F.col("_what") == "pruned"
        delta = both.where("_what IS NOT NULL").select(self.key, *columns, F.when(~tombstones, F.col("_digest")).alias("_digest"), tombstones.alias("_gone"), "_what")
        seen = Observation()
        counted = delta.observe(seen, *(F.count_if(F.col("_what") == w).alias(w) for w in ("added", "changed", "pruned"))).drop("_what")
        names = self._tables()
        self.store.commit({f"delta-{len(names):06}": counted})
        if len(names) >= self.every:
            self.compact()
        return dict(seen.get)

    def compact(self) -> None:
        """Folds the deltas into the next base, without the tombstones; readers of older versions still have theirs."""
        self.store.commit({"base": self._state().where("NOT _gone")}, drop=[n for n in self._tables() if n != "base"])


def detail(documents: DataFrame, offers: DataFrame, product_id: int) -> DataFrame:
    """One document with its offers in the order they are shown; the offers of one product are few."""
    own = offers.where(F.col("product_id") == product_id)
    fields = F.struct("position", *(c for c in own.columns if c not in ("position", "product_id")))
    listed = own.groupBy("product_id").agg(F.array_sort(F.collect_list(fields)).alias("offers"))
    return documents.where(F.col("id") == product_id).join(listed, F.col("id") == F.col("product_id"), "left").drop("product_id")
