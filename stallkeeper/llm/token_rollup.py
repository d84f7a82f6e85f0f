r"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch holds inserts, deletes and revised counts of documents. Committing it joins the
changes with the counts on record, writes what changed for each document and the signed
change of every total, and publishes both by one rename. A batch that is published already
is left alone, so a commit may be repeated after any failure. Totals are sums over the
published deltas; nothing is ever recounted.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, piece_bpe
from .tables import Stash, load, python_ready

KEYS = ["source", "lang", "version"]
CHANGE = "op string, doc_id long, source string, lang string, version string, tokens long, seq long"
#: Published batches after which they are folded into one base.
COMPACT = 16
#: Counts the tokens of ``text``: takes rows of doc_id, source, lang and text, gives doc_id, source, lang and tokens.
Counter = Callable[[DataFrame], DataFrame]


#: What a worker's tasks of one version hand on to one another; only one version's is there at a time.
_kept: dict[str, object] = {}


def _only(version: str, memory: Callable[[], object]) -> object:
    """The version's chunk memory; those of other versions and their models go first, back to the system."""
    if version not in _kept:
        for held in (_kept, piece_bpe._models, packing._tokenizers):
            held.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)
        _kept[version] = memory()
        gc.freeze()  # the models' many small objects needn't be looked through again
    return _kept[version]


def _counter(version: str, memory: Callable[[], object], count: Callable[[pa.Array, object], np.ndarray]) -> Counter:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _only(version, memory)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(count(batch.column(3), held).astype(np.int64))], ["doc_id", "source", "lang", "tokens"])

    def counted(docs: DataFrame) -> DataFrame:
        python_ready(docs.sparkSession, 4000)
        return docs.select(F.col("doc_id").cast("long"), "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokens long")

    return counted


def versions() -> dict[str, Counter]:
    """The tokenizer versions of the query: the vocabularies that the encoding and packing operators use."""
    pieces, words = piece_bpe.model_path(), packing.tokenizer_path()
    return {
        "piece_bpe_32k": _counter("piece_bpe_32k", lambda: piece_bpe.memory_of(pieces, notes=False), piece_bpe.count_of),
        "word_bpe_49k": _counter("word_bpe_49k", lambda: packing.word_memory(words), packing.count_of),
    }


def by_pattern(pattern: str) -> Counter:
    """Counts matches of a pattern, for versions that are no more than that."""
    return lambda docs: docs.select("doc_id", "source", "lang", F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long").alias("tokens"))


STATE = "doc_id long, version string, source string, lang string, tokens long, live boolean, commit long"
DELTA = "source string, lang string, version string, docs long, tokens long"


class Rollup:
    """Totals in a folder that all executors share.

    Changes have the columns of CHANGE. ``insert`` and ``revise`` both set the count of a
    (doc_id, version) with its source and language; ``delete`` removes it, and does nothing
    where there is none. Of several changes of one key in a batch the one with the largest
    seq holds, then the largest tokens. Rows without a doc_id can't be found again: their
    inserts only add to totals. A null source, language or version is a group of its own; a
    null count is 0. An empty batch publishes no change. Other columns are ignored. One writer
    commits at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> dict[int, str]:
        """Published folders of a kind by number."""
        if not self._fs.exists(self._path(self.path)):
            return {}
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        return {int(n[len(kind) + 1 :].split("~")[0]): n for n in names if n.startswith(f"{kind}=")}

    def _publish(self, staged: str, name: str) -> None:
        """One rename; a name that is there already is refused, as some stores would move the folder into it."""
        source, target = self._path(staged), self._path(f"{self.path}/{name}")
        if self._fs.exists(target) or not self._fs.rename(source, target):
            self._fs.delete(source, True)
            raise OSError(f"{name} can't be published")

    def _read(self, part: str, schema: str) -> DataFrame:
        bases, batches = self._names("base"), self._names("batch")
        last = max(bases, default=0)
        names = [*([bases[last]] if bases else []), *(n for number, n in sorted(batches.items()) if number > last)]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}/{part}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def recorded(self) -> DataFrame:
        """The count on record of each live (doc_id, version)."""
        state = self._read("state", STATE)
        last = state.groupBy("doc_id", "version").agg(F.max(F.struct("commit", "live", "source", "lang", "tokens")).alias("now"))
        return last.where("now.live").select("doc_id", "version", "now.source", "now.lang", "now.tokens")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Publishes a batch; False if it was published before."""
        done, digest = self._names("batch"), hashlib.sha256(batch_id.encode()).hexdigest()[:32]
        if any(name.endswith(f"~{digest}") for name in done.values()):
            return False
        number = max(done, default=0) + 1
        changes = changes.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in CHANGE.split(", "))).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        # Written once, as the counts behind them may be costly and both the state and the totals need them.
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        changes.write.parquet(f"{staged}/changes")
        changes = self.spark.read.schema(changes.schema).parquet(f"{staged}/changes")
        found = changes.where("doc_id IS NOT NULL").groupBy("doc_id", "version").agg(F.max(F.struct("seq", "tokens", "op", "source", "lang")).alias("new"))
        old = self.recorded().select("doc_id", "version", F.struct("source", "lang", "tokens").alias("old"))
        both = found.join(old, found["doc_id"].eqNullSafe(old["doc_id"]) & found["version"].eqNullSafe(old["version"]), "left").select(found["doc_id"], found["version"], "new", "old")
        sets = F.col("new.op") != "delete"
        state = both.where(sets | F.col("old").isNotNull()).select(
            "doc_id", "version", "new.source", "new.lang", "new.tokens", sets.alias("live"), F.lit(number).cast("long").alias("commit"), "old"
        )
        state.write.parquet(f"{staged}/state")
        written = self.spark.read.schema(state.schema).parquet(f"{staged}/state")
        signed = [
            written.where("live").select(*KEYS, F.lit(1).alias("docs"), "tokens"),
            written.where("old IS NOT NULL").select("old.source", "old.lang", "version", F.lit(-1).alias("docs"), (-F.col("old.tokens")).alias("tokens")),
            changes.where("doc_id IS NULL AND op = 'insert'").select(*KEYS, F.lit(1).alias("docs"), "tokens"),
        ]
        delta = reduce(DataFrame.union, signed).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.where("docs <> 0 OR tokens <> 0").write.parquet(f"{staged}/delta")
        self._fs.delete(self._path(f"{staged}/changes"), True)
        self._publish(staged, f"batch={number:09d}~{digest}")
        if number - max(self._names("base"), default=0) >= COMPACT:
            self.compact()
        return True

    def compact(self) -> None:
        """Folds all published batches into a base; their folders stay as marks of what was committed, without their rows."""
        batches = self._names("batch")
        number = max(batches, default=0)
        if number <= max(self._names("base"), default=0):
            return
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        live = self.recorded().select("doc_id", "version", "source", "lang", "tokens", F.lit(True).alias("live"), F.lit(number).cast("long").alias("commit"))
        live.write.parquet(f"{staged}/state")
        self.totals().select(*KEYS, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")).write.parquet(f"{staged}/delta")
        self._publish(staged, f"base={number:09d}")
        for name in batches.values():
            for part in ("state", "delta"):
                self._fs.delete(self._path(f"{self.path}/{name}/{part}"), True)

    def totals(self, *keys: str) -> DataFrame:
        """Documents and tokens by any of source, lang and version (by default all three)."""
        keys = keys or tuple(KEYS)
        delta = self._read("delta", DELTA)
        return delta.groupBy(*keys).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


def changes_of(counted: DataFrame, op: str, version: str) -> DataFrame:
    """Rows of CHANGE for rows of doc_id, source, lang and, but for deletes, tokens."""
    tokens = F.col("tokens") if op != "delete" else F.lit(None)
    return counted.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(version).alias("version"), tokens.cast("long").alias("tokens"), F.lit(0).cast("long").alias("seq"))


def roll_up(docs: DataFrame, counters: Mapping[str, Counter], rollup: Rollup) -> DataFrame:
    """Totals after two batches for each version and one more.

    All documents come in under one version after the other, and those with a repeated line
    have their counts revised at once to what is left without the repeats, while the workers
    still hold the version's model; at last documents without a line of ten characters leave
    all versions. The revisions and the last batch are committed twice.
    """
    docs = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))  # a null text has no line
    lines = F.split("text", "\n")
    small = docs.where(~F.exists(lines, lambda x: F.length(x) >= 10))
    repeated = docs.where((F.size(F.array_distinct(lines)) < F.size(lines)) & F.exists(lines, lambda x: F.length(x) >= 10))
    once = repeated.withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    for version, count in counters.items():
        rollup.commit(f"load {version}", changes_of(count(docs), "insert", version))
        for _ in range(2):
            rollup.commit(f"drop repeated lines {version}", changes_of(count(once), "revise", version))
    for _ in range(2):
        rollup.commit("drop small", reduce(DataFrame.union, [changes_of(small, "delete", v) for v in counters]))
    return rollup.totals()


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after the batches of ``roll_up`` over all documents."""
    rollup = Rollup(spark, f"{Stash(spark, 'op6').root}/rollup")
    return roll_up(load(spark, sf_dir, "documents"), versions(), rollup)


#: The same rollup in SQL for two versions that are patterns: words, and letters or digits together and marks alone.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "parts-1": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
PATTERNS_SQL = r"""
WITH lines AS (
  SELECT source, lang, string_split(text, chr(10)) AS own FROM documents WHERE text IS NOT NULL
), live AS (
  SELECT source, lang, array_to_string(own, chr(10)) AS whole, own, list_distinct(own) AS once
  FROM lines WHERE len(list_filter(own, lambda x: length(x) >= 10)) > 0
), counted AS (
  SELECT source, lang, v.version,
    list_sum(list_transform(once, lambda x: len(regexp_extract_all(x, v.pattern)))) AS tokens
  FROM live, (VALUES ('words-1', '[^\x20\x09-\x0D]+'), ('parts-1', '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS v(version, pattern)
)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens
FROM counted GROUP BY source, lang, version
"""
