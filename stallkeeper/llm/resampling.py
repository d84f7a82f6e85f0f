"""Importance resampling by the ratio of two hashed n-gram models and Gumbel top-k, and a filter of what good documents lack.

``importance`` is the method. Every word and every pair of neighbouring words is hashed into
one of BUCKETS buckets. Two multinomial models over buckets generate texts: the raw one is
fitted on all texts, the target on those of labelled good documents, smoothed by mixing it
with the raw one. A document's log importance weight is log p_target - log p_raw, of either
sign, added over all its n-grams as often as they occur. A sample of ``size`` documents is drawn without
replacement in proportion to the weights: those with the largest log weight plus Gumbel noise
are kept.

Such sums over whole texts say how alike a text is to good ones, but a few words of abuse
hardly move them. ``resample`` and ``keep_good`` are a filter for those: their ratio is
never above 0 and counts documents by trait (words, words with how often they occur in the
text, in powers of two from four on, and how often a word follows itself). The target's
probability is the raw one unless its own counts say that it lacks the trait: the log ratio
of the counts is taken times the probability of that, from all texts or, if they say more,
from labelled bad ones as a contrast. By default they keep as many as a draw one by one would
be expected to take, each with the probability of its weight over the one that nearly all
held-out good documents exceed (one at most).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Stash, load, python_ready
from .textkit import LOWER, WHITE, Rolling, buffer_of, mix

#: Buckets of hashed n-grams (binary logarithm), and powers of two up to which occurrences in one text are told apart.
BITS, LEVELS = 20, 12
BUCKETS = 1 << BITS
#: Labelled rows that the target is fitted on at most, and as many for the contrast; drawn by hash.
LABELS = 100_000
#: One in so many of them sets the threshold instead, so that it holds for documents that the model hasn't seen.
HELD_OUT = 4
#: A trait that the target lacks has this share there of what is expected; the odds that one is so before its counts are seen.
LACKING, ODDS = 0.1, 1e-4
#: Share of held-out good documents whose weight may be below the reference weight, and the most that its logarithm can be.
LOSS, HIGHEST = 0.005, -2.0
#: Share of the target's own counts in its model; the raw model has the rest, so that an n-gram that the target happens to lack isn't impossible there.
MIXED = 0.1
BLOCK, SEED = 1 << 20, 1_729
COUNTED = ("raw", "target", "contrast")
_held: dict = {}


def _rolling() -> Rolling:
    if not _held:
        _held["one"] = Rolling(SEED)
    return _held["one"]


HASH = np.uint64(44)  # bits of a word's hash that tell words of one block apart; the rest numbers its texts
CLASSES = np.where(WHITE, 0, 2).astype(np.uint8)
for _first, _end in ((48, 58), (65, 91), (97, 123), (128, 256)):
    CLASSES[_first:_end] = 1


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every token in order. Tokens are runs of word bytes or of marks, in lower case."""
    data = LOWER[raw]
    kind = CLASSES[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(data))
    some = kind[starts] != 0
    starts, ends = starts[some], ends[some]
    rolling = _rolling()
    return mix(rolling.between(rolling.sums(data), starts, ends)), np.searchsorted(bounds, starts, side="right") - 1


def features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each occurrence of an n-gram, a token or two neighbouring ones of a text, and the number of them in each text."""
    words, of = _words(raw, bounds)
    together = of[1:] == of[:-1]
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[together]
    texts = np.concatenate([of, of[1:][together]])
    return (np.concatenate([words, pairs]) >> np.uint64(64 - BITS)).astype(np.int64), texts, np.bincount(texts, minlength=len(bounds) - 1)


def traits(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each distinct trait of each text, and the number of tokens of each text."""
    words, of = _words(raw, bounds)
    key, count = np.unique((of.astype(np.uint64) << HASH) | (words >> (np.uint64(64) - HASH)), return_counts=True)
    own, word = (key >> HASH).astype(np.int64), key & ((np.uint64(1) << HASH) - np.uint64(1))
    repeats = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=len(bounds) - 1)
    hashes, texts = [word << (np.uint64(64) - HASH)], [own]
    for level in range(LEVELS):
        often = count >= 1 << level if level > 1 else np.zeros(len(count), bool)
        again = np.flatnonzero(repeats >= 1 << level)
        hashes += [mix(word[often] + np.uint64(level << 50)), mix(np.full(len(again), (1 << 62) + level, np.uint64))]
        texts += [own[often], again]
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(texts), np.bincount(of, minlength=len(bounds) - 1)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, bounds = buffer_of(texts)
    first = 0
    while first < len(bounds) - 1:
        last = min(max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1), first + (1 << 19))
        yield first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def _counts(batches: Iterator[pa.RecordBatch], found: Callable) -> Iterator[pa.RecordBatch]:
    """One task's counts by bucket of what is ``found`` in all texts, good and bad ones, and in bucket -1 the numbers of texts."""
    counts, texts = np.zeros((3, BUCKETS), np.int64), np.zeros(3, np.int64)
    for batch in batches:
        good, bad = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (1, 2))
        texts += len(good), good.sum(), bad.sum()
        for first, last, raw, bounds in _blocks(batch.column(0)):
            bucket, of, _ = found(raw, bounds)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            for row, which in ((1, good), (2, bad)):
                counts[row] += np.bincount(bucket[which[first:last][of]], minlength=BUCKETS)
    some = np.flatnonzero(counts[0])
    for at in range(0, len(some), 100_000):
        part = some[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(c[part]) for c in counts)], ["bucket", *COUNTED])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([n]) for n in texts)], ["bucket", *COUNTED])


def _ratio(seen: Column, target: Column, share: float) -> Column:
    """Log ratio of a trait in ``target`` of the ``seen`` documents, of which ``share`` is the target: times the probability that the target lacks it."""
    if not 0 < share < 1:  # no other documents to compare with
        return F.lit(0.0)
    evidence = target * math.log(LACKING) + (seen - target) * math.log((1 - LACKING * share) / (1 - share))
    odds = F.exp(F.least(evidence, F.lit(500.0))) * ODDS
    return odds / (odds + 1) * F.least(F.lit(0.0), F.log((target + 0.5) / (seen * share + 0.5)))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(bucket, ratio): log p_target - log p_raw of an n-gram where six decimals of it aren't 0; without a target nowhere."""
    grams = counts.where("bucket >= 0")
    raw, target = (n or 0 for n in grams.agg(F.sum("raw"), F.sum("target")).first())
    ratio = F.log(F.col("target") / F.col("raw") * (MIXED * raw / target) + (1 - MIXED)) if target else F.lit(0.0)
    return grams.select("bucket", F.round(ratio, 6).cast("float").alias("ratio")).where("ratio <> 0")


def lack_ratios(counts: DataFrame) -> DataFrame:
    """(bucket, ratio) of a trait where six decimals of it aren't 0."""
    texts = counts.where("bucket < 0").agg(*(F.sum(c) for c in COUNTED)).first()
    everything, good, bad = (n or 0 for n in texts)
    raw, target, contrast = (F.col(c) for c in COUNTED)
    least = F.least(_ratio(raw, target, good / max(1, everything)), _ratio(target + contrast, target, good / max(1, good + bad)))
    return counts.where("bucket >= 0").select("bucket", F.round(least, 6).cast("float").alias("ratio")).where("ratio <> 0")


GOOD, BAD = "quality = 1 AND coalesce(toxic, 0) = 0", "quality = 0 OR toxic = 1"


def _by_id(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def _labelled(labels: DataFrame) -> DataFrame:
    """Ids of labelled good documents (every label says quality 1 and none says toxic), of which one in HELD_OUT is held out, and of bad ones (a label says quality 0 or toxic).

    At most LABELS of each, drawn by hash.
    """
    by_id = _by_id(labels)
    drawn = lambda which: by_id.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS)
    good = drawn(GOOD).select("doc_id", (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(HELD_OUT)) == 0).alias("held"), F.lit(False).alias("bad"))
    return good.unionByName(drawn(BAD).select("doc_id", F.lit(False).alias("held"), F.lit(True).alias("bad")))


def score(docs: DataFrame, labelled: DataFrame, stash: Stash, found: Callable, ratios_of: Callable) -> DataFrame:
    """Every document's doc_id, text_hash, n_features and log_ratio; held tells good ones that were held out.

    ``found`` gives buckets of texts and their numbers of features, ``ratios_of`` the ratios of counted buckets.
    """
    spark = docs.sparkSession
    python_ready(spark, 1000)
    # At most twice LABELS rows, so the broadcast is bounded.
    labelled = F.broadcast(stash.put("labelled", labelled))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(labelled, "doc_id", "left")
    bad = F.coalesce(F.col("bad"), F.lit(False))
    flagged = keyed.select("text", F.coalesce(~F.col("held") & ~F.col("bad"), F.lit(False)).alias("good"), bad.alias("bad"))
    counted = flagged.mapInArrow(lambda batches: _counts(batches, found), "bucket int, raw long, target long, contrast long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in COUNTED))
    # The number of buckets bounds what reaches the driver.
    model = ratios_of(stash.put("counts", counted)).toArrow()
    ratios = np.zeros(BUCKETS, np.float32)
    ratios[model["bucket"].to_numpy()] = model["ratio"].to_numpy()
    shared = spark.sparkContext.broadcast(ratios)
    del model, ratios

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            tokens, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for first, last, data, bounds in _blocks(batch.column(3)):
                bucket, of, count = found(data, bounds)
                tokens[first:last] = count
                total[first:last] = np.bincount(of, ratio[bucket], last - first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens), pa.array(np.round(total, 6))], ["doc_id", "text_hash", "held", "n_features", "log_ratio"])

    rows = keyed.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("held", F.lit(False)).alias("held"), "text")
    return stash.put("scores", rows.mapInArrow(rate, "doc_id long, text_hash long, held boolean, n_features long, log_ratio double"))


def kth_largest(values: DataFrame, column: str, k: int, few: int = 2000) -> float:
    """The k-th largest value, by counting in ever narrower ranges; ``few`` values at most come to the driver."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    inside, wanted = values, k
    while low < high:
        width = (high - low) / 1024
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(1023))
        counts = {r["place"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for at in sorted(counts, reverse=True):
            n, low, high = counts[at]
            if n >= wanted:
                break
            wanted -= n
        inside = inside.where((F.col(column) >= low) & (F.col(column) <= high))
        if n <= few:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[wanted - 1]
    return low


def gumbel(*key: Column) -> Column:
    """Standard Gumbel noise that depends on the key and seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def _draw(scored: DataFrame, stash: Stash) -> DataFrame:
    return stash.put("drawn", scored.withColumn("draw", F.col("log_ratio") + gumbel(F.col("doc_id"), F.col("text_hash"))))


def _sample(drawn: DataFrame, size: int) -> DataFrame:
    kept = F.col("draw") >= kth_largest(drawn, "draw", size) if size else F.lit(False)
    return drawn.select("doc_id", "text_hash", "n_features", "log_ratio", "draw", kept.alias("kept"))


def importance(docs: DataFrame, labels: DataFrame, stash: Stash, size: int | None = None) -> DataFrame:
    """Every document's doc_id, text_hash, n_features (n-grams), log_ratio (log importance weight), draw and kept.

    ``size`` is how many documents are wanted (all, if there are fewer), by default the share
    of good ones among all that are labelled good or bad, of all documents. The target is all
    labelled good documents; see ``_labelled`` for how many at most. Null and empty texts have
    no n-grams and a log weight of 0. Null ids are kept as they are and count as unlabelled.
    Equal rows get equal draws; all that tie with the last one kept are kept. Without a
    document labelled good every weight is 0 and all is kept, whatever the size. No rows give no rows.
    """
    good = _labelled(labels).where("NOT bad").withColumn("held", F.lit(False))
    drawn = _draw(score(docs, good, stash, features, log_ratios), stash)
    rows, target = stash.get("counts").where("bucket < 0").agg(F.sum("raw"), F.sum("target")).first()
    if size is None:
        share = _by_id(labels).where(f"({GOOD}) OR ({BAD})").agg(F.avg(F.expr(GOOD).cast("int"))).first()[0]
        size = round((rows or 0) * (share or 0))
    return _sample(drawn, min(size, rows or 0) if target else rows or 0)


def resample(docs: DataFrame, labels: DataFrame, stash: Stash, size: int | None = None) -> DataFrame:
    """Every document's doc_id, text_hash, n_features (tokens), log_ratio, draw and kept, by what good documents lack.

    ``size`` is how many documents are wanted; see above for the default. Null and empty
    texts have no traits and a log ratio of 0. Null ids are kept as they are and count as
    unlabelled. Equal rows get equal draws; all that tie with the last one kept are kept.
    Without good labels every ratio is 0 and all is kept. Documents may have several labels;
    see ``_labelled``. No rows give no rows.
    """
    scored = score(docs, _labelled(labels), stash, traits, lack_ratios)
    drawn = _draw(scored, stash)
    if size is None:
        limit = scored.where("held").agg(F.percentile_approx("log_ratio", LOSS, 100_000)).first()[0]
        reference = min(HIGHEST, HIGHEST if limit is None else limit)
        size = int(round(scored.agg(F.sum(F.exp(F.least(F.lit(0.0), F.col("log_ratio") - reference)))).first()[0] or 0))
    return _sample(drawn, size)


def keep_good(docs: DataFrame, labels: DataFrame, stash: Stash) -> DataFrame:
    """The documents that ``resample`` keeps, with all their columns, whatever their names."""
    gone = stash.put("rejected", resample(docs, labels, stash).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    stash.drop("labelled", "counts", "scores", "drawn")
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_hash")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own_id"), own)
    return keyed.join(gone, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_hash") == F.col("_hash")), "left_anti").select("row.*")


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log importance weight and draw, and whether the sample keeps it."""
    found = importance(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), Stash(spark, "op3"))
    return found.select("doc_id", "n_features", "log_ratio", "draw", "kept")
