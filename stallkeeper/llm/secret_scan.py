r"""Secrets in whole texts, weighed by who owns them, with DataFrame functions only.

Patterns find candidates; their hashes are counted over the corpus by distinct repository
and owner. A candidate that several owners share is a copied example. One that a single
owner has in few repositories looks live; long mixed tokens of that sort become spans too,
though no pattern names them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Stash, load

#: Kind: (pattern, group that holds the secret, least characters of that group), in the order that breaks ties.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]{16,})", 1, 16),
}
#: A long run of key characters with a digit and a letter of each case: a candidate, not yet a span.
OWNED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])([A-Za-z0-9+/_-]{20,})"
#: From so many owners on, a candidate is a copied example; up to so many repositories, an owner's own looks live.
COPIED_OWNERS, LIVE_REPOSITORIES = 3, 4
#: The tables name no repositories, so an owner's documents are dealt to this many (a power of two) by the low bits of their ids.
REPOSITORIES = 64

#: Characters of the pieces that a text is cut into before spans are masked.
PIECE = 256

SPAN = "struct<start:int,end:int,ord:int,kind:string,secret:string>"


def scanned(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` over an array, in as many rounds as its size has binary digits.

    Each round takes in what lies 1, 2, 4, ... places before, so no array grows entry by entry. ``op`` gets null for what lies before the first.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(rounds, values, lambda done, k: F.transform(done, lambda x, i: op(x, F.get(done, i - F.pow(F.lit(2), k).cast("int")))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def spans_of(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind with code-point offsets.

    Splitting by the pattern gives the text between its matches, so running sums of lengths
    give where each match ends. Texts without a match skip the work.
    """
    whole, secret = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    sizes = F.zip_with(F.split(text, pattern), whole, lambda gap, one: F.struct(F.length(gap) + F.coalesce(F.length(one), F.lit(0)), F.length(one)))
    sizes = F.transform(F.filter(sizes, lambda s: s["col2"].isNotNull()), lambda s: F.struct(s["col1"].alias("step"), s["col2"].alias("length")))

    def of(parts: Column) -> Column:
        ends = scanned(F.transform(parts["sizes"], lambda s: s["step"]), lambda x, before: x + F.coalesce(before, F.lit(0)))
        found = F.transform(
            F.arrays_zip(ends.alias("end"), parts["sizes"].alias("size"), parts["secret"].alias("secret")),
            lambda m: F.struct((m["end"] - m["size"]["length"]).alias("start"), m["end"].alias("end"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), m["secret"].alias("secret")),
        )
        return F.filter(found, lambda s: F.length(s["secret"]) >= least)

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), bound(F.struct(sizes.alias("sizes"), secret.alias("secret")), of)).otherwise(none)


def free_of(spans: Column, base: Column) -> Column:
    """The spans that no base span meets: in one order by start, none before reaches them and the next one starts behind them."""
    def marks(own: bool) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("base"), s.alias("span"))

    marked = F.array_sort(F.concat(F.transform(base, marks(True)), F.transform(spans, marks(False))))

    def apart(row: Column) -> Column:
        reach = scanned(F.transform(row, lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.greatest)
        ahead = F.reverse(scanned(F.reverse(F.transform(row, lambda s: F.when(s["base"], s["start"]).otherwise(2**31 - 1))), F.least))
        lone = F.filter(F.arrays_zip(row.alias("one"), reach.alias("reach"), ahead.alias("ahead")), lambda z: ~z["one"]["base"] & (z["reach"] <= z["one"]["start"]) & (z["ahead"] >= z["one"]["end"]))
        return F.transform(lone, lambda z: z["one"]["span"])

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), bound(marked, apart)).otherwise(spans)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, keep: list[str], stash: Stash, owner: Column, repository: Column) -> DataFrame:
    """Candidates of every text: ``row`` (the kept columns), ``owner``, ``repository``, ``rid``, ``base`` and ``other`` spans in order.

    ``rid`` numbers the rows once written, so that repeated or null ids stay apart.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    made = docs.select(whole, F.coalesce("text", F.lit("")).alias("_text"), owner.alias("owner"), repository.alias("repository"))
    made = made.select(
        "row", "owner", "repository", F.monotonically_increasing_id().alias("rid"),
        *(spans_of(F.col("_text"), kind, i, *rule).alias(f"_{kind}") for i, (kind, rule) in enumerate(KINDS.items())),
        spans_of(F.col("_text"), "owned", len(KINDS), OWNED, 1, 20).alias("_owned"),
    )
    base = F.array_sort(F.concat(*(f"_{kind}" for kind in KINDS)))
    made = made.select("row", "owner", "repository", "rid", base.alias("base"), "_owned")
    # A token inside a base span is that span's.
    return stash.put("found", made.select("row", "owner", "repository", "rid", "base", free_of(F.col("_owned"), F.col("base")).alias("other")))


def ownership(found: DataFrame) -> DataFrame:
    """secret_hash with its distinct owners and repositories; copies are folded before they are shuffled."""
    seen = found.where((F.size("base") > 0) | (F.size("other") > 0)).select(
        "owner", "repository", F.explode(F.concat("base", "other")).alias("one")
    )
    return (
        seen.select(F.sha2(F.col("one.secret"), 256).alias("secret_hash"), "owner", "repository")
        .groupBy("secret_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
        .groupBy("secret_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
        .groupBy("secret_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"))
    )


def scan(docs: DataFrame, keep: list[str], stash: Stash, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """``row`` (the kept columns), ``base`` (all pattern spans), ``owned`` (spans that the method adds), ``copied``, ``live`` and ``hidden``.

    Spans are arrays of (start, end, ord, kind, secret) by start, in code points. ``copied``
    holds base spans whose secret at least COPIED_OWNERS owners have; ``live`` holds those
    that one owner has in LIVE_REPOSITORIES repositories at most, with all owned spans;
    ``hidden`` holds all spans but the copied ones. Work grows with a text's length and, but
    for sorting, with its spans.

    A null text is empty; a null owner or repository counts as one more. Rows with equal or
    null ids are scanned one by one. A document without candidates has five empty arrays.
    By default the owner is the source, and a repository one of REPOSITORIES shares of its
    documents. Other columns may have any names.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("doc_id").bitwiseAND(F.lit(REPOSITORIES - 1)) if repository is None else repository
    found = find(docs, keep, stash, owner, repository)
    owners = stash.put("owners", ownership(found))
    some = found.where((F.size("base") > 0) | (F.size("other") > 0)).select(
        "rid",
        F.explode(F.concat(F.transform("base", lambda s: F.struct(s.alias("span"), F.lit(True).alias("base"))), F.transform("other", lambda s: F.struct(s.alias("span"), F.lit(False).alias("base"))))).alias("one"),
    ).select("rid", "one.*", F.sha2(F.col("one.span.secret"), 256).alias("secret_hash"))
    weighed = some.join(owners, "secret_hash")
    own = (F.col("owners") == 1) & (F.col("repositories") <= LIVE_REPOSITORIES)
    picked = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("span"))))
    by_row = weighed.groupBy("rid").agg(
        picked(~F.col("base") & own).alias("owned"), picked(F.col("base") & (F.col("owners") >= COPIED_OWNERS)).alias("copied"), picked(own).alias("live"),
        picked(F.when(F.col("base"), F.col("owners") < COPIED_OWNERS).otherwise(own)).alias("hidden"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    return found.join(by_row, "rid", "left").select("row", "base", *(F.coalesce(c, none).alias(c) for c in ("owned", "copied", "live", "hidden")))


def redact(docs: DataFrame, stash: Stash, mark: str = "[secret]") -> DataFrame:
    """The documents with every candidate but copied examples replaced by ``mark`` and n_chars set anew.

    Takes and returns the columns of docs, whatever their names; a null text stays null.
    Overlapping spans are covered once.
    """
    found = scan(docs, docs.columns, stash)
    text = F.col("row.text")

    def masked(parts: Column) -> Column:
        at = lambda place: F.floor(place / PIECE).cast("int")

        def between(start: Column, end: Column) -> Column:
            near = F.array_join(F.slice(parts["pieces"], at(start) + 1, at(end) - at(start) + 1), "")
            return F.substring(near, start - at(start) * PIECE + 1, end - start)

        def shown(span: Column, i: Column) -> Column:
            before = F.coalesce(F.get(parts["reach"], i - 1), F.lit(0))
            return F.when(span["start"] >= before, F.concat(between(before, span["start"]), F.lit(mark))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(parts["hide"], shown), ""), between(F.element_at(parts["reach"], -1), F.length(text)))

    # Finding a place in a string reads all before it, so spans are cut from short pieces.
    reach = scanned(F.transform("hidden", lambda s: s["end"]), F.greatest)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = bound(F.struct(F.col("hidden").alias("hide"), reach.alias("reach"), pieces.alias("pieces")), masked)
    made = found.select("row", F.when(F.size("hidden") > 0, whole).alias("new"))
    changed = {"text": F.coalesce("new", "row.text"), "n_chars": F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(F.col("row.n_chars"))}
    return made.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document, with those that ownership adds and how many are copied or look live."""
    scanned = scan(load(spark, sf_dir, "documents"), ["doc_id"], Stash(spark, "op7"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "row.doc_id", *(count(kind) for kind in KINDS), F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.array_sort(F.concat("base", "owned"))).alias("spans"),
        F.size("copied").cast("long").alias("n_copied"), F.size("live").cast("long").alias("n_live"), F.size("owned").cast("long").alias("n_owned"),
    )
