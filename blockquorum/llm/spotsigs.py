"""SpotSigs document fingerprints: chains of content words that follow frequent words.

Built from DataFrame functions only. Wherever one of the ``ANCHORS`` (very frequent function words) stands,
it and the next ``CHAIN`` content words among the ``SPAN`` words after it form a signature. A text's
fingerprint is the sorted set of its signatures' 32-bit hashes, as 8 hex digits each, so two fingerprints are
compared without the texts, by the Jaccard likeness of the sets. A likeness of ``t`` needs sets whose lengths
differ by a factor of ``1/t`` at most: sets are partitioned by length, only equal or neighbouring partitions
are compared, and a pair whose lengths rule it out is not intersected.

In a block of ``BLOCK`` words (from the text's start) without an anchor every word is one, so texts in other
languages and lists of rare words have signatures too. Edge cases: null texts count as empty; texts without
words have the empty fingerprint, which is like the empty one (1.0) and unlike any other (0.0); equal texts have
equal fingerprints; null ids sort first, and rows of one id are ordered by text; a table of one row is its
own next document; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from blockquorum.llm.common import components
from blockquorum.runtime import materialize

CHAIN = 3
SPAN = 12
BLOCK = 16
BUCKET_BYTES = 4_000_000  # of text that stand together while neighbours are found
POINTS = 256

#: Very frequent function words of four languages.
ANCHORS = (
    "the of and to in is that for it was with as on be by this are from or not "
    "le la les des et en un une du que qui dans pour est sur au pas ne ce il "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "el los las de y por con no una su para es al lo como más del se mi"
).split()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, span: int = SPAN) -> Column:
    """Sorted set of signature hashes of a text (null counts as empty)."""

    def chain_after(w: Column, i: Column, every: Column) -> Column:
        near = F.slice(every, i + 2, F.lit(span))
        content = F.slice(F.filter(near, lambda x: ~x.isin(anchors)), 1, chain)
        return F.shiftrightunsigned(F.xxhash64(w, F.array_join(content, " ")), 32)

    def spots(every: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int"))
        has_anchor = F.transform(blocks, lambda b: F.exists(F.slice(every, b * BLOCK + 1, F.lit(BLOCK)), lambda w: w.isin(anchors)))

        def marked(has: Column) -> Column:
            is_spot = lambda w, i: w.isin(anchors) | ~F.get(has, F.floor(i / BLOCK).cast("int"))
            return F.filter(F.transform(every, lambda w, i: F.when(is_spot(w, i), chain_after(w, i, every))), lambda h: h.isNotNull())

        return F.when(F.size(every) > 0, _let(has_anchor, marked)).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(_let(words(F.coalesce(text, F.lit(""))), spots)))


def as_text(sigs: Column) -> Column:
    """The fingerprint of a signature set."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets; 0.0 without intersecting them where their lengths keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = _let(F.size(F.array_intersect(a, b)).cast("double"), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, 1.0).when((small == 0) | (small < large * least), 0.0).otherwise(exact)


def length_part(size: Column, least: float) -> Column:
    """Partition of a set length: sets of likeness ``least`` or more are in equal or neighbouring ones."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / log(1 / least) + 1e-9)).otherwise(-1).cast("int")


def _buckets(docs: DataFrame) -> DataFrame:
    """``docs`` (key, h, text) with a ``bucket`` that rises with the key, of about BUCKET_BYTES each: quantiles
    of the key, of which each is cut into equal ranges."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    share = [k / POINTS for k in range(1, POINTS)]
    total, points = docs.agg(F.sum(size), F.percentile_approx("key", share, 20 * POINTS)).first()
    points = sorted(set(points or []))
    fine = max(1, round((total or 0) / BUCKET_BYTES / max(1, len(points) + 1)))
    if not points:
        return docs.withColumn("bucket", F.lit(0).cast("bigint"))
    if (total or 0) < POINTS * BUCKET_BYTES:  # fewer buckets than points: every k-th point
        keep = max(1, round(POINTS * BUCKET_BYTES / max(1, total)))
        points = points[keep - 1 :: keep] or points[:1]
    known = F.array(*[F.lit(p).cast("bigint") for p in points])
    coarse = F.size(F.filter(known, lambda p: p <= F.col("key")))
    lo, hi = F.get(known, F.col("coarse") - 1), F.get(known, F.col("coarse"))
    part = F.coalesce(F.floor((F.col("key") - lo).cast("double") * fine / (hi - lo).cast("double")), F.lit(0))
    spread = F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1)).cast("bigint")
    return docs.withColumn("coarse", coarse).withColumn("bucket", F.col("coarse") * fine + spread).drop("coarse")


def with_next(docs: DataFrame, derive: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(doc_id, text, next_text, and for each name in ``derive`` its column and next_<name>) by ascending doc_id;
    the last row's next is the first. Texts are shuffled once: each bucket also gets the first row of the
    next one, so no window holds more than a bucket."""
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    own = docs.select("doc_id", key.alias("key"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = _buckets(own)
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("first")).select("bucket", "first.key", "first.h")
    ordered = Window.orderBy("bucket")  # one row for each bucket
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("bucket").over(ordered), F.last("bucket").over(whole))
    firsts = materialize(firsts.select("key", "h", before.alias("before")), "firsts")
    places = F.array(F.struct(F.col("bucket"), F.lit(False).alias("halo")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("halo")))
    rows = dealt.join(firsts, ["key", "h"], "left").withColumn("place", F.explode(F.when(F.col("before").isNotNull(), places).otherwise(F.slice(places, 1, 1))))
    rows = rows.select("doc_id", "key", "h", "text", "place.bucket", "place.halo")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "bucket").select("*", *[f(F.col("text")).alias(name) for name, f in derive.items()])
    by = Window.partitionBy("bucket").orderBy("halo", "key", "h", "text")
    following = [F.lead(c).over(by).alias(f"next_{c}") for c in ("text", *derive)]
    return rows.select("doc_id", "text", *derive, "halo", *following).filter("not halo").drop("halo")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document against its edited text (the last quarter replaced by the start of the next document) and
    against the next document: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    found = with_next(docs.select("doc_id", "text"), {"sigs": signatures})
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter))
    found = found.select("doc_id", n.cast("bigint").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    made = F.struct(F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), signatures(F.col("edited")).alias("sigs"))
    found = found.select("doc_id", "n_chars", "sigs", "next_sigs", _let(made, lambda m: _compared(F.col("sigs"), F.col("next_sigs"), m)).alias("made"))
    return found.select("doc_id", "n_chars", "made.*")


def _compared(sigs: Column, next_sigs: Column, made: Column) -> Column:
    return F.struct(
        made["sha"].alias("edited_sha256"),
        as_text(sigs).alias("fingerprint"),
        as_text(made["sigs"]).alias("edited_fingerprint"),
        likeness(sigs, made["sigs"]).alias("near_edited"),
        likeness(sigs, next_sigs).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id): classes of documents linked by a likeness of ``least`` or more, named by the smallest id
    in them. Equal fingerprints are one set; sets meet over the signatures of their prefix (rare ones first, as
    many as ``least`` cannot do without) and in equal or neighbouring length partitions."""
    own = docs.select("doc_id", signatures(F.col("text")).alias("sigs"))
    own = materialize(own.withColumn("print", F.xxhash64("sigs")), "sigs")
    sets = own.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.first("sigs").alias("sigs"))
    sets = materialize(sets.withColumn("n", F.size("sigs")), "sets")
    exploded = sets.filter("n > 0").select("print", "n", F.explode("sigs").alias("sig"))
    often = exploded.groupBy("sig").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("print").orderBy("often", "sig"))
    prefix = exploded.join(often, "sig").withColumn("rank", rank)
    prefix = prefix.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("print", "sig", length_part(F.col("n"), least).alias("part"), "n")
    a = prefix.select(F.col("print").alias("a"), "sig", "part", F.col("n").alias("n_a"))
    b = prefix.select(F.col("print").alias("b"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), F.col("n").alias("n_b"))
    may = (F.col("a") != F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)
    pairs = a.join(b, ["sig", "part"]).filter(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = sets.select(F.col("print").alias("a"), F.col("sigs").alias("sigs_a"))
    right = sets.select(F.col("print").alias("b"), F.col("sigs").alias("sigs_b"))
    links = pairs.join(left, "a").join(right, "b").filter(likeness(F.col("sigs_a"), F.col("sigs_b"), least) >= least).select("a", "b")
    roots = components(links)
    named = sets.select("print", "least_id").join(roots, F.col("print") == F.col("node"), "left").select("print", F.coalesce("root", "print").alias("root"), "least_id")
    classes = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    return own.select("doc_id", "print").join(named.join(classes, "root").select("print", "class_id"), "print").select("doc_id", "class_id")
