"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the hash's top bits name its bin, and a bin keeps its smallest hash. An empty
bin borrows from a bin that isn't empty, in an order of its own (optimal densification: an independent order for
each empty bin, so that likeness stays unbiased and varies least). Of each bin the eight low bits are stored; likeness
is the share of equal bins, corrected for bins that are equal by chance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import cut, documents_of

BINS, LOW_BITS, WORDS = 128, 8, 5
_SHIFT = 64 - (BINS.bit_length() - 1)
_WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The 64-bit hashes of all shingles; of a shorter text, of its whole sequence of words; none without words."""
    split = F.split(F.btrim(text, F.lit(_WHITE)), f"[{_WHITE}]+")
    hashes = lambda w: F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(F.slice(w, i, words)))).when(w[0] != "", F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return let(split, hashes)


def _slot(h: Column) -> Column:
    return F.shiftright(h, _SHIFT).cast("int") + BINS // 2


def fingerprint(text: Column) -> Column:
    """Two hex digits a bin; an empty string without words. Equal texts have equal fingerprints."""

    def firsts(ordered):
        return F.filter(ordered, lambda x, i: (i == 0) | (_slot(x) != _slot(F.get(ordered, i - 1))))

    def spread(least):
        gap = lambda x, i: _slot(x) - F.when(i == 0, F.lit(-1)).otherwise(_slot(F.get(least, i - 1))) - 1
        nothing = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
        rows = F.transform(least, lambda x, i: F.concat(nothing(gap(x, i)), F.array(x)))
        return F.concat(F.flatten(rows), nothing(F.lit(BINS - 1) - _slot(F.element_at(least, -1))))

    def dense(least):
        order = lambda j, s: F.xxhash64(j, s).bitwiseAND(F.lit(-BINS)).bitwiseOR(s.cast("bigint"))
        lender = lambda j: F.array_min(F.transform(least, lambda x: order(j, _slot(x)))).bitwiseAND(F.lit(BINS - 1)).cast("int")
        fill = lambda bins: F.transform(bins, lambda v, j: F.coalesce(v, F.get(bins, lender(j))))
        return F.when(F.size(least) == BINS, least).otherwise(let(spread(least), fill))

    packed = lambda bins: F.lower(F.array_join(F.transform(bins, lambda v: F.right(F.lpad(F.hex(v), 16, "0"), F.lit(LOW_BITS // 4))), ""))
    whole = lambda least: F.when(F.size(least) == 0, F.lit("")).otherwise(packed(dense(least)))
    hashes = shingle_hashes(text)
    return let(F.sort_array(hashes), lambda ordered: let(firsts(ordered), lambda least: whole(least)))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprints, 0 to 1; 1 for two texts without words."""
    width, chance = LOW_BITS // 4, 2.0**-LOW_BITS
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * width + 1, F.lit(width)) == F.substring(b, i * width + 1, F.lit(width))))
    share = (equal / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), share))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs``, without a shuffle. Null texts count as empty; an empty table gives no rows."""
    return documents_of(docs).select("doc_id", fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, n_chars): the next larger doc_id, after the largest the smallest; n_chars is of the longest row.

    Ids are dealt to ranges, which are written so that they stay as they are; each is ordered by itself, and only the
    ranges' smallest ids, as many as there are partitions, are ordered together.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    ids = cut(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()))
    heads = ids.groupBy("range").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("range")
    after = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("following"))
    own = ids.withColumn("inside", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    return own.join(after, "range").select("doc_id", F.coalesce("inside", "following").alias("next_id"), "n_chars")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint against that of an edited text and that of the next document.

    Edited: the last floor(n_chars/4) code points give way to the first as many of the next document by doc_id. Where
    rows repeat a doc_id, the one that starts with the smallest text is the next document, for all rows before it. A
    row without a doc_id has no next document; an empty text stands in. Empty tables give no rows.
    """
    own = documents_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both joins read one exchange of the texts. Fingerprints come after it: expressions with lambdas keep Spark from
    # seeing that two exchanges are the same.
    known, lone = own.where("doc_id is not null"), own.where("doc_id is null")
    after = successors(own).withColumnRenamed("doc_id", "for_id")
    start = F.left("text", F.floor(F.col("n_chars") / 4).cast("int")).alias("start")
    lent = known.join(after, F.col("doc_id") == F.col("next_id")).select(F.col("for_id").alias("doc_id"), F.struct(start, fingerprint(F.col("text")).alias("print")).alias("lent"))
    lent = lent.groupBy("doc_id").agg(F.min("lent").alias("lent"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    both = known.join(lent, "doc_id", "left").unionByName(lone.withColumn("lent", F.lit(None).cast(lent.schema["lent"].dataType))).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.left("text", n - quarter), F.coalesce(F.left("lent.start", quarter), F.lit(""))).alias("edited"),
        fingerprint(F.col("text")).alias("fingerprint"),
        F.coalesce("lent.print", F.lit("")).alias("next_fingerprint"),
    )
    both = both.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return both.withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))})
