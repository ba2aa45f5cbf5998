"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words, which any white space parts. A line goes if an earlier one, by doc_id and
line number, has a Jaccard similarity of at least 0.8 with it, whether that one goes itself or not. All lines with a
word take part. Lines without words, and those of rows without a doc_id, stay and take nothing away. Rows that repeat a
doc_id with other texts are documents of their own, in an order of their texts' hashes; rows that repeat it with the
same text lose the same lines.

Words are ordered by rarity: by the level (half a power of two) of their bucket's frequency, of 262,144 buckets,
then by hash; any common order gives the same result. Equal sets are one class, and only its first line looks for
partners. Sets of fewer than four words are similar only where they are equal, so the join leaves them out. Two sets
that are similar share a word of their prefixes. Pairs with such a word must pass the length filter, the positional
filter and a bitmap filter (each word flips one bit of its set's bitmap, so differing bits can't outnumber differing
words) inside the join, and then an exact count of their common words. So that a large group of near copies doesn't
give all its pairs, each class first meets only three earlier classes for each of three leads (hashes of words) that it
shares with them: the first, the last and the one with the fewest changed words; only classes not settled so meet all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import cut, discard, documents_of, numbered, small_side, text_parts

_BUCKETS = 1 << 18
_FEW = 64
#: An order of hashes that has little to do with their own.
_OTHER_ORDER = 0x2545F4914F6CDD1D
_BITS = ("b0", "b1")
#: Any white space but the blank and the line end: a complement in nested ranges, as most letters are in the first.
_RARE = r"[^\n -\x84[\xa1-\x{167f}[\x{1681}-\x{1fff}[\x{3001}-\x{10ffff}[\x00-\x08\x0e-\x1b\x86-\x9f\x{200b}-\x{2027}\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}]]]]]"


def _lowered(docs: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(doc_id, part, text): lower-cased, blanks for all white space but line ends."""
    texts = numbered(documents_of(docs).where("doc_id is not null and text is not null"), parts)
    low = texts.select("doc_id", "part", F.lower("text").alias("text"))
    return low.select("doc_id", "part", F.when(F.col("text").rlike(_RARE), F.regexp_replace("text", _RARE, " ")).otherwise(F.col("text")).alias("text"))


def _lines(lowered: DataFrame) -> DataFrame:
    """(doc_id, place, line): ``place`` packs the text's part and the line's number from 0."""
    lines = lowered.select("doc_id", "part", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.shiftleft("part", 32).bitwiseOR(F.col("line_no").cast("long")).alias("place"), "line")


def _hashes(line: Column) -> Column:
    """The different hashes of a line's words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def rarity(docs: DataFrame) -> bytes:
    """Each bucket's level of frequency, as a byte. At most 262,144 counts come to the driver, 512 in a row.

    Words count as they are written, between blanks and line ends: as any order of words will do, this spares a pass
    over all letters.
    """
    texts = documents_of(docs).where("doc_id is not null and text is not null")
    words = texts.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    # Eight buckets are counted in a row: so few groups fit the small table in front of Spark's hash aggregation.
    ids = words.select(F.xxhash64("w").bitwiseAND(F.lit(_BUCKETS - 1)).cast("int").alias("id"))
    counts = ids.groupBy(F.shiftright("id", 3).alias("at")).agg(*(F.count(F.when(F.col("id").bitwiseAND(F.lit(7)) == i, 1)).alias(f"n{i}") for i in range(8)))
    eight = F.array(*(F.coalesce(F.floor(2 * F.log2(F.greatest(F.col(f"n{i}"), F.lit(1)))).cast("int"), F.lit(0)) for i in range(8)))
    levels = bytearray(_BUCKETS)
    for run in counts.groupBy(F.shiftright("at", 6)).agg(F.collect_list(F.struct("at", eight.alias("levels"))).alias("eights")).toLocalIterator():
        for e in run.eights:
            levels[8 * e.at : 8 * e.at + 8] = bytes(e.levels)
    return bytes(levels)


def _parity(words: int, i: int) -> Column:
    """Of a bitmap of so many 64-bit words the ``i``-th: the bits that the keys which fall there flip."""
    flipped = "a ^ shiftleft(1L, cast(k & 63 as int))"
    return F.expr(f"aggregate(keys, 0L, (a, k) -> {flipped if words == 1 else f'if((k >> 6) & {words - 1} = {i}, {flipped}, a)'})")


def _leads(hashes: str) -> Column:
    a, z = F.array_min(hashes), F.array_max(hashes)
    other = F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_OTHER_ORDER)))
    least = F.array_min(other)
    return F.array(F.hash(a, F.array_min(F.array_remove(hashes, a))), F.hash(z, F.array_max(F.array_remove(hashes, z))), F.hash(least, F.array_min(F.array_remove(other, least))))


def signatures(docs: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(doc_id, place, n, h1, h2, prefix, leads, plain, b0, b1) of each line with a word; h1 and h2 tell the sets apart. Null and empty texts, lines without words and rows without a doc_id give none; an empty table gives no rows.

    ``leads`` are hashes of three pairs of words, which near copies mostly share: those of the smallest hashes, those of
    the largest, and those of the smallest in another order, so that one changed word seldom spoils two leads. ``plain`` is the level in the middle of the prefix: changed words
    make it lower.
    The prefix has 32-bit hashes: a collision adds a candidate pair, which the exact count rejects. The bitmap has 64
    bits, for more than 64 words 128, which fold to 64.
    """
    # Spark folds this into one array: to look a level up there takes less than half of what cutting a byte out of a string takes.
    levels, low = F.split(F.lit(",".join(map(str, rarity(docs)))), ",").cast("array<bigint>"), F.lit((1 << 56) - 1)
    level = lambda h: F.coalesce(F.get(levels, h.bitwiseAND(F.lit(_BUCKETS - 1)).cast("int")), F.lit(0).cast("long"))
    key = lambda h: F.shiftleft(level(h), 56).bitwiseOR(h.bitwiseAND(low))
    # The test is of the line: Spark would push one of the hashes below them and hash all words twice.
    lines = _lines(_lowered(docs, parts)).where(F.trim("line") != "").select("doc_id", "place", _hashes(F.col("line")).alias("hashes"))
    lines = lines.select("doc_id", "place", F.size("hashes").alias("n"), F.sort_array(F.transform("hashes", key)).alias("keys"), _leads("hashes").alias("leads"))
    n, prefix = F.col("n"), F.expr("slice(keys, 1, n - (4 * n + 4) div 5 + 1)")
    bits = [F.when(n <= _FEW, _parity(1, 0) if i == 0 else F.lit(0)).otherwise(_parity(2, i)) for i in range(2)]
    return lines.select(
        "doc_id",
        "place",
        "n",
        F.xxhash64("keys").alias("h1"),
        F.xxhash64(F.lit(1), "keys").alias("h2"),
        F.transform(prefix, lambda k: F.hash(k)).alias("prefix"),
        "leads",
        F.shiftright(F.get("keys", F.expr("(n - (4 * n + 4) div 5) div 2")), 56).cast("int").alias("plain"),
        *(b.cast("long").alias(c) for b, c in zip(bits, _BITS)),
    )


def _index(classes: DataFrame, prefix, done: Column, *more: str) -> DataFrame:
    """A row for each word of a class's prefix: (doc_id, place, b0, b1, at, word, more). ``at`` packs n, the word's position from 0, and ``done``, as this table is the largest that is shuffled."""
    rows = classes.select("doc_id", "place", "n", *_BITS, *more, done.cast("long").alias("done"), F.posexplode(prefix).alias("pos", "word"))
    at = F.expr("shiftleft(cast(n as long), 32) | shiftleft(cast(pos as long), 1) | done")
    # What is read from files counts as nullable, which makes the join's test slower; nothing is null here.
    sure = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*map(sure, ("doc_id", "place", *_BITS)), F.coalesce(at, F.lit(0)).alias("at"), sure("word"), *more)


def _sizes(a: str, b: str) -> tuple[Column, Column]:
    return tuple(F.shiftright(f"{side}.at", 32) for side in (a, b))


def _alike(a: str, b: str) -> Column:
    """The bitmap and length filters for two classes. They must share 4/9 of their n + m words, so a ninth of these may differ at most."""
    n, m = _sizes(a, b)
    x = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in _BITS]
    few = lambda differ: 9 * differ <= n + m
    narrow, wide = F.bit_count(x[0].bitwiseXOR(x[1])), F.bit_count(x[0]) + F.bit_count(x[1])
    return few(narrow) & (5 * n >= 4 * m) & (5 * m >= 4 * n) & ((n <= _FEW) | (m <= _FEW) | few(wide))


def _earlier(a: str, b: str) -> Column:
    return F.expr(f"{a}.doc_id < {b}.doc_id or ({a}.doc_id = {b}.doc_id and {a}.place < {b}.place)")


def _pairs(classes: DataFrame) -> DataFrame:
    """Pairs of classes (doc_a, place_a, doc_b, place_b), a before b and b not ``done``, that share a prefix word and pass all filters.

    ``x`` is the smaller set, or the earlier of two as large. A word that the two share first stands among its first
    ninth, or the words from there on would be too few; so only these rows of the index are asked with.
    """
    index = _index(classes, "prefix", F.coalesce("done", F.lit(0))).repartition("word")
    words = lambda side, n: n - F.shiftright(F.col(f"{side}.at").bitwiseAND(F.lit((1 << 32) - 1)), 1)
    # One exchange serves both sides: a test that can't be repeated stays above it, any other would go below.
    front = 9 * F.shiftright(F.col("at").bitwiseAND(F.lit((1 << 32) - 1)), 1) <= F.shiftright("at", 32)
    asked = index.where(F.when(F.monotonically_increasing_id() >= 0, front))
    x, y = asked.alias("x"), index.alias("y")
    n, m = _sizes("x", "y")
    earlier = _earlier("x", "y")
    open_ = lambda side: F.col(f"{side}.at").bitwiseAND(F.lit(1)) == 0
    fit = _alike("x", "y") & ((n < m) | (n == m) & earlier) & (9 * words("x", n) >= 4 * (n + m)) & (9 * words("y", m) >= 4 * (n + m))
    met = x.join(y, (F.col("x.word") == F.col("y.word")) & fit & F.when(earlier, open_("y")).otherwise(open_("x")))
    first = lambda c, a, b: F.when(earlier, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    ids = [first("doc_id", "x", "y").alias("doc_a"), first("place", "x", "y").alias("place_a"), first("doc_id", "y", "x").alias("doc_b"), first("place", "y", "x").alias("place_b")]
    return met.select(*ids).distinct()


def _sets(docs: DataFrame, parts: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """(doc_id, place, words) of the wanted lines; lines of repeated rows repeat. Documents without one are left before they are split."""
    some = documents_of(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    lines = _lines(_lowered(some, parts)).join(wanted, ["doc_id", "place"], "left_semi")
    return lines.select("doc_id", "place", _hashes(F.col("line")).alias("words"))


def _verified(sets_of: Callable[[DataFrame], DataFrame], pairs: DataFrame, broadcast_rows: int) -> DataFrame:
    """(doc_id, place) of the later lines of those pairs (doc_a, place_a, doc_b, place_b) whose words have a Jaccard similarity of 0.8 or more. Only their texts are read again."""
    wanted = cut(pairs.select(F.col("doc_a").alias("doc_id"), F.col("place_a").alias("place")).union(pairs.select("doc_b", "place_b")).distinct())
    sets = cut(sets_of(small_side(wanted, broadcast_rows)), wanted)
    one = sets.groupBy("doc_id", "place").agg(F.first("words").alias("words"))
    side = lambda s: one.select(F.col("doc_id").alias(f"doc_{s}"), F.col("place").alias(f"place_{s}"), F.col("words").alias(f"words_{s}"))
    both = pairs.join(side("a"), ["doc_a", "place_a"]).join(side("b"), ["doc_b", "place_b"])
    shared = F.size(F.array_intersect("words_a", "words_b"))
    near = both.where(9 * shared >= 4 * (F.size("words_a") + F.size("words_b")))
    return cut(near.select(F.col("doc_b").alias("doc_id"), F.col("place_b").alias("place")).distinct(), pairs, sets)


def matches(lines: DataFrame, sets_of: Callable[[DataFrame], DataFrame], broadcast_rows: int, likely: DataFrame | None = None) -> DataFrame:
    """(doc_id, place) of the rows of ``lines``, signatures, that have an earlier match; ``sets_of`` gives the words (doc_id, place, words) of wanted ones (doc_id, place).

    ``likely`` pairs (doc_a, place_a, doc_b, place_b), a before b, are verified beside the first ones, so that what they settle stays out of the join.
    """
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "place"))
    ranked = cut(lines.withColumn("again", rank > 1).drop("h1", "h2"))
    again = ranked.where("again").select("doc_id", "place")

    longer = ranked.where("not again and n >= 4")
    # Of the classes before one that share a lead with it, the first, the last and the plainest are tried.
    row = F.struct("doc_id", "place", *_BITS, "at")
    before = Window.partitionBy("word").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, -1)
    led = _index(longer, "leads", F.lit(0), "plain")
    met = led.select(row.alias("b"), F.first(row).over(before).alias("first"), F.last(row).over(before).alias("last"), F.max(F.struct("plain", row.alias("row"))).over(before).alias("plain"))
    met = met.where("first is not null").select("b", F.explode(F.array_distinct(F.array("first", "last", "plain.row"))).alias("a")).where(_earlier("a", "b") & _alike("a", "b"))
    ids = [F.col("a.doc_id").alias("doc_a"), F.col("a.place").alias("place_a"), F.col("b.doc_id").alias("doc_b"), F.col("b.place").alias("place_b")]
    pairs = met.select(*ids) if likely is None else met.select(*ids).union(likely)
    settled = _verified(sets_of, cut(pairs.distinct()), broadcast_rows)

    open_ = longer.join(small_side(settled, broadcast_rows).withColumn("done", F.lit(1)), ["doc_id", "place"], "left")
    pairs = cut(_pairs(open_))
    more = _verified(sets_of, pairs, broadcast_rows)
    found = cut(again.union(settled).union(more).distinct(), ranked, settled)
    discard(more)
    return found


def later_matches(docs: DataFrame, parts: DataFrame | None = None, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, part, line_no), line numbers from 0: the lines that go. ``parts`` of ``text_parts`` tells apart the texts of one doc_id; without it doc_ids don't repeat."""
    found = matches(signatures(docs, parts), lambda wanted: _sets(docs, parts, wanted), broadcast_rows)
    return found.select("doc_id", F.shiftright("place", 32).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line_no"))


def removed_lines(docs: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(doc_id, part, removed): the line numbers that go, for each text that loses any."""
    return later_matches(docs, parts).groupBy("doc_id", "part").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))


def _with_removed(docs: DataFrame, shown: Column) -> DataFrame:
    """(shown, doc_id, part, removed) for every row, by doc_id, in one shuffle; ``shown`` is made of ``text`` and the row's columns, the struct ``doc``, before that."""
    parts = text_parts(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return numbered(rows, parts).select(shown.alias("shown"), "doc_id", "part").join(removed_lines(docs, parts), ["doc_id", "part"], "left")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go; all rows and columns stay, null and empty texts and rows without a doc_id as they are. An empty table gives no rows. A very long text is split into its lines by one task."""
    kept = F.array_join(F.filter(F.split(F.col("shown.text").cast("string"), "\n"), lambda x, i: ~F.array_contains(F.col("removed"), i)), "\n")
    clean = F.when(F.col("removed").isNull(), F.col("shown.text")).otherwise(kept)
    return _with_removed(docs, F.col("doc")).select(*(clean.alias(c) if c == "text" else F.col(f"shown.`{c}`") for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for every row of ``docs``; a null text has no lines."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return _with_removed(documents_of(docs), n_lines).select("doc_id", F.col("shown").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))
