"""Personal data: generators propose spans, boosted trees score those that no rule settles, thresholds choose. DataFrame functions only.

Spans that the base rules find stay. The other generators are looser; their proposals overlap each other and the base
spans. Trees on format and context, without the features that the base rules test, learn from all proposals which look
like base spans (a proposal over a base span of its kind counts as one). A proposal is added where the calibrated share
of positives is at least ``share`` and it overlaps no base span. What the trees learn from is the histogram of the
binned features over all documents, whose size is bounded by the number of bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import boosting
from ._util import cut, documents_of
from .oph import let

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: (kind, base rule or not, pattern). The patterns take runs possessively and start them only at a run's or the last
#: match's end, so that they are linear in the text and match what the plain patterns do.
GENERATORS = (
    ("email", True, rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"),
    ("card", True, r"[0-9](?:[ -]?[0-9])++"),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{{2,}}+)++"),
    ("ip", False, r"(?<![0-9])[0-9]{1,3}+(?: ?\. ?[0-9]{1,3}+){3}"),
    ("card", False, r"(?<![0-9])[0-9]{4}+(?:[ ./_-]{0,2}[0-9]){9,15}(?![0-9])"),
    ("phone", False, r"(?<![0-9])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
#: Every text with a match of the loose email pattern has one of this.
_AT = r"@|\(at\)|\[at\]| at  ?[A-Za-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2}"
_CLUE = r"(?i)\b(?:tel|phone|call|fax|mobile|mail|contact|card|visa|pay|account|ip|host|server|address)\b"
FEATURES = ("f_kind", "f_digits", "f_other", "f_groups", "f_dots", "f_left", "f_right", "f_clue")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    worth = lambda i: let(F.substring(F.reverse(digits), i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 0, twice(d)).otherwise(d))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits) == 0, F.lit(False)).otherwise(total % 10 == 0)


def holds(kind: Column, found: Column) -> Column:
    """The base rules' tests of what their patterns match."""
    digits = _digits(found)
    size = F.length(digits)
    small = F.forall(F.split(found, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", small)
        .when(kind == "card", F.when(size.between(13, 19), luhn(digits)).otherwise(False))
        .otherwise(size.between(9, 15))
    )


def _proposals(text: Column) -> Column:
    """Of each generator its matches, with the length of the text before each since the last one, and what stands around it."""

    def of(number: int, pattern: str) -> Column:
        def found(parts):
            around = lambda m, i: F.struct(
                F.lit(number).alias("generator"),
                i.alias("i"),
                F.length(F.get(parts, i)).alias("gap"),
                m.alias("found"),
                F.right(F.get(parts, i), F.lit(24)).alias("before"),
                F.left(F.get(parts, i + 1), F.lit(1)).alias("after"),
            )
            return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), around)

        return let(F.split(text, pattern, -1), found)

    empty = "array<struct<generator:int,i:int,gap:int,found:string,before:string,after:string>>"
    out = []
    for number, (kind, base, pattern) in enumerate(GENERATORS):
        clue = _AT if kind == "email" and not base else "@" if kind == "email" else r"\+[0-9]" if kind == "phone" and base else "[0-9]"
        out.append(F.when(text.rlike(clue), of(number, pattern)).otherwise(F.array().cast(empty)))
    return F.concat(*out)


def _class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\w"), 2).otherwise(3)


def proposals(docs: DataFrame) -> DataFrame:
    """All proposed spans (doc_id, h, kind, base, start, end, f_...): ``h`` tells apart texts of one doc_id. Offsets are code points."""
    h = F.xxhash64("text")
    raw = documents_of(docs).where(F.col("text").rlike(f"[0-9]|{_AT}")).select("doc_id", h.alias("h"), F.explode(_proposals(F.col("text"))).alias("p")).select("doc_id", "h", "p.*")
    raw = raw.dropDuplicates(["doc_id", "h", "generator", "i"])
    number = F.col("generator")
    kind = F.element_at(F.array(*(F.lit(k) for k, _, _ in GENERATORS)), number + 1)
    base = number < 4
    order = Window.partitionBy("doc_id", "h", "generator").orderBy("i")
    end = F.sum(F.col("gap") + F.length("found")).over(order).cast("long")
    found, digits = F.col("found"), F.length(_digits(F.col("found")))
    return raw.select(
        "doc_id",
        "h",
        kind.alias("kind"),
        (base & holds(kind, found)).alias("base"),
        (end - F.length("found")).alias("start"),
        end.alias("end"),
        F.when(kind == "email", 0).when(kind == "ip", 1).when(kind == "card", 2).otherwise(3).alias("f_kind"),
        F.when(digits < 7, F.least(digits, F.lit(1))).when(digits < 13, digits - 5).when(digits < 20, 8).otherwise(9).alias("f_digits"),
        F.least(F.length("found") - digits, F.lit(5)).alias("f_other"),
        F.least(F.size(F.split(found, "[^0-9]+")), F.lit(5)).alias("f_groups"),
        F.least(F.length(F.regexp_replace(found, r"[^.]", "")), F.lit(4)).alias("f_dots"),
        _class(F.right("before", F.lit(1))).alias("f_left"),
        _class(F.col("after")).alias("f_right"),
        F.col("before").rlike(_CLUE).cast("int").alias("f_clue"),
    )


def spans(docs: DataFrame, share: float = 0.9) -> DataFrame:
    """(doc_id, h, kind, start, end, base): the base rules' spans and those the trees add."""
    # Later spans are earlier ones of the opposite order: a frame that grows is kept up, one that shrinks is computed anew for each row.
    order = [F.asc, F.asc, F.asc, F.desc]
    names = ("start", "end", "kind", "base")
    part = Window.partitionBy("doc_id", "h")
    earlier = part.orderBy(*(f(c) for f, c in zip(order, names))).rowsBetween(Window.unboundedPreceding, -1)
    later = part.orderBy(*((F.asc if f is F.desc else F.desc)(c) for f, c in zip(order, names))).rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda test: F.coalesce(F.max(F.when(test, F.col("end"))).over(earlier), F.lit(-1))
    begins = lambda test: F.coalesce(F.min(F.when(test, F.col("start"))).over(later), F.lit(1 << 60))
    same = [F.max(F.when(F.col("base") & (F.col("kind") == k), F.col("end"))).over(earlier) for k in KINDS]
    next_ = [F.min(F.when(F.col("base") & (F.col("kind") == k), F.col("start"))).over(later) for k in KINDS]
    pick = lambda of, none: F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in zip(KINDS, of)), F.lit(none))
    seen = proposals(docs).withColumns({"on_base": (ends(F.col("base")) > F.col("start")) | (begins(F.col("base")) < F.col("end")), "like": F.col("base") | (pick(same, -1) > F.col("start")) | (pick(next_, 1 << 60) < F.col("end"))})
    seen = cut(seen)
    model, limits = train(seen, share)
    margin = boosting.expression(model, [F.col(f) for f in FEATURES])
    limit = F.element_at(F.array(*(F.lit(x) for x in limits)), F.col("f_kind") + 1)
    kept = seen.withColumn("added", ~F.col("base") & ~F.col("on_base") & (margin >= limit)).where("base or added")
    kept = kept.withColumn("free", F.col("base") | (ends(F.col("added")) <= F.col("start")))
    return kept.where("free").select("doc_id", "h", "kind", "start", "end", "base")


def train(seen: DataFrame, share: float):
    """The trees, and for each kind the margin from which on a proposal is taken.

    Margins are calibrated on texts that they weren't learnt from: of the two halves of all texts, by hash, each is
    scored by trees of the other one. Only the histogram of binned features comes to the driver: at most
    2*4*10*6*5*5*4*4*2 rows.
    """
    import numpy as np

    half = F.pmod(F.xxhash64("doc_id", "h", F.lit(5)), F.lit(2)).cast("int").alias("half")
    table = seen.groupBy(half, *FEATURES).agg(F.sum(F.col("like").cast("long")).alias("positive"), F.count("*").alias("total"))
    rows = sorted(tuple(r) for r in table.collect())
    data = np.array(rows, dtype=float).reshape(len(rows), len(FEATURES) + 3)
    halves, x, positive, total = data[:, 0], data[:, 1:-2], data[:, -2], data[:, -1]
    model = boosting.fit(x, positive, total)
    margin = np.zeros(len(rows))
    for k in (0, 1):
        if (own := halves == k).any():
            margin[own] = boosting.margins(boosting.fit(x[~own], positive[~own], total[~own]) if (~own).any() else model, x[own])
    return model, [boosting.threshold(margin[m], positive[m], total[m], share) if (m := x[:, 0] == k).any() else float("inf") for k in range(len(KINDS))]


def _listed(of: Column) -> Column:
    """Spans as kind:start:end, by kind as listed, then start."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(of, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, share: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans) for every row of ``docs``; the counts are of base spans.

    Null and empty texts have no spans. Repeated rows give a row each, also with a null doc_id. Only the spans are
    shuffled, never a text. Empty tables give no rows.
    """
    each = F.struct("kind", "start", "end")
    found = spans(docs, share).groupBy("doc_id", "h").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS),
        F.collect_list(F.when(F.col("base"), each)).alias("base_spans"),
        F.collect_list(each).alias("spans"),
    )
    rows = documents_of(docs).select("doc_id", F.xxhash64("text").alias("h")).alias("d")
    joined = rows.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return joined.select("d.doc_id", *(F.coalesce(f"f.n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS), _listed(F.coalesce("f.base_spans", nothing)).alias("base_spans"), _listed(F.coalesce("f.spans", nothing)).alias("spans"))


def redact(docs: DataFrame, share: float = 0.9) -> DataFrame:
    """``docs`` with each span's text replaced by its kind, as in [EMAIL]; of overlapping base spans, the whole stretch by the first one's. All columns stay, whatever their names; a null text stays null.

    Rows that repeat are each redacted, also those without a doc_id. An empty table gives no rows. The texts meet their
    spans by doc_id, in one shuffle.
    """
    order = Window.partitionBy("doc_id", "h").orderBy("start", "end", "kind")
    past = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretch = spans(docs, share).withColumn("new", (F.col("start") >= past).cast("int")).withColumn("n", F.sum("new").over(order))
    stretch = stretch.groupBy("doc_id", "h", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    found = stretch.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("s")).alias("f")
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h")).alias("d")
    joined = rows.join(found, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    text = F.col("d.doc.text").cast("string")
    upto = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("f.s"), i - 1)["end"]).cast("int")
    pieces = F.transform(F.col("f.s"), lambda s, i: F.concat(F.substring(text, upto(i) + 1, s["start"].cast("int") - upto(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substring(text, F.element_at(F.col("f.s"), -1)["end"].cast("int") + 1, F.length(text))
    clean = F.when(F.col("f.s").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return joined.select(*(clean.alias(c) if c == "text" else F.col(f"d.doc.`{c}`") for c in docs.columns))
