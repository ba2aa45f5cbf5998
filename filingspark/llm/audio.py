"""Chroma audio fingerprints of a media column, and the alignment of recordings by them.

A recording's spectrum is folded into twelve pitch classes a frame. Filters over an integral image of these frames
compare neighbouring areas; sixteen of them, quantized to two bits each in Gray code, make one 32-bit integer a frame.
Two recordings align at the offset that most of their equal pairs of successive integers vote for, and the share of
differing bits there says how alike they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._util import cut

RATE, FRAME, HOP, WIDTH = 4000, 1024, 512, 16


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, classes, frames) of the sixteen filters, by rule: the kinds in turn, places and sizes spread."""
    return [(i % 4, (5 * i) % 9, 2 + (7 * i) % 3, 4 + (5 * i) % 13) for i in range(16)]


def chroma(pcm: bytes):
    """(frames, 12): the share of each pitch class in a frame's energy, zero where a frame is silent. 16-bit little-endian samples."""
    import numpy as np

    x = np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype("f4") / 32768
    if len(x) < FRAME:
        return np.zeros((0, 12), "f4")
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype("f4"), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = (hertz > 60) & (hertz < 1900)
    notes = np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12
    out = power[:, heard] @ (notes[:, None] == np.arange(12)).astype(power.dtype)
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-6, out / np.maximum(total, 1e-6), 0)


def fingerprint(pcm: bytes | None):
    """The packed integers, one for each place of a window of ``WIDTH`` frames; none for a null or shorter recording."""
    import numpy as np

    frames = chroma(pcm or b"")
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.zeros(0, "i4")
    sums = np.zeros((len(frames) + 1, 13))
    sums[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0, p0, t1, p1):
        return sums[at + t1, p1] - sums[at + t0, p1] - sums[at + t1, p0] + sums[at + t0, p0]

    out = np.zeros(n, "u4")
    gray = np.array([0, 1, 3, 2], "u4")
    for kind, p, classes, width in filters():
        q, t = min(12, p + classes), width
        if kind == 0:
            a, b = area(0, p, t, q), area(0, 0, t, 12) - area(0, p, t, q)
        elif kind == 1:
            a, b = area(0, p, t // 2, q), area(t // 2, p, t, q)
        elif kind == 2:
            m = (p + q) // 2
            a, b = area(0, p, t, m), area(0, m, t, q)
        else:
            third = max(1, t // 3)
            a, b = area(third, p, t - third, q), area(0, p, third, q) + area(t - third, p, t, q)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        out = out << np.uint32(2) | gray[np.searchsorted([-0.25, 0.0, 0.25], np.round(value, 5))]
    return out.view("i4")


def fingerprints(recordings: DataFrame, id_column: str, media_column: str, decode: Callable[[object], bytes | None] = bytes) -> DataFrame:
    """(id, fingerprint array<int>) for every row, without a shuffle. Null and short recordings have an empty one; repeated rows and null ids give a row each, an empty table none.

    ``decode`` makes 16-bit little-endian samples of a media value; one recording at a time is held decoded.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints = [fingerprint(decode(x) if x is not None else None).tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int32()))], ["id", "fingerprint"])

    return recordings.select(F.col(id_column).cast("long").alias("id"), F.col(media_column)).mapInArrow(run, "id long, fingerprint array<int>")


def bit_error(a: Column, b: Column, offset: Column) -> Column:
    """The share of differing bits where b, moved by ``offset`` places (b[i + offset] against a[i]), overlaps a."""
    begin, end = F.greatest(F.lit(0), -offset), F.least(F.size(a), F.size(b) - offset)
    differing = F.aggregate(F.sequence(begin, end - 1), F.lit(0), lambda s, i: s + F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i + offset))))
    return F.when(end > begin, differing / (32.0 * (end - begin)))


def align(prints: DataFrame, is_query: Column) -> DataFrame:
    """For every row of (id, fingerprint) n_codes, class_id, and a row for each query of another class it aligns with: query_id, offset, votes, bit_error, place.

    Rows with equal fingerprints are one class, named by its smallest id, and searched once; a query stands for its
    class, by its smallest id, and isn't aligned with that class itself, which class_id tells. Every class that shares
    two successive integers with a query aligns with it, at the offset with the most votes, then the longest overlap,
    then the smallest. ``place`` numbers a row's queries from 1: the most votes, then the lowest bit error, then the
    smallest id. Rows without an alignment have nulls there, rows with empty fingerprints among them. Repeated rows
    give their alignments each; null ids are searched but name no class unless nothing else does. Empty tables give no
    rows.
    """
    rows = cut(prints.select("id", "fingerprint", F.xxhash64("fingerprint").alias("h1"), F.xxhash64(F.lit(1), "fingerprint").alias("h2"), F.coalesce(is_query, F.lit(False)).alias("q")))
    classes = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.min(F.when(F.col("q"), F.col("id"))).alias("query_id"), F.min("fingerprint").alias("codes")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("codes") - 2), lambda i: F.struct(i.alias("at"), F.xxhash64(F.get("codes", i), F.get("codes", i + 1)).alias("key")))
    index = classes.where(F.size("codes") >= 2).select("h1", "h2", "query_id", F.size("codes").alias("n"), F.inline(pairs))
    asked = index.where("query_id is not null").select("key", F.col("query_id").alias("query"), F.col("at").alias("q_at"), F.col("n").alias("q_n"))
    met = index.join(asked, "key").where(~F.col("query_id").eqNullSafe(F.col("query")))
    votes = met.groupBy("h1", "h2", "query", "n", "q_n", (F.col("at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("votes"))
    overlap = F.least(F.col("q_n"), F.col("n") - F.col("offset")) - F.greatest(F.lit(0), -F.col("offset"))
    best = votes.groupBy("h1", "h2", "query").agg(F.max_by(F.struct("offset", "votes"), F.struct("votes", overlap, -F.col("offset"))).alias("v")).select("h1", "h2", "query", "v.*")
    codes = classes.select("h1", "h2", "codes")
    asked = classes.where("query_id is not null").select(F.col("query_id").alias("query"), F.col("codes").alias("q_codes"))
    measured = best.join(codes, ["h1", "h2"]).join(asked, "query").select("h1", "h2", F.col("query").alias("query_id"), F.col("offset").cast("long").alias("offset"), "votes", F.round(bit_error(F.col("q_codes"), F.col("codes"), F.col("offset")), 6).alias("bit_error"))
    measured = measured.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("votes"), "bit_error", "query_id")).cast("long"))
    found = classes.select("h1", "h2", "class_id").join(measured, ["h1", "h2"], "left")
    return rows.join(found, ["h1", "h2"]).select("id", "fingerprint", F.size("fingerprint").cast("long").alias("n_codes"), "class_id", "query_id", "offset", "votes", "bit_error", "place")


def sonify(vector: list[float] | None) -> bytes:
    """A recording of a vector: one note of 512 samples for each number, its pitch class by where the number falls among a normal variable's twelfths."""
    import math

    import numpy as np

    x = np.nan_to_num(np.array(vector or [], "f8"))
    spread = float(np.sqrt((x**2).mean())) if len(x) else 0.0
    rank = np.array([0.5 * (1 + math.erf(y / spread / math.sqrt(2))) if spread else 0.5 for y in x])
    return _tones()[np.minimum((12 * rank).astype(int), 11)].tobytes()


@cache
def _tones():
    import numpy as np

    t = np.arange(HOP) / RATE
    return np.stack([12000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) + 6000 * np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in range(12)]).astype("<i2")
