"""Fill-in-middle by rotating blocks of a text in place.

A text is a run of units, words of ASCII letters or single other code points. Two cuts, drawn from a hash of the
doc_id, part it into prefix, middle and suffix. The sentinels are put before the three parts in one bytearray, and the
parts change places by rotations: a rotation is three reversals, of either block and then of both together. To restore
a text the rotation is undone in the same way and the sentinels go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .words import portions


@dataclass(frozen=True)
class Layout:
    """Sentinels before prefix, suffix and middle; the seed of the cuts; percents of texts that change, and of these the ones with the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 1
    changed: int = 90
    suffix_first: int = 20

    @property
    def sentinels(self) -> tuple[bytes, bytes, bytes]:
        return tuple(s.encode() for s in (self.prefix, self.suffix, self.middle))


def unit_starts(data: bytes):
    """The byte offsets at which units begin."""
    import numpy as np

    b = np.frombuffer(data, "u1")
    low = b | 0x20
    letter = (low >= 97) & (low <= 122)
    start = (b & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


def _length(data) -> int:
    """Code points of UTF-8 bytes."""
    import numpy as np

    return int(((np.frombuffer(data, "u1") & 0xC0) != 0x80).sum())


def _reverse(buffer, start: int, end: int) -> None:
    buffer[start:end] = buffer[start:end][::-1]


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """The blocks [start, middle) and [middle, end) of ``buffer`` change places."""
    _reverse(buffer, start, middle)
    _reverse(buffer, middle, end)
    _reverse(buffer, start, end)


def arrange(data: bytes, first: int, second: int, form: str, marks: tuple[bytes, bytes, bytes]) -> bytearray:
    """Prefix data[:first], middle data[first:second] and suffix, each after its sentinel, in the order of ``form``."""
    prefix, suffix, middle = marks
    buffer = bytearray(data)
    buffer[second:second] = suffix
    buffer[first:first] = middle
    buffer[0:0] = prefix
    m = len(prefix) + first
    s = m + len(middle) + second - first
    if form == "psm":
        rotate(buffer, m, s, len(buffer))
    else:
        rotate(buffer, 0, s, len(buffer))
    return buffer


def restore(data: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that ``arrange`` was given. Texts with a sentinel are plain, so each stands once."""
    if form == "plain":
        return bytes(data)
    prefix, suffix, middle = marks
    buffer = bytearray(data)
    if form == "psm":
        s = buffer.index(suffix)
        at = buffer.index(middle, s)
        rotate(buffer, s, at, len(buffer))
    else:
        rotate(buffer, 0, buffer.index(prefix), len(buffer))
    m = buffer.index(middle)
    del buffer[(s := buffer.index(suffix, m)) : s + len(suffix)]
    del buffer[m : m + len(middle)]
    del buffer[: len(prefix)]
    return bytes(buffer)


def _draws(doc_id: int, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(doc_id: int | None, text: bytes, layout: Layout):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    starts = unit_starts(text)
    n = len(starts)
    marks = layout.sentinels
    if not n or doc_id is None or any(m in text for m in marks):
        return n, "plain", None, None, text
    h1, h2, h3, h4 = _draws(doc_id, layout.seed)
    if h3 % 100 >= layout.changed:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < layout.suffix_first else "psm"
    first, second = (int(starts[c]) if c < n else len(text) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, form, _length(text[:first]), _length(text[first:second]), bytes(arrange(text, first, second, form, marks))


def fill_in_middle(docs: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``, in one pass without a shuffle.

    ``n`` counts the units; ``form`` is plain, psm or spm, the order of the parts in ``output``; lengths are code points,
    NULL where the form is plain. A null text counts as empty; empty texts, texts that hold a sentinel and rows without
    a doc_id, which draw no cuts, are plain. Rows of one doc_id draw alike. An empty table gives no rows, and other
    columns, of any name, are left out. A very long text is one bytearray in one worker.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, texts in portions(batch.column(1)):
                rows = [(i, *transformed(i, t.as_buffer().to_pybytes(), layout)) for i, t in zip(ids[start:], texts.cast(pa.large_binary()))]
                columns = [pa.array([r[c] for r in rows], k if c < 5 else pa.large_binary()) for c, k in enumerate(kinds)]
                columns[5] = columns[5].cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(formed: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``formed``, as ``fill_in_middle`` returns it, with ``restored``: the text rebuilt from output and form alone."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index
            forms = batch.column(at("form")).to_pylist()
            for start, outputs in portions(batch.column(at("output"))):
                texts = [restore(t.as_buffer().to_pybytes(), f, layout.sentinels) for f, t in zip(forms[start:], outputs.cast(pa.large_binary()))]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*part.schema.names, "restored"])

    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return formed.mapInArrow(run, f"{kinds}, restored string")
