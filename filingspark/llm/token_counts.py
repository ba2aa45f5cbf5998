"""Token counts by prefix dynamic programming.

A byte-pair encoding is the only sequence of tokens in which all neighbours are compatible (encoding the two joined
gives the two back). So the encoding of a prefix is the encoding of a shorter prefix and one token more: the one
token that ends there and is compatible with the last token before it. Going from left to right, this gives the
exact count at every prefix, and truncation or budget questions need no further encoding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ._util import documents_of
from .prefix_bpe import SPACE, PrefixBPE, Recent, load
from .ragged import gather
from .words import portions, without_cycles

#: How the vocabulary cuts a text into pieces (fixed value); its white space is Unicode's.
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_RUN = re.compile(f"[{SPACE}]{{2,}}(?=[^{SPACE}])")
#: White space that isn't a single blank or line end.
_TWO = re.compile(f"[{SPACE}][{SPACE}]|[{SPACE.replace(' ', '').replace(chr(10), '')}]")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, prefix_counts binary"


class PrefixCounter:
    """Counts at every prefix for one byte-level vocabulary. A count is kept as its step from the prefix one code point shorter."""

    def __init__(self, path: str, size: int = 400_000):
        import regex

        self.bpe, self.tokenizer = PrefixBPE(path), load(path)
        self.pieces = regex.compile(_PIECES).findall
        self.special = list(self.bpe.special)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words, self.steps_of = Recent(size), Recent(size)

    def solve(self, pieces: set[str]) -> None:
        """Solve the pieces that aren't known yet. A contraction is one piece only once it is complete."""
        fresh = {p.encode(): p for p in self.steps_of.unknown(pieces)}
        for raw, _, count, step in self.bpe.solve(sorted(fresh)):
            piece = fresh[raw]
            if len(piece) < len(raw):
                at, ends = 0, [0]
                for c in piece:
                    ends.append(at := at + len(c.encode()))
                count = [count[i] for i in ends]
                self.steps_of[piece] = bytes([(b - a) & 255 for a, b in zip(count, count[1:])])
            elif piece in ("'re", "'ve", "'ll"):
                self.steps_of[piece] = bytes([1, 1, (count[3] - 2) & 255])
            else:
                self.steps_of[piece] = bytes(step[1:])

    def count(self, piece: str) -> int:
        self.solve({piece})
        return sum((x ^ 128) - 128 for x in self.steps_of[piece])

    def segment(self, text: str) -> bytes:
        """The steps of a text without special strings. A run of white space is one piece while it ends the prefix; a further code point splits its last one off."""
        self.solve(set(pieces := self.pieces(text)))
        steps = b"".join(map(self.steps_of.__getitem__, pieces))
        if _RUN.search(text) is not None:
            steps = bytearray(steps)
            for run in _RUN.finditer(text):
                more, at = self.count(run[0]) - self.count(run[0][:-1]) - self.count(run[0][-1]), run.end() - 1
                steps[at] = (steps[at] + more) & 0xFF
                steps[at + 1] = (steps[at + 1] - more) & 0xFF
        return bytes(steps)

    def learn(self, met: list[str]) -> list[bytes]:
        """The steps of each word: with the blank before it, or with a carriage return for the line end before it."""
        self.words.age()
        self.steps_of.age()
        words, steps_of = self.words, self.steps_of
        cut = {}
        for word in words.unknown(set(met)):
            plain = word[1:] if word[:1] == "\r" else word
            cut[word] = [plain] if plain[1:].isalpha() and (plain[0] == " " or plain[0].isalpha()) else self.pieces(plain)
        self.solve({p for parts in cut.values() for p in parts})
        for word, parts in cut.items():
            steps = steps_of[parts[0]] if len(parts) == 1 else b"".join([steps_of[p] for p in parts])
            words[word] = b"\x01" + steps if word[:1] == "\r" else steps
        return [words[w] for w in met]

    def steps(self, texts) -> list:
        """The steps of each text of an Arrow string array without nulls, as numpy arrays.

        With single blanks and line ends only, pieces never reach over them, and a blank belongs to the word after it.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        strings = texts.to_pylist()
        plain = [_TWO.search(t) is None and not any(s in t for s in self.special) for t in strings]
        some = texts.filter(pa.array(plain))
        words = pc.split_pattern(pc.replace_substring(pc.replace_substring(some, "\n", "\n\r"), " ", "\n "), "\n")
        values, ends = gather(words, self, "i1")
        rows = iter([values[a:b] for a, b in zip(ends, ends[1:])])
        return [next(rows) if ok else np.frombuffer(self.odd(t), "i1") for t, ok in zip(strings, plain)]

    def odd(self, text: str) -> bytes:
        """Special strings have one token; until one is complete, it is ordinary text."""
        out, before = [], ""
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2 == 0:
                out.append(self.segment(part))
                before = part
            else:
                count = lambda t: len(self.tokenizer.encode(t, add_special_tokens=False).ids)
                at = [n := count(before), *(count(before + part[:j]) for j in range(1, len(part))), n + 1]
                out.append(bytes([(b - a) & 0xFF for a, b in zip(at, at[1:])]))
        return b"".join(out)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_prefix_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and ``prefix_counts`` for every row of ``docs``: from one reading, without a shuffle.

    ``prefix_counts`` answers for any prefix (``unpack_counts``, ``count_at``, ``longest_prefix``). Null and empty
    texts have no tokens; repeated rows, ties and null ids give a row each; an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        c = counter(tokenizer_path)
        for batch in batches:
            sizes, tokens, packed = [], [], []
            for _, texts in portions(batch.column(1), 6_000_000):
                sizes += pc.binary_length(texts).to_pylist()
                for steps in c.steps(texts):
                    tokens.append(int(steps.sum(dtype="i8")))
                    packed.append(zlib.compress(steps.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefix_counts"])

    return documents_of(docs).mapInArrow(without_cycles(run), SCHEMA)


def unpack_counts(packed: bytes):
    """The counts at the prefixes of 0, 1, 2, ... code points, as a numpy array."""
    import numpy as np

    return np.concatenate([[0], np.cumsum(np.frombuffer(zlib.decompress(packed), "i1"), dtype="i8")])


def count_at(packed: Column, n_chars: Column) -> Column:
    """The exact number of tokens of the first ``n_chars`` code points (of all, if there are fewer)."""

    @F.pandas_udf("long")
    def at(p, n):
        import pandas as pd

        return pd.Series([None if x is None or pd.isna(k) else int((c := unpack_counts(x))[min(max(int(k), 0), len(c) - 1)]) for x, k in zip(p, n)], dtype="Int64")

    return at(packed, n_chars)


def longest_prefix(packed: Column, budget: Column) -> Column:
    """The most code points a prefix can have whose encoding has at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def most(p, n):
        import numpy as np
        import pandas as pd

        return pd.Series([None if x is None or pd.isna(k) else int(np.flatnonzero(unpack_counts(x) <= max(int(k), 0))[-1]) for x, k in zip(p, n)], dtype="Int64")

    return most(packed, budget)
