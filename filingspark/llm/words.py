"""Exact ids of a lower-casing, white-space-dropping BPE vocabulary, word by word.

No token of such a vocabulary spans white space and white space itself has no token, so a text's ids are those of its
words in order. A worker keeps the ids of the words that it met lately and solves a batch's new words together.
"""

from __future__ import annotations

import gc
import re
from functools import cached_property

from .prefix_bpe import SPACE, PrefixBPE, Recent, load
from .ragged import gather

_SPLIT = re.compile(f"[{SPACE}]+")
#: str.split() also divides at these four, the vocabulary's normalizer doesn't.
_MORE = re.compile("[\x1c-\x1f]")
#: How the vocabulary cuts a word into pieces (fixed value).
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Beyond this code point, the library itself normalizes and encodes a word.
_PLAIN = chr(0x24F)


def words_of(text: str) -> list[str]:
    return text.split() if _MORE.search(text) is None else [w for w in _SPLIT.split(text) if w]


class WordTable:
    """word -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str, size: int = 400_000):
        import regex

        self.path, self.bpe = path, PrefixBPE(path)
        self.tokenizer, self.cut = load(path), regex.compile(_PIECES).findall
        self.words, self.pieces = Recent(size), Recent(size)
        self.packed = {i: i.to_bytes(4, "little") for i in self.bpe.token}

    def forget(self) -> None:
        """What it remembers of texts; the vocabulary stays."""
        self.words, self.pieces = Recent(self.words.size), Recent(self.pieces.size)

    @cached_property
    def tokens(self) -> list[str]:
        """The text of each id."""
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def library(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, met: list[str]) -> list[bytes]:
        """The ids of each of the words; a "word" with rarer white space in it counts as several."""
        import unicodedata

        words = self.words
        words.age()
        self.pieces.age()
        new: dict[str, list[bytes]] = {}
        for word in words.unknown(set(met)):
            if word.isascii() and "<|" not in word and len(word) <= 256:
                low = word.lower()
            elif "<|" in word or len(word) > 256 or max(word) > _PLAIN:
                words[word] = b"".join(map(self.library, words_of(word)))
                continue
            else:
                low = "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
            new[word] = [low.encode()] if low.isalpha() else [p.encode() for p in self.cut(low)]
        pack, ids, pieces = self.packed, self.bpe.ids, self.pieces
        for piece, last, _, _ in self.bpe.solve(sorted(pieces.unknown({p for parts in new.values() for p in parts}))):
            pieces[piece] = b"".join([pack[i] for i in ids(piece, last)])
        for word, parts in new.items():
            words[word] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])

        return [words[w] for w in met]

    def encode(self, texts):
        """(ids, ends) of an Arrow string array without nulls: text i has ids[ends[i]:ends[i + 1]]."""
        import pyarrow.compute as pc

        return gather(pc.ascii_split_whitespace(texts), self, "<u4")

    def encode_one(self, text: str) -> bytes:
        return b"".join(self.learn(words_of(text)))


def without_cycles(run):
    """``run``, during which a Python worker doesn't search for reference cycles: its tables hold none, and looking for some in them takes longer than filling them. Before and after other tasks of the worker do, and the driver's process always does."""

    def quiet(batches):
        from pyspark import TaskContext

        inside = TaskContext.get() is not None
        if inside:
            gc.disable()
        try:
            yield from run(batches)
        finally:
            if inside:
                gc.enable()

    return quiet


_TABLES: dict[str, WordTable] = {}


def table(path: str, size: int) -> WordTable:
    """The worker's table for a vocabulary; it outlives the task where Spark reuses its Python workers."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path, size)
    return _TABLES[path]


def portions(texts, most: int = 16_000_000):
    """An Arrow string column in slices of about ``most`` bytes, or one text; null becomes empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield start, texts.slice(start, end - start)
        start = end
