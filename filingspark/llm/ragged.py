"""Look-ups of many short words at once: each distinct word of a batch once, then one gather for all of them."""

from __future__ import annotations


def gather(words, table, dtype: str):
    """(values, ends) for an Arrow list array of words: row i's values, word after word, are values[ends[i]:ends[i + 1]].

    ``table`` has a word's values as bytes; ``table.learn(words)`` is called with the distinct words first.
    """
    import numpy as np

    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    found = table.learn(distinct)
    stored = np.frombuffer(b"".join(found), dtype)
    sizes = np.fromiter(map(len, found), "i4", len(found)) // np.dtype(dtype).itemsize
    begins = np.cumsum(sizes, dtype="i4") - sizes
    size = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(size, dtype="i8")])
    at = np.repeat((begins[codes] - ends[:-1]).astype("i4"), size)
    at += np.arange(len(at), dtype="i4")
    offsets = words.offsets.to_numpy()
    return stored[at], ends[offsets - offsets[0]]
