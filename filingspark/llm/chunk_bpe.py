"""BPE encoding and decoding with content-defined chunks.

A rolling hash over the last 32 bytes cuts each text where its value has nine zero bits, so equal passages of
different documents fall into equal chunks, wherever they stand. A worker encodes each chunk that it meets once. The
word that a cut runs through belongs to no chunk: it is encoded anew, and the seam is accepted once encoding it
together with the words on both sides gives the ids that stand there; otherwise the whole document is encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ._util import documents_of
from .prefix_bpe import SPACE, Recent
from .words import WordTable, portions, without_cycles

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
_BODY = re.compile(f"[{SPACE}].*[{SPACE}]|[{SPACE}]", re.S)
_WINDOW, _BITS = 32, 9


def cuts(buf, starts):
    """The places in a byte buffer of several texts before which a chunk begins, the texts' starts included.

    A byte's value is fixed (a multiplicative hash of it), so that all workers cut alike. No cut depends on another text.
    """
    import numpy as np

    spread = (np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype("u4")
    h, width = spread[buf], 1
    while width < _WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    at = np.flatnonzero((h >> np.uint32(32 - _BITS)) == 0) + 1
    at = at[at < len(buf)]
    at = at[(buf[at] & 0xC0) != 0x80]
    owner = np.searchsorted(starts, at, "right") - 1
    return np.unique(np.concatenate([starts, at[at - starts[owner] >= _WINDOW]]))


class ChunkEncoder:
    def __init__(self, path: str, chunks: int = 20_000, seams: int = 40_000):
        self.words = WordTable(path, 160_000)
        self.chunks, self.seams = Recent(chunks), Recent(seams)

    def learn(self, keys: list[bytes]) -> None:
        """A chunk is (head, ids, tail, text): the ids between its first and last white space; ids is None if it has none."""
        import pyarrow as pa

        new = list(self.chunks.unknown(set(keys)))
        texts = [k.decode() for k in new]
        found = [_BODY.search(t) for t in texts]
        bodies = [m[0] if m else "" for m in found]
        ids, ends = self.words.encode(pa.array(bodies, pa.large_string()))
        for i, (key, text, m) in enumerate(zip(new, texts, found)):
            self.chunks[key] = (text[: m.start()], ids[ends[i] : ends[i + 1]].tobytes(), text[m.end() :], text) if m else (text, None, "", text)

    def repair(self, seams: set[tuple[str, str, str]]) -> None:
        """seams: the words before, at and after a cut; the ids of the one at it, or None if they don't agree with the library's."""
        new = list(self.seams.unknown(seams))
        ids = self.words.learn([w for seam in new for w in seam])
        for i, seam in enumerate(new):
            before, at, after = ids[3 * i : 3 * i + 3]
            self.seams[seam] = at if self.words.library(" ".join(seam)) == before + at + after else None

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow large-string array without nulls."""
        import numpy as np

        offsets = np.frombuffer(texts.buffers()[1], "i8", len(texts) + 1, 8 * texts.offset)
        raw = texts.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
        offsets = offsets - offsets[0]
        full = np.unique(offsets[:-1][offsets[1:] > offsets[:-1]])
        places = [*cuts(np.frombuffer(raw, "u1"), full).tolist(), len(raw)] if raw else [0]
        self.chunks.age()
        self.seams.age()
        keys = [raw[a:b] for a, b in zip(places, places[1:])]
        self.learn(keys)
        docs, seams, k = [], set(), 0
        for end in offsets[1:].tolist():
            parts, open_, before = [], [], ""
            while places[k] < end:
                head, ids, tail, text = self.chunks[keys[k]]
                open_.append(head)
                if ids is not None:
                    words = text.split(None, 2)
                    after = words[1 if head else 0] if len(words) > (2 if head else 1) else ""
                    parts.append(seam := (before, "".join(open_), after))
                    seams.add(seam)
                    parts.append(ids)
                    words = text.rsplit(None, 2)
                    before = words[-2 if tail else -1] if len(words) > (2 if tail else 1) else ""
                    open_ = [tail]
                k += 1
            parts.append(seam := (before, "".join(open_), ""))
            seams.add(seam)
            docs.append(parts)
        self.repair(seams)
        out = []
        for i, parts in enumerate(docs):
            ids = [self.seams[p] if type(p) is tuple else p for p in parts]
            out.append(self.words.library(texts[i].as_py()) if None in ids else b"".join(ids))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ``ids`` (little-endian uint32) and ``decoded`` for every row of ``docs``, without a shuffle.

    The ids are those of the tokenizers library without added special tokens; ``decoded`` is its decoding of them with
    special tokens kept. Null and empty texts have no ids and decode to an empty text; repeated rows and null ids give
    a row each; an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = ChunkEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        tokens = np.array(encoder.words.tokens, dtype=object)
        for batch in batches:
            for start, texts in portions(batch.column(1), 6_000_000):
                ids = encoder.encode(texts)
                decoded = [" ".join(tokens[np.frombuffer(x, "<u4")].tolist()) for x in ids]
                columns = [batch.column(0).slice(start, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return documents_of(docs).mapInArrow(without_cycles(run), SCHEMA)
