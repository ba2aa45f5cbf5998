"""Byte-pair encoding of short pieces by dynamic programming over prefixes, for many pieces at once.

A byte-pair encoding is the only sequence of tokens in which all neighbours are compatible (encoding the two joined
gives the two back). So the encoding of a prefix is the encoding of a shorter prefix and one token more: the one
that ends there and is compatible with the last token before it. Sorted pieces share the work on their common prefixes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

#: Unicode's White_Space property, which the vocabularies' own patterns use (fixed values).
SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_START = (1 << 17) - 1


def load(path: str):
    """The tokenizer in a .json file, with truncation and padding off and one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}


class PrefixBPE:
    """One vocabulary. A word-end mark, if it has one, belongs to a piece's last symbol."""

    def __init__(self, path: str, pairs: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        mark = self.mark = model.get("end_of_word_suffix") or ""

        def raw(token: str) -> tuple[bytes, bool]:
            ends = bool(mark) and token.endswith(mark)
            return bytes(of[c] for c in (token[: -len(mark)] if ends else token)), ends

        self.rank = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = i
        self.vocab: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        self.token: dict[int, tuple[bytes, bool]] = {}
        for text, i in model["vocab"].items():
            if text not in self.special:
                token, ends = self.token[i] = raw(text)
                (self.ending if ends else self.vocab)[token] = i
        self.last_of = self.ending if mark else self.vocab
        self.length = {i: len(t) for i, (t, _) in self.token.items()}
        self.longest = max(self.length.values())
        self.pairs: dict[int, bool] = {}
        self.most = pairs

    def merge(self, piece: bytes, ends: bool) -> list[tuple[bytes, bool]]:
        """The encoding by its definition, the pair of lowest rank first; for two joined tokens."""
        parts = [(piece[i : i + 1], ends and i == len(piece) - 1) for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            (a, _), (b, e) = parts[at : at + 2]
            parts[at : at + 2] = [(a + b, e)]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= self.most:
            self.pairs.clear()
        (x, ends), both = self.token[b], [self.token[b]]
        if a != _START:
            x, both = self.token[a][0] + x, [self.token[a], *both]
        known = self.pairs[a << 17 | b] = self.merge(x, ends) == both
        return known

    def solve(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
        """For each of the sorted pieces: at each of its prefixes the last token, the number of tokens, and that number's step (modulo 256). The lists change as the iterator goes on.

        Exactly one token fits at each end, so they may be tried in any order: first the one that the last token grows into, then the last symbol alone, then the rest, longest first.
        """
        vocab, last_of, pairs, longest, compatible, marked = self.vocab, self.last_of, self.pairs, self.longest, self.compatible, bool(self.mark)
        before, last, count, step, began = b"", [_START], [0], [0], [0]
        for piece in pieces:
            n, same = len(piece), 0
            for x, y in zip(before, piece):
                if x != y:
                    break
                same += 1
            if marked and n:  # the last place is another symbol than inside a longer piece
                same = min(same, len(before) - 1, n - 1) if before else 0
            del last[same + 1 :], count[same + 1 :], step[same + 1 :], began[same + 1 :]
            for end in range(same + 1, n + 1):
                known, grown = last_of if end == n else vocab, began[-1]
                for start in (grown, end - 1) if grown < end - 1 else (grown,):
                    token = known.get(piece[start:end])
                    if token is not None:
                        ok = pairs.get(last[start] << 17 | token)
                        if ok or (ok is None and compatible(last[start], token)):
                            break
                else:
                    for start in range(end - longest if end > longest else 0, end):
                        token = known.get(piece[start:end])
                        if token is not None:
                            ok = pairs.get(last[start] << 17 | token)
                            if ok or (ok is None and compatible(last[start], token)):
                                break
                    else:
                        raise ValueError("the vocabulary lacks a byte")
                last.append(token)
                step.append((count[start] + 1 - count[-1]) & 255)
                count.append(count[start] + 1)
                began.append(start)
            before = piece
            yield piece, last, count, step

    def ids(self, piece: bytes, last: list[int]) -> list[int]:
        """The whole encoding, from a solution's last tokens."""
        out, at, length = [], len(piece), self.length
        while at:
            out.append(token := last[at])
            at -= length[token]
        out.reverse()
        return out


class Recent(dict):
    """What a worker has met lately. Two generations of at most ``size`` entries bound the memory, whatever the input."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def unknown(self, keys: set) -> set:
        """The keys that aren't there; those from the older generation move to the newer one."""
        new = keys.difference(self)
        old = new.intersection(self.old)
        self.update(zip(old, map(self.old.__getitem__, old)))
        return new - old

    def age(self) -> None:
        """Between batches."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
