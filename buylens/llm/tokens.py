"""Texts to token ids with a public tokenizer that lower-cases, drops white space and breaks letters from marks.

White space never becomes part of a token, so a text's ids are those of its parts between spaces and line feeds. Arrow splits a batch and finds its
distinct parts. A part of plain Latin letters and closing marks has the ids of the lower-case word and of the marks, so its word goes to the library's model
directly; every other part takes the library's whole way. Words repeat, so each Python worker keeps the ids of those its tasks have met, up to a bound.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

KNOWN = 500_000
#: Ids, places and parts of a text take some twenty times its space while a batch is encoded.
ENCODED_BYTES = 1 << 19
LONGEST_KEPT = 48
#: Letters below U+0100 whose lower case and normal form are one letter.
_LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Marks that stay together and that no letter before them joins: all of ASCII but the apostrophe, which begins endings such as 's.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_ENDING = "(?P<m>[" + re.escape(_MARKS) + "]+)$"
#: Byte-level alphabet for letters from U+0080 to U+00FF: each UTF-8 byte as a printable character.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_LETTERS = {c: "".join(chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)) for b in chr(c).encode()) for c in range(128, 256)}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _strings(array: pa.Array) -> list[str]:
    """The values of an array without nulls; several times as fast as ``to_pylist``."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        for probe in ("Straße,", "ÀÉ!", "Word", "a$$$", "b."):
            word = re.match(r"\w+", probe)[0]
            if self._word(word.lower()) + self._whole(probe[len(word):]) != self._whole(probe) or self._whole(f" {probe}\n{probe}") != 2 * self._whole(probe):
                raise ValueError("this tokenizer does not split texts at white space and marks")

    def _whole(self, part: str) -> bytes:
        return _pack(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        return _pack([t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(_LETTERS))])

    def _words(self, words: list[str]) -> list[bytes]:
        out = [self.words.get(w) for w in words]
        new = {w: self._word(w) for w, ids in zip(words, out, strict=True) if ids is None}
        if len(self.words) + len(new) > KNOWN:
            self.words.clear()
        room = KNOWN - len(self.words)
        self.words.update((w, ids) for _, (w, ids) in zip(range(room), new.items(), strict=False) if len(w) <= LONGEST_KEPT)
        return [new[w] if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _after(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._whole(marks)
            if len(self.marks) < KNOWN and len(marks) <= LONGEST_KEPT:
                self.marks[marks] = ids
        return ids

    def _parts(self, parts: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Pieces of ids, and the numbers of the two pieces (stem, marks) of each of a batch's distinct parts."""
        stems = pc.utf8_rtrim(parts, _MARKS)
        plain = pc.match_substring_regex(stems, _LATIN)
        words = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        pieces = [b"", *self._words(_strings(words.dictionary))]
        numbers = np.zeros((len(parts), 2), dtype=np.int64)
        fits = plain.to_numpy(zero_copy_only=False)
        numbers[fits, 0] = words.indices.to_numpy() + 1
        others = np.flatnonzero(~fits)
        numbers[others, 0] = len(pieces) + np.arange(len(others))
        pieces += [self._whole(part) if part else b"" for part in _strings(parts.take(pa.array(others)))]
        marked = np.flatnonzero(fits & (pc.binary_length(parts).to_numpy() > pc.binary_length(stems).to_numpy()))
        ends = pc.extract_regex(parts.take(pa.array(marked)), _ENDING).field("m").dictionary_encode()
        numbers[marked, 1] = len(pieces) + ends.indices.to_numpy()
        pieces += [self._after(m) for m in _strings(ends.dictionary)]
        return pieces, numbers

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a small batch; null is empty."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        parts = lists.flatten().dictionary_encode()
        pieces, numbers = self._parts(parts.dictionary)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
        flat, first = np.frombuffer(b"".join(pieces), dtype="<u4"), np.cumsum(sizes) - sizes
        number = numbers[parts.indices.to_numpy()].ravel()
        size = sizes[number]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        # every id's place in ``flat``: its piece's first place plus its number in the piece
        joined = flat[np.repeat(first[number] - (ends - size), size) + np.arange(total)]
        at = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int64)
        bounds = np.concatenate([[0], ends])[2 * (at - at[0])]
        return [joined[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=1)
def shared_encoder(kind: type[Encoder], path: str) -> Encoder:
    """The encoder of this Python worker, whose tasks run one after the other."""
    return kind(path)
