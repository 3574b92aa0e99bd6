"""Splitting text into the pieces that byte-level BPE merges within, over flat arrays.

The split is the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
boundaries follow from where the class of the character changes, so they are found for all
texts of a slice at once.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from scholia.llm.common import Texts, span_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Pieces kept between slices of a task; beyond that the memory of pieces starts anew.
KEPT_PIECES = 200_000


@lru_cache(1)
def character_classes() -> np.ndarray:
    import regex

    points = np.r_[0:0xD800, 0xE000:0x110000]
    every = "".join(map(chr, points))
    classes = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            classes[points[found.start() : found.end()]] = kind
    return classes


class Pieces(NamedTuple):
    """Byte spans of the pieces; pieces first[k] to first[k + 1] are of text k."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def _special_spans(data: bytes, offsets: np.ndarray, specials: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Leftmost occurrences of special strings that lie within one text."""
    spans, at = [], 0
    while specials:
        found = min(((data.find(s, at), -len(s)) for s in specials if data.find(s, at) >= 0), default=None)
        if found is None:
            break
        begin, end = found[0], found[0] - found[1]
        if offsets[np.searchsorted(offsets, begin, "right")] >= end:
            spans.append((begin, end))
            at = end
        else:
            at = begin + 1
    return spans


def split(texts: Texts, specials: tuple[bytes, ...] = ()) -> Pieces:
    data, offsets = texts
    if not len(data):
        none = np.zeros(0, np.int64)
        return Pieces(none, none, np.zeros(len(offsets), np.int64))
    raw = data.tobytes()
    spans = _special_spans(raw, offsets, specials)
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    breaks = np.unique(np.concatenate([offsets, *[np.array(s) for s in spans]])) if spans else offsets
    hard = np.zeros(len(points) + 1, bool)
    hard[np.searchsorted(byte_at, breaks)] = True

    kinds = character_classes()[points]
    blank = points == 0x20
    begins = hard[:-1].copy()
    begins[1:] |= kinds[1:] != kinds[:-1]
    run_start = np.flatnonzero(begins)
    run_end = np.append(run_start[1:], len(points))
    kind, length, last = kinds[run_start], run_end - run_start, hard[run_end]
    after_blank = np.zeros(len(run_start), bool)
    after_blank[1:] = blank[run_start[1:] - 1] & ~hard[run_start[1:]]

    is_piece = np.zeros(len(points) + 1, bool)
    word = kind != SPACE
    is_piece[run_start[word] - after_blank[word]] = True
    space = ~word
    whole = space & (last | (length >= 2))
    is_piece[run_start[whole]] = True
    tail = run_end[space & ~last] - 1
    is_piece[tail[~blank[tail]]] = True

    # 's 't 'm 'd 're 've 'll after a lone apostrophe that no blank joins
    lone = (kind == OTHER) & (length == 1) & (points[run_start] == 39) & ~after_blank & ~last
    lone[-1] = False
    k = np.flatnonzero(lone)
    k = k[kind[k + 1] == LETTER] if len(k) else k
    if len(k):
        a, long = run_start[k + 1], length[k + 1] >= 2
        x, y = points[a], np.where(long, points[np.minimum(a + 1, len(points) - 1)], 0)
        one = np.isin(x, [115, 116, 109, 100])
        two = long & (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108))
        joined = one | two
        is_piece[a[joined]] = False
        rest = a[joined] + np.where(two, 2, 1)[joined]
        more = rest < run_end[k + 1][joined]
        is_piece[rest[more]] = True

    for begin, end in spans:
        i, j = np.searchsorted(byte_at, (begin, end))
        is_piece[i:j] = False
        is_piece[i] = True
    at = np.flatnonzero(is_piece[:-1])
    starts = byte_at[at]
    return Pieces(starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets))


class PieceMemory:
    """What encode gives for each piece, asked once per distinct piece.

    encode takes a list of pieces and returns (values, lengths): the values of all pieces
    end to end, and how many each piece has.
    """

    def __init__(self, encode, known: dict[bytes, list[int]]):
        self.encode, self.known = encode, known
        self._start()

    def _start(self) -> None:
        self.index = {piece: i for i, piece in enumerate(self.known)}
        values = [np.array(v, np.uint32) for v in self.known.values()]
        self.parts, self.sizes = values, [np.array([len(v)], np.int64) for v in values]

    def look_up(self, data: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, offsets, values): piece i has values[offsets[place[i]]:offsets[place[i] + 1]]."""
        if len(self.index) > KEPT_PIECES:
            self._start()
        _, chosen, back = np.unique(span_hashes(data, pieces.starts, pieces.ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        found = [raw[a:b] for a, b in zip(pieces.starts[chosen].tolist(), pieces.ends[chosen].tolist())]
        new = [p for p in found if p not in self.index]
        if new:
            at = len(self.index)
            self.index.update(zip(new, range(at, at + len(new))))
            values, lengths = self.encode(new)
            self.parts.append(values)
            self.sizes.append(lengths)
        if len(self.parts) > 1:
            self.parts, self.sizes = [np.concatenate(self.parts)], [np.concatenate(self.sizes)]
        place = np.array([self.index[p] for p in found], np.int64)[back] if found else np.zeros(0, np.int64)
        sizes = self.sizes[0] if self.sizes else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return place, offsets, self.parts[0] if self.parts else np.zeros(0, np.uint32)


@lru_cache(4)
def tokenizer_file(path: str) -> dict:
    """A byte-level BPE file of the tokenizers library, refused where it asks for more than this module does."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    first = file["pre_tokenizer"] or {}
    plain = file["normalizer"] is None and first.get("type") == "ByteLevel" and not first["add_prefix_space"] and first.get("use_regex", True)
    model = file["model"]
    plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
    if not plain:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    return file


def special_ids(path: str) -> dict[bytes, list[int]]:
    return {t["content"].encode(): [t["id"]] for t in tokenizer_file(path)["added_tokens"]}
