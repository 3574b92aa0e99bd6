"""BPE encoding and decoding by batched merge rounds (operator 1).

Texts are split into pieces, distinct pieces of a slice are encoded together: their symbols
lie in one flat array; each round looks up the rank of every adjacent pair by binary search
over the sorted pair keys and merges each piece's lowest-ranked pair. Decoding gathers the
bytes of the ids. Both are narrow: no shuffle, and a task holds one slice of text at a time.

Defined results: null text counts as empty; an empty text has no ids and decodes to an empty
text; repeated rows each give a row; an empty table gives an empty result; other columns are
ignored unless named in keep.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scholia.llm.common import as_texts, prepare, slices, spread_ranges, texts_of
from scholia.llm.pretokens import PieceMemory, special_ids, split, tokenizer_file

#: Pieces of more bytes are merged one by one with a queue: rounds would be as many as their merges.
LONG_PIECE = 128
_NO_RANK = np.int64(1 << 40)


class Merges:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        file = tokenizer_file(path)
        vocab: dict[str, int] = file["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.byte_symbol = np.zeros(256, np.int64)
        for char, b in byte_of.items():
            self.byte_symbol[b] = vocab[char]
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        results = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int64), results[order]
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        tokens |= {t["id"]: t["content"].encode() for t in file["added_tokens"]}
        ordered = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_sizes = np.array([len(t) for t in ordered], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(ordered), np.uint8)

    def _look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return at, self.keys[at] == pairs

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), sizes)
        long = sizes > LONG_PIECE
        ids, owners = [], []
        for i in np.flatnonzero(long).tolist():
            ids.append(self._one_by_one(symbols[of == i].tolist()))
            owners.append(np.full(len(ids[-1]), i))
        if long.any():
            symbols, of = symbols[~long[of]], of[~long[of]]
        while len(symbols):
            pairs = np.append((symbols[:-1] << 20) | symbols[1:], -1)
            pairs[:-1][of[:-1] != of[1:]] = -1
            at, hit = self._look_up(pairs)
            rank = np.where(hit, self.ranks[at], _NO_RANK)
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            lowest = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.append(begins, len(of)))
            lowest = np.repeat(lowest, counts)
            done = lowest == _NO_RANK
            if done.any():
                ids.append(symbols[done])
                owners.append(of[done])
            chosen = np.flatnonzero((rank == lowest) & ~done)
            if len(chosen):  # of pairs that overlap (one symbol repeated) every second one is merged
                fresh = np.concatenate([[True], chosen[1:] != chosen[:-1] + 1])
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
                symbols[chosen] = self.results[at[chosen]]
            keep = ~done
            keep[chosen + 1] = False
            symbols, of = symbols[keep], of[keep]
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
        ids, owners = np.concatenate(ids), np.concatenate(owners)
        return ids[np.argsort(owners, kind="stable")].astype(np.uint32), np.bincount(owners, minlength=len(pieces))

    def _one_by_one(self, symbols: list[int]) -> np.ndarray:
        """The same merges for one long piece, by a queue of (rank, place)."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        array = np.array(symbols)
        at, hit = self._look_up((array[:-1] << 20) | array[1:])
        queue = [(r, i, k) for r, i, k in zip(self.ranks[at[hit]].tolist(), np.flatnonzero(hit).tolist(), self.keys[at[hit]].tolist())]
        heapq.heapify(queue)

        def push(i: int) -> None:
            key = (symbols[i] << 20) | symbols[after[i]]
            j = int(np.searchsorted(self.keys, key))
            if j < len(self.keys) and self.keys[j] == key:
                heapq.heappush(queue, (int(self.ranks[j]), i, key))

        results = dict(zip(self.keys[at[hit]].tolist(), self.results[at[hit]].tolist()))
        while queue:
            _, i, key = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j < 0 or (symbols[i] << 20) | symbols[j] != key:
                continue
            if key not in results:
                results[key] = int(self.results[np.searchsorted(self.keys, key)])
            symbols[i], symbols[j], after[i] = results[key], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([s for s in symbols if s >= 0], np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids end to end, and how many each id has."""
        sizes = self.token_sizes[ids]
        return self.token_bytes[spread_ranges(self.token_starts[ids], sizes)], sizes


@lru_cache(4)
def merges(path: str) -> Merges:
    return Merges(path)


def _binary(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def encode(documents: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns of keep, n_tokens, ids (binary: little-endian unsigned 32-bit integers).

    Ids equal those of the tokenizers library for the file at path, which must lie at that
    place on every executor, with add_special_tokens=False.
    """
    prepare(documents.sparkSession)
    kept = [f for f in documents.schema if f.name in keep and f.name not in ("doc_id", "text", "n_tokens", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, specials = merges(path), special_ids(path)
        memory = PieceMemory(table.encode, specials)
        for batch in slices(batches):
            texts = as_texts(batch.column("text"))
            pieces = split(texts, tuple(specials))
            place, offsets, values = memory.look_up(texts.data, pieces)
            sizes = offsets[place + 1] - offsets[place]
            ids = values[spread_ranges(offsets[place], sizes)].astype("<u4")
            ends = np.concatenate([[0], np.cumsum(sizes)])[pieces.first]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(batch.column(f.name) for f in kept),
                    pa.array(np.diff(ends)), _binary(ids, ends[1:] * 4, pa.binary()),
                ],
                names=["doc_id", *(f.name for f in kept), "n_tokens", "ids"],
            )

    schema = "doc_id long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "n_tokens long, ids binary"
    return texts_of(documents, *[f.name for f in kept]).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encoded and the text of its ids, as the library's decode(ids, skip_special_tokens=False).

    Bytes that are no UTF-8 become U+FFFD; null ids decode to an empty text. A column named
    text is replaced.
    """
    names = [c for c in encoded.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "text") + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                data, _ = table.decode(np.frombuffer(ids.as_py() or b"", "<u4").astype(np.int64))
                texts.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.select(*names).mapInArrow(run, schema)
