"""Token counts of whole texts, huge ones by overlapping chunks (operator 3).

A text of more than CHUNK characters is encoded in chunks that overlap. Two neighbours are
spliced at a common boundary that is proven stable: a place where both chunks have a piece
boundary and that lies so far before the left chunk's end that its cut cannot have moved it.
From such a place on, splitting and merging see the same characters in either chunk, so the
spliced counts are those of the whole. Where no such place lies in the overlap (one piece
longer than it), the overlap doubles, at most back to the last splice, which is a boundary of
the whole text itself.

Chunks are encoded with the tokenizer's own library: byte-level BPE files piece by piece,
each distinct piece of a task once; other .json files and sentencepiece models whole texts
at a time (their pieces cannot be cut apart safely).

Defined results: null text counts as empty: 0 bytes, 0 tokens; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scholia.llm.common import Texts, as_texts, prepare, slices, texts_of
from scholia.llm.pretokens import PieceMemory, special_ids, split, tokenizer_file

#: Bytes of a chunk and of the first overlap; more than LIMIT tokens are marked.
CHUNK, OVERLAP, LIMIT = 32_768, 256, 512


class Encoded(NamedTuple):
    """Byte offsets of the piece boundaries (the start of each piece, then the end), and tokens per piece."""

    bounds: np.ndarray
    tokens: np.ndarray


class LibraryCounts:
    """Tokens of pieces, as the tokenizers library counts them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer_file(path)  # refuses what cannot be cut into pieces
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = special_ids(path)
        self.specials = tuple(specials)
        self.reach = max([len(s) for s in specials], default=0)
        self.memory = PieceMemory(self._count, {s: [1] for s in specials})

    def _count(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return np.array([len(x) for x in found], np.uint32), np.ones(len(pieces), np.int64)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, tokens, first): the pieces of all texts, their tokens, and each text's first piece."""
        pieces = split(texts, self.specials)
        place, offsets, values = self.memory.look_up(texts.data, pieces)
        return pieces.starts, values[offsets[place]].astype(np.int64), pieces.first

    def chunk(self, data: np.ndarray, begin: int, end: int) -> Encoded:
        starts, tokens, _ = self.encode(Texts(data[begin:end], np.array([0, end - begin])))
        return Encoded(np.append(starts, end - begin) + begin, tokens)


def _char_start(data: np.ndarray, at: int) -> int:
    """The nearest start of a character at or before a byte."""
    while 0 < at < len(data) and (data[at] & 0xC0) == 0x80:
        at -= 1
    return at


def count_spliced(counts: LibraryCounts, data: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The tokens of one text, encoded by overlapping chunks.

    left is right up to every boundary before its last piece and the reach of special
    strings; its tokens are taken up to the splice and never looked at again.
    """
    total, splice, size = 0, 0, chunk
    end = _char_start(data, min(size, len(data)))
    left = counts.chunk(data, 0, end)
    while end < len(data):
        wide = overlap
        while True:
            begin = _char_start(data, max(splice, end - wide))
            stop = _char_start(data, min(end + size, len(data)))
            right = counts.chunk(data, begin, stop)
            stable = left.bounds[:-1][left.bounds[:-1] + counts.reach <= end]
            stable = stable[stable >= max(begin, splice)]
            common = stable[np.isin(stable, right.bounds)]
            if begin == splice:  # a boundary of the whole text: nothing to align
                common = np.append(np.array([splice]), common)
            if len(common):
                break
            wide *= 2
        at = int(common[-1])
        total += int(left.tokens[(left.bounds[:-1] >= splice) & (left.bounds[:-1] < at)].sum())
        size = chunk if at > splice else size * 2  # a piece longer than a chunk: take more at once
        left, splice, end = right, at, stop
    return total + int(left.tokens[left.bounds[:-1] >= splice].sum())


def count_tokens(documents: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts equal those of the library for the file at path, which must lie at that place on
    every executor, without added special tokens, truncation or padding.
    """
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = None if path.endswith(".json") and _is_plain(path) else _whole_counter(path)
        counts = None if whole else LibraryCounts(path)
        for batch in slices(batches):
            texts = as_texts(batch.column("text"))
            sizes = np.diff(texts.offsets)
            if whole:
                tokens = np.array(whole([t or "" for t in batch.column("text").to_pylist()]), np.int64)
            else:
                huge = sizes > chunk
                keep = np.repeat(~huge, sizes)
                short = Texts(texts.data[keep], np.concatenate([[0], np.cumsum(np.where(huge, 0, sizes))]))
                _, each, first = counts.encode(short)
                tokens = np.diff(np.concatenate([[0], np.cumsum(each)])[first])
                for i in np.flatnonzero(huge).tolist():
                    tokens[i] = count_spliced(counts, texts.data[texts.offsets[i] : texts.offsets[i + 1]], chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts_of(documents).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _is_plain(path: str) -> bool:
    try:
        return bool(tokenizer_file(path))
    except ValueError:
        return False


def _whole_counter(path: str):
    """Counts whole texts with the file's library; for tokenizers whose pieces depend on more than their bytes."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
