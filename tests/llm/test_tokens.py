"""Operators 1 and 3 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholia.llm import bpe, token_counts
from scholia.llm.common import as_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(documents, library):
    decoded = bpe.decode(bpe.encode(documents, PATH, keep=("lang",)), PATH)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), r.text) for r in decoded.collect())
    want = []
    for r in documents.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_odd(odd, library):
    check(odd, library)


def test_given(given, library):
    check(given, library)


def test_nothing(nothing):
    assert bpe.decode(bpe.encode(nothing, PATH), PATH).count() == 0
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_bytes_that_are_no_text(spark, library):
    ids = [0, 222, 50_000, 50_256, 447]
    rows = spark.createDataFrame([(1, bytearray(np.array(ids, "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in bpe.decode(rows, PATH).collect()}
    assert got == {1: library.decode(ids, skip_special_tokens=False), 2: ""}


def test_pieces_of_any_length(library):
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 5, 40, 127, 129, 700]))) for _ in range(60)] + ["a" * 999, "ab" * 200]
    ids, sizes = bpe.merges(PATH).encode([p.encode() for p in pieces])
    assert sizes.tolist() == [len(x.ids) for x in library.encode_batch(pieces, add_special_tokens=False)]
    assert ids.tolist() == [i for x in library.encode_batch(pieces, add_special_tokens=False) for i in x.ids]


def test_counts(odd, given, library):
    for documents in (odd, given):
        got = sorted(tuple(r) for r in token_counts.count_tokens(documents, PATH).na.fill(-1, ["doc_id"]).collect())
        want = []
        for r in documents.select("doc_id", "text").collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want.append((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), n, n > 512))
        assert got == sorted(want)


def test_splices(library):
    """Chunks much smaller than the text, special strings and pieces longer than a chunk."""
    rng, counts = random.Random(7), token_counts.LibraryCounts(PATH)
    parts = ["'s", "'re", " ", "  ", "\n", "<|endoftext|>", "'", "a", "word", " it's", "é", "漢", "12", "!!", "   ", "x" * 90]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 300)))
        data = np.frombuffer(text.encode(), np.uint8)
        got = token_counts.count_spliced(counts, data, rng.choice([40, 100, 333]), rng.choice([4, 16]))
        assert got == len(library.encode(text, add_special_tokens=False).ids)


def test_other_libraries(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(r.n_tokens for r in token_counts.count_tokens(odd, path).collect())
    assert got == sorted(len(model.encode(r.text or "")) for r in odd.collect())
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    got = sorted(r.n_tokens for r in token_counts.count_tokens(odd, path).collect())
    assert got == sorted(len(other.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())


def test_query(spark, given, library):
    from scholia.llm.queries import QUERIES
    from tests.llm.conftest import FOLDER

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op1_bpe"](spark, FOLDER).collect()}
    for r in given.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id] == (len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest())


def test_arrow_slices():
    import pyarrow as pa

    whole = pa.array(["ab", None, "", "é"])
    assert as_texts(whole.slice(1)).data.tobytes() == "é".encode()
    assert as_texts(whole.slice(0, 1)).offsets.tolist() == [0, 2]
