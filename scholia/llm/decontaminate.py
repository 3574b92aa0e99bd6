"""Benchmark passages in documents by latent semantic retrieval (operator 7).

1. One pass over the texts keeps, per document, the places of the words that occur in a
   benchmark item (other words can match nothing); this narrow table is stored.
2. Document frequencies over all passages of PASSAGE words give TF-IDF weights. A randomised
   SVD of the passages' TF-IDF matrix, with the items' own rows in balance, gives the latent
   space: each task multiplies its rows with a random matrix and back, the products add up,
   and a small factorisation on the driver ends it (one pass, Nystroem form).
3. Windows of three steps of STEP words are latent vectors, sums of their words' vectors.
   The targets are the items and, of items longer than a passage, also their parts of at
   most PASSAGE words each, as no window covers much of a long item. Window and target are
   candidates when their cosine and the share of the target that the window covers in the
   latent space are large. Windows whose length alone rules that out are left out
   (Cauchy-Schwarz), which loses none.
4. Candidates are checked by the longest common subsequence of words of the whole item and
   the text around the window, and by the item's answer: its last sentence. Windows of a
   text that lie within an eighth of the item of each other are checked together.

Items of fewer than LEAST_WORDS words have no latent vector: they are found where all their
words stand in a row, in the same stored table.

Items are taken in blocks of about BLOCK (long ones count for more), so that what is broadcast
stays bounded at any number of items; each block is a search over all documents.

Words are runs of letters, digits and non-ASCII characters, A-Z as a-z.

Defined results: null or empty texts and items, and items without a word, match nothing;
short items have null cosine and covered; an item with a null item_id is searched like any
other and its finding has a null item_id; repeated rows of a document, and items that share an
item_id (null is one id), give one finding, the one with the most common words; an empty table
gives no findings; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import as_texts, mix, prepare, slices, stored, texts_of, words_of

#: Items of a block, words of a passage and of a step, rank and oversampling of the SVD.
BLOCK, LEAST_WORDS, PASSAGE, STEP, RANK, MORE = 1_000, 8, 48, 16, 96, 8
#: Words of more than this share of the passages carry no weight (except an item's rarest half).
COMMON = 0.01
#: Least cosine and least covered share of a candidate; least common subsequence, alone and with the answer.
COSINE, COVERED, COMMON_WORDS, WITH_ANSWER = 0.3, 0.3, 0.55, 0.4


class Items(NamedTuple):
    """The items of a block: word numbers of each, its answer's, the sorted codes of all words; word numbers and item of each target (of long items only)."""

    ids: list[int | None]
    words: list[list[int]]
    answers: list[list[int]]
    codes: np.ndarray
    targets: list[list[int]]
    owner: list[int]


def _numbers(texts: list[str], codes: np.ndarray) -> list[list[int]]:
    words = words_of(as_texts(pa.array(texts, pa.string())), lower=True, loose=True)
    at = np.searchsorted(codes, words.codes).tolist()
    return [at[a:b] for a, b in zip(words.first, words.first[1:])]


def _parts_of(words: list[int]) -> list[list[int]]:
    """The item and, where it is longer than a passage, its even parts of at most PASSAGE words."""
    n = -(-len(words) // PASSAGE)
    return [words, *[words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n if n > 1 else 0)]]


def read_items(rows: list[tuple[int | None, str]]) -> Items:
    texts = [t or "" for _, t in rows]
    words = words_of(as_texts(pa.array(texts, pa.string())), lower=True, loose=True)
    worded = np.diff(words.first) > 0
    codes = np.unique(words.codes)
    ids = [i for (i, _), keep in zip(rows, worded) if keep]
    texts = [t for t, keep in zip(texts, worded) if keep]
    answers = [re.split(r"(?<=[.!?])\s+", t.strip())[-1] for t in texts]
    numbers = _numbers(texts, codes)
    targets = [(part, i) for i, item in enumerate(numbers) if len(item) >= LEAST_WORDS for part in _parts_of(item)]
    return Items(ids, numbers, _numbers(answers, codes), codes, [t for t, _ in targets], [i for _, i in targets])


def encode(documents: DataFrame, codes: np.ndarray) -> DataFrame:
    """Per document: doc_id, n_words, and of its known words the step from the last one and the number (binary)."""
    shared = prepare(documents.sparkSession).sparkContext.broadcast(codes)  # at most the words of BLOCK items
    kind = "<u2" if len(codes) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            words = words_of(as_texts(batch.column("text")), lower=True, loose=True)
            at = np.minimum(np.searchsorted(known, words.codes), len(known) - 1)
            hit = np.flatnonzero(known[at] == words.codes)
            place = hit - words.first[words.of[hit]]
            first = np.searchsorted(hit, words.first)
            step = np.diff(place, prepend=0)
            heads = first[:-1][first[:-1] < first[1:]]
            step[heads] = place[heads]
            step = step.astype("<u4")
            number = at[hit].astype(kind)
            spans = list(zip(first.tolist(), first[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(words.first)),
                    pa.array([step[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([number[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                names=["doc_id", "n_words", "steps", "numbers"],
            )

    return texts_of(documents).mapInArrow(run, "doc_id long, n_words long, steps binary, numbers binary")


class Flat(NamedTuple):
    """The known words of some documents end to end: document, place and number of each."""

    of: np.ndarray
    place: np.ndarray
    number: np.ndarray


def _flat(batch: pa.RecordBatch, kind: str) -> Flat:
    steps = [np.frombuffer(x, "<u4") for x in batch.column("steps").to_pylist()]
    number = np.frombuffer(b"".join(batch.column("numbers").to_pylist()), kind).astype(np.int64)
    of = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
    place = np.concatenate([np.cumsum(s, dtype=np.int64) for s in steps]) if steps else np.zeros(0, np.int64)
    return Flat(of, place, number)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _passage_words(flat: Flat, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, number) of the distinct words of each passage; passages are numbered across documents."""
    passage = (flat.of << 40) | (flat.place // size)
    passage = np.cumsum(np.diff(passage, prepend=-1) != 0)
    key = np.unique(passage * np.int64(n) + flat.number)
    return key // n, key % n


def weigh(encoded: DataFrame, items: Items, kind: str) -> np.ndarray:
    """Weights of the words by their share of all passages."""
    n = len(items.codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n + 1, np.int64)
        for batch in _parts(batches):
            held[n] += int(((batch.column("n_words").to_numpy() + PASSAGE - 1) // PASSAGE).sum())
            held[:n] += np.bincount(_passage_words(_flat(batch, kind), PASSAGE, n)[1], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(held)], names=["number", "n"])

    rows = encoded.mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()  # words of BLOCK items
    held = np.zeros(n + 1)
    for r in rows:
        held[r["number"]] = r["n"]
    total, share = held[n], held[:n]
    sought = np.zeros(n, bool)  # words of short items alone have no part in the latent space
    sought[[w for words in items.targets for w in words]] = True
    keep = sought & (share <= COMMON * max(total, 1))
    for words in items.targets:
        distinct = np.unique(words)
        keep[distinct[np.argsort(share[distinct], kind="stable")][: (len(distinct) + 1) // 2]] = True
    return np.where(keep, np.log((total + 1) / (share + 1)) + 1, 0)


def latent_space(encoded: DataFrame, items: Items, weights: np.ndarray, kind: str, rank: int = RANK, seed: int = 17) -> np.ndarray:
    """Right singular vectors (words x rank) of the passages' TF-IDF matrix, by one multiplication with a random matrix."""
    n = len(items.codes)
    wide = min(n, rank + MORE)
    probe = np.random.default_rng(seed).normal(size=(n, wide))
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast((weights, probe.astype(np.float32)))  # words of BLOCK items x (RANK + MORE)
    lines = 256

    def multiply(passage: np.ndarray, number: np.ndarray, into: np.ndarray, w: np.ndarray, p: np.ndarray) -> float:
        """into += A'(A p) for the rows of A given by passage and number; the sum of squares of A."""
        live = w[number] > 0
        passage, number = passage[live], number[live]
        if not len(number):
            return 0.0
        begins = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        value = w[number].astype(np.float32)[:, None]
        rows = np.add.reduceat(p[number] * value, begins, axis=0)
        back = np.repeat(rows, np.diff(np.append(begins, len(number))), axis=0) * value
        order = np.argsort(number, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]]))
        into[number[order][heads]] += np.add.reduceat(back[order], heads, axis=0)
        return float((value**2).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = shared.value
        product, squares = np.zeros((n, wide)), 0.0
        for batch in _parts(batches, 64):
            squares += multiply(*_passage_words(_flat(batch, kind), PASSAGE, n), product, w, p)
        parts = list(range(0, n, lines))
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int64()), pa.array([product[a : a + lines].astype("<f4").tobytes() for a in parts], pa.binary()),
             pa.array([squares if a == 0 else 0.0 for a in parts])],
            names=["part", "product", "squares"],
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f4").astype(float) for x in table.column("product").to_pylist())
        return pa.table({"part": [key[0].as_py()], "product": [total.astype("<f8").tobytes()], "squares": [sum(table.column("squares").to_pylist())]})

    schema = "part long, product binary, squares double"
    product, squares = np.zeros((n, wide)), 0.0
    for r in encoded.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect():  # words x (RANK + MORE) numbers
        block = np.frombuffer(r["product"], "<f8").reshape(-1, wide)
        product[r["part"] : r["part"] + len(block)] = block
        squares += r["squares"]
    own, passages, numbers = np.zeros((n, wide)), [], []
    for i, words in enumerate(items.targets):
        distinct = np.unique(words)
        passages.append(np.full(len(distinct), i))
        numbers.append(distinct)
    own_squares = multiply(np.concatenate(passages), np.concatenate(numbers), own, weights, probe.astype(np.float32))
    product += own * (squares / own_squares if squares and own_squares else 1.0)
    shift = 1e-6 * np.linalg.norm(product) + 1e-12
    product += shift * probe
    core = probe.T @ product
    values, basis = np.linalg.eigh((core + core.T) / 2)
    live = values > values[-1] * 1e-10
    half = product @ (basis[:, live] / np.sqrt(values[live]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, :rank]


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        met = row & masks.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(item) - row.bit_count()


def _has_run(words: list[int], places: list[int], run: list[int]) -> bool:
    k = len(run)
    return any(words[i : i + k] == run and places[i + k - 1] - places[i] == k - 1 for i in range(len(words) - k + 1))


def short_runs(items: Items) -> dict[int, tuple[np.ndarray, list[list[int]]]]:
    """By length: the sorted hashes of the short items' words, and the items of each hash."""
    by: dict[int, dict[int, list[int]]] = {}
    for j, words in enumerate(items.words):
        if len(words) < LEAST_WORDS:
            by.setdefault(len(words), {}).setdefault(int(_run_hashes(np.array(words), len(words))[0]), []).append(j)
    return {k: (np.array(sorted(held), np.uint64), [held[h] for h in sorted(held)]) for k, held in by.items()}


def _run_hashes(number: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k numbers in a row."""
    n = len(number) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + number[i : i + n].astype(np.uint64) + np.uint64(1))
    return out


def _short_hits(flat: Flat, items: Items, runs: dict[int, tuple[np.ndarray, list[list[int]]]]) -> dict[tuple[int, int], int]:
    """The first place in each document of each short item whose words stand there in a row."""
    first: dict[tuple[int, int], int] = {}
    for k, (hashes, of) in runs.items():
        if len(flat.of) < k:
            continue
        n = len(flat.of) - k + 1
        whole = (flat.of[:n] == flat.of[k - 1 :]) & (flat.place[k - 1 :] - flat.place[:n] == k - 1)
        found = _run_hashes(flat.number, k)
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        hits = np.flatnonzero(whole & (hashes[at] == found))
        _, fresh = np.unique(flat.of[hits] * np.int64(len(hashes)) + at[hits], return_index=True)
        for i in hits[fresh].tolist():
            for j in of[at[i]]:
                if items.words[j] == flat.number[i : i + k].tolist():
                    first[int(flat.of[i]), j] = int(flat.place[i])
    return first


def _search_block(documents: DataFrame, items: Items) -> DataFrame:
    kind = "<u2" if len(items.codes) < 1 << 16 else "<u4"
    encoded = stored(encode(documents, items.codes), "passage-words")
    if items.targets:
        weights = weigh(encoded, items, kind)
        space = latent_space(encoded, items, weights, kind)
        latent = (space * weights[:, None]).astype(np.float32)
        wanted = np.stack([latent[np.unique(w)].sum(axis=0) for w in items.targets])
    else:
        weights, latent, wanted = np.zeros(len(items.codes)), np.zeros((len(items.codes), 1), np.float32), np.zeros((1, 1), np.float32)
    shared = encoded.sparkSession.sparkContext.broadcast((items, latent, wanted, weights > 0, short_runs(items)))  # words of BLOCK items x RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, vectors, goal, heavy, runs = shared.value
        length = np.maximum(np.linalg.norm(goal, axis=1), 1e-9)
        unit, least = (goal / length[:, None]).T, float(length.min()) * COVERED
        names = ["doc_id", "item_id", "cosine", "covered", "common_words", "answer_found", "first_word", "last_word"]
        for batch in _parts(batches, 128):
            flat = _flat(batch, kind)
            live = np.flatnonzero(heavy[flat.number])
            best: dict[tuple[int, int], tuple] = {}
            checked: dict[tuple[int, int, int], tuple[float, bool]] = {}
            if len(live):
                # one vector for each step with a word of weight; windows are it and the two steps after it
                step_of, step, number = flat.of[live], flat.place[live] // STEP, flat.number[live]
                key = (step_of << 40) | step
                order = np.lexsort((number, key))
                key, number = key[order], number[order]
                fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1])])
                key, number = key[fresh], number[fresh]
                begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                steps = np.add.reduceat(vectors[number], begins, axis=0)
                key = key[begins]
                windows = steps.copy()
                for k in (1, 2):
                    at = np.minimum(np.searchsorted(key, key + k), len(key) - 1)
                    there = key[at] == key + k
                    windows[there] += steps[at[there]]
                size = np.linalg.norm(windows, axis=1)
                near = np.flatnonzero(size >= least)
                many = max(16, min(2048, (1 << 22) // len(length)))
                for a in range(0, len(near), many):
                    rows = near[a : a + many]
                    dots = windows[rows] @ unit
                    cosine, covered = dots / size[rows, None], dots / length
                    for i, j in np.argwhere((cosine >= COSINE) & (covered >= COVERED)).tolist():
                        doc, at = int(key[rows[i]] >> 40), int(key[rows[i]] & ((1 << 40) - 1)) * STEP
                        t = block.owner[j]
                        item = block.words[t]
                        grain = max(1, len(item) // 8 // STEP) * STEP  # windows this near share one check
                        near_by = (doc, t, at // grain)
                        if near_by not in checked:
                            lo, hi = np.searchsorted(flat.of, (doc, doc + 1))
                            begin = at // grain * grain
                            span = lo + np.searchsorted(flat.place[lo:hi], (begin - len(item), begin + grain + 2 * STEP + len(item)))
                            words, places = flat.number[span[0] : span[1]].tolist(), flat.place[span[0] : span[1]].tolist()
                            share = common_subsequence(item, words) / len(item)
                            checked[near_by] = share, len(block.answers[t]) >= 3 and _has_run(words, places, block.answers[t])
                        share, answer = checked[near_by]
                        if share >= COMMON_WORDS or answer and share >= WITH_ANSWER:
                            row = (share, float(cosine[i, j]), float(covered[i, j]), answer, at, at + 3 * STEP)
                            if (doc, t) not in best or row > best[doc, t]:
                                best[doc, t] = row
            for (doc, j), at in _short_hits(flat, block, runs).items():
                best[doc, j] = (1.0, None, None, len(block.answers[j]) >= 3, at, at + len(block.words[j]))
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], block.ids[j], c, v, s, x, a, b) for (d, j), (s, c, v, x, a, b) in best.items()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return encoded.mapInArrow(
        run, "doc_id long, item_id long, cosine double, covered double, common_words double, answer_found boolean, first_word long, last_word long"
    )


def search(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, cosine, covered, common_words, answer_found, first_word, last_word."""
    size = F.greatest(F.lit(1), F.ceil(F.char_length("text") / (8 * PASSAGE)))  # about the passages of an item
    blocks = max(1, -(-(benchmark.agg(F.sum(F.coalesce(size, F.lit(1)))).first()[0] or 0) // block))
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = None
    for b in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about block items
        items = read_items(sorted(((r["item_id"], r["text"] or "") for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        if items.ids:
            part = _search_block(documents, items)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, cosine double, covered double, common_words double, answer_found boolean, first_word long, last_word long"
        )
    rest = ["common_words", "cosine", "covered", "answer_found", "first_word", "last_word"]
    one = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*rest)).alias("x"))
    return one.select(*[F.col(c) if c in one.columns else F.col(f"x.{c}").alias(c) for c in found.columns])
