"""Operators 4 and 6 against brute force."""

import hashlib
import re
import string

import numpy as np
import pytest

from scholia.llm import jaccard, substrings
from scholia.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def removed(rows):
    """(doc_id, words, removed, text left) of each row."""
    starts: dict[tuple, int] = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - 12):
            key = tuple(words[k : k + 13])
            if i is not None:
                starts[key] = min(i, starts.get(key, i))
    out = []
    for i, text in rows:
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - 12):
            if i is not None and starts[tuple(words[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("group", [20_000, 2])
def test_substrings(odd, given, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)  # 2: every prefix is extended
    for documents in (odd, given):
        want = removed([(r.doc_id, r.text) for r in documents.collect()])
        got = substrings.remove_repeats(documents, keep=("lang", "n_words")).collect()
        assert by_id([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got]) == by_id(want)


def test_substrings_of_nothing(nothing):
    assert substrings.remove_repeats(nothing).count() == 0


def test_substrings_query(spark, given):
    from scholia.llm.queries import QUERIES
    from tests.llm.conftest import FOLDER

    got = {r.doc_id: r.kept_sha256 for r in QUERIES["op4_substrings"](spark, FOLDER).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in removed([(r.doc_id, r.text) for r in given.collect()])}


def linked(rows):
    """doc_id: (size, component) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        if i is not None:
            sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("members", [2_000, 2])
def test_jaccard(odd, given, monkeypatch, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)  # 2: every larger block is dealt out in pairs of chunks
    for documents in (odd, given):
        rows = [(r.doc_id, r.text) for r in documents.collect()]
        got = jaccard.link(documents).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == linked(rows)
        assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_of_nothing(nothing):
    assert jaccard.link(nothing).count() == 0


def test_jaccard_at_the_bound(spark):
    """Sets of 9 with 8 in common link (80 of 100), with 7 they don't; a chain connects what doesn't link."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[1:14])), (3, " ".join(words[2:15])), (4, " ".join(words[20:33])), (5, " ".join(words[22:35]))]
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_trees_lose_no_link():
    """Many near copies of several originals, in one block: the forest connects what all pairs connect."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(6):
        original = rng.integers(1, 2**60, 120).astype(np.uint64)
        for _ in range(25):
            copy = original.copy()
            copy[rng.integers(0, 120, rng.integers(0, 20))] = rng.integers(1, 2**60, 1).astype(np.uint64)
            sets.append(np.unique(copy))
    n, maps = np.array([len(s) for s in sets]), [jaccard.bitmap(s).tobytes() for s in sets]
    true = lambda a, b: 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (n[a] + n[b])

    def roots(links):
        label = np.arange(len(sets))
        for a, b in links:
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        return label.tolist()

    every = [(a, b) for a in range(len(sets)) for b in range(a) if true(a, b)]
    got = jaccard.join_members(np.arange(len(sets)), n, maps, np.zeros(len(sets), int), true)
    assert roots(got) == roots(every) and len(got) < len(sets)
    side = np.arange(len(sets)) % 2
    across = jaccard.join_members(np.arange(len(sets)), n, maps, side, true)
    assert roots(across) == roots([e for e in every if side[e[0]] != side[e[1]]])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 60), (7, 7), (200, 100), (1, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 100: 50, 200: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
