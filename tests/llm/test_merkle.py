"""Operator 13 against a plain Python manifest."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scholia.llm import merkle
from tests.checking import compare
from tests.llm.conftest import CLASHING, FOLDER, SCHEMA


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    out = ""
    for v in (row.doc_id, row.source, row.lang, row.n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(out)


def climb(nodes, arity):
    """(last node, per leaf the list of (before, after))"""
    levels, paths = [list(nodes)], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        for i, path in enumerate(paths):
            at = i // arity ** (len(levels) - 1)
            run = at - at % arity
            path.append(("".join(last[run:at]), "".join(last[at + 1 : run + arity])))
        levels.append([H("".join(last[k : k + arity])) for k in range(0, len(last), arity)])
    return levels[-1][0], paths


def manifest(rows, tampered, arity):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    order = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    done = []
    for s in order:
        held = sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        done.append((held, *climb([leaf(r, r.text) for r in held], arity)))
    root, above = climb([d[1] for d in done], arity)
    out = Counter()
    for (held, subroot, paths), top in zip(done, above):
        for r, path in zip(held, paths):
            folded = leaf(r, tampered(r))
            for before, after in path + top:
                folded = H(before + folded + after)
            proof = H("".join(b + a for b, a in path + top))
            out[(r.doc_id, leaf(r, r.text), subroot, root, proof, folded, folded == root)] += 1
    return out


def without_breaks(r):
    if r.text is None or r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2:
        return r.text
    return r.text.replace("\n", "")


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest(odd, arity):
    got = Counter(tuple(r) for r in merkle.audit(odd, merkle.without_line_breaks(), arity=arity).collect())
    assert got == manifest(odd.collect(), without_breaks, arity)
    assert {k[-1] for k in got} == {True, False}


def test_small_and_empty(spark, nothing):
    assert merkle.audit(nothing, merkle.without_line_breaks()).count() == 0
    for rows in ([(1, "a\nb", "en", "s", 3)], [(i, "t", None, None, 1) for i in range(5)], [(i, None, "en", f"s{i}", None) for i in range(5)]):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in CLASHING if c not in SCHEMA})
        got = Counter(tuple(r) for r in merkle.audit(df, merkle.without_line_breaks()).collect())
        assert got == manifest(df.collect(), without_breaks, 3)


def test_equal_rows_and_long_text(spark):
    """A third of all rows are one row; one text has 2 MB."""
    rows = [(7, "same", "en", "hot", 4)] * 60 + [(i, f"text {i}\n", "en", "hot", 7) for i in range(119)] + [(500, "long\n" * 400_000, "en", "hot", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter(tuple(r) for r in merkle.audit(df, merkle.without_line_breaks()).collect())
    assert got == manifest(df.collect(), without_breaks, 3)


def test_same_rows_as_sql(spark, con):
    from scholia.llm.queries import ORACLES, QUERIES

    equal, why, *_ = compare(spark, QUERIES["op13_merkle"], ORACLES["op13_merkle"], FOLDER, con)
    assert equal, why
