"""Operators 11 and 12 against plain Python versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import divergence, mixture
from tests.checking import compare
from tests.llm.conftest import FOLDER, SCHEMA


@pytest.mark.parametrize("name", ["op11_mixture", "op12_divergence"])
def test_same_rows_as_sql(spark, con, name):
    from scholia.llm.queries import ORACLES, QUERIES

    equal, why, *_ = compare(spark, QUERIES[name], ORACLES[name], FOLDER, con)
    assert equal, why


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def mixed(rows, weights=(5, 2, 1), share=Fraction(3, 2), repeats=2):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    held = defaultdict(list)
    for r in rows:
        h = md5("mix" + ("-" if r.doc_id is None else str(r.doc_id)) + ":" + md5(r.text or ""))
        held[r.source].append((int(h[:15], 16), size(r), r.doc_id))
    order = sorted(held, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(x[1] for x in held[s]) for s in order}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > repeats * sizes[s]}
        if not full:
            target.update({s: weight[s] * unit for s in open_})
            break
        target.update({s: Fraction(repeats * sizes[s]) for s in full})
        open_ -= full
        left -= sum(repeats * sizes[s] for s in full)
    out = Counter()
    for s in order:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = target[s] - whole * sizes[s], 0
        for _, n, i in sorted(held[s], key=lambda x: (x[0], x[1], x[2] or 0)):
            more = 1 if before + n <= rest else 0 if before > rest else math.floor((rest - before) / n + Fraction(1, 2)) if n else 0
            before += n
            out[(i, n, sizes[s], round(float(target[s]), 6), n * (whole + more) if n else 0)] += 1
    return out, target


def got_mix(df, **options):
    rows = mixture.mix(df, **options).collect()
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["size"] * r["copies"]) for r in rows)


@pytest.mark.parametrize("few", [True, False])
def test_mix(odd, given, nothing, few, monkeypatch):
    if not few:
        monkeypatch.setattr(mixture, "MOST_SOURCES", 0)
    for df in (odd, given, nothing) if few else (odd,):
        got = got_mix(df)
        want, target = mixed(df.collect())
        assert got == want
        assert got == got_mix(df.repartition(3))
    assert sum(target.values()) == 0 or len(target) > 1
    assert mixture.repeated(mixture.mix(nothing)).count() == 0


def test_mix_of_equal_rows_and_other_weights(spark):
    """Three fifths of the rows are one row: as many are taken as fit, and copies follow."""
    rows = [(1, "one two three four", "en", "a", 0)] * 60 + [(i, "x " * (i % 7), "en", "abc"[i % 3], 0) for i in range(40)] + [(99, "", None, "d", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for options in ({}, {"weights": (1,), "share": (1, 2), "repeats": 1}, {"weights": (1, 9), "share": (5, 2), "repeats": 3}):
        plain = {**options, "share": Fraction(*options["share"])} if options else {}
        assert got_mix(df, **options) == mixed(df.collect(), **plain)[0]
    assert got_mix(df, weights=(1,), share=(9, 2), repeats=3) == mixed(df.collect(), (1,), Fraction(9, 2), 3)[0]  # more than there is
    mixed_rows = mixture.mix(df, keep=("lang", "text"))
    assert mixture.repeated(mixed_rows).count() == mixed_rows.agg(F.sum("copies")).first()[0]


def test_mix_of_many_sources_and_a_long_text(spark):
    rows = [(i, "w " * (1 + i % 11 * (i % 3)), "en", f"s{i % 90}", 0) for i in range(400)] + [(1000, "long " * 300_000, "en", "s5", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, target = mixed(df.collect())
    assert got_mix(df) == want
    longest = defaultdict(int)
    taken = Counter()
    for r in mixture.mix(df, keep=("source",)).collect():
        longest[r.source] = max(longest[r.source], r["size"])
        taken[r.source] += r["size"] * r.copies
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in target)


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def audited(rows, least, top=50):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        found = terms(r.text)
        docs[r.lang or ""].update(set(found))
        counts[r.lang or "", r.source or ""].update(found)
    out = Counter()
    for lang in {g[0] for g in counts}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        sources = [s for x, s in counts if x == lang]
        n = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        every = {t: sum(n[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(n[s]) for s in sources}, share(every)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            over = [(q[t] - p[s][t], t.encode()) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                for k, (v, item) in enumerate(sorted(found)[:most]):
                    out[(lang, s, part, item.decode(), -v, k + 1)] += 1
    return out


@pytest.mark.parametrize("least,block,tile", [(2, 8, 1), (3, 16, 2)])
def test_audit(odd, nothing, least, block, tile):
    assert Counter(tuple(r) for r in divergence.audit(odd, least, block, tile).collect()) == audited(odd.collect(), least)
    assert divergence.audit(nothing).count() == 0


def test_audit_of_many_groups_and_a_long_text(spark):
    rows = [(i, f"Ab{i % 5} ab cd ef{'g' * (i % 4)} {'é' * (i % 3)}", "en", f"s{i % 70}", 0) for i in range(300)]
    rows += [(1000, "long Text " * 200_000, "en", "s3", 0), (1001, None, "en", "empty", 0), (1002, "alone", "xx", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(tuple(r) for r in divergence.audit(df, 2).collect()) == audited(df.collect(), 2)


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for divisor in (5, 1_000, 123_456_789, 2**52 + 1, 2**53 + 11, 2**60):
        counts = np.minimum(rng.integers(0, divisor, 50), divisor - 5)
        assert divergence.shares(counts, divisor).tolist() == [1 + 10**9 * (int(c) + 5) // divisor for c in counts]
    forest = divergence.Forest(np.array([[1, 2, 0, 0], [1, 2, 0, 0], [0, 0, 1, 2]]))
    assert forest.roots[0] == forest.roots[1] != forest.roots[2] and len(forest.children[0]) == 2  # equal subtrees are one node
