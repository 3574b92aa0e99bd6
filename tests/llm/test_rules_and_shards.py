"""Operators 8 and 10, the pipeline, and the entry file."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import quality_rules, sharding
from tests.checking import compare
from tests.llm.conftest import FOLDER


@pytest.mark.parametrize("name", ["op4_substrings", "op8_quality_rules"])
def test_same_rows_as_sql(spark, con, name):
    from scholia.llm.queries import ORACLES, QUERIES

    equal, why, *_ = compare(spark, QUERIES[name], ORACLES[name], FOLDER, con)
    assert equal, why


def counted(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    seen, covered = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7)), set()
    for k in range(len(words) - 7):
        if seen[tuple(words[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, nothing):
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        want = counted(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.kept and r.base_failed)
    by = {r.doc_id: r.kept for r in got}
    assert by[1] and by[10] and not by[5] and not by[14] and not by[15]
    assert quality_rules.judge(nothing).count() == 0
    left = quality_rules.keep_good(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == sorted(r.doc_id or 0 for r in got if r.kept)


def test_many_groups(odd, given, monkeypatch):
    """With the salted join the verdicts are the same."""
    for documents in (odd, given):
        few = sorted(tuple(r) for r in quality_rules.judge(documents).na.fill(-1, ["doc_id"]).collect())
        with monkeypatch.context() as m:
            m.setattr(quality_rules, "MOST_GROUPS", 0)
            assert few == sorted(tuple(r) for r in quality_rules.judge(documents).na.fill(-1, ["doc_id"]).collect())


def test_buckets(spark):
    values = [*range(40), 1000, 1023, 1024, 123_456_789]
    for v, edge in spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v"))).collect():
        assert v <= edge <= v + max(0, v // 32) and (v > 63 or edge == v)


def test_fences_follow_their_group(spark):
    """Long words in one source, short ones in another; small groups are judged by their language's sketch."""
    from tests.llm.conftest import SCHEMA

    words = lambda n, i: " ".join("abcdefghijklmnop"[: n + (i + k) % 3] + str(k) for k in range(60))
    rows = [(i, words(9 if i % 2 else 3, i), "en", f"s{i % 2}", 0) for i in range(400)]
    odd = {
        1_000: ("en", "s0", words(18, 0), False), 1_001: ("en", "s1", words(10, 0), True), 1_002: ("en", "s1", words(1, 0)[:120] + " a" * 90, False),
        1_003: ("en", "own", words(3, 0) + " $" * 120, False), 1_004: ("xx", "own", "tick " * 10 + words(5, 0), False), 1_005: ("xx", None, words(5, 0), True),
        1_006: ("en", "s0", "\n".join(f"line {k} of text" if k < 4 else "again and so on" for k in range(20)) + words(4, 0), False),
    }
    rows += [(i, text, lang, source, 0) for i, (lang, source, text, _) in odd.items()]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].fence_word_length < got[1].fence_word_length and got[0].floor_word_length < got[1].floor_word_length
    assert all(got[i].kept for i in range(400))
    assert got[1_003].fence_symbol_rate == got[1_004].fence_symbol_rate == 120  # not a fence of its own
    for i, (*_, kept) in odd.items():
        assert got[i].kept == kept, got[i]


def test_labelled_documents(spark, given):
    """Documents labelled good stay unless the base rule drops them; those labelled bad go."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = quality_rules.judge(spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet")).collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert not any(r.kept for r in rows if labels.get(r.doc_id) == 0)


def test_native(spark, given):
    plan = quality_rules.judge(given)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shards(odd, nothing, given):
    for documents, n in ((odd, 8), (given, 8), (given, 3), (nothing, 8)):
        rows = sharding.shard(documents, n, keep=("lang",)).collect()
        total = documents.count()
        sizes = Counter(r["shard"] for r in rows)
        assert len(rows) == total and max(sizes.values(), default=0) - (min(sizes.values()) if len(sizes) == n else 0) <= 1
        for s in sizes:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_shards_do_not_depend_on_partitions(given):
    one = {r.doc_id: (r["shard"], r["slot"]) for r in sharding.shard(given.coalesce(1)).collect()}
    assert one == {r.doc_id: (r["shard"], r["slot"]) for r in sharding.shard(given.repartition(7)).collect()}
    assert one != {r.doc_id: (r["shard"], r["slot"]) for r in sharding.shard(given, seed=8).collect()}


def test_hypergeometric():
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, 30, 70, 20) for _ in range(8_000)])
    assert abs(drawn.mean() - 6) < 0.1 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert [sharding.hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (4, 4, 8), (3, 3, 0))] == [0, 3, 4, 0]
    assert abs(sharding.hypergeometric(rng, 5 * 10**10, 35 * 10**10, 5 * 10**7) - 6_250_000) < 30_000


def test_matrix():
    counts = [5, 0, 100, 33, 1]
    lines = sharding.communication_matrix(counts, 8, 3)
    assert [sum(line) for line in lines] == counts
    columns = [sum(c) for c in zip(*lines)]
    assert sum(columns) == 139 and max(columns) - min(columns) <= 1


# --- pipeline -------------------------------------------------------------------


def test_pipeline(spark, given):
    """Each stage is held to its operator on its own input."""
    import corpus_pipeline as pipeline
    from scholia.llm import decontaminate, jaccard

    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "decontamination", "secret_scan", "bpe"]
    stages = dict(pipeline.STAGES)
    docs, ids = given, lambda d: sorted(r.doc_id for r in d.collect())
    good = stages["quality_rules"](spark, docs, FOLDER)
    assert ids(good) == sorted(r.doc_id for r in quality_rules.judge(docs).collect() if r.kept)
    single = stages["ngram_jaccard"](spark, good, FOLDER)
    assert ids(single) == sorted(r.doc_id for r in jaccard.link(good).collect() if r.component_id == r.doc_id)
    clean = stages["decontamination"](spark, single, FOLDER)
    found = {r.doc_id for r in decontaminate.search(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert ids(clean) == [i for i in ids(single) if i not in found]
    safe = stages["secret_scan"](spark, clean, FOLDER)
    assert ids(safe) == ids(clean) and good.columns == single.columns == clean.columns == safe.columns == docs.columns
    assert not [r for r in safe.collect() if "AKIA" in r.text or r.n_chars != len(r.text)]
    out = pipeline.run(spark, FOLDER)
    assert ids(out) == ids(safe)


def test_pipeline_of_odd_rows(spark, odd, nothing):
    import corpus_pipeline as pipeline

    for docs in (odd, nothing):
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= {None, *range(1, 19)}


def test_entry(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()
