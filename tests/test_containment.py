"""Containment by rarest grams, against plain string search."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from scholia.operators.containment import GRAMS, contained_in, gram_filter, needle_grams, possible_grams, text_grams


def found(spark, needles, texts):
    rows = contained_in(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "id bigint, body string")
    ).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def plain(needles, texts):
    return {(n, i) for n in needles if n for i, body in texts if body and n in body}


def test_random_texts_equal_plain_search(spark):
    rng = random.Random(5)
    word = lambda lo, hi: "".join(rng.choice("ab é\n.*😀") for _ in range(rng.randint(lo, hi)))
    needles = [word(0, 12) for _ in range(80)] + ["", None, "(", "a.b", "😀😀", "ab"]
    texts = [(rng.randint(0, 30), word(0, 120)) for _ in range(90)] + [(7, None), (8, ""), (None, "ab ab")]
    texts += [texts[0], texts[0]]
    assert found(spark, needles, texts) == plain(needles, texts)


def test_long_bodies_and_needles(spark):
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    needles = [body[99_990:], body[50_000:50_007], body[:1], body[20_000:25_000], body[10:2_000] + "#"]
    texts = [(1, body), (2, body[::-1]), (3, body[60_000:])]
    assert found(spark, needles, texts) == plain(needles, texts)
    rows = text_grams(spark.createDataFrame([(1, 1, body)], "id int, print int, body string"))
    assert rows.count() <= len(GRAMS) * len(body)


def test_common_gram_is_not_the_key(spark):
    """A needle that shares a frequent gram with all texts is looked up by its rare one."""
    texts = [(i, "the common opening words") for i in range(500)] + [(999, "the common opening quartz")]
    needles = ["the common opening quartz", "opening words"]
    assert found(spark, needles, texts) == plain(needles, texts)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == set()
    assert found(spark, ["a"], []) == set()
    extra = spark.createDataFrame([("a", 1)], "needle string, id int")
    texts = spark.createDataFrame([(1, "cab", "x")], "id bigint, body string, needle string").withColumn("gram", F.lit("g"))
    assert [tuple(r) for r in contained_in(extra, texts).collect()] == [("a", 1)]


def test_filter_keeps_what_needles_have(spark):
    """Only grams of some needle become rows, where every gram of the text was one before."""
    body = "the quick brown fox 😀 jumps over the lazy dog é" * 50
    needles = spark.createDataFrame([("fox 😀 jumps",), ("é",), ("zz",), ("the",)], "needle string")
    cut = needle_grams(needles)
    texts = spark.createDataFrame([(1, 1, body), (2, 2, "")], "id int, print int, body string")
    rows = {r.gram for r in possible_grams(texts, gram_filter(cut)).collect()}
    wanted = {r.gram for r in cut.collect() if r.gram in body}
    assert wanted <= rows and len(rows) <= len(wanted) + 5 and len(wanted) < 10
