"""Operators 2, 5, 7 and 9: base rules against brute force, models by held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import decontaminate, language, quality_model, secret_scan
from tests.llm.conftest import FOLDER

BIG = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


# --- secrets ------------------------------------------------------------------


def base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def test_base_findings(odd, spark):
    texts = ["secret=token:abcdefg", "PassWord='a.b-c=d'", "token=ab token=abcdef", "AKIA" + "A" * 15, "xAKIA" + "Z" * 16 + "-", "ſecret=abcdefg", "ab12" * 6, None]
    more = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    for documents in (odd, more):
        got = secret_scan.scan(documents, None).collect()
        want = sorted((r.doc_id or 0, base(r.text or "")) for r in documents.collect())
        assert sorted((r.doc_id or 0, [tuple(f) for f in r.findings]) for r in got) == want


def test_redacted(odd):
    kept = secret_scan.redact(secret_scan.scan(odd, None, keep=("text", "lang")))
    got = {r.doc_id: r.text for r in kept.collect()}
    marked = secret_scan.scan(odd, None, keep=("text", "lang"), mark="[secret]")
    assert sorted(map(str, marked.select("doc_id", "text").collect())) == sorted(map(str, kept.select("doc_id", "text").collect()))
    assert got[17] == "[secret] and [secret]".replace("[secret] and", '[secret]" and')
    assert got[18] == "[secret] token=abc [secret]"
    assert got[8] == "one two" and got[5] == "" and got[6] == ""


def test_no_network_without_findings(odd, nothing):
    assert secret_scan.learn(nothing) is None and secret_scan.learn(odd.where("doc_id < 17")) is None
    assert secret_scan.scan(nothing, None).count() == 0


def test_network(spark):
    """With its own threshold it finds secrets that no base pattern knows, planted in another table, and leaves the rest alone."""
    net = secret_scan.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rng, words = np.random.default_rng(9), ["river", "meadow", "hammer", "violet"]
    rows, planted = [], {}
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect() if r.text]
    for k, (i, t) in enumerate(texts):
        shape = list(secret_scan.SHAPES)[k % len(secret_scan.SHAPES)]
        x, lead = secret_scan.secret(shape, words, rng), ["pwd: ", 'auth_value = "', "login="][k % 3]
        at = t.find(" ", len(t) // 2) + 1
        planted[i] = (at + len(lead), x)
        rows.append((i, t[:at] + lead + x + " " + t[at:]))
    found = {r.doc_id: [tuple(f) for f in r.findings] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    hit = [any(a <= at < b for _, a, b in found[i]) for i, (at, _) in planted.items()]
    assert np.mean(hit) >= 0.9 and sum(k == "model" for f in found.values() for k, _, _ in f) >= 500
    wrong = [i for i, f in found.items() if any(k == "model" and not planted[i][0] - 20 <= a <= planted[i][0] + 20 for k, a, _ in f)]
    assert len(wrong) <= 0.02 * len(rows)
    long = "x" * 20 + "Ab3/" * 400_000  # a candidate of 1.6 MB is looked at whole
    pad = "just plain words here " * 3
    got = secret_scan.scan(spark.createDataFrame([(1, pad + long + " " + pad), (2, pad * 20_000)], "doc_id long, text string"), net).collect()
    assert [(f.start, f.end) for f in got[0].findings] == [(len(pad), len(pad) + len(long))] and not got[1].findings
    both = net.pooled([secret_scan.shown("a b", "secretvalue1", " c"), secret_scan.shown("", "q" * 100_000, "")])
    assert np.allclose(both[:1], net.pooled([secret_scan.shown("a b", "secretvalue1", " c")]))


def test_network_from_rare_findings(spark, monkeypatch):
    """Findings in few of many documents still give a network, as all documents are looked at."""
    monkeypatch.setattr(secret_scan, "SHOWN", 400)
    rows = [(i, f"order 2024-01-{i % 28:02}-{i:012} was sent by host{i:013}.example", ) for i in range(3_000)]
    rows += [(10_000 + i, f"password: {hashlib.sha1(str(i).encode()).hexdigest()[:20]} end") for i in range(30)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert secret_scan.learn(documents, sample=300) is not None
    assert secret_scan.learn(documents.where("doc_id < 10002"), sample=300) is None


def test_candidates():
    """Short and all-letter values after a sign or quote are candidates, and every base finding is a label."""
    shown = lambda t: [t[a:b] for a, b in secret_scan.candidates(t)]
    assert shown("pwd: Hunter2abc") == ["Hunter2abc"] and shown("key = 'correcthorsebattery'") == ["correcthorsebattery"]
    assert shown("word=abcde, plain words of prose") == [] and shown("pin=abc123def456ghi789 x") == ["pin=abc123def456ghi789"]
    assert [x[2] for x in secret_scan.labelled("AKIA" + "B" * 16 + " " + "abcdef" * 4)] == [True, True]
    cover = secret_scan.Cover([(3, 5), (4, 9), (20, 21)])
    met = lambda a, b: any(c < b and a < d for c, d in [(3, 5), (4, 9), (20, 21)])
    assert all(cover.meets(a, b) == met(a, b) for a in range(24) for b in range(a + 1, 25))


def test_secrets_query(spark):
    from scholia.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op2_secrets"](spark, FOLDER).collect():
        want = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


# --- language -----------------------------------------------------------------


def test_language(spark):
    documents = spark.read.parquet(f"{BIG}/documents.parquet")
    got = {r.doc_id: r for r in language.predict(documents, language.learn(documents)).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in documents.collect() if crc(r.doc_id) % 4 == 2]
    assert all(got[i].held_out == (crc(i) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_language_odd(odd, nothing):
    model = language.learn(odd)
    got = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert got[5].lang_pred == got[6].lang_pred == got[7].lang_pred == "und" and got[5].score == 0
    assert not got[None].held_out and got[1].lang_pred in ("en", "de", "fr")
    empty = language.learn(nothing)
    assert language.predict(nothing, empty).count() == 0
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}


# --- quality ------------------------------------------------------------------


def test_quality(spark):
    documents, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_model.score(documents, labels).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if crc(r.doc_id) % 5 == 0]
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    assert np.mean([q == r.predicted for q, r in held]) >= 0.95


def test_quality_odd(odd, nothing, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 19)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality_model.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert {r.score for r in quality_model.score(odd, none).collect()} == {0.5}
    assert quality_model.score(nothing, labels).count() == 0


def test_statistics_by_hand():
    import pyarrow as pa

    from scholia.llm.common import as_texts

    x = dict(zip(quality_model.FEATURES, quality_model.statistics(as_texts(pa.array(["a a b!\nA1 é\na a b!", "", "w " * 16])))[0]))
    assert x["words"] == pytest.approx(np.log1p(8)) and x["distinct_words"] == pytest.approx(4 / 8)
    assert x["adjacent_repeats"] == pytest.approx(np.sqrt(2 / 8)) and x["top_word"] == pytest.approx(np.sqrt(4 / 8))
    assert x["exclaims"] == pytest.approx(np.sqrt(2 / 8)) and x["repeated_lines"] == pytest.approx(np.sqrt(1 / 3))


# --- benchmark passages ---------------------------------------------------------


def test_passages(spark):
    documents, benchmark = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(documents, benchmark).collect()}
    loose = lambda t: " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()))
    items = {r.item_id: loose(r.text) for r in benchmark.collect()}
    texts = {r.doc_id: loose(r.text) for r in documents.collect()}
    want = {(d, i) for d, t in texts.items() for i, p in items.items() if p in t}
    assert want <= got and len(got - want) <= 0.05 * len(got)


def test_paraphrase_and_blocks(spark, given):
    item = "Seven bright kestrels circled above the abandoned observatory while torrential moonlight painted every crumbling parapet silver. Nobody answered the telephone."
    edited = item.replace("bright ", "").replace("abandoned", "derelict").replace("painted", "slowly painted").upper()
    filler = "plain words that say little about birds " * 30
    rows = [(1, filler + item + filler), (2, filler + edited + filler), (3, filler), (4, None), (5, ""), (1, filler + item + filler)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").unionByName(given.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    for block in (1_000, 1):
        got = {(r.doc_id, r.item_id) for r in decontaminate.search(documents, benchmark, block).collect()}
        assert got == {(1, 7), (2, 7)}


def test_long_passages(spark, given):
    """Items far longer than a window: whole and in large part they are found, a smaller part is not."""
    words = [f"{a}{b}{c}" for a in "bdfgklmnprstv" for b in ("ain", "el", "ior", "om", "un") for c in ("dax", "fep", "gim", "lor", "nuv", "tas", "zek", "wib")]
    rng = np.random.default_rng(5)
    items = {n: [str(w) for w in rng.choice(words, n)] for n in (170, 300, 500, 2_000)}
    filler = "plain words that say little about birds " * 30
    rows = [(n, filler + " ".join(w) + " " + filler) for n, w in items.items()]
    rows += [(10_000 + n, filler + " ".join(w[n // 5 : n // 5 + n * 3 // 5]) + " " + filler) for n, w in items.items()]
    rows += [(20_000 + n, filler + " ".join(w[: n // 5]) + " " + filler) for n, w in items.items()]
    documents = spark.createDataFrame(rows, "doc_id long, text string").unionByName(given.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    for block in (1_000, 1):
        got = {(r.doc_id, r.item_id) for r in decontaminate.search(documents, benchmark, block).collect()}
        assert got == {(n, n) for n in items} | {(10_000 + n, n) for n in items}


def test_short_and_unnamed_passages(spark):
    """Items under eight words are found as a run of all their words; items without an id are searched too."""
    item = "Seven bright kestrels circled above the abandoned observatory while torrential moonlight painted every crumbling parapet silver."
    filler = "plain words that say little about birds " * 30
    texts = [filler + "Quo vadis, DOMINE? " + filler, filler + "quo domine vadis " + filler, filler + item, filler + "axolotl", "quo vadis", None, "domine", "Quo\nvadis domine and an axolotl quo vadis domine"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    short = [(1, "Quo vadis, domine?"), (2, "axolotl"), (3, "vadis domine"), (4, " ?! "), (5, None), (None, None), (1, "axolotl")]
    want = {(0, 1, 0.0), (0, 3, 0.0), (3, 2, 0.0), (3, 1, 0.0), (7, 1, 0.0), (7, 2, 0.0), (7, 3, 0.0)}
    for rows, more in ((short, set()), ([*short, (None, item), (None, item + " Nobody")], {(2, None, 1.0)})):
        benchmark = spark.createDataFrame(rows, "item_id long, text string")
        for block in (1_000, 1):
            got = decontaminate.search(documents, benchmark, block).collect()
            assert len(got) == len(want | more)
            assert {(r.doc_id, r.item_id, float(r.cosine is not None)) for r in got} == want | more
            place = {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in got}
            assert place[0, 1] == (210, 213) and place[7, 3] == (1, 3)


def test_passages_of_nothing(nothing, odd, spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search(odd, benchmark).count() == 0
    some = spark.createDataFrame([(1, "a passage of at least eight words that is nowhere")], "item_id long, text string")
    assert decontaminate.search(nothing, some).count() == 0
    assert decontaminate.search(odd, some).count() == 0


def test_common_subsequence():
    assert decontaminate.common_subsequence([1, 2, 3, 4], [1, 9, 3, 4, 2]) == 3
    assert decontaminate.common_subsequence([1, 1, 2], [1, 2, 1, 2]) == 3
    assert decontaminate.common_subsequence([5], []) == 0


def test_places_behind_long_gaps(spark):
    """An item behind 100,000 words that no item has is reported where it is."""
    item = " ".join(f"item{k}" for k in range(30))
    rows = [(n, " ".join(f"u{k}" for k in range(n)) + " " + item) for n in (1_000, 70_000, 100_000)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.search(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted(r.doc_id for r in got) == [1_000, 70_000, 100_000]
    assert all(r.doc_id - 48 <= r.first_word <= r.doc_id + 30 for r in got), [(r.doc_id, r.first_word) for r in got]
