"""Texts longer than any limit that an operator once had: nothing of them is left out."""

from scholia.functions import lexicon
from scholia.functions import text as tx
from scholia.operators import extraction, structure
from scholia.operators import text as x


def test_chunks_without_cap(docs):
    body = "abcdefghij" * 500
    rows = x.fixed_chunks(docs(body), 100, 10).orderBy("chunk").collect()
    assert rows[0].body + "".join(r.body[10:] for r in rows[1:]) == body
    assert len(rows) > 50 and {r.coverage_pct for r in rows} == {100}
    assert x.fixed_chunks(docs(body), 100, 10, cap=3).count() == 3


def test_type_word_late_in_the_text(docs):
    from pyspark.sql import functions as F

    late = docs("plain words " * 400 + "problem set").withColumn("filename", F.lit("notes"))
    assert x.guess_material_type(late).first().type == "Assignment"


def test_every_evidence_sentence(docs):
    text = " ".join(f"Survey number {i} reported that study data differ." for i in range(100, 140))
    assert x.evidence_sentences(docs(text)).count() == 40
    assert x.cued_sentences(docs(text), x.EVIDENCE_CUES, 25, n=10).count() == 10


def test_long_captioned_table(docs):
    lines = "\n".join(f"name {i}     {i}     {i * i}" for i in range(60))
    cells = structure.text_tables(docs(f"Table 1: Squares\n{lines}\n\nafter")).collect()
    assert {c.title for c in cells} == {"Squares"} and {c.kind for c in cells} == {"captioned"}
    assert len({c.row for c in cells}) == 60


def test_relations_with_a_long_common_start(docs):
    start = "the long and winding history of the northern fishing harbours"
    text = f"{start} causes early decline.\n{start} causes late recovery."
    assert [r.effect for r in extraction.causal_relations(docs(text)).orderBy("rank").collect()] == ["early decline", "late recovery"]


def test_broken_words_are_merged_unless_turned_off(docs):
    assert x.clean_ocr(docs("this is a test")).first().cleaned == "this isa test"
    assert x.clean_ocr(docs("this is a test"), merge_single_letters=False).first().cleaned == "this is a test"


def test_word_lists_are_plain():
    assert len(lexicon.stop_words()) == len(set(lexicon.STOP_WORDS)) == 253
    assert tx.DOTTED.count("(") == 1 + sum(len(f.rstrip(".").split(".")) for f in tx.DOTTED_ABBREVIATIONS)


def test_dotted_abbreviations(docs):
    found = x.sentences(docs("A remark, i.e. a note, by a Ph.D. student of the U.K. is here. Another sentence follows it.")).collect()
    assert [r.sentence for r in found] == ["A remark, ie. a note, by a PhD. student of the UK. is here.", "Another sentence follows it."]


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    from scholia.streaming.sinks import read_upserted, upsert_writer

    path = str(tmp_path)
    write = upsert_writer(f"{path}/table", ["k"])
    write(spark.createDataFrame([(i, "a") for i in range(100)], "k long, v string"), 0)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    write(spark.createDataFrame([(3, "b"), (1000, "c")], "k long, v string"), 1)
    write(spark.createDataFrame([(3, "b"), (1000, "c")], "k long, v string"), 1)  # run again
    write(spark.createDataFrame([], "k long, v string"), 2)
    got = {r.k: r.v for r in read_upserted(spark, path).collect()}
    assert got == {**{i: "a" for i in range(100)}, 3: "b", 1000: "c"}
    changed = {p.parent.name for p, t in before.items() if not p.exists() or p.stat().st_mtime_ns != t}
    assert len({p.parent.name for p in before}) > 10 and len(changed) <= 2
