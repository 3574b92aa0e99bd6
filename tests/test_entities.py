"""Entities and glossaries are found and counted in the document's row, as the patterns find them in Spark."""

from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.operators import extraction as ex

ODD = [
    None, "", " ", "é", "Dr. Jane Doe Smith met Jane Doe\nand J. Doe of São Paulo, Yaoundé and St. Petersburg. Jane Doe\tleft in 1999.",
    "University of Lusaka Press; Open University, Oxford_x aOxford Oxford. Ohm's Law, Law of Large Numbers, String Theory",
    "On 3 May 1990 and May 3, 1990 the 1800s, 19th CENTURY BC; 12.5 kg 3% 7°C 1.5.6 Hz 20 Ω 5s _9 kg NaCl H2O AAB Équation Equation 12",
    "Rain Water Rain Water rain water RAIN WATER " * 3 + "South Africa. One Day One Day; For Example For Example",
    "kg KG m/s M/S bit Kg mole_x mole", "A1B2 CO2\r\nNew York City", "İstanbul Ankara Tel Aviv",
]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_mentions_as_in_spark(docs):
    d = docs(*ODD)
    found = [F.struct(F.lit(step).alias("step"), tx.find_all("text", p, 1, f).alias("m")) for step, (_, p, f) in enumerate(ex.ENTITY_PATTERNS)]
    rows = d.select("doc_id", F.explode(F.array(*found)).alias("e"))
    want = rows.select("doc_id", "e.step", F.explode("e.m").alias("text")).collect()
    kinds = [k for k, _, _ in ex.ENTITY_PATTERNS]
    common = [r for r in want if kinds[r.step] in ("person", "concept") and r.text.lower() in ex.COMMON_PHRASES]
    got = ex.entity_mentions(d).where("type <> 'unit'").select("doc_id", "step", "text").collect()
    assert common
    assert sorted(map(tuple, want)) == sorted(map(tuple, got + common))


def test_no_shuffle(docs):
    d = docs(*ODD)
    assert exchanges(ex.entities(d)) == exchanges(ex.glossary(d)) == 0


def test_glossary(docs):
    text = (
        "Osmosis is the slow motion of water.\nA CELL\nrefers to the smallest unit of life; osmosis means a flow of salt water.\n"
        "It is a thing that nobody calls by name. The definition of drift is a slow move of sand.\nwater water water"
    )
    rows = {r.key: (r.term, r.definition, r.related) for r in ex.glossary(docs(text, None, "", "x means y")).collect()}
    assert rows["osmosis"] == ("Osmosis", "slow motion of water", ["slow", "motion"])
    assert rows["a cell"][1] == "the smallest unit of life" and "it" not in rows
    assert rows["drift"][:2] == ("drift", "a slow move of sand")
    assert rows["water"][0] == "water" and rows["water"][1].startswith("Osmosis is the slow motion of water.") and rows["water"][2] == []
