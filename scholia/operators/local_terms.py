"""Student shorthand and British spelling: detection and rewriting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.functions import words as wx
from scholia.operators.extraction import COURSE_CODE

# Fixed values: (category, {term: expansion}), in the order in which they apply.
LOCAL_TERMS = [
    ("shorthand", {"imp": "important", "imp.": "important"}),
    ("abbreviation", {"NB": "Note well (important)", "nb": "Note well (important)"}),
    ("shorthand", {
        "rev": "revise", "revise": "review this topic thoroughly", "rev.": "revise",
        "Likely Exam": "This is likely to appear in the examination",
        "Likely Exam.": "This is likely to appear in the examination",
    }),
    ("lecturer", {
        "Sir said": "The lecturer said", "Madam said": "The lecturer said", "Dr said": "The lecturer said",
        "Profe said": "The professor said",
    }),
    ("abbreviation", {
        "CA": "Continuous Assessment", "CA.": "Continuous Assessment", "Test": "class test", "Ass": "Assignment",
        "Ass.": "Assignment", "Asgmt": "Assignment", "Tut": "Tutorial", "Tut.": "Tutorial",
        "Lab": "Laboratory session", "Sem": "Seminar", "Lec": "Lecture", "Lec.": "Lecture",
        "HD": "High Distinction", "D": "Distinction", "CR": "Credit", "P": "Pass", "F": "Fail",
        "UNZA": "University of Zambia", "CBU": "Copperbelt University", "MUN": "Mulungushi University",
        "ZIALE": "Zambia Institute of Advanced Legal Education",
        "Examinations Council": "Examinations Council of Zambia (ECZ)", "ECZ": "Examinations Council of Zambia",
        "colour": "color", "behaviour": "behavior", "organise": "organize", "organised": "organized",
        "recognise": "recognize", "analyse": "analyze", "analysed": "analyzed", "centre": "center", "fibre": "fiber",
        "metre": "meter", "litre": "liter", "programme": "program", "catalogue": "catalog", "dialogue": "dialog",
        "favour": "favor", "honour": "honor", "labour": "labor", "neighbour": "neighbor", "flavour": "flavor",
        "tumour": "tumor", "defence": "defense", "offence": "offense", "licence": "license", "practise": "practice",
        "travelling": "traveling", "cancelled": "canceled", "labelled": "labeled", "modelling": "modeling",
    }),
    ("slang", {
        "kwacha": "Zambian Kwacha (currency)", "Kwacha": "Zambian Kwacha (currency)", "ngwee": "Ngwee (Zambian coin)",
        "insaka": "Insaka (traditional community gathering)",
        "ubuntu": "Ubuntu (African philosophy of humanity towards others)", "chibemba": "Bemba language",
        "cinyanja": "Nyanja (Chewa) language",
    }),
    ("shorthand", {
        "pp": "past examination paper", "pp.": "past examination paper", "Past paper": "past examination paper",
        "mock": "mock examination (practice exam)", "Mock": "mock examination (practice exam)",
    }),
    ("abbreviation", {
        "pre-req": "prerequisite", "co-req": "corequisite", "sem": "semester", "Sem": "semester",
        "Semester 1": "First Semester", "Semester 2": "Second Semester", "yr": "year", "Yr": "year",
        "1st yr": "First Year", "2nd yr": "Second Year", "3rd yr": "Third Year", "4th yr": "Fourth Year",
        "final yr": "Final Year", "Final yr": "Final Year",
    }),
    ("shorthand", {"w/": "with", "w/o": "without", "b/c": "because", "re:": "regarding"}),
    ("abbreviation", {"viz": "namely", "q.v.": "which see (cross-reference)", "cf": "compare", "vs": "versus"}),
]
PHRASE_RULES = [
    (r"\bSir said\b", "The lecturer said", "i"), (r"\bMadam said\b", "The lecturer said", "i"),
    (r"\bDr\.? said\b", "The lecturer said", "i"), (r"\bProf\.? said\b", "The professor said", "i"),
    (r"\bImportant CA\b", "Important Continuous Assessment", "i"),
    (r"\bCA\b(?=\s*(?:is|was|will|on|in|at|for|to)\b)", "Continuous Assessment", "i"),
    (r"\bLikely Exam\b", "This is likely to appear in the examination", "i"),
    (r"\bNB\b(?![a-z])", "Note well (important)", ""), (r"\bimp\.", "important", "i"),
]
KEEP_CASE = ("abbreviation", "shorthand")

Term = tuple[str, str, str]  # term, expansion, category


def default_terms() -> list[Term]:
    return [(t, e, c) for c, group in LOCAL_TERMS for t, e in group.items()]


def _pattern(term: str) -> str:
    return r"\b" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term) + r"\b"


def _flags(category: str) -> str:
    return "" if category in KEEP_CASE else "i"


def _compiled(pattern: str, flags: str) -> re.Pattern:
    return re.compile(tx.rx(pattern), re.ASCII | (re.IGNORECASE if flags == "i" else 0))


#: What a text must hold, in lower case, for each of PHRASE_RULES to be tried.
PHRASE_CUES = ["sir said", "madam said", "said", "said", "important ca", "ca", "likely exam", "nb", "imp."]


def _rewritten(terms: Sequence[Term]) -> Column:
    """struct(text, expansions): the rewritten text, and the terms of the text, once per lower-case form.

    A rule's pattern is only tried on a text that holds its letters.
    """
    rules = [(t.lower(), _compiled(_pattern(t), _flags(c)), e, c) for t, e, c in terms]
    phrases = [(cue, _compiled(p, f), e) for cue, (p, e, f) in zip(PHRASE_CUES, PHRASE_RULES, strict=True)]

    def rewrite(text: str) -> dict:
        lowered, found = text.lower(), {}
        for cue, pattern, expansion, category in rules:
            hit = pattern.search(text) if cue in lowered else None
            if hit:
                found.setdefault(hit.group().lower(), (hit.group(), expansion, category))
        for cue, pattern, expansion, category in rules:
            if category != "slang" and cue in lowered:
                text, n = pattern.subn(lambda m, e=expansion: e, text)
                lowered = text.lower() if n else lowered
        for cue, pattern, expansion in phrases:
            if cue in lowered:
                text = pattern.sub(lambda m, e=expansion: e, text)
                lowered = text.lower()
        return {"text": text, "expansions": [dict(zip(("original", "expanded", "category"), f)) for f in found.values()]}

    return wx.column(rewrite, f"struct<text:string,expansions:{EXPANSIONS}>", "text")


EXPANSIONS = "array<struct<original:string,expanded:string,category:string>>"


def normalise_local_terms(docs: DataFrame, terms: Sequence[Term] | None = None) -> DataFrame:
    """Rewritten text, the expansions made, course codes, and a confidence.

    Slang is reported but stays in the text. The dictionary is a fixed, short
    list, so its rules are part of the plan and nothing is joined.
    """
    terms = list(terms) if terms is not None else default_terms()
    marked = docs.select("doc_id", "text", _rewritten(terms).alias("_r"))
    codes = tx.find_all("text", COURSE_CODE, 0)
    words = F.greatest(F.size(F.split("text", r"\s+")), F.lit(1))
    n = F.size("expansions") + F.size("course_codes")
    return (
        marked.withColumn("expansions", F.coalesce("_r.expansions", F.array().cast(EXPANSIONS)))
        .withColumn("course_codes", codes)
        .select(
            "doc_id",
            F.col("_r.text").alias("text"),
            "expansions",
            "course_codes",
            F.round(F.greatest(F.lit(0.5), 1 - n / words * 0.1), 6).alias("confidence"),
        )
    )


def has_local_patterns(docs: DataFrame, terms: Sequence[Term] | None = None) -> DataFrame:
    """Whether any term (in any case) or course code occurs."""
    terms = list(terms) if terms is not None else default_terms()
    forms = dict.fromkeys(t.lower() for t, _, _ in terms)
    every = r"\b(?:" + "|".join(_pattern(t)[2:-2] for t in forms) + r")\b"
    return docs.select(
        "doc_id",
        (tx.matches(F.lower("text"), every) | tx.matches("text", COURSE_CODE)).alias("has_local_patterns"),
    )
