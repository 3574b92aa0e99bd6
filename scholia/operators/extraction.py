"""Information extraction: entities, formulas, definitions, references, reasoning.

Patterns run inside the document's row; only the counting of what they find
needs a shuffle, by (document, entity) or over the corpus. A slow pattern is
tried only on documents in which its cue word occurs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.functions import words as wx
from scholia.operators.structure import located
from scholia.operators.text import TOPIC_PHRASE

# --- entities: fixed values -------------------------------------------------

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
COUNTRIES = "United States|United Kingdom|South Africa|Zambia|Zimbabwe|Nigeria|Kenya|Ghana|Egypt|Morocco|Tanzania|Uganda|Ethiopia|Rwanda|Botswana|Namibia|Mozambique|Malawi|Angola|Cameroon|Senegal|Mali|Sudan|Tunisia|Algeria|Libya|China|Japan|India|Brazil|Russia|France|Germany|Spain|Italy|Portugal|Netherlands|Belgium|Switzerland|Austria|Sweden|Norway|Denmark|Finland|Poland|Greece|Turkey|Israel|Saudi Arabia|UAE|Qatar|Kuwait|Iran|Iraq|Pakistan|Bangladesh|Sri Lanka|Thailand|Vietnam|Philippines|Indonesia|Malaysia|Singapore|South Korea|North Korea|Taiwan|Hong Kong|Australia|New Zealand|Canada|Mexico|Argentina|Chile|Colombia|Peru|Venezuela|Cuba|Jamaica|Ireland|Scotland|Wales|Iceland"
CITIES = "Lusaka|Harare|Pretoria|Cape Town|Johannesburg|Durban|Nairobi|Lagos|Accra|Cairo|Casablanca|Dar es Salaam|Kampala|Addis Ababa|Kigali|Gaborone|Windhoek|Maputo|Lilongwe|Luanda|Yaoundé|Dakar|Khartoum|Tunis|Algiers|Tripoli|Beijing|Shanghai|Tokyo|Osaka|New Delhi|Mumbai|Bangalore|Brasilia|São Paulo|Moscow|St\\.? Petersburg|Paris|Berlin|Munich|Madrid|Barcelona|Rome|Milan|Lisbon|Amsterdam|Brussels|Zurich|Geneva|Vienna|Stockholm|Oslo|Copenhagen|Helsinki|Warsaw|Athens|Istanbul|Ankara|Tel Aviv|Riyadh|Dubai|Doha|Tehran|Baghdad|Karachi|Lahore|Dhaka|Colombo|Bangkok|Hanoi|Manila|Jakarta|Kuala Lumpur|Singapore|Seoul|Pyongyang|Taipei|Sydney|Melbourne|Auckland|Wellington|Toronto|Vancouver|Ottawa|Mexico City|Buenos Aires|Santiago|Bogotá|Lima|Caracas|Havana|Kingston|Dublin|Edinburgh|Cardiff|Reykjavik"
# (type, pattern, flags); every pattern has the entity in group 1
ENTITY_PATTERNS = [
    ("person", r"\b(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})\b", ""),
    ("person", r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b", ""),
    ("person", r"\b([A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+)\b", ""),
    (
        "organization",
        r"\b((?:University|Institute|College|School|Academy|Hospital|Foundation|Society|Association|Organization|Corporation|Corp|Inc|Ltd|LLC|Group|Agency|Bureau|Department|Ministry|Bank|Center|Centre|Laboratory|Lab)\s+(?:of\s+)?[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b",
        "",
    ),
    (
        "organization",
        r"\b([A-Z][a-zA-Z]+\s+(?:University|Institute|College|School|Corporation|Corp|Inc|Ltd|Foundation|Society|Association|Agency|Bureau|Bank|Center|Centre|Laboratory|Lab))\b",
        "",
    ),
    ("organization", r"\b((?:UN|EU|NATO|WHO|UNESCO|NASA|FBI|CIA|MIT|Oxford|Cambridge|Harvard|Stanford|Yale|Princeton))\b", ""),
    ("location", rf"\b((?:{COUNTRIES}))\b", ""),
    ("location", rf"\b((?:{CITIES}))\b", ""),
    (
        "location",
        r"\b((?:Mount|Lake|River|Ocean|Sea|Gulf|Bay|Strait|Channel|Island|Peninsula|Desert|Valley|Plateau|Mountain|Forest)\s+[A-Z][a-zA-Z]+)\b",
        "",
    ),
    ("date", rf"\b((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b", ""),
    ("date", rf"\b(\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}})\b", ""),
    ("date", r"\b((?:1[0-9]|[2-9][0-9])\d{2})\b", ""),
    ("date", r"\b(\d{1,2}(?:st|nd|rd|th)\s+century)\b", "i"),
    ("date", r"\b((?:19|20)\d{2}s)\b", ""),
    ("date", r"\b(BCE|CE|BC|AD)\b", ""),
    (
        "number",
        r"\b(\d+(?:\.\d+)?(?:\s*(?:%|kg|g|m|cm|mm|km|ft|in|lb|oz|°C|°F|K|Hz|W|kW|MW|J|kJ|N|Pa|kPa|MPa|V|A|Ω|mol|L|mL|s|ms|min|hour|day|year|ppm|ppb|dB|rad|cal|kcal|eV|MeV|GeV|mol|ph|bar|atm|torr|lux|cd))\b)",
        "",
    ),
    ("law", r"\b((?:[A-Z][a-z]+)'s\s+(?:Law|Principle|Rule|Equation|Theorem|Lemma|Constant))\b", ""),
    ("law", r"\b((?:Theory|Law|Principle|Rule|Equation|Theorem)\s+of\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b", ""),
    ("law", r"\b([A-Z][a-zA-Z]+\s+(?:Theory|Law|Principle|Effect|Paradox|Dilemma|Paradigm|Model|Framework))\b", ""),
    ("chemical", r"\b([A-Z][a-z]?\d*(?:[A-Z][a-z]?\d*)+)\b", ""),
    ("concept", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4})\b", ""),
    ("equation", r"\b((?:Equation|Formula|Expression)\s+(?:\d+|[A-Z][a-z]+))\b", ""),
]
UNITS = "m/s kg Newton Joule Watt Pascal Hertz Volt Ampere Ohm Coulomb Tesla Weber lumen candela mole Kelvin radian steradian decibel byte bit pixel".split()
# phrases of two words or more that are no names or concepts
COMMON_PHRASES = [
    "united states", "united kingdom", "south africa", "new york", "new zealand", "san francisco", "los angeles",
    "high school", "middle school", "primary school", "first time", "second time", "last time", "next time",
    "every time", "one another", "each other", "one day", "next day", "last day", "figure shows", "table shows",
    "graph shows", "chart shows", "as shown", "as discussed", "as mentioned", "as described", "as explained",
    "for example", "for instance", "in addition", "in contrast", "in fact", "in general", "in particular",
    "in summary", "in conclusion", "in other words", "on the other hand", "at the same time", "in the same way",
    "the first", "the second", "the third", "the last", "the next", "the following", "the above", "the below",
    "the former", "the latter",
]
CONCEPT_REPEATS, TERM_REPEATS = 2, 5


# every pattern starts with a capital or a digit at a word's start, so it is tried there alone
_WORD_STARTS = re.compile(r"[A-Z0-9](?<![A-Za-z0-9_].)")
_TRIED = [(step, re.compile(tx.rx(p), re.ASCII | (re.IGNORECASE if f else 0)).match) for step, (_, p, f) in enumerate(ENTITY_PATTERNS)]
_OF_DIGITS = {step for step, (_, p, _) in enumerate(ENTITY_PATTERNS) if re.match(r"\\b\((?:\\d|\(\?:1)", p)}
_BY_DIGIT = [t for t in _TRIED if t[0] in _OF_DIGITS]
_BY_CAPITAL = [t for t in _TRIED if t[0] not in _OF_DIGITS]
_UNIT = re.compile(tx.rx(r"\b(?:" + "|".join(UNITS) + r")\b"), re.ASCII | re.IGNORECASE)
_UNIT_STEPS = {u.lower(): (len(ENTITY_PATTERNS) + i, u) for i, u in enumerate(UNITS)}
_NAMED, _COMMON = ("person", "concept"), frozenset(COMMON_PHRASES)
MENTION = "step:int,pos:int,type:string,text:string"


def _mentions(text: str) -> list[tuple]:
    """Every pattern match of a text, by (step, pos): (step, pos, type, text)."""
    free, found = [0] * len(ENTITY_PATTERNS), [[] for _ in ENTITY_PATTERNS]
    for start in _WORD_STARTS.finditer(text):
        at = start.start()
        for step, match in _BY_DIGIT if text[at] <= "9" else _BY_CAPITAL:
            if at >= free[step] and (m := match(text, at)):
                free[step] = m.end()
                found[step].append(m.group(1))
    out = [
        (step, pos, ENTITY_PATTERNS[step][0], t)
        for step, texts in enumerate(found)
        for pos, t in enumerate(texts)
        if ENTITY_PATTERNS[step][0] not in _NAMED or t.lower() not in _COMMON
    ]
    lowered = text.lower()
    if any(u in lowered for u in _UNIT_STEPS):
        # no unit stands inside another one, so all are found in one pass
        units = [_UNIT_STEPS[m.lower()] for m in _UNIT.findall(text)]
        out += sorted((step, pos, "unit", u) for pos, (step, u) in enumerate(units))
    return out


def _entity_list(text: str) -> list[tuple]:
    """(type, key, text, frequency, first) of a text."""
    held: dict[tuple, list] = {}
    phrases: dict[str, list] = {}
    for step, pos, kind, t in _mentions(text):
        seen = phrases.setdefault(t, [0, (step, pos)]) if kind == "concept" else held.setdefault((kind, t.lower()), [t, 0, (step, pos)])
        seen[0 if kind == "concept" else 1] += 1
    for t, (n, first) in phrases.items():
        if n >= CONCEPT_REPEATS:
            held.setdefault(("concept", t.lower()), [t, 0, first])[1] += 1
    words = wx.content_list(text)
    often = [w for w, n in Counter(words).items() if n >= TERM_REPEATS]
    if often:
        last, counts = len(ENTITY_PATTERNS) + len(UNITS), Counter(words)
        for w in often:
            held["term", w] = [w, counts[w], (last, words.index(w))]
    return [(kind, key, t, n, dict(zip(("step", "pos"), first))) for (kind, key), (t, n, first) in held.items()]


def entity_mentions(docs: DataFrame) -> DataFrame:
    """Every pattern match: (doc_id, step, pos, type, text)."""
    return docs.select("doc_id", F.explode(wx.column(_mentions, f"array<struct<{MENTION}>>", "text")).alias("e")).select("doc_id", "e.*")


def entities(docs: DataFrame) -> DataFrame:
    """Entities per document with frequency, as (type, lower-case key), found and counted in the document's row.

    A phrase counts as a concept, once, when it occurs twice; a content word is
    a term when it occurs five times. ``first`` orders by where it was found.
    """
    kind = "array<struct<type:string,key:string,text:string,frequency:bigint,first:struct<step:int,pos:int>>>"
    return docs.select("doc_id", F.explode(wx.column(_entity_list, kind, "text")).alias("e")).select("doc_id", "e.*")


def surroundings(text: Column | str, start: Column, radius: int = 80, keep: int = 100) -> Column:
    left = F.greatest(start - radius, F.lit(0))
    return F.substring(tx.strip(F.substring(text, left + 1, start + radius - left)), 1, keep)


def entity_contexts(docs: DataFrame, kind: str, n: int = 3) -> DataFrame:
    """Text around the first n mentions of each entity of one kind."""
    parts = F.concat(*[located("text", p, f) for k, p, f in ENTITY_PATTERNS if k == kind])
    numbered = docs.select("doc_id", "text", F.posexplode(parts).alias("turn", "m"))
    order = W.partitionBy("doc_id", "key").orderBy("turn")
    return (
        numbered.select("doc_id", F.lower("m.match").alias("key"), "turn", surroundings("text", F.col("m.start")).alias("context"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("doc_id", "key", "rank", "context")
    )


def entity_index(found: DataFrame) -> DataFrame:
    return found.groupBy("type", "key").agg(
        F.count("*").alias("n_docs"), F.sum("frequency").alias("total")
    )


# --- formulas ---------------------------------------------------------------

FORMULA_STEPS = [
    (r"\$\$([^$]+)\$\$", r"\$+|\\\[\]|\\\]"),
    (r"\\\[([^\]]+)\\\]", r"\$+|\\\[\]|\\\]"),
    (r"\$([^$\n]+)\$", r"\$+|\\\(|\\\)"),
    (r"\\\(([^)]+)\\\)", r"\$+|\\\(|\\\)"),
]
CHEMICAL_EQUATION = r"(?:^|\s)((?:[A-Z][a-z]?\d*\s*(?:[→←⇌\->]+|reacts\s+with)\s*)+[A-Z][a-z]?\d*(?:\s*[→←⇌\->]+\s*[A-Z][a-z]?\d*)+)"
NAMED_LAW = r"((?:Newton|Ohm|Einstein|Coulomb|Kirchhoff|Boyle|Charles|Planck|Faraday|Lenz|Snell|Hooke|Stefan|Wien|Gauss|Ampere|Maxwell|Bernoulli|Archimedes|Pascal|Avogadro|Beer|Lambert)\s*(?:'s)?\s*(?:law|equation|principle|rule)?[^.\n]{5,100})"
FORMULA_CLASSES = [
    ("chemical", [(r"[A-Z][a-z]?\d*.*[→←⇌]", ""), (r"\b(?:H[2-9]?O|CO[2-9]?|NaCl|HCl|H[2-9]SO[2-9]|NaOH|KOH|CH[2-9]?|C[2-9]H[2-9]?|O[2-9]?|N[2-9]?|NH[2-9]?)\b", "")]),
    ("logic", [(r"[∧∨¬→↔⇒⇔∀∃]", ""), (r"\b(?:AND|OR|NOT|IMPLIES|IFF|XOR)\b", "i")]),
]
PHYSICS_SYMBOL = r"\b(?:c|m|g|G|h|k|e|F|E|p|v|a|t|T|P|V|I|R|Q|W|λ|ν|μ|σ|ε|ρ|ω|α|β|γ|θ|φ|ψ|τ|η|Φ|Ψ|Ω)\b.*[=≈]"
PHYSICS_UNIT = r"\b(?:m/s|kg|N|J|W|Pa|Hz|V|A|Ω|C|T|Wb|lm|cd|mol|K|°C|eV|dyn|erg|bar|atm|torr|cal|BTU|hp|dB|rad|sr)\b"
MATH_SIGN = r"[∑∫∏∂∇√∞±≈≠≤≥αβγδεζηθλμπρσφψω]"
MATH_ASSIGNMENT = r"[a-z]\s*[=]\s*[a-z0-9]"
# single letters that are too common to list as variables
COMMON_LETTERS = "a A I x y z n N t T f F g G k K c C v V p P E e m M r R s S h H d D u U w W l L i I j J q Q".split()


def formula_class(raw: Column) -> Column:
    out = None
    for name, patterns in FORMULA_CLASSES:
        test = F.lit(False)
        for pattern, flags in patterns:
            test = test | tx.matches(raw, pattern, flags)
        out = F.when(test, name) if out is None else out.when(test, name)
    return (
        out.when(tx.matches(raw, PHYSICS_SYMBOL) & tx.matches(raw, PHYSICS_UNIT), "physics")
        .when(tx.matches(raw, MATH_SIGN) | tx.matches(raw, MATH_ASSIGNMENT, "i"), "math")
        .otherwise("unknown")
    )


def formula_variables(raw: Column) -> Column:
    single = F.filter(tx.find_all(raw, r"\b([a-zA-Z])(?!\w)", 1), lambda v: ~v.isin(*COMMON_LETTERS))
    indexed = tx.find_all(raw, r"([a-zA-Z])_([a-zA-Z0-9])", 0)
    greek = tx.find_all(raw, r"[αβγδεζηθικλμνξπρστυφχψω]", 0)
    return F.array_distinct(F.concat(single, indexed, greek))


_SIGNED = [re.compile(p) for p in (r"[a-zA-Z][ \t\n\x0b\f\r]*=[ \t\n\x0b\f\r]*[a-zA-Z0-9]", r"[∑∫∏∂∇√∞±≈≠≤≥²³⁴⁵⁶⁷⁸⁹⁰]", r"[a-zA-Z][0-9]", r"[αβγδεζηθλμπρσφψωΔΣΠΩ]")]
_STEPS = [(re.compile(pattern, re.ASCII), re.compile(noise, re.ASCII)) for pattern, noise in FORMULA_STEPS]
_CHEMICAL, _LAW = re.compile(CHEMICAL_EQUATION, re.ASCII), re.compile(NAMED_LAW, re.ASCII | re.IGNORECASE)
_LAW_NAMES = NAMED_LAW.removeprefix("((?:").split(")", 1)[0].lower().split("|")


def _looks_like_formula(raw: str) -> bool:
    sides = raw.split("=")
    few = lambda s: len(wx.blank_split(s.strip(wx.BLANKS))) <= 4
    return len(raw) <= 100 and len(sides) == 2 and few(sides[0]) and few(sides[1]) and any(p.search(raw) for p in _SIGNED)


#: Characters of rows that leave a task at once.
BATCH_SIZE = 1_000_000


def _formula_matches(text: str) -> list[tuple[int, str, str]]:
    """(step, formula, as it stands in the text), step by step."""
    found = []
    for step, (pattern, noise) in enumerate(_STEPS):
        if "$" in text or "\\" in text:
            found += ((step, noise.sub("", m.group()).strip(wx.BLANKS), m.group()) for m in pattern.finditer(text))
    found = [f for f in found if len(f[1]) >= 2]
    found += ((4, raw, raw) for raw in wx.plain_formulas(text) if _looks_like_formula(raw))
    found += ((5, raw, raw) for m in _CHEMICAL.finditer(text) if len(raw := m.group().strip(wx.BLANKS)) >= 5)
    lowered = text.lower()
    if any(name in lowered for name in _LAW_NAMES):
        found += ((6, raw, raw) for raw in (m.group().strip(wx.BLANKS) for m in _LAW.finditer(text)))
    return found


_WHERE, _FOR = wx.ready(r"where\s+(.+?)(?:[.;]|\n)"), wx.ready(r"(?:formula|equation|expression)\s+for\s+(.+?)\s+(?:is|:)")
FOUND = "doc_id long, position int, step int, raw string, description string, context string"


def _formulas(text: str, first: int | None, known: bool) -> Iterator[tuple]:
    """(position, step, formula, description, context) of a text's formulas, the first of equal ones; the context is the first sentence with it."""
    held: dict[str, tuple] = {}
    for f in _formula_matches(text):
        held.setdefault(f[1].strip(wx.BLANKS).lower(), f)
    sents = wx.sentence_list(text) if held else []
    n = 0
    for position, (step, raw, near) in enumerate(held.values()):
        if n == first:
            return
        at = text.find(near)
        after = at + len(near)
        said = _WHERE.search(text[after : after + 300]) or _FOR.search(text[max(at - 200, 0) : at])
        context = next((s for s in sents if near in s), None)
        if not known or said or context is not None:
            n += 1
            yield position, step, raw, said and said.group(1).strip(wx.BLANKS), context


def formulas(docs: DataFrame, first: int | None = None, known: bool = False) -> DataFrame:
    """Formulas per document: inline and display math, plain, chemical, named laws.

    The context of a formula is the sentence that contains it; it may be as long as the text, so
    rows leave the task in small batches. Null and empty texts have none. ``first`` leaves out the later ones
    of a document, ``known`` those with neither description nor context.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = FOUND.replace(" long", "").replace(" int", "").replace(" string", "").split(", ")
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        batch_of = lambda held: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)], names)
        waiting, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                for f in _formulas(text.as_py() or "", first, known):
                    waiting.append((doc_id, *f))
                    size += len(f[2]) + len(f[4] or "") + 100
                    if size > BATCH_SIZE:
                        yield batch_of(waiting)
                        waiting, size = [], 0
        if waiting:
            yield batch_of(waiting)

    rows_ = docs.select("doc_id", "text").mapInArrow(rows, FOUND)
    raw = F.col("raw")
    kind = F.when(F.col("step") == 5, "chemical").when(F.col("step") == 6, "physics").otherwise(formula_class(raw))
    return rows_.select(
        "doc_id",
        "position",
        raw.alias("raw"),
        kind.alias("type"),
        F.when(F.col("step") == 5, F.array_distinct(tx.find_all(raw, r"[A-Z][a-z]?\d*", 0)))
        .otherwise(formula_variables(raw))
        .alias("variables"),
        "description",
        "context",
    )


def _math_matches(step: int, pattern: str, noise: str) -> Column:
    found = F.transform(
        tx.find_all("text", pattern, 0),
        lambda m, i: F.struct(
            F.lit(step).alias("step"), i.alias("i"), tx.strip(tx.sub(m, noise, "")).alias("raw"), m.alias("near")
        ),
    )
    return F.filter(found, lambda f: F.length(f["raw"]) >= 2)


# --- definitions and glossary -----------------------------------------------

DEFINITION_PATTERNS = [
    r"^(.+?)\s+(?:is|are)\s+defined\s+as\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+(.+)$",
    r"^(.+?)\s+refers?\s+to\s+(.+)$",
    r"^(.+?)\s+means?\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+(?:called|known\s+as|termed|referred\s+to\s+as)\s+(.+)$",
    r"^(.+?)\s+(?:consists|is\s+composed)\s+of\s+(.+)$",
    r"^(.+?)\s+(?:involves|includes|encompasses|comprises)\s+(.+)$",
    r"^(.+?)\s+can\s+be\s+defined\s+as\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+characterized\s+by\s+(.+)$",
    r"^the\s+definition\s+of\s+(.+?)\s+is\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+a\s+(?:type|form|kind|class|category|subset)\s+of\s+(.+)$",
    r"^(.+?)\s+represents?\s+(.+)$",
    r"^(.+?)\s+describes?\s+(.+)$",
    r"^(.+?)\s+denotes?\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+considered\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+used\s+(?:for|to|in)\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+based\s+on\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+responsible\s+for\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+measured\s+in\s+(.+)$",
    r"^(.+?)\s+(?:is|are)\s+expressed\s+(?:as|in|by)\s+(.+)$",
]
POINTING_WORDS = ["it", "they", "this", "that", "these", "those", "there", "here", "what", "which", "who"]


def _word_count(s: Column) -> Column:
    return F.size(F.split(s, r"\s+"))


def _definition(sentence: Column, pattern: str) -> Column:
    term = tx.strip(tx.extract(sentence, pattern, 1, "i"))
    meaning = tx.strip(tx.extract(sentence, pattern, 2, "i"))
    first = F.lower(F.get(F.split(term, r"\s+"), F.lit(0)))
    good = (
        F.length(term).between(3, 80)
        & (_word_count(term) <= 8)
        & ~tx.is_stop(first)
        & F.length(meaning).between(25, 250)
        & (_word_count(meaning) >= 4)
        & ~F.lower(term).isin(*POINTING_WORDS)
    )
    return F.when(good, F.struct(term.alias("term"), meaning.alias("definition")))


def definitions(docs: DataFrame) -> DataFrame:
    """Defined terms: per sentence the first pattern that passes its guards."""
    sized = docs.select(
        "doc_id",
        F.posexplode(wx.sentences("text")).alias("sent_idx", "sentence"),
    ).where(F.length("sentence").between(20, 300))
    found = sized.withColumn(
        "d", F.coalesce(*[_definition(F.col("sentence"), p) for p in DEFINITION_PATTERNS])
    ).where("d is not null")
    first = found.groupBy("doc_id", F.lower("d.term").alias("key")).agg(
        F.min_by(F.struct("sent_idx", "d.term", "d.definition", "sentence"), "sent_idx").alias("r")
    )
    return first.select("doc_id", "r.*")


GLOSSARY_PATTERNS = [
    (r"^(.+?)\s+(?:is|are)\s+defined\s+as\s+(.+?)[.;]", "m", r"defined"),
    (r"^(.+?)\s+refers?\s+to\s+(.+?)[.;]", "m", r"refers?\s+to"),
    (r"^(.+?)\s+means?\s+(.+?)[.;]", "m", r"means?"),
    (r"^(.+?)\s+(?:is|are)\s+(?:a|an|the)\s+(.+?)[.;]", "m", r"(?:is|are)\s+(?:a|an|the)"),
    (r"(?:definition\s+of)\s+(.+?)\s+is\s+(.+?)[.;]", "i", r"(?i)definition"),
]
NO_GLOSSARY_TERM = ["it", "this", "that", "these", "those", "there", "here"]


def _cued(pattern: str, flags: str, cue: str) -> Column:
    empty = F.array().cast("array<struct<start:int,match:string>>")
    return F.when(tx.matches("text", cue, "" if cue.startswith("(?") else "i"), located("text", pattern, flags)).otherwise(empty)


_GLOSSARY = [
    (
        re.compile(tx.rx(p) if "m" in f else wx.line_dots(p), re.ASCII | (re.MULTILINE if "m" in f else re.IGNORECASE)),
        re.compile(wx.line_dots(p), re.ASCII | (re.IGNORECASE if "i" in f else 0)),
        re.compile(cue.removeprefix("(?i)"), re.ASCII | re.IGNORECASE),
        "m" in f,
    )
    for p, f, cue in GLOSSARY_PATTERNS
]


def _from_lines(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches of a pattern that holds at line starts only."""
    at = 0
    while at < len(text):
        if found := pattern.match(text, at):
            yield found
            at = found.end() - 1
        at = text.find("\n", at) + 1 or len(text)


def _defined(text: str) -> dict[str, tuple[str, str]]:
    """Defined terms by lower-case form, first one kept: (term, definition)."""
    held: dict[str, tuple[str, str]] = {}
    for pattern, inner, cue, by_line in _GLOSSARY:
        if not cue.search(text):
            continue
        for found in _from_lines(pattern, text) if by_line else pattern.finditer(text):
            if not (m := inner.search(found.group())):
                continue
            one, two = m.group(1).strip(wx.BLANKS), m.group(2).strip(wx.BLANKS)
            if 3 <= len(one) <= 60 and 10 <= len(two) <= 250 and one.lower() not in NO_GLOSSARY_TERM:
                held.setdefault(one.lower(), (one, two))
    return held


def _glossary(text: str) -> list[tuple]:
    defined, out = _defined(text), []
    words = wx.keywords_of(text, 20) if defined else []
    for key, (term, meaning) in defined.items():
        low = meaning.lower()
        out.append((key, term, meaning, [k for k in words if k != key and k in low][:3]))
    lead = sorted((-n, first["step"], first["pos"], key, t) for kind, key, t, n, first in _entity_list(text) if kind in ("concept", "term"))[:10]
    bare: dict[str, str] = {}
    for *_, key, t in lead:
        bare.setdefault(key, t)
    for key, t in bare.items():
        if key not in defined:
            at = text.find(t)
            around = text[max(at - 80, 0) : at + 80].strip(wx.BLANKS)[:100] if at >= 0 else "Key term in this document."
            out.append((key, t, around, []))
    return out


def glossary(docs: DataFrame) -> DataFrame:
    """Defined terms plus the ten leading concepts and terms without a definition, made in the document's row."""
    kind = "array<struct<key:string,term:string,definition:string,related:array<string>>>"
    return docs.select("doc_id", F.explode(wx.column(_glossary, kind, "text")).alias("g")).select("doc_id", "g.*")


def _groups(step: int, found: Column, pattern: str, flags: str, one: int = 1, two: int = 2) -> Column:
    """Located matches -> struct(step, start, match, one, two) of trimmed groups."""
    inner = flags.replace("m", "")
    pick = lambda m, g: tx.strip(tx.extract(m, pattern, g, inner)) if g else F.lit("")
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(step).alias("step"),
            m["start"].alias("start"),
            m["match"].alias("match"),
            pick(m["match"], one).alias("one"),
            pick(m["match"], two).alias("two"),
        ),
    )


# --- references -------------------------------------------------------------

REFERENCE_SECTION = r"(?:^|\n)\s*(?:References|Bibliography|Works\s+Cited)\s*[:.]?\s*\n([\s\S]*?)(?:\n\s*(?:Appendix|Appendices|Acknowledg|Supplementary)|$)"
# (style, kind, pattern, group of authors, title, year, source, whole text)
REFERENCE_STYLES = [
    ("apa", "journal", r"([A-Z][a-z]+,\s+[A-Z]\.(?:\s*[A-Z]\.)?(?:,\s*&\s*[A-Z][a-z]+,\s+[A-Z]\.(?:\s*[A-Z]\.)?)*)\s*\((\d{4})\)\.\s*(.+?)\.\s*(.+?)\.", 1, 3, 2, 4, False),
    ("mla", "book", r"([A-Z][a-z]+(?:,\s+[A-Z][a-z]+)?)\.\s*\"(.+?)\"\.\s*(.+?),\s*(\d{4})\.", 1, 2, 4, 3, False),
    ("numeric", "unknown", r"\[(\d+)\]\s+([A-Z][^.\n]+)\.\s+([^.\n]+)\.\s*(?:(\d{4}))?", 2, 3, 4, 0, False),
    ("harvard", "journal", r"([A-Z][a-z]+,\s+[A-Z]\.(?:\s*[A-Z]\.)?)\s*(\d{4})\s+(.+?)\.\s*(.+?)\.", 1, 3, 2, 4, False),
    ("inline", "unknown", r"\(([A-Z][a-z]+(?:\s+et\s+al\.?)?,\s+(\d{4}))\)", 1, 0, 2, 0, True),
    ("url", "web", r"(https?://[^\s]+)", 0, 0, 0, 1, True),
]


def references(docs: DataFrame) -> DataFrame:
    """Citations per document by style; the reference list is used where there is one."""
    section = tx.extract("text", REFERENCE_SECTION, 1, "i")
    base = docs.select("doc_id", "text", F.when(section != "", section).otherwise(F.col("text")).alias("_refs"))

    def style(step: int, spec: tuple) -> Column:
        name, kind, pattern, author, title, year, source, whole = spec
        get = lambda m, g: F.nullif(tx.strip(tx.extract(m, pattern, g)), F.lit("")) if g else F.lit(None).cast("string")

        def authors(m: Column) -> Column:
            text = get(m, author)
            if name == "apa":
                return F.transform(F.split(text, r",\s*&\s*|,\s*"), tx.strip)
            if name == "numeric":
                return F.transform(F.split(text, r",\s*"), tx.strip)
            if name == "inline":
                return F.array(tx.strip(F.get(F.split(text, ","), F.lit(0))))
            if name == "url":
                return F.array().cast("array<string>")
            return F.array(text)

        return F.transform(
            tx.find_all("text" if whole else "_refs", pattern, 0),
            lambda m, i: F.struct(
                F.lit(step).alias("step"),
                i.alias("i"),
                m.alias("raw"),
                F.lit(name).alias("style"),
                F.lit(kind).alias("kind"),
                authors(m).alias("authors"),
                get(m, title).alias("title"),
                get(m, year).try_cast("int").alias("year"),
                get(m, source).alias("source"),
            ),
        )

    found = F.concat(*[style(i, spec) for i, spec in enumerate(REFERENCE_STYLES)])
    rows = base.select("doc_id", F.explode(found).alias("r")).select("doc_id", "r.*")
    first = rows.groupBy("doc_id", "raw").agg(
        F.min_by(F.struct("step", "i", "style", "kind", "authors", "title", "year", "source"), F.struct("step", "i")).alias("r")
    )
    return first.select("doc_id", "raw", "r.style", "r.kind", "r.authors", "r.title", "r.year", "r.source")


def citation_counts(refs: DataFrame) -> DataFrame:
    author = F.lower(F.get("authors", F.lit(0)))
    return refs.where(F.size("authors") > 0).groupBy(author.alias("author"), "year", "kind").agg(
        F.count("*").alias("citations"), F.count_distinct("doc_id").alias("n_docs")
    )


# --- causes, reasoning, inference -------------------------------------------

# (pattern, cause group, effect group, strength, cue)
CAUSAL_PATTERNS = [
    (r"(.+?)\s+causes?\s+(.+?)[.;]", 1, 2, "strong", r"\scauses?\s"),
    (r"(.+?)\s+leads?\s+to\s+(.+?)[.;]", 1, 2, "strong", r"\sleads?\s+to\s"),
    (r"(.+?)\s+results?\s+in\s+(.+?)[.;]", 1, 2, "strong", r"\sresults?\s+in\s"),
    (r"(.+?)\s+produces?\s+(.+?)[.;]", 1, 2, "moderate", r"\sproduces?\s"),
    (r"(.+?)\s+generates?\s+(.+?)[.;]", 1, 2, "moderate", r"\sgenerates?\s"),
    (r"(.+?)\s+(?:affects?|influences?)\s+(.+?)[.;]", 1, 2, "weak", r"\s(?:affects?|influences?)\s"),
    (r"(.+?)\s+(?:is|are)\s+caused\s+by\s+(.+?)[.;]", 2, 1, "strong", r"\scaused\s+by\s"),
    (r"(.+?)\s+(?:depends?|relies?)\s+on\s+(.+?)[.;]", 2, 1, "moderate", r"\s(?:depends?|relies?)\s+on\s"),
    (r"because\s+(?:of\s+)?(.+?),?\s+(.+?)[.;]", 1, 2, "strong", r"because\s"),
    (r"due\s+to\s+(.+?),?\s+(.+?)[.;]", 1, 2, "moderate", r"due\s+to\s"),
]
BOTH_WAYS = r"\b(?:conversely|vice\s+versa|similarly|likewise|in\s+turn)\b"


def causal_relations(docs: DataFrame) -> DataFrame:
    """Cause and effect pairs with strength; first of equal pairs per document."""
    found = wx.cued_groups("text", [(p, cue, c, e) for p, c, e, _, cue in CAUSAL_PATTERNS])
    strengths = F.array(*[F.lit(s) for _, _, _, s, _ in CAUSAL_PATTERNS])
    rows = docs.select("doc_id", "text", F.explode(found).alias("g")).where(
        F.length("g.one").between(5, 100) & F.length("g.two").between(5, 100)
    )
    left = F.greatest(F.col("g.start") - 100, F.lit(0))
    around = F.substring("text", left + 1, F.col("g.start") + F.length("g.match") + 100 - left)
    shaped = rows.select(
        "doc_id",
        F.struct("g.step", "g.start").alias("at"),
        F.col("g.one").alias("cause"),
        F.col("g.two").alias("effect"),
        F.get(strengths, F.col("g.step")).alias("strength"),
        tx.matches(around, BOTH_WAYS, "i").alias("bidirectional"),
    )
    key = tx.strip(F.lower(F.concat("cause", F.lit("→"), "effect")))
    first = shaped.groupBy("doc_id", key.alias("_k")).agg(
        F.min_by(F.struct("cause", "effect", "strength", "bidirectional", "at"), "at").alias("r")
    )
    order = W.partitionBy("doc_id").orderBy("r.at")
    return first.select(
        "doc_id", F.row_number().over(order).alias("rank"), "r.cause", "r.effect", "r.strength", "r.bidirectional"
    )


# (type, pattern, premise group, conclusion group, confidence, cue)
REASONING_PATTERNS = [
    ("conditional", r"if\s+(.+?),?\s+then\s+(.+?)[.;]", 1, 2, 0.85, r"if\s.*\sthen\s"),
    ("conditional", r"(.+?)\s+implies\s+(.+?)[.;]", 1, 2, 0.8, r"\simplies\s"),
    ("conditional", r"(.+?)\s+(?:leads?\s+to|results?\s+in)\s+(.+?)[.;]", 1, 2, 0.75, r"\s(?:leads?\s+to|results?\s+in)\s"),
    ("causal", r"(.+?)\s+causes?\s+(.+?)[.;]", 1, 2, 0.8, r"\scauses?\s"),
    ("causal", r"because\s+(.+?),?\s+(.+?)[.;]", 1, 2, 0.75, r"because\s"),
    ("causal", r"since\s+(.+?),?\s+(.+?)[.;]", 1, 2, 0.7, r"since\s"),
    ("causal", r"due\s+to\s+(.+?),?\s+(.+?)[.;]", 1, 2, 0.7, r"due\s+to\s"),
    ("causal", r"(.+?)\s+(?:is|are)\s+caused\s+by\s+(.+?)[.;]", 2, 1, 0.75, r"\scaused\s+by\s"),
    ("deductive", r"therefore\s*,?\s*(.+?)[.;]", 0, 1, 0.7, r"therefore"),
    ("inductive", r"(.+?)\s+suggests?\s+that\s+(.+?)[.;]", 1, 2, 0.65, r"\ssuggests?\s+that\s"),
    ("inductive", r"evidence\s+(?:shows?|indicates?|demonstrates?)\s+that\s+(.+?)[.;]", 0, 1, 0.7, r"evidence\s"),
    ("inductive", r"(?:studies?|research|data|experiments?)\s+(?:show|shows|indicate|indicates|demonstrate|demonstrates)\s+that\s+(.+?)[.;]", 0, 1, 0.7, r"\sthat\s"),
    ("inductive", r"(?:many|most|several|numerous|various)\s+(.+?)\s+(?:show|shows|demonstrate|demonstrates|indicate|indicates)\s+that\s+(.+?)[.;]", 1, 2, 0.6, r"\sthat\s"),
    ("abductive", r"(.+?)\s+can\s+be\s+explained\s+by\s+(.+?)[.;]", 1, 2, 0.6, r"\sexplained\s+by\s"),
    ("abductive", r"(.+?)\s+(?:may|might|could)\s+(?:be\s+due\s+to|result\s+from)\s+(.+?)[.;]", 1, 2, 0.55, r"\s(?:be\s+due\s+to|result\s+from)\s"),
    ("analogical", r"(.+?)\s+is\s+like\s+(.+?)[.;]", 1, 2, 0.5, r"\sis\s+like\s"),
    ("analogical", r"just\s+as\s+(.+?),?\s+(.+?)[.;]", 1, 2, 0.55, r"just\s+as\s"),
    ("analogical", r"(.+?)\s+is\s+similar\s+to\s+(.+?)[.;]", 1, 2, 0.5, r"\ssimilar\s+to\s"),
    ("analogical", r"(.+?)\s+is\s+analogous\s+to\s+(.+?)[.;]", 1, 2, 0.55, r"\sanalogous\s+to\s"),
]
FALLACIES = [
    ("Hasty generalization", r"(?:all|every|always|never)\s+\w+\s+(?:are|is|do|does)\s+"),
    ("Correlation-causation", r"(?:correlates?\s+with|associated\s+with).*(?:causes?|leads?\s+to|results?\s+in)"),
    ("Appeal to authority", r"(?:expert|authority|professor|scientist)\s+says?\s+"),
    ("False dichotomy", r"(?:either|only)\s+.+\s+or\s+.+(?:nothing|no\s+other)"),
    ("Slippery slope", r"(?:will\s+inevitably|will\s+ultimately|will\s+eventually)\s+lead\s+to"),
    ("Circular reasoning", r"(.+?)\s+(?:is|are)\s+(.+?)\s+because\s+(.+?)\s+(?:is|are)\s+"),
]
DATA_CUE = r"\b\d+(?:\.\d+)?%?\b"
CITATION_CUE = r"\[\d+\]|\(\w+\s+(?:et\s+al\.?\s+)?\d{4}\)"
STUDY_CUE = r"\b(?:study|studies|research|experiment|data|evidence|results?|findings?|shown|demonstrated|observed|measured)\b"


def reasoning_steps(docs: DataFrame) -> DataFrame:
    """Premise and conclusion by cue pattern, with confidence and fallacy flags.

    Evidence is a sentence with data, a citation or a study word that starts
    within 500 characters; two raise the confidence by .1, four by .15.
    """
    found = wx.cued_groups("text", [(p, cue, pre, con) for _, p, pre, con, _, cue in REASONING_PATTERNS])
    at = F.transform(
        wx.sentences("text"),
        lambda s: F.struct((F.position(s, F.col("text")) - 1).alias("start"), s.alias("s")),
    )
    # sentences are placed once per document, before its matches become rows
    ready = docs.where(F.length(tx.strip("text")) >= 50).select("doc_id", "text", F.filter(at, lambda s: s["start"] >= 0).alias("_s"), found.alias("_g"))
    rows = ready.select("doc_id", "_s", F.explode("_g").alias("g")).where(F.length("g.two") >= 5)
    home = F.get(
        F.filter(
            "_s",
            lambda s: (F.col("g.start") >= s["start"]) & (F.col("g.start") < s["start"] + F.length(s["s"])),
        ),
        F.lit(0),
    )["s"]
    cue = lambda s: tx.matches(s, DATA_CUE) | tx.matches(s, CITATION_CUE) | tx.matches(s, STUDY_CUE, "i")
    evidence = F.filter(
        "_s",
        lambda s: (F.abs(s["start"] - F.col("g.start")) <= 500)
        & (F.length(s["s"]) > 20)
        & (F.length(s["s"]) < 300)
        & cue(s["s"]),
    )
    kinds = F.array(*[F.lit(k) for k, *_ in REASONING_PATTERNS])
    base = F.array(*[F.lit(r[4]) for r in REASONING_PATTERNS])
    shaped = rows.select(
        "doc_id",
        F.struct("g.step", "g.start").alias("at"),
        F.get(kinds, F.col("g.step")).alias("type"),
        F.when(F.length("g.one") > 3, F.col("g.one")).otherwise("implicit").alias("premise"),
        F.col("g.two").alias("conclusion"),
        F.get(base, F.col("g.step")).alias("_c"),
        F.size(evidence).alias("n_evidence"),
        F.coalesce(home, F.col("g.match")).alias("inference"),
    )
    n = F.col("n_evidence")
    bonus = F.when(n >= 2, 0.1).otherwise(0.0) + F.when(n >= 4, 0.05).otherwise(0.0)
    flagged = shaped.select(
        "doc_id",
        "at",
        "type",
        "premise",
        "conclusion",
        F.round(F.least(F.lit(0.98), F.col("_c") + bonus), 6).alias("confidence"),
        "n_evidence",
        F.array_compact(
            F.array(*[F.when(tx.matches("inference", p, "i"), F.lit(name)) for name, p in FALLACIES])
        ).alias("fallacies"),
    )
    key = tx.strip(F.lower("conclusion"))
    first = flagged.groupBy("doc_id", key.alias("_k")).agg(
        F.min_by(F.struct(*[c for c in flagged.columns if c != "doc_id"]), "at").alias("r")
    )
    order = W.partitionBy("doc_id").orderBy("r.at")
    return first.select(
        "doc_id", F.row_number().over(order).alias("rank"), "r.type", "r.premise", "r.conclusion", "r.confidence",
        "r.n_evidence", "r.fallacies",
    )


def inferences(docs: DataFrame) -> DataFrame:
    """Sentence-level inference rules: modus ponens, generalisation, cause."""
    rows = docs.select("doc_id", F.posexplode(wx.sentences("text")).alias("sent_idx", "s"))
    s = F.col("s")
    ponens = tx.matches(s, r"if\s+.+\s+then\s+.+", "i") & tx.matches(s, "therefore", "i")
    so = r"(?:therefore|thus|hence|consequently)"
    general = tx.matches(s, rf"\b(?:many|most|all|every|several|numerous)\b.*\b{so}\b", "i")
    why = r"\b(?:because|since|due\s+to)\b"
    sides = F.split(s, tx.rx(why, "i"), -1)
    halves = F.split(s, tx.rx(so, "i"), -1)
    concluded = tx.extract(s, r"therefore\s+(.+?)[.;]", 1, "i")

    def rule(test: Column, name: str, kind: str, premises: Column, conclusion: Column) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(name).alias("rule"), F.lit(kind).alias("type"), premises.alias("premises"),
                conclusion.alias("conclusion"),
            ),
        )

    found = F.array_compact(
        F.array(
            rule(
                ponens, "Modus Ponens", "deductive",
                F.array(
                    tx.extract(s, r"if\s+(.+?),?\s+then", 1, "i"), tx.extract(s, r"then\s+(.+?),?\s+therefore", 1, "i")
                ),
                F.when(concluded != "", concluded).otherwise(s),
            ),
            rule(
                general, "Inductive Generalization", "inductive", F.array(tx.strip(F.get(halves, F.lit(0)))),
                F.coalesce(tx.strip(F.get(halves, F.lit(1))), s),
            ),
            rule(
                F.size(sides) == 2, "Causal Inference", "causal", F.array(tx.strip(F.get(sides, F.lit(1)))),
                tx.strip(F.get(sides, F.lit(0))),
            ),
        )
    )
    return rows.select("doc_id", "sent_idx", F.explode(found).alias("r")).select("doc_id", "sent_idx", "r.*")


PREREQUISITE_PATTERNS = [
    (r"(?:assuming|assume)\s+(?:knowledge\s+of\s+|familiarity\s+with\s+)?(.+?)[.;]", "assum"),
    (r"(?:recall\s+that|as\s+(?:discussed|mentioned|covered)\s+(?:earlier|before|previously))\s*:?\s*(.+?)[.;]", r"recall|\sas\s|^as\s"),
    (r"(?:prerequisite[s]?\s*[:.]\s*)(.+?)(?:\n|$)", "prerequisite"),
]
# one of these stands in what a pattern matches
PREREQUISITE_WORDS = [("assum",), ("recall", "discussed", "mentioned", "covered"), ("prerequisite",)]


def prerequisites(docs: DataFrame, topics: DataFrame | None = None, n: int = 5) -> DataFrame:
    """Knowledge a document assumes, by phrase; else its first key topic."""
    # the end of the text stands before its last line end, too
    end = r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"
    every = wx.cued_groups("text", [(p.replace("$", end), cue, 1, 0) for p, cue in PREREQUISITE_PATTERNS], PREREQUISITE_WORDS)
    ready = docs.where(F.length(tx.strip("text")) >= 50)
    # without topics from elsewhere all is made in the document's row
    own = wx.key_topics("text", TOPIC_PHRASE, 10) if topics is None else F.lit(None)
    found = ready.select("doc_id", every.alias("_every"), own.alias("_topics"))
    kept = F.filter("_every", lambda g: (F.length(g["one"]) > 3) & (F.length(g["one"]) < 80))
    both = found.withColumn("_named", F.array_distinct(F.transform(kept, lambda g: g["one"])))
    if topics is not None:
        both = both.drop("_topics").join(topics, "doc_id", "left")
    fallback = F.when(F.size("_topics") > 2, F.slice("_topics", 1, 1)).otherwise(F.array().cast("array<string>"))
    chosen = F.when(F.size("_named") > 0, F.slice("_named", 1, n)).otherwise(fallback)
    return both.select("doc_id", F.posexplode(chosen).alias("rank", "prerequisite"))


COURSE_CODE = r"\b([A-Z]{2,4})\s?(\d{3,4})\b"


def course_codes(docs: DataFrame) -> DataFrame:
    return (
        docs.select("doc_id", F.explode(tx.find_all("text", COURSE_CODE, 0)).alias("code"))
        .groupBy("doc_id", "code")
        .agg(F.count("*").alias("mentions"))
    )


def course_code_index(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count("*").alias("n_docs"), F.sum("mentions").alias("mentions"))


def answer_sentences(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Sentences of the asked document by number of question words they contain.

    Question words are longer than four characters and match as substrings.
    """
    every = F.filter(F.split(F.lower("question"), r"\s+"), lambda w: F.length(w) > 4)
    asked = questions.select("question_id", "doc_id", every.alias("_w"))
    held = asked.join(docs.select("doc_id", "text"), "doc_id").select("question_id", "doc_id", wx.sentence_hits("text", "_w").alias("_h"))
    scored = held.select("question_id", "doc_id", F.explode("_h").alias("h")).select("question_id", "doc_id", "h.*")
    order = W.partitionBy("question_id", "doc_id").orderBy(F.desc("hits"), "sent_idx")
    return scored.select(
        "question_id", "doc_id", F.row_number().over(order).alias("rank"), "sent_idx", "hits", "sentence"
    )


NO_ANSWER = "The document does not contain sufficient information to answer this question with high confidence."


def answers(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """One answer per question: a causal relation it names, else the best sentence."""
    causes = causal_relations(docs)
    word = lambda c: F.get(F.split(F.lower(c), r"\s+"), F.lit(0))
    named = questions.join(causes, "doc_id").where(
        F.lower("question").contains(word("cause")) | F.lower("question").contains(word("effect"))
    )
    by_cause = named.groupBy("question_id").agg(
        F.min_by(F.struct("cause", "effect", "strength", "bidirectional"), "rank").alias("r")
    )
    best = answer_sentences(questions, docs).where(F.col("rank") == 1).select("question_id", "sentence")
    verb = F.when(F.col("r.bidirectional"), " mutually affects ").otherwise(" causes ")
    strength = F.when(F.col("r.strength") == "strong", 0.8).when(F.col("r.strength") == "moderate", 0.6).otherwise(0.4)
    return (
        questions.select("question_id")
        .join(by_cause, "question_id", "left")
        .join(best, "question_id", "left")
        .select(
            "question_id",
            F.coalesce(F.concat("r.cause", verb, "r.effect"), "sentence", F.lit(NO_ANSWER)).alias("answer"),
            F.when(F.col("r").isNotNull(), strength).when(F.col("sentence").isNotNull(), 0.5).otherwise(0.1).alias("confidence"),
        )
    )
