"""Column expressions for text: one document or word in, one value out.

Everything here is a native Spark expression, evaluated inside the row, so a
text operator that needs only its own document never shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions import lexicon

# ASCII word boundary. Java's own \b is Unicode-aware in Java 17.
_EDGE = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)


_BEFORE_WORD = r"(?<![A-Za-z0-9_])"
_STARTS = re.compile(r"(^|\(\?:|\|)\\b(?=[A-Za-z0-9\[(]|\\d|\\w)(?!\(\\d\+%\)\?)")


def rx(pattern: str, flags: str = "") -> str:
    """Portable pattern -> Java pattern: ASCII word edges, Unix line ends.

    An edge that opens an alternative whose first character is a word
    character needs only the look-behind.
    """
    body = _STARTS.sub(lambda m: m.group(1) + _BEFORE_WORD, pattern)
    body = body.replace(r"\b", _EDGE)
    flags = "d" + flags if "m" in flags and "d" not in flags else flags
    return f"(?{flags}){body}" if flags else body


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def matches(col: Column | str, pattern: str, flags: str = "") -> Column:
    return F.coalesce(_c(col).rlike(rx(pattern, flags)), F.lit(False))


def sub(col: Column | str, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(_c(col), F.lit(rx(pattern, flags)), F.lit(replacement))


def find_all(col: Column | str, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(_c(col), F.lit(rx(pattern, flags)), group)


def extract(col: Column | str, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract(_c(col), rx(pattern, flags), group)


def strip(col: Column | str) -> Column:
    return sub(col, r"^\s+|\s+$", "")


def replace_inside(col: Column | str, pattern: str, fix: Callable[[Column], Column]) -> Column:
    """Replace every match by a function of the match (no row-level Python)."""
    text = _c(col)
    between = F.split(text, rx(pattern), -1)
    found = F.regexp_extract_all(text, F.lit(rx(pattern)), 0)
    return F.array_join(
        F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(fix(b), F.lit("")))),
        "",
    )


def one_of(col: Column, words: Sequence[str]) -> Column:
    return col.isin(*words)


# --- tokens -----------------------------------------------------------------


def tokens(col: Column | str) -> Column:
    """Lower-case ASCII tokens longer than one character, in order."""
    plain = sub(F.lower(_c(col)), r"[^a-z0-9\s'\-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 1)


def is_stop(word: Column) -> Column:
    return one_of(word, lexicon.stop_words())


def is_content(word: Column) -> Column:
    return (F.length(word) > 2) & ~is_stop(word)


def content_tokens(col: Column | str) -> Column:
    return F.filter(tokens(col), is_content)


def whitespace_words(col: Column | str) -> Column:
    return F.filter(F.split(_c(col), r"\s+"), lambda w: F.length(w) > 0)


# --- stems ------------------------------------------------------------------
# Suffix rules of the Porter variant. Each stage keeps the
# shortest stem of the stated length, so the longest suffix of a stage wins;
# "#" marks a word that a stage has already changed.
STEM_STAGES = [
    (r"(ss|i)es$|([^s])s$", r"\1\2"),
    (r"^(.{2,}ee)d$|^(.{3,}?)ed$|^(.{3,})ing$", r"\1\2\3"),
    (r"^(.{3,})y$", r"\1i"),
    (
        r"^(.{3,}?)(?:(at)(?:ional|ion|or)|(enc)i|(anc)i|(iz)(?:er|ation)|(abl)i|(iv)iti)$",
        r"\1\2\3\4\5\6\7e#",
    ),
    (r"^(.{3,}?)biliti$", r"\1ble#"),
    (r"^(.{3,}?)lessli$", r"\1less#"),
    (
        r"^(.{3,}?)(?:(tion)al|(al)(?:li|ism|iti)|(ent)li|(e)li|(ous)(?:li|ness)|(ive)ness"
        r"|(ful)(?:ness|li)|(log)i)$",
        r"\1\2\3\4\5\6\7\8\9#",
    ),
    (r"#$", r""),
    (r"^(.{3,}?)(?:(ic)(?:ate|iti|al)|ative|(al)ize|ful|ness|ous)$", r"\1\2\3"),
    (
        r"^(.{4,}?)(?:al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ou|ism|ate|iti|ous|ive|ize)$",
        r"\1",
    ),
    (r"^(.{4,})e$", r"\1"),
]


def stem(col: Column | str) -> Column:
    word = F.lower(strip(col))
    out = word
    for pattern, replacement in STEM_STAGES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement.replace("\\", "$")))
    out = F.regexp_replace(out, F.lit(r"^(.{2,})([^lszf])\2$"), F.lit("$1$2"))
    return F.when(F.length(word) <= 3, word).otherwise(out)


# --- sentences --------------------------------------------------------------
# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = """
Mr Mrs Ms Dr Prof Sr Jr St vs etc No vol Fig Eq Ref Ch Sec pp al ca cf approx max min avg resp nr dept inc
ltd co corp
""".split()
DOTTED_ABBREVIATIONS = {
    "i.e.": "ie", "e.g.": "eg", "U.S.": "US", "U.K.": "UK", "U.N.": "UN",
    "Ph.D.": "PhD", "B.Sc.": "BSc", "M.Sc.": "MSc", "B.A.": "BA", "M.A.": "MA",
}
# The table as one pattern: each part is a group, so the letters are kept and the inner stops go.
_DOTTED_PARTS = [form.rstrip(".").split(".") for form in DOTTED_ABBREVIATIONS]
DOTTED = r"\b(?:" + "|".join(r"\.".join(f"({part})" for part in parts) for parts in _DOTTED_PARTS) + r")\."
DOTTED_KEPT = "".join(f"${i}" for i in range(1, sum(map(len, _DOTTED_PARTS)) + 1))
DOT, CUT = "<DOT>", "<SPLIT>"
INLINE_MATH = r"\$[^$]+\$"
SENTENCE_OPENERS = "A-Z\"'(\\["


def sentences(col: Column | str) -> Column:
    """Sentences longer than 15 characters, in order."""
    text = _c(col)
    text = sub(text, DOTTED, DOTTED_KEPT + DOT)
    text = sub(text, r"\b(" + "|".join(ABBREVIATIONS) + r")\.", "$1" + DOT)
    text = sub(text, r"\b(\d+)\.(\d+)", "$1" + DOT + "$2")
    text = sub(text, r"(\d)\.(\d)", "$1" + DOT + "$2")
    text = replace_inside(text, INLINE_MATH, lambda m: F.replace(m, F.lit("."), F.lit(DOT)))
    text = sub(text, rf"([.!?])\s+(?=[{SENTENCE_OPENERS}])", "$1" + CUT)
    text = sub(text, r"([.!?])\s*$", "$1" + CUT, "m")
    parts = F.transform(F.split(text, CUT), lambda s: strip(F.replace(s, F.lit(DOT), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) > 15)


# --- words ------------------------------------------------------------------


def syllables(col: Column | str) -> Column:
    word = F.lower(strip(col))
    core = sub(sub(word, r"(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), r"^y", "")
    count = F.greatest(F.regexp_count(core, F.lit(r"[aeiouy]{1,2}")), F.lit(1))
    return F.when(F.length(word) <= 3, F.lit(1)).otherwise(count)


def word_category(word: Column) -> Column:
    rules = lexicon.tagging_rules()
    out = F.when(one_of(word, rules[0][1]), F.lit(rules[0][0]))
    for name, words in rules[1:]:
        out = out.when(one_of(word, words), F.lit(name))
    for name, suffixes in lexicon.SUFFIX_GUESSES:
        out = out.when(word.rlike("(?:" + "|".join(suffixes) + ")$"), F.lit(name))
    return out.otherwise(F.lit("noun"))


def hits(lowered: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text, as substrings."""
    total = F.lit(0)
    for word in words:
        total = total + F.when(lowered.contains(word), 1).otherwise(0)
    return total


def total(array: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0), lambda acc, x: acc + value(x).cast("int"))
