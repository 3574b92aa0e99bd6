"""Which short strings occur in which texts, as equi-joins on character grams.

A needle is looked up by one of its grams only: the one that the fewest texts hold. The
texts that hold it are candidates, and ``contains`` settles each of them. A text gives a row
for every place and gram length, so the rows grow with its length and not with the
number of needles or of their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import words as wx
from scholia.session import cut_lineage

#: Gram lengths; a needle uses the longest that it is not shorter than.
GRAMS = (8, 4, 2, 1)
#: Code points of a text whose grams are held in memory at a time.
SLICE = 65_536
#: Bits of the filter of needle grams (2 MB), and of a part of it.
BITS, PART = 2**24, 32_768


def grams(text: str | Column, size: int) -> Column:
    """All grams of size code points, overlapping, in order; one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def needle_grams(needles: DataFrame) -> DataFrame:
    """(needle, offset, gram): every gram of the needle's own gram length."""
    cut = F.lit(None).cast("array<string>")
    for size in reversed(GRAMS):
        cut = F.when(F.char_length("needle") >= size, grams(F.col("needle"), size)).otherwise(cut)
    return needles.select("needle", F.posexplode(cut).alias("offset", "gram"))


def text_grams(texts: DataFrame) -> DataFrame:
    """(id, print, gram): the grams of a text, at most one row a place and gram length.

    A long text is cut into slices that overlap by all but one character of a gram.
    """
    slices = F.regexp_extract_all("body", F.lit(f"(?s)(?=(.{{1,{SLICE + max(GRAMS) - 1}}})).{{1,{SLICE}}}"), F.lit(1))
    part = texts.select("id", "print", F.explode(slices).alias("part"))
    every = F.concat(*[grams(F.col("part"), size) for size in GRAMS])
    return part.select("id", "print", F.explode(F.array_distinct(every)).alias("gram"))


def _marks(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Per gram length the filter's place of every gram of a text."""
    mark = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    for size in reversed(GRAMS):
        if size > 1:
            half = size // 2
            mark = mark[:-half] * np.uint64(0x9E3779B97F4A7C15) + (mark[half:] ^ (mark[half:] >> np.uint64(29)))
        if not len(mark):
            return
        yield size, ((mark + np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)


def _mark(gram: str) -> int:
    return int(dict(_marks(gram))[len(gram)][0])


def gram_filter(cut: DataFrame) -> np.ndarray:
    """The bits of all needle grams, summed up in parts; of one size, however many needles there are."""
    at = cut.select(wx.column(_mark, "bigint", "gram").alias("at"))
    parts = at.groupBy(F.floor(F.col("at") / PART).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % PART).alias("bits"))
    held = np.zeros(BITS // 8, np.uint8)
    for row in parts.collect():
        held[row.part * PART // 8 : (row.part + 1) * PART // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return held


def possible_grams(texts: DataFrame, held: np.ndarray) -> DataFrame:
    """(id, print, gram): the distinct grams of a text that pass the filter, and thus all that some needle has."""

    def grams_of(body: str) -> list[str]:
        out: set[str] = set()
        for start in range(0, len(body), SLICE):
            part = body[start : start + SLICE + max(GRAMS) - 1]
            for size, marks in _marks(part):
                passed = np.flatnonzero((held[marks >> np.uint64(3)] >> (marks & np.uint64(7)).astype(np.uint8)) & 1)
                out.update(part[i : i + size] for i in passed.tolist())
        return list(out)

    return texts.select("id", "print", F.explode(wx.column(grams_of, "array<string>", "body")).alias("gram"))


def contained_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs (needle, id) where the needle is a part of one of the id's texts.

    ``needles`` has the column needle, ``texts`` the columns id and body; an id may have several
    bodies. Empty and null needles, and null or empty bodies, give no pair; a null id is kept as
    it is. Long needles and bodies are treated whole. Grams that no needle holds are left out
    by a filter in the text's row, the few that pass by chance by a join; the rest are stored; a gram of many texts is used only by needles all of
    whose grams are as common.
    """
    wanted = needles.select("needle").where("needle <> ''").distinct()
    bodies = texts.select("id", "body").where("body <> ''").withColumn("print", F.xxhash64("body"))
    cut = cut_lineage(needle_grams(wanted))
    held = cut_lineage(possible_grams(bodies, gram_filter(cut)).join(cut.select("gram").distinct(), "gram", "left_semi"))
    common = held.groupBy("gram").agg(F.count("*").alias("texts"))
    # needle with a gram that no text holds occurs nowhere: it is left without a key
    key = (
        cut.join(common, "gram", "left")
        .groupBy("needle")
        .agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "offset")).alias("gram"))
    )
    candidates = held.join(key, "gram").select("needle", F.col("id").alias("_id"), F.col("print").alias("_print")).distinct()
    settled = candidates.join(bodies, F.col("_print").eqNullSafe(F.col("print")) & F.col("_id").eqNullSafe(F.col("id")))
    return settled.where(F.contains("body", "needle")).select("needle", "id").distinct()
