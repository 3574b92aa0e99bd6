"""Line-oriented document structure: sections, flags, text tables, figures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.functions import words as wx
from scholia.operators.text import by_document

# Heading forms in the order in which they are tried:
# (pattern, flags, level or None when the marker gives it, group of the title).
HEADINGS = [
    (r"^(#{1,6})\s+(.+)$", "", None, 2),
    (r"^(\d+(?:\.\d+)*)\s+(.+)$", "", None, 2),
    (r"^(Chapter\s+\d+)\s*[:.]?\s*(.*)$", "i", 1, 2),
    (r"^(Section\s+\d+)\s*[:.]?\s*(.*)$", "i", 2, 2),
    (r"^(Part\s+[IVXLC]+)\s*[:.]?\s*(.*)$", "i", 1, 2),
    (
        r"^(Abstract|Introduction|Methodology|Methods|Results|Discussion|Conclusion|References|Bibliography"
        r"|Appendix|Acknowledgments)\s*$",
        "i", 1, 1,
    ),
    (r"^([A-Z][A-Z\s]{5,60})$", "", 2, 1),
]
HEADING_WORDS = 15


def heading(line: Column) -> Column:
    """struct(level, title) of a trimmed line, or null when it is no heading."""
    out = None
    for i, (pattern, flags, level, group) in enumerate(HEADINGS):
        marker = tx.extract(line, pattern, 1, flags)
        if level is not None:
            depth = F.lit(level)
        elif i == 0:
            depth = F.length(marker)
        else:
            depth = F.size(F.split(marker, r"\."))
        found = F.struct(
            depth.alias("level"),
            tx.sub(tx.strip(tx.extract(line, pattern, group, flags)), r"^[:.]+\s*", "").alias("title"),
        )
        test = tx.matches(line, pattern, flags)
        out = F.when(test, found) if out is None else out.when(test, found)
    return F.when(F.size(F.split(out["title"], r"\s+")) <= HEADING_WORDS, out)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) with lines trimmed."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "_l")).select(
        "doc_id", "line_no", tx.strip("_l").alias("line")
    )


def sections(docs: DataFrame) -> DataFrame:
    """Flat section rows with level, content and parent section.

    Text before the first heading counts as an introduction once it reaches a
    sixth line; the parent is the nearest earlier section of a lower level.
    """
    rows = lines(by_document(docs)).withColumn("_h", F.when(F.col("line") != "", heading(F.col("line"))))
    upto = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("_s", F.count("_h").over(upto))
    body = F.when(F.col("_h").isNull(), F.struct("line_no", "line"))
    grouped = numbered.groupBy("doc_id", "_s").agg(
        F.max("_h").alias("_h"),
        F.array_sort(F.collect_list(body)).alias("_body"),
        F.max(F.when(F.col("line") != "", F.col("line_no"))).alias("_last"),
    )
    kept = grouped.where((F.col("_s") > 0) | (F.col("_last") >= 5))
    flat = kept.select(
        "doc_id",
        F.row_number().over(W.partitionBy("doc_id").orderBy("_s")).alias("section"),
        F.when(F.col("_s") == 0, "Introduction").otherwise(F.col("_h.title")).alias("title"),
        F.when(F.col("_s") == 0, 0).otherwise(F.col("_h.level")).alias("level"),
        tx.strip(F.array_join(F.transform("_body", lambda b: b["line"]), "\n")).alias("content"),
    )
    # parents by one ordered fold over the levels of a document: open holds the chain of sections above
    none = F.array().cast("array<struct<section:int,level:int>>")
    start = F.struct(none.alias("open"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(acc["open"], lambda s: s["level"] < x["level"])
        parent = F.get(above, F.size(above) - 1)["section"]
        return F.struct(F.array_append(above, x).alias("open"), F.array_append(acc["out"], parent).alias("out"))

    levels = flat.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "level"))).alias("_all"))
    parents = levels.select("doc_id", F.posexplode(F.aggregate("_all", start, step, lambda acc: acc["out"])).alias("_at", "parent_section"))
    return flat.join(parents.withColumn("section", F.col("_at") + 1), ["doc_id", "section"]).select(
        "doc_id", "section", "title", "level", "content", "parent_section"
    )


def root_section_count(col: str) -> Column:
    """Number of top-level sections, inside the row.

    A section is top-level when no earlier one has a lower level.
    """
    trimmed = F.transform(F.split(col, "\n", -1), tx.strip)
    marked = F.transform(
        trimmed,
        lambda line, i: F.struct(
            F.when(line != "", heading(line))["level"].alias("level"), ((i >= 5) & (line != "")).alias("late")
        ),
    )
    start = F.struct(
        F.lit(None).cast("int").alias("low"), F.lit(0).alias("n"), F.lit(False).alias("intro")
    )

    def step(acc: Column, x: Column) -> Column:
        implicit = acc["low"].isNull() & x["level"].isNull() & x["late"]
        level = F.when(implicit, 0).otherwise(x["level"])
        root = level.isNotNull() & (acc["low"].isNull() | (level <= acc["low"]))
        return F.struct(
            F.when(root, level).otherwise(acc["low"]).alias("low"),
            (acc["n"] + F.when(root, 1).otherwise(0)).alias("n"),
            (acc["intro"] | implicit).alias("intro"),
        )

    return F.aggregate(marked, start, step)["n"].cast("long")


# Patterns for contents, references, appendix.
CONTENTS = [
    (r"\btable\s+of\s+contents?\b", "i"), (r"\bcontents?\s*[:.]\s*\n", "i"), (r"\bindex\s*[:.]\s*\n", "i"),
    (r"^\s*\d+\s+\.\s*\.\s*\.\s*\.\s*\d+\s*$", "m"),
]
REFERENCES = [
    (r"^\s*references?\s*$", "im"), (r"^\s*bibliography\s*$", "im"), (r"^\s*works\s+cited\s*$", "im"),
    (r"\[\d+\]\s+[A-Z][a-z]+,\s+[A-Z]", "m"), (r"\(\w+\s+(?:et\s+al\.?\s+)?\d{4}\)", "m"),
]
APPENDIX = [
    (r"^\s*appendix\s+[a-z\d]", "im"), (r"^\s*appendices?\s*$", "im"),
    (r"^\s*supplementary\s+(?:material|information)\s*$", "im"),
]


def flag_columns(col: str) -> dict[str, Column]:
    def any_of(patterns: list[tuple[str, str]]) -> Column:
        out = F.lit(False)
        for pattern, flags in patterns:
            out = out | tx.matches(col, pattern, flags)
        return out

    return {
        "has_contents": any_of(CONTENTS),
        "has_references": any_of(REFERENCES),
        "has_appendix": any_of(APPENDIX),
    }


_ENDS = "\r\u0085\u2028\u2029"


def _of_line(pattern: str) -> str:
    """A heading form as the columns read it: the dot and the end stop before any line end."""
    return wx.line_dots(pattern).removesuffix("$") + rf"(?=[{_ENDS}]?\Z)"


_HEADING_FORMS = [(re.compile(_of_line(p), re.ASCII | (re.IGNORECASE if f else 0)), level, group) for p, f, level, group in HEADINGS]
_FLAGS = [
    [(cue, re.compile(tx.rx(p), re.ASCII | (re.IGNORECASE if "i" in f else 0) | (re.MULTILINE if "m" in f else 0))) for cue, (p, f) in zip(cues, listed, strict=True)]
    for cues, listed in (
        (("contents", "content", "index", " ."), CONTENTS),
        (("reference", "bibliography", "cited", "[", "("), REFERENCES),
        (("appendix", "appendi", "supplementary"), APPENDIX),
    )
]


def _heading_level(line: str) -> int | None:
    for i, (form, level, group) in enumerate(_HEADING_FORMS):
        if found := form.search(line):
            title = re.sub(r"^[:.]+\s*", "", (found.group(group) or "").strip(wx.BLANKS), flags=re.ASCII)
            if len(wx.blank_split(title)) > HEADING_WORDS:
                return None
            return level or (len(found.group(1)) if i == 0 else found.group(1).count(".") + 1)
    return None


def _facts(text: str) -> dict:
    low, n = None, 0
    for i, line in enumerate(text.split("\n")):
        if not (line := line.strip(wx.BLANKS)):
            continue
        level = _heading_level(line)
        if low is None and level is None and i >= 5:
            level = 0
        if level is not None and (low is None or level <= low):
            low, n = level, n + 1
    lowered = text.lower()
    flags = [any(cue in lowered and form.search(text) for cue, form in listed) for listed in _FLAGS]
    return {"has_contents": flags[0], "has_references": flags[1], "has_appendix": flags[2], "n_sections": n}


def structure_facts(col: str) -> Column:
    """``flag_columns`` and ``root_section_count`` in one pass over the text."""
    return wx.column(_facts, "struct<has_contents:boolean,has_references:boolean,has_appendix:boolean,n_sections:bigint>", col)


def structure_flags(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[c.alias(n) for n, c in flag_columns("text").items()])


# --- tables -----------------------------------------------------------------

CAPTION = r"^Table\s+(\d+)[.:]\s*(.*)$"


def text_tables(docs: DataFrame) -> DataFrame:
    """Cells of pipe tables, aligned tables and captioned tables.

    One row per cell: (doc_id, table, kind, title, caption, row, col, value);
    row 0 is the header. Blocks are runs of lines found by comparing each line
    with its neighbours, so no document is read line by line in a loop.
    """
    doc = W.partitionBy("doc_id").orderBy("line_no")
    upto = doc.rowsBetween(W.unboundedPreceding, 0)
    before = doc.rowsBetween(W.unboundedPreceding, -1)
    rows = lines(by_document(docs)).withColumns(
        {
            "_pipe": F.col("line").contains("|"),
            "_wide": (F.length("line") > 10) & F.col("line").rlike(r"\s{3,}"),
            "_cap": tx.matches("line", CAPTION, "i") & ~F.col("line").contains("|"),
            "_stop": (F.col("line") == "") | tx.matches("line", r"^(?:Table|Figure)\s+\d+", "i"),
            "prev": F.lag("line").over(doc),
            "next": F.lead("line").over(doc),
        }
    )
    # lines owned by a caption: up to the next blank line or caption
    rows = rows.withColumn("_cap_at", F.last(F.when(F.col("_cap"), F.col("line_no")), True).over(before))
    rows = rows.withColumn(
        "_stop_at", F.last(F.when(F.col("_stop"), F.col("line_no")), True).over(upto)
    )
    rows = rows.withColumn(
        "_owned",
        F.col("_cap_at").isNotNull()
        & ~F.col("_stop")
        & (F.col("_stop_at") == F.col("_cap_at")),
    )
    kind = (
        F.when(F.col("_owned"), "captioned")
        .when(F.col("_pipe"), "pipe")
        .when(F.col("_wide"), "aligned")
        .otherwise("none")
    )
    rows = rows.withColumn("kind", kind)
    new = (F.col("kind") != F.lag("kind").over(doc)) | F.lag("kind").over(doc).isNull() | F.lag("_cap").over(doc)
    rows = rows.withColumn("_block", F.sum(F.when(new, 1).otherwise(0)).over(upto)).where(F.col("kind") != "none")
    # a pipe table starts at its first line with two pipes, an aligned one at
    # the first long line followed by another long one
    starts = F.when(F.col("kind") == "pipe", F.size(F.split("line", r"\|", -1)) >= 3).when(
        F.col("kind") == "aligned",
        (F.length("line") > 20) & (F.length("next") > 20) & F.col("next").rlike(r"\s{3,}"),
    ).otherwise(True)
    in_block = W.partitionBy("doc_id", "_block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    body = rows.withColumn("_on", F.max(F.when(starts, 1).otherwise(0)).over(in_block)).where("_on = 1")
    blocks = body.groupBy("doc_id", "_block").agg(
        F.first("kind").alias("kind"),
        F.array_sort(F.collect_list(F.struct("line_no", "line", "prev"))).alias("_b"),
        F.min("_cap_at").alias("_cap_at"),
    )
    text = F.transform("_b", lambda b: b["line"])
    piped = (F.col("kind") == "pipe") | (
        (F.col("kind") == "captioned") & F.exists("_b", lambda b: b["line"].contains("|"))
    )
    cells_pipe = F.transform(
        F.filter(text, lambda line, i: ~((i == 1) & line.rlike(r"^[\s|-]+$") & line.contains("-"))),
        lambda line: F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|", -1), tx.strip),
    )
    words = F.regexp_extract_all(F.get(text, 0), F.lit(r"\S+ *"), 0)
    starts_at = F.transform(
        words, lambda w, i: F.aggregate(F.slice(words, 1, i), F.lit(1), lambda acc, x: acc + F.length(x))
    )
    cells_aligned = F.transform(
        text,
        lambda line: F.transform(
            "_starts",
            lambda s, k: tx.strip(
                F.substring(line, s, F.coalesce(F.get("_starts", k + 1), F.length(line) + 1) - s)
            ),
        ),
    )
    shaped = blocks.withColumn("_starts", starts_at).withColumn(
        "_cells",
        F.when(piped, cells_pipe).otherwise(
            F.filter(cells_aligned, lambda r, i: (i == 0) | F.exists(r, lambda c: c != ""))
        ),
    )
    enough = (
        F.when(piped, F.size("_cells") >= 2)
        .when(F.col("kind") == "aligned", (F.size("_cells") >= 3) & (F.size("_starts") >= 2))
        .otherwise((F.size("_cells") >= 2) & (F.size("_starts") >= 2))
    )
    titles = rows_titles(docs)
    numbered = shaped.where(enough & (F.size("_b") >= 2)).withColumn(
        "table", F.row_number().over(W.partitionBy("doc_id").orderBy("_block"))
    )
    return (
        numbered.join(titles, ["doc_id", "_cap_at"], "left")
        .select(
            "doc_id", "table", "kind",
            F.when(F.col("kind") == "captioned", F.nullif("title", F.lit(""))).alias("title"),
            F.when(F.col("kind") == "pipe", F.get("_b", 0)["prev"]).alias("caption"),
            F.posexplode("_cells").alias("row", "_row"),
        )
        .select("doc_id", "table", "kind", "title", "caption", "row", F.posexplode("_row").alias("col", "value"))
    )


def rows_titles(docs: DataFrame) -> DataFrame:
    return lines(docs).where(tx.matches("line", CAPTION, "i")).select(
        "doc_id", F.col("line_no").alias("_cap_at"), tx.strip(tx.extract("line", CAPTION, 2, "i")).alias("title")
    )


# --- located matches and figures --------------------------------------------


def located(col: Column | str, pattern: str, flags: str = "") -> Column:
    """All matches with their 0-based start: array<struct(start, match)>.

    Starts are the running lengths of the pieces between matches.
    """
    text = F.col(col) if isinstance(col, str) else col
    java = tx.rx(pattern, flags)
    found = F.regexp_extract_all(text, F.lit(java), 0)
    between = F.split(text, java, -1)
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out")
    )

    def step(acc: Column, z: Column) -> Column:
        at = acc["at"] + F.length(z["0"])
        return F.when(
            z["1"].isNotNull(),
            F.struct(
                (at + F.length(z["1"])).alias("at"),
                F.array_append(acc["out"], F.struct(at.alias("start"), z["1"].alias("match"))).alias("out"),
            ),
        ).otherwise(acc)

    return F.aggregate(
        F.arrays_zip(between.alias("0"), found.alias("1")), start, step, lambda acc: acc["out"]
    )


# Figure patterns and types by cue.
FIGURE = r"(?:Figure|Fig\.?)\s+(\d+)[.:]\s*([^\n]+(?:\n(?!(?:Figure|Fig\.?|Table)\s+\d)[^\n]+)*)"
FIGURE_MENTION = r"(?:Figure|Fig\.?)\s+(\d+)\b"
IMAGE_NOTE = r"\[(?:Image|Figure|Diagram|Chart|Graph|Table):\s*([^\]]+)\]"
FIGURE_TYPES = [
    ("chart", r"chart|graph|plot|bar|pie|line\s+graph"),
    ("diagram", r"diagram|schematic|flowchart|flow\s+chart|architecture"),
    ("equation", r"equation|formula|expression"),
    ("table", r"table"),
    ("image", r"image|photo|picture|photograph|micrograph"),
]


def figures(docs: DataFrame) -> DataFrame:
    """Captioned figures with type and up to three mentions, and [Image: ...] notes."""
    hits = docs.select(
        "doc_id",
        "text",
        located("text", FIGURE, "i").alias("_f"),
        located("text", FIGURE_MENTION, "i").alias("_m"),
    )
    number = lambda m: tx.extract(m, FIGURE_MENTION, 1, "i")
    first = F.filter(
        "_f",
        lambda f, i: ~F.exists(
            F.slice("_f", 1, i), lambda g: number(g["match"]) == number(f["match"])
        ),
    )
    one = hits.select("doc_id", "text", "_m", F.explode(first).alias("f")).select(
        "doc_id",
        F.col("f.start").alias("start"),
        number(F.col("f.match")).alias("number"),
        tx.strip(tx.extract("f.match", FIGURE, 2, "i")).alias("caption"),
        "_m",
        "text",
    )
    lowered = F.lower("caption")
    kind = F.when(lowered.rlike(FIGURE_TYPES[0][1]), FIGURE_TYPES[0][0])
    for name, pattern in FIGURE_TYPES[1:]:
        kind = kind.when(lowered.rlike(pattern), name)
    others = F.filter("_m", lambda m: (number(m["match"]) == F.col("number")) & (m["start"] != F.col("start")))
    contexts = F.transform(
        F.slice(others, 1, 3),
        lambda m: tx.strip(
            F.substring(
                "text",
                F.greatest(m["start"] - 50, F.lit(0)) + 1,
                m["start"] + 80 - F.greatest(m["start"] - 50, F.lit(0)),
            )
        ),
    )
    captioned = one.select(
        "doc_id", "start", "number", "caption", kind.otherwise("unknown").alias("type"), contexts.alias("mentions")
    )
    notes = docs.select("doc_id", F.explode(located("text", IMAGE_NOTE, "i")).alias("n")).select(
        "doc_id",
        F.col("n.start").alias("start"),
        F.lit(None).cast("string").alias("number"),
        tx.strip(tx.extract("n.match", IMAGE_NOTE, 1, "i")).alias("caption"),
        F.lit("unknown").alias("type"),
        F.array().cast("array<string>").alias("mentions"),
    )
    unique = notes.groupBy("doc_id", "caption").agg(
        F.min("start").alias("start"), F.first("number").alias("number"), F.first("type").alias("type"),
        F.first("mentions").alias("mentions"),
    )
    return captioned.unionByName(unique.select(*captioned.columns))
