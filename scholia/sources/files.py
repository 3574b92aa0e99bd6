"""File sources: text documents of several kinds, delimited tables, file kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import text as tx
from scholia.operators.text import extraction_quality, sanitise

# File kinds by extension, by MIME type, by leading bytes (hex).
TEXT_FILES = ["txt", "md", "markdown", "csv", "json", "rtf"]
EXTENSIONS = {
    "pdf": ["pdf"],
    "image": ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tiff", "tif", "heic", "heif", "svg", "avif"],
    "text": ["txt", "md", "markdown", "csv", "json", "rtf", "log", "xml", "html", "htm"],
    "docx": ["docx"],
    "pptx": ["pptx"],
    "xlsx": ["xlsx"],
    "office": ["doc", "ppt", "xls"],
    "video": ["mp4", "webm", "ogg", "mov", "m4v"],
    "audio": ["mp3", "wav", "m4a", "aac", "flac"],
}
MIME_PREFIXES = {"image/": "image", "text/": "text", "video/": "video", "audio/": "audio"}
MIME_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/msword": "office",
    "application/vnd.ms-powerpoint": "office",
    "application/vnd.ms-excel": "office",
    "application/rtf": "office",
}
MAGIC = [
    ("pdf", 0, ["25504446"]),
    ("image", 0, ["FFD8FF", "89504E47", "474946", "424D", "52494646"]),
    ("video", 4, ["66747970"]),
    ("office", 0, ["504B03", "504B05", "504B07"]),
]


def extension(path: Column | str) -> Column:
    return F.lower(tx.extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind_from_extension(path: Column | str) -> Column:
    ext = extension(path)
    out = None
    for kind, names in EXTENSIONS.items():
        out = F.when(ext.isin(*names), kind) if out is None else out.when(ext.isin(*names), kind)
    return out.otherwise("none")


def kind_from_mime(mime: Column | str) -> Column:
    kind = F.lower(F.trim(F.get(F.split(mime, ";"), F.lit(0))))
    out = F.when(kind == "application/pdf", "pdf")
    for prefix, name in MIME_PREFIXES.items():
        out = out.when(kind.startswith(prefix), name)
    for full, name in MIME_TYPES.items():
        out = out.when(kind == full, name)
    return out.otherwise("none")


def kind_from_bytes(content: Column | str) -> Column:
    """Kind from the first sixteen bytes; only those are turned to hex."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for kind, offset, marks in MAGIC:
        test = F.lit(False)
        for mark in marks:
            test = test | (F.substring(head, offset * 2 + 1, len(mark)) == mark)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("none")


def file_kind(files: DataFrame) -> DataFrame:
    """Kind of each file (path, mime, content): extension, then MIME, then bytes.

    Bytes decide at once for a definite kind; "office" (a zip or old office
    file) is refined by extension and MIME where those say more.
    """
    ext, mime, sniffed = kind_from_extension("path"), kind_from_mime("mime"), kind_from_bytes("content")
    vague = ["none", "office"]
    refined = (
        F.when(~F.col("_x").isin(*vague), F.col("_x"))
        .when(~F.col("_m").isin(*vague), F.col("_m"))
        .when(~F.col("_b").isin(*vague), F.col("_b"))
        .when((F.col("_x") == "office") | (F.col("_m") == "office") | (F.col("_b") == "office"), "office")
        .otherwise("none")
    )
    return files.withColumns({"_x": ext, "_m": mime, "_b": sniffed}).withColumn("kind", refined).drop("_x", "_m", "_b")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder as documents with kind, clean text and confidence.

    Each file is one row; the listing is spread over the cluster by Spark's
    binary-file source, and file names are filtered before bytes are read.
    """
    names = "|".join(TEXT_FILES)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .where(extension("path").rlike(f"^(?:{names})$"))
    )
    docs = files.select(
        F.xxhash64("path").alias("doc_id"),
        "path",
        extension("path").alias("extension"),
        F.col("length").alias("size_bytes"),
        sanitise(F.decode("content", "UTF-8")).alias("text"),
    )
    return extraction_quality(docs, keep=("path", "extension", "size_bytes", "text"))


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text as rows of cells, padded to the widest row.

    Quoted cells may hold the separator or line breaks. The width is found in a
    first pass that returns one number.
    """
    lines = spark.read.text(path)
    unquoted = F.regexp_replace("value", r'"(?:[^"]|"")*"', "")
    width = lines.agg(F.max(F.size(F.split(unquoted, f"\\Q{sep}\\E", -1)))).first()[0] or 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    table = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("multiLine", "true")
        .option("escape", '"')
        .option("nullValue", "")
        .csv(path)
    )
    return table.select(*[F.coalesce(c, F.lit("")).alias(c) for c in table.columns])
