"""What the operators share: slices of Arrow text, word hashes, stored intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.session import work_folder

#: Bytes of text that a task works on at once. A longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows and bytes that an Arrow batch between Spark and Python holds at most.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of loose words: every ASCII character but letters and digits.
_LOOSE = np.ones(256, bool)
_LOOSE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BYTE_CODES = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of text columns; nothing else of the session changes."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        spark.conf.set(key, str(value))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = work_folder(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(documents: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text (null: empty) and the named columns, read by name so that extra columns don't matter."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns
    )


def hash_sample(rows: DataFrame, hashed: Column, size: int, n: int) -> DataFrame:
    """The size rows of the n given with the smallest 64-bit hash.

    Rows far above the bound to be expected are left out before the sort, so that the tasks
    together send about twice the sample, however many they are. Where too few are below it
    (many rows of one hash), all are sorted.
    """
    share = min(1.0, 2 * size / max(n, 1) + 100 / max(n, 1))
    if share < 1:
        low = rows.where(hashed < F.lit(int(share * 2**64) - 2**63))
        if low.count() >= size:
            rows = low
    return rows.orderBy(hashed, *rows.columns).limit(size)


class Texts(NamedTuple):
    """Texts end to end: data holds their UTF-8 bytes, text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


def as_texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of an Arrow string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind, len(column) + 1, column.offset * width).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(held[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], at: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of column text."""
    for batch in batches:
        offsets = as_texts(batch.column("text")).offsets
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + at, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, for slices of usual size kept by the process."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        made = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE)]
        if n > SLICE_BYTES * 8:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running polynomial over random byte codes."""
    forward, back = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * forward[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    """The words of texts: of[i] is the text of word i, first[k] is the first word of text k."""

    codes: np.ndarray
    of: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(texts: Texts, lower: bool = False, loose: bool = False) -> Words:
    """Hash codes of the words of each text.

    Words are runs of bytes other than ASCII white space; with loose, runs of letters,
    digits and non-ASCII characters. lower: A-Z count as a-z.
    """
    data = _LOWER[texts.data] if lower else texts.data
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not((_LOOSE if loose else _SPACE)[data], out=inside[:-1])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = texts.offsets[:-1]
    edges = edges[edges < len(data)]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    stops = ~inside
    stops[edges] = True  # a word ends with its text
    stops = np.flatnonzero(stops)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    first = np.searchsorted(starts, texts.offsets)
    of = np.repeat(np.arange(len(texts.offsets) - 1), np.diff(first))
    return Words(span_hashes(data, starts, ends), of, first, starts, ends)


def windows_of(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of so many codes; the last size - 1 entries reach over the end and are meaningless."""
    total = np.zeros(len(codes), np.uint64)
    for k in range(min(size, len(codes))):
        scale = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 2**64))
        total[: len(codes) - k] += mix(codes[k:] + np.uint64(k + 1)) * scale
    return mix(total)


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - begin, lengths)


#: Places of a membership filter: 8 MB at any size of input. A full one lets more rows pass, never fewer.
FILTER_BITS, FILTER_PART = 1 << 26, 1 << 15


def membership_filter(keys: DataFrame) -> np.ndarray:
    """One bit for each hash of the only column (64-bit integers): no key of it is ever missed."""
    name = keys.columns[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // FILTER_PART), pa.array(at % FILTER_PART)], names=["part", "bit"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_PART, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    placed = keys.select(F.col(name).cast("long")).where(F.col(name).isNotNull()).mapInArrow(place, "part long, bit long").distinct()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in placed.groupBy("part").applyInArrow(gather, "part long, bits binary").collect():  # at most 8 MB
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * len(part) : (r["part"] + 1) * len(part)] = part
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each 64-bit key may be in the filter."""
    at = mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
